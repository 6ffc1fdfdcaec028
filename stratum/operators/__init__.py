"""Set-oriented jobs over storage metadata: DataFrames in, DataFrames out."""
