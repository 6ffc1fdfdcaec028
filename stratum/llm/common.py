"""Shared plumbing of the corpus operators: table access, shared-folder tables, code shipping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

#: The six separators between words: space and 0x09 to 0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, read through Spark so that any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one only where that is unset and Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoint")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which can be removed as a whole once it has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a parquet table into the shared folder and returns the reader of it.

    The table survives the loss of any executor, and nothing upstream is computed twice.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def discard(*frames: DataFrame) -> None:
    """Removes tables of materialize() that no later step reads."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def sampled(rows: DataFrame, id: str, most: int) -> DataFrame:
    """Rows of about ``most`` ids at most, those of smallest hash; all if there are no more rows than that.

    The share that passes is set by a count, so what any later step gathers is near ``most`` whatever the input or
    its partitions; a repeated id passes or goes as one.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(id), 11) < F.lit(int(0.95 * most / n * 2**53)))


def row_hash(docs: DataFrame) -> Column:
    """64 bits of a whole row; equal for rows that are equal in every column."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of docs for each row hash in keep (digest): which of several equal rows makes no difference."""
    asked = keep.select(F.col("digest").alias("_k_keep"))
    return docs.withColumn("_k_hash", row_hash(docs)).join(asked, F.col("_k_hash") == F.col("_k_keep"), "left_semi").dropDuplicates(["_k_hash"]).drop("_k_hash")


def trim_memory() -> None:
    """Gives what Python has freed back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words(text: Column) -> Column:
    """Array of the words of a text, JVM-side; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN))


def split_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes; bytes.split() splits at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows of at most ``budget`` bytes each; a longer row is a run of its own."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > budget:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list[str]], list[list]]],
    budget: int = 4 << 20,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """df with columns computed from a text column in Arrow batches balanced by bytes; a null text counts as empty.

    make() builds the worker's function; it gets a list of texts and returns one list of values per field. New
    columns replace those of the same name. No shuffle; a lost executor only repeats its own splits. done() is called when a
    task has ended: workers stay alive for later tasks, and what make() has built would stay with them.
    """
    ship(df.sparkSession)
    names = [f[0] for f in fields]
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, t) for n, t, _ in fields])
    kept = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t_text"), *[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        try:
            for batch in batches:
                column = batch.column(0)
                for a, b in slices(pc.binary_length(column).to_pylist(), budget):
                    out = fn(column.slice(a, b - a).to_pylist())
                    arrays = [batch.column(i + 1).slice(a, b - a) for i in range(len(rest))]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(v, t) for v, (_, _, t) in zip(out, fields)], names=rest + names)
        finally:
            if done is not None:
                del fn
                done()

    return kept.mapInArrow(run, schema)
