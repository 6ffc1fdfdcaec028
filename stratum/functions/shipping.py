"""Sends this package to the executors, so that Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_lock = threading.Lock()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
