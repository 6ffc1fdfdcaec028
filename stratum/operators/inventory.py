"""Object inventories: pages, counts, backup manifests, migration totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import put_if_absent


#: Fixed value: keys of a page.
MAX_PAGE = 256


def prefix_scan(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.filter(F.col("key").startswith(prefix))


def page(objects: DataFrame, prefix: str, start_after: str | None, limit: int) -> DataFrame:
    """Direct children of a prefix after a key, ascending: at most limit + 1 rows, the last one telling that more follow."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} keys")
    rest = F.substring(F.col("key"), len(prefix) + 1, 1 << 20)
    children = prefix_scan(objects, prefix).filter((F.length(rest) > 0) & ~rest.contains("/"))
    if start_after is not None:
        children = children.filter(F.col("key") > start_after)
    return children.orderBy("key").limit(limit + 1)


def with_metadata(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """keys plus found and length: one join, never a lookup per row."""
    have = objects.select("key", F.col("length").alias("length"), F.lit(True).alias("_there"))
    return keys.join(have, "key", "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def existing(keys: DataFrame, objects: DataFrame) -> DataFrame:
    return keys.join(objects.select("key"), "key", "left_semi")


def read_range(objects: DataFrame, start: int, end_inclusive: int) -> DataFrame:
    """key, content slice; fails past the end of an object."""
    piece = F.substring(F.col("content"), start + 1, end_inclusive - start + 1)
    whole = F.octet_length("content") > end_inclusive
    return objects.select("key", F.when(whole, piece).otherwise(F.raise_error(F.concat(F.lit("range past the end of "), F.col("key"))).cast("binary")).alias("content"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def write_backup(tables: dict[str, DataFrame], objects: DataFrame, path: str) -> None:
    """A manifest: counts and the object entries, as JSON lines."""
    counts({**tables, "objects": objects}).write.json(f"{path}/counts")
    objects.select("key", "length").sortWithinPartitions("key").write.json(f"{path}/objects")


def migrate(source: DataFrame, target: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to write, totals: scanned, inserted, already_present, conflicts, bytes)."""
    judged = put_if_absent(target, source)
    n = lambda what: F.coalesce(F.sum(F.when(F.col("outcome") == what, 1).otherwise(0)), F.lit(0))
    totals = judged.agg(F.count(F.lit(1)).alias("scanned"), n("inserted").alias("inserted"), n("already_exists").alias("already_present"), n("conflict").alias("conflicts"), F.coalesce(F.sum(F.when(F.col("outcome") == "inserted", F.col("length"))), F.lit(0)).alias("bytes"))
    new = judged.filter("outcome = 'inserted'").drop("outcome")
    return (new.limit(0) if dry_run else new), totals
