"""Keyed state as immutable snapshots: every change is DataFrames in, the next state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(RuntimeError):
    """A fail-closed gate found rows that must not exist."""


def require_none(bad: DataFrame, what: str) -> None:
    """Raises unless the frame is empty; looks at one row."""
    if row := bad.limit(1).collect():
        raise Violation(f"{what}: {row[0].asDict()}")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """The columns of several one-row frames in one row, without a product of them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _match(keys: list[str], left: str = "o", right: str = "n") -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The next snapshot: rows of new replace those of old with the same key; of several new ones the last by ``order``.

    Without an order a key that comes twice is an error: which one is the last writer could not be told.
    """
    if not order:
        require_none(new.groupBy(*keys).count().filter("count > 1"), "repeated key without an order")
    else:
        rest = [c for c in new.columns if c not in (*keys, order)]
        new = new.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in (order, *rest)])
    columns = old.columns
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), _match(keys), "full_outer")
    return joined.select(*[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new plus ``inserted``: whether the key was unknown. Of rows repeating a key the least is inserted."""
    rest = [c for c in new.columns if c not in keys]
    unique = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return unique.join(old.select(*keys).withColumn("_known", F.lit(True)).dropDuplicates(keys), keys, "left").withColumn("inserted", F.col("_known").isNull()).drop("_known")


def put_if_absent(objects: DataFrame, new: DataFrame) -> DataFrame:
    """new (key, length, checksum) plus outcome: inserted, already_exists or conflict (other bytes under the key).

    One row a key; a key that the batch itself gives with different lengths or checksums is a conflict, whatever the store holds.
    """
    rest = [c for c in new.columns if c != "key"]
    body = F.struct("length", "checksum")
    once = new.groupBy("key").agg(F.min(F.struct(*rest)).alias("_v"), (~F.min(body).eqNullSafe(F.max(body))).alias("_differs"))
    once = once.select("key", *[F.col(f"_v.{c}").alias(c) for c in rest], "_differs")
    have = objects.select("key", F.col("length").alias("_l"), F.col("checksum").alias("_c"))
    same = (F.col("length") == F.col("_l")) & F.col("checksum").eqNullSafe(F.col("_c"))
    outcome = F.when(F.col("_differs"), F.lit("conflict")).when(F.col("_l").isNull(), F.lit("inserted")).when(same, F.lit("already_exists")).otherwise(F.lit("conflict"))
    return once.join(have, "key", "left").withColumn("outcome", outcome).drop("_l", "_c", "_differs")


def copy_if_absent(objects: DataFrame, canonical: DataFrame, key: Column) -> DataFrame:
    """Rows of canonical under another key, and what became of each."""
    return put_if_absent(objects, canonical.withColumn("key", key))


def delete(old: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Idempotent: unknown keys do nothing."""
    return old.join(keys.select(*on).distinct(), list(on), "left_anti")


def commit_versions(records: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Each new record becomes a version, and the last by ``order`` the latest of its file: one snapshot holds both.

    order is a column of new that does not stay; without it a file that comes twice is an error. A version given twice is kept once.
    """
    keyed = ["record_kind", "scope_key", "file_id"]
    if not order:
        require_none(new.groupBy("scope_key", "file_id").count().filter("count > 1"), "several versions of a file without an order")
        new = new.withColumn(order := "_order", F.lit(0))
    rest = [c for c in new.columns if c not in ("scope_key", "file_id", "record_kind", order)]

    def last(keys: list[str], kind: str) -> DataFrame:
        own = [c for c in rest if c not in keys]
        top = new.groupBy(*keys).agg(F.max(F.struct(order, *own)).alias("_v"))
        return top.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in own]).withColumn("record_kind", F.lit(kind))

    version, latest = last(["scope_key", "file_id", "content_hash"], "version"), last(["scope_key", "file_id"], "latest")
    kept = records.join(latest.select(*keyed).distinct(), keyed, "left_anti")
    kept = kept.join(version.select(*keyed, "content_hash").distinct(), [*keyed, "content_hash"], "left_anti")
    return kept.unionByName(version).unionByName(latest)
