"""Lifecycle repair: holds first, then quarantine against the holds that survive, then webhook claims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CLAIM_RETENTION_SECONDS, delivery_class, hold_class, hold_expired, quarantine_class


@dataclass
class RepairResult:
    holds: DataFrame
    quarantine: DataFrame
    deliveries: DataFrame
    classes: DataFrame


def _flag(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Adds whether object_key is among keys."""
    known = keys.select("object_key").distinct().withColumn("_f", F.lit(True))
    return df.join(known, "object_key", "left").withColumn(name, F.col("_f").isNotNull()).drop("_f")


def repair(holds: DataFrame, quarantine: DataFrame, deliveries: DataFrame, objects: DataFrame, reachable: DataFrame, now: int, retention: int = CLAIM_RETENTION_SECONDS) -> RepairResult:
    """The surviving rows of each table, and counts by (table, class)."""
    have = objects.select(F.col("key").alias("object_key"))
    judged_holds = _flag(holds, have, "_there").withColumn("class", hold_class(F.col("_there"), hold_expired(F.col("held_at"), F.col("release_after"), now)))
    alive = judged_holds.filter("class = 'keep'")
    q = _flag(_flag(_flag(quarantine, have, "_there"), reachable.select(F.col("key").alias("object_key")), "_live"), alive, "_held")
    judged = q.withColumn("class", quarantine_class(F.col("_there"), F.col("_live"), F.col("_held")))
    claims = deliveries.withColumn("class", delivery_class(F.col("processed_at"), now, retention))
    parts = [df.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "class", "rows") for name, df in (("holds", judged_holds), ("quarantine", judged), ("deliveries", claims))]
    return RepairResult(
        alive.select(*holds.columns),
        judged.filter("class = 'keep'").select(*quarantine.columns),
        claims.filter("class = 'keep'").select(*deliveries.columns),
        parts[0].unionByName(parts[1]).unionByName(parts[2]),
    )
