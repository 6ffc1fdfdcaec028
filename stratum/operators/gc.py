"""Mark and sweep: orphans, quarantine, deletion, reports.

objects: key, length. quarantine: object_key, observed_length, first_seen, delete_after. holds: object_key, held_at, release_after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import classify_key, hold_active, saturating_sub
from ..sources.tables import stored
from .state import Violation, one_row, require_none


def managed(objects: DataFrame) -> DataFrame:
    """Objects of a managed class; fails on a key of managed shape that is no hash."""
    classed = objects.withColumn("_k", classify_key(F.col("key")))
    require_none(classed.filter("_k.error").select("key"), "malformed managed key")
    return classed.filter("_k.class <> 'unmanaged'").drop("_k")


def orphans(objects: DataFrame, referenced: DataFrame, holds: DataFrame | None = None, now: int = 0) -> DataFrame:
    """Objects that nothing references and no active hold keeps."""
    out = objects.join(referenced.select("key"), "key", "left_anti")
    if holds is not None:
        held = holds.filter(hold_active(F.col("release_after"), now)).select(F.col("object_key").alias("key"))
        out = out.join(held, "key", "left_anti")
    return out


def mark(quarantine: DataFrame, orphan: DataFrame, now: int, retention: int) -> DataFrame:
    """Full outer reconciliation, one row per key with its action: released, retained (same length) or new (unknown, or the length changed,
    which restarts the clock)."""
    o = orphan.select(F.col("key").alias("object_key"), F.col("length").alias("_l"))
    joined = quarantine.join(o, "object_key", "full_outer")
    action = F.when(F.col("_l").isNull(), F.lit("released")).when(F.coalesce(F.col("observed_length") == F.col("_l"), F.lit(False)), F.lit("retained")).otherwise(F.lit("new"))
    fresh = F.col("action") == "new"
    return joined.withColumn("action", action).select(
        "object_key",
        F.when(fresh, F.col("_l")).otherwise(F.col("observed_length")).alias("observed_length"),
        F.when(fresh, F.lit(now)).otherwise(F.col("first_seen")).cast("long").alias("first_seen"),
        F.when(fresh, F.lit(now + retention)).otherwise(F.col("delete_after")).cast("long").alias("delete_after"),
        "action",
    )


def sweep(quarantine: DataFrame, orphan: DataFrame, now: int) -> DataFrame:
    """quarantine plus action: released (no orphan any more), deleted (due) or kept, and the bytes that a deletion frees."""
    o = orphan.select(F.col("key").alias("object_key"), F.col("length").alias("_l"))
    joined = quarantine.join(o, "object_key", "left")
    action = F.when(F.col("_l").isNull(), F.lit("released")).when(F.col("delete_after") <= now, F.lit("deleted")).otherwise(F.lit("kept"))
    return joined.withColumn("action", action).withColumn("deleted_bytes", F.when(F.col("action") == "deleted", F.col("_l")).otherwise(F.lit(0).cast("long"))).drop("_l")


def integrity_gate(quarantine: DataFrame, holds: DataFrame, objects: DataFrame, now: int) -> None:
    """Fails on a candidate or an active hold of a missing object, a changed length, or an active hold on a candidate."""
    have = objects.select(F.col("key").alias("object_key"), F.col("length").alias("_l"))
    seen = quarantine.join(have, "object_key", "left")
    fault = (
        F.when(F.col("_l").isNull(), "quarantined object is missing")
        .when(F.col("_l") != F.col("observed_length"), "quarantined object changed its length")
        .when(F.col("delete_after") < F.col("first_seen"), "quarantine candidate ends before it begins")
    )
    active = holds.filter(hold_active(F.col("release_after"), now)).select("object_key").distinct()
    held = active.join(have, "object_key", "left").join(quarantine.select("object_key", F.lit(True).alias("_q")), "object_key", "left")
    held_fault = F.when(F.col("_l").isNull(), "held object is missing").when(F.col("_q"), "held object is quarantined")
    # One job, which ends at the first row found.
    bad = seen.select("object_key", fault.alias("fault")).unionByName(held.select("object_key", held_fault.alias("fault"))).filter("fault is not null")
    if row := bad.limit(1).collect():
        raise Violation(f"{row[0]['fault']}: {row[0]['object_key']}")


def retention_report(quarantine: DataFrame, now: int) -> DataFrame:
    """Candidates by (delete_after, key) with the seconds until each is deleted."""
    return quarantine.withColumn("seconds_until_delete", saturating_sub(F.col("delete_after"), F.lit(now).cast("long"))).orderBy("delete_after", "object_key")


def orphan_inventory(orphan: DataFrame) -> DataFrame:
    return orphan.orderBy("key")


@dataclass
class GcResult:
    report: DataFrame
    orphans: DataFrame
    quarantine: DataFrame
    holds: DataFrame
    deleted: DataFrame


def collect(objects: DataFrame, records: DataFrame, referenced: DataFrame, quarantine: DataFrame, holds: DataFrame, now: int, retention: int, do_mark: bool = False, do_sweep: bool = False) -> GcResult:
    """Dry run, mark, sweep or both. A dry run keeps expired holds, a mutating run prunes them."""
    integrity_gate(quarantine, holds, objects, now)
    if do_mark or do_sweep:
        holds = holds.filter(hold_active(F.col("release_after"), now))
    # Every part of the report reads the orphans: found once, kept in the shared folder.
    found = stored(orphans(managed(objects), referenced, holds, now), "orphans")
    zero = F.lit(0).cast("long")
    when = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), zero)
    parts = [
        records.agg(F.count(F.lit(1)).alias("scanned_records")),
        referenced.select("key").distinct().agg(F.count(F.lit(1)).alias("referenced_chunks")),
        found.agg(F.count(F.lit(1)).alias("orphan_chunks"), F.coalesce(F.sum("length"), zero).alias("orphan_bytes")),
    ]
    state = quarantine
    if do_mark:
        marked = mark(state, found, now, retention)
        parts.append(marked.agg(when(F.col("action") == "new").alias("new_candidates"), when(F.col("action") == "retained").alias("retained_candidates"), when(F.col("action") == "released").alias("_released_mark")))
        state = marked.filter("action <> 'released'").drop("action")
    else:
        parts.append(state.agg(zero.alias("new_candidates"), zero.alias("retained_candidates"), zero.alias("_released_mark")))
    deleted = state.limit(0)
    if do_sweep:
        swept = sweep(state, found, now)
        parts.append(swept.agg(when(F.col("action") != "kept").alias("_released_sweep"), when(F.col("action") == "deleted").alias("deleted_chunks"), F.coalesce(F.sum("deleted_bytes"), zero).alias("deleted_bytes")))
        deleted = swept.filter("action = 'deleted'").select("object_key")
        state = swept.filter("action = 'kept'").drop("action", "deleted_bytes")
    else:
        parts.append(state.agg(zero.alias("_released_sweep"), zero.alias("deleted_chunks"), zero.alias("deleted_bytes")))
    parts.append(state.agg(F.count(F.lit(1)).alias("active_candidates")))
    report = one_row(parts).withColumn("released_candidates", F.col("_released_mark") + F.col("_released_sweep")).drop("_released_mark", "_released_sweep")
    return GcResult(report, found, state, holds, deleted)
