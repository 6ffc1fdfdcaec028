"""Index rebuild: version heads, latest rows, dedupe mappings, stale reconstructions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import valid_file_id, valid_hash, valid_scope_part
from .state import one_row


def heads(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``. An aggregate, so a key of many versions is combined before the shuffle."""
    rest = [c for c in versions.columns if c not in (*keys, *order)]
    return versions.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_h")).select(*keys, *[F.col(f"_h.{c}").alias(c) for c in (*order, *rest)])


def reconcile(desired: DataFrame, existing: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys plus action: rebuilt (new or other values), unchanged or removed."""
    d = desired.select(*keys, F.struct(*values).alias("_d"))
    e = existing.select(*keys, F.struct(*values).alias("_e"))
    same = F.col("_d").eqNullSafe(F.col("_e"))
    action = F.when(F.col("_d").isNull(), F.lit("removed")).when(same, F.lit("unchanged")).otherwise(F.lit("rebuilt"))
    return d.join(e, keys, "full_outer").select(*keys, action.alias("action"))


def choose_mappings(members: DataFrame) -> DataFrame:
    """(chunk_hash, shard_object_key): the smallest shard key that holds the chunk. members: shard_key, chunk_hash."""
    return members.groupBy("chunk_hash").agg(F.min("shard_key").alias("shard_object_key"))


def candidate_issue(max_bytes: int = 1 << 30) -> Column:
    """The first reason to drop a candidate; columns: record_bytes, parsed, file_id, content_hash, scope, expected_key, record_key, plan_issue."""
    scope_ok = F.col("scope").isNull() | (valid_scope_part(F.col("scope.owner")) & valid_scope_part(F.col("scope.name")))
    return (
        F.when(F.col("record_bytes") > max_bytes, F.lit("oversized_record_metadata"))
        .when(~F.col("parsed"), F.lit("invalid_record_json"))
        .when(~valid_file_id(F.col("file_id")), F.lit("invalid_file_id"))
        .when(~valid_hash(F.col("content_hash")), F.lit("invalid_content_hash"))
        .when(~scope_ok, F.lit("invalid_repository_scope"))
        .when(F.col("expected_key") != F.col("record_key"), F.lit("record_path_mismatch"))
        .when(F.col("plan_issue").isNotNull(), F.lit("invalid_reconstruction_plan"))
    )


@dataclass
class RebuildResult:
    latest: DataFrame
    mappings: DataFrame
    stale_reconstructions: DataFrame
    issues: DataFrame
    report: DataFrame


def rebuild(candidates: DataFrame, latest: DataFrame, shard_members: DataFrame, shard_issues: DataFrame, mappings: DataFrame, reconstructions: DataFrame, keys: list[str], order: list[str]) -> RebuildResult:
    """candidates: version rows with the columns of candidate_issue(). Mappings are left alone if a shard has an issue, and
    reconstructions if anything has."""
    judged = candidates.withColumn("issue", candidate_issue())
    issues = judged.filter("issue is not null").select(F.col("issue").alias("kind"), F.col("record_key").alias("location")).unionByName(shard_issues.select("kind", "location"))
    good = judged.filter("issue is null").drop("issue")
    desired = heads(good, keys, order)
    change = reconcile(desired, latest, keys, ["content_hash"])
    any_shard, any_issue = bool(shard_issues.limit(1).count()), bool(issues.limit(1).count())
    chosen = mappings if any_shard else choose_mappings(shard_members)
    stale = reconstructions.limit(0) if any_issue else reconstructions.join(desired.select("file_id").distinct(), "file_id", "left_anti")
    moved = reconcile(chosen, mappings, ["chunk_hash"], ["shard_object_key"])
    n = lambda df, a, name: df.agg(F.coalesce(F.sum(F.when(F.col("action") == a, 1).otherwise(0)), F.lit(0)).alias(name))
    parts = [candidates.agg(F.count(F.lit(1)).alias("scanned_versions")), issues.agg(F.count(F.lit(1)).alias("issues"))]
    for df, a, name in ((change, "rebuilt", "rebuilt_latest"), (change, "unchanged", "unchanged_latest"), (change, "removed", "removed_latest"), (moved, "rebuilt", "rebuilt_mappings"), (moved, "unchanged", "unchanged_mappings"), (moved, "removed", "removed_mappings")):
        parts.append(n(df, a, name))
    parts.append(stale.agg(F.count(F.lit(1)).alias("removed_reconstructions")))
    return RebuildResult(desired, chosen, stale, issues, one_row(parts))
