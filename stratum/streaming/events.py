"""Repository webhook events: normalisation, exactly-once claims, keyed state, effects; batch core and stream wrappers.

Arrival order decides, not event time: ``arrival`` ranks events of one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DELETION_HOLD_SECONDS, branch_of, json_text, owner_and_name, reconciled_at
from ..operators.state import upsert
from ..sources.tables import current_snapshot, write_snapshot

CLAIM = ["provider", "owner", "repo", "delivery_id"]
REPOSITORY = ["provider", "owner", "repo"]
STATE = ("last_access_changed_at", "last_revision_pushed_at", "last_pushed_revision")
RECONCILED = ("last_cache_invalidated_at", "last_authorization_rechecked_at", "last_drift_checked_at")


def normalise(raw: DataFrame) -> DataFrame:
    """(provider, event, delivery_id, payload, ...) to owner, repo, kind, revision, new_owner, new_repo; other events leave.

    Providers: github and gitea (push, repository), gitlab (push, tag push, project hooks), generic (kind in the payload).
    """
    p = F.col("payload")
    full = owner_and_name(json_text(p, "$.repository.full_name", "$.project.path_with_namespace", "$.path_with_namespace", "$.repository"))
    action = json_text(p, "$.action", "$.event_name", "$.kind")
    push = F.col("event").isin("push", "Push Hook", "Tag Push Hook", "revision_pushed")
    old_name = json_text(p, "$.changes.repository.name.from", "$.old_path_with_namespace", "$.old_repository")
    renamed = action.isin("renamed", "project_rename", "repository_renamed") & old_name.isNotNull()
    kind = (
        F.when(push, F.lit("revision_pushed"))
        .when(action.isin("deleted", "project_destroy", "repository_deleted"), F.lit("repository_deleted"))
        .when(renamed, F.lit("repository_renamed"))
        .when(action.isin("edited", "privatized", "publicized", "transferred", "project_update", "access_changed"), F.lit("access_changed"))
    )
    previous = F.coalesce(owner_and_name(old_name)["name"], old_name)
    is_rename = F.col("kind") == "repository_renamed"
    out = raw.withColumns({"kind": kind, "_full": full, "_old": previous}).filter("kind is not null and _full.owner is not null")
    return out.withColumns(
        {
            "owner": F.col("_full.owner"),
            "repo": F.when(is_rename, F.col("_old")).otherwise(F.col("_full.name")),
            "revision": F.when(F.col("kind") == "revision_pushed", branch_of(json_text(p, "$.ref", "$.revision"))),
            "new_owner": F.when(is_rename, F.col("_full.owner")),
            "new_repo": F.when(is_rename, F.col("_full.name")),
        }
    ).drop("_full", "_old", "payload")


def claim(events: DataFrame, claimed: DataFrame | None = None, arrival: str = "arrival") -> DataFrame:
    """The first event of each claim key that is not claimed already. A minimum, so a delivery repeated very often is combined early."""
    rest = [c for c in events.columns if c not in (*CLAIM, arrival)]
    first = events.groupBy(*CLAIM).agg(F.min(F.struct(arrival, *rest)).alias("_e")).select(*CLAIM, *[F.col(f"_e.{c}").alias(c) for c in (arrival, *rest)])
    return first if claimed is None else first.join(claimed.select(*CLAIM), CLAIM, "left_anti")


def fold(events: DataFrame, at: str = "at", arrival: str = "arrival") -> DataFrame:
    """Per repository the last value by arrival of each field that its events set."""

    def last(value: Column, kind: str) -> Column:
        mine = (F.col("kind") == kind) & value.isNotNull()
        return F.max_by(value, F.when(mine, F.col(arrival)))

    return events.groupBy(*REPOSITORY).agg(
        last(F.col(at), "access_changed").alias("last_access_changed_at"),
        last(F.col(at), "revision_pushed").alias("last_revision_pushed_at"),
        last(F.col("revision"), "revision_pushed").alias("last_pushed_revision"),
    )


def merge_state(state: DataFrame, folded: DataFrame) -> DataFrame:
    """New value, else the previous one; reconciliation times stay."""
    new = folded.select(*REPOSITORY, *[F.col(c).alias(f"_n_{c}") for c in STATE])
    joined = state.join(new, REPOSITORY, "full_outer")
    kept = [F.col(c) for c in state.columns if c in RECONCILED]
    return joined.select(*REPOSITORY, *[F.coalesce(f"_n_{c}", c).alias(c) for c in STATE], *kept)


def reconcile(state: DataFrame, now: int) -> DataFrame:
    """Cache invalidation and rechecks happen once after the signal that asks for them."""
    signal = F.greatest("last_access_changed_at", "last_revision_pushed_at")
    return state.withColumns(
        {
            "last_cache_invalidated_at": reconciled_at(signal, F.col("last_cache_invalidated_at"), now),
            "last_authorization_rechecked_at": reconciled_at(F.col("last_access_changed_at"), F.col("last_authorization_rechecked_at"), now),
            "last_drift_checked_at": reconciled_at(F.col("last_revision_pushed_at"), F.col("last_drift_checked_at"), now),
        }
    )


def deleted_repository(records: DataFrame, terms: DataFrame, deleted: DataFrame, now: int, key: Callable[[Column], list[Column]]) -> dict[str, DataFrame]:
    """Effects of deletions: the records that remain, holds on every object key that a hash may have, and counts.

    records: record_key, provider, owner, repo, record_kind, ...; terms: record_key, hash; key: the object keys of a hash, some of which
    may not exist.
    """
    gone = records.join(deleted.select(*REPOSITORY).distinct(), REPOSITORY, "left_semi")
    hashes = terms.join(gone.select("record_key", *REPOSITORY), "record_key").select(*REPOSITORY, "hash").distinct()
    keys = hashes.select(F.explode(F.array(*key(F.col("hash")))).alias("object_key")).distinct()
    holds = keys.select("object_key", F.lit("repository deleted").alias("reason"), F.lit(now).cast("long").alias("held_at"), F.lit(now + DELETION_HOLD_SECONDS).cast("long").alias("release_after"))
    impact = gone.groupBy(*REPOSITORY).agg(F.sum(F.when(F.col("record_kind") == "version", 1).otherwise(0)).alias("versions"))
    impact = impact.join(hashes.groupBy(*REPOSITORY).agg(F.count(F.lit(1)).alias("chunks")), REPOSITORY, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    impact = impact.withColumn("holds", F.col("chunks") * len(key(F.lit(""))))
    return {"records": records.join(deleted.select(*REPOSITORY).distinct(), REPOSITORY, "left_anti"), "holds": holds, "impact": impact}


def renamed_repository(records: DataFrame, renames: DataFrame) -> DataFrame:
    """Records under their new names; the latest of a file is the version of the greatest content hash. Fails if a target differs."""
    r = renames.select(*REPOSITORY, "new_owner", "new_repo")
    moved = records.filter("record_kind = 'version'").join(r, REPOSITORY).withColumns({"owner": F.col("new_owner"), "repo": F.col("new_repo")}).drop("new_owner", "new_repo")
    stay = records.join(r, REPOSITORY, "left_anti")
    identity = [*REPOSITORY, "record_kind", "file_id", "content_hash"]
    clash = moved.alias("m").join(stay.alias("s"), [F.col(f"m.{c}") == F.col(f"s.{c}") for c in identity]).filter("m.body <> s.body")
    from ..operators.state import require_none

    require_none(clash.select("m.file_id", "m.content_hash"), "rename target differs")
    rest = [c for c in moved.columns if c not in (*REPOSITORY, "file_id", "content_hash", "record_kind")]
    head = moved.groupBy(*REPOSITORY, "file_id").agg(F.max(F.struct("content_hash", *rest)).alias("_h"))
    latest = head.select(*REPOSITORY, "file_id", F.lit("latest").alias("record_kind"), F.col("_h.content_hash").alias("content_hash"), *[F.col(f"_h.{c}").alias(c) for c in rest])
    keyed = [*REPOSITORY, "record_kind", "file_id", "content_hash"]
    fresh = moved.join(stay.select(*keyed), keyed, "left_anti")
    kept = stay.join(latest.select(*REPOSITORY, "record_kind", "file_id"), [*REPOSITORY, "record_kind", "file_id"], "left_anti")
    return kept.unionByName(fresh).unionByName(latest)


def claims_stream(events: DataFrame, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Exactly-once deliveries of a stream: unbounded without an event time, else state is dropped after the delay."""
    if event_time is None:
        return events.dropDuplicates(CLAIM)
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(CLAIM)


def run_state(events: DataFrame, read: Callable[[], DataFrame], read_claims: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Claim and apply in one micro-batch: write(state, claims, batch) must store both together, so a failed batch is retried whole."""

    def apply(batch: DataFrame, number: int) -> None:
        claims = read_claims()
        new = claim(batch, claims)
        write(merge_state(read(), fold(new)), claims.unionByName(new.select(*CLAIM, F.col("at").alias("processed_at"))), number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_store(spark, root: str, empty_state: DataFrame, empty_claims: DataFrame):
    """(read, read_claims, write) for run_state(): state and claims are one snapshot with the number of its batch.

    Readers follow the pointer, which moves last: a batch that fails leaves neither its claims nor its effects, and one that is
    repeated after it was stored changes nothing.
    """
    numbered = "batch long"

    def stored(name: str, empty: DataFrame) -> DataFrame:
        try:
            return spark.read.schema(empty.schema).parquet(f"{current_snapshot(spark, root)}/{name}")
        except AnalysisException:  # nothing was stored yet
            return empty

    def write(state: DataFrame, claims: DataFrame, batch: int) -> None:
        done = stored("batch", spark.createDataFrame([], numbered)).agg(F.max("batch")).collect()[0][0]
        if done is None or done < batch:
            write_snapshot({"state": state, "claims": claims, "batch": spark.createDataFrame([(batch,)], numbered)}, root)

    return (lambda: stored("state", empty_state)), (lambda: stored("claims", empty_claims)), write


def upsert_state(state: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(state, new, REPOSITORY)
