"""Integrity check: issues as rows of one schema (kind, location, detail).

records: record_key, record_kind, scope_key, file_id, content_hash, total_bytes, expected_key, record_bytes, parsed.
terms: record_key, pos, hash, chunked, offset, length, range_start, range_end, packed_start, packed_end.
objects: key, length, body_hash (nullable: not hashed). members: xorb_hash, idx, chunk_hash, length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import chunk_key, future, hold_active, valid_file_id, valid_hash, valid_scope_part, xorb_key
from .plan import validate
from ..sources import tables
from .state import one_row

MAX_RECORD_BYTES = 1 << 30
PROVIDER_TIMES = ("last_access_changed_at", "last_revision_pushed_at", "last_cache_invalidated_at", "last_authorization_rechecked_at", "last_drift_checked_at")


def _issue(df: DataFrame, kind: str | Column, location: str, detail: str | Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    detail = F.lit(None) if detail is None else F.col(detail) if isinstance(detail, str) else detail
    return df.select(kind.alias("kind"), F.col(location).cast("string").alias("location"), detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _large(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the store: sorted and merged, never sent to the driver. The planner's estimate, compressed
    files and 20 bytes a string, is far below what a table of long keys and hashes takes in memory, and one check has many of them."""
    return df.hint("merge")


def _found(df: DataFrame, location: str, *checks: tuple[str, Column, str | None]) -> DataFrame:
    """One row for each of the checks (kind, condition, detail column) that a row fails; all are judged in one pass."""
    rows = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(kind).alias("kind"), (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"))) for kind, bad, detail in checks]
    return df.select(F.col(location).cast("string").alias("location"), F.explode(F.array_compact(F.array(*rows))).alias("_i")).select("_i.kind", "location", "_i.detail")


def record_issues(records: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """Per record: size and JSON stop it; the other checks add up. computed: record_key, digest (the recomputed content hash)."""
    big = F.col("record_bytes") > MAX_RECORD_BYTES
    readable = ~big & F.col("parsed")
    out = _found(
        records,
        "record_key",
        ("oversized_record_metadata", big, None),
        ("invalid_record_json", ~big & ~F.col("parsed"), None),
        ("invalid_file_id", readable & ~valid_file_id(F.col("file_id")), "file_id"),
        ("invalid_content_hash", readable & ~valid_hash(F.col("content_hash")), "content_hash"),
        ("record_path_mismatch", readable & (F.col("record_key") != F.col("expected_key")), "expected_key"),
    )
    if computed is not None:
        out = out.unionByName(_issue(records.filter(readable).join(_large(computed), "record_key").filter("digest <> content_hash"), "record_hash_mismatch", "record_key", "digest"))
    return out


def plan_issues(records: DataFrame, terms: DataFrame) -> DataFrame:
    return _issue(validate(terms, records.select("record_key", "total_bytes"), "record_key"), F.col("issue"), "record_key", F.col("pos"))


def term_issues(terms: DataFrame, broken: DataFrame, objects: DataFrame, members: DataFrame) -> DataFrame:
    """Chunk and container checks of records without a plan issue; a missing object hides its hash and length checks. One issue per
    referring row."""
    sound = terms.join(_large(broken.select(F.col("location").alias("record_key")).distinct()), "record_key", "left_anti")
    have = objects.select(F.col("key").alias("_key"), F.col("length").alias("_length"), "body_hash")
    there = F.col("_there").isNotNull()
    have = have.withColumn("_there", F.lit(True))
    chunks = sound.filter("chunked").withColumn("_key", chunk_key(F.col("hash"))).join(_large(have), "_key", "left")
    own = members.select("xorb_hash", "idx", "chunk_hash", F.col("length").alias("member_length"))
    counts = own.groupBy("xorb_hash").agg(F.count(F.lit(1)).alias("n"))
    xorbs = sound.filter("not chunked").withColumn("_key", xorb_key(F.col("hash"))).join(_large(have.select("_key", "_there")), "_key", "left")
    sized = xorbs.withColumn("xorb_hash", F.col("hash")).join(_large(counts), "xorb_hash", "left")
    inside = xorbs.filter("_there").select("record_key", "pos", F.col("hash").alias("xorb_hash"), "range_start", "range_end", "length").join(_large(own), "xorb_hash").filter("idx >= range_start and idx < range_end")
    sums = inside.groupBy("record_key", "pos", "xorb_hash", "length").agg(F.sum("member_length").alias("sum")).filter("sum <> length")
    found = inside.withColumn("_key", chunk_key(F.col("chunk_hash"))).join(_large(have), "_key", "left")
    return _union(
        [
            _found(
                chunks,
                "record_key",
                ("missing_chunk", ~there, "_key"),
                ("chunk_hash_mismatch", there & (F.col("body_hash") != F.col("hash")), "_key"),
                ("chunk_length_mismatch", there & (F.col("_length") != F.col("length")), "_key"),
            ),
            _found(sized, "record_key", ("missing_chunk", ~there, "_key"), ("chunk_length_mismatch", there & (F.col("range_end") > F.coalesce("n", F.lit(0))), "_key")),
            _found(
                found,
                "record_key",
                ("missing_chunk", ~there, "_key"),
                ("chunk_hash_mismatch", there & (F.col("body_hash") != F.col("chunk_hash")), "_key"),
                ("chunk_length_mismatch", there & (F.col("_length") != F.col("member_length")), "_key"),
            ),
            _issue(sums, "chunk_length_mismatch", "record_key", "xorb_hash"),
        ]
    )


def version_issues(latest: DataFrame, versions: DataFrame, on: list[str], values: list[str], location: str) -> DataFrame:
    """Latest rows whose version is missing or differs."""
    v = versions.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.struct(*values).alias("_v"), F.lit(True).alias("_there"))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)))
    joined = latest.join(_large(v), match, "left")
    return _issue(joined.filter("_there is null"), "missing_version_record", location).unionByName(_issue(joined.filter(F.col("_there") & ~F.struct(*values).eqNullSafe(F.col("_v"))), "mismatched_version_record", location))


def shard_issues(mappings: DataFrame, objects: DataFrame, members: DataFrame, unreadable: DataFrame) -> DataFrame:
    """unreadable: shard_key of shards that do not parse."""
    have = _large(objects.select(F.col("key").alias("shard_object_key")))
    there = mappings.join(have, "shard_object_key", "left_semi")
    missing = mappings.join(have, "shard_object_key", "left_anti")
    bad = _large(unreadable.select(F.col("shard_key").alias("shard_object_key")))
    readable = there.join(bad, "shard_object_key", "left_anti")
    held = members.select(F.col("shard_key").alias("shard_object_key"), "chunk_hash")
    return _union(
        [
            _issue(missing, "missing_dedupe_shard_object", "shard_object_key", "chunk_hash"),
            _issue(there.join(bad, "shard_object_key", "left_semi"), "invalid_retained_shard", "shard_object_key", "chunk_hash"),
            _issue(readable.join(_large(held), ["shard_object_key", "chunk_hash"], "left_anti"), "invalid_dedupe_shard_mapping", "shard_object_key", "chunk_hash"),
        ]
    )


def reconstruction_issues(reconstructions: DataFrame, stored: DataFrame) -> DataFrame:
    """reconstructions: file_id, terms (array of struct with object_hash); stored: object_hash. One issue per unregistered term."""
    empty = reconstructions.filter("terms is null or size(terms) = 0")
    terms = reconstructions.select("file_id", F.explode("terms").alias("t")).select("file_id", F.col("t.object_hash").alias("object_hash"))
    return _issue(empty, "empty_reconstruction", "file_id").unionByName(_issue(terms.join(_large(stored.select("object_hash").distinct()), "object_hash", "left_anti"), "missing_reconstruction_xorb", "file_id", "object_hash"))


def lifecycle_issues(quarantine: DataFrame, holds: DataFrame, deliveries: DataFrame, states: DataFrame, objects: DataFrame, reachable: DataFrame, now: int) -> DataFrame:
    have = _large(objects.select(F.col("key").alias("object_key"), F.col("length").alias("_l")))
    mark = lambda df, name: _large(df.select("object_key", F.lit(True).alias(name)).distinct())
    live = mark(reachable.select(F.col("key").alias("object_key")), "_live")
    seen = quarantine.join(have, "object_key", "left").join(live, "object_key", "left")
    held = holds.withColumn("_active", hold_active(F.col("release_after"), now)).join(have, "object_key", "left").join(mark(quarantine, "_quarantined"), "object_key", "left")
    names = valid_scope_part(F.col("owner")) & valid_scope_part(F.col("repo"))
    where = F.concat_ws("/", "provider", "owner", "repo")
    times = states.select(where.alias("at"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("t")) for c in PROVIDER_TIMES])).alias("x"))
    return _union(
        [
            _found(
                seen,
                "object_key",
                ("invalid_quarantine_candidate", F.col("delete_after") < F.col("first_seen"), None),
                ("missing_quarantined_object", F.col("_l").isNull(), None),
                ("quarantine_length_mismatch", F.col("_l") != F.col("observed_length"), None),
                ("reachable_quarantined_object", F.col("_live"), None),
            ),
            _found(
                held,
                "object_key",
                ("invalid_retention_hold", F.col("release_after") < F.col("held_at"), None),
                ("missing_held_object", F.col("_active") & F.col("_l").isNull(), None),
                ("held_quarantined_object", F.col("_active") & F.col("_quarantined"), None),
            ),
            _issue(deliveries.filter(future(F.col("processed_at"), now)), "invalid_webhook_delivery_timestamp", "delivery_id"),
            _issue(states.filter(~names).withColumn("at", where), "invalid_provider_repository_state", "at"),
            _issue(times.filter(future(F.col("x.t"), now)), "invalid_provider_repository_state_timestamp", "at", F.col("x.c")),
        ]
    )


@dataclass
class Fsck:
    issues: DataFrame
    report: DataFrame


def fsck(records: DataFrame, terms: DataFrame, objects: DataFrame, members: DataFrame, mappings: DataFrame, shard_members: DataFrame, unreadable_shards: DataFrame, reconstructions: DataFrame, stored: DataFrame, quarantine: DataFrame, holds: DataFrame, deliveries: DataFrame, states: DataFrame, reachable: DataFrame, now: int, computed: DataFrame | None = None) -> Fsck:
    """The whole integrity check: all issues, and one row of what was scanned and how many were found.

    A record's terms are checked against objects only if its plan is sound, and latest rows against versions only if they are readable.
    """
    own = tables.stored(record_issues(records, computed), "fsck-records")
    unsound = own.filter(F.col("kind").isin("oversized_record_metadata", "invalid_record_json"))
    readable = records.join(_large(unsound.select(F.col("location").alias("record_key"))), "record_key", "left_anti")
    own_terms = terms.join(_large(readable.select("record_key")), "record_key", "left_semi")
    plans = tables.stored(plan_issues(readable, own_terms), "fsck-plans")
    on = ["scope_key", "file_id", "content_hash"]
    drift = version_issues(readable.filter("record_kind = 'latest'"), readable.filter("record_kind = 'version'"), on, ["total_bytes"], "record_key")
    everything = _union(
        [
            own,
            plans,
            term_issues(own_terms, plans, objects, members),
            drift,
            shard_issues(mappings, objects, shard_members, unreadable_shards),
            reconstruction_issues(reconstructions, stored),
            lifecycle_issues(quarantine, holds, deliveries, states, objects, reachable, now),
        ]
    )
    found = tables.stored(everything, "fsck-issues")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        records.agg(*[F.coalesce(F.sum((F.col("record_kind") == k).cast("long")), F.lit(0)).alias(f"{k}_records") for k in ("latest", "version")]),
        n(own_terms, "inspected_chunk_references"),
        n(mappings, "inspected_dedupe_shard_mappings"),
        n(reconstructions, "inspected_reconstructions"),
        n(deliveries, "inspected_webhook_deliveries"),
        n(states, "inspected_provider_repository_states"),
        n(found, "issues"),
    ]
    return Fsck(found, one_row(parts))


def report(issues: DataFrame) -> DataFrame:
    """Issues by kind."""
    return issues.groupBy("kind").agg(F.count(F.lit(1)).alias("issues"))
