"""Composite jobs: ingest, container and shard registration, digest-addressed puts, holds, repair chain, caches and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import CLAIM_RETENTION_SECONDS, chunk_key, classify_key, hold_active, hold_release, shard_key, xorb_key
from ..functions.shipping import ship
from . import chunking, fsck, plan, rebuild, repair
from .state import copy_if_absent, put_if_absent, require_none, upsert


#: Fixed values of the plan cache.
CACHE_SECONDS, CACHE_ENTRIES = 30, 4096


@dataclass
class Ingest:
    chunks: DataFrame
    objects: DataFrame
    records: DataFrame
    report: DataFrame


def ingest(files: DataFrame, objects: DataFrame, chunk_size: int, file: str = "file_id", hasher: str = "blake3") -> Ingest:
    """Chunk, hash, deduplicate, account and digest: files (file, content). objects: key, length, checksum.

    Chunks and contents are known by BLAKE3, or by SHA-256, which stays in the JVM.
    """
    cut = chunking.chunk_content if hasher == "sha256" else lambda f, n: chunking.chunk_content_with(f, hasher, n)
    chunks = cut(files.select(file, "content"), chunk_size)
    new = chunking.first_owners(chunks.select(file, "idx", "length", "hash"), file, "idx").select(chunk_key(F.col("hash")).alias("key"), "length", F.col("hash").alias("checksum"))
    judged = put_if_absent(objects, new)
    require_none(judged.filter("outcome = 'conflict'"), "other bytes under a chunk's key")
    known = objects.select(F.col("checksum").alias("hash"))
    report = chunking.upload_accounting(chunks.select(file, "idx", "length", "hash"), file, (file, "idx"), known)
    sizes = files.select(file, F.octet_length("content").cast("long").alias("total_bytes"))
    digest = chunking.content_digest(chunks, file, F.sum("length"), chunk_size, hasher)
    return Ingest(chunks, judged.filter("outcome = 'inserted'").drop("outcome"), sizes.join(digest, file, "left"), report)


def store_containers(members: DataFrame, lengths: DataFrame, objects: DataFrame) -> DataFrame:
    """Puts of each member chunk once and of each container. members: xorb_hash, idx, chunk_hash, length; lengths: xorb_hash, length."""
    chunks = members.groupBy(F.col("chunk_hash").alias("checksum")).agg(F.min("length").alias("length")).select(chunk_key(F.col("checksum")).alias("key"), "length", "checksum")
    containers = lengths.select(xorb_key(F.col("xorb_hash")).alias("key"), "length", F.col("xorb_hash").alias("checksum"))
    return put_if_absent(objects, chunks.unionByName(containers))


def register_shards(segments: DataFrame, members: DataFrame, shards: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms with packed ranges, mappings to commit, shards with inserted). segments: shard_hash, file_id, pos, xorb_hash, range_start, range_end;
    shards: shard_hash, chunk_hash. Fails on a segment past its container."""
    terms = plan.packed_ranges(segments, members)
    require_none(terms.filter("packed_end is null or packed_start is null"), "segment past its container")
    mappings = shards.select("chunk_hash", shard_key(F.col("shard_hash")).alias("shard_object_key")).distinct()
    own = shards.select("shard_hash").distinct().join(known.select("shard_hash").withColumn("_k", F.lit(True)), "shard_hash", "left")
    return terms, mappings, own.select("shard_hash", F.col("_k").isNull().alias("inserted"))


def commit_mappings(mappings: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Live registration: the last writer of a chunk wins."""
    return upsert(mappings, new, ["chunk_hash"], order)


def first_chunks(segments: DataFrame) -> DataFrame:
    """(xorb_hash, idx): the chunk at which some file begins, the start of each file's first segment."""
    first = segments.groupBy("file_id").agg(F.min(F.struct("pos", "xorb_hash", "range_start")).alias("s"))
    return first.select(F.col("s.xorb_hash").alias("xorb_hash"), F.col("s.range_start").alias("idx")).distinct()


def shard_of_chunk(hashes: DataFrame, mappings: DataFrame, objects: DataFrame) -> DataFrame:
    """hash, shard_object_key, length: from chunk to shard to the shard's length."""
    found = hashes.join(mappings.select(F.col("chunk_hash").alias("hash"), "shard_object_key"), "hash")
    return found.join(objects.select(F.col("key").alias("shard_object_key"), "length"), "shard_object_key")


def digest_put(objects: DataFrame, uploads: DataFrame, canonical: Column, scoped: Column) -> tuple[DataFrame, DataFrame]:
    """Digest-addressed puts: one canonical object for equal bytes, and a scoped copy for each upload. uploads: digest, length, and what scoped needs."""
    once = uploads.groupBy("digest").agg(F.min("length").alias("length")).select(canonical.alias("key"), "length", F.col("digest").alias("checksum"))
    return put_if_absent(objects, once), copy_if_absent(objects, uploads.withColumn("checksum", F.col("digest")), scoped)


def set_holds(holds: DataFrame, new: DataFrame, now: int, order: str | None = None) -> DataFrame:
    """new: object_key, reason, ttl (null: for ever), and the order column, by which the last hold of a key counts."""
    if order:
        rest = [c for c in new.columns if c not in ("object_key", order)]
        new = new.groupBy("object_key").agg(F.max(F.struct(order, *rest)).alias("_v")).select("object_key", *[F.col(f"_v.{c}").alias(c) for c in rest])
    rows = new.select("object_key", "reason", F.lit(now).cast("long").alias("held_at"), hold_release(F.lit(now).cast("long"), F.col("ttl")).alias("release_after"))
    require_none(rows.filter(F.col("reason").isNull() | (F.trim("reason") == "")), "a hold needs a reason")
    return upsert(holds, rows, ["object_key"])


def list_holds(holds: DataFrame, now: int, active_only: bool = False) -> DataFrame:
    return (holds.filter(hold_active(F.col("release_after"), now)) if active_only else holds).orderBy("object_key")


def release_holds(holds: DataFrame, keys: DataFrame) -> DataFrame:
    return holds.join(keys.select("object_key"), "object_key", "left_anti")


def repair_all(candidates: DataFrame, latest: DataFrame, shards: DataFrame, shard_issues: DataFrame, mappings: DataFrame, reconstructions: DataFrame, keys: list[str], order: list[str], holds: DataFrame, quarantine: DataFrame, deliveries: DataFrame, states: DataFrame, objects: DataFrame, reachable: DataFrame, now: int):
    """Rebuild, then lifecycle repair, then the lifecycle part of the integrity check over what is left."""
    built = rebuild.rebuild(candidates, latest, shards, shard_issues, mappings, reconstructions, keys, order)
    fixed = repair.repair(holds, quarantine, deliveries, objects, reachable, now, CLAIM_RETENTION_SECONDS)
    return built, fixed, fsck.lifecycle_issues(fixed.quarantine, fixed.holds, fixed.deliveries, states, objects, reachable, now)


def verify_objects(objects: DataFrame) -> DataFrame:
    """Objects of a managed class whose body hash differs from their name; other classes are not hashed. objects: key, body_hash."""
    return objects.withColumn("_k", classify_key(F.col("key"))).filter("_k.class = 'chunk' and body_hash <> _k.hash").drop("_k")


def evict(entries: DataFrame, now: int, capacity: int) -> DataFrame:
    """Cache entries (key, expires_at) that stay when one comes: the expired go, and at capacity the oldest one."""
    live = entries.filter(F.col("expires_at") > now)
    oldest = live.groupBy().agg(F.min(F.struct("expires_at", "key")).alias("o"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= capacity).select(F.col("o.key").alias("key"))
    return live.join(oldest, "key", "left_anti")


def get_or_load(entries: DataFrame, asked: DataFrame, load: Callable[[DataFrame], DataFrame], now: int, ttl: int = CACHE_SECONDS, capacity: int = CACHE_ENTRIES, readable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers: key, payload, hit; the next entries). entries: key, payload, expires_at; asked: key; load: keys to (key, payload).

    An entry that expired or is not readable (default: null) is loaded again. Of what was loaded and what lives on, the ``capacity``
    entries that expire last stay, ties by key.
    """
    ok = F.coalesce(F.col("payload").isNotNull() if readable is None else readable, F.lit(False))
    live = entries.filter((F.col("expires_at") > now) & ok)
    wanted = asked.select("key").distinct()
    hits = wanted.join(live, "key").select("key", "payload", F.lit(True).alias("hit"))
    loaded = load(wanted.join(live.select("key"), "key", "left_anti")).select("key", "payload")
    after = live.select("key", "payload", "expires_at").unionByName(loaded.withColumn("expires_at", F.lit(now + ttl).cast("long")))
    return hits.unionByName(loaded.withColumn("hit", F.lit(False))), after.orderBy(F.desc("expires_at"), "key").limit(capacity)


def purge_sessions(sessions: DataFrame, now: int, ttl: int) -> DataFrame:
    return sessions.filter(F.col("touched_at") + ttl > now)


def file_contains(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (record_key, hash) whose record has a term of that hash."""
    return pairs.join(terms.select("record_key", "hash").distinct(), ["record_key", "hash"], "left_semi")


def allowed_subjects(requests: DataFrame, policies: DataFrame, need: str) -> DataFrame:
    """requests (subject, provider, owner, repo) plus allowed. policies: repository, readers and writers (arrays)."""
    joined = requests.join(policies, ["provider", "owner", "repo"], "left")
    may = F.array_contains("writers", F.col("subject"))
    if need == "read":
        may = may | F.array_contains("readers", F.col("subject"))
    return joined.withColumn("allowed", F.coalesce(may, F.lit(False))).drop("readers", "writers")


def manifest_issue(document: Column, media_type: Column) -> Column:
    """Null for a well-formed image manifest: schema version 2, agreeing media type, digest and size in every descriptor."""
    d = F.from_json(document, "schemaVersion INT, mediaType STRING, config STRUCT<digest: STRING, size: BIGINT>, layers ARRAY<STRUCT<digest: STRING, size: BIGINT>>, manifests ARRAY<STRUCT<digest: STRING, size: BIGINT>>")
    all_ = F.concat(F.when(d["config"].isNotNull(), F.array(d["config"])).otherwise(F.array().cast("array<struct<digest: string, size: bigint>>")), F.coalesce(d["layers"], F.array().cast("array<struct<digest: string, size: bigint>>")), F.coalesce(d["manifests"], F.array().cast("array<struct<digest: string, size: bigint>>")))
    bad = F.exists(all_, lambda x: ~F.coalesce(x["digest"].rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False)) | F.coalesce(x["size"] < 0, F.lit(True)))
    return (
        F.when(d.isNull() | F.coalesce(d["schemaVersion"] != 2, F.lit(True)), F.lit("schema_version"))
        .when(d["mediaType"].isNotNull() & (d["mediaType"] != media_type), F.lit("media_type"))
        .when((F.size(all_) == 0) | bad, F.lit("descriptor"))
    )


def lfs_request_issue(operation: Column, objects: Column, hash_algo: Column, transfers: Column) -> Column:
    """Null for an acceptable batch request: known operation, at most 1024 objects, SHA-256, basic transfer."""
    return (
        F.when(~F.coalesce(operation.isin("download", "upload"), F.lit(False)), F.lit("operation"))
        .when(F.size(objects) > 1024, F.lit("too_many_objects"))
        .when(F.coalesce(hash_algo, F.lit("sha256")) != "sha256", F.lit("hash_algo"))
        .when(transfers.isNotNull() & (F.size(transfers) > 0) & ~F.array_contains(transfers, "basic"), F.lit("transfer"))
    )


def averages(runs: DataFrame, by: str, *values: str) -> DataFrame:
    """Runs and the whole-number mean of each measure."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), *[F.expr(f"sum({v}) div count({v})").alias(f"mean_{v}") for v in values])


def running_state(parts: DataFrame, by: str) -> DataFrame:
    """SHA-256 of bytes that came in parts (pos, content): parts stream through in order, no file is ever held as a whole."""
    kind = parts.schema[by].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state, done = None, None, []
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(content.as_buffer() or b"")
            if done:
                yield _pairs(done, batch.schema.field(0).type, by)
                done = []
        if state is not None:
            yield _pairs([(now, state.hexdigest())], batch.schema.field(0).type, by)

    ordered = parts.filter("content is not null").repartition(by).sortWithinPartitions(by, "pos").select(by, "content")
    ship(parts.sparkSession)
    return ordered.mapInArrow(digest, T.StructType([T.StructField(by, kind), T.StructField("sha256", T.StringType())]))


def _pairs(rows: list[tuple], kind: pa.DataType, by: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows])], [by, "sha256"])


def resume_digests(states: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """(by, state, sha256): uploads that go on. states: by, state (null or no row: a new upload); parts: by, pos, content, all after the state.

    One row a part in one task of an upload, in order; the state is stored between sessions. sha256 is the digest so far.
    """
    ship(parts.sparkSession)
    kind = parts.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), T.StructField("state", T.BinaryType()), T.StructField("sha256", T.StringType())])
    begun = states.select(by, F.lit(None).cast(parts.schema["pos"].dataType).alias("pos"), F.col("state").alias("content"), F.lit(0).alias("_kind"))
    rows = begun.unionByName(parts.select(by, "pos", "content", F.lit(1).alias("_kind"))).repartition(by).sortWithinPartitions(by, "_kind", "pos").select(by, "content", "_kind")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.functions.hashing import ResumableSha256

        now, held, started = None, None, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], own), pa.array([held.state()], pa.binary()), pa.array([held.hexdigest()])], [by, "state", "sha256"])

        for batch in batches:
            own = batch.schema.field(0).type
            for key, content, what in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not started or key != now:
                    if started:
                        yield row()
                    now, held, started = key, ResumableSha256(content if what == 0 else None), True
                if what == 1:
                    held.update(content or b"")
        if started:
            yield row()

    return rows.mapInArrow(go_on, schema)


def packed_is_monotonic(members: DataFrame) -> DataFrame:
    """Members whose packed or unpacked range does not follow the one before it."""
    w = Window.partitionBy("xorb_hash").orderBy("idx")
    seen = members.withColumns({"_p": F.lag("packed_end", 1, 0).over(w), "_u": F.lag("unpacked_end", 1, 0).over(w)})
    return seen.filter("packed_start <> _p or packed_end <= packed_start or unpacked_start <> _u or unpacked_end <= unpacked_start").drop("_p", "_u")
