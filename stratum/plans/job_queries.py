"""Composite jobs over inputs derived from the driver tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import fsck, gc, jobs, plan, protocols, rebuild, state
from ..sources import tables
from ..streaming import events as ev
from .queries import CHUNKS, EVENTS, HOLDS, NOW, ORPHANS, QUARANTINE, REF, _chunks, _deliveries, _files, _holds, _inventory, _order_terms, _quarantine, _referenced, _t, query

# -- containers and shards: the lines of an order are a container's members, in order

_LINES = """m AS (SELECT CAST(l_orderkey AS VARCHAR) AS x, row_number() OVER w - 1 AS i, CAST(l_partkey AS VARCHAR) AS c, CAST(l_quantity AS BIGINT) AS length, CAST(sum(l_quantity) OVER w AS BIGINT) AS packed
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), n AS (SELECT x, max(i) + 1 AS n FROM m GROUP BY x)"""


def _members(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    length = F.col("l_quantity").cast("long")
    up = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("xorb_hash"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("l_partkey").cast("string").alias("chunk_hash"), length.alias("length"), up.alias("packed_end"))
    return rows.withColumn("packed_start", F.col("packed_end") - F.col("length"))


def _segments(spark, d) -> DataFrame:
    """One segment a container: all of its members but the first and, of longer ones, the last."""
    n = _members(spark, d).groupBy("xorb_hash").agg((F.max("idx") + 1).alias("n"))
    k = F.col("xorb_hash").cast("long")
    return n.select(
        F.concat(F.lit("s"), (k % 50).cast("string")).alias("shard_hash"), F.concat(F.lit("f"), "xorb_hash").alias("file_id"), F.lit(0).cast("long").alias("pos"), "xorb_hash",
        F.when(F.col("n") > 1, 1).otherwise(0).cast("long").alias("range_start"), F.when(F.col("n") > 3, F.col("n") - 1).otherwise(F.col("n")).alias("range_end"),
    )


SEGMENTS = f"{_LINES}, seg AS (SELECT 's' || CAST(x AS BIGINT) % 50 AS shard, 'f' || x AS file, x, CASE WHEN n > 1 THEN 1 ELSE 0 END AS a, CASE WHEN n > 3 THEN n - 1 ELSE n END AS b FROM n)"


@query(f"WITH {SEGMENTS} SELECT seg.x AS xorb_hash, a AS range_start, b AS range_end, coalesce((SELECT packed FROM m WHERE m.x = seg.x AND m.i = a - 1), 0) AS packed_start, (SELECT packed FROM m WHERE m.x = seg.x AND m.i = b - 1) AS packed_end FROM seg")
def packed_ranges(spark, d):
    return plan.packed_ranges(_segments(spark, d), _members(spark, d)).select("xorb_hash", "range_start", "range_end", "packed_start", "packed_end")


@query(
    f"""WITH {SEGMENTS}, t AS (SELECT CAST(count(*) AS BIGINT) AS terms, CAST(sum((SELECT packed FROM m WHERE m.x = seg.x AND m.i = b - 1)) AS BIGINT) AS packed FROM seg),
c AS (SELECT DISTINCT 's' || CAST(x AS BIGINT) % 50 AS shard, c FROM m), p AS (SELECT c, max(shard) AS shard FROM c GROUP BY c)
SELECT terms, packed, (SELECT count(*) FROM p) AS mappings, (SELECT count(*) FROM p WHERE shard > 's3') AS late, (SELECT count(DISTINCT shard) FROM c WHERE shard NOT IN ('s1', 's2')) AS inserted FROM t"""
)
def shard_commit(spark, d):
    """Registration of fifty shards, of which two are known: terms with packed ranges, live mappings with the last writer, new shards."""
    members = _members(spark, d)
    shards = members.select(F.concat(F.lit("s"), (F.col("xorb_hash").cast("long") % 50).cast("string")).alias("shard_hash"), "chunk_hash").distinct()
    terms, mappings, own = jobs.register_shards(_segments(spark, d), members, shards, spark.createDataFrame([("s1",), ("s2",)], "shard_hash string"))
    none = spark.createDataFrame([], "chunk_hash string, shard_object_key string")
    live = jobs.commit_mappings(none, mappings, "shard_object_key")
    return state.one_row(
        [
            terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("packed_end").alias("packed")),
            live.agg(F.count(F.lit(1)).alias("mappings"), F.sum((F.col("shard_object_key") > X.shard_key(F.lit("s3"))).cast("long")).alias("late")),
            own.agg(F.sum(F.col("inserted").cast("long")).alias("inserted")),
        ]
    )


@query(f"WITH {_LINES} SELECT x AS xorb_hash, i AS idx FROM m WHERE CAST(c AS BIGINT) % 97 = 0")
def broken_containers(spark, d):
    """Members whose packed range does not follow the one before."""
    m = _members(spark, d)
    wrong = F.when(F.col("chunk_hash").cast("long") % 97 == 0, F.col("packed_start") + 1).otherwise(F.col("packed_start"))
    m = m.withColumns({"unpacked_start": F.col("packed_end") - F.col("length"), "unpacked_end": F.col("packed_end")}).withColumn("packed_start", wrong)
    return jobs.packed_is_monotonic(m).filter("packed_start < packed_end or chunk_hash % 97 = 0").select("xorb_hash", "idx")


@query(
    f"""WITH {_LINES}, o AS (SELECT substr(c, 1, 2) || '/' || c AS key, min(length) AS length FROM m GROUP BY 1 UNION ALL SELECT 'xorbs/default/' || substr(x, 1, 2) || '/' || x || '.xorb', CAST(sum(length) AS BIGINT) FROM m GROUP BY x)
SELECT CASE WHEN length % 5 = 0 THEN 'conflict' WHEN length % 2 = 0 THEN 'already_exists' ELSE 'inserted' END AS outcome, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM o GROUP BY 1"""
)
def container_store(spark, d):
    """Puts of each member once and of each container into a store that has some of them, some with other bytes."""
    members = _members(spark, d)
    lengths = members.groupBy("xorb_hash").agg(F.sum("length").alias("length"))
    none = spark.createDataFrame([], tables.SCHEMAS["objects"])
    all_ = jobs.store_containers(members, lengths, none).drop("outcome")
    have = all_.filter("length % 5 = 0 or length % 2 = 0").withColumn("length", F.col("length") + F.when(F.col("length") % 5 == 0, 1).otherwise(0))
    return jobs.store_containers(members, lengths, have).groupBy("outcome").agg(F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"))


@query(
    f"""WITH {CHUNKS}, u AS (SELECT DISTINCT hash FROM chunks), w AS (SELECT hash, 's-' || substr(hash, 1, 2) AS shard FROM u WHERE substr(hash, 64, 1) < '8') SELECT hash, shard AS shard_object_key, CAST(length(shard) AS BIGINT) AS length FROM w WHERE substr(shard, 3, 1) <> 'a'"""
)
def shard_of_chunk(spark, d):
    """From chunk to shard to the shard's length; unmapped chunks and missing shards drop out."""
    u = _chunks(spark, d).select("hash").distinct()
    mappings = u.filter("substr(hash, 64, 1) < '8'").select(F.col("hash").alias("chunk_hash"), F.concat(F.lit("s-"), F.substring("hash", 1, 2)).alias("shard_object_key"))
    objects = mappings.select(F.col("shard_object_key").alias("key"), F.length("shard_object_key").cast("long").alias("length")).distinct().filter("substr(key, 3, 1) <> 'a'")
    return jobs.shard_of_chunk(u, mappings, objects).select("hash", "shard_object_key", "length")


@query(f"WITH {CHUNKS} SELECT DISTINCT doc_id AS record_key, hash FROM chunks")
def chunks_of_files(spark, d):
    """Of all chunks of a file and of the file after it, those that the file has."""
    c = _chunks(spark, d).select(F.col("doc_id").alias("record_key"), "hash")
    pairs = c.unionByName(c.select((F.col("record_key") - 1).alias("record_key"), F.concat(F.lit("x"), "hash").alias("hash"))).distinct()
    return jobs.file_contains(c, pairs)


@query("SELECT 'shared/' || h AS key, 'inserted' AS outcome, 'once' AS what FROM (SELECT DISTINCT sha256(encode(text)) AS h FROM documents) UNION ALL SELECT DISTINCT source || '/' || sha256(encode(text)), 'inserted', 'scoped' FROM documents")
def digest_puts(spark, d):
    """Equal bytes once under their digest, and a copy in the scope of each upload."""
    uploads = _files(spark, d).select(F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("length"), "source")
    put, copies = jobs.digest_put(spark.createDataFrame([], tables.SCHEMAS["objects"]), uploads, F.concat(F.lit("shared/"), "digest"), F.concat("source", F.lit("/"), "digest"))
    return put.select("key", "outcome", F.lit("once").alias("what")).unionByName(copies.select("key", "outcome", F.lit("scoped").alias("what")))


# -- integrity


_FSCK = """rec AS (SELECT o_orderkey AS k, o_custkey, 'v:' || o_orderkey AS record_key, o_orderkey % 29 = 0 AS big, o_orderkey % 31 = 0 AS broken FROM orders),
line AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS pos, l_partkey AS p, CAST(l_quantity AS BIGINT) AS len FROM lineitem)"""


def _fsck_parts(spark, d):
    """Every order is a record of which each line is a stored chunk; parts of records, objects and tables are made wrong."""
    from pyspark.sql import Window

    hash_ = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    k = F.col("o_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    before = F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = lambda x: F.lit(x).cast("long")
    terms = _t(spark, d, "lineitem").select(
        F.concat(F.lit("v:"), "l_orderkey").alias("record_key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), hash_("l_partkey").alias("hash"), F.lit(True).alias("chunked"), before.alias("offset"), F.col("l_quantity").cast("long").alias("length"),
        n(0).alias("range_start"), n(1).alias("range_end"), n(0).alias("packed_start"), n(1).alias("packed_end"),
    )
    sums = terms.groupBy("record_key").agg(F.sum("length").alias("total"))
    versions = _t(spark, d, "orders").select(F.concat(F.lit("v:"), k).alias("record_key"), F.lit("version").alias("record_kind"), F.lit("s").alias("scope_key"), F.when(k % 13 == 0, F.concat(F.lit("a/b"), k)).otherwise(F.concat(F.lit("f-"), k)).alias("file_id"),
                                             F.when(k % 17 == 0, F.lit("bad")).otherwise(hash_("o_orderkey")).alias("content_hash"), F.when(k % 29 == 0, n(1 << 31)).otherwise(n(10)).alias("record_bytes"), (k % 31 != 0).alias("parsed"), k.alias("k"))
    versions = versions.join(sums, "record_key", "left").withColumns({"total_bytes": F.coalesce("total", n(0)) + F.when(F.col("k") % 19 == 0, 1).otherwise(0), "expected_key": F.when(F.col("k") % 23 == 0, F.lit("elsewhere")).otherwise(F.col("record_key"))}).drop("total")
    # Latest records of a third of the orders, without terms of their own; the totals of some differ, some have no version.
    latest = versions.filter("k % 3 = 0").withColumns({"record_key": F.concat(F.lit("l:"), "k"), "expected_key": F.concat(F.lit("l:"), "k"), "record_kind": F.lit("latest"), "record_bytes": n(10), "parsed": F.lit(True)})
    latest = latest.withColumns({"content_hash": F.when(F.col("k") % 37 == 0, hash_("record_key")).otherwise(F.col("content_hash")), "total_bytes": n(0), "file_id": F.when(F.col("k") % 13 == 0, F.col("file_id")).otherwise(F.concat(F.lit("f-"), "k"))})
    records = versions.unionByName(latest).drop("k")
    part = _t(spark, d, "part").filter("p_partkey % 41 <> 0")
    objects = part.select(X.chunk_key(hash_("p_partkey")).alias("key"), F.col("p_size").cast("long").alias("length"), F.when(F.col("p_partkey") % 43 == 0, F.lit("x")).otherwise(hash_("p_partkey")).alias("body_hash"))
    return records, terms, objects


def _whole_fsck(spark, d) -> fsck.Fsck:
    records, terms, objects = _fsck_parts(spark, d)
    none = lambda ddl: spark.createDataFrame([], ddl)
    mappings = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("chunk_hash"), F.concat(F.lit("shard-"), F.col("s_suppkey") % 10).alias("shard_object_key"))
    shards = mappings.select(F.col("shard_object_key").alias("key")).distinct().filter("key <> 'shard-3'").withColumns({"length": F.lit(1).cast("long"), "body_hash": F.lit(None).cast("string")})
    members_of = mappings.filter("cast(chunk_hash as long) % 4 <> 0").select(F.col("shard_object_key").alias("shard_key"), "chunk_hash")
    terms_of = F.array(F.struct((F.col("c_custkey") % 100).cast("string").alias("object_hash")))
    reconstructions = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file_id"), F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(terms_of).alias("terms"))
    stored = _t(spark, d, "customer").select((F.col("c_custkey") % 100).cast("string").alias("object_hash")).distinct().filter("object_hash <> '42'")
    quarantine, holds = _quarantine(spark, d), _holds(spark, d)
    things = _inventory(spark, d).filter("cast(key as long) % 6 <> 0").withColumn("body_hash", F.lit(None).cast("string"))
    states = _t(spark, d, "nation").select(F.lit("p").alias("provider"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("owner"), F.lit("r").alias("repo"), (NOW + (F.col("n_nationkey") - 12) * 100).cast("long").alias("last_access_changed_at"), *[F.lit(None).cast("long").alias(c) for c in fsck.PROVIDER_TIMES[1:]])
    deliveries = _deliveries(spark, d).select(*ev.CLAIM, F.col("at").alias("processed_at"))
    all_objects = objects.unionByName(shards).unionByName(things)
    return fsck.fsck(records, terms, all_objects, none("xorb_hash string, idx long, chunk_hash string, length long"), mappings, members_of, none("shard_key string"), reconstructions, stored, quarantine, holds, deliveries, states, _referenced(spark, d), NOW)


_SOUND = "SELECT v.k FROM rec v WHERE NOT v.big AND NOT v.broken AND v.k % 19 <> 0"
_ISSUES = f"""{_FSCK}, {HOLDS}, {QUARANTINE}, {REF}, obj AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS length FROM part WHERE p_partkey % 6 <> 0),
ok AS (SELECT * FROM rec WHERE NOT big AND NOT broken), act AS (SELECT object_key FROM holds WHERE release_after IS NULL OR release_after > 1706745600),
lat AS (SELECT k, k % 37 = 0 AS moved FROM rec WHERE k % 3 = 0), tot AS (SELECT k, sum(len) AS s FROM line GROUP BY k),
t AS (SELECT line.*, p_size, p_partkey FROM line JOIN ({_SOUND}) USING (k) LEFT JOIN part ON p_partkey = p AND p_partkey % 41 <> 0),
issues AS (SELECT 'oversized_record_metadata' AS kind FROM rec WHERE big UNION ALL SELECT 'invalid_record_json' FROM rec WHERE broken AND NOT big
UNION ALL SELECT 'invalid_file_id' FROM ok WHERE k % 13 = 0 UNION ALL SELECT 'invalid_file_id' FROM lat WHERE k % 13 = 0
UNION ALL SELECT 'invalid_content_hash' FROM ok WHERE k % 17 = 0 UNION ALL SELECT 'invalid_content_hash' FROM lat WHERE k % 17 = 0 AND NOT moved UNION ALL SELECT 'record_path_mismatch' FROM ok WHERE k % 23 = 0
UNION ALL SELECT 'total_bytes_mismatch' FROM ok WHERE k % 19 = 0
UNION ALL SELECT 'missing_chunk' FROM t WHERE p_partkey IS NULL UNION ALL SELECT 'chunk_hash_mismatch' FROM t WHERE p_partkey % 43 = 0 UNION ALL SELECT 'chunk_length_mismatch' FROM t WHERE p_size <> len
UNION ALL SELECT 'missing_version_record' FROM lat JOIN rec USING (k) WHERE moved OR big OR broken
UNION ALL SELECT 'mismatched_version_record' FROM lat JOIN ok USING (k) LEFT JOIN tot USING (k) WHERE NOT moved AND coalesce(s, 0) + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END <> 0
UNION ALL SELECT 'missing_dedupe_shard_object' FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT 'invalid_dedupe_shard_mapping' FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 4 = 0
UNION ALL SELECT 'empty_reconstruction' FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT 'missing_reconstruction_xorb' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 100 = 42
UNION ALL SELECT 'missing_quarantined_object' FROM q WHERE object_key NOT IN (SELECT key FROM obj) UNION ALL SELECT 'quarantine_length_mismatch' FROM q JOIN obj ON key = object_key WHERE length <> observed_length
UNION ALL SELECT 'reachable_quarantined_object' FROM q WHERE object_key IN (SELECT key FROM refs) UNION ALL SELECT 'invalid_retention_hold' FROM holds WHERE release_after < held_at
UNION ALL SELECT 'missing_held_object' FROM act WHERE object_key NOT IN (SELECT key FROM obj) UNION ALL SELECT 'held_quarantined_object' FROM act WHERE object_key IN (SELECT object_key FROM q)
UNION ALL SELECT 'invalid_provider_repository_state' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'invalid_provider_repository_state_timestamp' FROM nation WHERE (n_nationkey - 12) * 100 > 300)"""


@query(f"WITH {_ISSUES} SELECT kind, count(*) AS issues FROM issues GROUP BY 1")
def fsck_issues(spark, d):
    """All checks in one job, issues by kind."""
    return fsck.report(_whole_fsck(spark, d).issues)


@query(
    f"""WITH {_ISSUES} SELECT (SELECT count(*) FROM lat) AS latest_records, (SELECT count(*) FROM rec) AS version_records, (SELECT count(*) FROM line JOIN ok USING (k)) AS inspected_chunk_references, (SELECT count(*) FROM supplier) AS inspected_dedupe_shard_mappings,
(SELECT count(*) FROM customer) AS inspected_reconstructions, (SELECT count(*) FROM events) AS inspected_webhook_deliveries, (SELECT count(*) FROM nation) AS inspected_provider_repository_states, (SELECT count(*) FROM issues) AS issues"""
)
def fsck_report(spark, d):
    """What one integrity check scanned and found."""
    return _whole_fsck(spark, d).report


@query(
    f"""WITH {_LINES}, t AS (SELECT x, n, CASE WHEN CAST(x AS BIGINT) % 5 = 0 THEN n + 1 ELSE n END AS b, (SELECT sum(length) FROM m WHERE m.x = n.x) + CASE WHEN CAST(x AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS len FROM n)
SELECT kind, count(*) AS issues FROM (SELECT 'missing_chunk' AS kind FROM t WHERE CAST(x AS BIGINT) % 11 = 0 UNION ALL SELECT 'chunk_length_mismatch' FROM t WHERE CAST(x AS BIGINT) % 11 <> 0 AND b > n UNION ALL SELECT 'chunk_length_mismatch' FROM t WHERE CAST(x AS BIGINT) % 11 <> 0 AND CAST(x AS BIGINT) % 7 = 0
UNION ALL SELECT 'missing_chunk' FROM t JOIN m USING (x) WHERE CAST(x AS BIGINT) % 11 <> 0 AND CAST(c AS BIGINT) % 13 = 0 UNION ALL SELECT 'chunk_length_mismatch' FROM t JOIN m USING (x) JOIN part ON p_partkey = CAST(c AS BIGINT) WHERE CAST(x AS BIGINT) % 11 <> 0 AND CAST(c AS BIGINT) % 13 <> 0 AND length <> p_size
UNION ALL SELECT 'chunk_hash_mismatch' FROM t JOIN m USING (x) WHERE CAST(x AS BIGINT) % 11 <> 0 AND CAST(c AS BIGINT) % 13 <> 0 AND CAST(c AS BIGINT) % 17 = 0) GROUP BY 1"""
)
def container_term_issues(spark, d):
    """Containers and their members: missing ones, ranges past the end, sums, lengths and hashes of members."""
    members = _members(spark, d)
    k = F.col("xorb_hash").cast("long")
    whole = members.groupBy("xorb_hash").agg((F.max("idx") + 1).alias("n"), F.sum("length").alias("length"))
    terms = whole.select(F.concat(F.lit("r"), "xorb_hash").alias("record_key"), F.lit(0).cast("long").alias("pos"), F.col("xorb_hash").alias("hash"), F.lit(False).alias("chunked"), (F.col("length") + F.when(k % 7 == 0, 1).otherwise(0)).alias("length"), F.lit(0).cast("long").alias("range_start"), (F.col("n") + F.when(k % 5 == 0, 1).otherwise(0)).alias("range_end"))
    containers = whole.filter(k % 11 != 0).select(X.xorb_key(F.col("xorb_hash")).alias("key"), "length", F.lit(None).cast("string").alias("body_hash"))
    p = F.col("p_partkey")
    chunks = _t(spark, d, "part").filter(p % 13 != 0).select(X.chunk_key(p.cast("string")).alias("key"), F.col("p_size").cast("long").alias("length"), F.when(p % 17 == 0, F.lit("x")).otherwise(p.cast("string")).alias("body_hash"))
    return fsck.report(fsck.term_issues(terms, spark.createDataFrame([], "kind string, location string, detail string"), containers.unionByName(chunks), members))


@query(f"WITH {HOLDS}, {QUARANTINE} SELECT 'length' AS what, 'quarantined object changed its length' AS refused UNION ALL SELECT 'missing', 'quarantined object is missing' UNION ALL SELECT 'held', 'held object is quarantined' UNION ALL SELECT 'held_missing', 'held object is missing' UNION ALL SELECT 'order', 'quarantine candidate ends before it begins' UNION ALL SELECT 'sound', NULL")
def gate_refusals(spark, d):
    """What the collector's gate refuses, over the whole tables with one fault each, and that it lets sound ones pass."""
    inv, holds = _inventory(spark, d), _holds(spark, d)
    active = holds.filter(X.hold_active(F.col("release_after"), NOW))
    good = _quarantine(spark, d).join(active, "object_key", "left_anti").join(inv.select(F.col("key").alias("object_key"), F.col("length").alias("_l")), "object_key").withColumn("observed_length", F.col("_l")).drop("_l")
    one = good.agg(F.min("object_key")).collect()[0][0]
    cases = {
        "sound": (good, holds, inv),
        "length": (good.withColumn("observed_length", F.col("observed_length") + F.when(F.col("object_key") == one, 1).otherwise(0)), holds, inv),
        "missing": (good, holds, inv.filter(F.col("key") != one)),
        "order": (good.withColumn("delete_after", F.when(F.col("object_key") == one, F.col("first_seen") - 1).otherwise(F.col("delete_after"))), holds, inv),
        "held_missing": (good, holds, inv.filter("key <> '3'")),
        "held": (good, holds.unionByName(spark.createDataFrame([(one, 0, None)], "object_key string, held_at long, release_after long")), inv),
    }
    out = []
    for name, (q, h, objects) in cases.items():
        try:
            gc.integrity_gate(q, h, objects, NOW)
            out.append((name, None))
        except state.Violation as refused:
            out.append((name, str(refused).split(":")[0]))
    return spark.createDataFrame(out, "what string, refused string")


@query("SELECT 'batch' AS what, 'more than 1024 files of a batch request' AS refused UNION ALL SELECT 'lfs', 'more than 1024 objects' UNION ALL SELECT 'tags', 'a page has 1 to 128 tags' UNION ALL SELECT 'page', 'a page has 1 to 256 keys'")
def cap_refusals(spark, d):
    """Requests beyond the fixed limits are refused, not cut."""
    from ..operators import inventory

    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderkey").alias("file_id"), F.col("o_orderkey").alias("position"), F.lit("b").alias("batch"))
    terms, _ = _order_terms(spark, d)
    calls = {
        "batch": lambda: plan.batch_fetch_info(terms, o),
        "lfs": lambda: protocols.lfs_batch(o, o, "upload"),
        "tags": lambda: protocols.tag_page(o, "r", None, 129),
        "page": lambda: inventory.page(o, "", None, 257),
    }
    out = []
    for name, call in calls.items():
        try:
            call()
            out.append((name, None))
        except (state.Violation, ValueError) as refused:
            out.append((name, str(refused).split(":")[0]))
    return spark.createDataFrame(out, "what string, refused string")


# -- rebuild and repair


def _rebuild(spark, d, broken: bool) -> rebuild.RebuildResult:
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    candidates = o.select(
        F.lit("s").alias("scope_key"), F.concat(F.lit("f-"), "o_custkey").alias("file_id"), F.sha2(k.cast("string").cast("binary"), 256).alias("content_hash"), at.alias("modified"), F.concat(F.lit("v:"), k).alias("record_key"),
        F.concat(F.lit("v:"), k).alias("expected_key"), F.lit(10).cast("long").alias("record_bytes"), F.lit(True).alias("parsed"), F.lit(None).cast("struct<owner: string, name: string>").alias("scope"),
        F.when((k % 101 == 0) & F.lit(broken), F.lit("empty_chunk")).alias("plan_issue"),
    )
    heads = rebuild.heads(candidates.select("scope_key", "file_id", "modified", "content_hash"), ["scope_key", "file_id"], ["modified", "content_hash"])
    c = F.regexp_extract("file_id", "([0-9]+)", 1).cast("long")
    latest = heads.withColumn("content_hash", F.when(c % 7 == 0, F.lit("old")).otherwise(F.col("content_hash"))).filter(c % 5 != 0).unionByName(spark.createDataFrame([("s", 0, "gone", "f-gone")], "scope_key string, modified long, content_hash string, file_id string"))
    p = _t(spark, d, "part")
    members = p.select(F.concat(F.lit("s-"), "p_brand").alias("shard_key"), F.col("p_size").cast("string").alias("chunk_hash"))
    mappings = members.groupBy("chunk_hash").agg(F.max("shard_key").alias("shard_object_key"))
    reconstructions = o.select(F.concat(F.lit("f-"), "o_custkey").alias("file_id")).distinct().unionByName(spark.createDataFrame([("f-stale",)], "file_id string"))
    return rebuild.rebuild(candidates, latest, members, spark.createDataFrame([], "kind string, location string"), mappings, reconstructions, ["scope_key", "file_id"], ["modified", "content_hash"])


_HEADS = """v AS (SELECT o_custkey AS c, sha256(encode(CAST(o_orderkey AS VARCHAR))) AS h, epoch(o_orderdate) AS m, o_orderkey % 101 = 0 AS bad FROM orders), d AS (SELECT c, h FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, h DESC) AS k FROM v) WHERE k = 1),
e AS (SELECT c, h FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, h DESC) AS k FROM v WHERE NOT bad) WHERE k = 1), old AS (SELECT c, CASE WHEN c % 7 = 0 THEN 'old' ELSE h END AS h FROM d WHERE c % 5 <> 0 UNION ALL SELECT -1, 'gone'),
mp AS (SELECT p_size, min('s-' || p_brand) AS a, max('s-' || p_brand) AS b FROM part GROUP BY 1)"""


def _rebuild_sql(heads: str, name: str, issues: str, stale: str) -> str:
    return f"""SELECT '{name}' AS run, (SELECT count(*) FROM v) AS scanned_versions, {issues} AS issues, (SELECT count(*) FROM {heads} x LEFT JOIN old USING (c) WHERE old.h IS DISTINCT FROM x.h) AS rebuilt_latest, (SELECT count(*) FROM {heads} x JOIN old USING (c) WHERE old.h = x.h) AS unchanged_latest,
(SELECT count(*) FROM old WHERE c NOT IN (SELECT c FROM {heads})) AS removed_latest, (SELECT count(*) FROM mp WHERE a <> b) AS rebuilt_mappings, (SELECT count(*) FROM mp WHERE a = b) AS unchanged_mappings, CAST(0 AS BIGINT) AS removed_mappings, CAST({stale} AS BIGINT) AS removed_reconstructions"""


@query(f"WITH {_HEADS} {_rebuild_sql('d', 'clean', 'CAST(0 AS BIGINT)', '1')} UNION ALL {_rebuild_sql('e', 'broken', '(SELECT count(*) FROM v WHERE bad)', '0')}")
def rebuild_report(spark, d):
    """Two rebuilds: stale reconstructions go only if nothing has an issue."""
    runs = [_rebuild(spark, d, broken).report.withColumn("run", F.lit(name)) for name, broken in (("clean", False), ("broken", True))]
    return runs[0].unionByName(runs[1])


@query(f"WITH {_HEADS} SELECT 'f-' || c AS file_id, h AS content_hash FROM e")
def rebuild_latest(spark, d):
    return _rebuild(spark, d, True).latest.select("file_id", "content_hash")


@query("SELECT CAST(p_size AS VARCHAR) AS chunk_hash, min('s-' || p_brand) AS shard_object_key FROM part GROUP BY 1")
def rebuild_mappings(spark, d):
    return _rebuild(spark, d, False).mappings.select("chunk_hash", "shard_object_key")


@query(
    f"""WITH {REF}, {HOLDS}, {QUARANTINE}, {EVENTS}, obj AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS length FROM part WHERE p_partkey % 6 <> 0),
h AS (SELECT * FROM holds WHERE NOT coalesce(release_after < held_at OR release_after <= 1706745600, false) AND object_key IN (SELECT key FROM obj)),
k AS (SELECT * FROM q WHERE object_key IN (SELECT key FROM obj) AND object_key NOT IN (SELECT key FROM refs) AND object_key NOT IN (SELECT object_key FROM h))
SELECT 'holds' AS what, count(*) AS rows FROM h UNION ALL SELECT 'quarantine', count(*) FROM k UNION ALL SELECT 'deliveries', count(*) FROM ev WHERE secs <= 1706745900 AND secs > 1706745600 - 2592000 UNION ALL SELECT 'rebuilt', count(*) FROM orders WHERE o_custkey < 0
UNION ALL SELECT kind, count(*) FROM (SELECT 'quarantine_length_mismatch' AS kind FROM k JOIN obj ON key = object_key WHERE length <> observed_length UNION ALL SELECT 'invalid_provider_repository_state' FROM nation WHERE n_nationkey % 5 = 0) GROUP BY 1"""
)
def repair_chain(spark, d):
    """Rebuild, lifecycle repair, and the check of what is left: only what repair does not touch is found."""
    objects = _inventory(spark, d).filter("cast(key as long) % 6 <> 0")
    states = _t(spark, d, "nation").select(F.lit("p").alias("provider"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("owner"), F.lit("r").alias("repo"), *[F.lit(None).cast("long").alias(c) for c in fsck.PROVIDER_TIMES])
    deliveries = _deliveries(spark, d).select(*ev.CLAIM, F.col("at").alias("processed_at"))
    empty = _rebuild(spark, d, False)
    candidates = spark.createDataFrame([], "scope_key string, file_id string, content_hash string, modified long, record_key string, expected_key string, record_bytes long, parsed boolean, scope struct<owner: string, name: string>, plan_issue string")
    built, fixed, left = jobs.repair_all(
        candidates, empty.latest.limit(0), spark.createDataFrame([], "shard_key string, chunk_hash string"), spark.createDataFrame([], "kind string, location string"), empty.mappings.limit(0), spark.createDataFrame([], "file_id string"),
        ["scope_key", "file_id"], ["modified", "content_hash"], _holds(spark, d), _quarantine(spark, d), deliveries, states, objects, _referenced(spark, d), NOW,
    )
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")
    out = n(fixed.holds, "holds").unionByName(n(fixed.quarantine, "quarantine")).unionByName(n(fixed.deliveries, "deliveries")).unionByName(n(built.latest, "rebuilt"))
    return out.unionByName(fsck.report(left).toDF("what", "rows"))


# -- repositories and protocols


@query(
    """WITH v AS (SELECT o_custkey AS c, o_custkey % 10 AS repo, CAST(o_orderkey AS VARCHAR) AS h FROM orders), x AS (SELECT c, CASE WHEN repo = 3 THEN 'new3' WHEN repo = 4 THEN 'new4' ELSE 'r' || repo END AS repo, h FROM v),
l AS (SELECT repo, c, max(h) AS h FROM x GROUP BY 1, 2) SELECT repo, 'version' AS record_kind, 'f' || c AS file_id, h AS content_hash FROM x UNION ALL SELECT repo, 'latest', 'f' || c, h FROM l"""
)
def renamed_repositories(spark, d):
    """Two of ten repositories get new names; all latest rows are the greatest content hash here."""
    o = _t(spark, d, "orders")
    scope = [F.lit("p").alias("provider"), F.lit("o").alias("owner"), F.concat(F.lit("r"), F.col("o_custkey") % 10).alias("repo"), F.concat(F.lit("f"), "o_custkey").alias("file_id")]
    version = o.select(*scope, F.lit("version").alias("record_kind"), F.col("o_orderkey").cast("string").alias("content_hash"), F.lit("b").alias("body"))
    latest = version.groupBy("provider", "owner", "repo", "file_id").agg(F.max("content_hash").alias("content_hash")).withColumns({"record_kind": F.lit("latest"), "body": F.lit("b")})
    renames = spark.createDataFrame([("p", "o", "r3", "o", "new3"), ("p", "o", "r4", "o", "new4")], "provider string, owner string, repo string, new_owner string, new_repo string")
    return ev.renamed_repository(version.unionByName(latest.select(*version.columns)), renames).select("repo", "record_kind", "file_id", "content_hash")


@query("SELECT 'differs' AS what, 'rename target differs' AS refused UNION ALL SELECT 'equal', NULL")
def rename_conflicts(spark, d):
    """A rename onto records of other bytes is refused, onto equal ones it is not."""
    o = _t(spark, d, "orders").filter("o_custkey % 10 in (3, 5)")
    version = o.select(F.lit("p").alias("provider"), F.lit("o").alias("owner"), F.concat(F.lit("r"), F.col("o_custkey") % 10).alias("repo"), F.lit("f").alias("file_id"), F.lit("version").alias("record_kind"), F.lit("same").alias("content_hash"), F.lit("b").alias("body")).distinct()
    renames = spark.createDataFrame([("p", "o", "r3", "o", "r5")], "provider string, owner string, repo string, new_owner string, new_repo string")
    out = []
    for name, body in (("differs", F.col("repo")), ("equal", F.lit("b"))):
        try:
            ev.renamed_repository(version.withColumn("body", body), renames).count()
            out.append((name, None))
        except state.Violation as refused:
            out.append((name, str(refused).split(":")[0]))
    return spark.createDataFrame(out, "what string, refused string")


_TAGS = "t AS (SELECT p_brand AS repository, p_name || '-' || p_partkey AS tag, 'd' || (p_partkey % 10) AS digest, p_partkey AS k FROM part)"


def _tags(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    return _t(spark, d, "part").select(F.col("p_brand").alias("repository"), F.concat_ws("-", "p_name", p.cast("string")).alias("tag"), F.concat(F.lit("d"), (p % 10).cast("string")).alias("digest"), p.alias("k"))


@query(f"WITH {_TAGS} SELECT repository, tag, CASE WHEN k % 3 = 0 THEN 'd0' ELSE digest END AS digest, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 10 END AS size FROM t WHERE k % 3 = 0 OR k % 10 < 8")
def oci_tags_resolved(spark, d):
    """Some tags are moved; those that point at a manifest come with it."""
    t = _tags(spark, d)
    moved = protocols.move_tags(t.drop("k"), t.filter("k % 3 = 0").select("repository", "tag", F.lit("d0").alias("digest")))
    digests = spark.range(8).select(F.concat(F.lit("d"), "id").alias("digest"), F.col("id").alias("size"))
    manifests = t.select("repository").distinct().withColumn("digest", F.explode(F.array(*[F.lit(f"d{i}") for i in range(8)]))).join(digests, "digest")
    return protocols.resolve_tags(moved, manifests).select("repository", "tag", "digest", "size")


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS repository, CAST(l_orderkey AS VARCHAR) AS digest, 'p' || l_partkey AS missing FROM lineitem WHERE l_partkey % 5 = 0")
def oci_missing_descriptors(spark, d):
    """Descriptors of manifests that no blob of the repository has."""
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("repository"), F.col("l_orderkey").cast("string").alias("digest"), F.concat(F.lit("p"), "l_partkey").alias("blob"), F.col("l_partkey").alias("k"))
    manifests = lines.groupBy("repository", "digest").agg(F.collect_set("blob").alias("descriptors"))
    return protocols.missing_descriptors(manifests, lines.filter("k % 5 <> 0").select("repository", F.col("blob").alias("digest")).distinct())


# -- streams, caches, sessions


@query(
    f"""WITH {EVENTS}, s AS (SELECT owner, repo, arg_max(secs, arrival) FILTER (WHERE kind = 'access_changed') AS a, arg_max(revision, arrival) FILTER (WHERE kind = 'revision_pushed' AND revision IS NOT NULL) AS v FROM ev WHERE arrival % 10 < 5 GROUP BY 1, 2),
n AS (SELECT owner, repo, arg_max(secs, arrival) FILTER (WHERE kind = 'access_changed') AS a, arg_max(revision, arrival) FILTER (WHERE kind = 'revision_pushed' AND revision IS NOT NULL) AS v FROM ev WHERE arrival % 10 >= 5 AND kind = 'revision_pushed' GROUP BY 1, 2)
SELECT owner, repo, coalesce(n.a, s.a) AS last_access_changed_at, coalesce(n.v, s.v) AS last_pushed_revision FROM s FULL JOIN n USING (owner, repo)"""
)
def repo_state_merge(spark, d):
    """A later batch sets some fields; the others keep what they had."""
    e = _deliveries(spark, d)
    before = ev.fold(e.filter("arrival % 10 < 5")).withColumns({c: F.lit(None).cast("long") for c in ev.RECONCILED})
    return ev.merge_state(before, ev.fold(e.filter("arrival % 10 >= 5 and kind = 'revision_pushed'"))).select("owner", "repo", "last_access_changed_at", "last_pushed_revision")


@query(f"WITH {EVENTS} SELECT owner, repo, delivery_id FROM ev GROUP BY 1, 2, 3")
def streamed_claims(spark, d):
    """All events as a stream in micro-batches of a file each: every delivery is claimed once, with the retention as watermark."""
    root = tables.scratch(spark, "stream")
    rows = _deliveries(spark, d).withColumn("ts", F.timestamp_seconds("at"))
    rows.repartitionByRange(4, "at").sortWithinPartitions("at").write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    claims = ev.claims_stream(source, "ts", f"{X.CLAIM_RETENTION_SECONDS} seconds").select("owner", "repo", "delivery_id")
    claims.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("owner string, repo string, delivery_id string").parquet(f"{root}/out")


@query(
    f"""WITH {EVENTS}, f AS (SELECT owner, repo, delivery_id, min(arrival) AS arrival FROM ev GROUP BY 1, 2, 3), w AS (SELECT ev.* FROM ev JOIN f USING (owner, repo, delivery_id, arrival))
SELECT owner, repo, count(*) AS claims, arg_max(secs, arrival) FILTER (WHERE kind = 'access_changed') AS last_access_changed_at FROM w GROUP BY 1, 2"""
)
def streamed_state(spark, d):
    """Claims and state of the whole event stream, stored together after each micro-batch; repeats across batches change nothing."""
    root = tables.scratch(spark, "stream")
    rows = _deliveries(spark, d)
    rows.repartitionByRange(3, "arrival").sortWithinPartitions("arrival").write.parquet(f"{root}/in")
    none = spark.createDataFrame([], "provider string, owner string, repo string, last_access_changed_at long, last_revision_pushed_at long, last_pushed_revision string")
    claims = spark.createDataFrame([], "provider string, owner string, repo string, delivery_id string, processed_at long")
    read, read_claims, write = ev.snapshot_store(spark, f"{root}/store", none, claims)
    # The files are named by partition, so they come in order of arrival.
    source = spark.readStream.schema(rows.schema).option("latestFirst", "false").option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
    ev.run_state(source, read, read_claims, write, f"{root}/ck").awaitTermination()
    counts = read_claims().groupBy("owner", "repo").agg(F.count(F.lit(1)).alias("claims"))
    return read().select("owner", "repo", "last_access_changed_at").join(counts, ["owner", "repo"])


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 100 > 50 AND c_custkey % 7 <> 0 AS live FROM customer), e AS (SELECT k, live, CASE WHEN live THEN k % 100 ELSE 80 END AS expires_at FROM c)
SELECT 'answer' AS what, k AS key, CASE WHEN live THEN 'old' ELSE 'new' END AS payload, live AS hit FROM e UNION ALL SELECT 'entry', k, CASE WHEN live THEN 'old' ELSE 'new' END, NULL FROM (SELECT * FROM e ORDER BY expires_at DESC, k LIMIT 500)"""
)
def cache_answers(spark, d):
    """All keys are asked: live entries answer, expired and unreadable ones are loaded; 500 entries stay."""
    k = F.col("c_custkey")
    entries = _t(spark, d, "customer").select(k.alias("key"), F.when(k % 7 != 0, F.lit("old")).alias("payload"), (k % 100).cast("long").alias("expires_at"))
    answers, after = jobs.get_or_load(entries, entries, lambda keys: keys.withColumn("payload", F.lit("new")), 50, capacity=500)
    rows = answers.withColumn("what", F.lit("answer")).select("what", "key", "payload", "hit")
    return rows.unionByName(after.select(F.lit("entry").alias("what"), "key", "payload", F.lit(None).cast("boolean").alias("hit")))


@query(f"WITH {EVENTS} SELECT arrival FROM ev WHERE secs + 3600 > 1705968000")
def live_sessions(spark, d):
    sessions = _deliveries(spark, d).select("arrival", F.col("at").alias("touched_at"))
    return jobs.purge_sessions(sessions, 1_705_968_000, 3600).select("arrival")


@query("SELECT conv_id, sha256(encode(string_agg(text, '' ORDER BY turn))) AS sha256 FROM conversations GROUP BY 1")
def resumed_uploads(spark, d):
    """Each conversation as an upload in two sessions; the state between them is a stored table."""
    parts = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.encode("text", "UTF-8").alias("content"))
    none = spark.createDataFrame([], "conv_id long, state binary")
    root = tables.scratch(spark, "uploads")
    jobs.resume_digests(none, parts.filter("pos < 2"), "conv_id").write.parquet(root)
    states = spark.read.schema("conv_id long, state binary, sha256 string").parquet(root)
    return jobs.resume_digests(states.select("conv_id", "state"), parts.filter("pos >= 2"), "conv_id").select("conv_id", "sha256")


@query("SELECT doc_id, sha256(encode(text)) AS sha256 FROM documents WHERE octet_length(encode(text)) > 0")
def file_part_digests(spark, d):
    """Files as ordered parts from deduplicated objects, and the digest of each as the parts stream by."""
    files = _files(spark, d)
    n, size = F.octet_length("content").cast("long"), F.lit(1024).cast("long")
    at = F.sequence(F.lit(0).cast("long"), n - 1, size)
    pieces = files.filter(n > 0).select(F.explode(F.transform(at, lambda a: F.substring(F.col("content"), (a + 1).cast("int"), F.lit(1024)))).alias("content"))
    objects = pieces.withColumn("hash", F.sha2("content", 256)).groupBy("hash").agg(F.first("content").alias("content"))
    terms = _chunks(spark, d).select("doc_id", F.col("idx").alias("pos"), "hash", "length")
    return jobs.running_state(plan.file_parts(terms, objects, "doc_id"), "doc_id")


@query(f"WITH {SEGMENTS} SELECT 'terms' AS what, count(*) AS rows FROM seg UNION ALL SELECT 'mappings', count(DISTINCT c) FROM m UNION ALL SELECT 'latest', count(*) FROM seg UNION ALL SELECT 'version', count(*) FROM seg")
def shard_snapshot(spark, d):
    """Terms, mappings, versions and latest records of a registration, stored as one snapshot and read through its pointer."""
    members = _members(spark, d)
    shards = members.select(F.concat(F.lit("s"), (F.col("xorb_hash").cast("long") % 50).cast("string")).alias("shard_hash"), "chunk_hash").distinct()
    terms, mappings, _ = jobs.register_shards(_segments(spark, d), members, shards, spark.createDataFrame([], "shard_hash string"))
    records = terms.select(F.lit("s").alias("scope_key"), "file_id", F.col("xorb_hash").alias("content_hash"))
    none = spark.createDataFrame([], "record_kind string, scope_key string, file_id string, content_hash string")
    live = jobs.commit_mappings(spark.createDataFrame([], "chunk_hash string, shard_object_key string"), mappings, "shard_object_key")
    root = tables.scratch(spark, "commit")
    tables.write_snapshot({"terms": terms, "mappings": live, "records": state.commit_versions(none, records)}, root)
    now = tables.current_snapshot(spark, root)
    n = lambda name, what: spark.read.parquet(f"{now}/{name}").groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    return n("terms", F.lit("terms")).unionByName(n("mappings", F.lit("mappings"))).unionByName(n("records", F.col("record_kind")))
