"""Each operator over inputs derived from the driver tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import chunking, fsck, gc, inventory, jobs, plan, protocols, reach, rebuild, repair, state
from ..streaming import events as ev

NOW = 1_706_745_600
CHUNK = 1024
DAY = 86_400


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- inputs


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.encode("text", "UTF-8").alias("content"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_content(_files(spark, d), CHUNK)


CHUNKS = """files AS (SELECT doc_id, lang, source, encode(text) AS b, octet_length(encode(text)) AS n FROM documents),
starts AS (SELECT doc_id, lang, source, b, n, unnest(range(0, n, 1024)) AS b0 FROM files WHERE n > 0),
chunks AS (SELECT doc_id, lang, source, n, b0 // 1024 AS idx, b0 AS "offset", least(1024, n - b0) AS length, sha256(b[b0 + 1:b0 + 1024]) AS hash FROM starts)"""


def _le(x: str) -> str:
    h = f"printf('%016x', CAST({x} AS BIGINT))"
    return " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8))


def _order_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as terms of a record, with some made wrong."""
    from pyspark.sql import Window

    lines = _t(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    length = F.when(F.col("l_suppkey") % 53 == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("long")
    t = lines.withColumn("length", length).withColumn("pos", F.row_number().over(w).cast("long") - 1)
    t = t.withColumn("run", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    terms = t.select(
        F.col("l_orderkey").alias("file_id"),
        "pos",
        F.when(F.col("l_partkey") % 101 == 0, F.lit("zz")).otherwise(F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256)).alias("hash"),
        (F.col("run") + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)).alias("offset"),
        "length",
        F.lit(0).cast("long").alias("range_start"),
        F.when(F.col("l_partkey") % 89 == 0, 0).otherwise(1).cast("long").alias("range_end"),
        F.lit(0).cast("long").alias("packed_start"),
        F.when(F.col("l_partkey") % 83 == 0, F.lit(0).cast("long")).otherwise(F.col("length") + 1).alias("packed_end"),
    )
    files = _t(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), (F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("extra"))
    sums = terms.groupBy("file_id").agg(F.sum("length").alias("s"))
    files = files.join(sums, "file_id", "left").select("file_id", (F.coalesce("s", F.lit(0)) + F.col("extra")).alias("total_bytes"))
    return terms, files


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("length"))


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").filter("(l_returnflag = 'R' or l_linestatus = 'F') and l_quantity >= 45")
    return lines.select(F.col("l_partkey").cast("string").alias("key")).distinct()


REF = "refs AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS key FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus = 'F') AND l_quantity >= 45)"
INV = "inv AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS length FROM part)"
ORPHANS = "orphans AS (SELECT i.* FROM inv i WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.key = i.key) AND NOT EXISTS (SELECT 1 FROM holds h WHERE h.object_key = i.key AND (h.release_after IS NULL OR h.release_after > 1706745600)))"
HOLDS = "holds AS (SELECT CAST(s_suppkey AS VARCHAR) AS object_key, CAST(1706745600 - 100 * s_suppkey AS BIGINT) AS held_at, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN CAST(1706745600 + 50 * (s_suppkey % 7) - 100 AS BIGINT) ELSE CAST(1706745600 - 200 * s_suppkey AS BIGINT) END AS release_after FROM supplier)"
QUARANTINE = "q AS (SELECT CAST(p_partkey AS VARCHAR) AS object_key, CAST(p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS observed_length, CAST(1706745600 - 3600 * (p_partkey % 5) AS BIGINT) AS first_seen, CAST(1706745600 - 3600 * (p_partkey % 5) + 7200 AS BIGINT) AS delete_after FROM part WHERE p_partkey % 4 = 0)"


def _holds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    release = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, NOW + 50 * (k % 7) - 100).otherwise(NOW - 200 * k)
    return _t(spark, d, "supplier").select(k.cast("string").alias("object_key"), (NOW - 100 * k).alias("held_at"), release.cast("long").alias("release_after"))


def _quarantine(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    first = NOW - 3600 * (k % 5)
    length = F.col("p_size") + F.when(k % 11 == 0, 1).otherwise(0)
    return _t(spark, d, "part").filter("p_partkey % 4 = 0").select(k.cast("string").alias("object_key"), length.cast("long").alias("observed_length"), first.alias("first_seen"), (first + 7200).alias("delete_after"))


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(
        F.lit("p").alias("provider"),
        F.col("event_type").alias("owner"),
        F.col("user_id").cast("string").alias("repo"),
        F.date_format("ts", "yyyy-MM-dd").alias("delivery_id"),
        F.col("event_id").alias("arrival"),
        at.cast("long").alias("at"),
        F.when(F.col("event_id") % 2 == 0, F.lit("revision_pushed")).otherwise(F.lit("access_changed")).alias("kind"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("rev-"), F.col("event_id").cast("string"))).alias("revision"),
    )


EVENTS = """ev AS (SELECT 'p' AS provider, event_type AS owner, CAST(user_id AS VARCHAR) AS repo, strftime(ts, '%Y-%m-%d') AS delivery_id, event_id AS arrival, CAST(floor(epoch(ts)) AS BIGINT) AS secs,
CASE WHEN event_id % 2 = 0 THEN 'revision_pushed' ELSE 'access_changed' END AS kind, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'rev-' || event_id END AS revision FROM events)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- chunk ingest


@query(
    f"""WITH {CHUNKS}, own AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, idx) AS k FROM chunks)
SELECT source, count(*) AS chunks, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN k = 1 THEN 0 ELSE 1 END) AS BIGINT) AS reused,
CAST(sum(length) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN k = 1 THEN length ELSE 0 END) AS BIGINT) AS stored_bytes FROM own GROUP BY source"""
)
def chunk_dedupe_by_source(spark, d):
    return chunking.upload_accounting(_chunks(spark, d).select("source", "doc_id", "idx", "length", "hash"), "source", ("doc_id", "idx"))


@query(f"WITH {CHUNKS}, u AS (SELECT hash, min(length) AS length, count(*) AS refs FROM chunks GROUP BY hash) SELECT count(*) AS chunk_count, CAST(sum(length) AS BIGINT) AS chunk_bytes, CAST(sum(refs) AS BIGINT) AS \"references\" FROM u")
def chunk_inventory_stats(spark, d):
    return chunking.chunk_stats(_chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT hash, min(doc_id) AS doc_id, count(DISTINCT source) AS sources FROM chunks GROUP BY hash")
def dedupe_first_owner(spark, d):
    c = _chunks(spark, d)
    owner = chunking.first_owners(c.select("hash", "doc_id"), "doc_id")
    return owner.join(c.groupBy("hash").agg(F.countDistinct("source").alias("sources")), "hash")


@query(
    f"""WITH {CHUNKS}, digests AS (SELECT doc_id, max(n) AS n, string_agg(hex(encode(hash)) || {_le('"offset"')} || {_le('length')}, '' ORDER BY idx) AS body FROM chunks GROUP BY doc_id)
SELECT doc_id, sha256(unhex({_le('n')} || {_le('1024')} || body)) AS content_hash FROM digests"""
)
def content_digest_per_file(spark, d):
    return chunking.content_digest(_chunks(spark, d), "doc_id", F.sum("length"), CHUNK)


@query("SELECT sha256(encode(text)) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_files(spark, d):
    h = _files(spark, d).select("doc_id", F.sha2("content", 256).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


# -- plans


def _requests(spark, d):
    n = F.octet_length("content").cast("long")
    start = (F.col("doc_id") * 37) % F.greatest(n, F.lit(1))
    return _files(spark, d).select("doc_id", start.alias("start"), (start + F.col("doc_id") % 5000).alias("end"))


@query(
    f"""WITH {CHUNKS}, req AS (SELECT doc_id, n, (doc_id * 37) % greatest(n, 1) AS s, (doc_id * 37) % greatest(n, 1) + doc_id % 5000 AS e FROM files),
hit AS (SELECT r.doc_id, r.s, c.* EXCLUDE (doc_id) FROM req r JOIN chunks c ON c.doc_id = r.doc_id AND r.e < r.n AND c."offset" <= r.e AND c."offset" + c.length - 1 >= r.s),
agg AS (SELECT doc_id, count(*) AS terms, arg_min(greatest(s - "offset", 0), idx) AS o, min(idx) AS f, max(idx) AS l, CAST(sum(length) AS BIGINT) AS b FROM hit GROUP BY doc_id)
SELECT r.doc_id, r.s AS start, r.e AS "end", r.e >= r.n AS unsatisfiable, a.terms, CAST(a.o AS BIGINT) AS offset_into_first_range, a.f AS first_pos, a.l AS last_pos, a.b AS planned_bytes FROM req r LEFT JOIN agg a USING (doc_id)"""
)
def reconstruct_range_plan(spark, d):
    terms = _chunks(spark, d).select("doc_id", F.col("idx").alias("pos"), "offset", "length")
    return plan.ranged_plan(terms, _requests(spark, d), "doc_id")


@query(
    f"""WITH {CHUNKS}, first AS (SELECT source, hash, length, idx, min(doc_id * 1000000 + idx) AS p FROM chunks GROUP BY 1, 2, 3, 4)
SELECT source, hash, count(*) AS entries, CAST(max(length) AS BIGINT) - 1 AS last_byte, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY p) AS in_order FROM first GROUP BY 1, 2"""
)
def fetch_entries_by_source(spark, d):
    z = F.lit(0).cast("long")
    c = _chunks(spark, d).select("source", "hash", (F.col("doc_id") * 1_000_000 + F.col("idx")).alias("pos"), F.col("idx").alias("range_start"), (F.col("idx") + 1).alias("range_end"), z.alias("packed_start"), F.col("length").alias("packed_end"))
    out = plan.fetch_info(c, "source")
    in_order = F.array_join(F.transform("entries", lambda e: e["chunk_start"].cast("string")), ",")
    return out.select("source", "hash", F.size("entries").cast("long").alias("entries"), F.array_max(F.transform("entries", lambda e: e["byte_end"])).alias("last_byte"), in_order.alias("in_order"))


@query(f"WITH {CHUNKS} SELECT hash, count(*) AS entries, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY doc_id DESC, idx) AS in_order FROM chunks GROUP BY hash")
def batch_reconstruction(spark, d):
    """All documents in one request, the last id first."""
    z = F.lit(0).cast("long")
    c = _chunks(spark, d).select(F.col("doc_id").alias("file_id"), "hash", F.col("idx").alias("pos"), F.col("idx").alias("range_start"), (F.col("idx") + 1).alias("range_end"), z.alias("packed_start"), F.col("length").alias("packed_end"))
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (-F.col("doc_id")).alias("position"))
    in_order = F.array_join(F.transform("entries", lambda e: e["chunk_start"].cast("string")), ",")
    return plan.batch_fetch_info(c, ids, most=(1 << 31) - 2).select("hash", F.size("entries").cast("long").alias("entries"), in_order.alias("in_order"))


@query("SELECT doc_id, sha256(encode(text)) AS content_hash FROM documents WHERE octet_length(encode(text)) > 0")
def reassembled_files(spark, d):
    """Cut into chunks, stored once by hash, and put together again."""
    c = _chunks(spark, d).select("doc_id", F.col("idx").alias("pos"), "hash", "length")
    files = _files(spark, d)
    n, at = F.octet_length("content").cast("long"), F.sequence(F.lit(0).cast("long"), F.octet_length("content").cast("long") - 1, F.lit(CHUNK).cast("long"))
    pieces = files.filter(n > 0).select(F.explode(F.transform(at, lambda a: F.substring(F.col("content"), (a + 1).cast("int"), F.lit(CHUNK)))).alias("content"))
    objects = pieces.withColumn("hash", F.sha2("content", 256)).dropDuplicates(["hash"])
    return plan.assemble(c, objects, "doc_id").select("doc_id", F.sha2("content", 256).alias("content_hash"))


@query(
    """WITH l AS (SELECT l_orderkey AS f, l_partkey AS p, CAST(CASE WHEN l_suppkey % 53 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS len, row_number() OVER w - 1 AS pos,
coalesce(sum(CASE WHEN l_suppkey % 53 = 0 THEN 0 ELSE l_quantity END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)),
i AS (SELECT f, pos, len, CASE WHEN p % 101 = 0 THEN 'invalid_content_hash' WHEN len = 0 THEN 'empty_chunk' WHEN p % 97 = 0 THEN 'non_contiguous_chunks' WHEN p % 89 = 0 THEN 'invalid_chunk_range' WHEN p % 83 = 0 THEN 'invalid_packed_range' END AS issue FROM l),
a AS (SELECT f, min(CASE WHEN issue IS NOT NULL THEN pos END) AS pos, arg_min(issue, CASE WHEN issue IS NOT NULL THEN pos END) AS issue FROM i GROUP BY f)
SELECT o_orderkey AS file_id, a.pos, coalesce(a.issue, CASE WHEN o_orderkey % 50 = 0 THEN 'total_bytes_mismatch' END) AS issue FROM orders LEFT JOIN a ON a.f = o_orderkey WHERE coalesce(a.issue, CASE WHEN o_orderkey % 50 = 0 THEN 'total_bytes_mismatch' END) IS NOT NULL"""
)
def plan_validation_issues(spark, d):
    terms, files = _order_terms(spark, d)
    return plan.validate(terms, files)


# -- versions


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def head_version(spark, d):
    return rebuild.heads(_t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    """WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'missing_version_record' ELSE 'mismatched_version_record' END AS kind, CAST(o_custkey AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS detail FROM h WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0"""
)
def latest_vs_version_drift(spark, d):
    latest = head_version(spark, d).withColumn("total", F.lit(1))
    versions = _t(spark, d, "orders").filter("o_orderkey % 10 <> 0").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1).alias("total"))
    return fsck.version_issues(latest, versions, ["o_custkey", "o_orderkey"], ["total"], "o_custkey")


@query(
    """WITH d AS (SELECT o_custkey AS k, arg_max(o_orderkey, o_orderdate * 1) AS x FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate) * 10000000 + o_orderkey AS o_orderdate FROM orders) GROUP BY 1),
e AS (SELECT o_custkey AS k, max(o_orderkey) AS x FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT -1, 1)
SELECT CASE WHEN d.x IS NULL THEN 'removed' WHEN d.x = e.x THEN 'unchanged' ELSE 'rebuilt' END AS action, count(*) AS rows FROM d FULL JOIN e ON d.k = e.k GROUP BY 1"""
)
def rebuild_actions(spark, d):
    orders = _t(spark, d, "orders")
    desired = head_version(spark, d).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"))
    have = orders.filter("o_custkey % 5 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("x"))
    have = have.union(spark.createDataFrame([(-1, 1)], "k long, x long"))
    return rebuild.reconcile(desired, have, ["k"], ["x"]).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {CHUNKS} SELECT hash AS chunk_hash, min(source) AS shard_object_key FROM chunks GROUP BY hash")
def dedupe_mapping_choice(spark, d):
    return rebuild.choose_mappings(_chunks(spark, d).select(F.col("hash").alias("chunk_hash"), F.col("source").alias("shard_key")))


# -- garbage collection


@query(f"WITH {REF}, {INV}, {HOLDS}, {ORPHANS} SELECT key, length FROM orphans")
def orphan_objects(spark, d):
    return gc.orphans(_inventory(spark, d), _referenced(spark, d), _holds(spark, d), NOW)


@query(
    f"""WITH {REF}, {INV}, {HOLDS}, {ORPHANS}, {QUARANTINE}
SELECT coalesce(q.object_key, o.key) AS object_key, CASE WHEN o.key IS NOT NULL AND (q.object_key IS NULL OR q.observed_length <> o.length) THEN o.length ELSE q.observed_length END AS observed_length,
CASE WHEN o.key IS NOT NULL AND (q.object_key IS NULL OR q.observed_length <> o.length) THEN 1706745600 ELSE q.first_seen END AS first_seen,
CASE WHEN o.key IS NOT NULL AND (q.object_key IS NULL OR q.observed_length <> o.length) THEN 1706749200 ELSE q.delete_after END AS delete_after,
CASE WHEN o.key IS NULL THEN 'released' WHEN q.observed_length = o.length THEN 'retained' ELSE 'new' END AS action FROM q FULL JOIN orphans o ON o.key = q.object_key"""
)
def quarantine_reconcile(spark, d):
    return gc.mark(_quarantine(spark, d), orphan_objects(spark, d), NOW, 3600)


@query(
    f"""WITH {REF}, {INV}, {HOLDS}, {ORPHANS}, {QUARANTINE} SELECT q.*, CASE WHEN o.key IS NULL THEN 'released' WHEN q.delete_after <= 1706745600 THEN 'deleted' ELSE 'kept' END AS action,
CASE WHEN o.key IS NOT NULL AND q.delete_after <= 1706745600 THEN o.length ELSE 0 END AS deleted_bytes FROM q LEFT JOIN orphans o ON o.key = q.object_key"""
)
def quarantine_sweep(spark, d):
    return gc.sweep(_quarantine(spark, d), orphan_objects(spark, d), NOW)


@query(
    f"""WITH {REF}, {INV}, {HOLDS}, held AS (SELECT object_key FROM holds WHERE release_after IS NULL OR release_after > 1706745600), {ORPHANS},
q AS (SELECT CAST(p_partkey AS VARCHAR) AS object_key, CAST(p_size AS BIGINT) AS observed_length, 1706745600 - 3600 * (p_partkey % 5) + 7200 AS delete_after FROM part WHERE p_partkey % 4 = 0 AND CAST(p_partkey AS VARCHAR) NOT IN (SELECT object_key FROM held)),
m AS (SELECT coalesce(q.object_key, o.key) AS object_key, coalesce(q.delete_after, 1706749200) AS delete_after, o.length, CASE WHEN o.key IS NULL THEN 'released' WHEN q.object_key IS NOT NULL THEN 'retained' ELSE 'new' END AS action FROM q FULL JOIN orphans o ON o.key = q.object_key),
s AS (SELECT *, action <> 'released' AND delete_after <= 1706745600 AS del FROM m)
SELECT (SELECT count(*) FROM orders) AS scanned_records, (SELECT count(*) FROM refs) AS referenced_chunks, (SELECT count(*) FROM orphans) AS orphan_chunks, (SELECT CAST(sum(length) AS BIGINT) FROM orphans) AS orphan_bytes, (SELECT count(*) FROM held) AS holds_left,
count(*) FILTER (WHERE action = 'new') AS new_candidates, count(*) FILTER (WHERE action = 'retained') AS retained_candidates, count(*) FILTER (WHERE del) AS deleted_chunks, CAST(coalesce(sum(length) FILTER (WHERE del), 0) AS BIGINT) AS deleted_bytes,
count(*) FILTER (WHERE action <> 'released' AND NOT del) AS active_candidates, count(*) FILTER (WHERE action = 'released' OR del) AS released_candidates FROM s"""
)
def gc_report(spark, d):
    """Mark and sweep in one run with all holds; part keys stand for chunk keys, so every object is managed."""
    inv = _inventory(spark, d)
    key = lambda c: X.chunk_key(F.sha2(F.col(c).cast("binary"), 256))
    objects = inv.withColumn("key", key("key"))
    held = _holds(spark, d).filter(X.hold_active(F.col("release_after"), NOW))
    q = _quarantine(spark, d).join(inv.select(F.col("key").alias("object_key"), F.col("length").alias("observed_length_")), "object_key").withColumn("observed_length", F.col("observed_length_")).drop("observed_length_")
    q = q.join(held, "object_key", "left_anti").withColumn("object_key", key("object_key"))
    holds = _holds(spark, d).withColumn("object_key", key("object_key"))
    records = _t(spark, d, "orders").select("o_orderkey")
    out = gc.collect(objects, records, _referenced(spark, d).withColumn("key", key("key")), q, holds, NOW, 3600, do_mark=True, do_sweep=True)
    return state.one_row([out.report, out.holds.agg(F.count(F.lit(1)).alias("holds_left"))])


@query(f"WITH {QUARANTINE} SELECT *, greatest(delete_after - 1706745600, 0) AS seconds_until_delete FROM q")
def retention_report(spark, d):
    return gc.retention_report(_quarantine(spark, d), NOW)


@query(f"WITH {HOLDS} SELECT object_key, release_after IS NULL OR release_after > 1706745600 AS active, coalesce(release_after < held_at OR release_after <= 1706745600, false) AS expired FROM holds")
def hold_activity(spark, d):
    return _holds(spark, d).select("object_key", X.hold_active(F.col("release_after"), NOW).alias("active"), X.hold_expired(F.col("held_at"), F.col("release_after"), NOW).alias("expired"))


@query(
    f"""WITH {CHUNKS}, mem AS (SELECT source AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id, idx) - 1 AS i, sha256(encode(hash || source)) AS h FROM chunks),
st AS (SELECT DISTINCT hash AS h FROM chunks), inr AS (SELECT DISTINCT h FROM mem WHERE i >= 1 AND i < 4), allm AS (SELECT DISTINCT h FROM mem),
base AS (SELECT substr(h, 1, 2) || '/' || h AS key FROM st UNION SELECT 'xorbs/default/' || substr(x, 1, 2) || '/' || x || '.xorb' FROM mem UNION SELECT 'xorbs/default/' || substr(h, 1, 2) || '/' || h || '.xorb' FROM st WHERE substr(h, 1, 1) IN ('0', '1')),
ss AS (SELECT DISTINCT 'shards/' || lang AS key FROM chunks), sm AS (SELECT DISTINCT 'shards/m-' || x AS key FROM mem),
k AS (SELECT unnest(['gc', 'repair', 'fsck']) AS variant, key FROM (SELECT key FROM base UNION SELECT key FROM ss) UNION SELECT unnest(['gc', 'repair']), substr(h, 1, 2) || '/' || h FROM allm UNION SELECT 'fsck', substr(h, 1, 2) || '/' || h FROM inr UNION SELECT 'gc', key FROM sm)
SELECT variant, key FROM k"""
)
def reachable_keys(spark, d):
    """All three definitions over the chunks of all documents and one container a source, of which chunks 1 to 3 are referenced."""
    from pyspark.sql import Window

    c = _chunks(spark, d)
    own = F.sha2(F.concat("hash", "source").cast("binary"), 256)
    members = c.select(F.col("source").alias("xorb_hash"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "idx")) - 1).cast("long").alias("idx"), own.alias("chunk_hash"))
    n = lambda x: F.lit(x).cast("long")
    stored = c.select("hash", F.lit(True).alias("chunked"), n(0).alias("range_start"), n(1).alias("range_end"))
    packed = c.select(F.col("source").alias("hash"), F.lit(False).alias("chunked"), n(1).alias("range_start"), n(4).alias("range_end")).distinct()
    mappings = c.select(F.col("hash").alias("chunk_hash"), F.concat(F.lit("shards/"), F.col("lang")).alias("shard_object_key"))
    mappings = mappings.union(members.select("chunk_hash", F.concat(F.lit("shards/m-"), F.col("xorb_hash"))))
    objects = c.filter("substr(hash, 1, 1) in ('0', '1')").select(X.xorb_key(F.col("hash")).alias("key")).distinct()
    out = [reach.reachable_keys(stored.union(packed), members, mappings, objects, v).select(F.lit(v).alias("variant"), "key") for v in ("gc", "repair", "fsck")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT 'missing_lines' AS kind, CAST(o_orderkey AS VARCHAR) AS location FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_references(spark, d):
    keys = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    found = inventory.with_metadata(keys, _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("length")))
    return found.filter("not found").select(F.lit("missing_lines").alias("kind"), F.col("key").cast("string").alias("location"))


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT kind, count(*) AS issues FROM (
SELECT 'empty_reconstruction' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT o FROM t) UNION ALL SELECT 'missing_reconstruction_xorb' FROM lineitem WHERE l_partkey % 10 = 0) GROUP BY kind"""
)
def reconstruction_check(spark, d):
    terms = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("object_hash"))).alias("terms"))
    files = _t(spark, d, "orders").select(F.col("o_orderkey").alias("file_id")).join(terms, "file_id", "left")
    stored = _t(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").cast("string").alias("object_hash"))
    return fsck.report(fsck.reconstruction_issues(files, stored))


# -- repair


@query(
    f"""WITH {REF}, {HOLDS}, {QUARANTINE}, {EVENTS}, obj AS (SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 6 <> 0),
h AS (SELECT object_key, CASE WHEN release_after < held_at OR release_after <= 1706745600 THEN 'delete_expired' WHEN object_key NOT IN (SELECT key FROM obj) THEN 'delete_missing' ELSE 'keep' END AS class FROM holds),
k AS (SELECT CASE WHEN object_key NOT IN (SELECT key FROM obj) THEN 'delete_missing' WHEN object_key IN (SELECT key FROM refs) THEN 'delete_reachable' WHEN object_key IN (SELECT object_key FROM h WHERE class = 'keep') THEN 'delete_held' ELSE 'keep' END AS class FROM q),
c AS (SELECT CASE WHEN secs > 1705968000 + 300 THEN 'delete_future' WHEN secs <= 1705968000 - 864000 THEN 'delete_stale' ELSE 'keep' END AS class FROM ev)
SELECT 'holds' AS "table", class, count(*) AS rows FROM h GROUP BY 2 UNION ALL SELECT 'quarantine', class, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'deliveries', class, count(*) FROM c GROUP BY 2"""
)
def lifecycle_repair_classes(spark, d):
    objects = _t(spark, d, "part").filter("p_partkey % 6 <> 0").select(F.col("p_partkey").cast("string").alias("key"))
    deliveries = _deliveries(spark, d).select(*ev.CLAIM, F.col("at").alias("processed_at"))
    now = repair.repair(_holds(spark, d), _quarantine(spark, d), deliveries, objects, _referenced(spark, d), NOW)
    late = repair.repair(_holds(spark, d), _quarantine(spark, d), deliveries, objects, _referenced(spark, d), 1_705_968_000, 864_000)
    return now.classes.filter("table <> 'deliveries'").unionByName(late.classes.filter("table = 'deliveries'"))


# -- events


@query(f"WITH {EVENTS} SELECT provider, owner, repo, delivery_id, min(arrival) AS arrival FROM ev GROUP BY 1, 2, 3, 4")
def webhook_dedupe(spark, d):
    return ev.claim(_deliveries(spark, d)).select(*ev.CLAIM, "arrival")


@query(
    f"""WITH {EVENTS} SELECT provider, owner, repo, arg_max(secs, arrival) FILTER (WHERE kind = 'access_changed') AS last_access_changed_at, arg_max(secs, arrival) FILTER (WHERE kind = 'revision_pushed') AS last_revision_pushed_at,
arg_max(revision, arrival) FILTER (WHERE kind = 'revision_pushed' AND revision IS NOT NULL) AS last_pushed_revision FROM ev GROUP BY 1, 2, 3"""
)
def repo_state_fold(spark, d):
    return ev.fold(_deliveries(spark, d))


@query(
    f"""WITH {EVENTS}, s AS (SELECT provider, owner, repo, max(secs) FILTER (WHERE kind = 'access_changed') AS a, max(secs) FILTER (WHERE kind = 'revision_pushed') AS r FROM ev GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN CAST(repo AS BIGINT) % 3 = 0 THEN 1705968000 END AS c, CASE WHEN CAST(repo AS BIGINT) % 4 = 0 THEN 1706400000 END AS z FROM s)
SELECT provider, owner, repo, CAST(CASE WHEN greatest(coalesce(a, r), coalesce(r, a)) IS NULL OR c >= greatest(coalesce(a, r), coalesce(r, a)) THEN c ELSE 1706745600 END AS BIGINT) AS last_cache_invalidated_at,
CAST(CASE WHEN a IS NULL OR z >= a THEN z ELSE 1706745600 END AS BIGINT) AS last_authorization_rechecked_at, CAST(CASE WHEN r IS NULL THEN NULL ELSE 1706745600 END AS BIGINT) AS last_drift_checked_at FROM t"""
)
def reconciled_states(spark, d):
    e = _deliveries(spark, d)
    own = lambda k: F.max(F.when(F.col("kind") == k, F.col("at")))
    s = e.groupBy(*ev.REPOSITORY).agg(own("access_changed").alias("last_access_changed_at"), own("revision_pushed").alias("last_revision_pushed_at"))
    at = lambda n, t: F.when(F.col("repo").cast("long") % n == 0, F.lit(t)).cast("long")
    s = s.withColumns({"last_cache_invalidated_at": at(3, 1_705_968_000), "last_authorization_rechecked_at": at(4, 1_706_400_000), "last_drift_checked_at": F.lit(None).cast("long")})
    return ev.reconcile(s, NOW).select(*ev.REPOSITORY, *ev.RECONCILED)


@query(
    f"""WITH {CHUNKS}, gone AS (SELECT * FROM chunks WHERE source IN ('src1', 'src3')), f AS (SELECT lang, source, count(*) AS versions FROM documents WHERE source IN ('src1', 'src3') GROUP BY 1, 2)
SELECT f.lang AS provider, f.source AS owner, 'r' AS repo, f.versions, count(DISTINCT g.hash) AS chunks, 2 * count(DISTINCT g.hash) AS holds FROM f LEFT JOIN gone g ON g.lang = f.lang AND g.source = f.source GROUP BY 1, 2, 4"""
)
def repo_delete_impact(spark, d):
    docs = _t(spark, d, "documents")
    scope = [F.col("lang").alias("provider"), F.col("source").alias("owner"), F.lit("r").alias("repo")]
    records = docs.select(F.col("doc_id").alias("record_key"), *scope, F.lit("version").alias("record_kind"))
    terms = _chunks(spark, d).select(F.col("doc_id").alias("record_key"), "hash")
    gone = records.filter("owner in ('src1', 'src3')").select("provider", "owner", "repo").distinct()
    return ev.deleted_repository(records, terms, gone, NOW, lambda h: [X.chunk_key(h), X.xorb_key(h)])["impact"].select("provider", "owner", "repo", "versions", "chunks", "holds")


@query(
    "SELECT event_id, 'owner-' || user_id AS owner, 'main' AS revision FROM events WHERE event_id % 4 = 0 AND user_id IS NOT NULL"
)
def provider_payloads(spark, d):
    e = _t(spark, d, "events").filter("user_id is not null")
    payload = F.concat(F.lit('{"ref":"refs/heads/main","repository":{"full_name":"owner-'), F.col("user_id").cast("string"), F.lit('/repo"}}'))
    raw = e.select(F.lit("github").alias("provider"), F.when(F.col("event_id") % 4 == 0, F.lit("push")).otherwise(F.lit("ping")).alias("event"), F.col("event_id").cast("string").alias("delivery_id"), "event_id", payload.alias("payload"))
    return ev.normalise(raw).select("event_id", "owner", "revision")


# -- inventories and protocols


@query("SELECT key FROM (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS key FROM pages) WHERE key > 'm.' ORDER BY key LIMIT 26")
def inventory_page(spark, d):
    objects = _t(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("key")).distinct()
    return inventory.page(objects.select(F.translate("key", "/", "\\").alias("key")), "", "m.", 25).select(F.translate("key", "\\", "/").alias("key"))


@query(
    f"""WITH {CHUNKS}, k AS (SELECT hash, CASE doc_id % 5 WHEN 0 THEN substr(hash, 1, 2) || '/' || hash WHEN 1 THEN 'xorbs/default/' || substr(hash, 1, 2) || '/' || hash || '.xorb' WHEN 2 THEN 'shards/' || substr(hash, 1, 2) || '/' || hash || '.shard'
WHEN 3 THEN substr(hash, 1, 2) || '/' || substr(hash, 1, 40) ELSE 'protocols/lfs/global/objects/' || hash END AS key, doc_id % 5 AS c FROM chunks)
SELECT CASE c WHEN 0 THEN 'chunk' WHEN 1 THEN 'xorb' WHEN 2 THEN 'shard' ELSE 'unmanaged' END AS class, c = 3 AS error, count(DISTINCT key) AS keys, count(DISTINCT CASE WHEN c < 3 THEN hash END) AS hashes FROM k GROUP BY 1, 2"""
)
def key_classification(spark, d):
    h = F.col("hash")
    c = F.col("doc_id") % 5
    key = F.when(c == 0, X.chunk_key(h)).when(c == 1, X.xorb_key(h)).when(c == 2, X.shard_key(h)).when(c == 3, F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 1, 40))).otherwise(X.lfs_key(F.lit("global"), h))
    keys = _chunks(spark, d).select(key.alias("key")).withColumn("k", X.classify_key(F.col("key")))
    return keys.groupBy(F.col("k.class").alias("class"), F.col("k.error").alias("error")).agg(F.countDistinct("key").alias("keys"), F.countDistinct("k.hash").alias("hashes"))


@query(
    """SELECT DISTINCT lang, source, sha256(encode(lang || chr(0) || source || chr(0) || 'r' || chr(0))) AS namespace, octet_length(encode(lang)) || ':' || lang || octet_length(encode(source)) || ':' || source || '1:r' AS scope_key FROM documents"""
)
def scope_namespace(spark, d):
    s = _t(spark, d, "documents").select("lang", "source").distinct()
    r, none = F.lit("r"), F.lit(None).cast("string")
    return s.select("lang", "source", X.scope_namespace(F.col("lang"), F.col("source"), r, none).alias("namespace"), X.scope_key(F.col("lang"), F.col("source"), r, none).alias("scope_key"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")))
def backup_counts(spark, d):
    return inventory.counts({t: _t(spark, d, t) for t in ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")})


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 13 AS a, o_orderkey % 17 AS b, 12 AS len FROM orders)
SELECT id, CASE WHEN a >= len OR b < a THEN NULL ELSE a END AS start, CASE WHEN a >= len OR b < a THEN NULL ELSE least(b, len - 1) END AS "end", CASE WHEN a >= len THEN 'unsatisfiable' WHEN b < a THEN 'syntax' END AS error FROM r"""
)
def http_ranges(spark, d):
    k = F.col("o_orderkey")
    header = F.concat(F.lit("bytes="), (k % 13).cast("string"), F.lit("-"), (k % 17).cast("string"))
    return _t(spark, d, "orders").select(k.alias("id"), X.http_range(header, F.lit(12).cast("long")).alias("r")).select("id", "r.start", "r.end", "r.error")


@query(f"WITH h AS (SELECT doc_id, sha256(encode(text)) AS x FROM documents) SELECT doc_id, {' || '.join(f'substr(x, {(g * 8 + 7 - i) * 2 + 1}, 2)' for g in range(4) for i in range(8))} AS reversed FROM h")
def group_reversed_hashes(spark, d):
    return _files(spark, d).select("doc_id", X.group_reversed_hex(F.sha2("content", 256)).alias("reversed"))


@query(
    """SELECT o_orderkey AS oid, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'download' ELSE 'missing' END AS action FROM orders"""
)
def lfs_batch(spark, d):
    return protocols.lfs_batch(_t(spark, d, "orders").select(F.col("o_orderkey").alias("oid")), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("oid")), "download").select("oid", "action")


@query(
    """WITH t AS (SELECT 'r' || p_brand AS repository, p_name || '-' || p_partkey AS tag, 'd' || (p_partkey % 10) AS digest FROM part), x AS (SELECT * FROM t WHERE digest IN ('d3', 'd4'))
SELECT repository, count(*) AS tags FROM t WHERE (repository, tag) NOT IN (SELECT repository, tag FROM x) GROUP BY 1"""
)
def oci_tags_after_delete(spark, d):
    tags = _t(spark, d, "part").select(F.concat(F.lit("r"), "p_brand").alias("repository"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("tag"), F.concat(F.lit("d"), (F.col("p_partkey") % 10).cast("string")).alias("digest"))
    gone = tags.filter("digest in ('d3', 'd4')").select("repository", "digest").distinct()
    return protocols.delete_manifests(tags, tags, gone).groupBy("repository").agg(F.count(F.lit(1)).alias("tags"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0"""
)
def snapshot_upsert(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return state.upsert(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 3 <> 0 THEN 'inserted' WHEN p_partkey % 5 = 0 THEN 'conflict' ELSE 'already_exists' END AS outcome FROM part"""
)
def object_put_if_absent(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("length"), F.lit(None).cast("string").alias("checksum"), F.col("p_partkey").alias("k"))
    have = p.filter("k % 3 = 0").withColumn("length", F.col("length") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).drop("k")
    return state.put_if_absent(have, p.drop("k")).select("key", "outcome")


@query(
    """SELECT count(*) AS scanned, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS inserted, count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0) AS already_present, count(*) FILTER (WHERE p_partkey % 15 = 0) AS conflicts, CAST(sum(p_size) FILTER (WHERE p_partkey % 3 <> 0) AS BIGINT) AS bytes FROM part"""
)
def migration_totals(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("length"), F.lit(None).cast("string").alias("checksum"), F.col("p_partkey").alias("k"))
    have = p.filter("k % 3 = 0").withColumn("length", F.col("length") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).drop("k")
    return inventory.migrate(p.drop("k"), have, dry_run=True)[1]


@query(
    """WITH b AS (SELECT l_shipmode_key, sum(l_quantity) AS q, sum(l_linenumber) AS t FROM (SELECT l_suppkey AS l_shipmode_key, l_quantity, l_linenumber FROM lineitem) GROUP BY 1)
SELECT l_shipmode_key AS suppkey, CAST(CAST(q AS BIGINT) * 1000000 // t AS BIGINT) AS bytes_per_second, CAST(t * 1000 // CAST(q AS BIGINT) AS BIGINT) AS per_mille FROM b"""
)
def bench_rates(spark, d):
    g = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").alias("t"))
    return g.select("suppkey", X.throughput(F.col("q"), F.col("t")).alias("bytes_per_second"), X.per_mille(F.col("t"), F.col("q")).alias("per_mille"))


@query(
    """SELECT o_orderpriority AS priority, count(*) AS keys, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS bad FROM orders GROUP BY 1"""
)
def identifier_checks(spark, d):
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a/"), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("f-"), F.col("o_orderkey").cast("string")))
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when(X.valid_file_id(name), 0).otherwise(1)).alias("bad"))


@query(f"WITH {CHUNKS} SELECT DISTINCT source AS scope_key, hash FROM chunks")
def scope_references(spark, d):
    c = _chunks(spark, d)
    records = _t(spark, d, "documents").select(F.col("doc_id").alias("record_key"), F.col("source").alias("scope_key"))
    return protocols.references(records, c.select(F.col("doc_id").alias("record_key"), "hash"), c.select("hash").distinct())


# -- composite jobs


@query(
    f"""WITH {CHUNKS}, own AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, idx) AS k, min(doc_id) OVER (PARTITION BY hash) AS first FROM chunks),
seen AS (SELECT DISTINCT hash FROM chunks WHERE doc_id % 4 = 0)
SELECT count(*) AS inserted_objects, CAST(sum(length) AS BIGINT) AS inserted_bytes FROM own WHERE k = 1 AND hash NOT IN (SELECT hash FROM seen)"""
)
def ingest_objects(spark, d):
    """Ingest of all files into a store that holds the chunks of every fourth."""
    have = chunking.chunk_content_with(_files(spark, d).filter("doc_id % 4 = 0"), "blake3", CHUNK).groupBy("hash").agg(F.min("length").alias("length"))
    objects = have.select(X.chunk_key(F.col("hash")).alias("key"), "length", F.col("hash").alias("checksum"))
    out = jobs.ingest(_files(spark, d).select("doc_id", "content"), objects, CHUNK, "doc_id")
    return out.objects.agg(F.count(F.lit(1)).alias("inserted_objects"), F.sum("length").alias("inserted_bytes"))


@query(
    """WITH s AS (SELECT l_orderkey AS f, l_linenumber AS pos, l_partkey AS x, l_suppkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT DISTINCT CAST(x AS VARCHAR) AS xorb_hash, r AS idx FROM s WHERE k = 1"""
)
def file_start_chunks(spark, d):
    s = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").cast("string").alias("xorb_hash"), F.col("l_suppkey").alias("range_start"))
    return jobs.first_chunks(s)


@query(
    """WITH e AS (SELECT c_custkey AS key, c_custkey % 100 AS expires_at FROM customer WHERE c_custkey % 100 > 50) SELECT count(*) AS entries, min(key) AS first FROM e WHERE key <> (SELECT min(key) FROM e WHERE expires_at = 51)"""
)
def cache_after_eviction(spark, d):
    e = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 100).alias("expires_at"))
    return jobs.evict(e, 50, 10).agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("first"))


@query(f"WITH {HOLDS} SELECT object_key, held_at, release_after FROM holds WHERE release_after IS NULL OR release_after > 1706745600")
def active_holds(spark, d):
    return jobs.list_holds(_holds(spark, d), NOW, active_only=True)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'descriptor' WHEN 3 THEN 'media_type' END AS issue FROM orders")
def manifest_checks(spark, d):
    k = F.col("o_orderkey")
    digest = F.when(k % 4 == 2, F.lit("sha256:no")).otherwise(F.concat(F.lit("sha256:"), F.sha2(k.cast("string").cast("binary"), 256)))
    doc = F.to_json(F.struct(F.when(k % 4 == 1, 1).otherwise(2).alias("schemaVersion"), F.when(k % 4 == 3, F.lit("other")).otherwise(F.lit("m")).alias("mediaType"), F.array(F.struct(digest.alias("digest"), k.alias("size"))).alias("layers")))
    return _t(spark, d, "orders").select(k.alias("id"), jobs.manifest_issue(doc, F.lit("m")).alias("issue"))


@query("SELECT l_suppkey AS suppkey, count(*) AS runs, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS mean_l_linenumber FROM lineitem GROUP BY 1")
def bench_averages(spark, d):
    return jobs.averages(_t(spark, d, "lineitem").withColumn("suppkey", F.col("l_suppkey")), "suppkey", "l_linenumber")


@query("SELECT conv_id, sha256(encode(string_agg(text, '' ORDER BY turn))) AS sha256 FROM conversations GROUP BY 1")
def resumed_digests(spark, d):
    parts = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.encode("text", "UTF-8").alias("content"))
    return jobs.running_state(parts, "conv_id")


@query(
    """SELECT n_nationkey AS subject, r_name AS repo, n_regionkey = r_regionkey OR n_nationkey % 7 = 0 AND r_regionkey = 0 AS allowed FROM nation JOIN region ON r_regionkey = n_regionkey OR r_regionkey = 0"""
)
def policy_access(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    own = n.select(F.col("n_nationkey").alias("subject"), F.col("n_regionkey").alias("key"))
    asked = own.unionByName(own.withColumn("key", F.lit(0))).distinct()
    repo = [F.lit("p").alias("provider"), F.lit("o").alias("owner")]
    requests = asked.join(r, F.col("key") == F.col("r_regionkey")).select("subject", *repo, F.col("r_name").alias("repo"))
    readers = n.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("readers"))
    writers = n.filter("n_nationkey % 7 = 0").agg(F.collect_list("n_nationkey").alias("w"))
    policies = r.join(readers, F.col("r_regionkey") == F.col("n_regionkey")).join(writers.withColumn("zero", F.lit(0)), F.col("r_regionkey") == F.col("zero"), "left")
    policies = policies.select(*repo, F.col("r_name").alias("repo"), "readers", F.coalesce("w", F.array().cast("array<int>")).alias("writers"))
    return jobs.allowed_subjects(requests, policies, "read").select("subject", "repo", "allowed")
