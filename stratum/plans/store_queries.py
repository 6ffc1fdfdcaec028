"""Sources, sinks, state commits and expressions over inputs derived from the driver tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import hashing
from ..operators import chunking, inventory, jobs, protocols, state
from ..sources import tables
from ..streaming import events as ev
from .queries import CHUNK, CHUNKS, EVENTS, HOLDS, NOW, QUARANTINE, QUERIES, _chunks, _deliveries, _files, _holds, _quarantine, _t, query


def _lp(x: str) -> str:
    return f"octet_length(encode({x})) || ':' || {x}"


def _object(k: str = "p_partkey") -> list:
    return [F.col(k).cast("string").alias("key"), F.col("p_size").cast("long").alias("length"), F.lit(None).cast("string").alias("checksum")]


# -- file inventories and documents


def _nation_files(spark, d) -> str:
    """One file a nation, below a folder named by its key."""
    root = tables.scratch(spark, "files")
    _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition("k").write.partitionBy("k").text(root)
    return root


@query("SELECT n_nationkey AS nationkey, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS length FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%'")
def file_inventory_scan(spark, d):
    """Files below a string prefix, by key."""
    files = tables.sorted_inventory(inventory.prefix_scan(tables.file_inventory(spark, _nation_files(spark, d)), "k=1"))
    return files.select(F.regexp_extract("key", "^k=([0-9]+)/", 1).cast("int").alias("nationkey"), "length")


@query("SELECT n_nationkey AS nationkey, substr(n_name, 2, 3) AS part FROM nation")
def object_ranges(spark, d):
    """Bytes 1 to 3 of every file."""
    out = inventory.read_range(tables.file_contents(spark, _nation_files(spark, d)), 1, 3)
    return out.select(F.regexp_extract("key", "^k=([0-9]+)/", 1).cast("int").alias("nationkey"), F.decode("content", "UTF-8").alias("part"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file_id, n_regionkey AS total_bytes, CAST(1 AS BIGINT) AS range_end FROM nation")
def legacy_record_import(spark, d):
    """One JSON document a file, over several lines, read whole and parsed."""
    root = tables.scratch(spark, "legacy")
    n = F.col("n_nationkey").cast("string")
    doc = F.concat(F.lit('{\n"file_id": "'), n, F.lit('", "content_hash": "h", "chunk_size": 4,\n"total_bytes": '), F.col("n_regionkey").cast("string"), F.lit(', "chunks": [{"hash": "c", "offset": 0, "length": 1}]}'))
    _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), doc.alias("value")).repartition("k").write.partitionBy("k").text(root)
    parsed = tables.parse_records(tables.legacy_records(spark, root))
    return parsed.filter("parsed").select("r.file_id", F.col("r.total_bytes").cast("int").alias("total_bytes"), F.get("chunks", F.lit(0))["range_end"].alias("range_end"))


@query("SELECT r_name AS name, CAST(r_regionkey * 10 AS INTEGER) AS port FROM region")
def provider_configs(spark, d):
    root = tables.scratch(spark, "config")
    one = _t(spark, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("name"), (F.col("r_regionkey") * 10).alias("port"))).alias("providers"))).alias("value"))
    one.coalesce(1).write.text(root)
    return tables.provider_config(spark, root, "providers ARRAY<STRUCT<name: STRING, port: INT>>").select(F.inline("providers"))


# -- record tables

_SCOPE = f"{_lp('lang')} || {_lp('source')} || '1:r'"
RECS = f"""recs AS (SELECT doc_id, lang, source, 'f-' || doc_id AS file_id, sha256(encode(text)) AS h, octet_length(encode(text)) AS n, {_SCOPE} AS scope FROM documents),
records AS (SELECT *, 'latest' AS kind FROM recs UNION ALL SELECT *, 'version' FROM recs WHERE doc_id % 3 <> 0)"""


def _records(spark, d) -> DataFrame:
    """Latest records of all documents and versions of most, as JSON; some do not parse, one field of the chunks is missing."""
    docs = _files(spark, d).select("doc_id", "lang", "source", F.concat(F.lit("f-"), "doc_id").alias("file_id"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").alias("n"))
    scope = X.scope_key(F.col("lang"), F.col("source"), F.lit("r"), F.lit(None).cast("string"))
    text = F.concat(
        F.lit('{"file_id":"'), "file_id", F.lit('","content_hash":"'), "content_hash", F.lit('","total_bytes":'), F.col("n").cast("string"), F.lit(',"chunk_size":'), F.when(F.col("doc_id") % 7 == 0, "0").otherwise("1024"),
        F.lit(',"repository_scope":{"provider":"'), "lang", F.lit('","owner":"'), "source", F.lit('","name":"r"},"chunks":[{"hash":"'), "content_hash", F.lit('","offset":0,"length":'), F.col("n").cast("string"), F.lit("}]}"),
    )
    base = docs.select(
        "doc_id", "file_id", "content_hash", scope.alias("scope_key"), F.when(F.col("doc_id") % 50 == 0, F.lit('{"file_id":')).otherwise(text).alias("record"),
        F.timestamp_micros(F.col("doc_id") * 1_500_000).alias("updated_at"),
    )
    kind = lambda k, h: [X.record_key(F.lit(k), F.col("scope_key"), F.col("file_id"), h).alias("record_key"), F.lit(k).alias("record_kind"), "scope_key", "file_id", "content_hash", "record", "updated_at"]
    return base.select(*kind("latest", None)).unionByName(base.filter("doc_id % 3 <> 0").select(*kind("version", F.col("content_hash"))))


def _snapshot(spark, d) -> str:
    """The record table and the state tables as one snapshot, read back through its pointer."""
    root = tables.scratch(spark, "snapshot")
    h, q = _holds(spark, d), _quarantine(spark, d)
    orders = _t(spark, d, "orders")
    at = F.timestamp_seconds(F.lit(NOW))
    terms = F.array(F.struct(F.col("o_custkey").cast("string").alias("object_hash"), F.lit(0).cast("long").alias("chunk_start"), F.lit(1).cast("long").alias("chunk_end_exclusive"), F.lit(4).cast("long").alias("unpacked_length")))
    tables.write_snapshot(
        {
            "file_records": _records(spark, d),
            "file_reconstructions": orders.select(F.col("o_orderkey").cast("string").alias("file_id"), terms.alias("terms"), at.alias("updated_at")),
            "stored_objects": orders.select(F.col("o_custkey").cast("string").alias("object_hash"), at.alias("registered_at")).distinct(),
            "dedupe_shards": _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("chunk_hash"), F.concat(F.lit("s-"), "p_brand").alias("shard_object_key"), at.alias("updated_at")),
            "quarantine_candidates": q,
            "retention_holds": h.select("object_key", F.lit("why").alias("reason"), "held_at", "release_after"),
            "webhook_deliveries": ev.claim(_deliveries(spark, d)).select(*ev.CLAIM, F.col("at").alias("processed_at")),
        },
        root,
    )
    return tables.current_snapshot(spark, root)


@query(f"WITH {RECS} SELECT file_id, CAST(floor(doc_id * 1.5) AS BIGINT) AS modified FROM records WHERE kind = 'version'")
def record_scan(spark, d):
    return tables.scan_records(tables.table(spark, _snapshot(spark, d), "file_records"), "version").select("file_id", "modified")


@query(f"WITH {RECS} SELECT {_lp('kind')} || {_lp('scope')} || {_lp('file_id')} AS record_key, scope AS scope_key, file_id, h AS content_hash FROM records WHERE kind = 'latest'")
def record_locators(spark, d):
    return tables.locators(tables.table(spark, _snapshot(spark, d), "file_records"), "latest")


@query(f"WITH {RECS} SELECT file_id, kind AS record_kind FROM records WHERE lang = 'en' AND source = 'src1' AND doc_id % 50 <> 0")
def scoped_record_scan(spark, d):
    """All revisions of one repository, by exact fields."""
    parsed = tables.parse_records(tables.table(spark, _snapshot(spark, d), "file_records"))
    return tables.scoped_records(parsed, "en", "src1", "r").select("r.file_id", "record_kind")


@query(f"WITH {RECS} SELECT kind AS record_kind, file_id, h AS content_hash FROM records WHERE doc_id = 11")
def record_points(spark, d):
    """The latest of a file and its version of a content hash."""
    records = tables.table(spark, _snapshot(spark, d), "file_records")
    some = records.filter("file_id = 'f-11'").select("scope_key", "content_hash").limit(1).collect()[0]
    out = tables.read_record(records, "f-11", some["scope_key"]).unionByName(tables.read_record(records, "f-11", some["scope_key"], some["content_hash"]))
    return out.select("record_kind", "file_id", "content_hash")


@query(f"WITH {RECS} SELECT file_id, kind AS record_kind, doc_id % 50 <> 0 AS parsed, CASE WHEN doc_id % 50 <> 0 THEN doc_id % 7 <> 0 END AS chunked, CASE WHEN doc_id % 50 <> 0 THEN CAST(n AS BIGINT) END AS length, CASE WHEN doc_id % 50 <> 0 THEN CAST(1 AS BIGINT) END AS range_end FROM records")
def record_parse(spark, d):
    """Every record and its terms; unreadable ones are rows too."""
    parsed = tables.parse_records(tables.table(spark, _snapshot(spark, d), "file_records"))
    terms = tables.record_terms(parsed).select("record_key", "chunked", "length", "range_end")
    return parsed.select("record_key", "file_id", "record_kind", "parsed").join(terms, "record_key", "left").drop("record_key")


@query(
    f"""WITH {HOLDS}, {QUARANTINE}, {EVENTS} SELECT 'retention_holds' AS "table", count(*) AS rows, min(object_key) AS first FROM holds UNION ALL SELECT 'quarantine_candidates', count(*), min(object_key) FROM q
UNION ALL SELECT 'stored_objects', count(DISTINCT o_custkey), min(CAST(o_custkey AS VARCHAR)) FROM orders UNION ALL SELECT 'file_reconstructions', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders
UNION ALL SELECT 'dedupe_shards', count(*), min(CAST(p_partkey AS VARCHAR)) FROM part UNION ALL SELECT 'webhook_deliveries', count(DISTINCT (owner, repo, delivery_id)), 'p' FROM ev"""
)
def state_table_scans(spark, d):
    """Each state table by its key."""
    root = _snapshot(spark, d)
    keys = {"retention_holds": "object_key", "quarantine_candidates": "object_key", "stored_objects": "object_hash", "file_reconstructions": "file_id", "dedupe_shards": "chunk_hash", "webhook_deliveries": "provider"}
    out = None
    for name, key in keys.items():
        rows = tables.table(spark, root, name).orderBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first")).select(F.lit(name).alias("table"), "rows", "first")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH {HOLDS}, {QUARANTINE} SELECT 'mapping' AS what, CAST(p_partkey AS VARCHAR) AS key, 's-' || p_brand AS value FROM part WHERE p_partkey % 100 = 1 UNION ALL SELECT 'candidate', object_key, CAST(observed_length AS VARCHAR) FROM q WHERE object_key LIKE '%00'
UNION ALL SELECT 'hold', object_key, CAST(held_at AS VARCHAR) FROM holds WHERE object_key IN ('7', '9') UNION ALL SELECT 'reconstruction', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey = 5"""
)
def state_point_lookups(spark, d):
    root = _snapshot(spark, d)
    pick = lambda name, key, test, value, what: tables.table(spark, root, name).filter(test).select(F.lit(what).alias("what"), F.col(key).alias("key"), F.expr(value).cast("string").alias("value"))
    out = pick("dedupe_shards", "chunk_hash", "cast(chunk_hash as long) % 100 = 1", "shard_object_key", "mapping")
    out = out.unionByName(pick("quarantine_candidates", "object_key", "object_key like '%00'", "observed_length", "candidate"))
    out = out.unionByName(pick("retention_holds", "object_key", "object_key in ('7', '9')", "held_at", "hold"))
    return out.unionByName(pick("file_reconstructions", "file_id", "file_id = '5'", "terms[0].object_hash", "reconstruction"))


@query("SELECT 'orders' AS \"table\", true AS any_rows UNION ALL SELECT 'none', false")
def any_row_probe(spark, d):
    orders = _t(spark, d, "orders")
    return spark.createDataFrame([("orders", tables.any_rows(orders)), ("none", tables.any_rows(orders.filter("o_orderkey < 0")))], "table string, any_rows boolean")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem)")
def registered_objects(spark, d):
    keys = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return inventory.existing(keys, _t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key")))


@query(f"WITH {CHUNKS}, u AS (SELECT hash, min(length) AS length FROM chunks GROUP BY 1) SELECT count(*) AS chunks, CAST(sum(length) AS BIGINT) AS chunk_bytes, (SELECT count(*) FROM documents) AS files FROM u")
def storage_stats(spark, d):
    """Chunk objects alone count; containers under the same hashes do not."""
    u = _chunks(spark, d).groupBy("hash").agg(F.min("length").alias("length"))
    objects = u.select(X.chunk_key(F.col("hash")).alias("key"), "length").unionByName(u.select(X.xorb_key(F.col("hash")).alias("key"), "length"))
    return chunking.storage_stats(objects, _records(spark, d))


# -- sinks and commits


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size + 2 AS BIGINT) WHEN p_partkey % 2 = 0 THEN CAST(p_size + 1 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS length FROM part")
def object_overwrites(spark, d):
    """Puts that overwrite, some keys twice in one batch: the last by order counts."""
    p = _t(spark, d, "part").select(*_object(), F.lit(0).alias("at"), F.col("p_partkey").alias("k"))
    new = p.filter("k % 2 = 0").withColumns({"length": F.col("length") + 1, "at": F.lit(1)})
    new = new.unionByName(p.filter("k % 6 = 0").withColumns({"length": F.col("length") + 2, "at": F.lit(2)}))
    return state.upsert(p.drop("k"), new.drop("k"), ["key"], "at").select("key", "length")


@query("SELECT 'scope/' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'already_exists' WHEN p_partkey % 5 = 0 THEN 'conflict' ELSE 'inserted' END AS outcome FROM part")
def object_copies(spark, d):
    """Copies of canonical objects under scoped keys, where some are there already and some differ."""
    p = _t(spark, d, "part").select(*_object(), F.col("p_partkey").alias("k"))
    scoped = F.concat(F.lit("scope/"), "key")
    have = p.filter("k % 4 = 0 or k % 5 = 0").select(scoped.alias("key"), (F.col("length") + F.when(F.col("k") % 4 == 0, 0).otherwise(1)).alias("length"), "checksum")
    return state.copy_if_absent(have, p.drop("k"), scoped).select("key", "outcome")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 3 <> 0")
def object_deletes(spark, d):
    """Deletes, again and of keys that are not there: nothing more happens."""
    objects = _t(spark, d, "part").select(*_object(), F.col("p_partkey").alias("k"))
    gone = objects.filter("k % 3 = 0").select("key").union(spark.createDataFrame([("unknown",)], "key string"))
    return state.delete(state.delete(objects, gone, "key"), gone, "key").select("key")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 7 = 0 THEN 'conflict' ELSE 'inserted' END AS outcome FROM part")
def put_conflicts(spark, d):
    """Every object twice in one batch, some of them with other bytes."""
    p = _t(spark, d, "part").select(*_object(), F.col("p_partkey").alias("k"))
    again = p.withColumn("length", F.col("length") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))
    return state.put_if_absent(p.drop("k").limit(0), p.unionByName(again).drop("k")).select("key", "outcome")


@query(f"WITH {EVENTS} SELECT owner, repo, delivery_id, min(arrival) AS arrival, CAST(repo AS BIGINT) % 4 <> 0 AS inserted FROM ev GROUP BY 1, 2, 3")
def delivery_inserts(spark, d):
    """Deliveries newly recorded or known; a repeated one is inserted once."""
    new = _deliveries(spark, d).select(*ev.CLAIM, "arrival")
    known = new.filter("cast(repo as long) % 4 = 0").select(*ev.CLAIM)
    return state.insert_or_ignore(known, new, ev.CLAIM).select("owner", "repo", "delivery_id", "arrival", "inserted")


_ORDER_RECORDS = "o AS (SELECT o_custkey AS k, o_orderkey AS h, epoch(o_orderdate) * 10000000 + o_orderkey AS seq FROM orders)"


def _order_records(spark, d) -> DataFrame:
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 10_000_000 + F.col("o_orderkey")
    return _t(spark, d, "orders").select(F.lit("s").alias("scope_key"), F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderkey").cast("string").alias("content_hash"), at.alias("at"))


@query(f"WITH {_ORDER_RECORDS} SELECT 'version' AS record_kind, CAST(k AS VARCHAR) AS file_id, CAST(h AS VARCHAR) AS content_hash FROM o UNION ALL SELECT 'latest', CAST(k AS VARCHAR), CAST(arg_max(h, seq) AS VARCHAR) FROM o WHERE h % 2 = 0 GROUP BY k UNION ALL SELECT 'latest', CAST(k AS VARCHAR), CAST(arg_max(h, seq) AS VARCHAR) FROM o WHERE k NOT IN (SELECT k FROM o WHERE h % 2 = 0) GROUP BY k")
def commit_batch(spark, d):
    """Odd orders are committed first, then all even ones: versions add up, the latest is the last of the batch that has the file."""
    r = _order_records(spark, d)
    none = spark.createDataFrame([], "record_kind string, scope_key string, file_id string, content_hash string")
    odd = state.commit_versions(none, r.filter("cast(content_hash as long) % 2 = 1"), "at")
    return state.commit_versions(odd, r.filter("cast(content_hash as long) % 2 = 0"), "at").select("record_kind", "file_id", "content_hash")


@query(f"WITH {_ORDER_RECORDS}, l AS (SELECT k, arg_max(h, seq) AS h FROM o GROUP BY k) SELECT CAST(k AS VARCHAR) AS file_id, CAST(h AS VARCHAR) AS content_hash FROM o UNION SELECT CAST(k AS VARCHAR), CAST(h AS VARCHAR) FROM l")
def records_by_identity(spark, d):
    """Latest and version records in one table, each identity once."""
    none = spark.createDataFrame([], "record_kind string, scope_key string, file_id string, content_hash string")
    all_ = state.commit_versions(none, _order_records(spark, d), "at")
    parts = [all_.filter(F.col("record_kind") == k).drop("record_kind") for k in ("latest", "version")]
    return parts[0].unionByName(parts[1]).dropDuplicates(["scope_key", "file_id", "content_hash"]).select("file_id", "content_hash")


@query(
    f"""WITH {HOLDS}, n AS (SELECT object_key, max(k) AS k FROM (SELECT CAST(p_partkey % 200 AS VARCHAR) AS object_key, p_partkey AS k FROM part) GROUP BY 1),
s AS (SELECT object_key, CASE WHEN k % 2 = 0 THEN CAST(1706745600 + k AS BIGINT) END AS release_after FROM n UNION ALL SELECT object_key, release_after FROM holds WHERE object_key NOT IN (SELECT object_key FROM n))
SELECT object_key, release_after FROM s WHERE (release_after IS NULL OR release_after > 1706745700) AND object_key NOT LIKE '%1'"""
)
def hold_upsert(spark, d):
    """Holds set anew, many a key more than once: the last counts. Some are released, the active ones are listed."""
    p = F.col("p_partkey")
    new = _t(spark, d, "part").select((p % 200).cast("string").alias("object_key"), F.lit("why").alias("reason"), F.when(p % 2 == 0, p).cast("long").alias("ttl"), p.alias("at"))
    old = _holds(spark, d).select("object_key", F.lit("old").alias("reason"), "held_at", "release_after")
    holds = jobs.set_holds(old, new, NOW, "at")
    return jobs.list_holds(jobs.release_holds(holds, holds.filter("object_key like '%1'")), NOW + 100, active_only=True).select("object_key", "release_after")


@query("SELECT 'objects' AS \"table\", count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS bytes FROM part UNION ALL SELECT 'orders', count(*), NULL FROM orders UNION ALL SELECT 'nation', count(*), NULL FROM nation")
def backup_manifest(spark, d):
    """A manifest written and read back: counts of tables, entries of objects."""
    root = tables.scratch(spark, "backup")
    inventory.write_backup({t: _t(spark, d, t) for t in ("orders", "nation")}, _t(spark, d, "part").select(*_object()), root)
    entries = spark.read.schema("key string, length long").json(f"{root}/objects").agg(F.sum("length").alias("bytes")).withColumn("table", F.lit("objects"))
    return spark.read.schema("table string, rows long").json(f"{root}/counts").join(entries, "table", "left")


@query(f"WITH {QUARANTINE} SELECT object_key AS key, greatest(delete_after - 1706745600, 0) AS value FROM q UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS BIGINT) FROM part WHERE p_partkey % 4 <> 0")
def gc_artifacts(spark, d):
    """Retention report and orphan inventory written as JSON and read back."""
    from ..operators import gc

    root = tables.scratch(spark, "gc")
    q = _quarantine(spark, d)
    orphans = _t(spark, d, "part").filter("p_partkey % 4 <> 0").select(*_object()).select("key", "length")
    tables.write_gc_artifacts(q.agg(F.count(F.lit(1)).alias("n")), gc.retention_report(q, NOW), gc.orphan_inventory(orphans), root)
    due = spark.read.schema("object_key string, seconds_until_delete long").json(f"{root}/retention").toDF("key", "value")
    return due.unionByName(spark.read.schema("key string, length long").json(f"{root}/orphans").toDF("key", "value"))


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(length) AS BIGINT) * 1000000 // 2000000 AS bytes_per_second, CAST(2 AS BIGINT) AS runs FROM chunks")
def ingest_benchmark(spark, d):
    """Two storage-free runs of the chunk ingest, and rates over fixed times."""
    chunks = _chunks(spark, d)
    for _ in range(2):
        tables.black_hole(chunks)
    totals = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("bytes"))
    runs = totals.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"case": F.lit("ingest"), "micros": F.lit(2_000_000)})
    mean = jobs.averages(runs, "case", "chunks", "bytes", "micros")
    return mean.select(F.col("mean_chunks").alias("chunks"), F.col("mean_bytes").alias("bytes"), X.throughput(F.col("mean_bytes"), F.col("mean_micros")).alias("bytes_per_second"), "runs")


# -- expressions


def _mac_sql() -> str:
    inner, outer = (p.hex() for p in hashing._pads(b"a secret"))
    return f"SELECT event_id, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('body ' || event_id)))) AS mac, event_id % 4 < 2 AS valid FROM events"


@query(_mac_sql())
def webhook_signatures(spark, d):
    """Signatures with and without their prefix, of another body, and no hex at all."""
    k = F.col("event_id")
    body = F.concat(F.lit("body "), k.cast("string")).cast("binary")
    mac = hashing.hmac_sha256(body, b"a secret")
    sent = F.when(k % 4 == 0, F.concat(F.lit("sha256="), mac)).when(k % 4 == 1, mac).when(k % 4 == 2, hashing.hmac_sha256(F.lit("other").cast("binary"), b"a secret")).otherwise(F.lit("sha256=é"))
    return _t(spark, d, "events").select("event_id", mac.alias("mac"), hashing.signature_valid(body, sent, b"a secret").alias("valid"))


_KEYS = "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'a//b' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'a\\b' WHEN 4 THEN 'a' || chr(7) WHEN 5 THEN repeat('k', 4097) WHEN 6 THEN '/a' ELSE 'a/' || p_partkey END"


@query(
    f"""WITH k AS (SELECT p_partkey, {_KEYS} AS key FROM part) SELECT p_partkey, p_partkey % 8 = 7 AS object_key, p_partkey % 8 NOT IN (0, 4, 5) AS scope_part, p_partkey % 8 = 7 AS repository, p_partkey % 4 <> 0 AS tag, p_partkey % 3 = 0 AS upload_id,
p_partkey % 5 <> 2 AS in_scope, p_partkey % 3 <> 2 AS may_read, p_partkey % 3 = 0 AS may_write FROM k"""
)
def name_validators(spark, d):
    """Object keys, scope components, repository names, tags, upload ids, repositories in a scope, and token scopes."""
    p = F.col("p_partkey")
    key = F.when(p % 8 == 0, "").when(p % 8 == 1, "a//b").when(p % 8 == 2, "a/../b").when(p % 8 == 3, "a\\b").when(p % 8 == 4, "a\u0007").when(p % 8 == 5, F.lit("k" * 4097)).when(p % 8 == 6, "/a").otherwise(F.concat(F.lit("a/"), p))
    tag = F.when(p % 4 == 0, F.lit(".x")).otherwise(F.concat(F.lit("v"), p))
    upload = F.when(p % 3 == 0, F.concat(F.lit("ab-"), p)).when(p % 3 == 1, "").otherwise(F.lit("xyz"))
    inside = F.when(p % 5 == 2, "own/names").when(p % 5 == 3, "own/name/below").otherwise("own/name")
    scope = F.when(p % 3 == 0, "write").when(p % 3 == 1, "read").otherwise("none")
    repository = F.when(p % 8 == 5, F.lit("A")).otherwise(key)
    return _t(spark, d, "part").select(
        "p_partkey", X.valid_object_key(key).alias("object_key"), X.valid_scope_part(key).alias("scope_part"), X.valid_repository_name(repository).alias("repository"), X.valid_tag(tag).alias("tag"), X.valid_upload_id(upload).alias("upload_id"),
        X.repository_in_scope(inside, F.lit("Own"), F.lit("Name")).alias("in_scope"), X.scope_allows(scope, "read").alias("may_read"), X.scope_allows(scope, "write").alias("may_write"),
    )


@query(
    """SELECT a.n_nationkey AS x, b.n_nationkey AS y, a.n_regionkey = b.n_regionkey AS repository, a.n_regionkey = b.n_regionkey AND a.n_nationkey % 2 = b.n_nationkey % 2 AS scope FROM nation a JOIN nation b ON a.n_regionkey >= b.n_regionkey AND a.n_regionkey - b.n_regionkey < 2"""
)
def scope_matches(spark, d):
    """Scopes with their revision, and repositories whatever the revision, of neighbouring regions."""
    n = _t(spark, d, "nation")
    scope = F.struct(F.lit("p").alias("provider"), F.lit("o").alias("owner"), F.col("n_regionkey").cast("string").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "main").alias("revision"))
    left = n.select(F.col("n_nationkey").alias("x"), "n_regionkey", scope.alias("s"))
    right = n.select(F.col("n_nationkey").alias("y"), F.explode(F.array(F.col("n_regionkey"), F.col("n_regionkey") + 1)).alias("n_regionkey"), scope.alias("t"))
    return left.join(right, "n_regionkey").select("x", "y", X.same_repository("s", "t").alias("repository"), X.same_scope("s", "t").alias("scope"))


@query(f"WITH {EVENTS} SELECT arrival, secs > 1705968000 + 300 AS future, CASE WHEN arrival % 3 = 0 THEN NULL ELSE secs + arrival % 100 END AS release, 'p:' || owner || '/' || repo || '@' || coalesce(revision, 'latest') || ':f:h' AS identity FROM ev")
def time_and_identity(spark, d):
    """Future skew, release times of holds and identity keys."""
    e = _deliveries(spark, d)
    ttl = F.when(F.col("arrival") % 3 == 0, F.lit(None)).otherwise(F.col("arrival") % 100)
    identity = X.identity_key(F.col("provider"), F.col("owner"), F.col("repo"), F.col("revision"), F.lit("f"), F.lit("h"))
    return e.select("arrival", X.future(F.col("at"), 1_705_968_000).alias("future"), X.hold_release(F.col("at"), ttl).alias("release"), identity.alias("identity"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'operation' WHEN 1 THEN 'too_many_objects' WHEN 2 THEN 'hash_algo' WHEN 3 THEN 'transfer' END AS issue FROM orders"""
)
def lfs_request_issues(spark, d):
    k = F.col("o_orderkey")
    objects = F.sequence(F.lit(1), F.when(k % 5 == 1, 1025).otherwise(2))
    transfers = F.when(k % 5 == 3, F.array(F.lit("ssh"))).when(k % 2 == 0, F.array(F.lit("ssh"), F.lit("basic")))
    issue = jobs.lfs_request_issue(F.when(k % 5 == 0, "lock").otherwise("upload"), objects, F.when(k % 5 == 2, "sha512").when(k % 2 == 0, "sha256"), transfers)
    return _t(spark, d, "orders").select(k.alias("id"), issue.alias("issue"))


@query(
    """WITH d AS (SELECT doc_id, sha256(encode(text)) AS h FROM documents) SELECT doc_id, h AS hex, CASE WHEN doc_id % 3 = 0 THEN h END AS digest, doc_id % 2 <> 0 AS is_hash FROM d"""
)
def hex_and_digests(spark, d):
    """Hex to bytes and back, digests with their algorithm, and the shape of a hash."""
    h = F.sha2("content", 256)
    k = F.col("doc_id") % 3
    named = F.when(k == 0, F.concat(F.lit("sha256:"), h)).when(k == 1, F.concat(F.lit("sha512:"), h)).otherwise(F.concat(F.lit("sha256:"), F.upper(h), F.lit("Z")))
    shape = F.when(F.col("doc_id") % 2 == 0, F.upper(F.concat(F.lit("f"), F.substring(h, 2, 63)))).otherwise(h)
    return _files(spark, d).select("doc_id", X.to_hex(X.from_hex(h)).alias("hex"), X.digest_of_text_id(named).alias("digest"), X.valid_hash(shape).alias("is_hash"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 19 AS a, o_orderkey % 23 AS b FROM orders)
SELECT id, b - a + 1 AS length, CASE WHEN id % 2 = 0 THEN NULL ELSE id + 5 END AS added, 'http://h/x/' || id AS url, CAST(least(ceil(greatest(a * 10, 1) / 64.0), 2) AS BIGINT) AS permits, CAST(greatest(4, least(12, b * 2)) AS INTEGER) AS workers,
CASE WHEN a <= b AND id % 4 <> 0 THEN a END AS put_start, CASE WHEN a <= b AND id % 4 <> 0 THEN b END AS put_end, CASE WHEN id % 2 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN id % 3 = 0 THEN 'v' || id WHEN id % 3 = 1 THEN 'main' ELSE 'plain' END AS branch FROM o"""
)
def transfer_arithmetic(spark, d):
    """Range lengths, checked sums, URLs, permits, defaults, upload ranges, visibility and revisions."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 19).alias("a"), (F.col("o_orderkey") % 23).alias("b"))
    i, a, b = F.col("id"), F.col("a"), F.col("b")
    put = X.content_range(F.when(i % 4 == 0, F.lit("bytes */5")).when(i % 4 == 1, F.concat(F.lit("bytes "), a, F.lit("-"), b, F.lit("/99"))).otherwise(F.concat(a, F.lit("-"), b)))
    ref = F.when(i % 3 == 0, F.concat(F.lit("refs/tags/v"), i)).when(i % 3 == 1, "refs/heads/main").otherwise("plain")
    return o.select(
        "id", X.range_length(a, b).alias("length"), X.checked_add(F.when(i % 2 == 0, F.lit((1 << 63) - 1)).otherwise(i), F.lit(5).cast("long")).alias("added"), X.transfer_url(F.when(i % 2 == 0, "http://h/x//").otherwise("http://h/x"), i.cast("string")).alias("url"),
        X.transfer_permits(a * 10, 64, 2).alias("permits"), X.adaptive_default(b, 2, 4, 12).cast("int").alias("workers"), put["start"].alias("put_start"), put["end"].alias("put_end"), X.visibility(i % 2 == 0).alias("visibility"), X.branch_of(ref).alias("branch"),
    )


@query("SELECT CAST(50 * l_suppkey AS BIGINT) AS id, CAST(CASE WHEN q = 0 THEN 0 ELSE (q * 1000 // n) // 4 END AS BIGINT) AS scaling FROM (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1)")
def bench_scaling(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select((F.col("l_suppkey") * 50).cast("long").alias("id"), X.scaling_per_mille(F.col("q"), F.col("n"), F.lit(4)).alias("scaling"))


def blake3_ingest(spark, d):
    """Chunk keys and content hashes by BLAKE3 of every document; SQL has no such hash, the tests compare with the published vectors."""
    none = spark.createDataFrame([], tables.SCHEMAS["objects"])
    return jobs.ingest(_files(spark, d).select("doc_id", "content"), none, CHUNK, "doc_id").records


QUERIES["blake3_ingest"] = blake3_ingest


@query("SELECT p_brand AS repository, p_name || '-' || p_partkey AS tag FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name || '-' || p_partkey) <= 129 AND p_brand = (SELECT min(p_brand) FROM part)")
def oci_tag_page(spark, d):
    """The first page of a repository's tags and one more, each tag twice in the table."""
    tags = _t(spark, d, "part").select(F.col("p_brand").alias("repository"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("tag"))
    first = tags.agg(F.min("repository")).collect()[0][0]
    return protocols.tag_page(tags.union(tags), first, None, 128).select(F.lit(first).alias("repository"), "tag")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS length FROM part WHERE p_partkey % 3 <> 0")
def migrated_objects(spark, d):
    """The rows that a migration writes into a store that has a third of the objects."""
    p = _t(spark, d, "part").select(*_object(), F.col("p_partkey").alias("k"))
    return inventory.migrate(p.drop("k"), p.filter("k % 3 = 0").drop("k"))[0].select("key", "length")


@query(f"WITH {CHUNKS}, g AS (SELECT DISTINCT hash FROM chunks WHERE source IN ('src1', 'src3')) SELECT substr(hash, 1, 2) || '/' || hash AS object_key, CAST(1706745600 + 86400 AS BIGINT) AS release_after FROM g UNION ALL SELECT 'xorbs/default/' || substr(hash, 1, 2) || '/' || hash || '.xorb', CAST(1706745600 + 86400 AS BIGINT) FROM g")
def repo_delete_holds(spark, d):
    """Holds on all keys that the chunks of deleted repositories may have."""
    docs = _t(spark, d, "documents")
    scope = [F.col("lang").alias("provider"), F.col("source").alias("owner"), F.lit("r").alias("repo")]
    records = docs.select(F.col("doc_id").alias("record_key"), *scope, F.lit("version").alias("record_kind"))
    terms = _chunks(spark, d).select(F.col("doc_id").alias("record_key"), "hash")
    gone = records.filter("owner in ('src1', 'src3')")
    return ev.deleted_repository(records, terms, gone, NOW, lambda h: [X.chunk_key(h), X.xorb_key(h)])["holds"].select("object_key", "release_after")
