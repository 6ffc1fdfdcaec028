"""Readers and writers: inventories, record tables, JSON records, containers, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "hash STRING, offset BIGINT, length BIGINT, range_start BIGINT, range_end BIGINT, packed_start BIGINT, packed_end BIGINT"
RECORD = f"file_id STRING, content_hash STRING, total_bytes BIGINT, chunk_size BIGINT, repository_scope STRUCT<provider: STRING, owner: STRING, name: STRING, revision: STRING>, chunks ARRAY<STRUCT<{CHUNK.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>"
SCHEMAS = {
    "objects": "key STRING, length BIGINT, checksum STRING",
    "file_records": "record_key STRING, record_kind STRING, scope_key STRING, file_id STRING, content_hash STRING, record STRING, updated_at TIMESTAMP",
    "file_reconstructions": "file_id STRING, terms ARRAY<STRUCT<object_hash: STRING, chunk_start: BIGINT, chunk_end_exclusive: BIGINT, unpacked_length: BIGINT>>, updated_at TIMESTAMP",
    "stored_objects": "object_hash STRING, registered_at TIMESTAMP",
    "dedupe_shards": "chunk_hash STRING, shard_object_key STRING, updated_at TIMESTAMP",
    "quarantine_candidates": "object_key STRING, observed_length BIGINT, first_seen BIGINT, delete_after BIGINT",
    "retention_holds": "object_key STRING, reason STRING, held_at BIGINT, release_after BIGINT",
    "webhook_deliveries": "provider STRING, owner STRING, repo STRING, delivery_id STRING, processed_at BIGINT",
    "provider_repository_states": "provider STRING, owner STRING, repo STRING, last_access_changed_at BIGINT, last_revision_pushed_at BIGINT, last_pushed_revision STRING, last_cache_invalidated_at BIGINT, last_authorization_rechecked_at BIGINT, last_drift_checked_at BIGINT",
}
MAX_RECORD_BYTES = 1 << 30


def _key(root: str) -> Column:
    """The part of a path below the root, whatever scheme and host the file system puts before it."""
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    return F.expr(f"substr(path, instr(path, {base!r}) + {len(base)})")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder spark.checkpoint.dir; a folder of its own only where that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="scratch")
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame that several steps read, written once to the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """key, length, modified of every file below a folder, on any Hadoop file system; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_key(root).alias("key"), "length", F.unix_timestamp("modificationTime").alias("modified"))


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_key(root).alias("key"), "length", "content")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A state table of a snapshot, with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table in a relational store; filters and columns are pushed to it."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def parse_records(records: DataFrame, record: str = "record", strict: bool = False) -> DataFrame:
    """Adds r (the parsed record, null if unreadable), parsed and record_bytes; strict: unreadable records fail the job. Missing chunk fields get 0, 1, 0, 0."""
    size = F.octet_length(record).cast("long")
    parsed = F.from_json(F.when(size <= MAX_RECORD_BYTES, F.col(record)), T.StructType.fromDDL(RECORD), {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    df = records.withColumns({"record_bytes": size, "r": parsed}).withColumn("parsed", F.col("r.file_id").isNotNull() & F.col("r.chunks").isNotNull())
    whole = F.transform(
        "r.chunks",
        lambda c: F.struct(
            c["hash"].alias("hash"),
            c["offset"].alias("offset"),
            c["length"].alias("length"),
            F.coalesce(c["range_start"], F.lit(0)).alias("range_start"),
            F.coalesce(c["range_end"], F.lit(1)).alias("range_end"),
            F.coalesce(c["packed_start"], F.lit(0)).alias("packed_start"),
            F.coalesce(c["packed_end"], F.lit(0)).alias("packed_end"),
        ),
    )
    return df.withColumn("chunks", whole)


def record_terms(parsed: DataFrame) -> DataFrame:
    """One row per chunk of parsed records; chunked tells whether it is a stored chunk or a range of a container."""
    rows = parsed.filter("parsed").select("record_key", F.col("r.chunk_size").alias("chunk_size"), F.posexplode("chunks").alias("pos", "c"))
    return rows.select("record_key", F.col("pos").cast("long").alias("pos"), (F.col("chunk_size") != 0).alias("chunked"), "c.*")


def scoped_records(records: DataFrame, provider: str, owner: str, name: str) -> DataFrame:
    """All revisions of a repository, by exact fields of the scope struct r.repository_scope."""
    s = F.col("r.repository_scope")
    return records.filter((s["provider"] == provider) & (s["owner"] == owner) & (s["name"] == name))


def scan_records(records: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind with the whole seconds of their change."""
    return records.filter(F.col("record_kind") == kind).withColumn("modified", F.floor(F.unix_micros("updated_at") / 1_000_000).cast("long"))


def locators(records: DataFrame, kind: str) -> DataFrame:
    """Keys alone: the record column is not read."""
    return records.filter(F.col("record_kind") == kind).select("record_key", "scope_key", "file_id", "content_hash")


def read_record(records: DataFrame, file_id: str, scope_key: str, content_hash: str | None = None) -> DataFrame:
    """The latest of a file, or the version of a content hash."""
    own = records.filter((F.col("file_id") == file_id) & (F.col("scope_key") == scope_key))
    if content_hash is None:
        return own.filter("record_kind = 'latest'")
    return own.filter((F.col("record_kind") == "version") & (F.col("content_hash") == content_hash))


def sorted_inventory(objects: DataFrame) -> DataFrame:
    """By the bytes of the key."""
    return objects.orderBy("key")


def legacy_records(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document per file, as rows of record_key and record."""
    docs = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return docs.select(F.col("_metadata.file_path").alias("record_key"), F.col("value").alias("record"))


def provider_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def any_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables under a new version and then moves the pointer: readers see all of it or none."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return f"{root}/{version}"


def current_snapshot(spark: SparkSession, root: str) -> str:
    return f"{root}/{spark.read.schema('version string').json(f'{root}/current').collect()[0]['version']}"


def write_gc_artifacts(report: DataFrame, retention: DataFrame, orphans: DataFrame, path: str) -> None:
    """Report, retention by due time and orphan inventory by key, as JSON lines."""
    for name, df in (("report", report), ("retention", retention), ("orphans", orphans)):
        df.write.json(f"{path}/{name}")


def black_hole(df: DataFrame) -> None:
    """Runs a plan and keeps nothing: the sink of ingest benchmarks."""
    df.write.format("noop").mode("overwrite").save()
