"""Chunk ingest: slice, hash, deduplicate, account, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import classify_key, little_endian_hex
from ..functions.hashing import HASHERS
from .state import one_row


def chunk_content(files: DataFrame, chunk_size: int = 1024, content: str = "content") -> DataFrame:
    """One row per chunk: the columns of files but the content, plus idx, offset, length, hash (SHA-256).

    Slicing and hashing happen inside one array expression, so the explode carries hashes and never the content.
    Empty content has no chunks.
    """
    n = F.octet_length(content).cast("long")
    size = F.lit(chunk_size).cast("long")
    piece = lambda at: F.substring(F.col(content), (at + 1).cast("int"), F.lit(chunk_size))
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, size)).otherwise(F.array().cast("array<bigint>"))
    parts = F.transform(starts, lambda at: F.struct(F.floor(at / size).cast("long").alias("idx"), at.alias("offset"), F.least(size, n - at).alias("length"), HASHERS["sha256"](piece(at)).alias("hash")))
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    return files.select(*rest, F.explode(parts).alias("_c")).select(*rest, "_c.idx", "_c.offset", "_c.length", "_c.hash")


def chunk_content_with(files: DataFrame, hasher: str, chunk_size: int = 1024, content: str = "content") -> DataFrame:
    """The same with another hash function; the pieces travel to it as Arrow batches."""
    n, size = F.octet_length(content).cast("long"), F.lit(chunk_size).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, size)).otherwise(F.array().cast("array<bigint>"))
    parts = F.transform(starts, lambda at: F.struct(at.alias("offset"), F.substring(F.col(content), (at + 1).cast("int"), F.lit(chunk_size)).alias("piece")))
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    rows = files.select(*rest, F.explode(parts).alias("_c"))
    return rows.select(*rest, F.floor(F.col("_c.offset") / size).cast("long").alias("idx"), "_c.offset", F.octet_length("_c.piece").cast("long").alias("length"), HASHERS[hasher](F.col("_c.piece")).alias("hash"))


def first_owners(chunks: DataFrame, *order: str) -> DataFrame:
    """One row per hash: the chunk that comes first by ``order``. A minimum, so a hot hash is combined before the shuffle."""
    others = [c for c in chunks.columns if c not in (*order, "hash")]
    return chunks.groupBy("hash").agg(F.min(F.struct(*order, *others)).alias("_o")).select("hash", *[F.col(f"_o.{c}").alias(c) for c in (*order, *others)])


def upload_accounting(chunks: DataFrame, by: str, order: tuple[str, ...], existing: DataFrame | None = None) -> DataFrame:
    """Per ``by``: chunks, inserted, reused, total_bytes, stored_bytes. A repeat, also inside one file, counts as reused."""
    # Both aggregates read the exchange of ``per``, so the chunks are scanned and hashed once.
    per = chunks.groupBy("hash", by).agg(F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_bytes"), F.min(F.struct(*[c for c in order if c != by], "length")).alias("_first"))
    head = F.struct(by, "_first") if by == order[0] else F.struct("_first", by)
    new = per.groupBy("hash").agg(F.min(head).alias("_o")).select("hash", F.col(f"_o.{by}").alias(by), F.col("_o._first.length").alias("length"))
    if existing is not None:
        new = new.join(existing.select("hash"), "hash", "left_anti")
    stored = new.groupBy(by).agg(F.count(F.lit(1)).alias("inserted"), F.sum("length").alias("stored_bytes"))
    totals = per.groupBy(by).agg(F.sum("_n").alias("chunks"), F.sum("_bytes").alias("total_bytes"))
    zero = F.lit(0).cast("long")
    joined = totals.join(stored, by, "left").withColumn("inserted", F.coalesce("inserted", zero))
    return joined.select(by, "chunks", "inserted", (F.col("chunks") - F.col("inserted")).alias("reused"), "total_bytes", F.coalesce("stored_bytes", zero).alias("stored_bytes"))


def content_digest(terms: DataFrame, file: str, total: Column, chunk_size: int, hasher: str = "sha256") -> DataFrame:
    """(file, content_hash): hash over total, chunk size and, in order, each chunk's hex hash, offset and length (little endian)."""
    per_file = terms.groupBy(file).agg(total.alias("_total"), F.sort_array(F.collect_list(F.struct("idx", "hash", "offset", "length"))).alias("_t"))
    text = F.transform("_t", lambda t: F.concat(F.hex(F.encode(t["hash"], "UTF-8")), little_endian_hex(t["offset"]), little_endian_hex(t["length"])))
    body = F.concat(little_endian_hex(F.col("_total")), little_endian_hex(F.lit(chunk_size)), F.array_join(text, ""))
    return per_file.select(file, HASHERS[hasher](F.unhex(body)).alias("content_hash"))


def storage_stats(objects: DataFrame, records: DataFrame) -> DataFrame:
    """One row: chunk objects and their bytes (other classes do not count), and latest records."""
    zero = F.lit(0).cast("long")
    is_chunk = classify_key(F.col("key"))["class"] == "chunk"
    chunks = objects.filter(is_chunk).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), zero).alias("chunk_bytes"))
    return one_row([chunks, records.filter("record_kind = 'latest'").agg(F.count(F.lit(1)).alias("files"))])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: stored chunks, their bytes, and the references to them."""
    unique = chunks.groupBy("hash").agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("refs"))
    return unique.agg(F.count(F.lit(1)).alias("chunk_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("chunk_bytes"), F.coalesce(F.sum("refs"), F.lit(0)).alias("references"))
