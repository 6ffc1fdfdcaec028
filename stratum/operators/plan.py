"""Reconstruction plans: validation, ranged plans, fetch lists, byte assembly.

terms: file_id, pos, hash, offset, length, range_start, range_end, packed_start, packed_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import valid_hash
from .state import require_none

#: Bytes of a file that assemble() puts into one cell.
MAX_CELL = 256 << 20
#: Files of a batch request, terms or chunks of a shard, files or containers of a shard.
MAX_BATCH_FILES, MAX_SHARD_TERMS, MAX_SHARD_FILES = 1024, 65_536, 16_384


def validate(terms: DataFrame, files: DataFrame, file: str = "file_id", pos: str = "pos") -> DataFrame:
    """(file, pos, issue): the first failing check of each file, in order of position and then of check; then the total.

    files: file, total_bytes. A file without terms is valid only if its total is 0.
    """
    before = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("length").over(before), F.lit(0))
    issue = (
        F.when(~valid_hash(F.col("hash")), F.lit("invalid_content_hash"))
        .when(F.col("length") == 0, F.lit("empty_chunk"))
        .when(F.col("offset") != F.col("_run"), F.lit("non_contiguous_chunks"))
        .when(F.col("range_end") <= F.col("range_start"), F.lit("invalid_chunk_range"))
        .when(F.col("packed_end") <= F.col("packed_start"), F.lit("invalid_packed_range"))
        .when(F.try_add(F.col("_run"), F.col("length")).isNull(), F.lit("total_bytes_mismatch"))
    )
    checked = terms.withColumn("_run", run).withColumn("issue", issue)
    first = checked.groupBy(file).agg(F.min(F.when(F.col("issue").isNotNull(), F.struct(F.col(pos).alias("pos"), F.col("issue")))).alias("_f"), F.sum("length").alias("_sum"))
    joined = files.select(file, "total_bytes").join(first, file, "left")
    total = F.when(F.coalesce("_sum", F.lit(0)) != F.col("total_bytes"), F.lit("total_bytes_mismatch"))
    out = joined.select(file, F.col("_f.pos").alias("pos"), F.coalesce(F.col("_f.issue"), total).alias("issue"))
    return out.filter("issue is not null")


def ranged_plan(terms: DataFrame, requests: DataFrame, file: str = "file_id") -> DataFrame:
    """Terms that overlap each request (file, start, end inclusive), one row per request:
    terms (count), offset_into_first_range, first_pos, last_pos, planned_bytes, unsatisfiable.

    A request that reaches past the file's end, and any on an empty file, is unsatisfiable.
    """
    sizes = terms.groupBy(file).agg(F.sum("length").alias("_total"))
    asked = requests.join(sizes, file, "left").withColumn("unsatisfiable", F.coalesce(F.col("end") >= F.col("_total"), F.lit(True)))
    overlap = (F.col("offset") <= F.col("end")) & (F.col("offset") + F.col("length") - 1 >= F.col("start"))
    hits = asked.filter("not unsatisfiable").join(terms, file).filter(overlap)
    plan = hits.groupBy(file, "start", "end").agg(
        F.count(F.lit(1)).alias("terms"),
        F.min_by(F.greatest(F.col("start") - F.col("offset"), F.lit(0)), "pos").alias("offset_into_first_range"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.sum("length").alias("planned_bytes"),
    )
    return asked.select(file, "start", "end", "unsatisfiable").join(plan, [file, "start", "end"], "left")


def fetch_info(terms: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, hash, entries): ordered distinct fetch entries of each hash, first occurrence first. Byte ranges are inclusive."""
    entry = F.struct(F.col("range_start").alias("chunk_start"), F.col("range_end").alias("chunk_end"), F.col("packed_start").alias("byte_start"), (F.col("packed_end") - 1).alias("byte_end"))
    first = terms.withColumn("_e", entry).groupBy(by, "hash", "_e").agg(F.min("pos").alias("_p"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"])
    return first.groupBy(by, "hash").agg(ordered.alias("entries"))


def guard_size(rows: DataFrame, most: int, what: str) -> None:
    """Fails beyond a documented limit; looks at one row more than it."""
    if rows.limit(most + 1).count() > most:
        require_none(rows.limit(1), f"more than {most} {what}")


def batch_fetch_info(terms: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """(hash, entries) over requested files (file_id, position): entries of a hash follow request order and repeat across files. Unknown files
    are dropped. More than MAX_BATCH_FILES ids are an error; a batch job over a whole table gives its own bound."""
    guard_size(ids, MAX_BATCH_FILES if most is None else most, "files of a batch request")
    per_file = fetch_info(terms).join(ids, "file_id")
    merged = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "entries"))), lambda x: x["entries"]))
    return per_file.groupBy("hash").agg(merged.alias("entries"))


def assemble(terms: DataFrame, objects: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, content): the bytes of each file in one cell, for files that fit there; file_parts() has no such bound. objects: hash, content.
    Fails on a missing object or a wrong length, and on a file of more than MAX_CELL bytes."""
    large = terms.groupBy(file).agg(F.sum("length").alias("bytes")).filter(F.col("bytes") > MAX_CELL)
    require_none(large, "file too large for one cell")
    joined = terms.join(objects, "hash", "left")
    part = F.when(F.octet_length("content") == F.col("length"), F.col("content"))
    checked = joined.withColumn("_part", F.coalesce(F.hex(part), F.raise_error(F.concat(F.lit("missing or short object "), F.col("hash"))).cast("string")))
    return checked.groupBy(file).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_part"))), lambda x: x["_part"]), "")).alias("content"))


def file_parts(terms: DataFrame, objects: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, pos, content): the bytes of files part by part, dealt by file and position and in order there, so that no file has to fit
    into a row or a task. objects: hash, content. Fails on a missing object or a wrong length."""
    joined = terms.select(file, "pos", "hash", "length").join(objects.select("hash", "content"), "hash", "left")
    whole = F.octet_length("content") == F.col("length")
    part = F.when(whole, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("missing or short object "), F.col("hash"))).cast("binary"))
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.select(file, "pos", part.alias("content")).repartitionByRange(n, file, "pos").sortWithinPartitions(file, "pos")


def packed_ranges(segments: DataFrame, members: DataFrame) -> DataFrame:
    """segments (xorb_hash, range_start, range_end, ...) plus packed_start and packed_end from the members' packed ends."""
    ends = members.select("xorb_hash", "idx", F.col("packed_end").alias("_end"))
    start = ends.withColumnRenamed("_end", "_before").withColumn("range_start", F.col("idx") + 1).drop("idx")
    stop = ends.withColumnRenamed("_end", "packed_end").withColumn("range_end", F.col("idx") + 1).drop("idx")
    out = segments.join(start, ["xorb_hash", "range_start"], "left").join(stop, ["xorb_hash", "range_end"], "left")
    return out.withColumn("packed_start", F.when(F.col("range_start") == 0, F.lit(0)).otherwise(F.col("_before"))).drop("_before")


def overlapping(offset: Column, length: Column, start: Column, end: Column) -> Column:
    return (offset <= end) & (offset + length - 1 >= start)
