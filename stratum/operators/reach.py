"""Reachable object keys. Three consumers define reachability differently; ``variant`` chooses.

terms: hash, chunked (true: a stored chunk, false: a container with range_start, range_end). members: xorb_hash, idx, chunk_hash.
mappings: chunk_hash, shard_object_key. objects: key.

gc: container members count for keys and for the chunks that keep shards alive. repair: members count for keys only.
fsck: only members inside the term's range, for keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import chunk_key, xorb_key


def reachable_keys(terms: DataFrame, members: DataFrame, mappings: DataFrame, objects: DataFrame, variant: str = "gc") -> DataFrame:
    """Distinct keys; duplicates go before every join, so a hot hash is one row."""
    if variant not in ("gc", "repair", "fsck"):
        raise ValueError(variant)
    chunks = terms.filter("chunked").select(F.col("hash").alias("chunk_hash")).distinct()
    ranges = terms.filter("not chunked").select(F.col("hash").alias("xorb_hash"), "range_start", "range_end").distinct()
    xorbs = ranges.select("xorb_hash").distinct()
    if variant == "fsck":
        inside = members.join(ranges, "xorb_hash").filter("idx >= range_start and idx < range_end").select("chunk_hash").distinct()
    else:
        inside = members.join(xorbs, "xorb_hash", "left_semi").select("chunk_hash").distinct()
    # A stored chunk may also have a container of its own; it counts if it exists.
    optional = chunks.select(xorb_key(F.col("chunk_hash")).alias("key")).join(objects.select("key"), "key", "left_semi")
    live = chunks.union(inside).distinct() if variant == "gc" else chunks
    shards = mappings.join(live, "chunk_hash", "left_semi").select(F.col("shard_object_key").alias("key"))
    keys = chunks.select(chunk_key(F.col("chunk_hash")).alias("key"))
    keys = keys.union(xorbs.select(xorb_key(F.col("xorb_hash")))).union(inside.select(chunk_key(F.col("chunk_hash")))).union(optional).union(shards)
    return keys.distinct()
