"""Protocol-level set jobs: batch negotiation, tags, manifests, scope references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import require_none

#: Objects of a batch, tags of a page.
MAX_BATCH, MAX_TAGS = 1024, 128


def lfs_batch(requested: DataFrame, objects: DataFrame, operation: str) -> DataFrame:
    """requested (oid, size) plus action: download or missing, upload or skip. objects: oid.

    With a column ``batch`` the requests of many clients are judged at once; a batch of more than MAX_BATCH objects is an error.
    """
    if operation not in ("download", "upload"):
        raise ValueError(operation)
    if "batch" in requested.columns:
        require_none(requested.groupBy("batch").count().filter(F.col("count") > MAX_BATCH), f"more than {MAX_BATCH} objects")
    have = objects.select("oid").distinct().withColumn("_there", F.lit(True))
    yes, no = ("download", "missing") if operation == "download" else ("skip", "upload")
    return requested.join(have, "oid", "left").withColumn("action", F.when(F.col("_there"), F.lit(yes)).otherwise(F.lit(no))).drop("_there")


def resolve_tags(tags: DataFrame, manifests: DataFrame) -> DataFrame:
    """tags (repository, tag, digest) with their manifests (repository, digest, ...)."""
    return tags.join(manifests, ["repository", "digest"])


def tag_page(tags: DataFrame, repository: str, last: str | None, limit: int) -> DataFrame:
    """Distinct tags after ``last``, ascending, one more than the limit if more follow."""
    if not 0 < limit <= MAX_TAGS:
        raise ValueError(f"a page has 1 to {MAX_TAGS} tags")
    own = tags.filter(F.col("repository") == repository)
    if last is not None:
        own = own.filter(F.col("tag") > last)
    return own.select("tag").distinct().orderBy("tag").limit(limit + 1)


def move_tags(tags: DataFrame, moves: DataFrame) -> DataFrame:
    """The next mapping: a moved tag points at its new digest."""
    moved = moves.select("repository", "tag", F.col("digest").alias("_to"))
    return tags.join(moved, ["repository", "tag"], "full_outer").withColumn("digest", F.coalesce("_to", "digest")).select("repository", "tag", "digest")


def delete_manifests(tags: DataFrame, targets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Tags that remain: those whose reverse entry (targets: repository, digest, tag) names a deleted digest go, if they still point at it."""
    gone = targets.join(deleted, ["repository", "digest"], "left_semi").join(tags, ["repository", "digest", "tag"], "left_semi")
    return tags.join(gone.select("repository", "tag"), ["repository", "tag"], "left_anti")


def missing_descriptors(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repository, digest, missing): descriptors that no blob of the repository has. manifests: repository, digest, descriptors (array)."""
    wanted = manifests.select("repository", "digest", F.explode("descriptors").alias("missing"))
    return wanted.join(blobs.select("repository", F.col("digest").alias("missing")), ["repository", "missing"], "left_anti").select("repository", "digest", "missing")


def references(records: DataFrame, terms: DataFrame, hashes: DataFrame, scope: str = "scope_key") -> DataFrame:
    """(scope, hash): which of the hashes each scope's records reference."""
    return terms.join(records.select("record_key", scope), "record_key").select(scope, "hash").distinct().join(hashes, "hash", "left_semi")
