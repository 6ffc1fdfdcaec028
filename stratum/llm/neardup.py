"""Near copies by the five-word shingles that two texts share: candidates by SimHash and minhash, links by exact Jaccard similarity.

Texts that are equal up to case and spacing are one node. A node has the SimHash fingerprint of its distinct shingles; nodes whose
fingerprints differ in RADIUS bits or fewer are candidates, all found by the tiled comparison of simhash.py. Texts of a similarity of
0.8 differ in more bits than that, so a node also has BANDS keys of ROWS minima each; nodes that share a key are candidates
too (a pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8). Connected candidates are a group,
dealt into tiles that are compared exactly: two nodes are linked if their sets of shingles have a Jaccard similarity of SIMILAR or
more, so links that neither showed are found as well where other candidates connect them. A tile meets itself and the first tile
of its group. Where that has not made one component of the group, it is dealt anew by component, and every pair of tiles meets
that could still join two. So the work on a group of near copies of one text grows with its size; only the tiles of a group that
stays in many parts meet in pairs. What is compared emits a spanning forest of its links, and components are found as for op 2.

Defined results: words are split and lowered as for the fingerprints; a text of fewer words than a shingle is one shingle; null and
blank texts are copies of each other and of nothing else; an empty table gives no rows. Nodes and rows are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep_rows, map_texts, materialize, row_hash, ship, split_words
from .simhash import components, folded, links

SHINGLE = 5
SIMILAR = (4, 5)
#: Bits in which the fingerprints of candidates differ at most.
RADIUS = 3
BANDS, ROWS = 20, 5
SEED = 42
TILE = 512
#: Tiles that share one copy of the first tile of their group.
FAN = 64
TILE_BYTES = 4 << 20


def lowered(text: str | None) -> list[bytes]:
    w = split_words(text)
    return b" ".join(w).lower().split(b" ") if w else []


def shingles(w: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles of some words, ascending."""
    import xxhash

    if not w:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), dtype=np.uint64))


_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def keys(grams: np.ndarray) -> list[int]:
    """The key of each band; none without shingles."""
    import xxhash

    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(grams), 512):  # bounded memory for very long texts
        part = grams[at : at + 512]
        least = np.minimum(least, ((part[:, None] * _FACTORS + _TERMS) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def linked(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs of SIMILAR or more: a search that compares each set with all not yet reached."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left, right, open_ = [], [], np.ones(len(sets), dtype=bool)
    mark = np.zeros(len(values) + 1, dtype=np.int64)
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            x = queue.pop()
            own = inverse[starts[x] : starts[x + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[inverse], starts[:-1])
            mark[own] = 0
            near = np.flatnonzero(open_ & (SIMILAR[1] * shared >= SIMILAR[0] * (sizes + sizes[x] - shared)))
            open_[near] = False
            left += [x] * len(near)
            right += near.tolist()
            queue += near.tolist()
    return left, right


def fingerprint(grams: np.ndarray) -> int | None:
    """SimHash of the distinct shingles; none without shingles."""
    return folded(grams.view(np.uint8).reshape(-1, 8)) if len(grams) else None


def _marked(docs: DataFrame, text: str, id: str) -> DataFrame:
    """doc_id, digest, node, fingerprint and keys of every row."""

    def make():
        import xxhash

        from stratum.llm.neardup import fingerprint, keys, lowered, shingles

        def mark(texts):
            nodes, prints, found = [], [], []
            for t in texts:
                w = lowered(t)
                grams = shingles(w)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(w), SEED) - (1 << 63))
                prints.append(fingerprint(grams))
                found.append(np.array(keys(grams), dtype=np.int64))
            return [nodes, prints, found]

        return mark

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_n_text"), row_hash(docs).alias("digest"))
    fields = [("node", T.LongType(), pa.int64()), ("fp", T.LongType(), pa.int64()), ("keys", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return map_texts(rows, "_n_text", fields, make, budget=1 << 20).drop("_n_text")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Candidates (a, b) whose closure joins the nodes of fingerprints within RADIUS bits."""
    printed = materialize(classes.filter("fp is not null").select("node", "fp"), "neardup-prints")
    least = materialize(printed.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")), "neardup-fps")
    same = printed.join(least.filter("least < most"), "fp").filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    left, right = (least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(f"node_{x}")) for x in "ab")
    near = links(least.select("fp"), RADIUS).toDF("fp_a", "fp_b").join(left, "fp_a").join(right, "fp_b")
    return same.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _by_keys(classes: DataFrame) -> DataFrame:
    """Candidates (a, b) whose closure joins the nodes that share a key: one a node and few more, however many keys they share.

    A node is joined to the least of the least nodes of its keys, and those others (fewer than BANDS) to that one.
    """
    keyed = materialize(classes.select("node", F.explode("keys").alias("key")), "neardup-keys")
    least = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least")
    stars = keyed.join(least, "key").filter("node > least").groupBy("node").agg(F.collect_set("least").alias("all"))
    stars = materialize(stars.select(F.array_min("all").alias("a"), F.col("node").alias("b"), "all"), "neardup-least")
    discard(keyed)
    return stars.select("a", "b").unionByName(stars.select("a", F.explode("all").alias("b")).filter("a < b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """Edges (a, b) whose closure joins the nodes of similar texts. classes: node, first (with a digest), fp, keys."""
    groups = components(materialize(_by_fingerprint(classes).unionByName(_by_keys(classes)), "neardup-stars"))
    asked = classes.join(groups, "node").select("node", "label", F.col("first.digest").alias("digest"))
    found = docs.select(F.col(text).alias("_n_text"), row_hash(docs).alias("digest")).join(asked, "digest").dropDuplicates(["digest"])

    def make():
        from stratum.llm.neardup import lowered, shingles

        return lambda texts: [[shingles(lowered(t)).tobytes() for t in texts]]

    sets = materialize(map_texts(found.select("node", "label", "_n_text"), "_n_text", [("grams", T.BinaryType(), pa.binary())], make).select("node", "label", "grams"), "neardup-sets")
    out = materialize(_first_links(sets), "neardup-links")
    crowded = sets.groupBy("label").agg(_parts().alias("parts")).filter("parts > 1").select("label")
    if crowded.limit(1).count():
        out = materialize(out.unionByName(_other_links(sets, crowded, components(out))), "neardup-links")
    discard(sets)
    return out


def _parts() -> Column:
    """Tiles that a group of sets needs."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum(F.octet_length("grams")) / TILE_BYTES))


def _tiles(sets: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, parts, tile and the rows (node, grams) of each tile."""
    spread = sets.join(sets.groupBy(*by).agg(_parts().alias("parts")), by).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")))
    spread = spread.select(*by, "parts", "tile", "node", "grams").repartition(*by, "tile")
    return materialize(spread.groupBy(*by, "parts", "tile").agg(F.collect_list(F.struct("node", "grams")).alias("rows")), name)


def _compared(work: DataFrame) -> DataFrame:
    """A forest (a, b) of the links in rows_a and rows_b, the rows of two tiles; null rows_b: of one tile."""
    ship(work.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.neardup import linked

        for batch in batches:
            for r in range(batch.num_rows):
                rows = batch.column(0)[r].as_py() + (batch.column(1)[r].as_py() or [])
                u, v = linked([np.frombuffer(x["grams"], dtype=np.uint64) for x in rows])
                if u:
                    nodes = np.array([x["node"] for x in rows], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["a", "b"])

    return work.select("rows_a", "rows_b").mapInArrow(compare, "a long, b long")


def _first_links(sets: DataFrame) -> DataFrame:
    """The links inside each tile, and those to the first tile of its group, which is sent once to every FAN tiles."""
    tiles = _tiles(sets, ["label"], "neardup-tiles").withColumn("fan", F.floor(F.col("tile") / FAN))
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / FAN))
    first = tiles.filter("tile = 0").select("label", F.explode(copies).alias("fan"), F.col("rows").alias("rows_b"))
    work = tiles.join(first, ["label", "fan"], "left")
    return _compared(work.select(F.col("rows").alias("rows_a"), F.when(F.col("tile") > 0, F.col("rows_b")).alias("rows_b")))


def _other_links(sets: DataFrame, crowded: DataFrame, found: DataFrame) -> DataFrame:
    """The links between tiles of crowded groups that are not one component yet. found: node, label of the components so far.

    A component of half a tile or more has tiles of its own, which need not meet each other; the rest of its group shares tiles.
    """
    found = found.select("node", F.col("label").alias("comp"))
    nodes = sets.join(crowded, "label", "left_semi").select("label", "node").join(found, "node", "left")
    nodes = materialize(nodes.select("label", "node", F.coalesce("comp", "node").alias("comp")), "neardup-comps")
    open_ = nodes.groupBy("label").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("label")
    sizes = nodes.join(open_, "label", "left_semi").groupBy("label", "comp").agg((2 * F.count(F.lit(1)) >= TILE).alias("whole"))
    homes = nodes.join(sizes, ["label", "comp"]).select("label", "node", "whole", F.when(F.col("whole"), F.col("comp")).otherwise(F.col("label")).alias("home"))
    tiles = _tiles(sets.join(homes, ["label", "node"]), ["label", "whole", "home"], "neardup-tiles")
    tiles = tiles.select("label", F.struct("whole", "home", "tile").alias("at"), "rows")
    left, right = ([tiles.select("label", F.col("at").alias(f"at_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab"])
    alike = F.col("at_a.whole") & F.col("at_b.whole") & (F.col("at_a.home") == F.col("at_b.home"))
    pairs = left.drop("rows_a").join(right.drop("rows_b"), "label").filter((F.col("at_a") <= F.col("at_b")) & ~alike)
    work = pairs.join(left, ["label", "at_a"]).join(right, ["label", "at_b"])
    return _compared(work.select("rows_a", F.when(F.col("at_a") < F.col("at_b"), F.col("rows_b")).alias("rows_b")))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each component stays, columns as in docs: the first by id (null last), text and the hash of the whole row."""
    marked = materialize(_marked(docs, text, id), "neardup-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "digest")).alias("first")
    classes = materialize(marked.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "neardup-classes")
    labels = components(_links(docs, classes, text)).withColumnRenamed("node", "at")
    joined = classes.join(labels, F.col("node") == F.col("at"), "left").select("first", F.coalesce("label", "node").alias("label"))
    return keep_rows(docs, joined.groupBy("label").agg(F.min("first").alias("first")).select("first.digest"))
