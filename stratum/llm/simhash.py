"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, components.

Fingerprints of distinct value are laid out in tiles by the population counts of their 64/blocks-bit parts. The
sum over parts of the differences of population counts never exceeds the number of differing bits, so two tiles
whose counts are further apart than the radius cannot hold a link and are never paired. The remaining tile pairs are
compared exactly with numpy exclusive-or and bit counts; inside a pair the rows are sorted by population count and
only blocks of rows within the radius meet. Each tile pair emits a spanning forest of its links, never all pairs
of a group, and components are found by distributed label propagation with pointer jumping.

Defined results: null and blank texts have fingerprint zero, linked like any other; repeated rows and ties share
fingerprint and component; an empty table gives no rows; a null doc_id is never the smallest id unless the
whole component has none (component_id is then null). Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep_rows, map_texts, materialize, row_hash, split_words
from .common import materialize as stored

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a tile (128 KB): a pair of tiles carries both, so larger ones mean fewer bytes a comparison.
TILE = 16_384
ROWS_PER_PART = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text."""
    import xxhash

    w = split_words(text)
    if not w:
        return 0
    w = b" ".join(w).lower().split(b" ")
    grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]
    return folded(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), dtype=np.uint8).reshape(-1, 8))


def folded(digests: np.ndarray) -> int:
    """Signed 64-bit SimHash of digests of eight bytes each."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(digests))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_s_fp", shingle: int = SHINGLE) -> DataFrame:

    def make():
        from stratum.llm.simhash import fingerprint

        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return map_texts(docs, text, [(out, T.LongType(), pa.int64())], make)


def _cell(fp: Column, blocks: int) -> Column:
    """Population counts of the blocks as digits in a base that leaves room for counts out of range."""
    width, base = 64 // blocks, _base(blocks)
    mask = (1 << width) - 1
    out = F.lit(0).cast("long")
    for b in range(blocks):
        part = F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit(mask if width < 64 else -1).cast("long"))
        out = out * base + F.bit_count(part).cast("long")
    return out


def _base(blocks: int) -> int:
    return 2 * (64 // blocks) + 2


def _steps(blocks: int, radius: int) -> list[int]:
    """Cell differences within the radius, one of each opposite pair; 0 comes first."""
    vectors = [((0,) * blocks, 0)]
    seen = {vectors[0][0]}
    for v, d in vectors:
        if d < radius:
            for i in range(blocks):
                for s in (-1, 1):
                    n = v[:i] + (v[i] + s,) + v[i + 1 :]
                    if n not in seen:
                        seen.add(n)
                        vectors.append((n, d + 1))
    base = _base(blocks)
    values = []
    for v in seen:
        x = 0
        for d in v:
            x = x * base + d
        values.append(x)
    return sorted(x for x in set(values) if x >= 0)


def _blocks(n: int) -> int:
    """More parts make finer cells; any number gives the same links. Chosen so that cells stay near a tile's size."""
    return 1 if n < 20_000 else 2 if n < 2_000_000 else 4 if n < 200_000_000 else 8


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join exactly the fingerprints linked between (or, b None, within) two tiles: fewer than there are rows.

    Rows are sorted by population count, and blocks of rows meet only the rows whose counts are within the radius.
    """
    values = np.unique(a if b is None else np.concatenate([a, b]))
    label = np.arange(len(values))
    left, right = [], []

    def by_count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bitwise_count(x.view(np.uint64)).astype(np.int64)
        order = np.argsort(n, kind="stable")
        return x[order], n[order]

    x, nx = by_count(a)
    y, ny = (x, nx) if b is None else by_count(b)
    at_x, at_y = np.searchsorted(values, x), np.searchsorted(values, y)
    for at in range(0, len(x), 256):
        rows = x[at : at + 256]
        low, high = np.searchsorted(ny, nx[at] - radius, "left"), np.searchsorted(ny, nx[min(at + 255, len(x) - 1)] + radius, "right")
        if low >= high:
            continue
        near = np.bitwise_count(rows.view(np.uint64)[:, None] ^ y[low:high].view(np.uint64)[None, :]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > (b is None)):
            own = label[at_x[at + i]]
            others = np.unique(label[at_y[low:high][near[i]]])
            others = others[others != own]
            if len(others):
                merged = np.append(others, own)
                least = merged.min()
                for o in merged[merged != least]:
                    left.append(values[least])
                    right.append(values[o])
                label[np.isin(label, merged)] = least
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) whose closure joins exactly the fingerprints linked at ``radius`` or fewer bits.

    fps: one long column fp, distinct and stored. Tiles hold about ``tile`` fingerprints each however many share a cell.
    """
    if not blocks:
        blocks = _blocks(fps.count())
    celled = fps.select("fp", _cell(F.col("fp"), blocks).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    spread = celled.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("parts")))
    # Dealt by tile before they are gathered: a crowded cell is many tiles, and its join by cell can be split.
    spread = spread.select("cell", "tile", "fp").repartition("cell", "tile")
    tiles = materialize(spread.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    here = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"))
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(blocks, radius)])
    near = here.withColumn("step", F.explode(steps)).withColumn("cell_b", F.col("cell_a") + F.col("step"))
    there = tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"))
    pairs = near.join(there, "cell_b").filter("step > 0 or tile_a <= tile_b").drop("step")
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"))
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b"))
    work = pairs.join(left, ["cell_a", "tile_a"]).join(right, ["cell_b", "tile_b"])
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("tile_a") == F.col("tile_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y, alike = (batch.column(c)[r] for c in range(3))
                a = x.values.to_numpy(zero_copy_only=False)
                b = None if alike.as_py() else y.values.to_numpy(zero_copy_only=False)
                u, v = forest(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return work.select("fps_a", "fps_b", same.alias("same")).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable, for every node on an edge. Edges (a, b), stored, any order.

    Each round takes the least label among neighbours and then the label's label, so paths halve; every round is
    written to the shared folder. Ends when a round changes nothing.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # A round's tables are as large as the edges, often far below a shuffle's worth of partitions.
    parts = max(1, -(-2 * edges.count() // ROWS_PER_PART))

    def materialize(df: DataFrame, name: str) -> DataFrame:
        return stored(df.coalesce(parts), name)

    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        offers = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        nearer = labels.join(offers, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        nearer = materialize(nearer, "cc-step")
        jump = nearer.select(F.col("node").alias("at"), F.col("label").alias("to"))
        after = materialize(nearer.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "to").alias("label"), (F.least("label", "to") != F.col("old")).alias("moved")), "cc-labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels, nearer)
        labels = after
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(both)
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    fps = materialize(with_fingerprint(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_s_text")), "_s_text").select("doc_id", F.col("_s_fp").alias("fp")), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    labels = components(materialize(links(classes.select("fp"), radius), "simhash-links"))
    joined = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.join(least, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each component stays, columns as in docs: the first by id (null last), fingerprint, text hash and row hash."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_s_text"), F.xxhash64(text).alias("text_hash"), row_hash(docs).alias("digest"))
    fps = materialize(with_fingerprint(rows, "_s_text").select("doc_id", F.col("_s_fp").alias("fp"), "text_hash", "digest"), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_hash", "digest")).alias("first")
    classes = materialize(fps.groupBy("fp").agg(first), "simhash-classes")
    labels = components(materialize(links(classes.select("fp"), radius), "simhash-links"))
    joined = classes.join(labels, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("label", "fp").alias("label"))
    return keep_rows(docs, joined.groupBy("label").agg(F.min("first").alias("first")).select("first.digest"))
