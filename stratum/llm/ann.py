"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (SAMPLE, the smallest by hash) is linked to a neighbour graph, the graph is cut into balanced
parts by recursive bisection (a spectral start, then swaps that lower the cut), and a small softmax classifier learns, for each sampled
vector, the share of its neighbours in each part. The classifier then indexes every row, in its most probable part, and routes a query
to its most probable parts, whose rows are compared exactly in double precision. There are about sqrt(rows) / 2 parts, as far as the
sample has PART_MIN vectors for each; tables of fewer than 2 * PART_MIN rows are one part.

How many parts are probed follows from the data: a tenth of the sample is kept out of the graph, and the fewest probes are taken at
which these find RECALL of their nearest vectors. Vectors that lie in groups need few, directionless noise needs most of the parts.

Parts are dealt out in blocks of rows and blocks of queries, BLOCK bytes and a quarter of them, and every two blocks of a part meet:
a part that holds a third of all rows, or draws a third of all queries, is many bounded tasks. Nothing that grows with the
input reaches the driver.

Defined results: null or zero vectors and vectors with null or non-finite components take no part; shorter vectors than the longest
count as ending in zeros; ties go to the smaller vec_id; repeated rows are candidates of their own, except to queries
of the same vec_id; with fewer candidates than asked for all are returned; an empty table gives no rows. Extra columns leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sampled, ship

SAMPLE = 8192
PART_MIN = 32
RECALL = 0.95
NEIGHBOURS = 10
BLOCK = 32 << 20


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indexes (n, k) of the rows of largest inner product."""
    n, k = len(x), min(k, len(x) - 1)
    out = np.empty((n, k), dtype=np.int64)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Sides (bool) of the nodes: ``share`` of them False; edges a-b, as positions in nodes."""
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    root = np.sqrt(degree)
    v = rng.standard_normal(n)
    for _ in range(60):  # power iteration of the shifted, normalised adjacency, off its first eigenvector
        v -= root * (v @ root) / (root @ root)
        u = v / root
        v = v + (np.bincount(a, u[b], n) + np.bincount(b, u[a], n)) / root
        v /= np.linalg.norm(v) + 1e-30
    left = int(round(n * share))
    side = np.ones(n, dtype=bool)
    side[np.argsort(v / root, kind="stable")[:left]] = False
    for _ in range(20):
        cross = side[a] != side[b]
        gain = np.bincount(a, np.where(cross, 1.0, -1.0), n) + np.bincount(b, np.where(cross, 1.0, -1.0), n)
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        m = min(len(up), len(down))
        good = np.flatnonzero(gain[up[:m]] + gain[down[:m]] > 0)
        if not len(good):
            break
        take = max(1, (good[-1] + 1) // 4)
        after = side.copy()
        after[up[:take]], after[down[:take]] = True, False
        if (after[a] != after[b]).sum() >= cross.sum():
            break
        side = after
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part 0..parts-1 for each node, of nearly equal sizes, few links between them."""
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    out = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(seed)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count == 1:
            out[nodes] = first
            continue
        local = np.full(n, -1)
        local[nodes] = np.arange(len(nodes))
        keep = (local[a] >= 0) & (local[b] >= 0)
        half = count // 2
        side = _bisect(nodes, local[a[keep]], local[b[keep]], half / count, rng)
        todo += [(nodes[~side], first, half), (nodes[side], first + half, count - half)]
    return out


def train_router(x: np.ndarray, shares: np.ndarray, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights (d + 1, parts) of a softmax classifier of the shares, by Adam over the whole sample."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros((x.shape[1], shares.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - shares) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Router:
    """scale, weights, the dimension and the number of probes; a few hundred kB at most."""

    def __init__(self, sample: np.ndarray, parts: int, k: int = 20, recall: float = RECALL):
        self.dim = sample.shape[1]
        self.parts = max(1, min(parts, len(sample) // PART_MIN))
        self.probes = 1
        self.scale = float(np.sqrt((sample**2).mean()) or 1.0)
        if self.parts == 1:
            self.weights = np.zeros((self.dim + 1, 1))
            return
        self.learn(np.delete(sample, np.s_[::10], axis=0))
        self.probes = self.fewest_probes(sample, np.arange(0, len(sample), 10), k, recall)

    def fewest_probes(self, sample: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
        """Probes at which the vectors ``asked`` find ``recall`` of their k nearest of the sample."""
        part = np.argmax(self.scores(sample), axis=1)
        hits = np.zeros(self.parts)
        for at in range(0, len(asked), 256):
            some = asked[at : at + 256]
            s = sample[some] @ sample.T
            s[np.arange(len(some)), some] = -np.inf
            near = part[np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k]]
            rank = np.argsort(np.argsort(-self.scores(sample[some]), axis=1, kind="stable"), axis=1)
            hits += np.bincount(np.take_along_axis(rank, near, axis=1).ravel(), minlength=self.parts)
        return int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall)) + 1

    def learn(self, sample: np.ndarray) -> None:
        graph = neighbour_graph(sample)
        part = balanced_parts(graph, self.parts)
        shares = np.zeros((len(sample), self.parts))
        np.add.at(shares, (np.arange(len(sample)), part), 1.0)
        for k in range(graph.shape[1]):
            np.add.at(shares, (np.arange(len(sample)), part[graph[:, k]]), 1.0)
        self.weights = train_router(sample / self.scale, shares / shares.sum(axis=1, keepdims=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int | None = None, k: int = 20, recall: float = RECALL) -> Router | None:
    """From at most ``sample`` usable vectors of one length, of the smallest by hash of their id; one of each id."""
    rows = sampled(vectors.select("vec_id", "embedding"), "vec_id", sample).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return None
    return Router(np.array([r["embedding"] for r in rows], dtype=np.float64), parts or round(vectors.count() ** 0.5 / 2), k, recall)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(q_id: np.ndarray, q: np.ndarray, r_id: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k rows of largest inner product for each query, own id excluded."""
    q, r = q.astype(np.float64), r.astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, min(256, (4 << 20) // max(1, len(r))))
    for at in range(0, len(q), step):
        part, ids = q[at : at + step], q_id[at : at + step]
        s = part @ r.T
        s[ids[:, None] == r_id[None, :]] = -np.inf
        if s.shape[1] > k:
            floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        else:
            floor = np.full(len(s), -np.inf)
        # Sums in matrix products depend on the place in the matrix: near the floor they are taken again, each alike.
        i, j = np.nonzero((s >= np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)[:, None]) & (s > -np.inf))
        exact = (part[i] * r[j]).sum(axis=1)
        order = np.lexsort((r_id[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        keep = rank < k
        out.append((ids[i[keep]], r_id[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def search(
    vectors: DataFrame, queries: Column, k: int = 20, parts: int | None = None, probes: int | None = None, sample: int = SAMPLE, rows: int | None = None, asks: int | None = None, recall: float = RECALL
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of the k nearest of each row for which ``queries`` holds.

    parts and probes: given, or found as above.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("ask")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = good.agg(F.max(F.size("embedding"))).collect()[0][0]
    if longest is None:
        return empty
    short = F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("embedding"))
    good = good.withColumn("embedding", F.when(F.size("embedding") < longest, F.concat("embedding", short)).otherwise(F.col("embedding")))
    router = fit(good, sample, parts, k, recall)
    dim, probes = router.dim, min(probes or router.probes, router.parts)
    rows = rows or max(256, BLOCK // (8 * dim))
    asks = asks or max(256, BLOCK // (32 * dim))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = router.scores(_matrix(batch.column(1), dim))
                best = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                offsets = np.arange(0, best.size + 1, probes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, best.ravel())], ["vec_id", "embedding", "ask", "parts"])

    indexed = materialize(good.mapInArrow(index, "vec_id long, embedding array<double>, ask boolean, parts array<int>"), "ann-index")
    # One row a part: how many blocks of rows it takes, and how many of the queries routed to it.
    held = {r["part"]: r["n"] for r in indexed.groupBy(F.get("parts", F.lit(0)).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["part"]: r["n"] for r in indexed.filter("ask").select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    row_blocks = F.array(*[F.lit(-(-held.get(p, 0) // rows)) for p in range(router.parts)])
    ask_blocks = F.array(*[F.lit(-(-asked.get(p, 0) // asks)) for p in range(router.parts)])
    salt = F.xxhash64("vec_id", F.lit(1))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    candidates = indexed.select("vec_id", "embedding", F.get("parts", F.lit(0)).alias("part"))
    candidates = candidates.withColumn("block", F.pmod(salt, F.get(row_blocks, F.col("part"))).cast("int"))
    candidates = candidates.withColumn("ask_block", F.explode(upto(F.get(ask_blocks, F.col("part")))))
    asking = indexed.filter("ask").select("vec_id", "embedding", F.explode("parts").alias("part"))
    asking = asking.withColumn("ask_block", F.pmod(salt, F.get(ask_blocks, F.col("part"))).cast("int"))
    asking = asking.withColumn("block", F.explode(upto(F.get(row_blocks, F.col("part")))))
    key = ["part", "block", "ask_block"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q, r = (_matrix(t.column("embedding").combine_chunks(), dim) for t in (left, right))
        out = nearest(left.column("vec_id").to_numpy(), q, right.column("vec_id").to_numpy(), r, k)
        return pa.table([pa.array(c) for c in out], names)

    found = asking.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
