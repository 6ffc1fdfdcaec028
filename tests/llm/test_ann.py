import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import ann


def brute(ids, x, asks, k):
    out = {}
    for a in asks:
        s = (x * x[a]).sum(axis=1)
        order = np.lexsort((ids, -s))
        out[int(ids[a])] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != ids[a]][:k]
    return out


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    n = 60
    x = rng.standard_normal((n, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, [float(v) for v in x[i]], 0, "a", "b") for i in range(n)]
    bad = [(300, None), (320, [0.0] * 8), (340, [1.0] * 7 + [float("nan")]), (360, [1.0] * 7 + [None]), (380, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + [(i, v, 0, "a", "b") for i, v in bad], "vec_id long, embedding array<float>, label int, parts string, ask string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    ids = np.arange(n)
    expected = brute(ids, x.astype(np.float64), range(0, n, 20), 20)
    assert got.keys() == expected.keys()
    for q, near in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id long, embedding array<double>")
    whole, cut = (sorted(map(tuple, ann.search(df, F.col("vec_id") % 3 == 0, parts=2, probes=1, **o).collect())) for o in ({}, {"rows": 50, "asks": 30}))
    assert whole == cut


def test_vectors_in_groups_need_few_probes(spark):
    """Learned parts and calibrated probes on vectors that lie in groups: a recall over 0.9 from less than half of the rows."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 32))
    x = centers[rng.integers(0, 40, 6000)] + 0.35 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = ann.Router(x[:3000], 24)
    part = router.scores(x).argmax(axis=1)
    sizes = np.bincount(part, minlength=router.parts)
    assert router.parts == 24 and router.probes <= 8 and sizes.max() < 4 * 6000 / 24
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<double>")
    assert recall(df, x, np.arange(6000), parts=24, sample=3000) >= 0.9


def recall(df, x, ids, **options):
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(ids, x, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    assert got.keys() == want.keys()
    return np.mean([len(got[q] & {i for i, _ in near}) / len(near) for q, near in want.items()])


def test_shorter_vectors_end_in_zeros(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 6))
    x[::7, 4:] = 0
    rows = [(i, [float(v) for v in x[i][: 4 if i % 7 == 0 else 6]]) for i in range(120)]
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x, np.arange(120)) == 1


def test_balanced_parts():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((150, 4)) + 8 * np.eye(4)[i] for i in range(4)])
    part = ann.balanced_parts(ann.neighbour_graph(x, 8), 4)
    assert sorted(np.bincount(part)) == [150] * 4
    assert all(np.bincount(part[i * 150 : i * 150 + 150]).max() > 140 for i in range(4))


def test_samples_are_bounded(spark):
    from stratum.llm.common import sampled

    rows = spark.range(20_000).select(F.col("id").alias("vec_id"))
    once = {r["vec_id"] for r in sampled(rows, "vec_id", 2000).collect()}
    assert 1700 < len(once) <= 2000 and once == {r["vec_id"] for r in sampled(rows.repartition(7), "vec_id", 2000).collect()}
    assert sampled(rows, "vec_id", 20_000).count() == 20_000
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 4))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1500)] + [(7, [1.0, 0.0, 0.0, 0.0])] * 500, "vec_id long, embedding array<double>")
    assert ann.search(df, F.col("vec_id") == 3, sample=600).count() == 20


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "check_s"])
def test_recall_as_shipped(spark, sf):
    """All parameters as they are: parts are skipped at every size, and enough is found."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    router = ann.fit(df.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    assert router.parts > router.probes
    found = recall(df, x, ids)
    print(f"{sf}: parts {router.parts}, probes {router.probes}, recall {found:.4f}")
    assert found >= 0.9
