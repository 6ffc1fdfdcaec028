import pytest
from pyspark.sql import functions as F

from stratum.llm import mixing

from .conftest import document_rows


def fill(sizes, weights, most):
    """Targets by repeated resharing."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1000, 1, 1, 1, 50], [5, 0, 0, 900, 3], [0, 0], [7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    assert got == pytest.approx(fill(sizes, w, 3))


def test_whole_mix(spark, docs, no_docs):
    rows = document_rows()
    size = {i: len((r[1] or "").encode().split()) for i, r in enumerate(rows)}
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    per = [sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in names]
    goal = dict(zip(names, fill(per, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 3)))
    out = mixing.assign(docs).collect()
    assert len(out) == len(rows) and sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    largest = max(size.values())
    for s in names:
        own = [r for r in out if r["source"] == s]
        assert all(r["target"] == pytest.approx(goal[s]) and r["source_size"] == per[names.index(s)] for r in own)
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= largest
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
    again = mixing.assign(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["taken"], str(r["positions"]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.assign(no_docs).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    """Repeats, nulls and clashing columns; what is taken comes from the copies in order."""
    import duckdb

    from stratum.llm import queries

    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in document_rows() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.01"):
        got = queries.op1_mixing(spark, d)
        path = f"{d}/documents.parquet/*.parquet" if d == str(tmp_path) else f"{d}/documents.parquet"
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
        expected = duckdb.sql(queries.ORACLE_SQL["op1_mixing"])
        assert got.columns == expected.columns
        a, b = (sorted(map(tuple, x), key=str) for x in (got.collect(), expected.fetchall()))
        assert a == b


def test_position_inverts_the_schedule(spark):
    schedule = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))
    shares = [i / 200 for i in range(201)]
    df = spark.createDataFrame([(x,) for x in shares], "x double").select("x", mixing.position(F.col("x"), F.lit(0), [schedule]).alias("t"))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))

    def demand(t):
        done = 0.0
        for (a, u), (b, v) in zip(schedule, schedule[1:]):
            s = min(max(t - a, 0.0), b - a)
            done += u * s + (v - u) / (b - a) * s * s / 2
        return done / area

    for r in df.collect():
        assert demand(r["t"]) == pytest.approx(r["x"], abs=1e-9)


def test_training_order(docs):
    out = mixing.training_order(docs, 3)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} <= {"a", None}
    placed = mixing.assign(docs.drop("size")).withColumn("p", F.explode("positions")).orderBy("p", "doc_id")
    assert [r["doc_id"] for r in out.collect()] == [r["doc_id"] for r in placed.collect()]
