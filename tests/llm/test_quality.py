import math
import struct

import xxhash

from stratum.llm import quality

from .conftest import document_rows


def stats(text):
    text = text or ""
    w = text.encode().split()
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % buckets for x in h + pairs]


def test_against_brute_force(docs, labels, no_docs):
    buckets, rows = 97, document_rows()
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"] and r["doc_id"] is not None}
    raw, good = [1] * buckets, [1] * buckets
    for r in rows:
        for g in grams(r[1], buckets):
            raw[g] += 1
            good[g] += r[0] in trusted
    weight = [math.log(good[b] / sum(good)) - math.log(raw[b] / sum(raw)) for b in range(buckets)]
    expected = []
    for r in rows:
        s, g = stats(r[1]), grams(r[1], buckets)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        expected.append((r[0], *s, failed, sum(weight[x] for x in g) / len(g) if g else 0.0))
    out = quality.quality(docs, labels, buckets=buckets)
    got = [(r["doc_id"], *(r[c] for c in quality.STATS), r["base_failed"], r["llr"]) for r in out.collect()]
    key = lambda r: (str(r[:7]), r[7])
    for a, b in zip(sorted(expected, key=key), sorted(got, key=key), strict=True):
        assert a[:7] == b[:7]
        assert abs(a[7] - b[7]) < 1e-9
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD) for r in out.collect())
    assert quality.quality(no_docs, labels).count() == 0


def test_without_trusted_documents_the_base_rules_decide(docs, labels):
    for r in quality.quality(docs, labels.filter("false")).collect():
        assert r["llr"] == 0 and r["kept"] == (not r["base_failed"])


def test_filter_keeps_columns(docs, labels):
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in quality.quality(docs.drop("kept"), labels).filter("kept").collect())


def test_no_python_in_the_plan(docs, labels):
    plan = quality.quality(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_trusted_documents_are_told_from_noise(spark):
    """Held-out accuracy on the driver's labelled documents."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    fit, rest = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), fit).join(rest, "doc_id")
    rows = judged.groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n[0, False] / (n[0, False] + n[0, True]) > 0.9
    base = judged.filter("quality = 1 and not base_failed").groupBy("kept").count().collect()
    n = {r["kept"]: r["count"] for r in base}
    assert n[True] / sum(n.values()) > 0.98
