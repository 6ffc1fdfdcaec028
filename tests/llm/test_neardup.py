"""The near-dedup stage against a comparison of every pair."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import neardup, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Component of each row: every two rows that share a shingle are compared."""
    sets, holders, label = [grams(r[1]) for r in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s or {()}:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def survivors(rows):
    first = {}
    for r, g in zip(rows, groups(rows)):
        first[g] = min(first.get(g, r[0]), r[0])
    return sorted(first.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stage_against_every_pair(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = survivors(rows)
    got = sorted(r[0] for r in corpus_pipeline.drop_copies(spark, docs, d).select("doc_id").collect())
    assert len(got) == len(set(got)) and len(set(want) ^ set(got)) <= 0.001 * len(want)


def test_near_copies_that_fingerprints_miss(spark, monkeypatch):
    """Every similarity of 0.8 to 1 counts, also within a group of several tiles; less does not."""
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for change in range(1 + family % 5 * 10):
            w = list(base)
            for at in rng.choice(200, 3, replace=False) if change else ():
                w[at] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base[:120])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    assert 30 < len(want) < len(rows) // 3
    assert sorted(r[0] for r in neardup.deduplicate(docs).select("doc_id").collect()) == want


def test_one_row_of_each_component(spark):
    rows = [(None, "a b c d e f"), (1, "A b  c d e f"), (None, "only here twice"), (None, "only here twice"), (2, "one text of many words"), (2, "another one that differs"), (3, ""), (4, None), (5, " ")]
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5], rows[6]]))
    assert neardup.deduplicate(got.filter(F.lit(False))).count() == 0


def test_one_row_of_each_fingerprint_group(spark):
    """Copies without an id go with those that have one, one stays where none has, and a repeated id does not drop another text."""
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "only here twice"), (None, "only here twice"), (2, "one text of many words"), (2, "another one that differs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(str, map(tuple, simhash.deduplicate(docs).collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))


def test_group_of_several_tiles_and_components(spark, monkeypatch):
    """A chain whose texts are like their neighbours only, two crowds that share keys but are not similar, and a bridge."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "FAN", 2)
    rng = np.random.default_rng(5)
    rows, w = [], [f"w{x}" for x in range(200)]
    for at in range(60):  # 16 of 200 words differ from the text before: 184 of 212 shingles at least are shared
        w[at * 16 % 192 : at * 16 % 192 + 16] = [f"c{at}-{i}" for i in range(16)]
        rows.append((len(rows), " ".join(w)))
    first = [f"a{x}" for x in range(300)]
    second = first[:210] + [f"b{x}" for x in range(90)]
    for base in (first, second):
        for _ in range(50):
            text = list(base)
            text[int(rng.integers(300))] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    assert want == [0, 60, 110]
    assert sorted(r[0] for r in neardup.deduplicate(docs).select("doc_id").collect()) == want
    bridge = first[:255] + second[255:]
    rows += [(len(rows), " ".join(bridge))]
    want = survivors(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r[0] for r in neardup.deduplicate(docs).select("doc_id").collect()) == want


def test_crowd_of_near_copies_meets_one_tile(spark, monkeypatch):
    """The work on near copies of one text is one comparison a tile, whatever their number."""
    monkeypatch.setattr(neardup, "TILE", 8)
    met, compared = [], neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda work: met.append(work.count()) or compared(work))
    base = [f"a{x}" for x in range(200)]
    rows = [(i, " ".join(base[:100] + [f"n{i}"] + base[100:])) for i in range(400)]
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert [r[0] for r in got] == [0]
    assert met[0] <= 51 and sum(met[1:]) == 0


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Texts that share no key are compared if their fingerprints are near or equal: here no node has any key."""
    base = [f"a{x}" for x in range(3000)]
    rows = [(i, " ".join([*base[:1000], f"n{i}", *base[1000:]])) for i in range(40)] + [(100 + i, " ".join(f"o{i}-{x}" for x in range(300))) for i in range(20)]
    far = [bin(a ^ b).count("1") for a, b in zip(*([neardup.fingerprint(neardup.shingles(neardup.lowered(t))) & (1 << 64) - 1 for _, t in part] for part in (rows[:39], rows[1:40])))]
    assert max(far) > 0 and sorted(far)[20] <= neardup.RADIUS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = neardup._marked
    monkeypatch.setattr(neardup, "_marked", lambda *a: marked(*a).withColumn("keys", F.array().cast("array<bigint>")))
    assert sorted(r[0] for r in neardup.deduplicate(docs).select("doc_id").collect()) == survivors(rows) == [0, *range(100, 120)]


def test_candidates_of_keys_are_near_a_forest(spark):
    """Nodes that share all of their keys, or each key with others, have about one edge each, of the same closure."""
    rng = np.random.default_rng(7)
    nodes = [int(x) for x in rng.integers(0, 1 << 60, 600)]
    keys_of = [[int(b * 1000 + (i // 300) * 100 + rng.integers(4)) for b in range(20)] for i in range(600)]
    got = neardup._by_keys(spark.createDataFrame(list(zip(nodes, keys_of)), "node long, keys array<long>")).collect()
    assert len(got) <= 700
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in got:
        label[find(a)] = find(b)
    assert len({find(x) for x in nodes[:300]}) == len({find(x) for x in nodes[300:]}) == 1 and len({find(x) for x in nodes}) == 2
