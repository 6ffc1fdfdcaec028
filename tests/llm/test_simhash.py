import random

import numpy as np
import xxhash

from stratum.llm import simhash

from .conftest import document_rows


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def closure(values, radius=2):
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


def test_documents(docs, no_docs):
    rows = document_rows()
    fps = [brute(r[1]) for r in rows]
    label = closure(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[label[f]] = min(least.get(label[f], r[0]), r[0])
    expected = sorted(((r[0], f"{f:016x}", least.get(label[f])) for r, f in zip(rows, fps)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_and_components_of_crowded_fingerprints(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(40):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                v ^= 1 << rng.randrange(64)
    values |= {rng.getrandbits(64) for _ in range(300)} | {0, 1, 3, 2**64 - 1}
    signed = {v: int(np.array(v, dtype=np.uint64).view(np.int64)) for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    expected = {}
    for v, root in closure(values).items():
        expected.setdefault(root, set()).add(signed[v])
    expected = {frozenset(g) for g in expected.values() if len(g) > 1}
    for blocks, tile in ((1, 64), (2, 4096), (8, 16)):
        edges = simhash.materialize(simhash.links(fps, tile=tile, blocks=blocks), "t")
        got = {}
        for node, label in simhash.components(edges).collect():
            got.setdefault(label, set()).add(node)
        assert {frozenset(g) for g in got.values()} == expected, (blocks, tile)


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = simhash.materialize(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), "path")
    assert {r["label"] for r in simhash.components(edges).collect()} == {0}


def test_one_of_each_group_stays(docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    expected = sorted({r[2] for r in map(tuple, simhash.near_duplicates(docs).collect()) if r[2] is not None})
    assert got == expected
