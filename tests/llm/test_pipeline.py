"""The whole pipeline against a plain Python version of it."""

import hashlib
import math
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratum.llm import mixing, quality
from stratum.llm.common import table

from .test_mixing import fill
from .test_quality import grams, stats
from .test_neardup import groups, survivors


def good(docs, labels):
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    assert len(trusted) <= quality.TARGET_ROWS
    n = quality.BUCKETS
    raw, target = [1] * n, [1] * n
    for r in docs:
        for g in grams(r["text"], n):
            raw[g] += 1
            target[g] += r["doc_id"] in trusted
    a, b = math.log(sum(raw)), math.log(sum(target))
    weight = [math.log(t) - b - math.log(x) + a for t, x in zip(target, raw)]
    for r in docs:
        s, g = stats(r["text"]), grams(r["text"], n)
        if s[0] >= 20 and 100 * s[4] <= 30 * s[0] and sum(weight[x] for x in g) / len(g) >= quality.THRESHOLD:
            yield r


def distinct(docs):
    """Five-word shingles, links at a similarity of 0.8: every pair is compared."""
    stay = set(survivors([(r["doc_id"], r["text"]) for r in docs]))
    return [r for r in docs if r["doc_id"] in stay]


def copies(docs):
    names = sorted({r["source"] for r in docs})
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in docs}
    per = [sum(size[r["doc_id"]] for r in docs if r["source"] == s) for s in names]
    out = {}
    for s, total, target in zip(names, per, fill(per, [mixing.WEIGHTS[i % 3] for i in range(len(names))], 3)):
        order = []
        for r in docs:
            if r["source"] == s:
                order.append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        start = 0
        for _, i in sorted(order):
            middle = start + size[i] / 2
            out[i] = min(3, max(0, math.ceil((target - middle) / total)))
            start += size[i]
    return out


def test_pipeline_on_driver_documents(spark):
    d = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mixing", "bpe"]
    docs = [r.asDict() for r in table(spark, d, "documents").collect()]
    left = distinct(list(good(docs, table(spark, d, "labels").collect())))
    expected = {i: n for i, n in copies(left).items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs}
    seen = {}
    for r in corpus_pipeline.run(spark, d).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
    assert seen == expected


def test_stages_keep_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_stages_with_nulls_repeats_and_empty_tables(spark, docs, no_docs):
    """Every stage alone and all in turn: ids and texts may be null or repeated; rows survive or go as a plain version says."""
    d = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, d).count() == 0
    rows = docs.collect()
    first = {}
    for r, g in zip(rows, groups([(r["doc_id"], r["text"]) for r in rows])):
        first.setdefault(g, []).append(r)
    kept = corpus_pipeline.drop_copies(spark, docs, d).collect()
    assert len(kept) == len(first)
    assert sorted(str(r) for r in kept) == sorted(str(r) for r in corpus_pipeline.drop_copies(spark, docs.repartition(5), d).collect())
    for members in first.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        here = [r for r in kept if r in members]
        assert len(here) == 1 and (here[0]["doc_id"] == min(ids) if ids else here[0]["doc_id"] is None)
    left = docs
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, d)
    assert left.count() == len(left.collect())
