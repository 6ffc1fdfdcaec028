import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import hpylm
from stratum.llm.queries import op6_lm_scores

from .conftest import document_rows

END = None


def folds(rows):
    """(tokens, held out) of each row."""
    return [([w.lower() for w in (r[1] or "").encode().split()] + [END], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2) for r in rows]


def cells_of(model):
    """From the kept state: {(context, word): mean tables} of dishes of two customers or more, and each word's parent customers and tables."""
    tables, parents = {}, {}
    for row in model.state.collect():
        s = hpylm._read_state({k: v for k, v in row.asDict().items() if k != "kept"})
        for x, r, t in zip(s["x"], s["r"], s["sum"]):
            tables[int(s["w"][x]), int(r)] = t / hpylm.SAMPLES
        kept = [hpylm.unpack(b) for b in row["kept"]]
        for i, w in enumerate(s["w"]):
            for k in range(hpylm.SAMPLES):
                parents[int(w), k] = (kept[2 * k][i], kept[2 * k + 1][i])
    for h, w in enumerate(model.hot):
        for k, totals in enumerate(model.samples):
            if totals.hot_customers[h]:
                parents[int(w), k] = (totals.hot_customers[h], totals.hot_tables[h])
    return tables, parents


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_plain_python(spark, docs, no_docs, monkeypatch, small):
    """Counts from the texts, seatings from the model, probabilities and sums in plain Python; small: many buckets, hot words, few restaurants."""
    if small:
        for name, value in (("BUCKET_BYTES", 4000), ("RESTAURANTS", 20)):
            monkeypatch.setattr(hpylm, name, value)
        monkeypatch.setattr(hpylm.frequent, "__defaults__", (20,))
    rows = document_rows()
    split = folds(rows)
    c = Counter(w for ws, h in split if not h for w in ws)
    n, v = sum(c.values()), len(c)
    identity = lambda w: hpylm.END_ID if w is END else hpylm.word_id(w)
    model = hpylm.train(hpylm.split(docs))
    known = {int(w): i for i, w in enumerate(model.known)}
    restaurant = lambda u: known.get(identity(u), len(known) + (identity(u) >> 20) % hpylm.GROUPS)
    pairs, customers = Counter(), Counter()
    for ws, h in split:
        for u, w in zip([END, *ws], ws):
            if not h:
                pairs[restaurant(u), w] += 1
                customers[restaurant(u)] += 1
    tables, parents = cells_of(model)
    first = model.samples[0]

    def log_p(u, w):
        r, x = restaurant(u), identity(w)
        count = pairs[r, w]
        p = max(0.0, (count - first.discount * tables.get((x, r), min(count, 1))) / (1 + customers[r]))
        for k, s in enumerate(model.samples):
            a, t = parents.get((x, k), (0, 0))
            all_tables = s.tables.sum()
            fresh = (1 + s.parent_discount * s.parent_tables) / (v + 1)
            p += (1 + s.discount * s.tables[r]) / (1 + customers[r]) * (a - s.parent_discount * t + fresh) / (1 + all_tables) / len(model.samples)
        return math.log10(p)

    expected = sorted(
        ((r[0], h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(log_p(u, w) for u, w in zip([END, *ws], ws))) for r, (ws, h) in zip(rows, split)),
        key=lambda x: (str(x[:5]), x[5]),
    )
    got = sorted(map(tuple, hpylm.score(hpylm.split(docs), model).collect()), key=lambda x: (str(x[:5]), x[5]))
    for a, b in zip(expected, got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=1e-6)
    assert hpylm.score(hpylm.split(no_docs), hpylm.train(hpylm.split(no_docs))).count() == 0


def test_reruns_agree_and_partitions_do_not_matter(docs):
    run = lambda d: sorted(str((*tuple(r)[:5], round(r[5], 6), round(r[6], 6))) for r in hpylm.score(hpylm.split(d), hpylm.train(hpylm.split(d))).collect())
    assert run(docs) == run(docs.repartition(5))


def test_every_kept_sample_adds_up_to_one(docs):
    """In every restaurant and kept round the vocabulary and the unknown word have probability 1."""
    model = hpylm.train(hpylm.split(docs))
    v = model.vocabulary
    assert len(model.state.collect()) == 1
    s = hpylm._read_state({k: x for k, x in model.state.first().asDict().items() if k != "kept"})
    kept = [hpylm.unpack(b) for b in model.state.first()["kept"]]
    for k, totals in enumerate(model.samples):
        base = totals.parent(*totals.with_hot(s["w"], kept[2 * k], kept[2 * k + 1]))
        assert len(base) == v and base.sum() + totals.parent(0, 0) == pytest.approx(1, abs=1e-6)
    mean_tables = np.mean([t.tables for t in model.samples], axis=0)
    own = np.bincount(s["r"], s["c"] - model.samples[0].discount * s["sum"] / hpylm.SAMPLES, len(mean_tables))
    own += np.bincount(s["sr"], s["st"] * (1 - model.samples[0].discount), len(mean_tables))
    back = np.mean([t.back_off() for t in model.samples], axis=0)
    assert own / (hpylm.STRENGTH + model.samples[0].customers) + back == pytest.approx(np.ones(len(mean_tables)), abs=1e-6)


def one_by_one(c, others, discount, base, sweeps, seed):
    """Mean tables by a plain Gibbs sampler that takes away and reseats every customer of one dish in turn."""
    rng = np.random.default_rng(seed)
    sizes, total, seen = [1] * min(c, 3) + ([c - 3] if c > 3 else []), 0, 0
    seat_of = [i for i, s in enumerate(sizes) for _ in range(s)]
    for sweep in range(sweeps):
        for k in range(c):
            sizes[seat_of[k]] -= 1
            weights = np.array([s - discount if s else 0.0 for s in sizes] + [(1 + discount * (others + sum(s > 0 for s in sizes))) * base])
            at = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
            if at == len(sizes):
                at = sizes.index(0) if 0 in sizes else at
                if at == len(sizes):
                    sizes.append(0)
            sizes[at] += 1
            seat_of[k] = at
        if sweep >= sweeps // 5:
            total, seen = total + sum(s > 0 for s in sizes), seen + 1
    return total / seen


@pytest.mark.parametrize(("c", "others", "base"), [(2, 50, 0.02), (5, 50, 0.05), (10, 400, 0.01), (50, 1000, 0.01), (200, 3000, 0.004)])
def test_tables_follow_the_law_of_a_plain_sampler(c, others, base):
    d = 0.7
    drawn = hpylm.draw_tables(np.full(4000, c), np.ones(4000), hpylm.Openings(1.0, d, np.full(4000, float(others)), base), np.random.default_rng(1))
    brute = np.mean([one_by_one(c, others, d, base, 8000 // c + 150, s) for s in range(3)])
    assert drawn.mean() == pytest.approx(brute, rel=0.06)


@pytest.mark.parametrize("others", [100, 2000, 20_000])
def test_large_dishes_follow_the_exact_law(others):
    """Above CUT customers the moves reach the mean of the law with exact Stirling numbers."""
    c, d, base = 1500, 0.7, 0.02
    stirling = hpylm.log_stirling(d, c)[c, 1:]
    weights = hpylm.Openings(1.0, d, np.full(3000, float(others)), base)
    p = np.cumsum(weights.each(np.array([0]), np.arange(c, dtype=np.float64)[None, :])[0]) + stirling
    p = np.exp(p - p.max())
    mean = (p * np.arange(1, c + 1)).sum() / p.sum()
    assert weights.upto(np.array([0]), np.array([7.0]))[0] == pytest.approx(weights.each(np.array([0]), np.arange(7.0)[None, :]).sum())
    t = np.ones(3000)
    for round_ in range(4):
        t = hpylm.draw_tables(np.full(3000, c), t, weights, np.random.default_rng(round_))
    assert t.mean() == pytest.approx(mean, rel=0.04)


def test_weights_with_a_parent_add_up_alike():
    of = lambda c: hpylm.Openings(1.0, 0.6, np.array([9.0]), None, np.array([c]), np.array([min(c, 2.0)]), 0.01, 0.4, np.array([50.0]))
    for c in (0.0, 1.0, 7.0):
        assert of(c).upto(np.array([0]), np.array([6.0]))[0] == pytest.approx(of(c).each(np.array([0]), np.arange(6.0)[None, :]).sum())


def test_flushes_and_pieces_of_long_texts_lose_nothing(monkeypatch):
    monkeypatch.setattr(hpylm, "FLUSH", 500)
    monkeypatch.setattr(hpylm, "PIECE", 200)
    rows = document_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows]), pa.array([i % 3 > 0 for i in range(len(rows))]), pa.array(range(len(rows)), pa.int64())], ["text", "train", "key"])
    expected, got, cells = Counter(), Counter(), Counter()
    for i, (ws, _) in enumerate(folds(rows)):
        for u, w in zip([END, *ws], ws):
            u, w = (hpylm.END_ID if x is END else hpylm.word_id(x) for x in (u, w))
            expected[u, w, i] += 1
    count = 0
    for ids, tokens, contexts, doc, keys, train in hpylm.flushes(iter([batch]), False):
        got.update(zip(ids[contexts].tolist(), ids[tokens].tolist(), keys[doc].tolist()))
        assert (train[doc] == (keys[doc] % 3 > 0)).all() and len(tokens) <= 700
        count += 1
    assert got == expected and count > 10
    hot = np.array([hpylm.END_ID])
    for b in hpylm.pack_cells(iter([batch]), hot, 7):
        t = pa.Table.from_batches([b])
        w, x, u, ux, n = hpylm.merge_cells(t)
        assert (hpylm.bucket_of(w[x], u[ux], hot, 7) == t.column("bucket")[0].as_py()).all()
        cells.update({(int(a), int(b)): int(k) for a, b, k in zip(u[ux], w[x], n)})
    expected_cells = Counter()
    for (u, w, i), k in expected.items():
        if i % 3:
            expected_cells[u, w] += k
    assert cells == expected_cells


def test_packing():
    for a in ([], [0], [255, 256], [1 << 56, 3], [0.5, -1.25]):
        a = np.array(a, dtype=np.float64 if a and isinstance(a[0], float) else np.int64)
        assert (hpylm.unpack(hpylm.pack(a)) == a).all()


def absolute_discounting(split, discount=0.7):
    """Held-out perplexity of a bigram model with one table a dish over add-one unigrams."""
    word, pairs, customers, follows = Counter(), Counter(), Counter(), defaultdict(set)
    for ws, h in split:
        if not h:
            for u, w in zip([END, *ws], ws):
                word[w] += 1
                pairs[u, w] += 1
                customers[u] += 1
                follows[u].add(w)
    n, v, total, tokens = sum(word.values()), len(word), 0.0, 0
    for ws, h in split:
        if h:
            for u, w in zip([END, *ws], ws):
                base = (word[w] + 1) / (n + v + 1)
                p = (max(pairs[u, w] - discount, 0) + discount * len(follows[u]) * base) / customers[u] if customers[u] else base
                total, tokens = total + math.log10(p), tokens + 1
    return 10 ** (-total / tokens)


def test_held_out_perplexity(spark):
    """Below the unigram base by far, and below absolute discounting."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = hpylm.split(rows)
    r = {x["held_out"]: x for x in hpylm.perplexity(hpylm.score(docs, hpylm.train(docs))).collect()}
    other = absolute_discounting(folds([(x["doc_id"], x["text"]) for x in rows.select("doc_id", "text").collect()]))
    print(r, other)
    assert r[True]["perplexity"] < 0.7 * r[True]["base_perplexity"]
    assert r[True]["perplexity"] < 0.97 * other


@pytest.mark.parametrize("bucket_bytes", [4000, 1 << 30])
def test_every_context_has_its_own_restaurant(spark, docs, tmp_path, monkeypatch, bucket_bytes):
    """The query scores alike, whether 20 contexts or all are broadcast, and rare contexts do not share what they have seen."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", bucket_bytes)
    run = lambda: sorted(map(tuple, op6_lm_scores(spark, str(tmp_path)).collect()), key=lambda r: (str(r[:5]), r[5], r[6]))
    every = run()
    monkeypatch.setattr(hpylm.frequent, "__defaults__", (20,))
    some = run()
    assert len(every) == docs.count()
    for a, b in zip(every, some, strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], rel=1e-9)
    monkeypatch.setattr(hpylm.frequent, "__defaults__", (0,))
    for a, b in zip(every, run(), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], rel=1e-9)


def test_totals_of_rare_contexts_are_those_of_all_buckets(docs, monkeypatch):
    """Customers and tables of each context, from the blocks, against the texts and the state."""
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(hpylm.frequent, "__defaults__", (5,))
    model = hpylm.train(hpylm.split(docs), pooled=False)
    pairs = Counter()
    for ws, h in folds(document_rows()):
        if not h:
            pairs.update((hpylm.END_ID if u is END else hpylm.word_id(u), hpylm.END_ID if w is END else hpylm.word_id(w)) for u, w in zip([END, *ws], ws))
    assert len(model.known) == 5 and len({u for u, _ in pairs}) > 100 and model.blocks > 1
    assert model.samples[-1].customers.sum() == sum(n for (u, _), n in pairs.items() if u in set(model.known.tolist()))
    size, once, several, tables, told = len(model.known) + hpylm.GROUPS, Counter(), defaultdict(set), Counter(), {}
    rows = model.state.collect()
    for row in rows:
        s = hpylm._read_state({k: v for k, v in row.asDict().items() if k not in ("kept", "seats")})
        for x, r, c, t in zip(s["x"], s["r"], s["c"], s["t"]):
            u = int(s["rare"][r - size] if r >= size else model.known[r])
            assert pairs[u, int(s["w"][x])] == c > 1 and 1 <= t <= c
            if r >= size:
                several[u].add(row["bucket"])
                tables[u] += t
        told[row["bucket"]] = s
    once.update(u for (u, _), n in pairs.items() if n == 1)
    apart = 0
    for bucket, s in told.items():
        for u, fixed, a in zip(s["rare"].tolist(), s["fixed"], s["apart"]):
            assert fixed == once[u] and a == (len(several[u]) > 1)
            apart += a
    assert apart > 20
    rare_once = sum(n for u, n in once.items() if u not in set(model.known.tolist()))
    assert model.samples[-1].parent_customers == model.samples[-1].tables.sum() + sum(tables.values()) + rare_once
