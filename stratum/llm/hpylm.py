"""Language-model scores: a hierarchical Pitman-Yor bigram model with Chinese-restaurant seating sampled by Gibbs.

Restaurants. The context of a token is the word before it, or the end mark of the text before at the start of one. Every context has
a restaurant of its own, whatever their number; that of a context without training tokens is empty, and leaves all to the parent.
All restaurants share one parent, the unigram restaurant, whose base is uniform over the vocabulary
and one unknown word. Every training token is a customer; every word seen in a context is a dish there, and all dishes are kept.
RESTAURANTS bounds only what is broadcast: the totals of that many most frequent contexts go to all tasks, those of the others (rare
ones) to the buckets that hold their dishes, by shuffles. Both ways seat and score alike, number for number.
With pooled=True (not what the query does) rare and unseen contexts share GROUPS restaurants by bits of their hash instead.

Data. Each task reads its texts once and packs the distinct (word, context) cells of some millions of tokens into one block a
bucket of words; a shuffle by bucket adds the blocks up. Words too frequent for a bucket are dealt by their context's group as well.

Training. In a round every dish of every restaurant has all its customers seated anew: the number of their tables is drawn from its
exact law given the number of customers, the tables of the restaurant's other dishes and the parent (weights S(c, t) times the product
of the weights of t new tables; S: generalised Stirling numbers). Then the parent's dishes, whose customers those tables are, follow alike.
A dish of one customer has one table. So the tables of a rare context's other dishes are asked for only if two buckets have dishes of it with
two customers or more; its dishes of one customer are counted once.
Seatings go on from round to round; the totals of the restaurants are summed after each one. SAMPLES rounds after BURN_IN are kept,
each with its own totals, so a kept sample's probabilities add up to one; predictive probabilities are averaged over them.

Above CUT customers the law's Stirling factor is taken from its limit in t / c^discount, interpolated from CUT customers, and the
number of tables moves by MOVES Metropolis steps a round.

Scoring. All tokens, packed with their documents, meet the final state of their bucket in a second shuffle; each bucket returns
its share of each document's sums. Tokens after rare contexts go on, with what their bucket knows of the word, to a block that holds all of
their context's cells, which is where its totals are added up. A word is identified by 56 bits of its XXH64.

Defined results: null and empty texts are their end token alone; a null doc_id belongs to training; repeated rows count as often as
they appear; an empty table gives no rows; without training tokens every known count is 0. Extra columns leave.
"""

from __future__ import annotations

import gc
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sampled, ship, words

FOLDS, HELD_OUT = 7, 2
STRENGTH = 1.0
BURN_IN, SAMPLES = 3, 3
CUT, MOVES = 512, 24
#: Contexts whose totals are broadcast; results do not depend on it.
RESTAURANTS = 1 << 18
GROUPS = 1024
#: Bytes of text for each bucket, tokens of a flush and of a piece of a long text, documents of a flush.
BUCKET_BYTES = 12 << 20
FLUSH, PIECE, FLUSH_DOCS = 1_500_000, 1_000_000, 1 << 19
#: Documents that the balance of buckets is judged from; results do not depend on it.
BALANCE_DOCS = 20_000
SEED = 42
#: No hash has more than 56 bits.
END_ID = 1 << 56


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def word_id(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 8


def pack(a: np.ndarray) -> bytes:
    """Non-negative whole numbers or doubles in few bytes: smallest width, byte planes apart, zstd."""
    a = np.ascontiguousarray(a)
    if a.dtype.kind == "f":
        size, kind, a = 8, 1, a.astype("<f8")
    else:
        top = int(a.max()) if len(a) else 0
        size, kind = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s)), 0
        a = a.astype(f"<u{size}")
    raw = a.view(np.uint8).reshape(-1, size).T.tobytes()
    return struct.pack("<BBQ", size, kind, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    size, kind, n = struct.unpack_from("<BBQ", b)
    raw = np.frombuffer(pa.decompress(b[10:], n, codec="zstd", asbytes=True) if n else b"", dtype=np.uint8)
    flat = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1)
    return flat.view("<f8") if kind else flat.view(f"<u{size}").astype(np.int64)


class _Local(dict):
    """Word to its number in this flush; the end mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def group_of(u: np.ndarray) -> np.ndarray:
    return u >> 20 & (GROUPS - 1)


def bucket_of(w: np.ndarray, u: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By word, and by the context's group too where the word is hot (ids, ascending): a dish is never in two buckets."""
    at = np.searchsorted(hot, w) if len(hot) else np.zeros(len(w), dtype=np.int64)
    frequent = hot[np.minimum(at, len(hot) - 1)] == w if len(hot) else np.zeros(len(w), dtype=bool)
    return (np.where(frequent, _mix(_mix(w) ^ group_of(u).astype(np.uint64)), _mix(w)) % np.uint64(buckets)).astype(np.int64)


def block_of(u: np.ndarray, blocks: int) -> np.ndarray:
    """The block of rare contexts."""
    return (_mix(_mix(u)) % np.uint64(blocks)).astype(np.int64)


def flushes(batches: Iterator[pa.RecordBatch], only_train: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids by local number, token numbers, context numbers, document numbers, document keys, train flags) of some millions of
    tokens at a time. Batches have text, train and key."""
    local, tokens, contexts, owner, keys, train, total = _Local(), [], [], [], [], [], 0

    def flush():
        import xxhash

        ids = np.fromiter((END_ID, *(xxhash.xxh64_intdigest(w) >> 8 for w in local)), dtype=np.int64, count=len(local) + 1)
        out = ids, np.concatenate(tokens), np.concatenate(contexts), np.repeat(np.arange(len(keys), dtype=np.int32), owner), np.array(keys, dtype=np.int64), np.array(train)
        for held in (local, tokens, contexts, owner, keys, train):
            held.clear()
        return out

    for batch in batches:
        for text, is_train, key in zip(*(batch.column(i) for i in range(3))):
            is_train = is_train.as_py()
            if only_train and not is_train:
                continue
            w = text.as_py().encode("utf-8", "surrogatepass").lower().split()
            before = None
            for at in range(0, len(w) + 1, PIECE):
                part = w[at : at + PIECE]
                if tokens and (total + len(part) > FLUSH or len(keys) >= FLUSH_DOCS):
                    yield flush()
                    total = 0
                n = len(part) + (at + PIECE > len(w))
                ids = np.zeros(n, dtype=np.int32)
                ids[: len(part)] = np.fromiter(map(local.__getitem__, part), dtype=np.int32, count=len(part))
                context = np.empty(n, dtype=np.int32)
                context[0] = local[before] if before is not None else 0
                context[1:] = ids[:-1]
                before = part[-1] if part else before
                tokens.append(ids)
                contexts.append(context)
                owner.append(n)
                keys.append(key.as_py())
                train.append(is_train)
                total += n
    if tokens:
        yield flush()


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)


def _sum_at(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, dtype=values.dtype)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in their order)."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    edges = np.append(_runs(bucket[order]), len(order))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[a]]), order[a:b]


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _coded_small(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of numbers below size, without a sort unless they are few."""
    if size > 16 * len(values):
        return _coded(values)
    there = np.zeros(size, dtype=bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[values]


def _coded_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of ascending numbers."""
    starts = _runs(values)
    return values[starts], np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(values))))


def pack_cells(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, w, wx, u, ux, n): words, contexts and counts of the training cells of a flush."""
    for ids, tokens, contexts, *_ in flushes(batches, True):
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[by_id] = np.arange(len(ids))
        ids = ids[by_id]
        key = rank[tokens] << 32
        key |= rank[contexts]
        del tokens, contexts, rank
        key.sort()
        starts = _runs(key)
        n = np.diff(np.append(starts, len(key))).astype(np.int32)
        w, u = (key[starts] >> 32).astype(np.int32), (key[starts] & 0xFFFFFFFF).astype(np.int32)
        del key, starts
        for b, at in _slices(bucket_of(ids[w], ids[u], hot, buckets)):
            (x, wx), (y, uy) = _coded_sorted(w[at]), _coded_small(u[at], len(ids))
            row = [ids[x], wx, ids[y], uy, n[at]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([pack(v)], pa.binary()) for v in row)], ["bucket", "w", "wx", "u", "ux", "n"])


def pack_postings(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int, known: np.ndarray, pooled: bool = True) -> Iterator[pa.RecordBatch]:
    """(bucket, w, wx, r, us, docs, dx, train, n): all tokens with their restaurants and documents; known: the ids of restaurants.

    us: ids of the rare contexts, ascending, whose numbers in r follow those of the others.
    """
    size = len(known) + GROUPS
    for ids, tokens, contexts, doc, keys, train in flushes(batches, False):  # most memory is held here
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[by_id] = np.arange(len(ids))
        key = rank[tokens] << 22
        key |= rank[contexts]
        key <<= 19
        key |= doc
        key.sort()
        starts = _runs(key)
        n = np.diff(np.append(starts, len(key))).astype(np.int32)
        key = key[starts]
        ids = ids[by_id]
        w, u, doc = (key >> 41).astype(np.int32), (key >> 19 & 0x3FFFFF).astype(np.int32), (key & 0x7FFFF).astype(np.int32)
        del tokens, contexts, rank, key, starts
        restaurant = restaurants(ids, known, pooled)
        for b, at in _slices(bucket_of(ids[w], ids[u], hot, buckets)):
            (x, wx), (d, dx) = _coded_sorted(w[at]), _coded_small(doc[at], len(keys))
            r = restaurant[u[at]]
            rare = r < 0
            y, uy = _coded(u[at][rare])
            r[rare] = size + uy
            row = [ids[x], wx, r, ids[y], keys[d].view(np.uint64), dx, train[d].astype(np.int64), n[at]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([pack(v)], pa.binary()) for v in row)], ["bucket", "w", "wx", "r", "us", "docs", "dx", "train", "n"])


def restaurants(u: np.ndarray, known: np.ndarray, pooled: bool = True) -> np.ndarray:
    """The restaurant of each context: its place in known (ascending); for all others -1, or one of GROUPS after them if pooled."""
    shared = len(known) + group_of(u) if pooled else np.full(len(u), -1, dtype=np.int64)
    if not len(known):
        return shared
    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
    return np.where(known[at] == u, at, shared)


def merge_cells(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(words, word of each cell, contexts, context of each cell, count) from the rows of a bucket."""
    of = lambda name: [unpack(b.as_py()) for b in rows.column(name)]
    ws, wxs, us, uxs, ns = (of(name) for name in ("w", "wx", "u", "ux", "n"))
    w, u = np.unique(np.concatenate(ws)), np.unique(np.concatenate(us))
    key = np.concatenate([np.searchsorted(w, a)[i] * len(u) + np.searchsorted(u, b)[j] for a, i, b, j in zip(ws, wxs, us, uxs)])
    n = np.concatenate(ns)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = _runs(key)
    return w, key[starts] // len(u), u, key[starts] % len(u), _sum_at(n, starts)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        low = y < 7
        if not low.any():
            break
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - shift


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = CUT) -> np.ndarray:
    """log S(c, t) for c, t up to ``most``: the number of ways, by weight, to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - t * discount, 0)) + out[c, 1:])
    return out


def _limit(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """What log S is without its factor in t / c^discount."""
    return lgamma(c - discount) - lgamma(np.array(1 - discount)) - lgamma(t) - (t - 1) * math.log(discount)


def log_stirling_large(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    at = np.arange(1, CUT + 1, dtype=np.float64)
    factor = log_stirling(discount)[CUT, 1:] - _limit(np.full(CUT, float(CUT)), at, discount)
    place = 1 + (t - 1) * (CUT / c) ** discount
    return np.where((t <= c) & (place <= CUT), _limit(c, t, discount) + np.interp(place, at, factor), -np.inf)


class Openings:
    """Weights of new tables of some dishes, the j-th after j have opened: (strength + discount * (others + j)) * base_j.

    others: tables of the restaurant's other dishes. base_j is a constant, or the parent's probability of the dish, which has
    ``customers`` there from other restaurants, at ``tables`` tables, and gets one more with each table opened here.
    """

    def __init__(self, strength: float, discount: float, others: np.ndarray, base: float | None = None, customers: np.ndarray | None = None, tables: np.ndarray | None = None, fresh: float = 0.0, parent_discount: float = 0.0, all_customers: np.ndarray | float = 0.0):
        self.strength, self.discount, self.others, self.base = strength, discount, others, base
        self.customers, self.tables, self.fresh, self.parent_discount, self.all_customers = customers, tables, fresh, parent_discount, all_customers

    def first(self) -> np.ndarray:
        return np.exp(self.each(np.arange(len(self.others)), np.zeros((1, 1)))[:, 0])

    def each(self, rows: np.ndarray, j: np.ndarray) -> np.ndarray:
        """log weights, rows by j (1, n)."""
        out = np.log(self.strength + self.discount * (self.others[rows, None] + j))
        if self.base is not None:
            return out + math.log(self.base)
        c = self.customers[rows, None]
        held = np.maximum(np.minimum(self.tables[rows, None], c), (c + j > 0).astype(np.float64) * (c == 0))
        held = np.where((c == 0) & (j == 0), 0.0, held)
        return out + np.log((c + j - self.parent_discount * held + self.fresh) / (self.all_customers[rows, None] + j))

    def upto(self, rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Sums of the log weights of the first t tables."""
        z = self.strength / self.discount + self.others[rows]
        out = t * math.log(self.discount) + lgamma(z + t) - lgamma(z)
        if self.base is not None:
            return out + t * math.log(self.base)
        c, y = self.customers[rows], self.all_customers[rows]
        x = np.where(c > 0, c - self.parent_discount * np.minimum(self.tables[rows], c) + self.fresh, 1 - self.parent_discount + self.fresh)
        own = np.where(c > 0, lgamma(x + t) - lgamma(x), math.log(self.fresh) + lgamma(np.maximum(x + t - 1, 1e-9)) - lgamma(x))
        return out + own - lgamma(y + t) + lgamma(y)


def draw_tables(c: np.ndarray, t: np.ndarray, weights: Openings, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with c customers each, drawn from their law; t: those before (used above CUT only)."""
    out = np.minimum(c, 1).astype(np.int64)
    d = weights.discount
    stirling = log_stirling(d)
    small = np.flatnonzero((c > 1) & (c <= CUT))
    small = small[np.argsort(c[small], kind="stable")]
    edges = np.append(_runs(c[small]), len(small))
    for a, b in zip(edges[:-1], edges[1:]):
        n = int(c[small[a]])
        step = max(1, (1 << 20) // n)
        j = np.arange(n, dtype=np.float64)[None, :]
        for at in range(a, b, step):
            rows = small[at : min(b, at + step)]
            p = np.cumsum(weights.each(rows, j), axis=1) + stirling[n, 1 : n + 1]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (p < (rng.random(len(rows)) * p[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(c > CUT)
    if len(large):
        n = c[large].astype(np.float64)
        # The step follows from the law, not from the state, so that every move is symmetric.
        typical = np.minimum(1 + weights.first()[large] / d, n**d)
        step = np.maximum(1.0, np.sqrt(typical))
        now = np.where(t[large] > 1, t[large], np.maximum(1, np.rint(typical))).astype(np.float64)
        law = lambda x: weights.upto(large, x) + log_stirling_large(n, x, d)
        here = law(now)
        for _ in range(MOVES):
            to = now + np.rint(rng.standard_normal(len(large)) * step)
            there = np.where(to >= 1, law(np.maximum(to, 1)), -np.inf)
            take = np.log(rng.random(len(large))) < there - here
            now, here = np.where(take, to, now), np.where(take, there, here)
        out[large] = now.astype(np.int64)
    return out


class Totals:
    """What all buckets share: numbers by restaurant (RESTAURANTS + GROUPS at most), all tables of rare contexts, and numbers of the hot words."""

    def __init__(self, customers, tables, rare_tables, parent_tables, vocabulary, discount, parent_discount, hot, hot_customers, hot_tables):
        self.customers, self.tables = customers, tables
        self.parent_customers, self.parent_tables = float(tables.sum() + rare_tables), float(parent_tables)
        self.vocabulary, self.discount, self.parent_discount = vocabulary, discount, parent_discount
        self.hot, self.hot_customers, self.hot_tables = hot, hot_customers, hot_tables

    def fresh(self) -> float:
        """Weight of a new table in the parent: its base is uniform over the vocabulary and one unknown word."""
        return (STRENGTH + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)

    def parent(self, customers, tables):
        return (customers - self.parent_discount * tables + self.fresh()) / (STRENGTH + self.parent_customers)

    def back_off(self) -> np.ndarray:
        """The share of each restaurant that goes to the parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def with_hot(self, w: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent customers and tables of words, those of hot words taken from all buckets together."""
        if not len(self.hot):
            return customers, tables
        at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        is_hot = self.hot[at] == w
        return np.where(is_hot, self.hot_customers[at], customers), np.where(is_hot, self.hot_tables[at], tables)


def sit(w, singles, x, r, c, t, parent_tables, rare_tables, totals: Totals, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over the dishes of a bucket: tables of each dish of two customers or more, and each word's parent customers and tables.

    w: words; singles: dishes of one customer of each; x, r, c, t: word, restaurant, customers and tables of each other dish.
    rare_tables: tables of the rare contexts, whose numbers follow those of the other restaurants.
    """
    customers = singles + np.bincount(x, t, len(w)).astype(np.int64)
    all_customers, all_tables = totals.with_hot(w, customers, parent_tables)
    opening = Openings(
        STRENGTH, totals.discount, np.maximum(np.concatenate([totals.tables, rare_tables])[r] - t, 0.0), None, (all_customers[x] - t).clip(0).astype(np.float64), all_tables[x].astype(np.float64),
        totals.fresh(), totals.parent_discount, (STRENGTH + totals.parent_customers - t).clip(STRENGTH),
    )
    t = draw_tables(c, t, opening, rng)
    customers = singles + np.bincount(x, t, len(w)).astype(np.int64)
    return t, customers, sit_parent(customers, parent_tables, totals, rng)


def sit_parent(customers: np.ndarray, tables: np.ndarray, totals: Totals, rng) -> np.ndarray:
    others = np.maximum(totals.parent_tables - tables, 0).astype(np.float64)
    return draw_tables(customers, tables, Openings(STRENGTH, totals.parent_discount, others, 1 / (totals.vocabulary + 1)), rng)


#: rare: the rare contexts with dishes of two customers or more here, ascending; fixed: tables of one customer in each, in all buckets;
#: apart: whether other buckets have dishes of two or more of it; seats: its tables at such dishes here, in each kept round.
_ARRAYS = ("w", "count", "singles", "x", "r", "c", "t", "sum", "parent", "sr", "st", "rare", "fixed", "apart")
_SUMS = ("rs", "ts", "hot")
_FACTS = ("n1", "n2", "m1", "m2", "p", "q", "e")
_STATE_SCHEMA = f"bucket int, lone long, {', '.join(f'{n} binary' for n in (*_ARRAYS, *_SUMS))}, kept array<binary>, seats array<binary>, {', '.join(f'{n} long' for n in _FACTS)}"


def _tables_here(s: dict, size: int) -> np.ndarray:
    """Tables of a bucket's rare contexts at its dishes of two customers or more."""
    far = s["r"] >= size
    return np.bincount(s["r"][far] - size, s["t"][far], len(s["rare"])).astype(np.int64)


def _state_row(s: dict, size: int, customers: np.ndarray, hot: np.ndarray, facts: list) -> pa.RecordBatch:
    """A bucket's state, and its part of the totals: tables by restaurant, parent customers of hot words, tables of rare contexts (lone: of one customer), rare contexts to ask for."""
    w, near = s["w"], s["r"] < size
    rs, inverse = _coded(np.concatenate([s["r"][near], s["sr"]]))
    ts = np.bincount(inverse, np.concatenate([s["t"][near], s["st"]]), len(rs)).astype(np.int64)
    at = np.searchsorted(w, hot)
    there = (at < len(w)) & (w[np.minimum(at, len(w) - 1)] == hot) if len(w) and len(hot) else np.zeros(len(hot), dtype=bool)
    mine = np.zeros(len(hot), dtype=np.int64)
    mine[there] = customers[at[there]]
    cold = np.ones(len(w), dtype=bool)
    cold[at[there]] = False
    facts = [*facts, int(s["parent"][cold].sum()), s["lone"] + int(s["t"][~near].sum()), int(s["apart"].sum())]
    packed = [pack(v) for v in (*(s[n] for n in _ARRAYS), rs, ts, mine)]
    return pa.RecordBatch.from_arrays(
        [pa.array([s["bucket"]], pa.int32()), pa.array([s["lone"]], pa.int64()), *(pa.array([v], pa.binary()) for v in packed),
         *(pa.array([s[n]], pa.list_(pa.binary())) for n in ("kept", "seats")), *(pa.array([int(v)], pa.int64()) for v in facts)],
        ["bucket", "lone", *_ARRAYS, *_SUMS, "kept", "seats", *_FACTS],
    )


def _read_state(row: dict) -> dict:
    return {k: unpack(v) if isinstance(v, bytes) else v for k, v in row.items()}


def _totals(state: DataFrame, size: int, hot: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Tables by restaurant and customers of the hot words, summed over buckets in blocks, and the sums of the facts."""
    block = 8192

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import unpack

        t, h = np.zeros(size, dtype=np.int64), np.zeros(hot, dtype=np.int64)
        for batch in batches:
            for rs, ts, mine in zip(*(batch.column(i).to_pylist() for i in range(3))):
                np.add.at(t, unpack(rs), unpack(ts))
                h += unpack(mine)
        everything = np.concatenate([t, h])
        at = range(0, len(everything), block)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([everything[a : a + block].tolist() for a in at], pa.list_(pa.int64()))], ["at", "v"])

    def add(rows: pa.Table) -> pa.Table:
        first = rows.column("at")[0].as_py()
        total = np.sum([v.values.to_numpy() for v in rows.column("v")], axis=0)
        return pa.table({"at": [first], "v": pa.array([total.tolist()], pa.list_(pa.int64()))})

    sums = state.select("rs", "ts", "hot").mapInArrow(partial, "at long, v array<long>").groupBy("at").applyInArrow(add, "at long, v array<long>")
    out = np.zeros(size + hot, dtype=np.int64)
    for r in sums.collect():  # RESTAURANTS + GROUPS numbers and one a hot word
        out[r["at"] : r["at"] + len(r["v"])] = r["v"]
    facts = state.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _FACTS]).collect()[0]
    return out[:size], out[size:], facts


_ASK = "block int, bucket int, ids binary, singles binary, tables binary"


def _ask(bucket: int, ids: np.ndarray, singles: np.ndarray, tables: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A bucket's numbers of rare contexts (ids ascending), a row a block."""
    out = [(b, bucket, pack(ids[at]), pack(singles[at]), pack(tables[at])) for b, at in _slices(block_of(ids, blocks))]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], ["block", "bucket", "ids", "singles", "tables"])


def _ask_first(row: dict, known: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Of the merged cells: dishes of one customer, and the others, of all rare contexts."""
    u, ux, n = (unpack(row[k]) for k in ("u", "ux", "n"))
    rare = np.flatnonzero(restaurants(u, known, False) < 0)
    one = n == 1
    return _ask(row["bucket"], u[rare], np.bincount(ux[one], minlength=len(u))[rare], np.bincount(ux[~one], minlength=len(u))[rare], blocks)


def _ask_again(row: dict, size: int, blocks: int) -> pa.RecordBatch:
    s = _read_state(row)
    apart = s["apart"] > 0
    tables = _tables_here(s, size)[apart]
    return _ask(row["bucket"], s["rare"][apart], np.zeros_like(tables), tables, blocks)


def _answer(rows: pa.Table) -> pa.Table:
    """To each bucket of a block, for its contexts with tables: those of all buckets, dishes of one customer, whether another bucket has tables."""
    ids, singles, tables = ([unpack(b.as_py()) for b in rows.column(name)] for name in ("ids", "singles", "tables"))
    _, at = _coded(np.concatenate(ids))
    here = np.concatenate(tables)
    every, fixed, buckets = np.bincount(at, here), np.bincount(at, np.concatenate(singles)), np.bincount(at, here > 0)
    edges, out = np.cumsum([0, *map(len, ids)]), []
    for bucket, a, b in zip(rows.column("bucket").to_pylist(), edges[:-1], edges[1:]):
        mine = at[a:b][here[a:b] > 0]
        if len(mine):
            out.append((bucket, pack(every[mine].astype(np.int64)), pack(fixed[mine].astype(np.int64)), pack((buckets[mine] > 1).astype(np.int64))))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
    return pa.table([columns[0], pa.array([rows.column("block")[0].as_py()] * len(out), pa.int32()), *columns[1:]], ["bucket", "block", "tables", "fixed", "apart"])


def exchange(asks: DataFrame) -> DataFrame:
    """bucket, told: what each bucket asked for."""
    answers = asks.groupBy("block").applyInArrow(_answer, "bucket int, block int, tables binary, fixed binary, apart binary")
    return materialize(answers.groupBy("bucket").agg(F.collect_list(F.struct("block", "tables", "fixed", "apart")).alias("told")), "lm-told")


def _rare_tables(s: dict, size: int, told: list[dict] | None, blocks: int, first: bool) -> np.ndarray:
    """Tables of the bucket's rare contexts in all buckets; the first time, what is fixed and apart is set."""
    tables = _tables_here(s, size)
    if told:
        told = {a["block"]: a for a in told}
        asked = np.flatnonzero(s["apart"])
        for block, at in _slices(block_of(s["rare"][asked], blocks)):
            tables[asked[at]] = unpack(told[block]["tables"])
            if first:
                s["fixed"][asked[at]], s["apart"][asked[at]] = unpack(told[block]["fixed"]), unpack(told[block]["apart"])
    return tables + s["fixed"]


def _release(spark) -> None:
    """Lets Spark remove the files of shuffles that no table needs any more: it does so when the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


class Model:
    """known: ids of restaurants that are broadcast; state: the buckets; samples: the kept totals; counts of the hot words; blocks: of rare contexts."""

    def __init__(self, known, state, samples, tokens, vocabulary, hot, hot_counts, buckets, blocks, pooled):
        self.known, self.state, self.samples, self.tokens, self.vocabulary = known, state, samples, tokens, vocabulary
        self.hot, self.hot_counts, self.buckets, self.blocks, self.pooled = hot, hot_counts, buckets, blocks, pooled


def keyed(docs: DataFrame) -> DataFrame:
    """text, train, key (64 bits of id and text), doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), F.col("train"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))


def balance(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of buckets, and the ids of words that would fill more than half of one."""
    n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    buckets = max(1, -(-n // BUCKET_BYTES))
    some = sampled(docs.select("key", "text"), "key", BALANCE_DOCS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = some.select(F.explode(words(lower)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0] if buckets > 1 else 0
    top = found.filter(F.col("n") * (2 * buckets) > total).collect() if total else []  # fewer than 2 * buckets
    return buckets, np.array(sorted({END_ID, *(word_id(r["w"].encode("utf-8", "surrogatepass")) for r in top)}), dtype=np.int64)


def frequent(words: DataFrame, most: int = RESTAURANTS) -> DataFrame:
    """The words of at least some count, ``most`` at most, whose totals are broadcast: the count is found from a histogram of at most 512 bins."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    bins = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["level"]):
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["least"]
    return words.filter(F.col("c") >= least)


def _dishes(row: dict, known: np.ndarray, hot: np.ndarray, pooled: bool) -> pa.RecordBatch:
    """The first state of a bucket: one table a dish."""
    w, x, u, ux, n = (unpack(row[k]) for k in ("w", "wx", "u", "ux", "n"))
    size = len(known) + GROUPS
    r, c = restaurants(u, known, pooled), n
    if pooled:
        key = x * size + r[ux]
        order = np.argsort(key, kind="stable")
        starts = _runs(key[order])
        key, c = key[order][starts], _sum_at(n[order], starts)
        x, r, rare = key // size, key % size, u[:0]
    else:  # in the order of their contexts' ids, so that what is drawn does not depend on what is broadcast
        there = np.flatnonzero((np.bincount(ux[n > 1], minlength=len(u)) > 0) & (r < 0))
        r[there] = size + np.arange(len(there))
        r, rare = r[ux], u[there]
    one = c == 1
    singles = np.bincount(x[one], minlength=len(w)).astype(np.int64)
    near = one & (r >= 0) & (r < size)
    sr, st = np.unique(r[near], return_counts=True)
    own = np.bincount(x, minlength=len(w)).astype(np.int64)
    facts = [one.sum(), (c == 2).sum(), (own == 1).sum(), (own == 2).sum()]
    count = np.bincount(x, c, len(w)).astype(np.int64)
    x, r, c = x[~one], r[~one], c[~one]
    t = np.ones(len(x), dtype=np.int64)
    s = {"bucket": row["bucket"], "lone": int(one.sum() - near.sum()), "w": w, "count": count, "singles": singles, "x": x, "r": r, "c": c, "t": t, "sum": np.zeros_like(t), "parent": np.minimum(own, 1), "sr": sr, "st": st}
    s |= {"rare": rare, "fixed": np.zeros(len(rare), dtype=np.int64), "apart": np.ones(len(rare), dtype=np.int64), "kept": [], "seats": []}
    return _state_row(s, size, own, hot, facts)


def train(docs: DataFrame, pooled: bool = True) -> Model:
    """docs: doc_id, text and train (boolean); pooled: rare contexts share GROUPS restaurants, else each has its own."""
    spark = docs.sparkSession
    ship(spark)
    docs = keyed(docs)
    buckets, hot = balance(docs)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import pack_cells

        yield from pack_cells(batches, hot, buckets)

    def merge(rows: pa.Table) -> pa.Table:
        from stratum.llm.hpylm import merge_cells, pack

        w, x, u, ux, n = merge_cells(rows)
        row = {"w": w, "wx": x, "u": u, "ux": ux, "n": n, "count": np.bincount(x, n, len(w)).astype(np.int64)}
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), **{k: pa.array([pack(v)], pa.binary()) for k, v in row.items()}})

    blocks = docs.select("text", "train", "key").filter("train").mapInArrow(cells, "bucket int, w binary, wx binary, u binary, ux binary, n binary")
    merged = materialize(blocks.groupBy("bucket").applyInArrow(merge, "bucket int, w binary, wx binary, u binary, ux binary, n binary, count binary"), "lm-cells")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import unpack

        for batch in batches:
            for w, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
                w, n = unpack(w), unpack(n)
                for at in range(0, len(w), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(w[at : at + 50_000]), pa.array(n[at : at + 50_000])], ["w", "c"])

    # Only a hot word has more than one row.
    vocabulary = materialize(merged.select("w", "count").mapInArrow(listed, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "lm-words")
    size = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).collect()[0]
    top = frequent(vocabulary).toArrow().combine_chunks()  # RESTAURANTS rows at most: what is broadcast
    ids, counts = (top.column(i).to_numpy() for i in range(2))
    known, counts = ids[np.argsort(ids)], counts[np.argsort(ids)]
    customers = np.append(counts, np.zeros(GROUPS)).astype(np.float64)
    least = int(counts.min()) if len(counts) else 1 << 62
    group = F.shiftright("w", 20).bitwiseAND(F.lit(GROUPS - 1)).cast("int")
    for r in vocabulary.filter(F.col("c") < least).groupBy(group.alias("g")).agg(F.sum("c").alias("c")).collect() if pooled else []:  # GROUPS rows
        customers[len(counts) + r["g"]] = r["c"]
    # As many blocks as hold a quarter of a bucket's tokens each.
    tokens, restaurants_ = int(size["n"]), len(customers)
    blocks = 1 if pooled or not tokens else max(1, math.ceil(4 * buckets * (1 - int(counts.sum()) / tokens)))
    asked = spark.createDataFrame(pa.table({"w": pa.array(hot)}))
    hot_counts = {r["w"]: r["c"] for r in vocabulary.join(asked, "w").collect()}
    hot_counts = np.array([hot_counts.get(int(w), 0) for w in hot], dtype=np.int64)
    discard(vocabulary)
    _release(spark)
    lists = spark.sparkContext.broadcast((known, hot))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import _dishes

        for batch in batches:
            for row in batch.to_pylist():
                yield _dishes(row, *lists.value, pooled)

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import _ask_first

        for batch in batches:
            for row in batch.to_pylist():
                yield _ask_first(row, lists.value[0], blocks)

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import _ask_again

        for batch in batches:
            for row in batch.to_pylist():
                yield _ask_again(row, restaurants_, blocks)

    state = materialize(merged.drop("count").mapInArrow(first, _STATE_SCHEMA), "lm-state")
    tables, hot_customers, facts = _totals(state, len(customers), len(hot))
    told = exchange(merged.select("bucket", "u", "ux", "n").mapInArrow(ask_first, _ASK)) if facts["e"] else None
    discard(merged)
    ratio = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    hot_tables = np.minimum(hot_customers, 1)
    totals = Totals(customers, tables.astype(np.float64), facts["q"], facts["p"] + hot_tables.sum(), size["v"], ratio(facts["n1"], facts["n2"]), ratio(facts["m1"], facts["m2"]), hot, hot_customers, hot_tables)
    samples = []
    for round_ in range(BURN_IN + SAMPLES):
        shared = spark.sparkContext.broadcast(totals)

        def reseat(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            from stratum.llm.hpylm import BURN_IN, SEED, _rare_tables, _read_state, _state_row, _tables_here, pack, sit

            now = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    s = _read_state(row)
                    rng = np.random.default_rng([SEED, round_, row["bucket"]])
                    rare = _rare_tables(s, restaurants_, row.get("told"), blocks, round_ == 0)
                    s["t"], customers, s["parent"] = sit(s["w"], s["singles"], s["x"], s["r"], s["c"], s["t"], s["parent"], rare, now, rng)
                    if round_ >= BURN_IN:
                        s["kept"] += [pack(customers), pack(s["parent"])]
                        s["seats"] += [pack(_tables_here(s, restaurants_))]
                        s["sum"] = s["sum"] + s["t"]
                    yield _state_row(s, restaurants_, customers, now.hot, [0, 0, 0, 0])

        after = materialize((state.join(told, "bucket", "left") if told is not None else state).mapInArrow(reseat, _STATE_SCHEMA), "lm-state")
        discard(state, *([told] if told is not None else []))
        state = after
        _release(spark)
        tables, hot_customers, facts = _totals(state, len(customers), len(hot))
        last = round_ + 1 == BURN_IN + SAMPLES
        told = exchange(state.select("bucket", "r", "t", "rare", "apart").mapInArrow(ask_again, _ASK)) if facts["e"] and not last else None
        hot_tables = sit_parent(hot_customers, totals.hot_tables, totals, np.random.default_rng([SEED, round_, 1 << 31]))
        totals = Totals(customers, tables.astype(np.float64), facts["q"], facts["p"] + hot_tables.sum(), size["v"], totals.discount, totals.parent_discount, hot, hot_customers, hot_tables)
        if round_ >= BURN_IN:
            samples.append(totals)
    return Model(known, state, samples, tokens, size["v"], hot, hot_counts, buckets, blocks, pooled)


def judge(rows: pa.Table, final: dict | None, model, blocks: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, list[np.ndarray]]]]:
    """From a bucket's postings and its final state: (document key, score, base, tokens, known tokens) of the documents with tokens in
    it, the score without that of tokens after rare contexts; and what is needed for those, by block, for judge_rare()."""
    samples, hot, hot_counts, size, tokens, vocabulary = model
    of = lambda name: [unpack(b.as_py()) for b in rows.column(name)]
    ws, wxs, rs, us, docs, dxs, flags, ns = (of(name) for name in ("w", "wx", "r", "us", "docs", "dx", "train", "n"))
    all_docs = np.concatenate(docs).view(np.int64)
    doc_keys, place = np.unique(all_docs, return_inverse=True)
    w, rare = np.unique(np.concatenate(ws)), np.unique(np.concatenate(us))
    both = size + len(rare)

    def of_all(r: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Restaurants, rare ones of some row renumbered to those of all."""
        far = np.flatnonzero(r >= size)
        r[far] = size + np.searchsorted(rare, ids)[r[far] - size]
        return r

    key = np.concatenate([np.searchsorted(w, a)[i] * both + of_all(r, u) for a, i, r, u in zip(ws, wxs, rs, us)])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc = np.concatenate([place[s + i] for s, i in zip(starts, dxs)]).astype(np.int32)
    n = np.concatenate(ns).astype(np.int32)
    trained = n * np.concatenate([f[i] for f, i in zip(flags, dxs)])
    del ws, wxs, rs, us, docs, dxs, flags, ns
    cells, at = np.unique(key, return_inverse=True)
    at = at.astype(np.int32)
    c = np.bincount(at, trained, len(cells))
    del key, trained
    x, r = cells // both, cells % both
    # What training left of these words and dishes.
    count = np.zeros(len(w))
    kept = [(np.zeros(len(w)), np.zeros(len(w))) for _ in samples]
    tables = np.minimum(c, 1)
    seats = [np.zeros(len(rare), dtype=np.int64) for _ in samples]
    if final is not None:
        s = _read_state({k: v for k, v in final.items() if k not in ("kept", "seats")})
        theirs = np.searchsorted(s["w"], w)
        theirs[theirs == len(s["w"])] = 0
        there = s["w"][theirs] == w if len(s["w"]) else np.zeros(len(w), dtype=bool)
        count[there] = s["count"][theirs[there]]
        for k, (customers, parent) in enumerate(kept):
            customers[there] = unpack(final["kept"][2 * k])[theirs[there]]
            parent[there] = unpack(final["kept"][2 * k + 1])[theirs[there]]
            seats[k][np.searchsorted(rare, s["rare"])] = unpack(final["seats"][k])
        dish = np.searchsorted(w, s["w"][s["x"]]) * both + of_all(s["r"], s["rare"])
        place = np.searchsorted(cells, dish)
        tables[place] = s["sum"] / len(samples)
    if len(hot):
        h = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
        count = np.where(hot[h] == w, hot_counts[h], count)
    kept = [totals.with_hot(w, *k) for totals, k in zip(samples, kept)]
    d = samples[0].discount
    far = np.flatnonzero(r >= size)
    near = np.where(r < size, r, 0)
    p = (c - d * tables) / (STRENGTH + samples[0].customers[near])
    for totals, k in zip(samples, kept):
        base = totals.parent(*k)
        p += totals.back_off()[near] * base[x] / len(samples)
    p[far] = 1.0
    add = lambda v: np.bincount(doc, n * v, len(doc_keys))
    of_word = x[at]
    known = doc_keys, add(np.log10(p)[at]), add(np.log10(count + 1.0)[of_word]), add(1), add((count > 0)[of_word])
    # All cells of a rare context here, and their tokens.
    later = []
    if len(far):
        x, r, c, tables = x[far], r[far] - size, c[far].astype(np.int64), np.rint(tables[far] * len(samples)).astype(np.int64)
        block = block_of(rare, blocks)
        customers = np.bincount(r, c, len(rare)).astype(np.int64)
        lone = np.bincount(r, c == 1, len(rare)).astype(np.int64)
        cell = np.full(len(cells), -1, dtype=np.int64)
        cell[far] = np.arange(len(far))
        cell = cell[at]
        token = np.flatnonzero(cell >= 0)
        cell, doc, n = cell[token], doc[token], n[token]
        number = np.empty(max(len(rare), len(far)), dtype=np.int64)
        for (b, u), (_, i), (_, j) in zip(_slices(block), _slices(block[r]), _slices(block[r[cell]])):
            number[u] = np.arange(len(u))
            (y, yx), (e, ex) = _coded(x[i]), _coded(doc[j])
            ux = number[r[i]]
            number[i] = np.arange(len(i))
            words = [v[y].astype(np.int64) for k in kept for v in k]
            later.append((b, [rare[u], customers[u], *((lone + v)[u] for v in seats), *words, ux, yx, c[i], tables[i], number[cell[j]], doc_keys[e].view(np.uint64), ex, n[j]]))
    return known, later


def judge_rare(rows: list[list[np.ndarray]], samples: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
    """(document key, score) of the tokens after the rare contexts of a block, from what the buckets have of them."""
    ids, k, d = np.unique(np.concatenate([row[0] for row in rows])), len(samples), samples[0].discount
    places = [np.searchsorted(ids, row[0]) for row in rows]
    customers, tables = np.zeros(len(ids)), [np.zeros(len(ids)) for _ in samples]
    for at, row in zip(places, rows):
        for total, v in zip((customers, *tables), row[1:]):
            total[at] += v
    keys, scores = [], []
    for at, row in zip(places, rows):
        words, (ux, x, c, t, cell, docs, doc, n) = row[2 + k : -8], row[-8:]
        u = at[ux]
        p = c - d * t / k
        for i, totals in enumerate(samples):
            base = totals.parent(*words[2 * i : 2 * i + 2])
            p = p + (STRENGTH + d * tables[i][u]) * base[x] / k
        keys.append(docs.view(np.int64))
        scores.append(np.bincount(doc, n * np.log10(p / (STRENGTH + customers[u]))[cell], len(docs)))
    return np.concatenate(keys), np.concatenate(scores)


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by key. Rows come in any order: added by size, so that reruns agree to the last bit."""
    keys, at = np.unique(keys, return_inverse=True)
    out = []
    for v in values:
        order = np.lexsort((v, at))
        out.append(_sum_at(v[order], _runs(at[order])))
    return keys, *out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text, train)."""
    spark = docs.sparkSession
    ship(spark)
    docs = keyed(docs)
    shared = spark.sparkContext.broadcast((model.known, model.hot, (model.samples, model.hot, model.hot_counts, len(model.known) + GROUPS, model.tokens, model.vocabulary)))
    buckets, blocks, pooled = model.buckets, model.blocks, model.pooled
    parts = max(1, buckets // 4)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.hpylm import pack_postings

        known, hot, _ = shared.value
        yield from pack_postings(batches, hot, buckets, known, pooled)

    def by_part(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        from stratum.llm.hpylm import _slices, pack

        for part, at in _slices((keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)):
            yield part, [pack(keys[at].view(np.uint64)), *(pack(v[at]) for v in values)]

    def as_table(rows: list[tuple[int, list[bytes]]]) -> pa.Table:
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["place", "body"])

    def read(rows: pa.Table) -> list[list[np.ndarray]]:
        from stratum.llm.hpylm import unpack

        return [[unpack(b) for b in body.as_py()] for body in rows.column("body")]

    def add(rows: pa.Table) -> tuple[np.ndarray, ...]:
        from stratum.llm.hpylm import added

        docs, *values = (np.concatenate(column) for column in zip(*read(rows)))
        return added(docs.view(np.int64), *values)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        """Places below parts: sums of documents; from there on: blocks of rare contexts."""
        from stratum.llm.hpylm import judge, pack

        out = []
        if left.num_rows:
            final = right.drop_columns(["bucket"]).to_pylist()[0] if right.num_rows else None
            (keys, score, base, n, known), later = judge(left, final, shared.value[2], blocks)
            out += by_part(keys, score, base, n.astype(np.int64), known.astype(np.int64))
            out += ((parts + b, [pack(v) for v in body]) for b, body in later)
        return as_table(out)

    def finish(rows: pa.Table) -> pa.Table:
        from stratum.llm.hpylm import added, judge_rare

        if rows.column("place")[0].as_py() < parts:
            keys, *values = add(rows)
        else:
            keys, score = added(*judge_rare(read(rows), shared.value[2][0]))
            none = np.zeros(len(keys), dtype=np.int64)
            values = score, none.astype(np.float64), none, none
        return as_table(list(by_part(keys, *values)))

    def total(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("key", "score", "base", "n", "known"), add(rows))))

    final = model.state.select("bucket", "w", "count", "x", "r", "sum", "rare", "kept", "seats")
    packed = docs.select("text", "train", "key").mapInArrow(postings, "bucket int, w binary, wx binary, r binary, us binary, docs binary, dx binary, train binary, n binary")
    body = "place int, body array<binary>"
    partial = packed.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(sums, body).groupBy("place").applyInArrow(finish, body)
    sums_of = partial.groupBy("place").applyInArrow(total, "key long, score double, base double, n long, known long")
    # Equal rows have one key, and sums of all of them.
    rows = docs.groupBy("key", "doc_id", "train").agg(F.count(F.lit(1)).alias("copies"))
    log_all = math.log10(model.tokens + model.vocabulary + 1)
    n = (F.col("n") / F.col("copies")).cast("long")
    return (
        rows.join(sums_of, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            (~F.col("train")).alias("held_out"),
            n.alias("n_tokens"),
            (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") / F.col("copies") - n * F.lit(log_all)).alias("base_score"),
            (F.col("score") / F.col("copies")).alias("score"),
        )
    )


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text, train of documents by the production fold."""
    return docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, base_perplexity, perplexity of each fold."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("base_score").alias("base_perplexity"), per("score").alias("perplexity"))
