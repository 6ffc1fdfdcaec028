"""Quality rules: base rules plus a hashed n-gram log-likelihood ratio, native Spark expressions only.

Two multinomials over ``buckets`` hashed 1- and 2-grams are counted: one over the whole raw corpus, one over
trusted documents. A document's score is the mean over its n-grams of log p(trusted) - log p(raw); it is kept
when no base rule fails and the score reaches a fixed threshold. The trusted set is a bounded, deterministic
sample of the documents labelled good (``target_rows``); raw counts cover every document.

Defined results: a null text has no words, so a base rule fails; an empty table gives no rows; without trusted
documents the ratio is 0 for every document and the base rules alone decide; repeated rows are judged alike;
extra columns stay, output columns replace those of the same name. A null doc_id is never trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, sampled, words

BUCKETS = 10_000
TARGET_ROWS = 20_000
THRESHOLD = -0.05
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed exactly once a row.

    The optimizer inlines a plain projection into whatever uses it, and into a lambda or a pushed-down filter that means
    again for each element; it moves nothing through a generator of one row.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """Adds _q_text and _q_hash (a 64-bit hash of each word)."""
    df = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    return _once(df, "_q_hash", F.transform(words(F.col("_q_text")), lambda w: F.xxhash64(w)))


def _grams(buckets: int) -> Column:
    """Hash buckets of all words and of all pairs of neighbours; needs _q_hash."""
    n = F.size("_q_hash")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get("_q_hash", i), F.get("_q_hash", i + 1))))
    both = F.concat("_q_hash", F.coalesce(pairs, F.array().cast("array<bigint>")))
    return F.transform(both, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five statistics of the base rules. Layers keep every array in a column of its own, computed once."""
    df = _hashed(docs, text)
    n = F.size("_q_hash")
    last = F.size("_q_windows") - 1
    df = _once(
        df,
        "_q_windows",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("_q_hash", i + 1, WINDOW)))),
    )
    # Only a text in which some window comes back pays for the sort that finds where.
    df = _once(
        df,
        "_q_sorted",
        F.when(F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"), F.sort_array(F.transform("_q_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    same = lambda j, k: F.get("_q_sorted", j)["x"] == F.get("_q_sorted", k)["x"]
    df = _once(
        df,
        "_q_at",
        F.when(
            F.col("_q_sorted").isNotNull(),
            F.sort_array(F.transform(F.filter("_q_sorted", lambda s, k: F.coalesce(same(k, k + 1), F.lit(False)) | F.coalesce(same(k, k - 1), F.lit(False))), lambda s: s["i"])),
        ),
    )
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_q_at") - 1),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get("_q_at", k + 1) - F.get("_q_at", k), F.lit(WINDOW))),
    )
    df = _once(df, "_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: F.trim(x, F.lit(SEPARATORS)) != ""))
    stats = F.struct(
        *[value.alias(name) for name, value in {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_q_text", SEPARATORS, "")).cast("long"),
            "n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_q_at").isNotNull(), covered).otherwise(F.lit(0).cast("long")),
        }.items()]
    )
    df = _once(df, "_q_stats", stats).drop("_q_windows", "_q_sorted", "_q_at", "_q_lines")
    return df.withColumns({name: F.col("_q_stats")[name] for name in STATS}).drop("_q_stats")


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids of documents labelled good and not toxic, of the smallest by hash: the documented bound.

    An id with several label rows is trusted if one of them is good and not toxic. Of more ids than ``rows``, about 95% of that are taken.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").alias("_q_id")).distinct()
    return sampled(ids, "_q_id", rows).orderBy(F.xxhash64("_q_id"), "_q_id").limit(rows)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text", id: str = "doc_id") -> list[float] | None:
    """log p(trusted) - log p(raw) of each bucket, add-one smoothed: ``buckets`` doubles, whatever the input.

    None without a trusted n-gram. trusted has at most TARGET_ROWS ids, so broadcasting it is bounded.
    """
    narrow = docs.select(F.col(id).alias("_q_doc"), F.col(text).alias("_q_raw"))
    # An id given twice would double its documents' counts: trusted ids are distinct.
    marked = narrow.join(F.broadcast(trusted.withColumn("_q_good", F.lit(1))), F.col("_q_doc") == F.col("_q_id"), "left")
    grams = _hashed(marked, "_q_raw").select(F.coalesce("_q_good", F.lit(0)).cast("long").alias("good"), F.explode(_grams(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    raw_total, good_total = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    if not good_total:
        return None
    import math

    raw, good = {r["bucket"]: r["raw"] for r in counts}, {r["bucket"]: r["good"] for r in counts}
    shift = math.log(raw_total + buckets) - math.log(good_total + buckets)
    return [math.log(good.get(b, 0) + 1) - math.log(raw.get(b, 0) + 1) + shift for b in range(buckets)]


def quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
    text: str = "text",
    id: str = "doc_id",
) -> DataFrame:
    """All columns of docs plus the statistics, base_failed, llr (double) and kept. No row is dropped."""
    weights = log_ratios(docs, trusted_ids(labels, target_rows), buckets, text, id)
    df = with_stats(docs, text)
    if weights is None:
        llr = F.lit(0.0)
    else:
        table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
        df = _once(df, "_q_grams", _grams(buckets))
        total = F.aggregate("_q_grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        llr = F.when(F.size("_q_grams") > 0, total / F.size("_q_grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    df = _once(df, "llr", llr).withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    return df.drop("_q_text", "_q_hash", "_q_grams")


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that quality() keeps, with the columns of docs."""
    return quality(docs, labels, **options).filter("kept").select(*docs.columns)
