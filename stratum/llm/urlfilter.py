"""URL filter: allow and block rules by host and path, then a weighted vocabulary found by an Aho-Corasick automaton.

Strict terms reject on one hit, soft terms from SOFT_LIMIT distinct ones on. A hit counts only between boundaries: no ASCII
letter or digit stands next to it. Matching sees the whole URL with A-Z lower-cased.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule, and is judged by the
vocabulary alone (null: allow); rows are independent, so ties, repeats and empty tables need no rule; extra columns
stay, output columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, unused

#: Fixed values of the production filter.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
STRICT = ("adult", "casino", "casinos", "escort", "escorts", "hentai", "porn", "porno", "viagra", "xxx")
SOFT = ("ads", "bet", "bets", "betting", "bonus", "cheap", "deal", "deals", "dating", "farm", "free", "jackpot", "loan", "loans", "pills", "poker", "promo", "sex", "spam", "track", "tracker", "win")
SOFT_LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's; null if none."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (len(r), r)):
        at = rule.find("/")
        h, p = rule[:at], rule[at:]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(rule)).otherwise(out)
    return out


def rejected(urls: list[str], automaton, soft_limit: int) -> list[bool]:
    out = []
    for url in urls:
        url = url.translate(_TABLE)
        soft: set[str] = set()
        strict = False
        for end, (term, is_strict) in automaton.iter(url):
            start = end - len(term) + 1
            if (start == 0 or not _alnum(url[start - 1])) and (end + 1 == len(url) or not _alnum(url[end + 1])):
                if is_strict:
                    strict = True
                    break
                soft.add(term)
        out.append(strict or len(soft) >= soft_limit)
    return out


_TABLE = str.maketrans(_UPPER, _LOWER)


def _alnum(c: str) -> bool:
    return c in "abcdefghijklmnopqrstuvwxyz0123456789"


def build(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in soft:
        out.add_word(term, (term, False))
    for term in strict:
        out.add_word(term, (term, True))
    out.make_automaton()
    return out


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    url: str = "url",
) -> DataFrame:
    """pages plus host, path, rule (null if none fits) and verdict (allow or block)."""
    ship(pages.sparkSession)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from stratum.llm.urlfilter import build, rejected

        automaton = build(strict, soft)  # once a task
        for urls in batches:
            yield pd.Series(rejected(urls.tolist(), automaton, soft_limit), dtype=bool)

    bad = F.pandas_udf(judge, "boolean")
    asked, found = unused(pages, "_u_url"), unused(pages, "_u_bad")
    df = pages.withColumn(asked, F.col(url))
    df = df.withColumn(found, bad(F.coalesce(F.col(asked), F.lit(""))))
    df = df.withColumns({"host": host(F.col(asked)), "path": path(F.col(asked))})
    df = df.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col(found), F.lit("block")).otherwise(F.lit("allow"))
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return df.withColumn("verdict", verdict).drop(asked, found)


def vocabulary(terms: DataFrame, most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table (term, strict), A-Z lowered; more than ``most`` rows are an error, none are left out.

    A term given both ways is strict; null and empty terms and a null mark (soft) are allowed.
    """
    rows = terms.select(F.translate("term", _UPPER, _LOWER).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict")).filter("term != ''")
    found = rows.groupBy("term").agg(F.max("strict").alias("strict")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r["term"] for r in found if r["strict"]), sorted(r["term"] for r in found if not r["strict"])
