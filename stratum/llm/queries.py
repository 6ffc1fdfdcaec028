"""The ten operators with production parameters over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hpylm, htmltext, mixing, quality, simhash, tokencount, urlfilter, warc
from .common import fresh_path, table, word_count


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, table(spark, sf_dir, "labels")).select("doc_id", *quality.STATS, "base_failed", "kept", "llr")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hpylm.split(table(spark, sf_dir, "documents"))
    return hpylm.score(docs, hpylm.train(docs, pooled=False))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_quality, op4_url_filter, op5_token_counts, op6_lm_scores, op7_warc, op8_html_text, op9_bpe, op10_neighbours)}
def _terms(terms) -> str:
    return f"(^|[^a-z0-9])({'|'.join(sorted(terms, key=len, reverse=True))})([^a-z0-9]|$)"


def _url_sql() -> str:
    """Host, path and rule by regular expression; the vocabulary by one boundary-checked expression for strict terms and one per soft term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        at = rule.index("/")
        return f"((host = '{rule[:at]}' OR ends_with(host, '.{rule[:at]}')) AND starts_with(path, '{rule[at:]}'))"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    soft = " + ".join(f"CAST(regexp_matches(u, '{_terms([t])}') AS INTEGER)" for t in urlfilter.SOFT)
    return f"""WITH a AS (SELECT page_id, coalesce(url, '') AS x FROM pages),
b AS (SELECT page_id, translate(x, '{upper}', '{lower}') AS u, CASE WHEN strpos(x, '://') > 0 THEN substr(x, strpos(x, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {rule} END AS rule, regexp_matches(u, '{_terms(urlfilter.STRICT)}') OR {soft} >= {urlfilter.SOFT_LIMIT} AS bad FROM c)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM d"""


_WARC_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= {warc.MIN_REVISIT} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN g ON g.h = p.h"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.mix_sql(), "op4_url_filter": _url_sql(), "op7_warc": _WARC_SQL}
