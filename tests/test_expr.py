"""Truth tables of the column helpers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratum.functions import expr as X
from stratum.functions.hashing import ResumableSha256, blake3, blake3_hex, blake3_many, signature_valid


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


HASH = "ab" + "0" * 62


def test_validators(spark):
    assert column(spark, [HASH, HASH[:-1], HASH.upper(), HASH + "\n", None], X.valid_hash) == [True, False, False, False, False]
    names = ["a.bin", "", "  ", ".", "..", "a..b", "/a", "a/b", "a\\b", "a\x07", "é" * 512, "é" * 513, None]
    assert column(spark, names, X.valid_file_id) == [True] + [False] * 9 + [True, False, False]
    keys = ["a/b", "", "/a", "a/", "a//b", "a/./b", "a/../b", "a\\b", "x" * 4096, "x" * 4097, None]
    assert column(spark, keys, X.valid_object_key) == [True] + [False] * 7 + [True, False, False]
    assert column(spark, ["team", "", "a\n", "x" * 513], X.valid_scope_part) == [True, False, False, False]
    assert column(spark, ["a/b-c.d", "A/b", "a//b", "a/..", "", "/a"], X.valid_repository_name) == [True] + [False] * 5
    assert column(spark, ["v1.0", "_x", "-x", "", "t" * 128, "t" * 129], X.valid_tag) == [True, True, False, False, True, False]


def test_keys(spark):
    lit = F.lit
    row = spark.range(1).select(
        X.scope_key(lit("p"), lit("team:a"), lit("asset"), lit(None).cast("string")).alias("a"),
        X.scope_key(lit("p"), lit("team"), lit("a:asset"), lit(None).cast("string")).alias("b"),
        X.scope_key(lit(None).cast("string"), lit(None).cast("string"), lit(None).cast("string"), lit(None).cast("string")).alias("g"),
        X.lp(lit("é")).alias("lp"),
        X.record_key(lit("latest"), lit("s"), lit("f")).alias("latest"),
        X.record_key(lit("version"), lit("s"), lit("f"), lit("h")).alias("version"),
        X.scope_namespace(lit("p"), lit("o"), lit("n"), lit(None).cast("string")).alias("ns"),
        X.group_reversed_hex(lit("000102030405060708090a0b0c0d0e0f")).alias("x"),
        X.identity_key(lit("p"), lit("o"), lit("n"), lit(None).cast("string"), lit("f"), lit("h")).alias("id"),
        X.digest_of_text_id(lit("sha256:" + HASH)).alias("digest"),
        X.little_endian_hex(lit(258)).alias("le"),
    ).first()
    assert row["a"] != row["b"] and row["g"] == "6:global" and row["lp"] == "2:é"
    assert row["latest"] == "6:latest1:s1:f" and row["version"] == "7:version1:s1:f1:h"
    assert row["ns"] == hashlib.sha256(b"p\0o\0n\0").hexdigest()
    assert row["x"] == "07060504030201000f0e0d0c0b0a0908"
    assert row["id"] == "p:o/n@latest:f:h" and row["digest"] == HASH and row["le"] == "0201000000000000"


def test_key_classes(spark):
    keys = [f"ab/{HASH}", f"xorbs/default/ab/{HASH}.xorb", f"shards/ab/{HASH}.shard", "ab/abc", "ab/cd", f"AB/{HASH}", "shards/ab/abz.shard", f"protocols/lfs/global/objects/{HASH}", f"x/ab/{HASH}"]
    got = column(spark, keys, X.classify_key)
    assert [g["class"] for g in got] == ["chunk", "xorb", "shard"] + ["unmanaged"] * 6
    assert [g["error"] for g in got] == [False, False, False, True, False, False, True, False, False]
    assert [g["hash"] for g in got[:3]] == [HASH] * 3


def test_ranges(spark):
    got = column(spark, ["bytes=0-3", "bytes=2-", "bytes=2-99", "bytes=4-4", "bytes=3-2", "bytes=0-1,2-3", "items=0-1", None], lambda c: X.http_range(c, F.lit(4).cast("long")))
    assert [tuple(g) for g in got] == [(0, 3, None), (2, 3, None), (2, 3, None), (None, None, "unsatisfiable"), (None, None, "syntax"), (None, None, "syntax"), (None, None, "unit"), (None, None, "unit")]
    big = column(spark, ["bytes=1-18446744073709551615", "bytes=1-18446744073709551616", "bytes=9-x", "bytes=0-x", "bytes=-3", "bytes=", "bytes=x-1", "bytes=99999999999999999999-1"], lambda c: X.http_range(c, F.lit(4).cast("long")))
    assert [tuple(g) for g in big] == [(1, 3, None), (None, None, "number"), (None, None, "unsatisfiable"), (None, None, "number"), (None, None, "syntax"), (None, None, "syntax"), (None, None, "number"), (None, None, "number")]
    got = column(spark, ["0-9", "bytes 5-6/10", "6-5", "x"], X.content_range)
    assert [tuple(g) for g in got] == [(0, 9), (5, 6), (None, None), (None, None)]


def test_lifecycle_boundaries(spark):
    now = 100
    assert column(spark, [None, 99, 100, 101], lambda c: X.hold_active(c, now), "long") == [True, False, False, True]
    assert column(spark, [99, 100, 101], lambda c: X.quarantine_due(c, now), "long") == [True, True, False]
    assert column(spark, [400, 401, None], lambda c: X.future(c, now), "long") == [False, True, False]
    assert column(spark, [40, 41], lambda c: X.stale(c, now, 60), "long") == [True, False]
    assert column(spark, [0, 1], lambda c: X.stale(c, now, 1000), "long") == [True, False]
    assert column(spark, [99, 100], lambda c: X.token_expired(c, now), "long") == [True, False]
    assert column(spark, [100, 101], lambda c: X.cache_live(c, now), "long") == [False, True]
    table = {(p, r, h): spark.range(1).select(X.quarantine_class(F.lit(p), F.lit(r), F.lit(h))).first()[0] for p in (False, True) for r in (False, True) for h in (False, True)}
    for (p, r, h), got in table.items():
        assert got == ("delete_missing" if not p else "delete_reachable" if r else "delete_held" if h else "keep")
    sig = spark.createDataFrame([(None, 5), (10, None), (10, 9), (10, 10)], "s long, r long").select(X.reconciled_at(F.col("s"), F.col("r"), 50).alias("x"))
    assert [r["x"] for r in sig.collect()] == [5, 50, 50, 10]


def test_arithmetic(spark):
    row = spark.range(1).select(X.range_length(F.lit(2), F.lit(9)), X.range_length(F.lit(0), F.lit(2**63 - 1)), X.saturating_sub(F.lit(3).cast("long"), F.lit(5).cast("long")), X.throughput(F.lit(10), F.lit(0)), X.throughput(F.lit(2**62), F.lit(1_000_000)), X.transfer_permits(F.lit(0), 10, 4), X.transfer_permits(F.lit(95), 10, 4), X.adaptive_default(F.lit(8), 2, 64, 256)).first()
    assert tuple(row) == (8, None, 0, 0, (2**64 - 1) // 1_000_000, 1, 4, 64)


def test_json_text_is_strict(spark):
    p = ['{"a": {"b": "x"}}', '{"a": {"b": 5}, "c": "y"}', "[", None]
    assert column(spark, p, lambda c: X.json_text(c, "$.a.b", "$.c")) == ["x", "y", None, None]


# Published vectors: input byte i is i mod 251.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}


@pytest.mark.parametrize("n", VECTORS)
def test_blake3_vectors(n):
    assert blake3_hex(bytes(i % 251 for i in range(n))) == VECTORS[n]


def test_blake3_and_signatures(spark):
    import hashlib
    import hmac

    signed = lambda secret, body: hmac.new(secret, body, hashlib.sha256).hexdigest()
    for secret in (b"k", b"long" * 40):
        cases = [(b"", "sha256=" + signed(secret, b""), True), (b"a\0\xff", signed(secret, b"a\0\xff").upper(), True), (b"x", "sha256=\xe9", False), (b"x", signed(secret, b"y"), False), (b"x", "", False), (None, "sha256=", False)]
        rows = spark.createDataFrame([(b if b is None else bytearray(b), s, ok) for b, s, ok in cases], "b binary, s string, ok boolean")
        assert rows.filter(signature_valid(F.col("b"), F.col("s"), secret) != F.col("ok")).count() == 0
    df = spark.createDataFrame([(bytearray(b""), "sha256=" + signed(b"k", b"")), (None, None), (bytearray(b"x"), "bad")], "b binary, s string")
    rows = df.select(blake3(F.col("b")).alias("h"), signature_valid(F.col("b"), F.col("s"), b"k").alias("ok")).collect()
    assert [r["h"] for r in rows] == [VECTORS[0], None, blake3_hex(b"x")] and [r["ok"] for r in rows] == [True, False, False]


def test_many_blake3_values_at_once():
    values = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 7168, 8193, 100_000)]
    assert blake3_many(values) == [blake3_hex(v) for v in values]


def test_a_digest_goes_on_from_its_stored_state():
    import hashlib

    data, digest = bytes(i % 256 for i in range(1000)), ResumableSha256()
    for at in range(0, 1000, 77):
        digest = ResumableSha256(digest.update(data[at : at + 77]).state())
    assert digest.hexdigest() == hashlib.sha256(data).hexdigest()
    assert ResumableSha256().hexdigest() == hashlib.sha256(b"").hexdigest()


def test_rates(spark):
    rows = spark.createDataFrame([(7, 2), (1 << 62, 3), (5, 0), (-1, 1)], "a long, b long")
    got = rows.select(X.throughput(F.col("a"), F.col("b")).alias("t"), X.scaling_per_mille(F.col("a"), F.lit(2), F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(3_500_000, 1750), (X.MAX_BOUND // 3, X.MAX_BOUND // 6), (0, 0), (-1_000_000, 0)]
