"""The driver's contract, with or without the corpus operators."""

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert all(callable(q) for q in queries.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "chunks", "inserted", "reused", "total_bytes", "stored_bytes"] and df.count() > 0


def test_storage_queries_run(spark):
    """Schemas are stable over the smallest tables; values are compared with SQL by the driver."""
    from stratum.plans.queries import QUERIES

    for name in ("orphan_objects", "head_version", "scope_namespace", "http_ranges", "webhook_dedupe"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1, name


def run_copy(tmp_path, code, *left_out):
    """Runs code in a copy of the tree without some of its folders and files."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in left_out:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)


def test_without_the_corpus_operators(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and len(q) > 90 and set(e.oracle_sql()) <= set(q)"
    out = run_copy(tmp_path, code, "stratum/llm", "tests/llm", "corpus_pipeline.py")
    assert out.returncode == 0, out.stderr


def test_errors_inside_the_corpus_operators_show(tmp_path):
    code = "open('corpus_pipeline.py', 'a').write('import a_package_that_is_not_there'); import __spark_entry__"
    out = run_copy(tmp_path, code)
    assert out.returncode and ("a_package_that_is_not_there" in out.stderr or not __import__("pathlib").Path("corpus_pipeline.py").exists())


def test_queries_equal_their_sql(spark):
    """Some of each module over the smallest tables; the driver compares all of them."""
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("gc_report", "reachable_keys", "batch_reconstruction", "record_parse", "commit_batch", "put_conflicts", "hold_upsert", "webhook_signatures", "name_validators", "transfer_arithmetic", "shard_commit", "gate_refusals", "cap_refusals", "rebuild_report", "fsck_issues", "streamed_claims", "cache_answers", "resumed_uploads"):
        got, expected = queries[name](spark, d), con.execute(sql[name])
        columns = sorted(got.columns)
        names = [x[0] for x in expected.description]
        assert sorted(names) == columns, name
        a = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
        b = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in expected.fetchall())
        assert a == b, name


def test_blake3_ingest(spark):
    from stratum.functions.hashing import blake3_hex

    texts = {r[0]: r[1].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in entry.queries()["blake3_ingest"](spark, "/root/testdata/sf0.001").collect():
        data = texts[r["doc_id"]]
        cuts = range(0, len(data), 1024)
        body = b"".join(blake3_hex(data[a : a + 1024]).encode() + a.to_bytes(8, "little") + len(data[a : a + 1024]).to_bytes(8, "little") for a in cuts)
        assert r["content_hash"] == blake3_hex(len(data).to_bytes(8, "little") + (1024).to_bytes(8, "little") + body)
