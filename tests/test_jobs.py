"""Jobs on literal inputs with literal results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stratum.functions import expr as X
from stratum.operators import chunking, fsck, gc, inventory, plan, protocols, reach, rebuild, repair, state
from stratum.plans import job_queries
from stratum.sources import tables
from stratum.streaming import events as ev

T = "file_id string, pos long, hash string, offset long, length long, range_start long, range_end long, packed_start long, packed_end long"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def terms(spark, rows):
    return frame(spark, rows, T)


def three(file="f"):
    return [(file, i, sha(bytes([i])), 4 * i, 4, 0, 1, 0, 4) for i in range(3)]


def test_chunks_and_digest(spark):
    files = frame(spark, [("f", bytearray(b"aaaabbbbcccc")), ("g", bytearray(b"aaaab")), ("e", bytearray(b""))], "file_id string, content binary")
    chunks = chunking.chunk_content(files, 4)
    rows = sorted(map(tuple, chunks.select("file_id", "idx", "offset", "length", "hash").collect()))
    assert rows[:3] == [("f", i, 4 * i, 4, sha(c)) for i, c in enumerate((b"aaaa", b"bbbb", b"cccc"))]
    assert rows[3:] == [("g", 0, 0, 4, sha(b"aaaa")), ("g", 1, 4, 1, sha(b"b"))]
    assert sorted(map(tuple, chunking.chunk_content_with(files, "sha256", 4).select("file_id", "idx", "offset", "length", "hash").collect())) == rows
    digest = dict(map(tuple, chunking.content_digest(chunks, "file_id", F.sum("length"), 4).collect()))
    body = (12).to_bytes(8, "little") + (4).to_bytes(8, "little") + b"".join(sha(c).encode() + (4 * i).to_bytes(8, "little") + (4).to_bytes(8, "little") for i, c in enumerate((b"aaaa", b"bbbb", b"cccc")))
    assert digest["f"] == sha(body)
    acc = {r["file_id"]: tuple(r)[1:] for r in chunking.upload_accounting(chunks.select("file_id", "idx", "length", "hash"), "file_id", ("idx",)).collect()}
    assert acc["f"] == (3, 3, 0, 12, 12) and acc["g"] == (2, 1, 1, 5, 1)


@pytest.mark.parametrize(
    "at,change,issue",
    [(1, {"hash": "zz"}, "invalid_content_hash"), (1, {"length": 0}, "empty_chunk"), (1, {"offset": 5}, "non_contiguous_chunks"), (2, {"range_end": 0}, "invalid_chunk_range"), (2, {"packed_end": 0}, "invalid_packed_range"), (2, {"length": 9}, "total_bytes_mismatch")],
)
def test_plan_validation(spark, at, change, issue):
    names = [c.split()[0] for c in T.split(", ")]
    rows = [dict(zip(names, r)) for r in three()]
    rows[at] |= change
    files = frame(spark, [("f", 12), ("empty", 0), ("lost", 1)], "file_id string, total_bytes long")
    got = {r["file_id"]: r["issue"] for r in plan.validate(terms(spark, [tuple(r[n] for n in names) for r in rows]), files).collect()}
    assert got == {"f": issue, "lost": "total_bytes_mismatch"}


def test_ranged_plans(spark):
    asked = frame(spark, [("f", 2, 9), ("f", 11, 12), ("f", 4, 4), ("none", 0, 0)], "file_id string, start long, end long")
    got = {(r["file_id"], r["start"]): r for r in plan.ranged_plan(terms(spark, three()), asked).collect()}
    assert (got["f", 2]["terms"], got["f", 2]["offset_into_first_range"]) == (3, 2)
    assert got["f", 11]["unsatisfiable"] and got["none", 0]["unsatisfiable"]
    assert (got["f", 4]["first_pos"], got["f", 4]["last_pos"], got["f", 4]["offset_into_first_range"]) == (1, 1, 0)


def test_fetch_lists(spark):
    two = terms(spark, three("f")[:1] + three("f")[:1] + three("g")[:1])
    assert [len(r["entries"]) for r in plan.fetch_info(two).collect()] == [1, 1]
    entry = plan.fetch_info(two).first()["entries"][0]
    assert (entry["byte_start"], entry["byte_end"], entry["chunk_start"], entry["chunk_end"]) == (0, 3, 0, 1)
    merged = plan.batch_fetch_info(two, frame(spark, [("g", 0), ("f", 1), ("missing", 2)], "file_id string, position long"))
    assert [len(r["entries"]) for r in merged.collect()] == [2]


def test_assembly_and_packed_ranges(spark):
    objects = frame(spark, [(sha(bytes([i])), bytearray(bytes([i]) * 4)) for i in range(3)], "hash string, content binary")
    assert bytes(plan.assemble(terms(spark, three()), objects).first()["content"]) == b"\0\0\0\0\1\1\1\1\2\2\2\2"
    with pytest.raises(Exception, match="missing or short"):
        plan.assemble(terms(spark, three()), objects.limit(2)).collect()
    members = frame(spark, [("x", 0, 10), ("x", 1, 25), ("x", 2, 40)], "xorb_hash string, idx long, packed_end long")
    segments = frame(spark, [("x", 0, 2), ("x", 1, 3)], "xorb_hash string, range_start long, range_end long")
    assert sorted((r["range_start"], r["packed_start"], r["packed_end"]) for r in plan.packed_ranges(segments, members).collect()) == [(0, 0, 25), (1, 10, 40)]


def gc_inputs(spark):
    live = [X.chunk_key, [sha(c) for c in (b"aaaa", b"bbbb", b"cccc")]]
    keys = [f"{h[:2]}/{h}" for h in live[1]]
    orphan = "de" + "0" * 62
    objects = frame(spark, [(k, 4) for k in keys] + [(f"de/{orphan}", 6), ("protocols/lfs/x", 9)], "key string, length long")
    records = frame(spark, [("latest",), ("version",)], "record_kind string")
    referenced = frame(spark, [(k,) for k in keys], "key string")
    quarantine = spark.createDataFrame([], tables.SCHEMAS["quarantine_candidates"])
    holds = spark.createDataFrame([], tables.SCHEMAS["retention_holds"])
    return objects, records, referenced, quarantine, holds, f"de/{orphan}"


def test_gc_modes_and_fixed_point(spark):
    objects, records, referenced, q, holds, orphan = gc_inputs(spark)
    dry = gc.collect(objects, records, referenced, q, holds, 1000, 3600).report.first().asDict()
    assert dry == {"scanned_records": 2, "referenced_chunks": 3, "orphan_chunks": 1, "orphan_bytes": 6, "new_candidates": 0, "retained_candidates": 0, "deleted_chunks": 0, "deleted_bytes": 0, "active_candidates": 0, "released_candidates": 0}
    marked = gc.collect(objects, records, referenced, q, holds, 1000, 3600, do_mark=True)
    r = marked.report.first()
    assert (r["new_candidates"], r["active_candidates"], r["deleted_chunks"]) == (1, 1, 0)
    again = gc.collect(objects, records, referenced, marked.quarantine, holds, 1001, 3600, do_mark=True)
    assert again.quarantine.collect() == marked.quarantine.collect() and again.report.first()["retained_candidates"] == 1
    early = gc.collect(objects, records, referenced, marked.quarantine, holds, 4599, 3600, do_sweep=True).report.first()
    assert early["deleted_chunks"] == 0
    due = gc.collect(objects, records, referenced, marked.quarantine, holds, 4600, 3600, do_sweep=True)
    assert (due.report.first()["deleted_chunks"], due.report.first()["deleted_bytes"], due.report.first()["active_candidates"]) == (1, 6, 0)
    assert [x["object_key"] for x in due.deleted.collect()] == [orphan]
    kept = gc.collect(objects, records, referenced, q, frame(spark, [(orphan, "r", 1, None)], tables.SCHEMAS["retention_holds"]), 1000, 3600, do_mark=True).report.first()
    assert kept["orphan_chunks"] == 0


def test_gc_gate_fails_closed(spark):
    objects, records, referenced, q, holds, orphan = gc_inputs(spark)
    Q, H = tables.SCHEMAS["quarantine_candidates"], tables.SCHEMAS["retention_holds"]
    for quarantine, hold in (([("gone", 6, 1, 2)], []), ([(orphan, 7, 1, 2)], []), ([(orphan, 6, 3, 2)], []), ([], [("gone", "r", 1, None)]), ([(orphan, 6, 1, 2)], [(orphan, "r", 1, None)])):
        with pytest.raises(state.Violation):
            gc.collect(objects, records, referenced, frame(spark, quarantine, Q), frame(spark, hold, H), 1000, 10)
    with pytest.raises(state.Violation):
        gc.managed(frame(spark, [("ab/abc", 1)], "key string, length long"))


def test_reachability_variants(spark):
    a, b, c, x = (sha(v) for v in (b"a", b"b", b"c", b"x"))
    t = frame(spark, [(a, True, 0, 1), (x, False, 0, 1)], "hash string, chunked boolean, range_start long, range_end long")
    members = frame(spark, [(x, 0, b), (x, 1, c)], "xorb_hash string, idx long, chunk_hash string")
    mappings = frame(spark, [(a, "shard-a"), (c, "shard-c")], "chunk_hash string, shard_object_key string")
    objects = frame(spark, [(f"xorbs/default/{a[:2]}/{a}.xorb",)], "key string")
    keys = {v: {r["key"] for r in reach.reachable_keys(t, members, mappings, objects, v).collect()} for v in ("gc", "repair", "fsck")}
    assert keys["gc"] - keys["repair"] == {"shard-c"} and keys["repair"] - keys["fsck"] == {f"{c[:2]}/{c}"}
    assert f"xorbs/default/{a[:2]}/{a}.xorb" in keys["fsck"] and "shard-a" in keys["fsck"]


def test_fsck_kinds(spark):
    a, b = sha(b"a"), sha(b"b")
    key = lambda h: f"{h[:2]}/{h}"
    R = "record_key string, file_id string, content_hash string, total_bytes long, expected_key string, record_bytes long, parsed boolean"
    records = frame(spark, [("big", "f", a, 0, "big", 2**30 + 1, True), ("json", None, None, 0, None, 5, False), ("bad", "a/b", "zz", 0, "other", 5, True), ("ok", "f", a, 4, "ok", 5, True)], R)
    computed = frame(spark, [("ok", b)], "record_key string, digest string")
    kinds = sorted(r["kind"] for r in fsck.record_issues(records, computed).collect())
    assert kinds == ["invalid_content_hash", "invalid_file_id", "invalid_record_json", "oversized_record_metadata", "record_hash_mismatch", "record_path_mismatch"]
    t = frame(spark, [("r1", 0, a, True, 4, 0, 1), ("r2", 0, a, True, 5, 0, 1), ("r3", 0, b, True, 4, 0, 1), ("x1", 0, b, False, 9, 0, 3)], "record_key string, pos long, hash string, chunked boolean, length long, range_start long, range_end long")
    members = frame(spark, [(b, 0, a, 4), (b, 1, b, 4)], "xorb_hash string, idx long, chunk_hash string, length long")
    objects = frame(spark, [(key(a), 4, b), (f"xorbs/default/{b[:2]}/{b}.xorb", 8, None)], "key string, length long, body_hash string")
    none = frame(spark, [], "location string")
    got = sorted((r["kind"], r["location"]) for r in fsck.term_issues(t, none, objects, members).collect())
    assert got == sorted([("chunk_hash_mismatch", "r1"), ("chunk_hash_mismatch", "r2"), ("chunk_length_mismatch", "r2"), ("missing_chunk", "r3"), ("chunk_hash_mismatch", "x1"), ("missing_chunk", "x1"), ("chunk_length_mismatch", "x1"), ("chunk_length_mismatch", "x1")])
    mappings = frame(spark, [(a, "gone"), (a, "bad"), (a, "s"), (b, "s")], "chunk_hash string, shard_object_key string")
    shards = frame(spark, [("bad",), ("s",)], "key string")
    got = sorted(r["kind"] for r in fsck.shard_issues(mappings, shards, frame(spark, [("s", a)], "shard_key string, chunk_hash string"), frame(spark, [("bad",)], "shard_key string")).collect())
    assert got == ["invalid_dedupe_shard_mapping", "invalid_retained_shard", "missing_dedupe_shard_object"]
    rec = frame(spark, [("e", []), ("m", [(a,), (b,), (b,)])], "file_id string, terms array<struct<object_hash: string>>")
    got = sorted(r["kind"] for r in fsck.reconstruction_issues(rec, frame(spark, [(a,)], "object_hash string")).collect())
    assert got == ["empty_reconstruction", "missing_reconstruction_xorb", "missing_reconstruction_xorb"]


def test_fsck_lifecycle(spark):
    now = 1000
    q = frame(spark, [("k", 4, 5, 1), ("gone", 4, 1, 2), ("k2", 9, 1, 2)], tables.SCHEMAS["quarantine_candidates"])
    h = frame(spark, [("k", "r", 5, 1), ("lost", "r", 1, None), ("k2", "r", 1, 2000)], tables.SCHEMAS["retention_holds"])
    d = frame(spark, [("p", "o", "r", "late", 1301), ("p", "o", "r", "fine", 1300)], tables.SCHEMAS["webhook_deliveries"])
    s = frame(spark, [("p", "", "r", 1301, None, None, 5000, None, None)], tables.SCHEMAS["provider_repository_states"])
    objects = frame(spark, [("k", 4), ("k2", 4)], "key string, length long")
    got = sorted(r["kind"] for r in fsck.lifecycle_issues(q, h, d, s, objects, frame(spark, [("k",)], "key string"), now).collect())
    assert got == sorted(["invalid_quarantine_candidate", "missing_quarantined_object", "quarantine_length_mismatch", "reachable_quarantined_object", "invalid_retention_hold", "missing_held_object", "held_quarantined_object", "invalid_webhook_delivery_timestamp", "invalid_provider_repository_state", "invalid_provider_repository_state_timestamp", "invalid_provider_repository_state_timestamp"])


def test_rebuild(spark):
    V = "record_key string, file_id string, content_hash string, modified long, record_bytes long, parsed boolean, scope struct<owner: string, name: string>, expected_key string, plan_issue string"
    a, b = sha(b"a"), sha(b"b")
    good = [("1", "f", a, 1, 9, True, None, "1", None), ("2", "f", b, 1, 9, True, None, "2", None), ("3", "g", a, 5, 9, True, None, "3", None)]
    latest = frame(spark, [("g", a), ("old", a), ("f", a)], "file_id string, content_hash string")
    no = frame(spark, [], "kind string, location string")
    members = frame(spark, [("s2", a), ("s1", a)], "shard_key string, chunk_hash string")
    mappings = frame(spark, [(a, "s2"), (b, "s9")], "chunk_hash string, shard_object_key string")
    recs = frame(spark, [("f",), ("ghost",)], "file_id string")
    out = rebuild.rebuild(frame(spark, good, V), latest, members, no, mappings, recs, ["file_id"], ["modified", "content_hash"])
    assert {r["file_id"]: r["content_hash"] for r in out.latest.collect()} == {"f": max(a, b), "g": a}
    assert [r["file_id"] for r in out.stale_reconstructions.collect()] == ["ghost"]
    r = out.report.first().asDict()
    assert (r["rebuilt_latest"] + r["unchanged_latest"], r["removed_latest"], r["rebuilt_mappings"], r["removed_mappings"], r["issues"]) == (2, 1, 1, 1, 0)
    again = rebuild.rebuild(frame(spark, good, V), out.latest.select("file_id", "content_hash"), members, no, out.mappings, recs, ["file_id"], ["modified", "content_hash"]).report.first()
    assert (again["rebuilt_latest"], again["removed_latest"], again["rebuilt_mappings"], again["removed_mappings"]) == (0, 0, 0, 0)
    bad = frame(spark, [*good, ("4", "a/b", a, 1, 9, True, None, "4", None)], V)
    broken = rebuild.rebuild(bad, latest, members, frame(spark, [("invalid_retained_shard", "s")], "kind string, location string"), mappings, recs, ["file_id"], ["modified"])
    assert broken.stale_reconstructions.count() == 0 and broken.mappings.count() == 2 and broken.issues.count() == 2


def test_repair_uses_surviving_holds(spark):
    h = frame(spark, [("a", "r", 1, None), ("b", "r", 1, 10), ("gone", "r", 1, None)], tables.SCHEMAS["retention_holds"])
    q = frame(spark, [("a", 1, 1, 2), ("b", 1, 1, 2), ("c", 1, 1, 2), ("gone", 1, 1, 2)], tables.SCHEMAS["quarantine_candidates"])
    d = frame(spark, [("p", "o", "r", "1", 5)], tables.SCHEMAS["webhook_deliveries"])
    objects = frame(spark, [("a",), ("b",), ("c",)], "key string")
    out = repair.repair(h, q, d, objects, frame(spark, [("c",)], "key string"), 100)
    assert [r["object_key"] for r in out.holds.collect()] == ["a"] and [r["object_key"] for r in out.quarantine.collect()] == ["b"]
    again = repair.repair(out.holds, out.quarantine, out.deliveries, objects, frame(spark, [("c",)], "key string"), 100)
    assert {r["class"] for r in again.classes.collect()} == {"keep"}


def test_state(spark):
    old = frame(spark, [("a", 1), (None, 2)], "k string, v long")
    new = frame(spark, [("a", 5, 1), ("a", 6, 2), (None, 7, 1), ("b", 8, 1)], "k string, v long, at long")
    assert sorted(map(tuple, state.upsert(old, new, ["k"], "at").collect()), key=str) == sorted([("a", 6), (None, 7), ("b", 8)], key=str)
    assert sorted((r["k"], r["inserted"]) for r in state.insert_or_ignore(old, frame(spark, [("a",), ("c",), ("c",)], "k string"), ["k"]).collect()) == [("a", False), ("c", True)]
    assert [r["k"] for r in state.delete(old, frame(spark, [("a",), ("z",)], "k string"), "k").collect()] == [None]
    r = "record_kind string, scope_key string, file_id string, content_hash string"
    out = state.commit_versions(frame(spark, [("latest", "s", "f", "1"), ("version", "s", "f", "1")], r), frame(spark, [("", "s", "f", "2")], r))
    assert sorted(map(tuple, out.collect())) == [("latest", "s", "f", "2"), ("version", "s", "f", "1"), ("version", "s", "f", "2")]


def test_events(spark):
    hooks = [
        ("github", "push", "1", {"ref": "refs/heads/main", "repository": {"full_name": "o/r"}}),
        ("github", "repository", "2", {"action": "renamed", "repository": {"full_name": "o/new"}, "changes": {"repository": {"name": {"from": "old"}}}}),
        ("github", "repository", "3", {"action": "deleted", "repository": {"full_name": "o/r"}}),
        ("gitlab", "Push Hook", "4", {"ref": "refs/tags/v1", "project": {"path_with_namespace": "g/p"}}),
        ("github", "ping", "5", {"repository": {"full_name": "o/r"}}),
    ]
    raw = frame(spark, [(a, b, c, json.dumps(p)) for a, b, c, p in hooks], "provider string, event string, delivery_id string, payload string")
    got = {r["delivery_id"]: (r["owner"], r["repo"], r["kind"], r["revision"], r["new_repo"]) for r in ev.normalise(raw).collect()}
    assert got == {"1": ("o", "r", "revision_pushed", "main", None), "2": ("o", "old", "repository_renamed", None, "new"), "3": ("o", "r", "repository_deleted", None, None), "4": ("g", "p", "revision_pushed", "v1", None)}
    E = "provider string, owner string, repo string, delivery_id string, arrival long, at long, kind string, revision string"
    batch = frame(spark, [("p", "o", "r", "1", 1, 10, "revision_pushed", "a"), ("p", "o", "r", "1", 2, 99, "revision_pushed", "z"), ("p", "o", "r", "2", 3, 5, "revision_pushed", None), ("p", "o", "r", "3", 4, 7, "access_changed", None)], E)
    new = ev.claim(batch)
    assert sorted(r["arrival"] for r in new.collect()) == [1, 3, 4]
    prior = frame(spark, [("p", "o", "r", 1, 2, "old", 3, None, None), ("p", "x", "y", 1, None, None, None, None, None)], tables.SCHEMAS["provider_repository_states"])
    merged = {r["owner"]: tuple(r)[3:7] for r in ev.merge_state(prior, ev.fold(new)).collect()}
    assert merged == {"o": (7, 5, "a", 3), "x": (1, None, None, None)}


def test_stream_equals_batch(spark, tmp_path):
    E = "provider string, owner string, repo string, delivery_id string, arrival long, at long, kind string, revision string"
    rows = [("p", "o", f"r{i % 3}", str(i % 20), i, 100 + i, "revision_pushed" if i % 2 else "access_changed", f"v{i}") for i in range(40)]
    for k in range(2):
        frame(spark, rows[k * 20 : k * 20 + 20], E).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    empty = spark.createDataFrame([], tables.SCHEMAS["provider_repository_states"])
    box = {"state": empty, "claims": spark.createDataFrame([], tables.SCHEMAS["webhook_deliveries"])}

    def write(new_state, claims, number):
        root = tables.write_snapshot({"s": new_state, "c": claims}, str(tmp_path / f"out{number}"))
        box["state"], box["claims"] = spark.read.parquet(f"{root}/s"), spark.read.parquet(f"{root}/c")

    source = spark.readStream.schema(E).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ev.run_state(source, lambda: box["state"], lambda: box["claims"], write, str(tmp_path / "ck")).awaitTermination()
    batch = ev.merge_state(empty, ev.fold(ev.claim(frame(spark, rows, E))))
    cols = ["repo", *ev.STATE]
    assert sorted(map(tuple, box["state"].select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert box["claims"].count() == ev.claim(frame(spark, rows, E)).count()


def test_deletion_and_rename(spark):
    R = "record_key string, provider string, owner string, repo string, record_kind string, file_id string, content_hash string, body string"
    rows = [("1", "p", "o", "r", "version", "f", "a", "x"), ("2", "p", "o", "r", "version", "f", "b", "y"), ("3", "p", "o", "other", "version", "f", "c", "z")]
    t = frame(spark, [("1", "h1"), ("1", "h2"), ("2", "h2"), ("2", "h3"), ("3", "h9")], "record_key string, hash string")
    records = frame(spark, rows, R)
    out = ev.deleted_repository(records, t, frame(spark, [("p", "o", "r")], "provider string, owner string, repo string"), 10, lambda h: [X.chunk_key(h), X.xorb_key(h)])
    i = out["impact"].first()
    assert (i["versions"], i["chunks"], i["holds"]) == (2, 3, 6) and out["holds"].count() == 6 and out["records"].count() == 1
    ren = frame(spark, [("p", "o", "r", "o", "n")], "provider string, owner string, repo string, new_owner string, new_repo string")
    moved = ev.renamed_repository(records, ren)
    assert sorted((r["repo"], r["record_kind"], r["content_hash"]) for r in moved.collect()) == [("n", "latest", "b"), ("n", "version", "a"), ("n", "version", "b"), ("other", "version", "c")]
    with pytest.raises(state.Violation):
        ev.renamed_repository(records.union(frame(spark, [("9", "p", "o", "n", "version", "f", "a", "other")], R)), ren)


def test_inventory(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one").write_bytes(b"1234")
    (tmp_path / "a/b/two").write_bytes(b"12")
    files = tables.file_inventory(spark, str(tmp_path))
    assert sorted((r["key"], r["length"]) for r in files.collect()) == [("a/b/two", 2), ("a/one", 4)]
    objects = frame(spark, [(f"p/{i:02d}", i) for i in range(10)] + [("p/x/deep", 1), ("q/1", 1)], "key string, length long")
    assert [r["key"] for r in inventory.page(objects, "p/", "p/02", 3).collect()] == ["p/03", "p/04", "p/05", "p/06"]
    content = tables.file_contents(spark, str(tmp_path))
    assert bytes(inventory.read_range(content.filter("key = 'a/one'"), 1, 2).first()["content"]) == b"23"
    with pytest.raises(Exception, match="range past"):
        inventory.read_range(content, 0, 3).collect()
    inventory.write_backup({"files": files}, files, str(tmp_path / "backup"))
    assert {r["table"]: r["rows"] for r in spark.read.json(str(tmp_path / "backup/counts")).collect()} == {"files": 2, "objects": 2}


def test_record_json(spark):
    good = {"file_id": "f", "content_hash": "h", "total_bytes": 4, "chunk_size": 4, "chunks": [{"hash": "x", "offset": 0, "length": 4}]}
    raw = frame(spark, [("1", json.dumps(good)), ("2", "{"), ("3", None)], "record_key string, record string")
    parsed = tables.parse_records(raw)
    assert {r["record_key"]: bool(r["parsed"]) for r in parsed.select("record_key", F.coalesce("parsed", F.lit(False)).alias("parsed")).collect()} == {"1": True, "2": False, "3": False}
    t = tables.record_terms(parsed).first()
    assert (t["range_start"], t["range_end"], t["packed_start"], t["packed_end"], t["chunked"]) == (0, 1, 0, 0, True)


def test_protocols(spark):
    have = frame(spark, [("a",), ("a",)], "oid string")
    asked = frame(spark, [("a", 1), ("b", 2)], "oid string, size long")
    assert {r["oid"]: r["action"] for r in protocols.lfs_batch(asked, have, "download").collect()} == {"a": "download", "b": "missing"}
    assert {r["oid"]: r["action"] for r in protocols.lfs_batch(asked, have, "upload").collect()} == {"a": "skip", "b": "upload"}
    tags = frame(spark, [("r", "t1", "d1"), ("r", "t2", "d2")], "repository string, tag string, digest string")
    moved = protocols.move_tags(tags, frame(spark, [("r", "t1", "d2"), ("r", "t3", "d1")], "repository string, tag string, digest string"))
    assert sorted((r["tag"], r["digest"]) for r in moved.collect()) == [("t1", "d2"), ("t2", "d2"), ("t3", "d1")]
    left = protocols.delete_manifests(moved, frame(spark, [("r", "d1", "t1"), ("r", "d1", "t3")], "repository string, digest string, tag string"), frame(spark, [("r", "d1")], "repository string, digest string"))
    assert sorted(r["tag"] for r in left.collect()) == ["t1", "t2"]
    assert [r["tag"] for r in protocols.tag_page(tags, "r", "t1", 5).collect()] == ["t2"]
    m = frame(spark, [("r", "m", ["b1", "b2"])], "repository string, digest string, descriptors array<string>")
    assert [r["missing"] for r in protocols.missing_descriptors(m, frame(spark, [("r", "b1")], "repository string, digest string")).collect()] == ["b2"]


def test_composite_jobs(spark, tmp_path):
    from stratum.operators import jobs

    files = frame(spark, [("f", bytearray(b"aaaabbbbaaaa")), ("g", bytearray(b"bbbb"))], "file_id string, content binary")
    empty = spark.createDataFrame([], tables.SCHEMAS["objects"])
    out = jobs.ingest(files, empty, 4)
    from stratum.functions.hashing import blake3_hex

    assert sorted(r["checksum"] for r in out.objects.collect()) == sorted([blake3_hex(b"aaaa"), blake3_hex(b"bbbb")])
    assert jobs.ingest(files, out.objects, 4).objects.count() == 0
    body = b"".join(blake3_hex(c).encode() + at.to_bytes(8, "little") + (4).to_bytes(8, "little") for at, c in ((0, b"aaaa"), (4, b"bbbb"), (8, b"aaaa")))
    digest = blake3_hex((12).to_bytes(8, "little") + (4).to_bytes(8, "little") + body)
    assert {r["file_id"]: r["content_hash"] for r in out.records.collect()}["f"] == digest
    plain = jobs.ingest(files, empty, 4, hasher="sha256")
    assert sorted(r["checksum"] for r in plain.objects.collect()) == sorted([sha(b"aaaa"), sha(b"bbbb")])
    assert sorted(map(tuple, plain.report.collect())) == sorted(map(tuple, out.report.collect()))
    tables.black_hole(out.chunks)
    members = frame(spark, [("x", 0, 0, 10, 0, 16), ("x", 1, 10, 25, 16, 32)], "xorb_hash string, idx long, packed_start long, packed_end long, unpacked_start long, unpacked_end long")
    assert jobs.packed_is_monotonic(members).count() == 0
    segments = frame(spark, [("s", "f", 0, "x", 0, 2)], "shard_hash string, file_id string, pos long, xorb_hash string, range_start long, range_end long")
    known = spark.createDataFrame([], "shard_hash string")
    terms_, mappings, shards = jobs.register_shards(segments, members, frame(spark, [("s", "c")], "shard_hash string, chunk_hash string"), known)
    assert (terms_.first()["packed_start"], terms_.first()["packed_end"], shards.first()["inserted"]) == (0, 25, True)
    with pytest.raises(state.Violation):
        jobs.register_shards(segments.withColumn("range_end", F.lit(9).cast("long")), members, mappings.withColumn("shard_hash", F.lit("s")), known)
    holds = jobs.set_holds(spark.createDataFrame([], tables.SCHEMAS["retention_holds"]), frame(spark, [("k", "why", None), ("l", "why", 5)], "object_key string, reason string, ttl long"), 10)
    assert sorted((r["object_key"], r["release_after"]) for r in holds.collect()) == [("k", None), ("l", 15)]
    assert [r["object_key"] for r in jobs.list_holds(holds, 15, True).collect()] == ["k"] and jobs.release_holds(holds, holds).count() == 0
    put, copies = jobs.digest_put(empty, frame(spark, [("d", 3, "a"), ("d", 3, "b")], "digest string, length long, scope string"), F.concat(F.lit("shared/"), "digest"), F.concat("scope", F.lit("/"), "digest"))
    assert put.count() == 1 and sorted(r["key"] for r in copies.collect()) == ["a/d", "b/d"]
    bad = jobs.verify_objects(frame(spark, [(f"ab/{'ab' + '0' * 62}", "x"), ("protocols/lfs/x", "y")], "key string, body_hash string"))
    assert bad.count() == 1
    q = frame(spark, [("a", None, None, ["lfs"]), ("download", None, "sha512", None), ("upload", None, None, ["basic"])], "op string, objects array<string>, algo string, transfers array<string>")
    assert [r["i"] for r in q.select(jobs.lfs_request_issue(F.col("op"), F.col("objects"), F.col("algo"), F.col("transfers")).alias("i")).collect()] == ["operation", "hash_algo", None]
    root = tables.write_snapshot({"objects": out.objects}, str(tmp_path / "snap"))
    assert tables.current_snapshot(spark, str(tmp_path / "snap")) == root and tables.table(spark, root, "objects").count() == 2


def test_claims_of_a_stream(spark, tmp_path):
    """Repeats are dropped within a batch and across batches, with and without a bound on the state."""
    E = "provider string, owner string, repo string, delivery_id string, arrival long, ts timestamp"
    from datetime import datetime, timedelta

    rows = [("p", "o", "r", str(i % 7), i, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(20)]
    for k in range(2):
        frame(spark, rows[k * 10 : k * 10 + 10], E).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for name, time in (("all", None), ("bounded", "ts")):
        source = spark.readStream.schema(E).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sink = str(tmp_path / name)
        ev.claims_stream(source, time).writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-ck").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(sink).count() == 7


def test_repeats_in_one_batch(spark, tmp_path):
    """What a store with one writer at a time would have refused or ordered is refused or ordered in a batch."""
    O, R = "key string, length long, checksum string", "record_kind string, scope_key string, file_id string, content_hash string, body string"
    empty = spark.createDataFrame([], O)
    put = state.put_if_absent(empty, frame(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("b", 1, "x"), ("c", 1, None), ("c", 2, None)], O))
    assert {r["key"]: r["outcome"] for r in put.collect()} == {"a": "conflict", "b": "inserted", "c": "conflict"}
    with pytest.raises(state.Violation):
        state.upsert(empty, frame(spark, [("a", 1, "x"), ("a", 2, "x")], O), ["key"])
    new = frame(spark, [("s", "f", "h1", "one", 1), ("s", "f", "h2", "two", 3), ("s", "f", "h3", "three", 2), ("s", "f", "h2", "two", 2)], "scope_key string, file_id string, content_hash string, body string, at long")
    old = frame(spark, [("latest", "s", "f", "h0", "zero"), ("version", "s", "f", "h0", "zero"), ("latest", "s", "g", "h9", "nine")], R)
    after = sorted(tuple(r) for r in state.commit_versions(old, new, "at").select("record_kind", "file_id", "content_hash", "body").collect())
    assert after == [("latest", "f", "h2", "two"), ("latest", "g", "h9", "nine"), ("version", "f", "h0", "zero"), ("version", "f", "h1", "one"), ("version", "f", "h2", "two"), ("version", "f", "h3", "three")]
    with pytest.raises(state.Violation):
        state.commit_versions(old, new.drop("at"))


def test_hard_caps(spark):
    ids = spark.range(1025).select(F.col("id").alias("file_id"), F.col("id").alias("position"))
    with pytest.raises(state.Violation):
        plan.batch_fetch_info(spark.createDataFrame([], "file_id long, hash string, pos long, range_start long, range_end long, packed_start long, packed_end long"), ids)
    objects = spark.range(1025).select(F.lit("b").alias("batch"), F.col("id").alias("oid"))
    with pytest.raises(state.Violation):
        protocols.lfs_batch(objects, objects, "download")
    assert protocols.lfs_batch(objects.limit(1024), objects, "download").count() == 1024
    for call in (lambda: protocols.tag_page(objects, "r", None, 129), lambda: inventory.page(objects, "", None, 257)):
        with pytest.raises(ValueError):
            call()


def test_cache_loads_what_is_missing(spark):
    from stratum.operators import jobs

    E = "key string, payload string, expires_at long"
    entries = frame(spark, [("a", "old", 50), ("b", "late", 5), ("c", None, 50), ("d", "d", 40)], E)
    load = lambda k: k.select("key", F.concat(F.lit("new "), "key").alias("payload"))
    answers, after = jobs.get_or_load(entries, frame(spark, [(k,) for k in "abcea"], "key string"), load, 10, capacity=4)
    assert sorted(map(tuple, answers.collect())) == [("a", "old", True), ("b", "new b", False), ("c", "new c", False), ("e", "new e", False)]
    assert sorted((r["key"], r["expires_at"]) for r in after.collect()) == [("a", 50), ("b", 40), ("c", 40), ("d", 40)]


def test_large_files_stay_in_parts(spark, monkeypatch):
    from stratum.operators import jobs

    monkeypatch.setattr(plan, "MAX_CELL", 6)
    terms = frame(spark, [("f", 0, sha(b"aaaa"), 4), ("f", 1, sha(b"bb"), 2), ("f", 2, sha(b"aaaa"), 4), ("g", 0, sha(b"bb"), 2)], "file_id string, pos long, hash string, length long")
    objects = frame(spark, [(sha(b"aaaa"), bytearray(b"aaaa")), (sha(b"bb"), bytearray(b"bb"))], "hash string, content binary")
    with pytest.raises(state.Violation):
        plan.assemble(terms, objects)
    parts = plan.file_parts(terms, objects)
    assert sorted((r["file_id"], r["pos"], bytes(r["content"])) for r in parts.collect()) == [("f", 0, b"aaaa"), ("f", 1, b"bb"), ("f", 2, b"aaaa"), ("g", 0, b"bb")]
    assert {r["file_id"]: r["sha256"] for r in jobs.running_state(parts, "file_id").collect()} == {"f": sha(b"aaaabbaaaa"), "g": sha(b"bb")}
    with pytest.raises(Exception, match="missing or short object"):
        plan.file_parts(terms, objects.limit(1)).collect()


def test_digests_go_on_in_the_next_session(spark):
    from stratum.operators import jobs

    P = "id string, pos long, content binary"
    none = spark.createDataFrame([], "id string, state binary")
    first = jobs.resume_digests(none, frame(spark, [("a", 0, bytearray(b"x" * 100)), ("a", 1, bytearray(b"y")), ("b", 0, bytearray(b""))], P), "id")
    kept = spark.createDataFrame([tuple(r) for r in first.select("id", "state").collect()], "id string, state binary")
    last = jobs.resume_digests(kept, frame(spark, [("a", 2, bytearray(b"z" * 70)), ("c", 0, bytearray(b"c"))], P), "id")
    assert {r["id"]: r["sha256"] for r in last.collect()} == {"a": sha(b"x" * 100 + b"y" + b"z" * 70), "b": sha(b""), "c": sha(b"c")}


def test_state_and_claims_are_stored_together(spark, tmp_path):
    """A batch that fails between claim and apply leaves nothing, and one that comes again changes nothing."""
    E = "provider string, owner string, repo string, delivery_id string, arrival long, at long, kind string, revision string"
    state_, claims = (spark.createDataFrame([], s) for s in ("provider string, owner string, repo string, last_access_changed_at long, last_revision_pushed_at long, last_pushed_revision string", "provider string, owner string, repo string, delivery_id string, processed_at long"))
    read, read_claims, write = ev.snapshot_store(spark, str(tmp_path / "s"), state_, claims)
    frame(spark, [("p", "o", "r", "1", 1, 10, "revision_pushed", "a"), ("p", "o", "r", "1", 2, 11, "revision_pushed", "b")], E).coalesce(1).write.parquet(str(tmp_path / "in/0"))

    def run(writer, name):
        source = spark.readStream.schema(E).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ev.run_state(source, read, read_claims, writer, str(tmp_path / name)).awaitTermination()

    def broken(*_):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(broken, "ck")
    assert read().count() == 0 and read_claims().count() == 0
    run(write, "ck")
    run(write, "ck-again")
    assert [r["last_pushed_revision"] for r in read().collect()] == ["a"] and read_claims().count() == 1


def test_impact_of_a_repository_without_terms(spark):
    records = frame(spark, [("k", "p", "o", "r", "version")], "record_key string, provider string, owner string, repo string, record_kind string")
    out = ev.deleted_repository(records, spark.createDataFrame([], "record_key string, hash string"), records, 5, lambda h: [h, h])
    assert tuple(out["impact"].select("versions", "chunks", "holds").first()) == (1, 0, 0)


def test_fsck_never_broadcasts_what_grows(spark, monkeypatch):
    """However small the planner takes a side to be: at 60 times sf0.1 the objects, taken for a few MB, filled the driver."""
    plans, stored = [], fsck.tables.stored
    monkeypatch.setattr(fsck.tables, "stored", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or stored(df, name))
    job_queries.fsck_issues(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 3 and "SortMergeJoin" in plans[2]
    broadcast = [line for line in plans[2].splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in broadcast if "BroadcastHashJoin [record_key" not in line]  # the inputs' own join
