"""URL filter, WARC archives and page text."""

import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from stratum.llm import htmltext, urlfilter, warc

PAGES = "page_id long, url string, html string, text string, host string, payload string"


def page_rows():
    rng = random.Random(2)
    body = lambda n: "".join(rng.choice("abcdefgh <>é\n") for _ in range(n))
    big, small = body(5000), body(50)
    rows = [(1, "http://a.org/x", big), (2, "http://b.com/de/1", big), (3, "u", small), (4, "u", small), (5, None, None), (6, "", ""), (7, "http://c.com\r\n", body(999)), (7, "http://c.com", body(999)), (9, "x", big), (9, "x", big), (None, "x", big), (11, "y", "é" * 500), (12, "y", "é" * 500), (13, "z", body(3_000_000))]
    return [(*r, "t", "h", "p") for r in rows] + [(100 + i, f"http://h{i}.net/", body(rng.randrange(3000)), "t", "h", "p") for i in range(40)]


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    rows = page_rows()
    monkeypatch.setattr(warc, "MEMBER", 1 << 20)
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages, str(tmp_path / "w"))
    first = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            first[html] = max(first.get(html, i), i)
    expected = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        ref = first.get(html)
        again = ref is not None and ref != i
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", ref if again else None))
    for split in (997, 1 << 16, warc.SPLIT):
        got = warc.read_archives(spark, str(tmp_path / "w"), split=split, payloads=True).collect()
        assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, expected))
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {r[2] or "" for r in rows}
    # Any gzip reader sees whole records.
    data = b"".join(gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes())).read() for f in sorted(Path(tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC-Record-ID:") >= len(rows)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_a_member_that_only_looks_like_a_record():
    class Memory(io.BytesIO):
        pass

    good = warc.members(warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None))
    fake = warc.members(b"no record at all")
    data = good + fake + b"\x1f\x8b\x08garbage" + good
    f = warc.Ranged(Memory(data), len(data), block=16)
    got = list(warc.records(f, 0, len(data)))
    assert len(got) == 2 and all(block.endswith(b"abc") for _, block in got)
    assert len(list(warc.records(warc.Ranged(Memory(data), len(data)), 1, len(data)))) == 1


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://Blog.Example.ORG/es/x?y#z", "blog.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://casino.example.org/fr/", "casino.example.org", "/fr/", "org/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://myorg/x", "myorg", "/x", None, "allow"),
        ("http://a.net?casino", "a.net", "", None, "block"),
        ("http://casinos-royal.net/", "casinos-royal.net", "/", None, "block"),
        ("http://scasino.net/", "scasino.net", "/", None, "allow"),
        ("http://free.net/", "free.net", "/", None, "allow"),
        ("http://free.net/free/free", "free.net", "/free/free", None, "allow"),
        ("HTTP://FREE-bets.net", "free-bets.net", "", None, "block"),
        ("casino", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = urlfilter.url_filter(spark.createDataFrame([(1, url, None, "t", "h", "p")], PAGES)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["text"]) == (host, path, rule, verdict, "t")


def test_columns_that_clash_and_a_vocabulary_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/Jetzt-xyz", "x", "y")], "page_id long, url string, _u_url string, _U_bad string")
    strict, soft = urlfilter.vocabulary(spark.createDataFrame([("XYZ", True), ("xyz", False), ("jetzt", None), (None, True), ("", True)], "term string, strict boolean"))
    assert (strict, soft) == (["xyz"], ["jetzt"])
    r = urlfilter.url_filter(pages, strict=strict, soft=soft).first()
    assert (r["_u_url"], r["_U_bad"], r["verdict"]) == ("x", "y", "block")
    assert urlfilter.url_filter(pages, strict=[], soft=soft).first()["verdict"] == "allow"
    with pytest.raises(ValueError):
        urlfilter.vocabulary(spark.createDataFrame([("a", True), ("b", True)], "term string, strict boolean"), 1)


def test_every_url_gets_a_verdict(spark):
    pages = spark.createDataFrame(page_rows(), PAGES)
    assert urlfilter.url_filter(pages).count() == pages.count() and urlfilter.url_filter(pages.limit(0)).count() == 0


P = "A long enough sentence that stands for the text of the article and says what there is to say."
CASES = [
    (f"<nav><a href=x>Home</a> | <a href=y>About</a></nav><article><h1>Title</h1><p>{P}<p>Short.</article><footer>Us</footer>", f"Title {P} Short."),
    (f"<article><p>a&amp;b &lt;i&gt; x&nbsp;&nbsp;y<br>z</p><div class='ad'>{P}</div><form>{P}</form></article>", "a&b <i> x y z"),
    (f"<body><header>{P}</header><main><p>{P} <a href=z>link</a></p></main><aside>{P}</aside><div id='comments'><p>{P}</p></div>", f"{P} link"),
    (f"<script>var a = '<p>{P}</p>';</script><style>p{{}}</style><!-- {P} --><article><p>{P}", P),
    (f"<article><p>one</p><section class='reader-comments'><article><p>{P}</p></article></section><p>two</p></article>", "one two"),
    (f"<div class=cookie-banner>{P}</div><div><p>{P}</p><p>{P}</p></div>", f"{P} {P}"),
    (f"<article><p title='a > b'>{P}</p><p>cut <b off", f"{P} cut"),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
]


def test_page_text(spark):
    pages = spark.createDataFrame([(i, "u", h, "old", "h", "p") for i, (h, _) in enumerate(CASES)], PAGES)
    out = htmltext.extract(pages)
    assert out.columns == ["page_id", "url", "html", "host", "payload", "text", "n_chars"]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[i] == (expected, len(expected)), i
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_held_out_pages(spark):
    """Accuracy on the driver's pages, none of which trained the tree: the article's text, word for word."""
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in htmltext.extract(rows).collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        assert r["text"] == " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


def splits(tree):
    return {htmltext.FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3]) if isinstance(tree, tuple) else set()


def held_out_blocks(seed, pages=60):
    """Pages without telling names or articles: (features, label) of their blocks, of other lengths than the labelled ones."""
    rng = random.Random(seed)
    for _ in range(pages):
        html, labels = "", []

        def add(piece, label):
            nonlocal html
            html += piece
            labels.extend(label)

        add(htmltext._a(*(rng.randint(1, 4) for _ in range(rng.randint(2, 6)))), [])
        labels.extend([0] * html.count("<li>"))
        if rng.random() < 0.5:
            add(htmltext._d(rng.randint(10, 19)), [0])
            add(htmltext._a(1, 2), [0, 0])
        add(htmltext._p(rng.randint(20, 40)), [1])
        for _ in range(rng.randint(1, 4)):
            add(htmltext._p(rng.randint(3, 12), rng.randint(20, 40)), [1, 1])
        add(htmltext._a(*(rng.randint(2, 15) for _ in range(3))), [0] * 3)
        if rng.random() < 0.5:
            add(htmltext._d(rng.randint(3, 14)), [0])
        yield from zip(htmltext.features(htmltext.candidates(html)), labels, strict=True)


def test_the_tree_decides_by_neighbours():
    """Words and link density of neighbours are split on, and without them held-out pages are judged clearly worse."""
    tree = htmltext.train()
    used = splits(tree)
    assert len({f for f in used if "before" in f or "after" in f}) >= 2 and any("link density" in f for f in used)
    rows = list(held_out_blocks(1))
    right = sum(htmltext.verdict(tree, x) == bool(y) for x, y in rows) / len(rows)
    alone = lambda x: (x[0], x[1], 0.0, 0.0, 0.0, 0.0, x[6], x[7])
    labelled = []
    for html, labels in (*htmltext.LABELLED, *htmltext.composed()):
        labelled += [(alone(x), int(y)) for x, y in zip(htmltext.features(htmltext.candidates(html)), labels.replace(" ", ""), strict=True)]
    blind = htmltext.grow(labelled)
    worse = sum(htmltext.verdict(blind, alone(x)) == bool(y) for x, y in rows) / len(rows)
    print(sorted(used), right, worse)
    assert right >= 0.95 and worse <= right - 0.03


def test_pages_without_telling_names():
    tree = htmltext.train()
    menu = "<div><a href=/1>Home</a> <a href=/2>World</a></div><div><a href=/3>Sports</a></div>"
    page = f"<div>{menu}</div><div><div>{P} {P}</div><div>A short caption</div><div>{P} {P}</div></div><div><a href=/4>Next story</a></div><div><a href=/5>And another</a></div><div>All rights ours</div>"
    assert htmltext.main_text(page, tree) == f"{P} {P} A short caption {P} {P}"


def test_words_of_links_are_counted_after_decoding():
    (block,) = htmltext.blocks("<p><a href=x>a&nbsp;b</a><a href=y>c</a> d</p>")
    assert block[:3] == ("a bc d", 3, 3)


def test_long_pages_are_read_whole():
    html = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert htmltext.main_text(html, htmltext.train()) == " ".join([P] * 20_000)
