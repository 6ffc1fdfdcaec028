"""Encoding and counting against the tokenizers library, row by row."""

import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratum.llm import bpe, tokencount

from .conftest import document_rows, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def check(library, text):
    ids, decoded = bpe.encoder(WORD).encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected, repr(text[:80])
    assert decoded == library.decode(expected, skip_special_tokens=False)


def test_encoder_equals_library(library):
    for row in document_rows():
        check(library, row[1] or "")


def test_encoder_on_random_letters(library):
    rng = random.Random(1)
    for n in range(1500):
        check(library, "".join(rng.choice("aaabcdeeehinorstt'é ßł") for _ in range(rng.randint(1, 24))))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    check(Tokenizer.from_file(WORD) if not hasattr(test_encoder_on_any_text, "t") else test_encoder_on_any_text.t, text)


test_encoder_on_any_text.t = Tokenizer.from_file(WORD)


def test_bpe_rows(spark, docs, no_docs, library):
    out = bpe.encode_decode(docs)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert struct.pack(f"<{len(expected)}I", *expected) == bytes(r["ids"])
        assert r["decoded"] == library.decode(expected, skip_special_tokens=False)
    assert bpe.encode_decode(no_docs).count() == 0


COUNTER = None


def counts(texts):
    global COUNTER
    COUNTER = COUNTER or tokencount.Counter(BYTE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return COUNTER.counts(texts)


def test_counts_equal_library(docs, no_docs):
    t = Tokenizer.from_file(BYTE)
    texts = [r[1] or "" for r in document_rows()]
    assert counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    rows = tokencount.token_counts(docs).collect()
    for r in rows:
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert tokencount.token_counts(no_docs).count() == 0


BYTES = Tokenizer.from_file(BYTE)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abz AZ09.,'\"\n\t   é́s t<|>中\U0001f600\x85"), max_size=60) | st.text(max_size=40))
def test_counts_on_any_text(text):
    assert counts([text]) == [len(BYTES.encode(text, add_special_tokens=False).ids)]


def test_safe_parts_add_up():
    text = prose(5, 6000) + "  two  spaces \n\n and it's 12 more words " * 200
    parts = tokencount.safe_parts(text, 500)
    assert "".join(parts) == text and len(parts) > 20
    assert sum(counts(parts)) == counts([text])[0] == len(BYTES.encode(text, add_special_tokens=False).ids)


def test_every_token_is_the_encoding_of_its_own_text(tmp_path):
    import json

    path = public_tokenizers.path(bpe.NAME)
    assert bpe.unreachable(path) == ()
    spec = json.load(open(path, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][1:]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert bpe.unreachable(str(tmp_path / "t.json"))


@pytest.mark.parametrize("alphabet", ["абвгд ежз, и. ", "αβγδ ε'ζ η 12 ", "中文字，很长。没有空格", "한국 어 텍스트 ", "²³ 1 2²3 Ⅷ x ", "a\u0301 e\u0308, "])
def test_long_texts_of_any_script_are_cut_where_nothing_changes(alphabet):
    rng = random.Random(alphabet)
    text = "".join(rng.choice(alphabet) for _ in range(6000))
    parts = tokencount.safe_parts(text, 500)
    assert len(parts) > 5 and "".join(parts) == text
    whole = Tokenizer.from_file(BYTE)
    assert sum(len(whole.encode(p, add_special_tokens=False).ids) for p in parts) == len(whole.encode(text, add_special_tokens=False).ids)
