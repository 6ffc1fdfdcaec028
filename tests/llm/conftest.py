import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, fp string, _x string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ing", ".", ",\n"]) for _ in range(n))


def document_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text, near and exact copies, odd characters, and clashing columns."""
    texts = [prose(i, 40 + 7 * i) for i in range(24)]
    texts += [texts[3], texts[3], texts[4] + " coda", None, "", " \n\t ", "One", "Two words", "Ünïcödé ÀÉÎ ﬁ ＡＢＣ İstanbul ΣΑΣ é", "a b c\x1cd\x85e"]
    texts += ["<|endoftext|> in a <|startoftext|>text", "don't we'll I'VE 12 345 3.14 ### $$$ -- 中文字 \U0001f600 ‍", "x" * 5000, prose(99, 9000), "same line\n" * 30, "the the the " * 40]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[6], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(24)] + [(None, 1, 0), (5, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
