"""Token counts: batches balanced by bytes go to the tokenizer, only lengths come back.

Long texts are cut at safe boundaries: before a single space between two letters. The pre-tokenizer's pattern starts a
new piece there whatever stands around it, so the counts of the parts add up to the count of the whole. Plain
texts use the fast encoder of the same vocabulary; texts with rarer characters, very long runs without a break or
special strings use the library of the tokenizer file itself. Both give the same ids.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; rows are
independent, so ties, repeats and empty tables need no rule. Output columns replace same-named ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

NAME = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
LIMIT = 512

#: Between two words of any script that one space parts, and before the punctuation of scripts without spaces: no piece of the
#: pre-tokenizer goes across either.
_CUT = re.compile("(?<=[^\\W_])(?= [^\\W_])|(?<=[^\\W\\d_])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
_UNUSUAL = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\u024f\\u0391-\\u03a9\\u03b1-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]|<\\||\\S{2000}|\\s{2000}")


def safe_parts(text: str, size: int = PIECE) -> list[str]:
    """Parts of a text whose token counts add up to that of the text; about ``size`` characters where a safe boundary allows."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


class Counter:
    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain: list[tuple[int, str]] = []
        other: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            for part in safe_parts(t):
                if self.fast is not None and not _UNUSUAL.search(part):
                    plain.append((i, part))
                else:
                    other.append((i, part))
        if other:
            for (i, _), found in zip(other, self.library.encode_batch([p for _, p in other], add_special_tokens=False)):
                out[i] += len(found.ids)
        if plain:
            for (i, _), ids in zip(plain, self.fast.encode_ordinary_batch([p for _, p in plain], num_threads=1)):
                out[i] += len(ids)
        return out


_counters: dict[tuple, Counter] = {}


def counter(path: str, ranks: str | None, pattern: str | None) -> Counter:
    if (path, ranks) not in _counters:
        _counters[path, ranks] = Counter(path, ranks, pattern)
    return _counters[path, ranks]


def token_counts(docs: DataFrame, path: str | None = None, ranks: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs plus n_bytes, n_tokens (long) and over_limit. path and ranks: the tokenizer file, and the same vocabulary as ranks."""
    pattern = None
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path(NAME), public_tokenizers.path(RANKS)
    if ranks:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def make():
        from stratum.llm.tokencount import counter

        c = counter(path, ranks, pattern)

        def run(texts: list[str]) -> list[list]:
            n = c.counts(texts)
            return [[len(t.encode("utf-8")) for t in texts], n, [x > limit for x in n]]

        return run

    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64()), ("over_limit", T.BooleanType(), pa.bool_())]
    return map_texts(docs, text, fields, make, budget=1 << 20)
