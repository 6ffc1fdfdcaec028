"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A token sequence is the BPE encoding of a string exactly if every neighbouring pair is compatible: encoding the two
tokens' text alone gives the two tokens back. So every prefix of a word has one last token. An automaton over the vocabulary
lists the tokens that are suffixes of each prefix; the one whose predecessor, the last token of the prefix
before it, is compatible is stored, and back-pointers give the ids. Compatibility needs no merging: a merge across
the boundary would have to join a node of the left token's right spine with a node of the right token's left spine
at a rank at which both are still whole.

Words are white-space separated pieces; each distinct one is encoded once per worker while it stays in a bounded
memo. Texts of characters outside a plain range go through the tokenizer file's own normalizer and pre-tokenizer.

Defined results: null and empty texts have no tokens and decode to the empty text; texts of any length are encoded
whole; rows are independent, so ties, repeats and empty tables need no rule. Output columns replace same-named ones.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, trim_memory

NAME = "word_bpe_49k.json"
END = "</w>"
#: Marks the end of a word inside the automaton; it is no symbol of the byte alphabet.
MARK = "\0"
#: Texts of these characters alone need no Unicode normalisation, and lower() and split() act on them as the tokenizer does.
PLAIN = "[^\\t-\\r\\x20-\\x7e\\xa1-\\u0129\\u0131-\\u0148\\u014a-\\u017f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]"
#: Entries of each of the two memos of words, and of the memo of pairs; with words of MEMO_WORD characters at most some 200 MB.
MEMO = 300_000
PAIRS = 400_000
MEMO_WORD = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}
    return [out[b] for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.text_of}
        self.text_bytes = {i: t.encode("utf-8") for i, t in self.text_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            parts.setdefault(whole, (left, right, r))
        never = len(self.rank)
        # Each spine: the node and the rank at which it is absorbed by the next larger one.
        self.right_spine, self.left_spine = {}, {}
        for t in vocab.values():
            for spines, side in ((self.right_spine, 1), (self.left_spine, 0)):
                spine, node, until = [], t, never
                while True:
                    spine.append((node, until))
                    if node not in parts:
                        break
                    until = parts[node][2]
                    node = parts[node][side]
                spines[t] = spine
        self.compatible: dict[int, bool] = {}
        self.width = max(vocab.values()) + 1
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.special.values():
                continue
            s = t[: -len(END)] + MARK if t.endswith(END) and t != END else t
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        alphabet = byte_alphabet()
        self.table = {b: alphabet[b] for b in range(256)}
        self.plain_break = regex.compile(PLAIN)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self._library = None

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of tokens a and b together are encoded as a, b."""
        key = a * self.width + b
        known = self.compatible.get(key)
        if known is None:
            rank, known = self.rank, True
            for x, x_until in self.right_spine[a]:
                for y, y_until in self.left_spine[b]:
                    r = rank.get((x, y))
                    # Equal ranks go to the leftmost pair: one inside a comes first, one inside b too late.
                    if r is not None and r < x_until and r <= y_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one pre-token in byte alphabet: the last token of each prefix, then back along the pointers."""
        n = len(symbols) + 1
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        known, width = self.compatible.get, self.width
        for end, match in self.automaton.iter(symbols + MARK):
            end += 1
            if last[end] is None:
                start = end - match[1]
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    token = before[0]
                    ok = known(token * width + match[0])
                    if not (self.fits(token, match[0]) if ok is None else ok):
                        continue
                # A token alone is the encoding of its own text: unreachable() finds no other in this file.
                last[end] = match
        ids, at = [], n
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def packed(self, pretokens: list[str]) -> tuple[bytes, bytes]:
        ids = self.word(pretokens[0]) if len(pretokens) == 1 else [i for p in pretokens for i in self.word(p)]
        return b"".join(map(self.id_bytes.__getitem__, ids)), b" ".join(map(self.text_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The tokenizer file names no decoder: tokens joined by spaces."""
        return " ".join(self.text_of[i] for i in ids)

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        found = self.old.get(chunk)
        if found is None:
            # ASCII letters are one piece, and stand for themselves in the byte alphabet.
            found = self.packed([chunk]) if chunk.isascii() and chunk.isalpha() else self.packed([p.encode("utf-8").decode("latin-1").translate(self.table) for p in self.pieces.findall(chunk)])
        if len(chunk) <= MEMO_WORD:
            if len(self.young) >= MEMO:
                self.young, self.old = {}, self.young
            self.young[chunk] = found
        return found

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def segment(self, text: str) -> list[tuple[bytes, bytes]]:
        if self.plain_break.search(text) is None:
            young = self.young.get
            return [young(c) or self.chunk(c) for c in text.lower().split()]
        lib = self.library()
        pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [self.packed([p]) for p, _ in pieces]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, and the text that they decode to."""
        if self.specials is not None and self.specials.search(text):
            parts = []
            for s in self.specials.split(text):
                if s in self.special:
                    parts.append((self.special[s].to_bytes(4, "little"), s.encode("utf-8")))
                elif s:
                    parts += self.segment(s)
        else:
            parts = self.segment(text)
        return b"".join(p[0] for p in parts), b" ".join(p[1] for p in parts if p[0]).decode("utf-8")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per running task and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """The worker waits for other tasks without the encoder and its memos."""
    _encoders.clear()
    trim_memory()


@lru_cache(maxsize=4)
def unreachable(path: str) -> tuple[str, ...]:
    """Tokens whose own text is encoded otherwise, by plain merging: with any, a prefix's last token would not be unique."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rank = {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
    special = {t["content"] for t in spec["added_tokens"]}
    out = []
    for token in spec["model"]["vocab"]:
        if token in special or token == END:
            continue
        parts = [*token[: -len(END)]] if token.endswith(END) else [*token]
        if token.endswith(END):
            parts[-1] += END
        while len(parts) > 1:
            r, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if r == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1:
            out.append(token)
    return tuple(out)


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs plus ids (binary, little-endian unsigned 32-bit) and decoded (string)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    if lost := unreachable(path):
        raise ValueError(f"{len(lost)} tokens of {path} are not the encoding of their own text, {lost[0]!r} first")

    def make():
        from stratum.llm.bpe import encoder

        enc = encoder(path)

        def run(texts: list[str], enc=enc) -> list[list]:
            out = [enc.encode(t) for t in texts]
            return [[x[0] for x in out], [x[1] for x in out]]

        return run

    fields = [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())]
    def done():
        from stratum.llm.bpe import forget

        forget()

    return map_texts(docs, text, fields, make, done=done)
