"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is one token that ends its encoding. An automaton over
the vocabulary lists the tokens that end at a position (they are suffixes of the prefix); the one
that the encoding ends with is the one whose predecessor, the last token of the prefix before it,
stays apart from it: encoding the two together gives the two. So one pass stores the last token
of each prefix, and following the back-pointers from the end gives the exact ids.

Whether two tokens stay apart is found by undoing merges at their seam, latest first: if at any
time the two inner parts have a merge that would have come before what keeps them apart, they
don't. Token ids rank merges, as in the tokenizer files.

The text of a piece is a string of byte symbols; where the file has an end-of-word suffix, the
last symbol of a piece is another symbol than the same byte inside it.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's
    own where that is printable in Latin-1, else the next of those from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE file whose normalizer is NFC, white space to
    blanks, lower case; whose pieces are contractions, runs of letters, single digits and runs of
    other signs; and whose words end with a suffix mark."""

    #: Pieces of text, as the file's pre-tokenizer has them.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
    #: Words of a worker's newer memory; when full it becomes the older one, from which words
    #: still in use move up again.
    REMEMBERED = 300_000
    #: Longer words aren't remembered, so that the memories' bytes are bounded too.
    LONG = 64

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = whole
            self.halves.setdefault(whole, pair)
        self._splits = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        # Tokens inside a word, and tokens that end one: the suffix mark is left off the latter.
        self._inner, self._ends = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t, i in vocab.items():
            last = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            text, into = (t[: -len(self.suffix)], self._ends) if last else (t, self._inner)
            into.add_word(text, (len(text), i))
        self._inner.make_automaton()
        self._ends.make_automaton()
        self._wholes = {t[: len(t) - len(self.suffix)]: i for t, i in vocab.items() if t.endswith(self.suffix)}
        self._apart: dict[int, bool] = {}
        self._symbols = _byte_symbols()
        self._known: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}

    def _seam(self, left: int, right: int) -> bool:
        """Whether the encoding of left's text followed by right's is just the two."""
        # ``before``: a merge across the seam counts only if it comes before this id. On the left
        # a later merge wins ties of place, so the right side's limit is one more than its id.
        before = 1 << 62
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and whole < before:
                return False
            parts_l, parts_r = self.halves.get(left), self.halves.get(right)
            if parts_l is None and parts_r is None:
                return True
            if parts_r is None or (parts_l is not None and left > right):
                before, left = left, parts_l[1]
            else:
                before, right = right + 1, parts_r[0]

    def _piece(self, text: str) -> list[int]:
        """Ids of a piece, given as byte symbols."""
        whole = self._wholes.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        #: For each prefix: its last token, and its length.
        last, size_of = [-1] * (n + 1), [0] * (n + 1)
        apart, seam = self._apart, self._seam
        if len(apart) > 2_000_000:
            apart.clear()
        # The automaton lists the tokens that end at a place from the longest on; only one fits.
        found = self._inner.iter(text, 0, n - 1) if self.suffix else self._inner.iter(text)
        ends = self._ends.iter(text) if self.suffix else ()
        for end, (size, token) in chain(found, ((at, x) for at, x in ends if at == n - 1)):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                fits = apart.get(pair)
                if fits is None:
                    fits = apart[pair] = seam(before, token)
                if not fits:
                    continue
            last[end], size_of[end] = token, size
        out = []
        while n > 0:
            if last[n] < 0:
                raise ValueError(f"no encoding of {text!r}")
            out.append(last[n])
            n -= size_of[n]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, their texts with a blank between)."""
        if word.isascii() and word.isprintable():
            ids = self._piece(word)
        else:
            symbols = self._symbols
            ids = self._piece("".join([symbols[b] for b in word.encode("utf-8")]))
        tokens = self.tokens
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([tokens[i] for i in ids])

    def normalise(self, text: str) -> str:
        """NFC and lower case, each character by itself (a final sigma is like others)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        if len(self._known) > self.REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        ids: list[bytes] = []
        texts: list[str] = []
        parts = self._splits.split(text or "") if self._splits else [text or ""]
        # split() gives the text between special tokens and, for each, one group per token.
        for part in parts:
            if not part:
                continue
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                texts.append(part)
                continue
            words = self.PIECES.findall(self.normalise(part))
            new = set(words).difference(known) if len(words) > 64 else {w for w in words if w not in known}
            for w in new:
                known[w] = older.get(w) or self._word(w)
            if words:
                got = [known[w] for w in words]
                ids.extend([g[0] for g in got])
                texts.extend([g[1] for g in got])
            for w in new:
                if len(w) > self.LONG:
                    del known[w]
        return b"".join(ids), " ".join(texts)

    def decode(self, ids: bytes) -> str:
        """The tokens' texts with a blank between, as the library does for a file without a
        decoder; special tokens stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def loaded(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``carry``, ids (array<int>) and decoded;
    with ``digest``, instead n_tokens, ids_sha256 and decoded_sha256.

    ``path``: the tokenizer file, at the same place on every machine. A null text is like an
    empty one: no ids. Null ids and repeated rows are kept as they are; an empty table gives an
    empty result; other columns of ``docs`` aren't read.
    """
    import hashlib

    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    names = [n for n in rows.columns if n != "text"]
    kinds = [rows.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for piece in pieces(batches):
            got = [bpe.encode(t) for t in piece.column("text").to_pylist()]
            if digest:
                more = {
                    "n_tokens": pa.array([len(a) // 4 for a, _ in got], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(a).hexdigest() for a, _ in got], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in got], pa.string()),
                }
            else:
                more = {"ids": pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in got], pa.list_(pa.int32())), "decoded": pa.array([b for _, b in got], pa.string())}
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], *more.values()], [*names, *more])

    extra = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    out = rows.mapInArrow(run, ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds, strict=True)], extra]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)], *[x.split(" ")[0] for x in extra.split(", ")])
