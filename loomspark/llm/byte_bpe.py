"""Byte-level BPE by overlapping chunks, and decoding.

The pattern of a byte-level vocabulary cuts a text into pre-tokens, each encoded by itself, and
scans from left to right: what it does from a place on hangs on the text behind that place only.
So a long text is cut into chunks that overlap, tasks pre-tokenise them at the same time, and where
two neighbours have a boundary at the same place of their overlap they agree from there on. The
text is cut at the first such place of each overlap, and tasks encode the pieces between cuts.

Two things make this exact. The last two characters of a chunk may be cut otherwise than in the
whole text, so no boundary after them counts. And a chunk that begins inside a pre-token may start
wrongly: its boundaries count for the next one only if it has passed a place that every scan cuts,
such as a letter before a blank. Where an overlap has no common boundary (a run of one kind of
character that is longer), there is no cut, and the piece goes on to the next one.

A pre-token's ids are found by merging neighbours of the least rank, leftmost first. Decoding puts
the tokens' bytes one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, pieces

#: Fixed value: the pattern that goes with the public rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places that every scan cuts which began before them: no pre-token has both characters.
CERTAIN = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|[^\s\p{L}\p{N}](?=[\s\p{N}])")
#: What a match may look at behind its end.
AHEAD = 2
#: Letters and numbers that the regular expressions here know and those of the public
#: library, whose tables are of Unicode 16, don't: code points in hexadecimal, alone or from-to.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686
16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""
_NEWER = re.compile("[" + "".join(["-".join([chr(int(c, 16)) for c in x.split("-")]) for x in NEWER.split()]) + "]")


def judged(text: str) -> str:
    """The text as the pattern sees it: newer letters and numbers are signs there. Same length."""
    if text.isascii():
        return text
    try:
        text.encode("latin-1")  # by far the quickest look at most texts
    except UnicodeEncodeError:
        return _NEWER.sub("\ue000", text)
    return text


class Merges:
    """Merging by ranks: ids of bytes, and of each pair of ids that merges, the id of their union."""

    #: Longer pieces are merged with a heap.
    SHORT, NONE = 96, 1 << 60

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes, self.pairs = ranks, [ranks.get(bytes([i])) for i in range(256)], {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 24 | b] = rank

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the neighbours whose union has the least rank are merged, leftmost
        first, until no union has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.bytes[x] for x in piece]
        return self._short(ids) if len(ids) <= self.SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, none = self.pairs.get, self.NONE
        ranks = [get(a << 24 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = best
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(best << 24 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | best, none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same in ``n * log(n)`` steps: neighbours in a heap by rank and place."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            # A neighbour that has changed since has another id.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, None
            after[i] = further = after[j]
            if further < n:
                before[further] = i
                if (r := get(rank << 24 | ids[further])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[further]))
            if (first := before[i]) >= 0 and (r := get(ids[first] << 24 | rank)) is not None:
                heapq.heappush(heap, (r, first, ids[first], rank))
        return [x for x in ids if x is not None]


class Memory(dict):
    """What ``make`` gives for a key, remembered: when ``most`` keys are held, they become the older
    ones, from which those still in use move up again. Keys longer than ``longest`` aren't
    remembered, so the bytes are bounded too."""

    def __init__(self, make: Callable[[str], tuple], most: int, longest: int) -> None:
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str) -> tuple:
        found = self.older.get(key) or self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class ByteBpe:
    """Encoder and decoder of a rank file: lines of a token in base 64 and its rank."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.small = max(self.tokens) < 1 << 16
        self.pattern = regex.compile(pattern)
        self.merge = Merges(self.ranks)
        self._known = Memory(self._word, 300_000, 64)

    def _word(self, word: str) -> tuple[bytes, str, bytes]:
        ids, tokens = self.merge(word.encode()), self.tokens
        return struct.pack(f"<{len(ids)}I", *ids), " " + " ".join(map(str, ids)), b"".join([tokens[i] for i in ids])

    def _words(self, text: str) -> list[tuple[bytes, str, bytes]]:
        """Of each pre-token: ids as little-endian 32-bit integers, ids with a blank before each,
        the bytes that the ids decode to."""
        seen = judged(text)
        words = self.pattern.findall(text) if seen is text or seen == text else [text[m.start() : m.end()] for m in self.pattern.finditer(seen)]
        return list(map(self._known.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, or of a piece that begins and ends at a boundary, as little-endian
        unsigned 32-bit integers."""
        return b"".join([g[0] for g in self._words(text or "")])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and of the bytes that they decode to."""
        got = self._words(text or "")
        ids = "".join(map(itemgetter(1), got))
        return ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(b"".join(map(itemgetter(2), got))).hexdigest()

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes, one after the other. An id without a token is an error."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def narrow(self, ids: bytes) -> bytes:
        """The same ids as 16-bit integers, if all of the vocabulary's fit."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.small else ids

    def wide(self, ids: bytes) -> bytes:
        """The inverse of ``narrow``."""
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.small else ids

    def marks(self, text: str, chunk: int, overlap: int) -> tuple[list[int], list[int], bool]:
        """Of a chunk with its overlap: the boundaries at its start and those at its end that count,
        from the chunk's first character on; whether the latter hold without the chunk before."""
        text = judged(text)
        ends = [m.end() for m in self.pattern.finditer(text)]
        head = [e for e in ends if e <= overlap - AHEAD]
        tail = [e for e in ends if chunk < e <= len(text) - AHEAD]
        return head, tail, CERTAIN.search(text, 0, chunk) is not None


@cache
def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker and file."""
    return ByteBpe(path, pattern)


CHUNKS = "key string, k bigint, text string"


def chunks_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, text) of ``texts`` (key, text): overlapping chunks, those of equal keys once. They are
    cut where the texts are read, so a long text moves once, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in pieces(batches):
            for key, text in zip(one.column("key").to_pylist(), one.column("text").to_pylist(), strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array([text[s : s + chunk + overlap] for s in some])], ["key", "k", "text"])

    return texts.mapInArrow(run, CHUNKS).groupBy("key", "k").agg(F.first("text").alias("text"))


def with_marks(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``chunks`` with head, tail and sure, as ``ByteBpe.marks`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for one in pieces(batches):
            got = [bpe.marks(t, chunk, overlap) for t in one.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*one.columns, *[pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (0, 1)], pa.array([g[2] for g in got], pa.bool_())], ["key", "k", "text", "head", "tail", "sure"])

    return chunks.mapInArrow(run, f"{CHUNKS}, head array<bigint>, tail array<bigint>, sure boolean")


def stitched(marks: DataFrame, chunk: int) -> DataFrame:
    """(key, k, lo, hi, piece, alone) of chunks with marks: the part of each chunk that is its own,
    which piece it belongs to (named by its first chunk) and whether it is all of that piece. Neighbours
    are cut at the first boundary that both have; without one, the piece goes on."""
    before = marks.where("k = 0 or sure").select("key", (F.col("k") + 1).alias("k"), F.transform("tail", lambda e: e - chunk).alias("tail"))
    start = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("tail", "head")))
    rows = marks.select("key", "k", "head").join(before, ["key", "k"], "left").select("key", "k", start.alias("start"))
    by = Window.partitionBy("key").orderBy("k")
    first = F.max(F.when(F.col("start").isNotNull(), F.col("k"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after, following = F.lead("start").over(by), F.lead("k").over(by)
    # The last chunk goes to its end; one whose successor doesn't begin a piece, up to that.
    hi = F.when(following.isNotNull(), chunk + F.coalesce(after, F.lit(0)))
    rows = rows.select("key", "k", F.coalesce("start", F.lit(0)).alias("lo"), hi.alias("hi"), first.alias("piece"), (F.col("start").isNotNull() & (following.isNull() | after.isNotNull())).alias("alone"))
    return rows


def _long_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int, scratch: Scratch) -> DataFrame:
    """(key, parts) of ``texts`` (key, text): the ids of the pieces, in order, as 32-bit integers
    (16-bit ones where the vocabulary allows)."""
    held = scratch.write(with_marks(chunks_of(texts, chunk, overlap), path, pattern, chunk, overlap), "chunks")
    ranges = scratch.write(stitched(held.select("key", "k", "head", "tail", "sure"), chunk), "ranges")
    own = F.struct("k", F.expr("substring(text, cast(lo as int) + 1, cast(coalesce(hi - lo, length(text)) as int))").alias("text"))
    # Ranges grow with the texts, so the join is the same at every size: by sorting, without a broadcast.
    parts = held.select(*[x.split(" ")[0] for x in CHUNKS.split(", ")]).join(ranges.hint("merge"), ["key", "k"])
    single = parts.where("alone").select("key", "piece", own["text"].alias("text"))
    several = parts.where("not alone").groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), "").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for one in pieces(batches):
            yield pa.RecordBatch.from_arrays([one.column("key"), one.column("piece"), pa.array([bpe.narrow(bpe.encode(t)) for t in one.column("text").to_pylist()], pa.binary())], ["key", "piece", "ids"])

    ids = single.unionByName(several).mapInArrow(encoded, "key string, piece bigint, ids binary")
    return ids.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("parts"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, pattern: str = PATTERN, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, ids (array<int>) and decoded (binary, the bytes that the
    ids decode to); with ``digest``, instead n_tokens, ids_sha256 (of the decimal ids with a blank
    between) and decoded_sha256.

    ``path``: the rank file, at the same place on every machine. Texts longer than a chunk and its
    overlap go through chunks, equal ones once; a shorter text is one piece. A null text is like
    an empty one: no ids. Null ids and repeated rows are kept as they are; an empty table gives an
    empty result; other columns of ``docs`` aren't read.
    """
    if not 2 * AHEAD < overlap <= chunk:
        raise ValueError("the overlap must be longer than what a match looks at, and no longer than a chunk")
    extra = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, names = rows.schema["id"].dataType.simpleString(), [x.split(" ")[0] for x in extra.split(", ")]
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap

    def columns(got: list[tuple[int, str, str]] | list[bytes], bpe: ByteBpe) -> list[pa.Array]:
        if digest:
            return [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return [pa.array([np.frombuffer(g, "<i4") for g in got], pa.list_(pa.int32())), pa.array([bpe.decode(g) for g in got], pa.binary())]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for one in pieces(batches):
            texts = one.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([one.column("id"), *columns([bpe.digests(t) if digest else bpe.encode(t) for t in texts], bpe)], ["id", *names])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = bpe.wide(b"".join(batch.column("parts")[i].as_py()))
                numbers = " ".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode() if digest else b""
                got = (len(ids) // 4, hashlib.sha256(numbers).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()) if digest else ids
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), *columns([got], bpe)], ["key", *names])

    scratch = Scratch(docs.sparkSession)
    plain = rows.where(~is_long).mapInArrow(short, f"id {kind}, {extra}")
    keyed = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    whole = scratch.write(_long_ids(keyed.select("key", "text"), path, pattern, chunk, overlap, scratch).mapInArrow(gathered, f"key string, {extra}"), "whole")
    scratch.drop("chunks", "ranges")
    out = plain.unionByName(keyed.select("id", "key").join(whole, "key").drop("key"))
    return out.select(F.col("id").alias(id_col), *names)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "bytes", pattern: str = PATTERN) -> DataFrame:
    """``rows`` with the column ``into`` (binary): the bytes of the tokens, one after the other;
    null for null, empty for no ids. Bytes of a part of a text may end inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            found = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, into])

    kept = rows.select(*[c for c in rows.columns if c != into])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, BinaryType())]))
