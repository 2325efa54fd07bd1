"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    block ... block | index | Bloom filter | footer

* key: 0x00 for a null id, else 0x01 and the id plus 2**63 as eight big-endian bytes, so byte
  order is id order;
* block: entries (varint bytes shared with the key before, varint bytes of key that follow, varint
  bytes of value, key bytes, value), then the block's crc32; a block starts with a whole key;
* value: 0x02 and ids of 16 bits, or 0x04 and ids of 32 bits, little-endian;
* index: for each block its first key, offset and length;
* Bloom filter: 10 bits a key, 7 probes;
* footer of fixed size: places of index and filter, counts, crc32 of index and filter, magic.

A lookup asks the filter, bisects the index and reads one block (more only where a key repeats).
Shards are cut by range of (id, hash of the text), so that even one repeated id spreads over
shards. A shard is written under a name of its own attempt, and the manifest lists the attempt
that came through: after a lost executor's task has run again, the first file is only left over.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, shared_path, written

MAGIC = b"LOOMSST1"
_FOOTER = struct.Struct("<QQQQQQI8s")
_PROBES, _BITS = 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def value_of(ids: bytes) -> bytes:
    """A shard's form of little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    return b"\4" + ids if len(wide) and wide.max() > 0xFFFF else b"\2" + wide.astype("<u2").tobytes()


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & ((1 << 64) - 1) | 1
    return [(a + k * b) % bits for k in range(_PROBES)]


class Writer:
    """Writes one shard to an open binary stream; keys must come in ascending order."""

    def __init__(self, out, block_size: int = 1 << 16) -> None:
        self.out, self.block_size = out, block_size
        self.at, self.block, self.first, self.before = 0, bytearray(), None, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = self.entries = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.add_value(doc_id, value_of(ids))

    def add_value(self, doc_id: int | None, value: bytes) -> None:
        """value: ids as a shard holds them."""
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.before, self.entries, self.tokens = key, self.entries + 1, self.tokens + (len(value) - 1) // value[0]
        if len(self.block) >= self.block_size:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        start, self.at = self.at, self.at + len(data)
        return start

    def _flush(self) -> None:
        if self.first is not None:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.first, self._put(data), len(data)))
            self.block, self.first, self.before = bytearray(), None, b""

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, len(self.keys) * _BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        a, b = self._put(index), self._put(bloom.tobytes())
        self._put(_FOOTER.pack(a, len(index), b, bits, self.entries, self.tokens, zlib.crc32(index + bloom.tobytes()), MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream, a block at a time."""

    def __init__(self, source, size: int) -> None:
        self.source, self.blocks_read = source, 0
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        a, n, b, self.bits, self.entries, self.tokens, crc, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.bloom = self._read(a, n), self._read(b, (self.bits + 7) // 8)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError("index or filter is damaged")
        self.first: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        view, at = memoryview(index), 0
        while at < len(view):
            k, at = _read_varint(view, at)
            self.first.append(bytes(view[at : at + k]))
            self.places.append(struct.unpack_from("<QQ", view, at + k))
            at += k + 16

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the shard is cut short")
        return data

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """(key, ids as little-endian 32-bit integers) of block i."""
        self.blocks_read += 1
        data = self._read(*self.places[i])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        view, at, key = memoryview(data)[:-4], 0, b""
        while at < len(view):
            shared, at = _read_varint(view, at)
            rest, at = _read_varint(view, at)
            size, at = _read_varint(view, at)
            key = key[:shared] + bytes(view[at : at + rest])
            value = view[at + rest + 1 : at + rest + size]
            yield key, bytes(value) if view[at + rest] == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.places)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each document with that id; usually one, none if there's no such."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.first)):
            if self.first[i] > key:
                break
            found += [ids for k, ids in self.block(i) if k == key]
        return found


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of the shared folder: local, HDFS or an object store."""
    return fs.FileSystem.from_uri(folder)


class Encoder:
    """The tokenizers library, remembering what it made of each piece of text.

    White space never joins or changes its neighbours in this tokenizer (its pre-tokenizer drops
    it, NFC doesn't compose across it), so chunks between blanks can be encoded apart. Where a
    text, or at least a chunk, has only letters of Latin-1 in lower case, digits and signs, it is
    cut further, into the tokenizer's own pieces. Each of those ends with a token that bears the
    end-of-word mark, so many new pieces go to the library as one text and its ids are cut apart
    at these tokens. All other chunks go to it whole.
    """

    #: Entries of the newer memory; when full it becomes the older, from which entries move up
    #: again. Longer ones than ``LONG`` characters aren't remembered, so its bytes are bounded.
    REMEMBERED, LONG = 400_000, 48
    #: Characters whose kind no version of Unicode changes, as NFC and lower case leave them.
    _PLAIN = re.compile("[\\t\\n\\r -@[-~\u00a1-\u00bf\u00df-\u00ff]*")
    _PIECES = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|'(?:[stmd]|re|ve|ll)|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\\t\\n\\r a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, end_id: int | None = None) -> None:
        """end_id: put after the ids of each text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(*vocab.values(), end_id or 0) <= 0xFFFF else 4
        self.kind, self.code = bytes([self.width]), "HI"[self.width == 4]
        self.end = b"" if end_id is None else struct.pack(f"<{self.code}", end_id)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(got.ids)}{self.code}", *got.ids) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, new: list[str]) -> list[bytes]:
        """Packed ids of each of these pieces, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or cuts[-1] != len(ids):
            return self._one_by_one(new)
        data, at, out = ids.astype(f"<u{self.width}").tobytes(), 0, []
        for cut in (cuts * self.width).tolist():
            out.append(data[at:cut])
            at = cut
        return out

    def _cut(self, text: str | None) -> list[str]:
        """The pieces and whole chunks of a text."""
        text = text or ""
        # The tokenizer lowers case itself, after NFC; doing it here only makes more pieces alike.
        # Not where Python's rules look at neighbours, nor where it could make a special token,
        # nor where NFC changes the text or its lower case (some marks compose with small letters
        # only), for then the order counts.
        special = "<|" in text
        if not special and "Σ" not in text and "İ" not in text:
            lower = text.lower()
            if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower)):
                text = lower
        plain, pieces_of = self._PLAIN.fullmatch, self._PIECES.findall
        if not special and plain(text):
            return pieces_of(text)
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            if "<|" not in chunk and plain(chunk):
                out += pieces_of(chunk)
            else:
                out.append(chunk)
        return out

    def values(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, the end id last, as a shard holds them."""
        if len(self.known) > self.REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [self._cut(text) for text in texts]
        new, whole = [], []
        for x in set().union(*cut).difference(known) if cut else ():
            had = older.get(x)
            if had is not None:
                known[x] = had
            elif "<|" not in x and self._PLAIN.fullmatch(x):
                new.append(x)
            else:
                whole.append(x)
        for part in [new[at : at + 256] for at in range(0, len(new), 256)]:
            known.update(zip(part, self._together(part), strict=True))
        if whole:
            known.update(zip(whole, self._one_by_one(whole), strict=True))
        out = [self.kind + b"".join(map(known.__getitem__, xs)) + self.end for xs in cut]
        for x in (*new, *whole):
            if len(x) > self.LONG:
                del known[x]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(x[1:], f"<u{self.width}").astype("<u4").tobytes() for x in self.values(texts)]


@cache
def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One per worker, file and end. Each task is one thread; the library's own threads stay off."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, end_id)


class Bounds:
    """Where shards end: the last (id, hash) of each but the last, ascending; nulls first. Bounds
    may be equal: then rows of that very (id, hash) are dealt over the shards that meet there."""

    def __init__(self, bounds: list[tuple[int | None, int]]) -> None:
        self.nulls = sum(i is None for i, _ in bounds)
        self.ids, self.hashes = array("q", [i or 0 for i, _ in bounds]), array("q", [h for _, h in bounds])

    @classmethod
    def of(cls, sample: DataFrame, shards: int, scratch: Scratch) -> Bounds:
        """From (_id, _h, n: rows with them) of a sample: shards of about as many sampled rows. The
        sample is sorted by ranges and summed in them and over them; the driver gets the bounds, at
        most ``shards - 1`` rows."""
        at = F.monotonically_increasing_id()
        rows = sample.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
        rows = scratch.write(rows.select("_id", "_h", "n", F.shiftright(at, 33).alias("part"), at.alias("at")), "sample")
        parts = rows.groupBy("part").agg(F.sum("n").alias("c"))
        # A row for each range of the sort.
        parts = scratch.write(parts.select("part", "c", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before")), "parts")
        total = parts.agg(F.sum("c")).first()[0]
        inside = F.sum("n").over(Window.partitionBy("part").orderBy("at"))
        upto = rows.join(F.broadcast(parts.select("part", "before")), "part").withColumn("upto", F.col("before") + inside)
        passed = lambda c: F.floor(c * shards / total)
        ends = upto.withColumn("ends", F.least(passed(F.col("upto")), F.lit(shards - 1)) - F.least(passed(F.col("upto") - F.col("n")), F.lit(shards - 1))).where("ends > 0")
        found = sorted(ends.select("_id", "_h", "ends").collect(), key=lambda r: (r["_id"] is not None, r["_id"] or 0, r["_h"]))
        scratch.drop("sample", "parts")
        return cls([(r["_id"], r["_h"]) for r in found for _ in range(r["ends"])])

    def shard(self, doc_id: int | None, h: int, deal: int) -> int:
        """The shard of a row; ``deal`` spreads rows alike in both over the shards that they fill."""
        if doc_id is None:
            lo, hi = 0, self.nulls
        else:
            lo, hi = bisect.bisect_left(self.ids, doc_id, self.nulls), bisect.bisect_right(self.ids, doc_id, self.nulls)
        lo, hi = bisect.bisect_left(self.hashes, h, lo, hi), bisect.bisect_right(self.hashes, h, lo, hi)
        return lo + deal % (hi - lo + 1) if hi - lo > 1 else lo


def write(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 1 << 20, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes and writes ``docs`` as shards in ``folder`` (a new one in the shared folder by
    default); returns the manifest (shard, file, first, last, entries, tokens; first and last id),
    a row for each shard that has documents.

    ``end_id`` ends every document. Null text: that id alone. Null ids come first; documents with
    one id go by a hash of their text. An empty table gives no shards; other columns of ``docs``
    aren't read. Texts are encoded where they are read; what is dealt out by range of (id, hash) are
    token ids. A shard takes about ``shard_bytes`` of text and ``shard_rows`` rows at most. The ranges
    come from a sample of ids and hashes, one in 512 but 4,096 at least, chosen by hash and counted, so
    a row repeated any number of times is one row of the sample; the sample stays on the executors.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    folder = folder or shared_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("text"))
    total, seen = docs.count(), Observation()
    share = float(1 << 40) * min(1.0, max(total / 512, 4_096, 32 * total / shard_rows) / max(1, total))
    sizes = rows.observe(seen, F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    counted = scratch.write(sizes.select("_id", "_h").where(F.pmod(F.xxhash64("_h", "_id"), F.lit(1 << 40)) < share).groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("n")), "counted")
    shards = max(1, -(-total // shard_rows), -(-((total and seen.get["bytes"]) or 0) // shard_bytes))
    bounds = Bounds.of(counted, shards, scratch) if shards > 1 else Bounds([])
    scratch.drop("counted")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = encoder(path, end_id), TaskContext.get().partitionId()
        for piece in pieces(batches):
            ids, hashes = piece.column("_id"), piece.column("_h")
            dealt = [bounds.shard(i, h, at + k) for k, (i, h) in enumerate(zip(ids.to_pylist(), hashes.to_pylist(), strict=True))]
            at += len(dealt)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(coder.values(piece.column("text").to_pylist()), pa.binary()), pa.array(dealt, pa.int32())], ["_id", "_h", "value", "_shard"])

    rows = rows.mapInArrow(encode, "_id bigint, _h bigint, value binary, _shard int")
    rows = rows.repartitionById(shards, "_shard").sortWithinPartitions("_id", "_h").select("_id", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = first = last = None
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            if writer is None and batch.num_rows:
                store, where = opened(folder)
                store.create_dir(where)
                out = store.open_output_stream(f"{where}/{name}")
                writer, first = Writer(out), batch.column("_id")[0].as_py()
            for doc_id, value in zip(batch.column("_id"), batch.column("value"), strict=True):
                last = doc_id.as_py()
                writer.add_value(last, value.as_py())
        if writer is not None:
            writer.close()
            out.close()
            columns = {"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{name}"], "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "entries": [writer.entries], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(columns)

    return written(rows.mapInArrow(run, "shard int, file string, first bigint, last bigint, entries bigint, tokens bigint"), "manifest")


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of the shards: shard, doc_id, start (ids of all documents before), n_tokens and
    ids (array<int>), or ids_crc32 instead of ids with ``digest``. No shards give no rows."""
    # Sums of runs of shards, then inside each run, so that no task holds all shards.
    runs = manifest.withColumn("_run", F.shiftright("shard", 10))
    sums = runs.groupBy("_run").agg(F.sum("tokens").alias("_t"))
    sums = sums.select("_run", (F.sum("_t").over(Window.orderBy("_run")) - F.col("_t")).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy("_run").orderBy("shard")) - F.col("tokens")
    starts = runs.withColumn("_inside", inside).join(F.broadcast(sums), "_run").select("shard", "file", (F.col("_before") + F.col("_inside")).alias("start"))
    spark = manifest.sparkSession
    shards = max(1, manifest.count())
    starts = starts.repartition(min(shards, max(spark.sparkContext.defaultParallelism * 4, 32)), "shard")
    last, kind = ("ids_crc32", "bigint") if digest else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, name = opened(file)
                with store.open_input_file(name) as source:
                    rows, held = [], 0
                    for doc_id, ids in Reader(source, source.size()):
                        n = len(ids) // 4
                        rows.append((doc_id, start, n, zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4").astype(np.int32)))
                        start, held = start + n, held + n
                        if len(rows) >= 512 or (held > 1_000_000 and not digest):
                            yield _rows(shard, rows, digest)
                            rows, held = [], 0
                    if rows:
                        yield _rows(shard, rows, digest)

    return starts.mapInArrow(run, f"shard int, doc_id bigint, start bigint, n_tokens bigint, {last} {kind}")


def lookup(manifest: DataFrame, ids: list[int | None]) -> DataFrame:
    """(doc_id, ids array<int>, shard, blocks) of the documents with these ids: only shards whose
    range of keys holds one of them are opened; in each, the Bloom filter is asked, the index is
    bisected and one block is read, more only where a key repeats. ``blocks``: how many of the
    shard's blocks that id took. Ids that no document has give no row; null finds null ids; an
    id asked for twice is found once. The list is the caller's, so its size bounds the plan.
    """
    kind = "doc_id bigint, ids array<int>, shard int, blocks int"
    asked = sorted({i for i in ids if i is not None})
    null = any(i is None for i in ids)
    wanted = F.array(*[F.lit(i).cast("bigint") for i in asked]) if asked else F.array().cast("array<bigint>")
    # Null ids come first in a shard; its least id isn't known then.
    hit = F.exists(wanted, lambda x: ((F.col("first") <= x) | F.col("first").isNull()) & (x <= F.col("last")))
    rows = manifest.where((F.col("first").isNull() if null else F.lit(False)) | F.coalesce(hit, F.lit(False))).select("shard", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, name = opened(file)
                with store.open_input_file(name) as source:
                    reader = Reader(source, source.size())
                    for doc_id in [*([None] if null else []), *asked]:
                        before = reader.blocks_read
                        for found in reader.get(doc_id):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([doc_id], pa.int64()), pa.array([np.frombuffer(found, "<u4").astype(np.int32)], pa.list_(pa.int32())), pa.array([shard], pa.int32()), pa.array([reader.blocks_read - before], pa.int32())],
                                ["doc_id", "ids", "shard", "blocks"],
                            )

    return rows.mapInArrow(run, kind)


def _rows(shard: int, rows: list, digest: bool) -> pa.RecordBatch:
    ids, start, n, x = zip(*rows, strict=True)
    columns = [pa.array([shard] * len(rows), pa.int32()), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.int64() if digest else pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
