"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``dims`` entries +1 or -1. The trigram abc is bound as
``roll(a, 2) * roll(b, 1) * c`` (the permutation tells positions apart), a text is the bundle
(sum) of its trigrams, and a language is the bundle of its labelled texts. The language whose
prototype has the largest cosine with the text is predicted.

Letters are lower-cased; each run of other characters counts as one blank. Code points share
4,096 letter vectors (a code point beyond takes that of its lower 12 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, pieces

SLOTS = 4096
UNDETERMINED = "und"
#: Distinct trigrams bundled at once; bounds the worker's memory.
_GRAMS = 4096
#: Trigrams looked at together, of one long text or several; bounds it too.
_SEGMENT = 1 << 20

_tables: dict[tuple[int, int], np.ndarray] = {}
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def _vectors(dims: int, seed: int) -> np.ndarray:
    if (dims, seed) not in _tables:
        _tables[dims, seed] = np.random.default_rng(seed).integers(0, 2, (SLOTS, dims), dtype=np.int8) * 2 - 1
    return _tables[dims, seed]


def _slots(text: str | None) -> np.ndarray | None:
    """Letter vectors of a text, in order, as int16; 32, a blank, for each run of other characters
    and at both ends. None if it has no letter."""
    text, found = text or "", []
    for a, b in parts(text, 0, len(text), _SEGMENT):
        cp = np.frombuffer(text[a:b].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = _letters()[cp]
        found.append((np.where(own, cp & np.uint32(SLOTS - 1), 32).astype(np.int16), own))
    slot, own = map(np.concatenate, zip(*found, strict=True)) if len(found) > 1 else found[0] if found else (np.zeros(0), np.zeros(0))
    if not own.any():
        return None
    keep = np.ones(len(slot), bool)
    keep[1:] = own[1:] | own[:-1]  # one blank for each run
    slot, ends = slot[keep], own[keep]
    return np.pad(slot, (int(ends[0]), int(ends[-1])), constant_values=32)


def bundles(texts: list[str | None], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(float32 bundle of each text, whether it has a letter). A text of any length is bundled in
    segments of ``_SEGMENT`` trigrams."""
    table = _vectors(dims, seed)
    out, some = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        low, n = held[0][0], held[-1][0] - held[0][0] + 1
        grams, where = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
        owner = np.repeat([i - low for i, _ in held], [len(x) for _, x in held])
        for start in range(0, len(grams), _GRAMS):
            g = grams[start : start + _GRAMS]
            bound = np.roll(table[g >> 24], 2, axis=1) * np.roll(table[(g >> 12) & (SLOTS - 1)], 1, axis=1) * table[g & (SLOTS - 1)]
            inside = slice(None) if len(g) == len(grams) else (where >= start) & (where < start + len(g))
            count = np.bincount(owner[inside] * len(g) + where[inside] - start, minlength=n * len(g)).reshape(n, len(g))
            out[low : low + n] += count.astype(np.float32) @ bound.astype(np.float32)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        slot = _slots(text)
        if slot is None:
            continue
        some[i] = True
        for start in range(0, len(slot) - 2, _SEGMENT):
            part = slot[start : start + _SEGMENT + 2].astype(np.int64)
            held.append((i, (part[:-2] << 24) | (part[1:-1] << 12) | part[2:]))
            size += len(part) - 2
            if size >= _SEGMENT:
                add()
                size = 0
    if held:
        add()
    return out, some


@dataclass(frozen=True)
class Profiles:
    """Prototypes of unit length, one row for each language; the fitted model."""

    languages: list[str]
    prototypes: np.ndarray
    dims: int
    seed: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, cosine cut to 0..1) of each text."""
        v, some = bundles(texts, self.dims, self.seed)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        norm = np.linalg.norm(v, axis=1)
        cos = (v @ self.prototypes.T.astype(np.float32)) / np.where(norm > 0, norm, 1)[:, None]
        best = cos.argmax(axis=1)
        score = np.where(some, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0).astype(np.float64)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)], score


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dims: int = 1024, seed: int = 7, per_language: int = 5_000) -> Profiles:
    """Prototypes from about ``per_language`` labelled rows of each language: those least by a
    hash of their id, so that the choice doesn't hang on order or partitions. Rows with a null
    text or language are left out; ties between languages at prediction go to the first by name.

    Each task takes that many rows of a language at most, bundles them and sends one vector per
    language; only those come to the driver.
    """
    # The sample is cut by a hash threshold, so that no sort or window holds all rows.
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Profiles([], np.zeros((0, dims)), dims, seed)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    sample = rows.where(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40)).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in pieces(batches):
            langs = np.array(piece.column(1).to_pylist(), object)
            v, _ = bundles(piece.column(0).to_pylist(), dims, seed)
            v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]  # each text counts alike
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = sample.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    names = sorted(counts)
    proto = np.zeros((len(names), dims))
    for r in parts.collect():  # languages x dims numbers
        proto[names.index(r["lang"]), r["i"]] = r["x"]
    proto = proto.round(6)  # sums come in any order
    proto /= np.maximum(np.linalg.norm(proto, axis=1), 1e-9)[:, None]
    return Profiles(names, proto, dims, seed)


def identify(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, text_as: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``carry``, lang_pred, score; and the text as
    ``text_as``, if that is given, so that ``carry`` needn't hold it a second time.

    A text that is null, empty or without a letter gets ``und`` with score 0; ids may be null or
    repeated; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    names = [n for n in rows.columns if n != "text" or text_as]
    kinds = [rows.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            lang, score = model.predict(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", lang_pred string, score double")
    texts = [F.col("text").alias(text_as)] if text_as else []
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)], "lang_pred", "score", *texts)
