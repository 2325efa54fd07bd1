"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model on the words of a sentence gives its
probability p of being toxic; the document's is the noisy-or ``1 - prod(1 - p)``. Only labels of
documents are known: the likelihood of those, through the noisy-or, trains the sentence model,
and the model then says which sentences of a document offend.

Sentences end at ``.``, ``!``, ``?``, ``;``, ``|`` or a line end. Words are runs of letters,
lower-cased. A word counts as itself and by its first four and six letters, so that inflected and
compound forms share evidence; these features are hashed into 2**18 slots, and a sentence has a
slot or hasn't. A text may be of any length: sentences are scored some at a time, and a long one is
lower-cased in parts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, pieces, written

SLOTS = 1 << 18
#: A slot in so large a share of the toxic rows, and in so many of them, may have a weight.
SHARE, FLOOR = 0.02, 3
#: Sentences of a text that are scored together, and characters of one that are lower-cased
#: together; they bound a worker's memory.
_SENTENCES, _PART = 1 << 16, 1 << 18
_SENTENCE = re.compile(r"[^.!?;|\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def _slots(word: str) -> list[int]:
    forms = [word, *[f"^{word[:k]}" for k in (4, 6) if len(word) > k]]
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for f in forms]


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) in characters of each sentence."""
    return (m.span() for m in _SENTENCE.finditer(text or ""))


def _words(text: str, start: int, end: int) -> Iterator[set[str]]:
    """The words of a sentence, lower-cased; where it is long, those of one part after the other."""
    return (set(_WORD.findall(text[a:b].lower())) for a, b in parts(text, start, end, _PART))


@dataclass(frozen=True)
class Model:
    """Weights by slot (only those that aren't 0) and the bias of a sentence.

    A word's features add up, so a sentence is scored by its distinct words."""

    weights: dict[int, float]
    bias: float

    def weight(self, word: str, words: dict[str, float]) -> float:
        """The sum of a word's features. words: remembers it."""
        x = words.get(word)
        if x is None:
            if len(words) > 300_000:
                words.clear()
            x = sum(self.weights.get(f, 0.0) for f in _slots(word))
            if len(word) <= 64:
                words[word] = x
        return x

    def _long(self, text: str, start: int, end: int, words: dict[str, float]) -> float:
        """Evidence in a long sentence; of its words only those with a weight are kept, to tell repeats."""
        found: dict[str, float] = {}
        for own in _words(text, start, end):
            found |= {w: x for w in own if w not in found and (x := self.weight(w, words))}
        return sum(found.values())

    def score(self, texts: list[str | None], words: dict[str, float]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(noisy-or of each text, its offending sentences: start, end, p). words: remembers weights of words."""
        scores, found = np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            less, own = 0.0, [np.zeros((0, 3))]
            for spans in batched(sentences(text), _SENTENCES):
                z = np.full(len(spans), self.bias)
                for k, (a, b) in enumerate(spans):
                    if b - a > _PART:
                        z[k] += self._long(text, a, b, words)
                        continue
                    for w in set(_WORD.findall(text[a:b].lower())):
                        x = words.get(w)
                        if x is None:
                            x = self.weight(w, words)
                        if x:
                            z[k] += x
                # log(1 - p) of a sentence is -log(1 + e**z)
                less += np.logaddexp(0, z).sum()
                bad = np.flatnonzero(z >= 0)
                if len(bad):
                    own.append(np.column_stack((np.array([spans[k] for k in bad.tolist()]), 1 / (1 + np.exp(-z[bad])))))
            scores[i] = -np.expm1(-less)
            found.append(np.concatenate(own))
        return scores, found


def sampled(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 8_000) -> DataFrame:
    """(text, y, h): the documents to learn from, at most about ``max_rows``, written in the
    shared folder. h: a hash of the id, by which they are chosen.

    Only ids and labels are joined and counted, over all rows; the texts of the chosen ids are
    then picked out of ``docs`` where they lie, by a broadcast of those ids.
    """
    labels = docs if labels is None else labels
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    ids = docs.select(F.col(id_col).alias("_id")).join(labels, "_id").distinct().withColumn("h", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)))
    n, toxic = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("bigint")), F.lit(0))).first()
    wanted = min(toxic, max(max_rows // 2, max_rows - (n - toxic)))
    share = lambda take, of: float(1 << 40) * min(1.0, take / max(1, of))
    limit = F.when(F.col("y") == 1, share(wanted, toxic)).otherwise(share(max_rows - wanted, n - toxic))
    chosen = ids.where(F.col("h") < limit)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Bounded: about max_rows ids.
    return written(texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y", "h").agg(F.min("text").alias("text")).select("text", "y", "h"), "labelled")


def fit(
    docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 8_000, max_chars: int = 32_000_000, least_docs: int = 8, rounds: int = 300, shrink: float = 2e-3, step: float = 0.2
) -> Model:
    """Trains on at most about ``max_rows`` labelled documents, chosen by a hash of the id so that
    the choice doesn't hang on order or partitions: toxic ones, of which half of them may be (more
    if there aren't so many others), then others; of either label those of least hash that hold
    ``max_chars // 2`` characters together, which bounds the driver's memory where texts are long. A
    text longer than that by itself takes no part; where all texts of a label are, the shortest does.
    ``labels``: a table of id and label; the columns of ``docs`` by default.

    Left out: rows with a null id or label, and ids in one of the two tables only. An id repeated
    in ``labels`` has the greatest of its labels; one repeated in ``docs`` counts once, with the
    least of its texts. Null text counts as empty. Slots in fewer than ``least_docs`` toxic
    documents get no weight; where these are a larger share of the toxic ones than ``SHARE``, that
    share counts, but ``FLOOR`` at least. Without documents of both labels (empty tables too) the
    model scores everything by its prior of almost 0.

    Weights stay at 0 or above and shrink by ``shrink`` a round, so most are 0 in the end.

    Executors turn texts into slots; the driver gets integers only, of the sample.
    """
    rows = sampled(docs, labels, text_col, label_col, id_col, max_rows)
    # At most about max_rows rows of two numbers.
    lengths = rows.select("y", "h", F.length("text").cast("bigint").alias("n")).toArrow().to_pandas()
    most = max(1, max_chars // 2)
    for y, own in lengths.groupby("y"):
        fit = own[own["n"] <= most].sort_values("h")
        if fit.empty:
            taken = F.col("h") == int(own.sort_values(["n", "h"])["h"].iloc[0])
        else:
            beyond = fit[fit["n"].cumsum() > most]["h"]
            taken = (F.length("text") <= most) & (F.col("h") < (1 << 40 if beyond.empty else int(beyond.iloc[0])))
        rows = rows.where((F.col("y") != int(y)) | taken)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            slots, sizes, ends = array("i"), array("i"), [(0, 0)]
            for text in piece.column(0).to_pylist():
                for a, b in sentences(text):
                    own = {f for words in _words(text, a, b) for w in words for f in _slots(w)}
                    slots.extend(sorted(own))
                    sizes.append(len(own))
                ends.append((len(slots), len(sizes)))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.array(x, np.int32))) for at, x in zip(zip(*ends, strict=True), (slots, sizes), strict=True)]
            yield pa.RecordBatch.from_arrays([*lists, piece.column(1)], ["slots", "sizes", "y"])

    got = rows.select("text", "y").mapInArrow(features, "slots array<int>, sizes array<int>, y int").toArrow()
    return _train(got, least_docs, rounds, shrink, step)


def _train(got: pa.Table, least_docs: int, rounds: int, shrink: float, step: float) -> Model:
    y = np.asarray(got.column("y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return Model({}, -8.0)
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    size = lambda c: np.asarray(pc.list_value_length(got.column(c)).to_pylist())
    slots, per_sentence, sentences_of = flat("slots"), flat("sizes"), size("sizes")
    doc_of_sentence = np.repeat(np.arange(len(y), dtype=np.int32), sentences_of)
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    toxic = (y == 1)[doc_of_sentence][sentence]
    pairs = np.unique(doc_of_sentence[sentence[toxic]].astype(np.int64) * SLOTS + slots[toxic])
    often = np.bincount(pairs % SLOTS, minlength=SLOTS)
    known = np.flatnonzero(often >= min(least_docs, max(FLOOR, SHARE * (y == 1).sum())))
    column = np.full(SLOTS, -1, np.int32)
    column[known] = np.arange(len(known))
    keep = column[slots] >= 0
    sentence, col = sentence[keep], column[slots[keep]]
    del slots, toxic, keep, got

    w, bias = np.zeros(len(known)), -7.0
    m, v, at = np.zeros(len(known) + 1), np.zeros(len(known) + 1), 0
    # Both labels weigh alike, as one is rare.
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for at in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[col], minlength=len(per_sentence))
        less = np.bincount(doc_of_sentence, np.logaddexp(0, z), minlength=len(y))
        whole = -np.expm1(-less)
        # d log-likelihood / dz: p (1 - P) / P where the label is 1, -p where it is 0.
        pull = np.where(y == 1, np.exp(-less) / np.maximum(whole, 1e-12), -1.0) * weigh
        grad_z = pull[doc_of_sentence] / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, grad_z[sentence], minlength=len(known)) / len(y), grad_z.sum() / len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = step * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-6)
        # Words only add evidence; shrinking takes those without enough of their own to 0.
        w, bias = np.maximum(w + move[:-1] - shrink, 0), bias + move[-1]
    return Model({int(s): float(x) for s, x in zip(known, w, strict=True) if abs(x) > 1e-3}, float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, text_as: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``carry``, score (0 to 1), and offending:
    an array of (start, end, score) of the sentences that are toxic with p of 0.5 or more; and the
    text as ``text_as``, if that is given, so that ``carry`` needn't hold it a second time.

    A null or empty text has no sentences and score 0; ids may be null or repeated; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    names = [n for n in rows.columns if n != "text" or text_as]
    kinds = [rows.schema[n].dataType.simpleString() for n in names]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, float] = {}
        for piece in pieces(batches):
            scores, found = model.score(piece.column("text").to_pylist(), words)
            whole = np.concatenate(found)
            whole = pa.StructArray.from_arrays([pa.array(whole[:, 0].astype(np.int32)), pa.array(whole[:, 1].astype(np.int32)), pa.array(whole[:, 2])], fields=list(spans.value_type))
            offending = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), whole)
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(scores), offending], [*names, "score", "offending"])

    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", score double, offending array<struct<start:int,end:int,score:double>>")
    texts = [F.col("text").alias(text_as)] if text_as else []
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)], "score", "offending", *texts)
