"""Hard-negative mining by product quantisation with stored residual norms.

Vectors are scaled and floored to integers. Parts of two dimensions are coded by one of 256 centres
each, a byte, and what that leaves over by a second byte in the same way; each vector keeps the norm
of what the first codes leave over and of what both do. A score (the integer inner product with
an anchor) then lies within ``|anchor| * norm`` of the sum of one table look-up per part, so every
vector has a lower and an upper bound of its score: wide ones from the first codes, for all
vectors, and narrow ones from both, for those that the wide ones can't rule out.

An anchor's positives are the best of its own label: of each block those are reckoned exactly whose
upper bound reaches the ``positives``-th lower bound. A positive's window takes scores from
``low`` percent of its own up to its own, and the best of other labels in it are wanted: those are
reckoned exactly that may be in the window and whose upper bound reaches the ``negatives``-th
lower bound of those that are in it for certain. Nothing that is left out can be in the answer;
no row is capped or guessed.

Vectors are coded once and written down. They are dealt into blocks of bounded size by a hash of the
whole row, so neither a label nor a vector nor an id in a third of all rows makes a block larger.
Anchors go to all blocks and stream past each; a block sends a few rows per anchor and window. Work
grows with vectors times anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import scanned
from .common import Scratch

PART, CENTRES = 2, 256
#: Sums of products below this are whole numbers in double precision.
EXACT = 2.0**53


@dataclass(frozen=True)
class Codebook:
    """centres and fine: parts x 256 x 2, of vectors of ``dims`` components and of what the centres
    leave over."""

    centres: np.ndarray
    fine: np.ndarray
    dims: int

    def codes(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x 2 parts, uint8: first all of the centres, then the fine ones) and residual norms
        after the first and after both, rounded up: n x 2."""
        p = cut(y, len(self.centres))
        code, lost = np.empty((len(y), 2 * p.shape[1]), np.uint8), np.zeros((len(y), 2))
        for s, (c, f) in enumerate(zip(self.centres, self.fine, strict=True)):
            near = closest(p[:, s], c)
            rest = p[:, s] - c[near]
            finer = closest(rest, f)
            code[:, s], code[:, p.shape[1] + s] = near, finer
            lost += np.stack([(rest**2).sum(axis=1), ((rest - f[finer]) ** 2).sum(axis=1)], axis=1)
        return code, np.sqrt(lost) * (1 + 1e-6) + 1e-6

    def tables(self, queries: np.ndarray, fine: bool = False) -> np.ndarray:
        """Score of each centre for each query: parts x 256 x queries."""
        return np.einsum("qsd,skd->skq", cut(queries, len(self.centres)), self.fine if fine else self.centres, optimize=True).astype(np.float32)


def cut(y: np.ndarray, parts: int) -> np.ndarray:
    """y in parts of PART components: n x parts x PART."""
    wide = np.zeros((len(y), parts * PART))
    wide[:, : y.shape[1]] = y
    return wide.reshape(len(y), -1, PART)


def closest(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (p @ c.T)).argmin(axis=1)


def means(p: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """256 centres of p (n x 2) by k-means; all of p's values, if they are no more."""
    distinct = np.unique(p, axis=0)
    c = distinct[rng.permutation(len(distinct))[:CENTRES]]
    for _ in range(rounds if len(distinct) > CENTRES else 0):
        near = closest(p, c)
        n = np.bincount(near, minlength=len(c))
        mean = np.stack([np.bincount(near, p[:, d], len(c)) for d in range(PART)], axis=1) / np.maximum(n, 1)[:, None]
        c = np.where(n[:, None] > 0, mean, c)
    return np.concatenate([c, np.repeat(c[:1], CENTRES - len(c), axis=0)])


def fit(y: np.ndarray, rounds: int = 4, seed: int = 7) -> Codebook:
    """Both kinds of centres for integer vectors y, a bounded sample."""
    rng = np.random.default_rng(seed)
    p = cut(y, max(1, -(-y.shape[1] // PART)))
    centres = [means(p[:, s], rng, rounds) for s in range(p.shape[1])]
    rest = [p[:, s] - c[closest(p[:, s], c)] for s, c in enumerate(centres)]
    return Codebook(np.stack(centres), np.stack([means(r, rng, rounds) for r in rest]), y.shape[1])


def products(y: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of y with a: int64, or Python's integers where those might
    not do. Both hold whole numbers in double precision."""
    most = np.abs(y).max(initial=0.0) * np.abs(a).max(initial=0.0) * max(1, len(a))
    if most < EXACT:
        return np.rint(y @ a).astype(np.int64)
    whole = [int(v) for v in a.tolist()]
    return np.array([sum(int(v) * w for v, w in zip(row, whole, strict=True)) for row in y.tolist()] + [None], dtype=object)[:-1]


class Block:
    """Coded vectors of one block, by label, and the search among them. Rows that are equal in
    all of id, label and vector count once."""

    def __init__(self, book: Codebook, rows: list[tuple[int, int, bytes, float, float, bytes]]) -> None:
        rows = sorted({(label, i, y, code, norm, left) for i, label, code, norm, left, y in rows})
        self.book = book
        self.label = np.array([r[0] for r in rows], np.int64)
        self.id = np.array([r[1] for r in rows], np.int64)
        self.y = np.stack([unpacked(r[2], book.dims) for r in rows])
        codes, parts = np.stack([np.frombuffer(r[3], np.uint8) for r in rows]), len(book.centres)
        self.code, self.fine = np.ascontiguousarray(codes[:, :parts].T), codes[:, parts:]
        length = np.sqrt((self.y * self.y).sum(axis=1))
        # What is left over, and what single precision may lose of tables and of their sums.
        lost = (2 * parts + 6) * 2.0**-22 * (length + 2 * np.array([r[4] for r in rows]))
        self.norm, self.left = (np.array([r[i] for r in rows]) + lost for i in (4, 5))
        self.reckoned = 0

    def bounds(self, queries: np.ndarray, at: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query, lower and upper bounds of the scores of the rows ``at``."""
        rough = scanned(self.book.tables(queries), self.code[:, at], 512).astype(np.float64)
        for q, mean in zip(queries, rough, strict=True):
            yield self._around(mean, self.norm[at], q)

    def narrow(self, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Narrower bounds of some rows, from both codes."""
        first, fine, parts = self.book.tables(q[None])[:, :, 0], self.book.tables(q[None], True)[:, :, 0], np.arange(len(self.code))
        mean = (first[parts, self.code[:, at].T] + fine[parts, self.fine[at]]).sum(axis=1, dtype=np.float64)
        return self._around(mean, self.left[at], q)

    @staticmethod
    def _around(mean: np.ndarray, left: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = left * (np.sqrt(q @ q) * (1 + 1e-9)) + 1e-6
        unsure = ~np.isfinite(mean)  # beyond single precision
        return np.where(unsure, -np.inf, mean - reach), np.where(unsure, np.inf, mean + reach)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.reckoned += len(at)
        return products(self.y[at], q)

    def best(self, score: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the first k by score, ties to smaller ids."""
        if score.dtype == object:
            order = sorted(range(len(at)), key=lambda j: (-score[j], self.id[at[j]]))[:k]
        else:
            order = np.lexsort((self.id[at], -score))[:k]
        return [(int(self.id[at[j]]), int(score[j])) for j in order]

    def positives(self, ids: list[int], label: int, queries: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query (of one label), the k best rows of its label with another id."""
        lo, hi = np.searchsorted(self.label, [label, label + 1])
        for i, q, (lower, upper) in zip(ids, queries, self.bounds(queries, slice(lo, hi)), strict=True):
            at = np.flatnonzero(self.id[lo:hi] != i)
            at = lo + at[upper[at] >= kth(lower[at], k)]
            lower, upper = self.narrow(q, at)
            at = at[upper >= kth(lower, k)]
            yield self.best(self.exact(q, at), at, k)

    def negatives(self, labels: list[int], queries: np.ndarray, targets: list[list[int]], k: int, low: int) -> Iterator[list[list[tuple[int, int]]]]:
        """For each query and each score of its ``targets``, the k best rows of other labels with
        low % of that score <= score <= that score."""
        # Float bounds of integer windows: a little wider is safe.
        wide = lambda x, way: float(x) + way * (1e-6 + abs(float(x)) * 1e-12)
        for label, q, goals, (lower, upper) in zip(labels, queries, targets, self.bounds(queries, slice(None)), strict=True):
            bottom, top = min(low * g / 100 for g in goals), max(goals)
            near = np.flatnonzero((self.label != label) & (lower <= wide(top, 1)) & (upper >= wide(bottom, -1)))
            lower, upper = self.narrow(q, near)
            inside = lambda score, goal: np.array([low * goal <= 100 * s <= 100 * goal for s in score.tolist()], bool)
            wanted, early = {}, np.zeros(len(near), bool)
            for goal in set(goals):
                floor = low * goal / 100
                some = (lower <= wide(goal, 1)) & (upper >= wide(floor, -1))
                sure = np.flatnonzero((lower >= wide(floor, 1)) & (upper <= wide(goal, -1)))
                wanted[goal] = some & (upper >= kth(lower[sure], k))
                early[sure[np.argsort(-lower[sure])[: 2 * k]]] = True
            # The exact scores of the likeliest rows raise the bar for the others.
            at = near[early]
            score, place = self.exact(q, at), np.flatnonzero(early)
            for goal, some in wanted.items():
                some &= upper >= kth(score[some[place] & inside(score, goal)], k)
            rest = np.logical_or.reduce(list(wanted.values())) & ~early
            at, score, place = np.concatenate([at, near[rest]]), np.concatenate([score, self.exact(q, near[rest])]), np.concatenate([place, np.flatnonzero(rest)])
            found = {}
            for goal, some in wanted.items():
                own = some[place] & inside(score, goal)
                found[goal] = self.best(score[own], at[own], k)
            yield [found[g] for g in goals]


def kth(lower: np.ndarray, k: int) -> float:
    """The k-th greatest; without so many, what everything reaches."""
    return np.sort(lower)[-k] if len(lower) >= k else -np.inf


def packed(y: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where they fit, else as doubles."""
    return (y.astype("<i2") if np.abs(y).max(initial=0.0) < 2**15 else y.astype("<f8")).tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * dims else "<f8").astype(np.float64)


def _integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)) + 0.0


CODED = "vec_id bigint, label bigint, d int, block int, code binary, norm double, rest double, y binary, digest binary, anchor boolean"


def coded(rows: DataFrame, books: dict[int, Codebook], blocks: dict[int, int], scale: float) -> DataFrame:
    """Of rows (vec_id, label, v, d, anchor): codes, residual norms, integers, and the block of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in CODED.split(", ")]
        for batch in batches:
            d = batch.column("d").to_numpy()
            for dims in np.unique(d).tolist():
                part = batch.filter(pa.array(d == dims))
                y = _integers(part.column("v"), dims, scale)
                code, norm = books[dims].codes(y)
                own = [packed(x) for x in y]
                ids, labels = part.column("vec_id").to_pylist(), part.column("label").to_pylist()
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in own]
                block = [int.from_bytes(hashlib.blake2b(b"%d %d " % (i, c) + h, digest_size=8).digest(), "little") % blocks[dims] for i, c, h in zip(ids, labels, digest, strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array([dims] * n, pa.int32()), pa.array(block, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm[:, 0]), pa.array(norm[:, 1]), pa.array(own, pa.binary()), pa.array(digest, pa.binary()), part.column("anchor")], names
                )

    return rows.mapInArrow(run, CODED)


def streamed(base: DataFrame, asks: DataFrame, books: dict[int, Codebook], blocks: dict[int, int], answer: Callable[[Block, list[dict]], Iterator[tuple]], schema: str, batch_size: int) -> DataFrame:
    """``answer`` of each block for all of ``asks`` (of its vectors' length), in batches of one
    label. ``asks``: vec_id, label, d, y, digest and ``goals`` (an array, or null)."""
    number = F.element_at(F.create_map(*[F.lit(x) for d, n in blocks.items() for x in (d, n)]), F.col("d"))
    left = base.select("d", "block", F.lit(False).alias("ask"), "label", "vec_id", "code", "norm", "rest", "y", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<bigint>").alias("goals"))
    right = asks.select("d", F.explode(F.sequence(F.lit(0), number - 1)).alias("block"), F.lit(True).alias("ask"), "label", "vec_id", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("rest"), "y", "digest", F.col("goals").cast("array<bigint>").alias("goals"))
    kinds = [x.strip().split(" ")[1] for x in schema.split(", ")]
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    types = [{"bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held = None, None, []
        for batch in batches:
            for asks in groups(batch.to_pylist()):
                key = (asks[0]["d"], asks[0]["block"])
                if key != at:
                    at, block, held = key, None, []
                if not asks[0]["ask"]:
                    held += [(r["vec_id"], r["label"], r["code"], r["norm"], r["rest"], r["y"]) for r in asks]
                    continue
                if held:
                    block, held = Block(books[key[0]], held), []
                for i in range(0, len(asks) if block else 0, batch_size):
                    out = list(answer(block, asks[i : i + batch_size]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def groups(rows: list[dict]) -> Iterator[list[dict]]:
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or any(rows[i][c] != rows[start][c] for c in ("d", "block", "ask")) or (rows[i]["ask"] and rows[i]["label"] != rows[start]["label"]):
                yield rows[start:i]
                start = i

    dealt = left.unionByName(right).repartition("d", "block").sortWithinPartitions("d", "block", "ask", "label")
    return dealt.mapInArrow(run, schema)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, sample: int = 4_096, block_bytes: int = 8 << 20, batch_size: int = 64
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score): for each
    row that ``anchor`` (a condition on the columns of ``vectors``) picks, its ``positives`` best
    other rows (by id) of the same label, and for each of these the ``negatives`` best rows of other labels
    with low/100 * positive score <= score <= positive score. Best: greatest integer inner product
    of ``floor(scale * x)``, ties to smaller ids. A positive with an empty window has no row.

    Rows with a null id, label or vector, or a null or non-finite component (also after scaling)
    take no part; rows equal in id, label and integers count once, those equal in id only are rows of
    their own; a vector has scores with those of its own length only (an empty one: 0); scores that
    don't fit a long aren't returned; an empty table gives an empty result; other columns aren't
    read. A codebook is fitted for each length of anchors on about ``sample`` vectors, those least
    by a hash of the id; all vectors are coded and scanned, in blocks of about ``block_bytes``.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1.7e308 / scale))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).alias("d"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    totals = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).where("a > 0").collect()}
    if not totals:
        return spark.createDataFrame([], kind)
    books, blocks = {}, {}
    for d, n in totals.items():
        of = rows.where(F.col("d") == d).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 40)).alias("h"))
        picked = of.where(F.col("h") < float(1 << 40) * min(1.0, sample / n)).select("v").limit(4 * sample).toArrow()
        picked = picked if picked.num_rows else of.orderBy("h", "v").limit(1).select("v").toArrow()
        y = _integers(picked.column("v").combine_chunks(), d, scale)
        books[d], blocks[d] = fit(y[np.lexsort(y.T)] if d else y), -(-n // max(256, block_bytes // (8 * max(1, d))))
    base = scratch.write(coded(rows.where(F.col("d").isin(list(totals))), books, blocks, scale), "coded")
    anchors = scratch.write(base.where("anchor").select("vec_id", "label", "d", "y", "digest").distinct(), "anchors")
    key, dims = ["vec_id", "label", "d", "digest"], dict(books)
    fits = lambda s: -(2**63) <= s < 2**63

    def positive(block: Block, asks: list[dict]) -> Iterator[tuple]:
        queries = np.stack([unpacked(a["y"], block.book.dims) for a in asks])
        for a, found in zip(asks, block.positives([a["vec_id"] for a in asks], asks[0]["label"], queries, positives), strict=True):
            yield from ((a["vec_id"], a["label"], a["d"], a["digest"], i, s) for i, s in found if fits(s))

    def negative(block: Block, asks: list[dict]) -> Iterator[tuple]:
        queries = np.stack([unpacked(a["y"], block.book.dims) for a in asks])
        for a, windows in zip(asks, block.negatives([a["label"] for a in asks], queries, [a["goals"] for a in asks], negatives, low), strict=True):
            for goal, found in zip(a["goals"], windows, strict=True):
                yield from ((a["vec_id"], a["label"], a["d"], a["digest"], goal, i, s) for i, s in found if fits(s))

    head = "vec_id bigint, label bigint, d bigint, digest binary"
    near = streamed(base, anchors.withColumn("goals", F.lit(None)), dims, blocks, positive, f"{head}, positive_id bigint, positive_score bigint", batch_size)
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id"))
    chosen = scratch.write(near.withColumn("r", best).where(F.col("r") <= positives).drop("r"), "positives")
    goals = chosen.groupBy(*key).agg(F.collect_set("positive_score").alias("goals"))
    asks = scratch.write(anchors.join(goals, key), "asks")
    hard = streamed(base, asks, dims, blocks, negative, f"{head}, positive_score bigint, negative_id bigint, negative_score bigint", batch_size)
    first = F.row_number().over(Window.partitionBy(*key, "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    hard = scratch.write(hard.withColumn("rank", first).where(F.col("rank") <= negatives), "negatives")
    scratch.drop("coded", "anchors", "asks")
    out = chosen.join(hard, [*key, "positive_score"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
