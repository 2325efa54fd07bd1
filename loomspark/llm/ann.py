"""Nearest neighbours by score-aware (anisotropic) quantisation.

Vectors of unit length are cut into two-dimensional parts, each coded by one of 16 centres: four
bits. For an inner product, the part of the residual that is parallel to the vector hurts most,
so codes and centres minimise ``|r|**2 + (eta - 1) * <r, x>**2``: codes by coordinate descent
over the parts, centres by the weighted least squares that this loss gives.

A search packs two codes into a byte and scans them against a table of the 256 scores that such a
byte can have, for each pair of parts and query: one addition per byte, vector and query. It takes
the best ``rerank`` of each block of vectors and computes their exact cosine in double precision on
the original vectors. That is a first batch: a vector's cosine is at most its quantised score plus
the norm of its residual, so every vector whose sum reaches the exact score of the last one wanted
may be among the nearest. That norm is wide, so the residual has a code of its own, of eight bits a
component, whose score is added for these vectors only; what it leaves over is a hundredth of the
norm, and what still reaches the bar, a few vectors, is reranked. Nothing else can be among the
nearest, and the answer is exact.

Equal vectors are scanned once, with the least ids that could be asked for, so a vector that a
third of the rows hold costs no more than another. Vectors are dealt into blocks of bounded size
and each is coded once, where its block is; queries, a small part of the rows, go to all blocks, and
stream past each in batches. A task holds one block and one batch and sends a few rows per query.
Work grows with vectors times queries; vectors are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PART, CENTRES = 2, 16


@dataclass(frozen=True)
class Quantiser:
    """centres: parts x 16 x 2."""

    centres: np.ndarray
    eta: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        short = self.centres.shape[0] * PART - x.shape[1]
        return (np.pad(x, ((0, 0), (0, short))) if short else x).reshape(len(x), -1, PART)

    def codes(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """uint8 codes (0 to 15), n x parts, of unit vectors x. In single precision: what that
        costs in closeness is in the residual, which ``reach`` takes from the codes themselves."""
        p, centres = self.parts(x).astype(np.float32), self.centres.astype(np.float32)
        dots = np.einsum("nsd,skd->snk", p, centres, optimize=True)
        # Of each part, vector and centre, with the residual r: <r, x>, and r's squared length.
        along_of = (p**2).sum(axis=2).T[:, :, None] - dots
        length_of = along_of - dots + (centres**2).sum(axis=2)[:, None, :]
        code = length_of.argmin(axis=2)
        along = np.take_along_axis(along_of, code[:, :, None], axis=2)[:, :, 0]
        total, rows = along.sum(axis=0), np.arange(len(x))
        for _ in range(sweeps):
            before = code.copy()
            for s in range(len(code)):
                rest = total - along[s]
                cost = along_of[s] + rest[:, None]
                cost *= cost
                cost *= np.float32(self.eta - 1)
                cost += length_of[s]
                code[s] = cost.argmin(axis=1)
                along[s] = along_of[s][rows, code[s]]
                total = rest + along[s]
            if (code == before).all():
                break
        return code.T.astype(np.uint8)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for, padded to whole parts."""
        return self.centres[np.arange(code.shape[1])[None, :], code].reshape(len(code), -1)

    def reach(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the score of each coded vector can lack for a query of unit length: the norm of its
        residual, and a little for single-precision scores."""
        parts = code.shape[1]
        lost = np.sqrt(((self.parts(x) - self.centres[np.arange(parts)[None, :], code]) ** 2).sum(axis=(1, 2)))
        return lost + (parts + 2) * 2.0**-22 * (1 + lost)

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Score of each centre for each query: queries x (parts * 16)."""
        return np.einsum("qsd,skd->qsk", self.parts(queries), self.centres).reshape(len(queries), -1).astype(np.float32)

    def byte_tables(self, queries: np.ndarray) -> np.ndarray:
        """Score of each byte of packed codes for each query: bytes x 256 x queries."""
        t = self.table(queries).reshape(len(queries), -1, CENTRES).transpose(1, 2, 0)
        if len(t) % 2:
            t = np.concatenate((t, np.zeros((1, *t.shape[1:]), np.float32)))
        return (t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(len(t) // 2, CENTRES * CENTRES, -1)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the earlier part in the upper bits; bytes x n, so that a byte's column is
    read in one run."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T)


def scanned(tables: np.ndarray, codes: np.ndarray, chunk: int) -> np.ndarray:
    """Quantised scores, queries x n, of packed codes: table look-ups and additions only."""
    n = codes.shape[1]
    out = np.empty((tables.shape[2], n), np.float32)
    for at in range(0, n, chunk):
        total = tables[0][codes[0, at : at + chunk]]
        for t, c in zip(tables[1:], codes[1:], strict=True):
            total += t[c[at : at + chunk]]
        out[:, at : at + chunk] = total.T
    return out


def fit(x: np.ndarray, eta: float = 3.0, rounds: int = 8, seed: int = 11) -> Quantiser:
    """Centres for unit vectors x (a bounded sample)."""
    rng = np.random.default_rng(seed)
    parts = -(-x.shape[1] // PART)
    p = np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)
    centres = p[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].transpose(1, 0, 2).copy()
    for _ in range(rounds):  # plain k-means first
        for s in range(parts):
            own = ((p[:, s, None, :] - centres[s]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(own, minlength=CENTRES)
            for d in range(PART):
                mean = np.bincount(own, p[:, s, d], CENTRES) / np.maximum(n, 1)
                centres[s, :, d] = np.where(n > 0, mean, centres[s, :, d])
    for _ in range(rounds):
        q = Quantiser(centres, eta)
        code = q.codes(x, sweeps=1)
        residual = p - centres[np.arange(parts)[None, :], code]
        along = (residual * p).sum(axis=2)
        total = along.sum(axis=1)
        centres = centres.copy()
        for s in range(parts):
            rest = total - along[:, s]
            v, w = p[:, s], eta - 1
            target = v + w * (rest + (v**2).sum(axis=1))[:, None] * v
            for k in range(CENTRES):
                own = code[:, s] == k
                if own.any():
                    left = own.sum() * np.eye(PART) + w * v[own].T @ v[own]
                    centres[s, k] = np.linalg.solve(left, target[own].sum(axis=0))
            new = ((v - centres[s, code[:, s]]) * v).sum(axis=1)
            total, along[:, s] = rest + new, new
    return Quantiser(centres, eta)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Block:
    """Vectors of one block, coded, and the search among them."""

    def __init__(self, model: Quantiser, ids: list[list[int]], x: np.ndarray) -> None:
        self.model, self.ids, self.x = model, ids, x
        self.first = np.array([i[0] for i in ids])
        codes = model.codes(x)
        self.codes, self.reach = packed(codes), model.reach(x, codes)
        # The residual in whole steps of its greatest component.
        rest = x - model.decoded(codes)[:, : x.shape[1]]
        self.step = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
        self.fine = np.rint(rest / self.step[:, None]).astype(np.int8)
        left = rest - self.fine * self.step[:, None]
        self.left = np.sqrt((left * left).sum(axis=1)) + (codes.shape[1] + 2 * x.shape[1] + 8) * 2.0**-22
        self.reckoned = 0

    def nearest(self, a: np.ndarray, k: int, rerank: int, chunk: int) -> Iterator[list[tuple[list[int], float]]]:
        """For each query, the k vectors of greatest cosine: their ids and that, ties to smaller ids."""
        scores, n = scanned(self.model.byte_tables(a), self.codes, chunk), len(self.x)
        for q, score in zip(a, scores, strict=True):
            near = np.argpartition(-score, rerank - 1)[:rerank] if n > rerank else np.arange(n)
            exact = (self.x[near] * q).sum(axis=1)
            if len(near) < n:
                bar = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
                more = score + self.reach >= bar
                more[near] = False
                more = np.flatnonzero(more)
                finer = score[more] + (self.fine[more].astype(np.float32) @ q.astype(np.float32)) * self.step[more]
                more = more[finer + self.left[more] >= bar]
                self.reckoned += len(near) + len(more)
                near, exact = np.concatenate([near, more]), np.concatenate([exact, (self.x[more] * q).sum(axis=1)])
            yield [(self.ids[near[t]], float(exact[t])) for t in np.lexsort((self.first[near], -exact))[:k]]


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8_192, eta: float = 3.0, rerank: int = 64, block_rows: int = 16_384, block_floats: int = 1 << 20, block_queries: int = 256, chunk: int = 512
) -> DataFrame:
    """(query_id, rank from 1, id, score): the k of ``vectors`` nearest to each of ``queries`` by
    cosine, itself (its id) excepted; nearest first, ties to smaller ids, fewer if there are fewer.

    Both sides have the columns ``id_col`` and ``vec_col``; others aren't read. Vectors that are
    null, empty, zero, or hold a null, NaN or infinity take no part, nor do rows with a null id;
    a vector has a cosine with those of its own length only; rows repeated with one id count once
    for each different vector. An empty table gives an empty result.

    A quantiser is fitted for each length that queries have, on about ``sample`` vectors, those
    least by a hash of the id; every vector is coded and scanned, and the result is that of exact
    search. ``rerank`` sizes the first batch of exact scores and cuts nothing. A block has
    ``block_rows`` vectors, or fewer long ones: ``block_floats`` components.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = "query_id bigint, rank int, " + f"{id_col} bigint, score double"

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        df = df.where((F.size(v) > 0) & F.col(id_col).isNotNull()).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists(v, lambda x: x != 0))
        # -0.0 equals 0.0 as a component, but not as a key.
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v")).distinct()

    asked = scratch.write(valid(queries), "asked")
    keys = asked.groupBy("v").agg(F.min("id").alias("q"))
    dims = [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().collect()]
    rows = scratch.write(valid(vectors.where(F.size(vec_col).isin(dims))).withColumn("d", F.size("v")), "vectors")
    totals = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    if not totals:
        return spark.createDataFrame([], kind)
    models = {}
    for d, total in totals.items():
        of = rows.where(F.col("d") == d).select("v", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"))
        picked = of.where(F.col("h") < float(1 << 40) * min(1.0, sample / total)).select("v").toArrow()
        picked = picked if picked.num_rows else of.orderBy("h").limit(1).select("v").toArrow()
        fitted = _matrix(picked.column("v").combine_chunks(), d)
        models[d] = fit(_unit(fitted[np.lexsort(fitted.T)]), eta)

    # Equal vectors once, with the k + 1 least ids: no more can be among the k of any query.
    least = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    least = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    blocks = F.element_at(F.create_map(*[F.lit(x) for d, n in totals.items() for x in (d, -(-n // min(block_rows, max(64, block_floats // d))))]), F.size("v"))
    left = least.select(F.size("v").alias("d"), F.pmod(F.xxhash64(F.element_at("ids", 1)), blocks).cast("int").alias("i"), F.lit(None).cast("bigint").alias("q"), "ids", "v")
    right = keys.where(F.size("v").isin(list(totals))).select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("i"), "q", F.lit(None).cast("array<bigint>").alias("ids"), "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after the other, each with its vectors first and then its queries."""
        at, block, ids, held = None, None, [], []

        def found(names: list[int], a: np.ndarray) -> pa.RecordBatch:
            out = [(name, i, score) for name, near in zip(names, block.nearest(a, k + 1, rerank, chunk), strict=True) for i, score in near]
            q, near, scores = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.float64())], ["q", "ids", "score"])

        for batch in batches:
            d, i = batch.column("d").to_numpy(), batch.column("i").to_numpy()
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if (d[start], i[start]) != at:
                    at, block, ids, held = (d[start], i[start]), None, [], []
                base = part.column("q").is_null().to_numpy(zero_copy_only=False)
                if base.any():
                    own = part.filter(pa.array(base))
                    ids += own.column("ids").to_pylist()
                    held.append(_unit(_matrix(own.column("v"), int(at[0]))))
                ask = part.filter(pa.array(~base))
                if ask.num_rows and held:
                    block = Block(models[int(at[0])], ids, np.concatenate(held))
                    ids, held = [], []
                for k0 in range(0, ask.num_rows if block else 0, block_queries):
                    some = ask.slice(k0, block_queries)
                    yield found(some.column("q").to_pylist(), _unit(_matrix(some.column("v"), int(at[0]))))

    dealt = left.unionByName(right).repartition("d", "i").sortWithinPartitions("d", "i", F.col("q").isNotNull())
    met = dealt.mapInArrow(search, "q bigint, ids array<bigint>, score double")
    met = met.select("q", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    met = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    lists = met.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("l"))
    answered = asked.join(keys, "v").select("id", "q").join(lists, "q")
    mine = F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, k)
    out = answered.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
