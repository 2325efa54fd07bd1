"""Hard negatives against brute force, the bounds, and the share that is reckoned exactly."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, modulus=10, k=5, m=5):
    seen = set()
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, a in seen:
        if i % modulus:
            continue
        score = [(sum(x * y for x, y in zip(a, b, strict=True)), j, c, b) for j, c, b in seen if len(b) == len(a)]
        for s, j, _, _ in sorted([x for x in score if x[2] == label and x[1] != i], key=lambda x: (-x[0], x[1]))[:k]:
            hard = sorted([x for x in score if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s], key=lambda x: (-x[0], x[1]))[:m]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def vectors(seed, n, dims, spread=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.12, (4, dims))
    return [(i, int(rng.integers(4)), (centre[i % 4] + rng.normal(0, spread, dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dims", "block_bytes"), [(1, 1), (7, 300 * 56), (16, 8 << 20)])
def test_equals_brute_force(spark, dims, block_bytes):
    rows = vectors(dims, 700, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes, batch_size=3)) == brute(rows)


def test_edges(spark):
    rng = random.Random(4)
    rows = vectors(1, 120, 4)
    rows += [(i, i % 3, [0.5, 0.25, 0.5, 0.25]) for i in range(200, 300)]  # equal vectors: ties
    rows += [(10, 1, [0.1, 0.2, 0.3, 0.4]), (10, 1, [0.1, 0.2, 0.3, 0.4]), (10, 2, [0.1, 0.2, 0.3, 0.4]), (10, 1, [0.4, 0.2, 0.3, 0.4])]
    rows += [(None, 1, [1.0] * 4), (400, None, [1.0] * 4), (410, 1, None), (420, 1, [1.0, None, 0.0, 0.0]), (430, 1, [1.0, math.nan, 0.0, 0.0]), (440, 1, [1.0, math.inf, 0.0, 0.0])]
    rows += [(450 + i, i % 2, []) for i in range(12)] + [(470 + i, i % 2, [0.3 * i]) for i in range(12)] + [(500, 1, [0.0] * 4), (510, 2, [-0.001] * 4)]
    rows += [(600 + i, i % 2, [3e5 + i, -2e5, 1e5 * rng.random(), 7e4]) for i in range(15)]  # beyond whole doubles
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", digest string, block int")
    assert got(negatives.mine(df, F.col("vec_id") % 10 == 0)) == brute(rows)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(df.where("vec_id = 400"), F.col("vec_id") % 10 == 0).collect() == []
    huge = spark.createDataFrame([(10, 1, [3e38]), (11, 1, [3e38]), (12, 2, [3e38]), (20, 3, [1.0]), (21, 3, [1.0]), (22, 4, [1.0])], SCHEMA)
    assert got(negatives.mine(huge, F.col("vec_id") % 10 == 0)) == [(20, 21, 1, 22, 65536, 65536)]


def test_bounds_hold_and_prune():
    """Every exact score lies between its bounds, and few are reckoned, at 64 and at 768 dimensions."""
    rng = np.random.default_rng(2)
    for dims, n in ((64, 12_000), (768, 5_000)):
        y = np.floor(256 * rng.normal(0, 1 / math.sqrt(dims), (n, dims)))
        book = negatives.fit(y[:4096])
        codes, norms = book.codes(y)
        block = negatives.Block(book, [(i, i % 10, codes[i].tobytes(), *norms[i].tolist(), negatives.packed(y[i])) for i in range(n)])
        asked = y[:40]
        for q, (lower, upper) in zip(asked, block.bounds(asked, slice(None)), strict=True):
            exact = negatives.products(block.y, q)
            assert (lower <= exact).all() and (exact <= upper).all()
            lows, ups = block.narrow(q, np.arange(n))
            assert (lows <= exact).all() and (exact <= ups).all() and (ups - lows).mean() < (upper - lower).mean() / 4
        for label in range(10):
            own = [i for i in range(40) if i % 10 == label]
            found = list(block.positives(own, label, y[own], 5))
            goals = [[s for _, s in f] for f in found]
            list(block.negatives([label] * len(own), y[own], goals, 5, 80))
        assert block.reckoned < 0.05 * 40 * n, (dims, block.reckoned / 40 / n)
        print(dims, block.reckoned / 40 / n)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (label + 1) % 10 if label is not None and i % 7 == 0 else label, v) for i, label, v in rows]
    assert got(queries.op12_hard_negatives(spark, SF)) == brute(moved, 100)
