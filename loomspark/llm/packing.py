"""Packing: optimal length buckets, then batches under a token budget.

The lengths of all documents make one histogram. Dynamic programming over it chooses the
boundaries of at most ``buckets`` buckets so that padding every document up to its bucket's
boundary wastes the fewest tokens. Inside a bucket, documents in order of a hash shard and id
fill batches of ``budget // boundary`` documents.

The histogram has a row for each length that occurs. Documents of d different lengths hold d**2 / 2
words at least, so for W words in all it has no more than sqrt(2 * W) rows: some 6 million, 90 MB,
for 100 TB of text. That bounds what comes to the driver.

Words are counted once: ids and lengths are written, and all else reads those.

Ranks inside a bucket come from two levels, counts of (bucket, shard) and a row number inside
each, so no task holds a bucket. Every document is packed: none is cut, dropped or split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def word_count(text: str | Column) -> Column:
    """Words of a text: runs of characters outside ``[\\x20\\x09-\\x0D]``; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over ascending distinct ``lengths``, the last of
    which is the greatest length, with the fewest padded tokens; fewer buckets where more don't
    help. Equal totals go to the smaller boundaries.

    ``f[k][j]``: fewest padded tokens when the first j lengths make k buckets. The cost of a
    bucket satisfies the quadrangle inequality, so the best split moves up with j and divide and
    conquer finds a level in O(n log n); all parts of one depth are done at once.
    """
    n = len(lengths)
    if not n:
        return []
    docs = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    # The lengths' own sum is the same for every choice: a bucket costs boundary x documents.
    top = np.asarray(lengths, np.int64)
    f = np.full(n + 1, np.iinfo(np.int64).max // 2)
    f[0] = 0
    splits: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        g, split = np.full(n + 1, np.iinfo(np.int64).max // 2), np.zeros(n + 1, np.int64)
        # Parts: the ends lo..hi, whose best splits lie in a..b.
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            sizes = np.minimum(b, j - 1) - a + 1
            starts = np.cumsum(sizes) - sizes
            part = np.repeat(np.arange(len(j)), sizes)
            i = np.arange(len(part)) - (starts - a)[part]
            cost = f[i] + top[j - 1][part] * (docs[j][part] - docs[i])
            least = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == least[part])
            k = i[hits[np.unique(part[hits], return_index=True)[1]]]
            g[j], split[j] = least, k
            left, right = lo < j, j < hi
            lo, hi, a, b = (np.concatenate((x[left], y[right])) for x, y in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
        if splits and g[n] >= f[n]:
            break
        f, splits = g, [*splits, split]
    ends, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        ends.append(int(top[j - 1]))
        j = int(split[j])
    return ends[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", length: str | Column | None = None, budget: int = 65_536, buckets: int = 16, shard_rows: int = 50_000, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in
    its bucket), slot (from 0 in its batch), padding.

    ``length``: a column or expression of the tokens of a row; words of ``text`` by default. Null
    or negative counts as 0. A document longer than the budget makes a batch of its own, as does
    each other of its bucket. Null ids are packed like others, as are rows repeated with one id,
    each for itself; an empty table gives an empty result; other columns of ``docs`` aren't read.

    Buckets and padding don't hang on order or partitions; which batch a document comes to does,
    as rows are dealt by their place in the partitions that are read, so that one row repeated any
    number of times spreads like others.
    """
    n = word_count("text") if length is None else F.col(length) if isinstance(length, str) else length
    rows = docs.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"), F.monotonically_increasing_id().alias("_row"))
    rows = Scratch(docs.sparkSession).write(rows, "lengths")
    bins = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).toArrow().to_pandas().sort_values("n_tokens")
    ends = boundaries(bins["n_tokens"].to_numpy(), bins["docs"].to_numpy(), buckets)
    total = int(bins["docs"].sum()) if len(bins) else 0
    shards = shards or max(8, -(-total // shard_rows))
    edges = F.array(*[F.lit(e).cast("bigint") for e in ends or [0]])
    # The number of boundaries below the length is the bucket.
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id", "_row"), F.lit(shards)).cast("int"))
    counts = rows.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_c"))
    # buckets x shards rows: a count of rows over shard_rows each.
    before = counts.select("bucket", "_shard", (F.sum("_c").over(Window.partitionBy("bucket").orderBy("_shard")) - F.col("_c")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_id", "_row")) - 1
    rows = rows.withColumn("_at", at).join(before, ["bucket", "_shard"])
    rank = F.col("_at") + F.col("_before")
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("bigint")
    return rows.withColumn("bucket_len", F.element_at(edges, F.col("bucket") + 1)).select(
        F.col("_id").alias(id_col),
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(rank / size).cast("bigint").alias("batch"),
        F.pmod(rank, size).cast("bigint").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
