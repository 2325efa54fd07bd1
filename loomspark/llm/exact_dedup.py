"""Exact dedup by progressive refinement, in DataFrame functions only.

1. Group by length of the normalised text; a length that occurs once is settled.
2. Of the other rows, group by (length, hash of a prefix).
3. Only rows of a (length, prefix hash) that occurs twice have their full text hashed, and the
   groups of (length, prefix hash, full hash) are the groups of equal texts.

The first scan counts (length, prefix hash) values, aggregated before the shuffle: a group holding
a third of the rows is one row per task, and lengths are counted from these counts. Which values
survive step 2 reaches the second scan as a bitmap of fixed size, broadcast; a false positive
there costs one more hash and changes no result. The second scan writes ids and hashes; from there
on only rows of surviving groups move, and only lengths, hashes and ids of them. The last join,
from rows to their group, has no consumer that needs its partitioning, so adaptive execution can
split a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, marked

PREFIX = 256
_KEY = ["_n", "_p", "_h"]


def normalised(text: str | Column) -> Column:
    """Null as empty; each run of ``[\\x20\\x09-\\x0D]`` as one space. Lone spaces, the usual
    case, don't match, so most texts are copied in few pieces."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _keys(text: Column, prefix: int) -> list[Column]:
    return [F.length(text).alias("_n"), F.xxhash64(F.substring(text, 1, prefix)).alias("_p")]


def _hashes(docs: DataFrame, id_col: str, text_col: str, prefix: int, every: bool, scratch: Scratch) -> DataFrame:
    """(_id, _n, _p, _maybe, _h): a row for each row; _h, the full hash, where the row's text may
    have an equal (_maybe), or for all rows if ``every``."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t"))
    counts = scratch.write(rows.select(*_keys(F.col("_t"), prefix)).groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_c")), "prefixes")
    lengths = counts.groupBy("_n").agg(F.sum("_c").alias("_c")).where("_c > 1").select("_n")
    again = counts.join(lengths, "_n", "left_semi").where("_c > 1")
    bits = scratch.write(bitmap(again, "_n", "_p"), "collisions")
    near = marked(rows.select("_id", *_keys(F.col("_t"), prefix), "_t"), bits, "_n", "_p")
    full = F.unhex(F.sha2("_t", 256))
    near = scratch.write(near.select("_id", "_n", "_p", "_maybe", (full if every else F.when(F.col("_maybe"), full)).alias("_h")), "hashes")
    scratch.drop("prefixes", "collisions")
    return near


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept (and text_sha256 if ``digest``).

    Of equal texts the row with the smallest id stays. Null text counts as empty. Null ids sort
    last: such a row stays only in a group without any other id, and then keep_id is null. Rows
    repeated with one id form a group in which each has kept = true, as each has that id.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession)
    near = _hashes(docs, id_col, text_col, prefix, digest, scratch)
    some = near.where("_maybe")
    # Written, so that the join with it can be split where a group is large.
    groups = scratch.write(some.groupBy(*_KEY).agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    alone = [F.lit(None).cast(near.schema["_id"].dataType).alias("keep_id"), F.lit(None).cast("bigint").alias("group_size")]
    out = some.join(groups, _KEY, "left").select("_id", "_h", "keep_id", "group_size").union(near.where("not _maybe").select("_id", "_h", *alone))
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        *([F.lower(F.hex("_h")).alias("text_sha256")] if digest else []),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they were.

    It is a row with the group's smallest id (null ids last); of several rows with that id and
    text, the one whose columns have the least hash, and one of those that are alike in all.
    Rows with one id but different texts are judged each by its own text. Null text counts as
    empty; an empty table gives an empty result.

    A row whose id occurs once, in a group of its own or as its smallest id, stays where it is
    read: only the others, found by a bitmap of their ids, are hashed again and joined.
    """
    scratch = Scratch(docs.sparkSession)
    near = _hashes(docs, id_col, text_col, prefix, False, scratch)
    # Rows of a group by id first, so that repeats of the id that stays are known.
    by_id = near.where("_maybe").groupBy(*_KEY, "_id").agg(F.count(F.lit(1)).alias("_c"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_c")).alias("_first")
    groups = by_id.groupBy(*_KEY).agg(first, F.sum("_c").alias("_size")).where("_size > 1")
    groups = scratch.write(groups.select(*_KEY, F.col("_first._id").alias("_keep"), F.col("_first._c").alias("_repeats")), "groups")
    lost = near.where("_maybe").join(groups, _KEY).where("not (_id <=> _keep) or _repeats > 1").select("_id")
    repeated = near.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1 or _id is null").select("_id")
    bits = scratch.write(bitmap(lost.union(repeated), "_id"), "doubtful")
    scratch.drop("hashes")

    names = [f"_k{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = marked(docs.toDF(*names), bits, own_id)
    clear, doubtful = rows.where("not _maybe").select(*names), rows.where("_maybe")
    doubtful = doubtful.withColumn("_t", normalised(own_text)).select(*names, *_keys(F.col("_t"), prefix), F.unhex(F.sha2("_t", 256)).alias("_h"))
    # Rows alike in text and id are one row of each task before they meet.
    plain = [c for c in names if docs.schema[names.index(c)].dataType.typeName() not in ("map", "variant")]
    one = doubtful.groupBy(*_KEY, F.col(own_id).alias("_own")).agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("_one"))
    judged = one.join(groups, _KEY, "left").where("_repeats is null or _own <=> _keep")
    return clear.union(judged.select("_one.*")).toDF(*docs.columns)
