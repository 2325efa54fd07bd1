"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time some turns longer. A rolling hash of the
first t turns names every prefix of every conversation; a conversation whose own hash is among
the proper prefixes of another goes (anti-join), of equal ones that of the least id stays, and
the rest is rendered.

The rolling hash of a prefix is the sum of 52-bit hashes of (position, hash of role and text) under
each of two seeds: 104 bits in all. A sum can be made of parts, so a conversation is summed in chunks of
``chunk`` turns and no window ever holds one long conversation; equal prefixes of many
conversations (a common first turn) are aggregated before the anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def chatml(role: Column, text: Column) -> Column:
    """One turn, as ChatML; the marks inside a text are set apart by a space, so that no text
    can end its turn."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|", "< |")
    return F.concat(F.lit("<|im_start|>"), clean(role), F.lit("\n"), clean(text), F.lit("<|im_end|>\n"))


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk: int) -> DataFrame:
    """(_conv, _chunk, _in, _role, _text, _c1, _c2): every turn with its place in its chunk and two
    hashes of what it says.

    Turns go by number, then role and text; nulls first. Rows repeated in all four columns count
    once. ``chunk`` numbers, and all turns of equal numbers, make a task's work at most; turns
    without a number are dealt by their text.
    """
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("bigint").alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text")).distinct()
    # Turns without a number are cut by role and first letters, which keeps their order.
    numbered = F.col("_turn").isNotNull()
    rows = rows.withColumn("_chunk", F.struct(F.floor(F.col("_turn") / chunk).alias("n"), F.when(~numbered, F.col("_role")).alias("r"), F.when(~numbered, F.substring("_text", 1, 4)).alias("t")))
    inside = Window.partitionBy("_conv", "_chunk").orderBy("_turn", "_role", "_text")
    said = lambda seed: F.xxhash64(F.lit(seed), F.coalesce("_role", F.lit("\0")), F.coalesce("_text", F.lit("\0")))
    return rows.select("_conv", "_chunk", F.row_number().over(inside).alias("_in"), "_role", "_text", said(1).alias("_c1"), said(2).alias("_c2"))


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(_conv, _at, h1, h2) of ``_turns``: positions from 1 and the hash of the conversation up to
    each. Only hashes and places move here, no text."""
    wide = "decimal(38,0)"
    same = F.col("_conv").eqNullSafe(F.col("_conv2")) & F.col("_chunk").eqNullSafe(F.col("_chunk2"))
    key = [F.col("_conv").alias("_conv2"), F.col("_chunk").alias("_chunk2")]
    before = Window.partitionBy("_conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("_conv", "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select(*key, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    rows = turns.select("_conv", "_chunk", "_in", "_c1", "_c2").join(starts, same, "left").withColumn("_at", F.col("_start") + F.col("_in"))
    # Upper 52 bits of each hash, summed as decimals, which neither wrap nor overflow.
    part = lambda seed, c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_at"), F.col(c)), 12).cast(wide)
    upto = Window.partitionBy("_conv", "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = scratch.write(rows.select("_conv", "_chunk", "_at", F.sum(part(1, "_c1")).over(upto).alias("_px"), F.sum(part(2, "_c2")).over(upto).alias("_py")), "inside")
    ends = rows.groupBy("_conv", "_chunk").agg(F.max(F.struct("_at", "_px", "_py")).alias("_e"))
    carried = ends.select(*key, *[F.coalesce(F.sum(F.col(f"_e.{c}")).over(before), F.lit(0)).cast(wide).alias(to) for c, to in (("_px", "_sx"), ("_py", "_sy"))])
    out = rows.join(carried, same, "left").select("_conv", "_at", (F.col("_px") + F.col("_sx")).cast(wide).alias("h1"), (F.col("_py") + F.col("_sy")).cast(wide).alias("h2"))
    out = scratch.write(out, "prefixes")
    scratch.drop("inside")
    return out


def collapse(marked: DataFrame) -> DataFrame:
    """Of ``_prefixes``, the conversations that stay as (_conv, n_turns, copies)."""
    ends = marked.groupBy("_conv").agg(F.max(F.struct("_at", "h1", "h2")).alias("_e")).select("_conv", F.col("_e._at").alias("n"), F.col("_e.h1").alias("h1"), F.col("_e.h2").alias("h2"))
    whole = ends.groupBy("n", "h1", "h2").agg(F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("copies"))
    # Proper prefixes: a turn that isn't the last of its conversation.
    lengths = ends.select(F.col("_conv").alias("_of"), F.col("n").alias("_len"))
    proper = marked.join(lengths, F.col("_conv").eqNullSafe(F.col("_of"))).where("_at < _len").select(F.col("_at").alias("n"), "h1", "h2").distinct()
    stay = whole.join(proper, ["n", "h1", "h2"], "left_anti")
    return stay.select("_conv", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = 256) -> DataFrame:
    """One row per conversation that stays: its id, n_turns, copies (equal conversations, itself
    included) and chat, the rendered text.

    Null roles and texts are rendered empty but differ from empty ones when hashed; a null
    conversation id is a conversation like others; a conversation of one turn goes if that turn
    begins another; an empty table gives an empty result; other columns of ``turns`` aren't read.
    """
    scratch = Scratch(turns.sparkSession)
    rows = scratch.write(_turns(turns, conv_col, turn_col, role_col, text_col, chunk), "turns")
    stay = scratch.write(collapse(_prefixes(rows, scratch)), "stay")
    scratch.drop("prefixes")
    kept = rows.join(stay.select(F.col("_conv").alias("_k")), F.col("_conv").eqNullSafe(F.col("_k")), "left_semi")
    said = F.array_sort(F.collect_list(F.struct("_chunk", "_in", chatml(F.col("_role"), F.col("_text")).alias("t"))))
    text = kept.groupBy(F.col("_conv").alias("_c")).agg(F.array_join(F.transform(said, lambda x: x["t"]), "").alias("chat"))
    return stay.join(text, F.col("_conv").eqNullSafe(F.col("_c"))).select(F.col("_conv").alias(conv_col), F.col("n_turns").cast("bigint").alias("n_turns"), F.col("copies").cast("bigint").alias("copies"), "chat")
