"""The prefix trie of conversations, in chains.

A node is a distinct sequence of the first d turns; its owner is the least conversation that begins
with it. If a conversation owns a node, it owns all deeper nodes on its way, so it owns one chain:
from its first owned depth to its end, or nothing, if a smaller conversation begins with all of it.
The first owned depth is found by binary search: a conversation's prefix digest at a probed depth is
joined with the least conversation of that digest. Each round probes a batch of depths for every
conversation that isn't settled, so a few rounds do for conversations of any length.

A chain hangs on the node before its first, which the last probe has named. Sums over subtrees
(leaves, saved code points) are taken over chains, bottom-up: each round adds what hangs twice as far
below and doubles the distance, so a tower of n chains takes log(n) rounds. Inside a chain they
are sums from its end.

Digests are the exclusive-or of 64-bit hashes of (place, role, text) under two seeds: 128 bits, made
of parts, so that no task holds one long conversation. Turns get their places in a table sorted by
ranges of (conversation, turn, role, text), which cut a long conversation too; windows run inside
``CHUNK`` places and over chunks. Joins whose one side may hold a key in a third of all rows read
written tables, so that adaptive execution can split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Places of a conversation that one window takes in.
CHUNK = 1_024
#: Depths of a conversation that one round of the search probes.
BATCH = 7
#: A node's ends are written down by ranges of so many conversation ids.
ENDS = 10_000


def ordered(turns: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, a, b, chars), with ``texts`` also (role, text): places from 1 and what is said
    there, as two hashes and a number of code points; and (conv, n): number of turns.

    Turns go by number, nulls first, then by role and text; equal rows follow each other. Null
    roles and texts are empty. Rows without a conversation id take no part."""
    said = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((role_col, "role"), (text_col, "text"))])
    keys = ["conv", "turn", "role", "text"]
    rows = said.where("conv is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    rows = rows.repartitionByRange(*keys, "copy").sortWithinPartitions(*keys, "copy")
    code = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    at = F.monotonically_increasing_id()
    rows = scratch.write(rows.select("conv", code(1).alias("a"), code(2).alias("b"), F.length("text").cast("bigint").alias("chars"), *(["role", "text"] if texts else []), F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("i")), "sorted")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(F.min("i").alias("lo"), F.count(F.lit(1)).alias("c"))
    parts = scratch.write(parts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))), "parts")
    sizes = scratch.write(parts.groupBy("conv").agg(F.sum("c").alias("n")), "sizes")
    starts = parts.select("conv", "part", (F.col("before") - F.col("lo") + 1).alias("shift"))
    rows = rows.join(starts, ["conv", "part"]).withColumn("pos", F.col("i") + F.col("shift")).drop("part", "i", "shift")
    return rows, sizes


def shared_heads(rows: DataFrame, sizes: DataFrame, scratch: Scratch, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share beginnings, in the shape of ``ordered`` (both):
    conversation c has the first h = crc32(c as decimal) % ``most`` turns of conversation
    c - c % ``group``, then its own turns after its first h. A head that isn't there is empty.
    Of a negative c, the remainder is negative, as in SQL."""
    taken = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    rows = scratch.write(rows, "places")
    convs = sizes.select("conv", "n", taken(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    of_base = sizes.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = scratch.write(convs.select("conv", "n", "h", "m", "base"), "heads")
    first = rows.where((F.col("conv") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    heads = convs.where("m > 0").select("conv", "base", "m").join(first, "base").where("pos <= m").drop("base", "m")
    # Only conversations whose head is shorter than h need to know so: few, and one row each.
    own = rows.where(F.col("pos") > taken(F.col("conv")))
    short = convs.where("m < h").select("conv", (F.col("m") - F.col("h")).alias("less"))
    own = own.join(short, "conv", "left").withColumn("pos", F.col("pos") + F.coalesce("less", F.lit(0))).drop("less")
    lengths = convs.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return heads.unionByName(own), lengths


def running(rows: DataFrame, key: str, place: str, sums: dict[str, Column], backwards: bool, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with each aggregate of ``sums`` (of bit_xor or sum, by name) over the rows of
    ``key`` from the first to each, or with ``backwards`` from the last: first inside chunks of
    places, then chunk by chunk. ``sums`` maps a name to a column of ``rows``."""
    combine = F.sum if backwards else F.bit_xor
    way = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    chunk = F.floor(F.col(place) / CHUNK).alias("chunk")
    inside = Window.partitionBy(key, "chunk").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", chunk)
    rows = scratch.write(rows.select(*[c for c in rows.columns if c not in sums], *[combine(c).over(inside).alias(n) for n, c in sums.items()]), name)
    # The end of a chunk holds the chunk's whole; a key of one chunk needs no more.
    last = F.min if backwards else F.max
    ends = rows.groupBy(key, "chunk").agg(last(F.col(place)).alias("edge"))
    ends = ends.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy(key))).where("chunks > 1")
    whole = ends.join(rows.select(key, "chunk", F.col(place).alias("edge"), *sums), [key, "chunk", "edge"])
    carried = scratch.write(whole.select(key, "chunk", *[combine(n).over(before).alias(f"_{n}") for n in sums]), f"{name}-carried")
    both = rows.join(carried, [key, "chunk"], "left")
    zero = F.lit(0).cast("bigint")
    add = (lambda n: F.col(n) + F.coalesce(f"_{n}", zero)) if backwards else (lambda n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", zero)))
    return both.select(*[c for c in rows.columns if c not in sums and c != "chunk"], *[add(n).alias(n) for n in sums])


def prefixes(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, d1, d2, chars): digests of the first turns of each conversation, from none on,
    and the code points of the last of them."""
    placed = lambda seed, c: F.xxhash64(F.lit(seed), "pos", c)
    summed = running(rows.select("conv", "pos", "a", "b", "chars"), "conv", "pos", {"d1": placed(3, "a"), "d2": placed(4, "b")}, False, scratch, "digests")
    zero = F.lit(0).cast("bigint")
    roots = lengths.select("conv", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("chars"))
    return scratch.write(summed.select("conv", F.col("pos").alias("depth"), "d1", "d2", "chars").unionByName(roots), "prefixes")


def first_owned(held: DataFrame, minima: DataFrame, lengths: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv, n, first, parent): the first depth that a conversation owns, n + 1 if none, and the
    owner of the depth before; null for the root's owner."""
    state = lengths.select("conv", "n", F.when(F.col("conv") == root, 0).otherwise(1).cast("bigint").alias("lo"), F.when(F.col("conv") == root, 0).otherwise(F.col("n") + 1).cast("bigint").alias("hi"), F.when(F.col("conv") != root, root).cast("bigint").alias("parent"))
    state, settled, turn = scratch.write(state, "state0"), [], 0
    while True:
        settled.append(state.where("lo >= hi"))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        # All depths of a short range, else depths that cut it into BATCH + 1 parts.
        spread = F.transform(F.sequence(F.lit(1), F.lit(BATCH)), lambda i: F.col("lo") + F.floor(i * (F.col("hi") - F.col("lo")) / (BATCH + 1)))
        depths = F.when(F.col("hi") - F.col("lo") <= BATCH, F.sequence("lo", F.col("hi") - 1)).otherwise(spread)
        probes = state.select("conv", F.explode(depths).alias("depth")).join(held.select("conv", "depth", "d1", "d2"), ["conv", "depth"])
        met = scratch.write(probes.join(minima.select("depth", "d1", "d2", "owner"), ["depth", "d1", "d2"]).select("conv", "depth", "owner"), f"met{turn}")
        other = F.col("owner") != F.col("conv")
        news = met.groupBy("conv").agg(F.max(F.when(other, F.struct("depth", "owner"))).alias("below"), F.min(F.when(~other, F.col("depth"))).alias("owned"))
        state = scratch.write(
            state.join(news, "conv").select("conv", "n", F.coalesce(F.col("below.depth") + 1, "lo").alias("lo"), F.coalesce("owned", "hi").alias("hi"), F.coalesce("below.owner", "parent").alias("parent")), f"state{turn + 1}"
        )
        scratch.drop(f"met{turn}")
        turn += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    found = scratch.write(out.select("conv", "n", F.col("hi").alias("first"), "parent"), "found")
    scratch.drop(*[f"state{i}" for i in range(turn + 1)])
    return found


def totals(chains: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """(conv, *sums) of chains (conv, parent, *sums): sums over each chain and all that hang below
    it, by pointer doubling. After round i a row holds what is less than 2**i chains below."""
    rows, turn = scratch.write(chains.select("conv", F.col("parent").alias("up"), *sums), "up0"), 0
    while not rows.where("up is not null").isEmpty():
        below = scratch.write(rows.where("up is not null").groupBy("up").agg(*[F.sum(s).alias(f"_{s}") for s in sums]).withColumnRenamed("up", "conv"), f"below{turn}")
        # Whose parent hangs on nothing has no further one; so the root isn't a join's hot key.
        inner = scratch.write(rows.where("up is not null").select(F.col("conv").alias("up"), F.col("up").alias("further")), f"inner{turn}")
        zero = F.lit(0).cast("bigint")
        added = rows.join(below, "conv", "left").select("conv", "up", *[(F.col(s) + F.coalesce(f"_{s}", zero)).alias(s) for s in sums])
        rows = scratch.write(added.join(inner, "up", "left").select("conv", F.col("further").alias("up"), *sums), f"up{turn + 1}")
        scratch.drop(f"below{turn}", f"inner{turn}", f"up{turn}")
        turn += 1
    return rows.select("conv", *sums)


def ends_of(found: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): digest of the decimal ids, ascending, with commas between, of the
    conversations that end at a node. Ids are joined by ranges, in many tasks; the digest, which
    can't be taken in parts, then reads one range after the other and holds one at a time."""
    at = F.when(F.col("first") <= F.col("n"), F.col("conv")).otherwise(F.col("parent"))
    rows = found.select(at.alias("owner"), F.col("n").alias("depth"), "conv", F.floor(F.col("conv") / ENDS).alias("range"))
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")))
    rows = rows.groupBy("owner", "depth", "range").agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("owner", "depth", "ids")], strict=True):
                if (owner, depth) != key:
                    if digest:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield out(done)
        if digest:
            yield out([(*key, digest.hexdigest())])

    def out(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])

    dealt = rows.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "range").select("owner", "depth", "ids")
    return dealt.mapInArrow(hashed, "owner bigint, depth bigint, ends_sha256 string")


def tree(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of ``rows`` and ``lengths``, as ``ordered`` and ``shared_heads`` give
    them: conv_id (the node's least conversation), depth, parent_conv_id (the least of its parent; null
    at the root), n_convs, n_children, n_leaves (nodes below it, itself included, that have no
    child), saved_tokens (over the same nodes, (n_convs - 1) x code points of the last turn),
    ends_sha256. ``conv_id`` and ``depth`` name a node. No conversations, no nodes."""
    lengths = scratch.write(lengths, "lengths")
    root = lengths.agg(F.min("conv")).first()[0]
    held = prefixes(rows, lengths, scratch)
    minima = scratch.write(held.groupBy("depth", "d1", "d2").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")), "minima")
    found = first_owned(held, minima, lengths, root if root is not None else 0, scratch)
    scratch.drop("sorted", "parts", "sizes", "places", "heads", "digests", "digests-carried", "prefixes")

    chains = found.where("first <= n")
    hung = chains.where("parent is not null").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"), "conv")
    kids = scratch.write(hung.groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("kids")), "kids")
    cost = (F.col("n_convs") - 1) * F.col("chars")
    own = scratch.write(minima.groupBy(F.col("owner").alias("conv")).agg(F.sum(cost).alias("saved")), "own")
    at_end = kids.select(F.col("owner").alias("conv"), F.col("depth").alias("n"), F.lit(0).cast("bigint").alias("leaf"))
    sized = chains.join(own, "conv").join(at_end, ["conv", "n"], "left").select("conv", "parent", F.coalesce("leaf", F.lit(1).cast("bigint")).alias("leaves"), "saved")
    sums = scratch.write(totals(sized, ["leaves", "saved"], scratch), "totals")

    zero = F.lit(0).cast("bigint")
    below = scratch.write(hung.join(sums, "conv").groupBy("owner", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("kids")), "below")
    nodes = minima.select("owner", "depth", "n_convs", "chars").join(below, ["owner", "depth"], "left")
    nodes = nodes.join(chains.select(F.col("conv").alias("owner"), "n", "first", "parent"), "owner")
    nodes = nodes.withColumn("n_children", F.coalesce("kids", zero) + (F.col("depth") < F.col("n")).cast("bigint"))
    leaves = F.coalesce("l", zero) + (F.col("n_children") == 0).cast("bigint")
    nodes = nodes.select("owner", "depth", "n_convs", "n_children", F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent"), leaves.alias("leaves"), (cost + F.coalesce("s", zero)).alias("saved"))
    nodes = running(nodes, "owner", "depth", {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, True, scratch, "nodes")
    ends = scratch.write(ends_of(found), "ends")
    scratch.drop("minima", "found", "kids", "own", "totals", "below", "lengths")
    out = nodes.join(ends, ["owner", "depth"], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share: bool = False, texts: bool = False) -> DataFrame:
    """The nodes of the prefix trie of conversations (see ``tree``); with ``share``, of conversations
    rebuilt by ``shared_heads``; with ``texts``, also role and text of each node's last turn
    (null at the root).

    Turns go by number, nulls first, then by role and text; equal rows are turns of their own; null
    roles and texts are empty; rows without a conversation id take no part; an empty table gives
    an empty result; other columns of ``turns`` aren't read.
    """
    scratch = Scratch(turns.sparkSession)
    rows, lengths = ordered(turns, scratch, conv_col, turn_col, role_col, text_col, texts)
    if share:
        rows, lengths = shared_heads(rows, lengths, scratch)
    if texts:
        rows = scratch.write(rows, "said")
    out = tree(rows, lengths, scratch)
    if not texts:
        return out
    said = rows.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "role", "text")
    return out.join(said, ["conv_id", "depth"], "left")
