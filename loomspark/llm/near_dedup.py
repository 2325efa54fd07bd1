"""Near-duplicate detection: SetSketch registers, band keys, likelihood, exact verification.

1. Every text becomes a set of word shingles; its SetSketch registers are written to a table in
   the shared folder, the sets are not.
2. Texts with equal sets form a class; from here on only classes take part. A class is named by a
   number of its own, not by an id, so rows repeated with one id but other texts keep their sets.
3. Leaders: in each bucket (classes with an equal band key) the others are compared with the one
   of least id, so a bucket of n sends n - 1 pairs, however large. Joint likelihood of the
   registers rejects hopeless pairs, the full sets decide the rest, and confirmed links make
   components.
4. Rest: a bucket of two, or one whose other members now lie in one component, holds no news. In
   the others, members of different components are compared in blocks of bounded size, each pair
   in the first band that it shares only; the members of a bucket's largest component aren't
   compared with each other, so a bucket that holds a large group and a few strangers costs the
   strangers times the bucket. Pairs are judged first by the likelihood of their registers, then by
   their shingles cut to 16 bits, which bound the similarity from above. What the bound admits, in
   practice the links, leaves the task, and full sets decide again.

Nothing caps buckets, partners or candidates. Odds to miss a pair of exactly the threshold: no
shared band (32 bands of 5 registers) 7e-9 at 0.85 and 3e-6 at 0.8; rejected by the likelihood
less than 1e-5; in step 4, rejected for too few equal registers (a cheap cut before the
likelihood, ``CUT`` under the threshold; registers agree independently, each with the odds of the
similarity or better) less than 1e-10. A likelier link is missed less often.

Full sets of texts are made again only of classes that share a bucket: a bitmap of fixed size picks
their rows where they lie, so texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, marked, one_of_each, pieces
from .setsketch import SetSketch
from .shingles import shingle_sets

BAND_ROWS = 5
#: A pair is rejected if its best similarity at the threshold or above is that much less likely
#: (in logarithms) than the best of all: 4.5 standard deviations.
SLACK = 10.0
#: Members of one bucket that one task compares at once are at most about twice as many.
BLOCK = 512
#: Bits of a band key that hold the band.
_BAND_BITS = 5
_BAND_MASK = (1 << _BAND_BITS) - 1
#: Pairs with a share of equal registers so far below the threshold aren't looked at further.
CUT = 0.25


def _sums(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, which with its size stand for the set."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)))
    mixed = np.concatenate(([np.uint64(0)], np.cumsum((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)))
    return [(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in (total, mixed)]


def _sketches(width: int):
    sketch = SetSketch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, offsets = shingle_sets(piece.column("text").to_pylist(), width)
            registers = sketch.registers(hashes, offsets)
            columns = [pa.array(np.diff(offsets), pa.int64()), *map(pa.array, _sums(hashes, offsets)), pa.array([r.tobytes() for r in registers], pa.binary())]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), *columns], ["_id", "n", "s1", "s2", "regs"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, offsets = shingle_sets(piece.column("text").to_pylist(), width)
            top = (hashes >> np.uint64(48)).astype(np.uint16)
            short = [np.unique(top[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [pa.array(np.diff(offsets), pa.int64()), *map(pa.array, _sums(hashes, offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64))), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), *columns], ["_id", "n", "s1", "s2", "shingles", "short"])

    return run


def _plausible(sketch: SetSketch, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the registers of each pair admit the threshold."""
    steps = 33
    below, above = np.linspace(0, threshold, steps), np.linspace(threshold, 1, 17)
    ll = sketch.log_likelihood(x, y, nx, ny, np.concatenate((below, above)))
    return (ll[:, steps:].max(axis=1) >= ll.max(axis=1) - SLACK) & (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9)


def _registers(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, m)


def _filter_pairs(threshold: float):
    """Keeps plausible pairs: columns a, b, na, nb, ra, rb in, a, b out."""
    sketch = SetSketch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, rows=4096, of="ra"):
            if piece.num_rows:
                keep = _plausible(sketch, _registers(piece.column("ra"), sketch.m), _registers(piece.column("rb"), sketch.m), piece.column("na").to_numpy(), piece.column("nb").to_numpy(), threshold)
                yield piece.select(["a", "b"]).filter(pa.array(keep))

    return run


def _compare_cells(threshold: int):
    """Rows sorted by cell (key, i, j): pairs of different components, one from block i and one
    from block j, that may be similar enough. A cell has about 2 * BLOCK rows at most. The lower
    bits of a key are its band."""
    sketch, share = SetSketch(), threshold / 100

    def cell(rows: list) -> Iterator[tuple[int, int]]:
        comp = np.array([r[2] for r in rows])
        if (comp == comp[0]).all():
            return
        ids, n, block = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        regs = np.frombuffer(b"".join([r[4] for r in rows]), np.int16).reshape(-1, sketch.m)
        i, j, key = rows[0][5:8]
        band = key & _BAND_MASK
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        short: dict[int, np.ndarray] = {}
        marked = np.zeros(1 << 16, bool)
        for x in left.tolist():
            other = right[(comp[right] != comp[x]) & ((right > x) if i == j else True)]
            # Cheap cuts first: sizes, the number of equal registers, the band.
            other = other[np.minimum(n[other], n[x]) >= share * np.maximum(n[other], n[x]) - 1e-9]
            if not len(other):
                continue
            equal = regs[other] == regs[x]
            keep = equal.sum(axis=1) >= sketch.m * (share - CUT)
            keep &= equal.reshape(len(other), -1, BAND_ROWS).all(axis=2).argmax(axis=1) == band
            other = other[keep]
            if not len(other):
                continue
            other = other[_plausible(sketch, np.broadcast_to(regs[x], (len(other), sketch.m)), regs[other], np.full(len(other), n[x]), n[other], share)]
            if not len(other):
                continue
            own = np.frombuffer(rows[x][8], np.uint16)
            marked[own] = True
            for y in other.tolist():
                if y not in short:
                    short[y] = np.frombuffer(rows[y][8], np.uint16)
                # Shingles that fall together in 16 bits could all be in the other set as well.
                both = int(marked[short[y]].sum()) + min(int(n[x]) - len(own), int(n[y]) - len(short[y]))
                both = min(both, int(n[x]), int(n[y]))
                if 100 * both >= threshold * (int(n[x]) + int(n[y]) - both):
                    yield min(ids[x], ids[y]), max(ids[x], ids[y])
            marked[own] = False

    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for got in batches:
            columns = [got.column(c).to_pylist() for c in ("cls", "n", "comp", "block", "regs", "i", "j", "key", "short")]
            for r in zip(*columns, strict=True):
                if r[5:8] != at:
                    out.extend(cell(rows) if len(rows) > 1 else ())
                    at, rows = r[5:8], []
                rows.append(r)
            if out:
                yield batch(out)
                out = []
        out.extend(cell(rows) if len(rows) > 1 else ())
        if out:
            yield batch(out)

    return run


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(_id, comp): the least id reachable, for each row of ``nodes`` (_id), over ``edges`` (a, b).

    Each round takes the least label of the neighbours, then the label's own label; rounds end
    when nothing changes, after about the logarithm of the longest path. Labels are written to
    the shared folder in every round; those of the round before the last are deleted.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels, at = scratch.write(both.select(F.col("a").alias("_id")).distinct().withColumn("comp", F.col("_id")), "labels-0"), 0
    while True:
        near = both.join(labels.select(F.col("_id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("_near"))
        step = labels.join(near.withColumnRenamed("a", "_id"), "_id", "left").select("_id", F.col("comp").alias("_was"), F.least("comp", F.coalesce("_near", "comp")).alias("comp"))
        hop = labels.select(F.col("_id").alias("comp"), F.col("comp").alias("_hop"))
        labels = scratch.write(step.join(hop, "comp", "left").select("_id", "_was", F.least("comp", F.coalesce("_hop", "comp")).alias("comp")), f"labels-{at + 1}")
        scratch.drop(f"labels-{at}")
        at += 1
        if labels.where("comp <> _was").isEmpty():
            break
        labels = labels.drop("_was")
    scratch.drop("both")
    return nodes.join(labels.select("_id", "comp"), "_id", "left").select("_id", F.coalesce("comp", "_id").alias("comp"))


def _labels(scratch: Scratch) -> list[str]:
    return [name for name in scratch.paths if name.startswith("labels-")]


def _links(source: DataFrame, classes: DataFrame, threshold: int, width: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between classes, enough of them to make the components."""
    share, write = threshold / 100, scratch.write
    bands = SetSketch().m // BAND_ROWS
    size = BAND_ROWS * 2  # bytes of a band
    # The band is part of what is hashed and stands in the key's lower bits.
    own = F.substring("regs", F.col("b") * size + 1, F.lit(size))
    slots = classes.select("cls", "rep", "regs", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("b"))
    slots = slots.select("cls", "rep", F.shiftleft(F.xxhash64("b", own), _BAND_BITS).bitwiseOR(F.col("b").cast("bigint")).alias("key"))
    # A bucket needs two members; its leader is the class of least id, of several the least class.
    heads = write(slots.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"), "heads")
    members = write(marked(slots, write(bitmap(heads, "key"), "bits"), "key").where("_maybe").join(heads, "key").select("key", "cls", "size", (F.col("rep") == F.col("least")).alias("first")), "members")
    # Written, so that the join with them can be split where a bucket is large.
    leads = write(members.where("first").groupBy("key").agg(F.min("cls").alias("lead")), "leads")
    members = write(members.drop("first").join(leads, "key"), "buckets")
    wanted = members.select("cls").distinct()
    some = write(marked(classes, write(bitmap(members, "cls"), "bits"), "cls").where("_maybe").join(wanted, "cls", "left_semi").select("cls", "rep", "n", "s1", "s2", "regs"), "registers")
    names = some.select(F.col("rep").alias("_id"), "n", "s1", "s2", "cls")
    sets = marked(source, write(bitmap(some, "rep"), "bits"), "_id").where("_maybe").select("_id", "text")
    sets = sets.mapInArrow(_sets(width), "_id bigint, n bigint, s1 bigint, s2 bigint, shingles array<bigint>, short binary")
    # One row of those that make the class: repeated rows are aggregated before the shuffle.
    key = ["_id", "n", "s1", "s2"]
    sets = sets.where("n > 0").groupBy(*key).agg(F.first("shingles").alias("shingles"), F.first("short").alias("short"))
    sets = write(sets.join(names, key).select("cls", "shingles", "short"), "shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("_both", F.size(F.array_intersect("sa", "sb")))
        return both.where(f"100 * _both >= {threshold} * (size(sa) + size(sb) - _both)").select("a", "b")

    pairs = members.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    ra = some.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    rb = some.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    plausible = pairs.join(ra, "a").join(rb, "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")
    plausible = write(plausible.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_filter_pairs(share), "a bigint, b bigint"), "plausible")
    links = write(confirmed(plausible), "links")
    first = write(components(wanted.select(F.col("cls").alias("_id")), links, scratch).withColumnRenamed("_id", "cls"), "first")

    # What is left: members of different components; the leader has been compared with all.
    rest = members.where("size > 2 and cls <> lead").select("key", "cls").join(first, "cls")
    parts = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    # Written, so that a join with it can be split where a bucket is large.
    parts = parts.where("kinds > 1").select("key", F.col("top.comp").alias("major"), blocks(F.col("top.c")).alias("inside"), blocks(F.col("all") - F.col("top.c")).alias("outside"))
    parts = write(parts, "parts")
    rest = rest.join(parts, "key")
    deal = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    major, every = F.col("comp") == F.col("major"), F.col("inside") + F.col("outside")
    rest = rest.withColumn("block", F.when(major, deal(F.col("inside"))).otherwise(F.col("inside") + deal(F.col("outside"))))
    # A row goes to the cells of its block with each other block that may hold news for it.
    cells = rest.select("cls", "key", "comp", "block", F.explode(F.sequence(F.when(major, F.col("inside")).otherwise(F.lit(0)), every - 1)).alias("_o"))
    cells = cells.select("cls", "key", "comp", "block", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j")).join(some.select("cls", "n", "regs"), "cls").join(sets.select("cls", "short"), "cls")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    late = cells.select("cls", "n", "comp", "block", "regs", "i", "j", "key", "short").mapInArrow(_compare_cells(threshold), "a bigint, b bigint").distinct()
    found = write(links.union(confirmed(write(late, "late"))), "all-links")
    scratch.drop("heads", "bits", "members", "leads", "buckets", "parts", "registers", "shingles", "plausible", "links", "first", "late", *_labels(scratch))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, width: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable over links
    of a similarity of ``threshold`` per cent or more), kept (id = component_id).

    A null, empty or blank text has an empty set and no link; a text of fewer than ``width``
    words has one shingle. Texts of equal sets are linked. Rows repeated with one id, whatever
    their texts, count as one document with the links of each; a row with a null id has no link,
    component_id null and kept true. An empty table gives an empty result; other columns of
    ``docs`` aren't read. The result is read from the tables "rows" and "components" of
    ``scratch``; the others are deleted.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text"))
    marks = scratch.write(source.mapInArrow(_sketches(width), "_id bigint, n bigint, s1 bigint, s2 bigint, regs binary"), "sketches")
    # Of equal sets, registers are equal too.
    classes = marks.where("n > 0 and _id is not null").groupBy("n", "s1", "s2").agg(F.min("_id").alias("rep"), F.first("regs").alias("regs"))
    classes = scratch.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows = marks.select("_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "cls", "rep"), ["n", "s1", "s2"], "left")
    rows = scratch.write(rows.select("_id", "n", F.when(F.col("_id").isNotNull(), F.col("cls")).alias("cls"), F.col("rep")), "rows")
    scratch.drop("sketches")
    links = _links(source, classes, threshold, width, scratch)
    # The classes of one id are linked.
    same = rows.where("cls is not null").groupBy("_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    same = rows.where("cls is not null").join(same.select("_id", "a"), "_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    linked = scratch.write(links.union(same), "edges")
    nodes = linked.select(F.col("a").alias("_id")).union(linked.select(F.col("b").alias("_id"))).distinct()
    comps = scratch.write(components(nodes, linked, scratch).select(F.col("_id").alias("cls"), "comp").join(classes.select("cls", "rep"), "cls"), "members")
    least = scratch.write(comps.groupBy("comp").agg(F.min("rep").alias("_least")), "leads")
    least = scratch.write(comps.join(least, "comp").select("cls", "_least"), "components")
    scratch.drop("classes", "all-links", "edges", "members", "leads", *_labels(scratch))

    out = rows.join(least, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.coalesce("_least", "rep"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("_id").eqNullSafe(comp).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns as they were.

    It is the row with the component's least id; of several rows with that id the one whose
    columns have the least hash, and one of those that are alike in all. Rows with a null id have
    no link and all stay. An empty table gives an empty result.

    A row whose id occurs once and is its component's least stays where it is read: only the
    others, found by a bitmap of their ids, are joined.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs, id_col, text_col, threshold, width, scratch).where(F.col(id_col).isNotNull())
    fate = found.groupBy(F.col(id_col).alias("_id")).agg(F.min("kept").alias("_stays"), F.count(F.lit(1)).alias("_rows")).where("not _stays or _rows > 1")
    fate = scratch.write(fate.select(F.col("_id").alias("_of"), "_stays"), "fate")
    scratch.drop("rows", "components")
    names = [f"_k{i}" for i in range(len(docs.columns))]
    own = F.col(names[docs.columns.index(id_col)]).cast("bigint")
    rows = marked(docs.toDF(*names).withColumn("_of", own), scratch.write(bitmap(fate, "_of"), "doubtful"), "_of")
    # Repeats of an id meet once they are one row of each task; those without an id stay as they are.
    clear, doubtful = rows.where("not _maybe or _of is null").select(*names), rows.where("_maybe and _of is not null")
    one = one_of_each(doubtful, ["_of"], names).withColumn("_of", own).join(fate, "_of", "left")
    return clear.union(one.where("coalesce(_stays, true)").select(*names)).toDF(*docs.columns)
