"""Tables in the shared folder, sets that only grow, and row numbers that split hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a set's bitmap: 2 MB, whatever it holds.
BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session, as in tests, may have none set
    and then takes one of its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, outlives executors."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _slots(keys: list[str]) -> list[Column]:
    """Two places of a key in the bitmap."""
    return [F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(BITS)).cast("bigint") for seed in (1, 2)]


def bitmap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_b, _bits): the bitmap of the rows' keys, at most BITS / 32,768 = 512 rows of 4 KB."""
    slots = rows.select(F.explode(F.array(*_slots(keys))).alias("_s"))
    return slots.groupBy(F.bitmap_bucket_number("_s").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))


def _bit(bits: str, slot: str) -> Column:
    at = f"bitmap_bit_position({slot})"
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 + 1 as int), 1)), 16, 10) as int)"
    return F.expr(f"coalesce(shiftright({byte}, cast({at} % 8 as int)) & 1 = 1, false)")


def marked(rows: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with _maybe: false only where the key isn't in the bitmap. The bitmap's size is
    bounded, so it is broadcast."""
    for i, slot in enumerate(_slots(keys)):
        named = bits.select(F.col("_b").alias(f"_b{i}"), F.col("_bits").alias(f"_bits{i}"))
        rows = rows.withColumn(f"_s{i}", slot).join(F.broadcast(named), F.bitmap_bucket_number(f"_s{i}") == F.col(f"_b{i}"), "left")
    found = rows.withColumn("_maybe", _bit("_bits0", "_s0") & _bit("_bits1", "_s1"))
    return found.drop(*[f"_{c}{i}" for c in ("s", "b", "bits") for i in (0, 1)])


class SeenSet:
    """A set of keys that only grows: written tables of rows, one for each addition, and a bitmap of
    fixed size over all of them. Adding writes the bitmap and nothing else; asking reads the keys
    that the bitmap can't rule out, and moves only those that the asking rows can't rule out."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.parts, self.bits = keys, [], None

    def add(self, rows: DataFrame) -> None:
        """``rows``: a written table, which the set goes on reading."""
        bits = bitmap(rows, self.keys)
        if self.bits is not None:
            bits = bits.unionByName(self.bits).groupBy("_b").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        self.bits = written(bits, "bits")
        self.parts.append(rows.select(*self.keys))

    def new(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (a written table) whose key isn't in the set. Null keys equal each other."""
        if not self.parts:
            return rows
        judged = marked(rows, self.bits, self.keys)
        doubtful = judged.where("_maybe").drop("_maybe")
        held = self.parts[0]
        for p in self.parts[1:]:
            held = held.unionByName(p)
        asked = written(bitmap(doubtful, self.keys), "bits")
        held = marked(held, asked, self.keys).where("_maybe").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return judged.where("not _maybe").drop("_maybe").unionByName(doubtful.join(held, on, "left_anti"))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], into: str = "rn", name: str = "numbered") -> DataFrame:
    """``rows`` with their number, from 1, among those of equal ``keys``, by ``order`` (which tells
    all rows of a key apart, else equal ones are numbered as they come).

    Rows are sorted by ranges of (keys, order), so a key with a third of all rows lies in many
    tasks; each range counts its rows of a key, and a number is that of the ranges before plus the
    place in its own. No task holds a whole key, and rows move twice."""
    places = [F.col(k) for k in keys] + order
    at, own = F.monotonically_increasing_id(), [f"_n_{i}" for i in range(len(keys))]
    rows = rows.repartitionByRange(*places).sortWithinPartitions(*places)
    rows = written(rows.select("*", F.shiftright(at, 33).alias("_n_part"), at.bitwiseAND((1 << 33) - 1).alias("_n_at")), name)
    before = Window.partitionBy(*own).orderBy("_n_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_n_part").alias("_n_p")).agg(F.min("_n_at").alias("_n_lo"), F.count(F.lit(1)).alias("_n_c"))
    parts = written(parts.withColumn("_n_before", F.coalesce(F.sum("_n_c").over(before), F.lit(0))), name)
    on = F.col("_n_part") == F.col("_n_p")
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    found = rows.join(parts, on).withColumn(into, F.col("_n_at") - F.col("_n_lo") + 1 + F.col("_n_before"))
    return found.drop("_n_part", "_n_at", "_n_p", "_n_lo", "_n_c", "_n_before", *own)
