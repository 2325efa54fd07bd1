"""What the operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the text contracts define it.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a folder of this machine is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that one operator writes to the shared folder on its way; ``drop`` deletes those
    that nothing reads any more, so that a finished run leaves only what its result is read from."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                deleted(self.spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whichever kind of store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of a bitmap of hashes: 2 MB, whatever the input.
BITMAP_BITS = 1 << 24


def bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of ``BITMAP_BITS`` bits over the hashes of ``columns``: at most
    BITMAP_BITS / 32,768 = 512 rows (_b, _bits) of 4 KB each, so it may be broadcast at any size
    of ``keys``. Null keys count like others."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)).cast("bigint")
    return keys.select(slot.alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))


def marked(df: DataFrame, bits: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``_maybe``: false only where the values of ``columns`` aren't among the keys of
    the bitmap. What it lets through by chance must be judged again, exactly; where a huge input
    fills the bitmap, that is more, and no result changes. ``df`` has no column _s, _b or _bits.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)).cast("bigint")
    found = df.withColumn("_s", slot).join(F.broadcast(bits), F.bitmap_bucket_number("_s") == F.col("_b"), "left")
    bit = F.expr("coalesce(shiftright(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_s) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(_s) % 8 as int)) & 1 = 1, false)")
    return found.withColumn("_maybe", bit).drop("_s", "_b", "_bits")


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows equal in ``keys`` the one whose ``columns`` have the least hash; only
    ``columns`` are returned. Aggregated before the shuffle, so a group may be of any size."""
    plain = [c for c in columns if not rows.schema[c].dataType.typeName() in ("map", "variant")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("_one")).select("_one.*")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, of: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose column ``of`` holds about ``size`` bytes at most
    (one row at least), so that a run of long texts doesn't fill a worker's memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(of))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


_BLANK = re.compile(r"\s")


def parts(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """text[start:end] as (start, end) of parts of ``size`` characters or some more: they end before a
    blank, so no word is cut, and lower-casing, which looks at a word's neighbours, gives the same."""
    while end - start > size:
        blank = _BLANK.search(text, start + size, end)
        cut = blank.start() if blank else end
        yield start, cut
        start = cut
    if start < end:
        yield start, end


def crc32_mod(column: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
