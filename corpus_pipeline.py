"""The corpus pipeline: language ID, toxicity, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return rows of ``docs`` with its columns as they were. Models are fitted on the tables in
``sf_dir``, without the documents that the operators' queries hold out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import exact_dedup, langid, near_dedup, packing, queries, toxicity
from loomspark.llm.common import Scratch, table


def _carried(docs: DataFrame) -> dict:
    """All columns by number; the text, which an operator has anyway, is passed on by it."""
    return {"carry": {f"_k{i}": F.col(c) for i, c in enumerate(docs.columns) if c != "text"}, "text_as": f"_k{docs.columns.index('text')}"}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (``und``), a null text, or no likeness to any language."""
    found = langid.identify(docs, queries.langid_model(spark, sf_dir), **_carried(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0))
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are toxic with a probability of 0.5 or more."""
    found = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), **_carried(docs))
    return found.where("score < 0.5").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the least id stays: one row of each group, null ids last."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more stays: one row of the least
    id. Rows without an id are linked with nothing and stay."""
    return near_dedup.deduplicated(docs, threshold=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", without_toxic), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: SQL can express neither the trained models nor the optimal boundaries; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last keeps is written in the shared folder,
    and deleted when the next stage has written its own."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), ()
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(*before)
        before = (f"stage-{name}",)
    return STAGES[-1][1](spark, docs, sf_dir)
