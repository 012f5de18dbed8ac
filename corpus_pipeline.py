"""Documents to training bins: quality rules, toxicity, near-duplicates, packing; a Parquet table after each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attest.llm import neardup, packing, quality, toxicity
from attest.llm.common import table, written
from attest.session import prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality.passing(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores below its threshold."""
    prepare(spark)
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    prepare(spark)
    return neardup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin, the place in it and the words of each piece of each document."""
    prepare(spark)
    return packing.best_fit(docs)


STAGES = [("quality-rules", keep_good), ("toxicity", keep_clean), ("near-duplicates", drop_near_copies),
          ("packing", pack)]

#: No SQL: two stages are trained, and the last is a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
