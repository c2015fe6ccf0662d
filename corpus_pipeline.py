"""The corpus pipeline: from raw documents to a mix, through five of the operators.

Each stage works on all rows that its predecessor kept and returns the columns of
documents; the last returns the mix. Between the stages lies a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrain.llm.common import discarding, freeing_shuffles, scratch, table
from loomgrain.llm.decontaminate import drop_leaks
from loomgrain.llm.exact_dedup import drop_copies
from loomgrain.llm.mixing import mix_sources
from loomgrain.llm.quality import drop_rejected
from loomgrain.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes from each document that is left."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", leaks),
    ("mixing", mix),
]

#: Fitted models, fingerprints and edit distances are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = scratch(spark, f"stage-{name.replace(' ', '-').lower()}")
        with discarding(spark, "stage-tables"), freeing_shuffles(spark):  # what only this stage needs goes with it
            out = stage(spark, docs, sf_dir)
            out.write.parquet(kept)
        docs = spark.read.schema(out.schema).parquet(kept)
    return docs
