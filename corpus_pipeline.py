"""A corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontam import without_contaminated
from tessera.llm.mixing import mixed
from tessera.llm.simhash import one_of_each
from tessera.llm.substrings import without_repeats
from tessera.llm.textkit import stored, table
from tessera.llm.toxicity import learn, scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, learned from all labelled documents."""
    model = learn(docs, table(spark, sf_dir, "labels"), held=None)
    return scored(docs, model, *docs.columns, name="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_of_each(docs, shingle_words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier."""
    return without_repeats(docs, window=20)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five-word shingles, containment 0.8 or more)."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), shingle_words=5, least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, one row for each copy (numbered in epoch, from 0)."""
    out = mixed(docs, weights=(5, 2, 1), most=3, seed="mix").where("copies > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies", "target", "source_size")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No stage but the last can be put in SQL (trained scores, fingerprints).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
