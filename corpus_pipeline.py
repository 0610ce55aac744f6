"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir), works on all that the stage before
kept, and returns the columns of documents, but for the last, which returns pieces of
packed sequences.  Stages judge rows by their text; ids are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontaminate, packing, phrases, simhash, toxicity
from topicloom.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of ``labels`` call toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: groups that BK-trees of SimHash
    fingerprints link, checked by a similarity of 0.8 or more of the shingles of five words,
    and what has that similarity out of the trees' reach."""
    return simhash.without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that occur elsewhere go; ``n_chars`` follows the text."""
    cleaned = phrases.without_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences along the curve."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return packing.pack(docs, file.read()).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no way to state these models and fingerprints; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
