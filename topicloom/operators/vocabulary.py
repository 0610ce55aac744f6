"""The dictionary: the most frequent stems and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as tx


def term_counts(stemmed: DataFrame) -> DataFrame:
    """``(term, freq)`` from a stem vocabulary; works on distinct tokens, not on the corpus."""
    return (
        stemmed.where(tx.stem_length_ok(F.col("stem")))
        .groupBy(F.col("stem").alias("term"))
        .agg(F.sum("n").alias("freq"))
    )


def vocabulary(counts: DataFrame, size: int = 60_000) -> DataFrame:
    """``(term, term_id, freq)``: the ``size`` most frequent terms, ties in term order.

    A global top-N lets every task send N rows to a single one.  So a histogram
    over powers of the frequency first finds the level that still holds the N-th
    term, and only terms at or above it are sorted.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    levelled = counts.withColumn("level", F.floor(F.log2("freq") * 16).cast("int"))
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        levelled.groupBy("level")
        .agg(F.count("*").alias("terms"))
        .select("level", F.coalesce(F.sum("terms").over(above), F.lit(0)).alias("before"))
        .where(F.col("before") < size)
        .agg(F.min("level"))
        .scalar()
    )
    top = (
        levelled.where(F.col("level") >= cut)
        .select("term", "freq")
        .orderBy(F.desc("freq"), "term")
        .limit(size)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), "term"))
    return top.select("term", (rank - 1).cast("int").alias("term_id"), "freq")


def token_index(stemmed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(token, term_id)`` for each distinct token whose stem is in the dictionary.

    Length limits, stop words and stemming are all settled here, once per distinct
    token; the corpus then needs a single lookup per token.
    """
    terms = dictionary.select(F.col("term").alias("stem"), "term_id")
    return stemmed.join(terms, "stem").select("token", "term_id")
