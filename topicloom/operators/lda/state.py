"""Training state: one row per document, ``(doc_id, doc_key, words, z)``.

``words`` holds each term id as often as it occurs, ``z`` the topic of each
occurrence.  The word-topic counts of the model are an aggregation of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import let, run_lengths

TOKENS_PER_PARTITION = 20_000_000


def topic_type(k: int) -> str:
    return "smallint" if k <= 32767 else "int"


def _words(df: DataFrame) -> Column:
    repeated = F.transform(
        F.arrays_zip("term_ids", "tfs"),
        lambda x: F.array_repeat(x["term_ids"], x["tfs"]),
    )
    return F.flatten(repeated)


def base_state(vectors: DataFrame, columns: list, key: str = "doc_id") -> DataFrame:
    """``doc_key`` and ``words`` of each document between given ``columns``; narrow."""
    first, *rest = columns
    return vectors.select(
        first, F.xxhash64(F.col(key)).alias("doc_key"), _words(vectors).alias("words"), *rest
    )


def initial_state(
    vectors: DataFrame, k: int, seed: int = 42, key: str = "doc_id", more: tuple[str, ...] = ()
) -> DataFrame:
    """Random topics from a hash of (seed, document, position), beside ``more`` columns; narrow."""

    def topic(_, at):
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_key"), at), F.lit(k))
        return drawn.cast(topic_type(k))

    state = base_state(vectors, [F.col(key).alias("doc_id"), *more], key)
    return state.withColumn("z", F.transform("words", topic))


def word_topic_counts(state: DataFrame) -> DataFrame:
    """``(term_id, topic, n)``; at most terms x topics rows leave each task."""
    return (
        state.select(F.inline(F.arrays_zip("words", "z")))
        .groupBy(F.col("words").alias("term_id"), F.col("z").cast("int").alias("topic"))
        .agg(F.count("*").alias("n"))
    )


def topic_totals(word_topic: DataFrame) -> DataFrame:
    """``(topic, n)``."""
    return word_topic.groupBy("topic").agg(F.sum("n").alias("n"))


def topic_counts(z: Column, k: int) -> Column:
    """How often each of the ``k`` topics occurs in the array ``z``."""
    runs = run_lengths(F.sort_array(z), "topics", "counts")
    by_topic = let(runs, lambda r: F.map_from_arrays(r["topics"], r["counts"]))

    def filled(counts):
        return F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda t: F.coalesce(F.try_element_at(counts, t.cast(topic_type(k))), F.lit(0)),
        )

    return let(by_topic, filled)
