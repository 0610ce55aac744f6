"""Reproducible sampling and splitting.

A document is judged by a hash of its own key and the seed, so the outcome does
not depend on how the table is partitioned, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_SALT = "split"


def hash32(*parts: Column) -> Column:
    """Uniform integer in [0, 2^32) from the colon-joined ``parts``."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _fraction(name: str, value: float) -> int:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be in [0, 1]")
    return round(value * 2**32)


def subsample(df: DataFrame, ratio: float, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Keep about ``ratio`` of the documents; 1.0 keeps all."""
    threshold = _fraction("ratio", ratio)
    if ratio == 1.0:
        return df
    return df.where(hash32(F.col(key), F.lit(seed)) < threshold)


def with_split(
    df: DataFrame, test_fraction: float, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """Add ``split``: ``test`` for about ``test_fraction`` of the documents, else ``train``."""
    threshold = _fraction("test_fraction", test_fraction)
    drawn = hash32(F.col(key), F.lit(seed), F.lit(SPLIT_SALT))
    return df.withColumn("split", F.when(drawn < threshold, "test").otherwise("train"))


def train_test_split(
    df: DataFrame, test_fraction: float, seed: int = 42, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Disjoint and complete (train, test); a fraction of 0 leaves the test set empty."""
    marked = with_split(df, test_fraction, seed, key)
    train = marked.where(F.col("split") == "train").drop("split")
    return train, marked.where(F.col("split") == "test").drop("split")
