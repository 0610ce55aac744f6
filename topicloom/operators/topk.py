"""Best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group under ``order``, numbered from 1.

    Spark cuts every group to ``k`` rows before the shuffle as well as after it, so
    a group that holds most of the table costs its task ``k`` rows per input task.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)
