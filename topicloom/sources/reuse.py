"""Load a table that an earlier run completed, or build and keep it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.session import table_complete
from topicloom.sources.dictionary import (
    dictionary_complete,
    read_dictionary,
    write_dictionary,
)


def load_or_build(
    spark: SparkSession, path: str | None, build: Callable[[], DataFrame]
) -> DataFrame:
    """Read the parquet table at ``path`` if complete; else build it, and write it if named."""
    if not table_complete(spark, path):
        built = build()
        if not path:
            return built
        built.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_or_fit_dictionary(
    spark: SparkSession, path: str | None, fit: Callable[[], DataFrame], n: int | None = None
) -> DataFrame:
    """Existing dictionary: read.  Named but missing: fit and write.  Unnamed: fit."""
    if not dictionary_complete(spark, path):
        fitted = fit()
        if not path:
            return fitted
        write_dictionary(fitted, path)
    return read_dictionary(spark, path, n)
