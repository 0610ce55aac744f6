"""The dictionary on disk: one term per line, the line number being the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import path_exists, table_complete


def write_dictionary(dictionary: DataFrame, path: str) -> DataFrame:
    """Write ``path/terms`` (text) and ``path/table`` (with frequencies); returns the dictionary.

    A dictionary is as large as its vocabulary size, so one task can write the text.
    """
    dictionary.write.mode("overwrite").parquet(f"{path}/table")
    ordered = dictionary.repartition(1).sortWithinPartitions("term_id")
    ordered.select("term").write.mode("overwrite").text(f"{path}/terms")
    return dictionary


def _first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.where(F.col("term_id") < n)


def read_terms(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``(term, term_id)`` from one text file with one term per line; only the first ``n``
    lines if given.

    Lines of several files have no common order, so a directory must hold one file.
    """
    whole = spark.read.text(path, wholetext=True)
    files = whole.inputFiles()
    if len(files) > 1:
        raise ValueError(f"{path} holds {len(files)} files; the terms of one are expected")
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    terms = whole.where("value <> ''").select(F.posexplode(lines).alias("term_id", "term"))
    return _first(terms, n).select("term", "term_id")


def read_dictionary(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``(term, term_id, freq)`` of what ``write_dictionary`` wrote, or ``(term, term_id)``
    of a plain text file; only the first ``n`` terms if given."""
    if path_exists(spark, f"{path}/table"):
        return _first(spark.read.parquet(f"{path}/table"), n)
    return read_terms(spark, path, n)


def dictionary_complete(spark: SparkSession, path: str | None) -> bool:
    """True for both tables of ``write_dictionary``, or a text file that is not empty."""
    if not path or not path_exists(spark, path):
        return False
    if path_exists(spark, f"{path}/table") or path_exists(spark, f"{path}/terms"):
        return table_complete(spark, f"{path}/table") and table_complete(spark, f"{path}/terms")
    return not spark.read.text(path).isEmpty()
