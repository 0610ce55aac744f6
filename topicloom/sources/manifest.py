"""What saved tables were made of: digests of their content, kept beside them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import table_complete


def digest(df: DataFrame, columns: Sequence[str]) -> str:
    """A digest of the rows in ``columns`` that depends on neither order nor partitioning.

    Rows, and the sums of two hashes of each: repeated rows count, in one aggregation.
    """
    hashes = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
    sums = [F.sum(h.cast("decimal(38,0)")) for h in hashes]
    row = df.agg(F.count("*"), *sums).first()
    return ":".join(str(x if x is not None else 0) for x in row)


def _path(folder: str) -> str:
    return f"{folder.rstrip('/')}/_manifest"  # readers of the table skip it


def write_manifest(spark: SparkSession, folder: str, content: dict[str, str]) -> None:
    row = spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string")
    row.write.mode("overwrite").text(_path(folder))


def read_manifest(spark: SparkSession, folder: str) -> dict[str, str]:
    """What was written; empty if nothing was."""
    if not table_complete(spark, _path(folder)):
        return {}
    return json.loads(spark.read.text(_path(folder)).first()[0])
