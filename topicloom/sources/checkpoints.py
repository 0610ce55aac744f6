"""Trainer checkpoints: one parquet table of the training state per saved sweep."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from topicloom.session import path_exists, table_complete


def sweep_path(folder: str, sweep: int) -> str:
    return f"{folder.rstrip('/')}/iter={sweep:06d}"


def write(state: DataFrame, path: str) -> DataFrame:
    """Write a state; the returned table has no lineage beyond its files."""
    state.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a superseded state of the trainer's own scratch folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_settings(spark: SparkSession, folder: str, settings: dict) -> None:
    """Keep the trainer's settings beside its states."""
    row = spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string")
    row.write.mode("overwrite").text(f"{folder.rstrip('/')}/settings")


def read_latest(
    spark: SparkSession, folder: str, settings: dict | None = None
) -> tuple[int, DataFrame | None]:
    """The number of sweeps done and the state after them; (0, None) if there is none.

    States written with other ``settings`` are refused.
    """
    if not path_exists(spark, folder):
        return 0, None
    if settings is not None and table_complete(spark, f"{folder.rstrip('/')}/settings"):
        found = json.loads(spark.read.text(f"{folder.rstrip('/')}/settings").first()[0])
        other = {k for k in settings if found.get(k) != settings[k]}
        if other:
            raise ValueError(f"the checkpoint has other settings: {', '.join(sorted(other))}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in file_system.listStatus(hadoop_path)]
    sweeps = sorted((int(n[5:]) for n in names if n.startswith("iter=")), reverse=True)
    for sweep in sweeps:
        path = sweep_path(folder, sweep)
        if table_complete(spark, path):
            return sweep, spark.read.parquet(path)
    return 0, None
