"""Topic models as text: a term id and its probability in each topic per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.model import phi_rows

SUM_TOLERANCE = 1e-6


def export_model(probs: DataFrame, path: str) -> None:
    """Write ``term_id p_0 ... p_{K-1}`` lines in term order."""
    row = F.concat_ws(" ", F.col("term_id").cast("string"), F.col("phi").cast("array<string>"))
    ordered = phi_rows(probs).orderBy("term_id").select(row.alias("value"))
    ordered.write.mode("overwrite").text(path)


def import_model(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """``(term_id, phi)``; ``check`` verifies that every topic sums to 1."""
    fields = F.split(F.trim("value"), " +")
    model = spark.read.text(path).where(F.trim("value") != "").select(
        F.element_at(fields, 1).cast("int").alias("term_id"),
        F.slice(fields, F.lit(2), F.size(fields) - 1).cast("array<double>").alias("phi"),
    )
    if check:
        wrong = topic_sums(model).where(F.abs(F.col("total") - 1) > SUM_TOLERANCE).count()
        if wrong:
            raise ValueError(f"{wrong} topics of the model at {path} do not sum to 1")
    return model


def model_probs(model: DataFrame) -> DataFrame:
    """``(term_id, topic, prob)`` from ``(term_id, phi)``."""
    return model.select("term_id", F.posexplode("phi").alias("topic", "prob"))


def topic_sums(model: DataFrame) -> DataFrame:
    """``(topic, total)`` of the probabilities."""
    return model_probs(model).groupBy("topic").agg(F.sum("prob").alias("total"))
