"""Documents as term counts.

``vectors`` is one row per document, ``(doc_id, term_ids, tfs)``, term ids
ascending.  Building it costs the only shuffle of the corpus, in which every
document is already one row per task; all that follows (long form, ML vectors,
training state) is narrow.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.arrays import run_lengths
from topicloom.operators.tokens import preprocess_tokens
from topicloom.operators.vocabulary import token_index
from topicloom.session import broadcast_if_small


def attach_terms(cleaned: DataFrame, stemmed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(*keys, term_id)`` for every cleaned token whose stem is in the dictionary.

    The token index is broadcast when its counted size allows.  Beyond that, the
    tokens are stemmed through the bounded memo and meet the dictionary instead.
    """
    keys = [c for c in cleaned.columns if c != "token"]
    index, small = broadcast_if_small(token_index(stemmed, dictionary))
    if small:
        return cleaned.join(index, "token").select(*keys, "term_id")
    index.unpersist()
    terms, _ = broadcast_if_small(dictionary.select(F.col("term").alias("stem"), "term_id"))
    return preprocess_tokens(cleaned, stemmed).join(terms, "stem").select(*keys, "term_id")


def doc_term_freq(attached: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form ``(key, term_id, tf)``; counts are combined before the shuffle."""
    return attached.groupBy(key, "term_id").agg(F.count("*").cast("int").alias("tf"))


def doc_vectors(attached: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, term_ids, tfs)``, one row per document that has any known term."""
    words = attached.groupBy(key).agg(F.collect_list("term_id").alias("_words"))
    runs = run_lengths(F.sort_array("_words"), "term_ids", "tfs")
    return words.select(key, runs.alias("_runs")).select(key, "_runs.term_ids", "_runs.tfs")


def long_form(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, term_id, tf)`` from vectors; narrow."""
    return vectors.select(key, F.inline(F.arrays_zip("term_ids", "tfs"))).select(
        key, F.col("term_ids").alias("term_id"), F.col("tfs").alias("tf")
    )


def limit_terms(vectors: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """Vectors of the terms below ``width`` only, without documents that have none; narrow."""
    pairs = F.filter(F.arrays_zip("term_ids", "tfs"), lambda x: x["term_ids"] < width)
    kept = vectors.select(key, pairs.alias("_kept")).where(F.size("_kept") > 0)
    return kept.select(key, "_kept.term_ids", "_kept.tfs")


def nonempty_docs(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_terms)`` of the documents with at least one known term."""
    return vectors.select(key, F.size("term_ids").alias("n_terms")).where(F.col("n_terms") > 0)


def corpus_size(documents: DataFrame) -> DataFrame:
    """One row ``(docs)``."""
    return documents.agg(F.count("*").alias("docs"))


def token_total(vectors: DataFrame):
    """Column summing the term counts of a vector row."""
    return F.aggregate("tfs", F.lit(0).cast("long"), lambda total, tf: total + tf)


def token_totals(vectors: DataFrame, by: str = "split") -> DataFrame:
    """``(by, tokens)``: term occurrences per value of ``by``."""
    return vectors.groupBy(by).agg(F.sum(token_total(vectors)).alias("tokens"))


def ml_vectors(vectors: DataFrame, width: int, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, features)`` with Spark ML sparse vectors, by way of a table at ``path``.

    A sparse vector is stored as a plain struct, so the rows are written as that
    struct and read back under the vector type.  No row passes through Python.
    """
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(width).cast("int").alias("size"),
        F.col("term_ids").alias("indices"),
        F.transform("tfs", lambda tf: tf.cast("double")).alias("values"),
    )
    vectors.select(key, struct.alias("features")).write.mode("overwrite").parquet(path)
    schema = T.StructType([vectors.schema[key], T.StructField("features", VectorUDT())])
    return vectors.sparkSession.read.schema(schema).parquet(path)
