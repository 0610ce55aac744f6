"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.lda.state import base_state
from topicloom.operators.tokens import clean_tokens, stem_vocabulary, tokenize
from topicloom.operators.vectorize import attach_terms, doc_vectors
from topicloom.operators.vocabulary import term_counts, vocabulary
from topicloom.session import keep, spread

VOCAB_SIZE = 2000
K = 5
ALPHA, BETA = 0.5, 0.01

RECORD_END = "\r\n\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_tokens(tokenize(documents(spark, sf_dir)))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(term_counts(stem_vocabulary(cleaned(spark, sf_dir))), VOCAB_SIZE)


@cache
def _prepared(application: str, spark: SparkSession, sf_dir: str):
    """Cleaned tokens with persisted stems and dictionary, shared by the later stages."""
    tokens = cleaned(spark, sf_dir)
    stemmed = keep(stem_vocabulary(tokens))
    known = keep(vocabulary(term_counts(stemmed), VOCAB_SIZE))
    vectors = keep(doc_vectors(attach_terms(tokens, stemmed, known)))
    return tokens, stemmed, known, vectors, known.count()


def _of(spark: SparkSession, sf_dir: str):
    return _prepared(spark.sparkContext.applicationId, spark, sf_dir)


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir)[1]


def known_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The dictionary and its size."""
    return _of(spark, sf_dir)[2], _of(spark, sf_dir)[4]


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_terms(*_of(spark, sf_dir)[:3])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir)[3]


def assigned(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """State with topic (doc_id + term_id + occurrence) mod K, computable in SQL, and ``more``
    columns of the vectors."""
    known = vectors(spark, sf_dir)
    topics = F.transform(
        F.arrays_zip("term_ids", "tfs"),
        lambda x: F.transform(
            F.sequence(F.lit(0), x["tfs"] - 1),
            lambda nth: F.pmod(F.col("doc_id") + x["term_ids"] + nth, F.lit(K)).cast("smallint"),
        ),
    )
    return base_state(known, ["doc_id", F.flatten(topics).alias("z"), *more])


def _record(headers: list[tuple[str, object]], payload):
    """One WARC record as a string column, without its closing blank lines."""
    lines = [F.lit("WARC/1.0\r\n")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    size = F.octet_length(payload).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit("\r\n\r\n"), payload)


def write_pages_as_warc(pages: DataFrame, path: str, with_ids: bool = True) -> None:
    """Per page a response (with or without id), a request and a record without type, in
    gzipped files.

    A text sink whose line end is the end of a record writes the format as it is,
    in parallel, to any file system.
    """
    page_id = F.col("page_id").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))
    known = [("WARC-TREC-ID", page_id)] if with_ids else []
    response = _record(
        [("WARC-Type", "response"), ("WARC-Target-URI", F.col("url")), *known], http
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", page_id)],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    untyped = _record([("WARC-Record-ID", page_id)], F.col("url"))
    records = pages.select(F.explode(F.array(response, request, untyped)).alias("value"))
    writer = records.write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.text(path)
