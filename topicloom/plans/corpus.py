"""From a raw corpus to the dictionary and document vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.pages import page_text, responses_and_damage
from topicloom.operators.tokens import clean_tokens, stem_vocabulary, tokenize
from topicloom.operators.vectorize import attach_terms, doc_vectors, limit_terms
from topicloom.operators.vocabulary import term_counts, vocabulary
from topicloom.session import keep, scratch_path, spread, table_complete
from topicloom.sources.dictionary import dictionary_complete, read_dictionary
from topicloom.sources.manifest import digest, read_manifest, write_manifest
from topicloom.sources.reuse import load_or_build, load_or_fit_dictionary
from topicloom.sources.warc import read_warc


@dataclass
class Corpus:
    dictionary: DataFrame
    vectors: DataFrame


def warc_documents(
    spark: SparkSession, path: str, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` of the response records below ``path``, and ``(doc_id, error)`` of
    what could not be read: damaged records, and pages without a text.

    The text is written once to the shared folder: the dictionary and the vectors
    each read it, and parsing the pages again would cost more than storing them.
    """
    records = responses_and_damage(read_warc(spark, path, "response", partitions))
    named = records.withColumnsRenamed({"page_id": "doc_id", "error": "damage"})
    text = page_text(named, ["doc_id", "damage"])
    stored = scratch_path(spark, "text")
    text.write.parquet(stored)
    text = spark.read.parquet(stored)
    errors = text.select("doc_id", F.coalesce("damage", "error").alias("error"))
    return text.where("damage is null").select("doc_id", "text"), errors.where("error is not null")


def build_corpus(
    documents: DataFrame, vocab_size: int = 60_000, dictionary: DataFrame | None = None
) -> Corpus:
    """Dictionary and vectors of ``(doc_id, text)`` documents."""
    cleaned = clean_tokens(tokenize(spread(documents, "doc_id")))
    stemmed = keep(stem_vocabulary(cleaned))
    if dictionary is None:
        dictionary = keep(vocabulary(term_counts(stemmed), vocab_size))
    return Corpus(dictionary, doc_vectors(attach_terms(cleaned, stemmed, dictionary)))


def load_corpus(
    spark: SparkSession,
    documents,
    vocab_size: int = 60_000,
    dictionary_path: str = "",
    vectors_path: str = "",
) -> Corpus:
    """Read dictionary and vectors if both exist; otherwise build what is missing.

    ``documents`` is a function, called only if the corpus has to be read.  Saved vectors know
    the content of their dictionary, and are refused with another one.
    """
    if table_complete(spark, vectors_path) and dictionary_complete(spark, dictionary_path):
        made_with = read_manifest(spark, vectors_path).get("dictionary")
        if made_with and made_with != _terms(read_dictionary(spark, dictionary_path)):
            raise ValueError(f"the vectors at {vectors_path} were made with another dictionary")
        # Both may have been saved with more terms than are asked for.
        return Corpus(
            read_dictionary(spark, dictionary_path, vocab_size),
            limit_terms(spark.read.parquet(vectors_path), vocab_size),
        )
    cleaned = clean_tokens(tokenize(spread(documents(), "doc_id")))
    stemmed = keep(stem_vocabulary(cleaned))
    dictionary = keep(
        load_or_fit_dictionary(
            spark,
            dictionary_path,
            lambda: vocabulary(term_counts(stemmed), vocab_size),
            vocab_size,
        )
    )

    def vectors() -> DataFrame:
        return doc_vectors(attach_terms(cleaned, stemmed, dictionary))

    if vectors_path and table_complete(spark, vectors_path):
        # Vectors without their dictionary are stale: term ids may have changed.
        vectors().write.mode("overwrite").parquet(vectors_path)
    loaded = load_or_build(spark, vectors_path, vectors)
    if vectors_path and dictionary_path:
        write_manifest(spark, vectors_path, {"dictionary": _terms(read_dictionary(spark, dictionary_path))})
    return Corpus(dictionary, loaded)


def _terms(dictionary: DataFrame) -> str:
    return digest(dictionary, ["term", "term_id"])


def vocabulary_width(dictionary: DataFrame) -> int:
    """Actual number of terms; never the requested size."""
    return dictionary.agg(F.count("*")).first()[0]
