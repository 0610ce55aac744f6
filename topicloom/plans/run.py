"""The whole job: corpus, sampling, split, training, evaluation, export."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.lda.em import fit_em
from topicloom.operators.lda.mllib import PRIOR_OFFSET, fit_ml, model_from_ml, train_perplexity
from topicloom.operators.lda.online import fit_online, topic_probs
from topicloom.operators.lda.sampler import fit_sampler
from topicloom.operators.model import describe_topics, heldout_perplexity, topic_word_probs
from topicloom.operators.partitioning import repartition_documents
from topicloom.operators.sampling import subsample, train_test_split
from topicloom.operators.vectorize import token_total
from topicloom.plans.corpus import load_corpus, vocabulary_width, warc_documents
from topicloom.session import keep, ship_package
from topicloom.sources.model_file import export_model

# Algorithm names and the number of fold-in rounds in evaluation.
SAMPLERS = {"mh": 50, "naive": 50}
ML_TRAINERS = {"sparkem": 20, "sparkonline": 20}
#: The same two kinds of trainers with the model as a table, for any number of terms and topics.
TABLE_TRAINERS = {"em": 20, "online": 20}
TOP_TERMS = 50


@dataclass(frozen=True)
class RunConfig:
    """Options of a run; checked on construction."""

    dataset: str = ""
    algorithm: str = "mh"
    dictionary_path: str = ""
    vectors_path: str = ""
    final_path: str = ""
    iterations: int = 100
    mh_steps: int = 2
    partitions: int = 336
    force_repartition: bool = False
    seed: int = 42
    subsample: float = 1.0
    test_fraction: float = 0.0
    k: int = 30
    vocab_size: int = 60_000
    alpha: float = 0.5
    beta: float = 0.01
    block_size: int | None = None
    checkpoint_save: str = ""
    checkpoint_read: str = ""
    checkpoint_every: int = 1

    def __post_init__(self):
        if self.algorithm not in SAMPLERS | ML_TRAINERS | TABLE_TRAINERS:
            raise ValueError("algorithm must be sparkonline, sparkem, online, em, mh or naive")
        for name in ("iterations", "mh_steps", "partitions", "k", "vocab_size", "checkpoint_every"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("alpha", "beta"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be larger than 0")
        for name in ("subsample", "test_fraction"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")


@dataclass
class RunSummary:
    documents: int
    vocab_size: int
    train_tokens: int
    train_ms: int
    topics: DataFrame
    probs: DataFrame
    dictionary: DataFrame
    metrics: dict[str, float] = field(default_factory=dict)
    errors: int = 0  # records and pages that could not be read


def _sum_tokens(vectors: DataFrame) -> int:
    return vectors.agg(F.sum(token_total(vectors))).first()[0] or 0


def run(
    spark: SparkSession, config: RunConfig, documents: DataFrame | None = None
) -> RunSummary:
    """Run on the WARC files at ``config.dataset``, or on given ``(doc_id, text)`` documents."""
    ship_package(spark)
    c = config
    errors = 0

    def given() -> DataFrame:
        nonlocal errors
        if documents is not None:
            return documents
        read, failed = warc_documents(spark, c.dataset, c.partitions)
        errors = failed.count()
        return read

    corpus = load_corpus(spark, given, c.vocab_size, c.dictionary_path, c.vectors_path)
    vectors = keep(subsample(corpus.vectors, c.subsample, c.seed))
    n_docs = vectors.count()
    train, test = train_test_split(vectors, c.test_fraction, c.seed)
    if c.force_repartition:
        train = repartition_documents(train, c.partitions)
        test = repartition_documents(test, c.partitions)
    width = vocabulary_width(corpus.dictionary)
    metrics: dict[str, float] = {}
    # The ML trainers always work on the wanted number of partitions.
    partitions = c.partitions if c.force_repartition or c.algorithm in ML_TRAINERS else None
    if c.algorithm in SAMPLERS:
        model = fit_sampler(
            train, width, c.algorithm, c.k, c.iterations, c.alpha, c.beta, c.seed, c.mh_steps,
            partitions, c.block_size, c.checkpoint_save, c.checkpoint_read, c.checkpoint_every,
        )
        terms = corpus.dictionary.select("term_id")
        probs = topic_word_probs(model.word_topic, model.totals, terms, c.k, width, c.beta)
    elif c.algorithm == "online":
        model = fit_online(train, width, c.k, c.iterations, c.alpha, c.beta, c.seed)
        probs = topic_probs(model)
    elif c.algorithm == "em":
        model = fit_em(
            train, width, c.k, c.iterations, c.alpha + PRIOR_OFFSET, c.beta + PRIOR_OFFSET, c.seed
        )
        totals = model.word_topic.groupBy("topic").agg(F.sum("n").alias("n"))
        terms = corpus.dictionary.select("term_id")
        probs = topic_word_probs(model.word_topic, totals, terms, c.k, width, c.beta)
        if model.tokens:
            metrics["train_perplexity"] = math.exp(-model.likelihood / model.tokens)
    else:
        model = fit_ml(
            train, width, c.algorithm, c.k, c.iterations, c.alpha, c.beta, c.seed, partitions
        )
        probs = model_from_ml(model)
        if c.algorithm == "sparkem":
            metrics.update(train_perplexity(model))
    probs = keep(probs)
    if c.test_fraction > 0:
        rounds = (SAMPLERS | ML_TRAINERS | TABLE_TRAINERS)[c.algorithm]
        metrics["test_tokens"] = _sum_tokens(test)
        metrics["test_perplexity"] = heldout_perplexity(test, probs, c.k, width, c.alpha, rounds)
    if c.final_path:
        export_model(probs, c.final_path)
    topics = describe_topics(probs, corpus.dictionary, TOP_TERMS)
    tokens = _sum_tokens(train)
    vectors.unpersist()
    return RunSummary(
        n_docs, width, tokens, model.train_ms, topics, probs, corpus.dictionary, metrics, errors
    )
