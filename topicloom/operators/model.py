"""What is read off a topic model: probabilities, descriptions, perplexity."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.lda import heldout
from topicloom.operators.lda.heldout import PHI_BROADCAST_BYTES, phi_rows  # noqa: F401
from topicloom.operators.lda.kernel import uniforms
from topicloom.operators.lda.state import topic_counts
from topicloom.operators.topk import top_k


def _topics(k: int):
    return F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("topic")


def topic_word_probs(
    word_topic: DataFrame, totals: DataFrame, terms: DataFrame, k: int, vocab_size: int, beta: float
) -> DataFrame:
    """``(term_id, topic, prob)`` over the full grid; each topic sums to 1.

    ``terms`` lists the ``vocab_size`` term ids.
    """
    grid = terms.select("term_id", _topics(k))
    # One row per topic; a topic without tokens is absent.
    sums = F.broadcast(totals.where(F.col("topic") < k).select("topic", F.col("n").alias("_total")))
    prob = (F.coalesce("n", F.lit(0)) + beta) / (F.coalesce("_total", F.lit(0)) + vocab_size * beta)
    return (
        grid.join(word_topic, ["term_id", "topic"], "left")
        .join(sums, "topic", "left")
        .select("term_id", "topic", prob.alias("prob"))
    )


def _shares(k: int, alpha: float):
    """Smoothed topic shares from the topics ``z`` of a document."""
    counts = topic_counts(F.col("z"), k)
    return F.transform(counts, lambda n: (n + alpha) / (F.size("z") + k * alpha))


def theta(state: DataFrame, k: int, alpha: float) -> DataFrame:
    """``(doc_id, theta)``: smoothed topic shares of each document, as an array; narrow."""
    return state.select("doc_id", _shares(k, alpha).alias("theta"))


def doc_topics(state: DataFrame, k: int, alpha: float) -> DataFrame:
    """``(doc_id, topic, prob)``; each document sums to 1."""
    return state.select("doc_id", F.posexplode(_shares(k, alpha)).alias("topic", "prob"))


def describe_topics(probs: DataFrame, dictionary: DataFrame, k: int = 50) -> DataFrame:
    """``(topic, rank, term_id, term, prob)``: the ``k`` most probable terms per topic."""
    best = top_k(probs, ["topic"], [F.desc("prob"), F.asc("term_id")], k)
    return best.join(dictionary.select("term_id", "term"), "term_id", "left").select(
        "topic", "rank", "term_id", "term", "prob"
    )


def _mixture(theta_, phi):
    return F.aggregate(F.zip_with(theta_, phi, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def log_likelihood(vectors: DataFrame, thetas: DataFrame, phis: DataFrame, key: str = "doc_id"):
    """One row ``(tokens, log_likelihood)`` of the documents under theta and phi.

    The topic shares join the documents before these are taken apart by term.
    """
    docs = vectors.join(thetas.withColumnRenamed("doc_id", key), key)
    entries = docs.select("theta", F.inline(F.arrays_zip("term_ids", "tfs"))).select(
        "theta", F.col("term_ids").alias("term_id"), F.col("tfs").alias("tf")
    )
    scored = entries.join(phis, "term_id").select(
        "tf", (F.col("tf") * F.ln(_mixture("theta", "phi"))).alias("ll")
    )
    return scored.agg(F.sum("tf").alias("tokens"), F.sum("ll").alias("log_likelihood"))


def perplexity(likelihood: DataFrame) -> DataFrame:
    """One row ``(perplexity)`` from ``(tokens, log_likelihood)``."""
    value = F.exp(-F.col("log_likelihood") / F.col("tokens"))
    return likelihood.select(value.alias("perplexity"))


def heldout_likelihood(
    vectors: DataFrame, probs: DataFrame, k: int, vocab_size: int, alpha: float,
    rounds: int = 50, key: str = "doc_id", budget: int = PHI_BROADCAST_BYTES,
) -> DataFrame:
    """One row ``(tokens, log_likelihood)``: fold documents into a fixed model, then score them.

    Folding in starts from equal shares and takes ``rounds`` fixed-point steps.  It
    scores the tokens it has folded in, so it compares models rather than predicts.
    """
    options = {"alpha": alpha, "rounds": rounds}
    return heldout.likelihood(vectors, probs, k, vocab_size, "fold_in", options, key, budget)


def left_to_right_likelihood(
    vectors: DataFrame, probs: DataFrame, k: int, vocab_size: int, alpha: float,
    particles: int = 10, moves: int = 1, seed: int = 42, key: str = "doc_id",
    budget: int = PHI_BROADCAST_BYTES, uniform: Callable = uniforms, doc_key=None,
) -> DataFrame:
    """One row ``(tokens, log_likelihood)``: each token predicted from those before it only.

    ``moves`` earlier tokens are redrawn before each token by each of the ``particles``.
    Uniforms are keyed by document, so the result depends on no partitioning.
    """
    if particles < 1 or moves < 0:
        raise ValueError("particles must be positive and moves not negative")
    options = {"alpha": alpha, "particles": particles, "moves": moves, "seed": seed, "uniform": uniform}
    return heldout.likelihood(
        vectors, probs, k, vocab_size, "left_to_right", options, key, budget, doc_key
    )


def heldout_perplexity(*args, **kwargs) -> float:
    """exp(-log likelihood per token) of ``heldout_likelihood``; NaN without tokens."""
    row = heldout_likelihood(*args, **kwargs).first()
    return math.exp(-row["log_likelihood"] / row["tokens"]) if row["tokens"] else math.nan
