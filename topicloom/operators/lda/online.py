"""Online variational Bayes for LDA (Hoffman et al. 2010) with lambda as a table.

``lambdas`` has one row a term.  An iteration draws documents by a hash, lets each part of
them meet the rows of lambda of its terms, and fits the documents' gamma there; what the
parts return per term is summed and blended into lambda by one join on the term.  Nothing of
terms x topics reaches the driver, only the K column sums.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.lda.meeting import meet, part_count, term_uses
from topicloom.operators.lda.mllib import minibatch_fraction
from topicloom.operators.sampling import hash32
from topicloom.operators.vectorize import token_total
from topicloom.session import scratch_path, ship_package
from topicloom.sources import checkpoints


#: Cells of (document, term) pairs x topics that are fitted together.
CHUNK_CELLS = 200_000


@dataclass
class OnlineModel:
    """``lambdas`` (term_id, lambdas) of all terms."""

    lambdas: DataFrame
    k: int
    vocab_size: int
    iterations: int
    train_ms: int


def digamma(x: np.ndarray) -> np.ndarray:
    """By its asymptotic series six steps ahead; good to 1e-9 for positive x."""
    y = x + 6
    series = 1 / 12 - (1 / 120 - (1 / 252 - 1 / (240 * y * y)) / (y * y)) / (y * y)
    behind = sum(1 / (x + i) for i in range(6))
    return np.log(y) - 1 / (2 * y) - series / (y * y) - behind


def fit_document(tfs: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, enough: float):
    """(share of each topic, norm of each term) of a document under ``beta`` = exp E[log beta]
    (terms x topics): at most ``rounds`` steps from equal gammas."""
    gamma = np.ones(beta.shape[1])
    share = np.exp(digamma(gamma) - digamma(gamma.sum()))
    norm = beta @ share
    for _ in range(rounds):
        before = gamma
        gamma = alpha + share * ((tfs / norm) @ beta)
        share = np.exp(digamma(gamma) - digamma(gamma.sum()))
        norm = beta @ share
        if np.abs(gamma - before).mean() < enough:
            break
    return share, norm


def fit_documents(tfs: np.ndarray, offsets: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, enough: float):
    """``fit_document`` of many, side by side: shares of the documents, norms of their terms.

    ``tfs`` and rows of ``beta`` of document i lie from ``offsets[i]`` to ``offsets[i + 1]``; none
    is empty.  A document that has settled rests, as alone.
    """
    k, size = beta.shape[1], np.diff(offsets)
    gamma = np.ones((len(size), k))
    share = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
    norm = (beta * np.repeat(share, size, axis=0)).sum(axis=1)
    moving, rows = np.arange(len(size)), slice(None)
    for _ in range(rounds):
        starts = np.cumsum(size[moving]) - size[moving]
        before, b = gamma[moving], beta[rows]
        mass = np.add.reduceat((tfs[rows] / norm[rows])[:, None] * b, starts, axis=0)
        now = alpha + share[moving] * mass
        own = np.exp(digamma(now) - digamma(now.sum(axis=1, keepdims=True)))
        gamma[moving], share[moving] = now, own
        norm[rows] = (b * np.repeat(own, size[moving], axis=0)).sum(axis=1)
        still = np.abs(now - before).mean(axis=1) >= enough
        if not still.all():
            moving = moving[still]
            rows = np.flatnonzero(np.repeat(np.isin(np.arange(len(size)), moving), size))
            if not len(moving):
                break
    return share, norm


def start(spark, vocab_size: int, k: int, seed: int = 42) -> DataFrame:
    """Rows of lambda around 1 with a standard deviation of 0.1, from a hash."""
    terms = spark.range(vocab_size).select(F.col("id").cast("int").alias("term_id"))
    uniform = lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col("term_id"), t), F.lit(2**32)) / 2.0**32
    wide = 0.1 * 12**0.5
    return terms.select(
        "term_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: 1 + wide * (uniform(t) - 0.5)).alias("lambdas")
    )


def _sums(lambdas: DataFrame, k: int) -> np.ndarray:
    told = lambdas.select(F.posexplode("lambdas").alias("topic", "x")).groupBy("topic").agg(F.sum("x").alias("x"))
    sums = np.zeros(k)
    for row in told.collect():
        sums[row["topic"]] = row["x"]
    return sums


def expectations(
    docs: DataFrame, lambdas: DataFrame, sums: np.ndarray, uses: DataFrame, parts: int, k: int,
    alpha: float, rounds: int, enough: float,
) -> DataFrame:
    """(term_id, topic, n): expected counts of ``docs`` (doc_key, term_ids, tfs)."""
    behind = digamma(sums)

    def run(documents: pa.Table, used: pa.Table) -> pa.Table:
        known = used.column("term_id").to_numpy()
        order = np.argsort(known)
        rows = used.column("lambdas").combine_chunks().flatten().to_numpy().reshape(-1, k)[order]
        beta = np.exp(digamma(rows) - behind)
        lists, counts = (documents.column(c).combine_chunks() for c in ("term_ids", "tfs"))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        terms = np.searchsorted(known[order], lists.flatten().to_numpy())
        tfs, found = counts.flatten().to_numpy().astype(float), np.zeros_like(beta)
        edges, lo = np.unique(offsets), 0  # an empty document adds nothing
        while lo < len(edges) - 1:
            hi = int(np.searchsorted(edges, edges[lo] + CHUNK_CELLS // k, side="right")) - 1
            hi = min(max(hi, lo + 1), len(edges) - 1)
            part = slice(edges[lo], edges[hi])
            own, tf, rows_of = terms[part], tfs[part], beta[terms[part]]
            share, norm = fit_documents(tf, edges[lo : hi + 1] - edges[lo], rows_of, alpha, rounds, enough)
            mass = (tf / norm)[:, None] * np.repeat(share, np.diff(edges[lo : hi + 1]), axis=0) * rows_of
            np.add.at(found, own, mass)
            lo = hi
        return pa.table({
            "term_id": pa.array(known[order], pa.int32()), "sums": pa.array(list(found), pa.list_(pa.float64())),
        })

    told = meet(docs, "doc_key", uses, lambdas, parts, run, "term_id int, sums array<double>")
    told = told.select("term_id", F.posexplode("sums").alias("topic", "n"))
    return told.groupBy("term_id", "topic").agg(F.sum("n").alias("n"))


def blended(lambdas: DataFrame, expected: DataFrame, rate: float, scale: float, eta: float) -> DataFrame:
    """lambda moved by ``rate`` towards eta + scale x expected counts."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("topic", "n"))), lambda x: x["n"])
    seen = expected.groupBy("term_id").agg(listed.alias("seen"))

    def moved(old: Column, n: Column) -> Column:
        return (1 - rate) * old + rate * (eta + scale * F.coalesce(n, F.lit(0.0)))

    blend = F.transform("lambdas", lambda old, at: moved(old, F.get("seen", at)))
    return lambdas.join(seen, "term_id", "left").select("term_id", blend.alias("lambdas"))


def fit_online(
    vectors: DataFrame, vocab_size: int, k: int = 30, iterations: int = 100, alpha: float = 0.5,
    eta: float = 0.01, seed: int = 42, fraction: float | None = None, tau: float = 1024.0,
    kappa: float = 0.51, rounds: int = 100, enough: float = 1e-3, key: str = "doc_id",
    begin: DataFrame | None = None,
) -> OnlineModel:
    """Train on ``fraction`` of the documents an iteration, by default min(1, 2 / iterations +
    1 / documents); steps shrink as (tau + t) ** -kappa.  ``begin`` is a table of lambdas."""
    if k < 1 or iterations < 1 or alpha <= 0 or eta <= 0 or tau < 0 or kappa <= 0:
        raise ValueError("k, iterations, alpha, eta and kappa must be positive")
    began = time.time()
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = scratch_path(spark, "online")
    docs = vectors.select(F.xxhash64(F.col(key)).alias("doc_key"), "term_ids", "tfs")
    if fraction is None:
        fraction = minibatch_fraction(docs, iterations).first()[0]
    lambdas = checkpoints.write(start(spark, vocab_size, k, seed) if begin is None else begin, f"{scratch}/0")
    total = docs.count()
    tokens = docs.agg(F.sum(token_total(docs))).first()[0] or 0
    parts = part_count(int(tokens * fraction), docs)
    for done in range(iterations):
        batch = docs.where(hash32(F.lit(seed), F.lit(done), F.col("doc_key")) < round(fraction * 2**32))
        size = batch.count()
        if size:
            uses = term_uses(batch, "doc_key", "term_ids", parts)
            expected = expectations(batch, lambdas, _sums(lambdas, k), uses, parts, k, alpha, rounds, enough)
            rate = (tau + done + 1) ** -kappa
            moved = blended(lambdas, expected, rate, total / size, eta)
            lambdas = checkpoints.write(moved, f"{scratch}/{done + 1}")
    return OnlineModel(lambdas, k, vocab_size, iterations, int((time.time() - began) * 1000))


def topic_probs(model: OnlineModel) -> DataFrame:
    """``(term_id, topic, prob)``; each topic sums to 1."""
    sums = F.array(*[F.lit(float(x)) for x in _sums(model.lambdas, model.k)])
    return model.lambdas.select("term_id", F.posexplode("lambdas").alias("topic", "x")).select(
        "term_id", "topic", (F.col("x") / F.get(sums, F.col("topic"))).alias("prob")
    )
