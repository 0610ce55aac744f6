"""LDA by expectation maximisation over (document, term) counts, with tables of any size.

The model is a table ``(term_id, topic, n)`` of expected counts, a document carries its own
K.  In an iteration each part of the documents meets the rows of the terms that it uses; a
(document, term) pair is shared out among the topics in proportion to
(n_wk + eta - 1) (n_dk + alpha - 1) / (n_k + V (eta - 1)), the posterior mode of Asuncion et
al. (2009).  The tasks return the documents' new counts and, per term, sums over the part,
which one aggregation by (term, topic) makes the next model.  Nothing of the size of the
model reaches the driver but the K totals.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.lda.meeting import meet, part_count, term_uses
from topicloom.operators.lda.state import initial_state, topic_counts, word_topic_counts
from topicloom.operators.vectorize import token_total
from topicloom.session import scratch_path, ship_package
from topicloom.sources import checkpoints

#: (document, term) pairs x topics that are shared out together.
CHUNK_CELLS = 400_000
_DOC = "doc_id, doc_key, term_ids, tfs"


@dataclass
class EmModel:
    """``word_topic`` (term_id, topic, n) and ``docs`` (doc_id, doc_key, term_ids, tfs, shares):
    expected counts; ``likelihood`` of the training tokens under the model before the last step."""

    word_topic: DataFrame
    docs: DataFrame
    k: int
    vocab_size: int
    alpha: float
    eta: float
    tokens: int
    likelihood: float
    train_ms: int


def start(vectors: DataFrame, k: int, seed: int = 42, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(docs, word_topic) from topics drawn by a hash of (seed, document, position); documents
    stay where they are."""
    state = initial_state(vectors, k, seed, key, ("term_ids", "tfs"))
    shares = F.transform(topic_counts(F.col("z"), k), lambda n: n.cast("double"))
    return state.select(*_DOC.split(", "), shares.alias("shares")), word_topic_counts(state)


def share_out(terms, tfs, offsets, shares, rows, weight, alpha: float):
    """New (shares of documents, sums of rows) and the log likelihood, by one E step.

    ``weight`` (rows x topics) holds (n_wk + eta - 1) / (n_k + V (eta - 1)); ``rows`` the row of
    each of the ``terms``.
    """
    k = weight.shape[1]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new, sums, total = np.zeros_like(shares), np.zeros_like(weight), 0.0
    prior = (shares + alpha - 1) / (shares.sum(axis=1, keepdims=True) + k * (alpha - 1))
    step = max(1, CHUNK_CELLS // k)
    for lo in range(0, len(terms), step):
        part = slice(lo, lo + step)
        mass = weight[rows[part]] * prior[docs[part]]
        mix = mass.sum(axis=1)
        total += float(tfs[part] @ np.log(mix))
        mass *= (tfs[part] / mix)[:, None]
        np.add.at(new, docs[part], mass)
        np.add.at(sums, rows[part], mass)
    return new, sums, total


def step(
    docs: DataFrame, word_topic: DataFrame, totals: np.ndarray, uses: DataFrame, parts: int,
    k: int, vocab_size: int, alpha: float, eta: float,
) -> DataFrame:
    """Rows of one iteration: documents with new ``shares``, and (term_id, sums) of each part
    without a document; ``ll`` is the part's log likelihood, in one of its rows."""
    pairs = F.collect_list(F.struct("topic", F.col("n").cast("double").alias("n")))
    rows = word_topic.groupBy("term_id").agg(pairs.alias("pairs"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in _DOC.split(", "))
    schema += ", shares array<double>, term_id int, sums array<double>, ll double"
    smooth = totals + vocab_size * (eta - 1)

    def run(documents: pa.Table, used: pa.Table) -> pa.Table:
        documents = documents.combine_chunks()
        lists, counts, old = (documents.column(c).combine_chunks() for c in ("term_ids", "tfs", "shares"))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        terms, tfs = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(float)
        known = used.column("term_id").to_numpy()
        order = np.argsort(known)
        pairs = used.column("pairs").combine_chunks()
        topic, n = (pairs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("topic", "n"))
        weight = np.zeros((len(known), k))
        weight[np.repeat(np.arange(len(known)), np.diff(pairs.offsets.to_numpy())), topic] = n
        weight = (weight + eta - 1) / smooth
        place = order[np.searchsorted(known[order], terms)]
        shares = old.flatten().to_numpy().reshape(-1, k)
        new, sums, total = share_out(terms, tfs, offsets, shares, place, weight, alpha)
        filled = len(documents)
        made = {name: pa.concat_arrays([documents.column(name).combine_chunks(), pa.nulls(len(known), documents.schema.field(name).type)]) for name in _DOC.split(", ")}

        def listed(matrix):
            return pa.array(list(matrix), pa.list_(pa.float64()))

        made["shares"] = pa.concat_arrays([listed(new), pa.nulls(len(known), pa.list_(pa.float64()))])
        made["term_id"] = pa.concat_arrays([pa.nulls(filled, pa.int32()), pa.array(known, pa.int32())])
        made["sums"] = pa.concat_arrays([pa.nulls(filled, pa.list_(pa.float64())), listed(sums)])
        made["ll"] = pa.array([total] + [0.0] * (filled + len(known) - 1), pa.float64())
        return pa.table(made)

    return meet(docs, "doc_key", uses, rows, parts, run, schema)


def model_of(rows: DataFrame) -> DataFrame:
    """(term_id, topic, n): the sums over all parts."""
    told = rows.where("term_id IS NOT NULL").select("term_id", F.posexplode("sums").alias("topic", "n"))
    return told.groupBy("term_id", "topic").agg(F.sum("n").alias("n"))


def _totals(word_topic: DataFrame, k: int) -> np.ndarray:
    totals = np.zeros(k)
    for row in word_topic.groupBy("topic").agg(F.sum("n").alias("n")).collect():
        totals[row["topic"]] = row["n"]
    return totals


def fit_em(
    vectors: DataFrame, vocab_size: int, k: int = 30, iterations: int = 100, alpha: float = 1.5,
    eta: float = 1.01, seed: int = 42, key: str = "doc_id", begin: tuple[DataFrame, DataFrame] | None = None,
) -> EmModel:
    """Train by expectation maximisation; ``alpha`` and ``eta`` must exceed 1.

    ``begin`` is a pair (docs, word_topic) as ``start`` makes it, the default.
    """
    if k < 1 or iterations < 1 or alpha <= 1 or eta <= 1:
        raise ValueError("k and iterations must be positive, alpha and eta above 1")
    began = time.time()
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = scratch_path(spark, "em")
    docs, word_topic = begin or start(vectors, k, seed, key)
    docs = checkpoints.write(docs, f"{scratch}/docs")
    word_topic = checkpoints.write(word_topic, f"{scratch}/model")
    tokens = docs.agg(F.sum(token_total(docs))).first()[0] or 0
    parts = part_count(tokens, docs)
    uses = checkpoints.write(term_uses(docs, "doc_key", "term_ids", parts), f"{scratch}/uses")
    for done in range(iterations):
        totals = _totals(word_topic, k)
        rows = step(docs, word_topic, totals, uses, parts, k, vocab_size, alpha, eta)
        rows = checkpoints.write(rows, f"{scratch}/step-{done}")
        docs = rows.where("term_id IS NULL").select(*_DOC.split(", "), "shares")
        word_topic = checkpoints.write(model_of(rows), f"{scratch}/model-{done}")
        if done:
            for name in (f"step-{done - 1}", f"model-{done - 1}"):
                checkpoints.drop(spark, f"{scratch}/{name}")
    total = rows.agg(F.sum("ll")).first()[0] or 0.0
    return EmModel(
        word_topic, docs, k, vocab_size, alpha, eta, int(tokens), float(total),
        int((time.time() - began) * 1000),
    )
