"""Likelihood of documents under a fixed model: folding in, and left to right.

A model within a byte limit is broadcast.  Beyond it each part of the documents meets the
rows of phi that it uses, once: all rounds of a document need no other rows.  Parts are made
smaller until the rows of each fit the limit, which is measured, not assumed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.lda.kernel import uniforms
from topicloom.operators.lda.meeting import meet, part_count, term_uses
from topicloom.operators.vectorize import token_total
from topicloom.session import cut_lineage, ship_package

PHI_BROADCAST_BYTES = 256 * 2**20
#: Bytes of the rows of phi that one part may use.
PHI_PART_BYTES = 256 * 2**20
#: Cells of documents x particles x topics that are worked on together.
CHUNK_CELLS = 2_000_000
#: Cells of (document, term) pairs x topics that are folded in together: as much as a cache holds.
FOLD_CELLS = 200_000


def fold_in(tfs: np.ndarray, phi: np.ndarray, alpha: float, rounds: int) -> tuple[float, np.ndarray]:
    """Log likelihood of a document and its topic shares after ``rounds`` fixed-point steps
    from equal shares; ``phi`` has a row for each of its terms."""
    k = phi.shape[1]
    share, n = np.full(k, 1.0 / k), tfs.sum()
    for _ in range(rounds):
        weight = phi * share
        weight *= (tfs / weight.sum(axis=1))[:, None]
        share = (alpha + weight.sum(axis=0)) / (k * alpha + n)
    return float(tfs @ np.log(phi @ share)), share


def left_to_right(
    rows: list[np.ndarray], keys: np.ndarray, phi: np.ndarray, alpha: float, particles: int,
    moves: int, seed: int, uniform: Callable = uniforms,
) -> np.ndarray:
    """Log likelihood of each document by sequential particles (Wallach et al. 2009, alg. 3).

    ``rows`` holds the row of ``phi`` of each token.  The probability of a token is the mean
    over particles of the prediction from the topics of the tokens before it, so no token
    is scored by what was fitted to it.  Before each token ``moves`` earlier ones, drawn at
    random, get a new topic given all others before the token; the estimate is exact as
    they grow, and a little too high with few.  Documents go side by side, longest first;
    uniforms are keyed by document, particle and token.
    """
    k = phi.shape[1]
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(-lengths, kind="stable")
    answer = np.zeros(len(rows))
    step = max(1, CHUNK_CELLS // (k * particles))
    for lo in range(0, len(order), step):
        docs = order[lo : lo + step]
        size, longest = lengths[docs], int(lengths[docs].max(initial=0))
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.concatenate([rows[d] for d in docs]) if longest else np.zeros(0, np.int64)
        z = np.zeros((int(size.sum()), particles), np.int32)
        counts = np.zeros((len(docs), particles, k))
        particle = np.arange(particles)

        def drawn(weights, active, n, purpose):
            """A topic for each document and particle, in proportion to ``weights``."""
            sums = np.cumsum(weights, axis=2)
            key = np.repeat(keys[docs[:active]], particles)
            pos = np.tile(particle, active) + particles * np.int64(n)
            u = uniform(seed, 0, purpose, key, pos).reshape(active, particles)
            return np.minimum((sums < (u * sums[:, :, -1])[:, :, None]).sum(axis=2), k - 1)

        for n in range(longest):
            active = int((size > n).sum())
            at = starts[:active] + n
            grid = (np.arange(active)[:, None], particle[None, :])
            for move in range(moves if n else 0):
                key = keys[docs[:active]]
                u = uniform(seed, 1, move, key, np.full(active, n))
                old = starts[:active] + np.minimum((u * n).astype(np.int64), n - 1)
                now = counts[:active]
                np.add.at(now, (*grid, z[old]), -1)
                z[old] = drawn(phi[flat[old]][:, None, :] * (now + alpha), active, n, 2 + move)
                np.add.at(now, (*grid, z[old]), 1)
            weights = phi[flat[at]][:, None, :] * (counts[:active] + alpha)
            seen = weights.sum(axis=2).mean(axis=1) / (n + k * alpha)
            answer[docs[:active]] += np.log(seen)
            z[at] = drawn(weights, active, n, 1)
            np.add.at(counts[:active], (*grid, z[at]), 1)
    return answer


def _lists(table, names):
    out = []
    for name in names:
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append(column)
    return out


def fold_in_all(term: np.ndarray, tfs: np.ndarray, offsets: np.ndarray, phi_of, alpha: float, rounds: int) -> float:
    """The sum of the log likelihoods of ``fold_in``, documents side by side.

    ``term`` and ``tfs`` of document i lie from ``offsets[i]`` to ``offsets[i + 1]``; empty ones
    have none.
    """
    edges, total, lo = np.unique(offsets), 0.0, 0
    while lo < len(edges) - 1:
        if not lo:
            k = phi_of(term[:1]).shape[1]
        hi = int(np.searchsorted(edges, edges[lo] + FOLD_CELLS // k, side="right")) - 1
        hi = min(max(hi, lo + 1), len(edges) - 1)
        own = slice(edges[lo], edges[hi])
        starts, size, tf = edges[lo:hi] - edges[lo], np.diff(edges[lo : hi + 1]), tfs[own]
        phi, n = phi_of(term[own]), np.add.reduceat(tf, starts)[:, None]
        share = np.full((hi - lo, k), 1.0 / k)
        for _ in range(rounds):
            weight = phi * np.repeat(share, size, axis=0)
            weight *= (tf / weight.sum(axis=1))[:, None]
            share = (alpha + np.add.reduceat(weight, starts, axis=0)) / (k * alpha + n)
        total += float(tf @ np.log((phi * np.repeat(share, size, axis=0)).sum(axis=1)))
        lo = hi
    return total


def _folded(table, phi_of, alpha: float, rounds: int, **_):
    terms, tfs = _lists(table, ("term_ids", "tfs"))
    offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
    term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(float)
    return float(tf.sum()), fold_in_all(term, tf, offsets, phi_of, alpha, rounds)


def _sequential(table, phi_of, alpha: float, particles: int, moves: int, seed: int, uniform, **_):
    terms, tfs = _lists(table, ("term_ids", "tfs"))
    keys = _lists(table, ("doc_key",))[0].to_numpy(zero_copy_only=False)
    offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
    term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
    used, row = np.unique(term, return_inverse=True)
    rows = [np.repeat(row[lo:hi], tf[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    scored = left_to_right(rows, keys, phi_of(used), alpha, particles, moves, seed, uniform)
    return float(tf.sum()), float(scored.sum())


_METHODS = {"fold_in": _folded, "left_to_right": _sequential}
_SCORED = "tokens double, log_likelihood double"


def phi_rows(probs: DataFrame) -> DataFrame:
    """``(term_id, phi)``: probabilities by topic as one array per term."""
    pairs = F.array_sort(F.collect_list(F.struct("topic", "prob")))
    return probs.groupBy("term_id").agg(F.transform(pairs, lambda x: x["prob"]).alias("phi"))


def _parts_that_fit(docs: DataFrame, k: int) -> tuple[int, DataFrame]:
    """A number of parts whose rows of phi fit ``PHI_PART_BYTES``, and what each uses."""
    sizes = docs.agg(F.sum(token_total(docs)).alias("tokens"), F.count("*").alias("docs")).first()
    parts = part_count(sizes["tokens"] or 0, docs)
    while True:
        uses = cut_lineage(term_uses(docs, "doc_key", "term_ids", parts))
        most = uses.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        if most * k * 8 <= PHI_PART_BYTES or parts >= sizes["docs"]:
            return parts, uses
        parts *= 2


def likelihood(
    vectors: DataFrame, probs: DataFrame, k: int, vocab_size: int, method: str, options: dict,
    key: str = "doc_id", budget: int = PHI_BROADCAST_BYTES, doc_key: Column | None = None,
) -> DataFrame:
    """One row ``(tokens, log_likelihood)`` of documents scored by a method of this module.

    ``doc_key`` keys their uniforms; by default it is a hash of ``key``.
    """
    score = _METHODS[method]
    ship_package(vectors.sparkSession)
    keyed = F.xxhash64(F.col(key)) if doc_key is None else doc_key
    docs = vectors.select(keyed.alias("doc_key"), "term_ids", "tfs")
    if vocab_size * k * 8 <= budget:
        table = probs.select("term_id", "topic", "prob").toArrow()
        phi = np.zeros((vocab_size, k))
        phi[table.column("term_id").to_numpy(), table.column("topic").to_numpy()] = table.column("prob").to_numpy()
        sent = vectors.sparkSession.sparkContext.broadcast(phi)

        def run(batches):
            for batch in batches:
                tokens, total = score(batch, lambda terms: sent.value[terms], **options)
                yield pa.RecordBatch.from_pydict({"tokens": [tokens], "log_likelihood": [total]})

        scored = docs.mapInArrow(run, _SCORED)
    else:
        parts, uses = _parts_that_fit(docs, k)

        def met(documents: pa.Table, used: pa.Table) -> pa.Table:
            terms = used.column("term_id").to_numpy()
            flat = used.column("phi").combine_chunks().flatten().to_numpy().reshape(-1, k)
            order = np.argsort(terms)
            known = terms[order]
            tokens, total = score(documents, lambda t: flat[order[np.searchsorted(known, t)]], **options)
            return pa.table({"tokens": [tokens], "log_likelihood": [total]})

        scored = meet(docs, "doc_key", uses, phi_rows(probs), parts, met, _SCORED)
    return scored.agg(
        F.sum("tokens").cast("long").alias("tokens"), F.sum("log_likelihood").alias("log_likelihood")
    )
