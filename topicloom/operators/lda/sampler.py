"""Gibbs and Metropolis-Hastings LDA as bulk-synchronous Spark sweeps.

A sweep maps the training state to its successor and then counts words per topic (at most
terms x topics rows leave a task).  The state is read and written once a sweep, whatever the
size of the model.  Counts whose size, known before they are collected, is within
``MODEL_BYTES`` are broadcast, and documents stay where they are.  Larger ones stay a table:
documents and the rows that they use meet part by part.

Each state is a table in the shared folder, so a lost executor costs the tasks
it was running, and neither plans nor lineage grow with the number of sweeps.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.lda.kernel import BlockCounts, Settings, sweep_documents, uniforms
from topicloom.operators.lda.meeting import meet, part_count, term_uses
from topicloom.operators.lda.state import (
    TOKENS_PER_PARTITION,
    initial_state,
    topic_totals,
    word_topic_counts,
)
from topicloom.operators.partitioning import block_count
from topicloom.operators.vectorize import token_total
from topicloom.session import keep, scratch_path, ship_package
from topicloom.sources import checkpoints
from topicloom.sources.manifest import digest

MODEL_BYTES = 256 * 2**20
BYTES_PER_COUNT = 64  # a count, its key and its share of an alias table, and the collected row
GROUP_TERMS = 1000  # terms between two refreshes of the documents' topic counts
POWER_LAW_CELLS = 2_000_000  # dense cells of the hot terms


@dataclass
class TopicModel:
    """A trained sampler model; everything corpus- or model-sized is a DataFrame."""

    state: DataFrame
    word_topic: DataFrame
    totals: DataFrame
    k: int
    vocab_size: int
    alpha: float
    beta: float
    sweeps: int
    train_ms: int


def power_law_cutoff(k: int) -> int:
    """Frequency rank below which a term's counts are kept dense."""
    return POWER_LAW_CELLS // k


def total_counts(table: DataFrame, k: int) -> np.ndarray:
    totals = np.zeros(k)
    for row in topic_totals(table).collect():
        totals[row["topic"]] = row["n"]
    return totals


def _in_block(table: DataFrame, first: int, last: int) -> DataFrame:
    return table.where((F.col("term_id") >= first) & (F.col("term_id") < last))


def block_counts(table: DataFrame, first: int, last: int, k: int, totals=None) -> BlockCounts:
    """Collect the counts of the terms ``first`` to ``last`` from a table of word-topic
    counts; the caller knows that their number is bounded."""
    if totals is None:
        totals = total_counts(table, k)
    mine = _in_block(table, first, last).toArrow()
    term_id, topic, n = (mine.column(c).to_numpy() for c in ("term_id", "topic", "n"))
    return BlockCounts.build(first, last, k, power_law_cutoff(k), term_id, topic, n, totals)


def _resampled(batch, counts: BlockCounts, method: str, s: Settings, sweep: int):
    """A batch or table of the state with new topics."""
    z, words, keys = (batch.column(c) for c in ("z", "words", "doc_key"))
    if isinstance(batch, pa.Table):
        z, words, keys = (c.combine_chunks() for c in (z, words, keys))
    offsets = z.offsets.to_numpy().astype(np.int64)
    drawn = sweep_documents(
        method, s, sweep, counts, words.flatten().to_numpy(zero_copy_only=False),
        z.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0],
        keys.to_numpy(zero_copy_only=False),
    )
    lists = pa.ListArray.from_arrays(
        pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(drawn).cast(z.type.value_type)
    )
    return batch.set_column(batch.schema.get_field_index("z"), "z", lists)


def sample_block(state: DataFrame, counts: BlockCounts, method: str, s: Settings, sweep: int):
    """The state after resampling the block's tokens by broadcast counts; narrow."""
    if method == "mh":
        counts.prepare(s)
    sent = state.sparkSession.sparkContext.broadcast(counts)

    def resample(batches):
        for batch in batches:
            yield _resampled(batch, sent.value, method, s, sweep)

    return state.mapInArrow(resample, state.schema), sent


def sample_block_met(
    state: DataFrame, uses: DataFrame, parts: int, table: DataFrame, totals: np.ndarray,
    first: int, last: int, method: str, s: Settings, sweep: int,
) -> DataFrame:
    """The same for counts of any size: each part of the documents meets its own."""
    pairs = F.collect_list(F.struct("topic", "n"))
    rows = _in_block(table, first, last).groupBy("term_id").agg(pairs.alias("pairs"))
    cutoff = power_law_cutoff(s.k)

    def resample(documents: pa.Table, used: pa.Table) -> pa.Table:
        if not used.num_rows:
            return documents
        terms = used.column("term_id").to_numpy()
        pairs = used.column("pairs").combine_chunks()
        term = np.repeat(terms, np.diff(pairs.offsets.to_numpy()))
        topic, n = (pairs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("topic", "n"))
        counts = BlockCounts.build(first, last, s.k, cutoff, term, topic, n, totals, np.sort(terms))
        return _resampled(documents, counts, method, s, sweep)

    return meet(state, "doc_key", uses, rows, parts, resample, state.schema)


def _spread(vectors: DataFrame, partitions: int | None, key: str) -> DataFrame:
    """Training is bound by CPU, so spread the documents evenly, by key."""
    if partitions is None:
        tokens = vectors.agg(F.sum(token_total(vectors))).first()[0] or 0
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        partitions = max(cores, -(-tokens // TOKENS_PER_PARTITION))
    return vectors.repartition(partitions, key)


def fit_sampler(
    vectors: DataFrame,
    vocab_size: int,
    method: str = "mh",
    k: int = 30,
    iterations: int = 100,
    alpha: float = 0.5,
    beta: float = 0.01,
    seed: int = 42,
    mh_steps: int = 2,
    partitions: int | None = None,
    block_size: int | None = None,
    checkpoint_save: str = "",
    checkpoint_read: str = "",
    checkpoint_every: int = 1,
    key: str = "doc_id",
    model_bytes: int | None = None,
    begin: DataFrame | None = None,
    groups: int | None = None,
    uniform: Callable = uniforms,
) -> TopicModel:
    """Train by ``mh`` (Metropolis-Hastings) or ``naive`` (full conditional) sampling.

    ``block_size`` terms are resampled at a time, with fresh counts for each block; by
    default a sweep counts once.  ``model_bytes`` decides how counts reach the documents, by
    broadcast or by a join, and changes no result.  ``checkpoint_read`` resumes from the
    latest complete sweep found there, if it was written with the same settings and from the
    same documents.  ``begin`` is
    a state to start from instead of random topics; documents refresh their topic counts
    between ``groups`` of terms; ``uniform`` makes the draws.
    """
    if method not in ("mh", "naive"):
        raise ValueError("method must be 'mh' or 'naive'")
    if k < 1 or alpha <= 0 or beta <= 0 or mh_steps < 1 or checkpoint_every < 1:
        raise ValueError("k, alpha, beta, mh_steps and checkpoint_every must be positive")
    began = time.time()
    spark = vectors.sparkSession
    ship_package(spark)
    groups = groups or max(8, -(-vocab_size // GROUP_TERMS))
    s = Settings(k, alpha, beta, vocab_size, seed, mh_steps, groups, uniform)
    settings = {
        "method": method, "k": k, "alpha": alpha, "beta": beta, "vocab_size": vocab_size,
        "seed": seed, "mh_steps": mh_steps, "block_size": block_size,
    }
    if checkpoint_save or checkpoint_read:
        settings["corpus"] = digest(vectors, [key, "term_ids", "tfs"])
    start, state = 0, None
    scratch = scratch_path(spark, "sweeps")
    if checkpoint_read:
        start, state = checkpoints.read_latest(spark, checkpoint_read, settings)
    if state is None and begin is not None:
        state = checkpoints.write(begin, f"{scratch}/0")
    if state is None:
        spread = _spread(vectors, partitions, key)
        state = checkpoints.write(initial_state(spread, k, seed, key), f"{scratch}/0")

    blocks = block_count(vocab_size, block_size or vocab_size)
    budget = MODEL_BYTES if model_bytes is None else model_bytes
    uses, parts, written = None, 0, 0
    for sweep in range(start, iterations):
        for block in range(blocks):
            first, last = (-(-b * vocab_size // blocks) for b in (block, block + 1))
            table = checkpoints.write(word_topic_counts(state), f"{scratch}/counts-{written}")
            totals = total_counts(table, k)
            sent = None
            if _in_block(table, first, last).count() * BYTES_PER_COUNT <= budget:
                counts = block_counts(table, first, last, k, totals)
                sampled, sent = sample_block(state, counts, method, s, sweep)
            else:
                if uses is None:
                    parts = part_count(state.agg(F.sum(F.size("words"))).first()[0] or 0, state)
                    uses = term_uses(state, "doc_key", "words", parts)
                    uses = checkpoints.write(uses, f"{scratch}/uses")
                sampled = sample_block_met(
                    state, uses, parts, table, totals, first, last, method, s, sweep
                )
            done = sweep + 1
            path = f"{scratch}/{written + 1}"
            save = done % checkpoint_every == 0 or done == iterations
            if checkpoint_save and save and block == blocks - 1:
                path = checkpoints.sweep_path(checkpoint_save, done)
                checkpoints.write_settings(spark, checkpoint_save, settings)
            state = checkpoints.write(sampled, path)
            if sent is not None:
                sent.destroy()
            checkpoints.drop(spark, f"{scratch}/{written}")
            checkpoints.drop(spark, f"{scratch}/counts-{written}")
            written += 1
    word_topic = keep(word_topic_counts(state))
    word_topic.count()
    return TopicModel(
        state, word_topic, topic_totals(word_topic), k, vocab_size, alpha, beta,
        max(start, iterations), int((time.time() - began) * 1000),
    )
