"""Connected components by contraction, in tables in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import released, written
from topicloom.session import ship_package

#: Contraction steps that are composed before the result becomes a table.
STEPS_PER_TABLE = 6
#: Edges that a task contracts at once.
BLOCK_EDGES = 500_000


def hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each position, the smallest known of its component) with the links of
    positions ``a`` and ``b`` added."""
    while True:  # hook the larger root below the smaller one until all pairs agree
        ra, rb = label[a], label[b]
        open_pairs = ra != rb
        if not open_pairs.any():
            return label
        a, b, ra, rb = a[open_pairs], b[open_pairs], ra[open_pairs], rb[open_pairs]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(a, b, block): each node with the first one of its component in these batches of edges."""
    names = pa.concat_arrays([x.column(c) for c in ("a", "b") for x in batches]).dictionary_encode()
    ends = names.indices.to_numpy().reshape(2, -1)
    label = hooked(np.arange(len(names.dictionary)), *ends)
    linked = np.flatnonzero(label != np.arange(len(label)))
    nodes = [names.dictionary.take(pa.array(x)) for x in (linked, label[linked])]
    block = pa.repeat(uuid.uuid4().int >> 65, len(linked))
    return pa.RecordBatch.from_arrays([*nodes, block], ["a", "b", "block"])


@released
def _stars(batches):
    """Edges (a, b) of the same nodes and components, contracted in blocks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_EDGES:
            yield _star(held)
            held, size = [], 0
    if size:
        yield _star(held)


def _contracted(edges: DataFrame) -> DataFrame:
    """The distinct ``edges`` between different nodes as a table, stars in place of what one
    block, named in ``block``, has of a component."""
    edges = edges.where("a <> b").select("a", "b").distinct()
    kind = edges.schema["a"].dataType.simpleString()
    return written(edges.mapInArrow(_stars, f"a {kind}, b {kind}, block long"), "edges")


def _ends(edges: DataFrame) -> set:
    """The first and the last block of ``edges``, in one step: none, one or two."""
    return set(edges.agg(F.min("block"), F.max("block")).first()) - {None}


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): equal roots, same component.

    In a round each node points at the neighbour, or itself, that comes first in an order
    drawn anew for the round, then at what that one points at; edges follow, and only those
    between different nodes stay.  Drawn orders make the number of rounds logarithmic for
    chains too, whose nodes in their own order would leave one by one.  Roots are nodes of
    their component, not the smallest ones.  Neighbours are combined before the shuffle, so
    a node with most of the edges is no hot key there; where edges follow, its side of the
    join has one row.  Tasks contract the edges that they hold before a round: when one block
    holds all that are left, its stars are the end, which spares the driver the last rounds.
    """
    steps, turn = [], 0
    ship_package(edges.sparkSession)
    edges = _contracted(edges)
    while len(blocks := _ends(edges)) > 1:
        edges = edges.drop("block")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(column, turn=turn):
            return F.struct(F.xxhash64(F.lit(turn), column).alias("rank"), F.col(column).alias("to"))

        step = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("best"))
        step = step.select("node", F.least("best", ranked("node")).getField("to").alias("to"))
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = written(step.join(ahead, "to").select("node", F.col("further").alias("to")), "step")
        steps.append(step)
        moved = edges
        for end in ("a", "b"):
            follow = step.select(F.col("node").alias(end), F.col("to").alias("moved"))
            moved = moved.join(follow, end).drop(end).withColumnRenamed("moved", end)
        edges = _contracted(moved)
        turn += 1
    if blocks:
        stars = edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
        steps.append(stars.unionByName(stars.select(F.col("to").alias("node"), "to").distinct()))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].select("node", F.col("to").alias("root"))
    for done, step in enumerate(steps[1:], 1):
        later = step.select(F.col("node").alias("root"), "to")
        roots = roots.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if done % STEPS_PER_TABLE == 0:
            roots = written(roots, "roots")
    return roots
