"""Approximate nearest neighbours: an NN-descent graph and greedy search in it.

Nearness is the inner product.  Equal vectors are one node.  For the graph a node carries
its vector in two bytes a component (with a scale), so that it can travel.  What the codes
can be wrong by is known: every node of the final beam that may be among the answers, by
that bound, is scored again on the original vectors in double precision.

*Graph.*  ``TREES`` times the nodes are range-sorted by the signs of their projections on
random directions, and every stretch of ``LEAF`` nodes is compared within itself.  Then
NN-descent: each node is sent to its neighbours, meets their neighbours there (a join of
the lists with themselves), and keeps the ``DEGREE`` best of what it meets.  Rounds end
when they improve the lists by less than ``ENOUGH``.  A list and what travels to it are
bounded for every node, however many nodes name it as a neighbour; such hubs are ordinary
skewed join keys.

*Search.*  A query holds the ``BEAM`` best nodes seen.  In each round it visits those not
yet visited, by a join with the graph, which stays persisted by node; neighbours that
beat the beam come back.  It ends when all of the beam is visited.  Rows of the index
start at their own node, other queries at ``ENTRIES`` nodes.

Vectors that are null, zero, of a rare length (another than most), or hold null or
non-finite components take no part, nor do rows without id.  A row given twice is one
candidate.  With fewer than ``k`` candidates all are returned.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from topicloom.llm.common import bounds, written
from topicloom.session import ship_package

DEGREE, TREES, LEAF = 24, 2, 2048
ROUNDS, ENOUGH = 12, 0.002
BEAM, ENTRIES = 400, 256
#: The largest code; a component is off by half a code at most.
TOP_CODE = 32767

_PAIRS = "array<struct<w:bigint,s:float>>"
_POOL = "array<struct<w:bigint,s:float,done:boolean>>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part, x as array<double>."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    limit = F.lit(float("inf"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    rows = rows.where(F.col("id").isNotNull() & fine & F.exists("x", lambda v: v != 0))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _coded(trees: int, d: int):
    """Byte codes, and for each tree the signs of the projections as a sort key."""

    def code(batches):
        planes = np.random.default_rng(7).standard_normal((trees * 40, d)).astype(np.float32)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            scale = np.abs(x).max(axis=1) / TOP_CODE
            codes = np.rint(x / scale[:, None]).astype("<i2")
            signs = (x.astype(np.float32) @ planes.T > 0).reshape(-1, trees, 40)
            keys = (signs * (1 << np.arange(39, -1, -1))).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale.astype(np.float32)), pa.array(keys.tolist(), pa.list_(pa.int64())),
                ],
                ["node", "code", "scale", "keys"],
            )

    return code


def _vectors(codes, scales, d: int) -> np.ndarray:
    raw = b"".join(codes.to_pylist())
    return np.frombuffer(raw, "<i2").reshape(-1, d) * scales.to_numpy()[:, None].astype(np.float32)


def _lists(offsets, fields: dict) -> pa.ListArray:
    inner = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def _leaves(degree: int, leaf: int, d: int):
    """Neighbours within each stretch of ``leaf`` rows."""

    def compare(batch: pa.Table):
        node, x = batch.column("node").to_numpy(), _vectors(batch.column("code"), batch.column("scale"), d)
        most = min(degree, len(node) - 1)
        if most < 1:
            best, scores = np.zeros((len(node), 0), np.int64), np.zeros((len(node), 0), np.float32)
        else:
            products = x @ x.T
            np.fill_diagonal(products, -np.inf)
            best = np.argpartition(-products, most - 1, axis=1)[:, :most]
            scores = np.take_along_axis(products, best, axis=1)
        offsets = np.arange(len(node) + 1) * best.shape[1]
        lists = _lists(offsets, {"w": node[best].ravel(), "s": scores.ravel().astype(np.float32)})
        return pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "nb"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * leaf:
                table = pa.Table.from_batches(held)
                whole = size // leaf * leaf - leaf  # the last stretch waits: it may be all there is
                for a in range(0, whole, leaf):
                    yield compare(table.slice(a, leaf))
                held, size = table.slice(whole).to_batches(), size - whole
        if size:
            table = pa.Table.from_batches(held)
            step = size if size <= leaf else -(-size // 2)  # fewer than two stretches are left
            for a in range(0, size, step):
                yield compare(table.slice(a, step))

    return run


def _by_key(batches, solve):
    """Pass batches sorted by their first column to ``solve`` in whole keys."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 20_000:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield solve(table.slice(0, last))
        held, size = table.slice(last).to_batches(), size - last
    if size:
        yield solve(pa.Table.from_batches(held))


def _flat(table: pa.Table, column: str, key: np.ndarray):
    """The elements of a list column as a struct array, and the row of each."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(key)), sizes)


def _best(key, w, s, most: int, done=None):
    """An order of the entries: by key, best first, each w once (visited first), at most ``most``."""
    order = np.lexsort((w, key) if done is None else (~done, w, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (w[order][1:] == w[order][:-1])
    order = order[~same]
    order = order[np.lexsort((w[order], -s[order], key[order]))]
    sorted_key = key[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key)
    return order[rank < most]


def _merge_lists(degree: int):
    def solve(table: pa.Table):
        key = table.column("node").to_numpy()
        entries, row = _flat(table, "nb", key)
        w, s = (entries.field(f).to_numpy(zero_copy_only=False) for f in ("w", "s"))
        names, at = np.unique(key, return_inverse=True)
        order = _best(at[row], w, s, degree)
        offsets = np.searchsorted(at[row][order], np.arange(len(names) + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(names), _lists(offsets, {"w": w[order], "s": s[order]})], ["node", "nb"]
        )

    return lambda batches: _by_key(batches, solve)


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    dealt = lists.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(_merge_lists(degree), f"node long, nb {_PAIRS}")


def _meet(d: int):
    """Visitors (q, code, scale, least) and the neighbours of the node they visit: the
    neighbours that are nearer to the visitor than ``least``."""

    def meet(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                table = pa.Table.from_batches([batch.slice(a, 2048)])
                q = table.column("q").to_numpy()
                entries, row = _flat(table, "nb", q)
                x = _vectors(table.column("code"), table.column("scale"), d)
                y = _vectors(entries.field("code"), entries.field("scale"), d)
                s = np.einsum("ij,ij->i", x[row], y)
                w = entries.field("w").to_numpy()
                near = (s > table.column("least").to_numpy()[row]) & (w != table.column("own").to_numpy()[row])
                offsets = np.searchsorted(row[near], np.arange(len(q) + 1))
                found = np.diff(offsets) > 0
                lists = _lists(offsets, {"w": w[near], "s": s[near].astype(np.float32)})
                yield pa.RecordBatch.from_arrays([pa.array(q), lists], ["q", "nb"]).filter(pa.array(found))

    return meet


def _adjacency(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(at, nb): the lists with the codes of the neighbours."""
    flat = lists.select(F.col("node").alias("at"), F.explode("nb.w").alias("w"))
    coded = nodes.select(F.col("node").alias("w"), "code", "scale")
    return flat.join(coded, "w").groupBy("at").agg(
        F.collect_list(F.struct("w", "code", "scale")).alias("nb")  # at most DEGREE entries
    )


class Index:
    """``nodes`` (node, x, code, scale), ``members`` (node, id) and ``lists`` (node, nb)."""

    def __init__(self, nodes, members, lists, d):
        self.nodes, self.members, self.lists, self.d = nodes, members, lists, d


def build(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS,
) -> Index:
    """Index every usable row."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vector_col)
    named = rows.groupBy("x").agg(F.min("id").alias("node"))
    named = written(named, "vectors")
    members = written(rows.join(named, "x").select("node", "id").distinct(), "members")
    first = named.first()
    d = len(first["x"]) if first else 0
    coded = named.mapInArrow(_coded(trees, d), "node long, code binary, scale float, keys array<long>")
    nodes = written(coded, "codes")
    count = nodes.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // (2 * leaf)))
    lists = None
    for tree in range(trees):
        key = F.col("keys")[tree]
        ranged = nodes.select("node", "code", "scale", key.alias("key"))
        ranged = ranged.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
        found = ranged.mapInArrow(_leaves(degree, leaf, d), f"node long, nb {_PAIRS}")
        lists = found if lists is None else lists.unionByName(found)
    lists = written(_merged(lists, degree), "lists")
    total = _total(lists)
    nodes = nodes.drop("keys")
    for _ in range(rounds):
        visitors = lists.join(nodes, "node").select(
            F.col("node").alias("q"), F.col("node").alias("own"), "code", "scale",
            F.when(F.size("nb") >= degree, F.array_min("nb.s")).otherwise(F.lit(float("-inf")))
            .cast("float").alias("least"),
            F.explode("nb.w").alias("at"),
        )
        met = visitors.join(_adjacency(lists, nodes), "at").mapInArrow(_meet(d), f"q long, nb {_PAIRS}")
        met = met.withColumnRenamed("q", "node")
        lists = written(_merged(lists.unionByName(met), degree), "lists")
        before, total = total, _total(lists)
        if total[0] == before[0] and abs(total[1] - before[1]) <= ENOUGH * abs(before[1]):
            break
    return Index(named.join(nodes, "node"), members, lists, d)


def _total(lists: DataFrame) -> tuple[int, float]:
    score = F.aggregate("nb.s", F.lit(0.0), lambda a, s: a + s.cast("double"))
    row = lists.agg(F.sum(F.size("nb")), F.sum(score)).first()
    return row[0] or 0, row[1] or 0.0


def _merge_pools(beam: int):
    """States and found neighbours of each query: the state with the best of both."""

    def solve(table: pa.Table):
        q = table.column("q").to_numpy()
        entries, row = _flat(table, "pool", q)
        names, at = np.unique(q, return_inverse=True)
        w, s, done = (entries.field(f).to_numpy(zero_copy_only=False) for f in ("w", "s", "done"))
        order = _best(at[row], w, s, beam, done.astype(bool))
        offsets = np.searchsorted(at[row][order], np.arange(len(names) + 1))
        state = np.flatnonzero(table.column("code").is_valid().to_numpy())
        state = state[np.argsort(at[state], kind="stable")]
        kept = table.select(["q", "own", "code", "scale"]).take(pa.array(state)).combine_chunks()
        pool = _lists(offsets, {"w": w[order], "s": s[order], "done": done[order].astype(bool)})
        columns = [kept.column(c).combine_chunks() for c in ("q", "own", "code", "scale")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pool], ["q", "own", "code", "scale", "pool"])

    return lambda batches: _by_key(batches, solve)


_STATE = f"q long, own long, code binary, scale float, pool {_POOL}"


def _search(index: Index, start: DataFrame, beam: int) -> DataFrame:
    """Final states of the queries in ``start`` (columns of _STATE)."""
    spark = start.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = index.nodes.select("node", "code", "scale")
    graph = written(_adjacency(index.lists, coded), "graph")
    graph = graph.repartition(parts, "at").persist(StorageLevel.MEMORY_AND_DISK)
    state = written(start, "search")
    while True:  # a beam never takes a worse node, and ends when all of it is visited
        todo = F.filter("pool", lambda p: ~p["done"])
        visits = state.select(
            "q", "own", "code", "scale", F.explode(todo["w"]).alias("at"),
            F.when(F.size("pool") >= beam, F.array_min("pool.s")).otherwise(F.lit(float("-inf")))
            .cast("float").alias("least"),
        )
        if visits.isEmpty():
            break
        met = visits.join(graph, "at").mapInArrow(_meet(index.d), f"q long, nb {_PAIRS}")
        null = F.lit(None)
        found = met.select(
            "q", null.cast("long").alias("own"), null.cast("binary").alias("code"),
            null.cast("float").alias("scale"),
            F.transform("nb", lambda p: F.struct(
                p["w"].alias("w"), p["s"].alias("s"), F.lit(False).alias("done")
            )).alias("pool"),
        )
        visited = state.withColumn("pool", F.transform("pool", lambda p: F.struct(
            p["w"].alias("w"), p["s"].alias("s"), F.lit(True).alias("done")
        )))
        both = visited.unionByName(found).repartition("q").sortWithinPartitions("q")
        state = written(both.mapInArrow(_merge_pools(beam), _STATE), "search")
    graph.unpersist()
    return state


def _start_at_own(index: Index, queries: DataFrame) -> DataFrame:
    """Queries (q, node) that are rows of the index: the pool is the node's own list."""
    own = queries.join(index.nodes.select("node", "code", "scale"), "node")
    own = own.join(index.lists, "node", "left")
    pool = F.transform(F.coalesce("nb", F.array().cast(_PAIRS)), lambda p: F.struct(
        p["w"].alias("w"), p["s"].alias("s"), F.lit(False).alias("done")
    ))
    return own.select("q", F.col("node").alias("own"), "code", "scale", pool.alias("pool"))


def _start_at_entries(index: Index, queries: DataFrame) -> DataFrame:
    """Other queries (q, x): the pool is ENTRIES nodes, the same for all."""
    d = index.d
    entries = index.nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "code", "scale")
    rows = entries.collect()
    nodes = np.array([r["node"] for r in rows], np.int64)
    y = np.array([np.frombuffer(r["code"], "<i2") * r["scale"] for r in rows], np.float32).reshape(-1, d)

    def start(batches):
        for batch in batches:
            n = batch.num_rows
            x = _vectors(batch.column("code"), batch.column("scale"), d)
            pool = _lists(np.arange(n + 1) * len(nodes), {
                "w": np.tile(nodes, n), "s": (x @ y.T).ravel().astype(np.float32),
                "done": np.zeros(n * len(nodes), bool),
            })
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.nulls(n, pa.int64()), batch.column("code"),
                 batch.column("scale"), pool],
                ["q", "own", "code", "scale", "pool"],
            )

    coded = queries.select(F.col("q").alias("node"), "x").mapInArrow(
        _coded(1, d), "node long, code binary, scale float, keys array<long>"
    )
    filled = coded.mapInArrow(start, _STATE)
    return filled.withColumn("own", F.lit(-(2**63)))  # no node of the index


def _answers(index: Index, state: DataFrame, asked: DataFrame, most: int, own: bool) -> DataFrame:
    """(q, id, score): for each asked (q, x) the ``most`` best rows, scored exactly.

    All rows that share a found node's vector count, and with ``own`` those of the node
    that asks.
    """
    # A code is off by sqrt(d) / (2 TOP_CODE) of the norm at most, for either vector.
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    longest = index.nodes.agg(F.max(norm)).first()[0] or 0.0
    off = 2 * (index.d ** 0.5 / TOP_CODE + 1e-6) * longest
    lengths = asked.select("q", (norm * off).alias("margin"))
    last = F.get("pool.s", F.lit(most - 1)).cast("double")
    close = F.filter("pool", lambda p: last.isNull() | (p["s"].cast("double") >= last - F.col("margin")))["w"]
    state = state.join(lengths, "q").withColumn("close", close)
    nodes = F.array_union("close", F.array("own")) if own else F.col("close")
    pairs = state.select("q", F.explode(nodes).alias("node"))
    scored = pairs.join(index.nodes.select("node", "x"), "node").join(
        asked.select("q", F.col("x").alias("qx")), "q"
    )
    product = F.aggregate(F.zip_with("x", "qx", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    scored = scored.select("q", "node", product.alias("score"))
    smallest = Window.partitionBy("node").orderBy("id")
    few = index.members.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= most)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = scored.join(few.drop("n"), "node").withColumn("n", F.row_number().over(order))
    return ranked.where(F.col("n") <= most).select("q", "id", "score")


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_rows(index: Index, ids: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest other rows of each indexed row in ``ids`` (id): query_id, rank,
    vec_id, score; nearest first, equal scores by vec_id.

    Copies of a vector search once, for one answer more than ``k``: at most one of the
    answers is the row that asks.
    """
    queries = index.members.join(ids.select("id").distinct(), "id")
    queries = written(queries.select(F.col("id").alias("query_id"), "node"), "queries")
    once = queries.select(F.col("node").alias("q"), "node").distinct()
    state = _search(index, _start_at_own(index, once), beam)
    asked = index.nodes.select(F.col("node").alias("q"), "x")
    found = _answers(index, state, asked, k + 1, True)
    pairs = queries.join(found, queries["node"] == found["q"])
    return _ranked(pairs.where(F.col("id") != F.col("query_id")), k)


def search(
    index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    beam: int = BEAM,
) -> DataFrame:
    """The ``k`` nearest rows of each usable query vector; columns as of ``search_rows``."""
    asked = usable(queries, id_col, vector_col).where(F.size("x") == index.d)
    asked = asked.groupBy(F.col("id").alias("q")).agg(F.first("x").alias("x"))
    state = _search(index, _start_at_entries(index, asked), beam)
    found = _answers(index, state, asked, k, False)
    return _ranked(found.withColumnRenamed("q", "query_id"), k)
