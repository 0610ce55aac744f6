"""Near pairs of vectors, exactly, by a dual traversal of cover trees.

Vectors of one label and length are normalised; a cosine of at least ``similarity`` is a
distance of at most ``radius`` on the sphere.  Equal vectors are one point with a weight.

*The upper levels are tables.*  A cell is a node with a centre and the true covering radius
of its points.  A cell of more than ``LEAF`` points is split among new centres, a net of
half the radius in a bounded sample of the cell; the sample only shapes the tree, every point
goes to its nearest centre and counts for the radius.  A cell whose diameter is below the
wanted distance is not split: all its points are linked, which needs no comparison, so that
a dense group of any size is no work.  Pairs of cells are traversed from the roots down, by
joins with the children of both, and a pair goes as soon as its covering radii allow no
link.  Of pairs of leaves some are linked whole; the others meet in tasks, block by block.

*Below the leaves a task has two blocks.*  Each becomes a cover tree with nested levels of
halving radii; a node is split while that gathers points.  Pairs of nodes are pruned by
their radii, linked whole by their radii, or compared by one matrix product in double
precision.  A task reports how much weight each point links to, and a star for each group
that it joins: never the pairs.

Bounds are used with a margin (``MARGIN``) beyond rounding; within it pairs are compared.

Rows whose vector is null, zero or holds null or non-finite components, and rows without
label, link with nothing.  Vectors of different lengths never link.  Rows may repeat, also
with equal ids; each counts.  A null id is never a smallest id, a component without any id
has a null one.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import released, written
from topicloom.llm.contract import components
from topicloom.operators.topk import top_k
from topicloom.session import broadcast_if_small, ship_package

SIMILARITY = 0.93
#: Points of a leaf, rows of the sample that shapes a split, and children of a cell.
LEAF, SAMPLE, CHILDREN = 2048, 512, 16
#: Rounds of splits; cells that are still large are cut into blocks by hash.
MOST_LEVELS = 40
MARGIN = 1e-9
#: Copies of the row of a vector to which many rows are joined.
SALTS = 16
#: Points of a node that are compared by one product.
NODE = 256


def _valid(vector) -> np.ndarray | None:
    """The vector in double precision, scaled by a power of two; None if it cannot link."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


@released
def _read(batches):
    """(uid, id, key, same, v): the key is null where the row links with nothing."""
    for batch in batches:
        keys, same, vectors = [], [], []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
            v = _valid(vector) if label is not None else None
            keys.append(None if v is None else f"{label}:{len(v)}")
            same.append(None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()))
            vectors.append(None if v is None else (v / math.sqrt(v @ v)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"), batch.column("id"), pa.array(keys, pa.string()),
                pa.array(same, pa.binary()), pa.array(vectors, pa.binary()),
            ],
            ["uid", "id", "key", "same", "v"],
        )


def _matrix(column) -> np.ndarray:
    """The rows of a column of packed vectors of one length."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(len(column), -1)


def net(points: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Positions of points that are ``apart`` from each other, farthest first, at most ``most``."""
    chosen = [0]
    near = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)):
        far = int(near.argmax())
        if near[far] <= apart:
            break
        chosen.append(far)
        near = np.minimum(near, np.linalg.norm(points - points[far], axis=1))
    return np.array(chosen)


def _choose(table: pa.Table) -> pa.Table:
    """Centres of a cell's children, packed one after the other: a net of half the radius of
    the sample, or of a lower level if that has one point only."""
    points = _matrix(table.column("v"))
    apart = float(np.linalg.norm(points - points[0], axis=1).max()) / 2
    chosen = net(points, apart, CHILDREN)
    return pa.table({
        "cell": table.column("cell")[:1], "centres": pa.array([points[chosen].tobytes()], pa.binary()),
    })


@released
def _place(batches):
    """Each point of a split cell moves to the child of its nearest centre."""
    for batch in batches:
        cells = batch.column("cell").to_pylist()
        centres = batch.column("centres").to_pylist()
        near, away, own = list(cells), [None] * len(cells), [None] * len(cells)
        rows: dict[str, list[int]] = {}
        for i, cell in enumerate(cells):
            rows.setdefault(cell, []).append(i)
        vectors = batch.column("v").to_pylist()
        for cell, at in rows.items():
            packed = centres[at[0]]
            points = np.frombuffer(b"".join([vectors[i] for i in at]), np.float64).reshape(len(at), -1)
            middle = np.frombuffer(packed, np.float64).reshape(-1, points.shape[1])
            best = (points @ middle.T - (middle * middle).sum(1) / 2).argmax(axis=1)
            distance = np.linalg.norm(points - middle[best], axis=1)
            for i, b, d in zip(at, best.tolist(), distance.tolist()):
                near[i], away[i], own[i] = f"{cell}/{b}", d, middle[b].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"), batch.column("m"), batch.column("v"), pa.array(near, pa.string()),
                pa.array(cells, pa.string()), pa.array(away, pa.float64()), pa.array(own, pa.binary()),
            ],
            ["node", "m", "v", "cell", "parent", "away", "centre"],
        )


_POINT = "node long, m long, v binary, cell string"


def grow(points: DataFrame, radius: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """The upper levels over ``points`` (node, m, v, key): (cells, points with their leaf cell).

    ``cells`` has (cell, parent, centre, radius, points, weight, least); roots have no parent.
    """
    cells, settled = [], []
    current = points.select(
        "node", "m", "v", F.col("key").alias("cell"), F.lit(None).cast("string").alias("parent"),
        F.lit(2.0).alias("away"), F.col("v").alias("centre"),
    )
    for level in range(MOST_LEVELS):
        # A cell has one centre; a root takes any of its points.
        made = current.groupBy("cell", "parent").agg(
            F.min("centre").alias("centre"), F.max("away").alias("radius"), F.count("*").alias("points"),
            F.sum("m").alias("weight"), F.min("node").alias("least"),
        )
        made = written(made, "cells")
        cells.append(made)
        wide = (F.col("points") > leaf) & (2 * F.col("radius") >= radius - MARGIN)
        open_cells = made.where(wide & F.lit(level < MOST_LEVELS - 1)).select("cell")
        if open_cells.isEmpty():
            settled.append(current.select("node", "m", "v", "cell"))
            break
        small, _ = broadcast_if_small(open_cells, width=200)
        settled.append(current.join(small, "cell", "left_anti").select("node", "m", "v", "cell"))
        inside = current.join(small, "cell", "left_semi").select("node", "m", "v", "cell")
        sample = top_k(inside, ["cell"], [F.xxhash64("node"), F.col("node")], SAMPLE)
        centres = sample.select("cell", "v").groupBy("cell").applyInArrow(_choose, "cell string, centres binary")
        centres, _ = broadcast_if_small(written(centres, "centres"), width=CHILDREN * 8 * 1024)
        placed = inside.join(centres, "cell").mapInArrow(
            _place, _POINT + ", parent string, away double, centre binary"
        )
        current = written(placed, "placed")
    every = cells[0]
    for more in cells[1:]:
        every = every.unionByName(more)
    leaves = settled[0]
    for more in settled[1:]:
        leaves = leaves.unionByName(more)
    return written(every, "tree"), leaves


@released
def _judge(batches):
    """Distance of the centres of the cells of each pair."""
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("centre_a", "centre_b"))
        apart = [float(np.linalg.norm(np.frombuffer(x) - np.frombuffer(y))) for x, y in zip(a, b)]
        yield batch.drop_columns(["centre_a", "centre_b"]).append_column("apart", pa.array(apart, pa.float64()))


def leaf_pairs(cells: DataFrame, radius: float) -> DataFrame:
    """(a, b, whole): pairs of leaf cells, a = b among them, that may hold links; ``whole``
    if all their points are linked for certain.  Traverses the tree from its roots."""
    inner = cells.where("parent IS NOT NULL").select(F.col("parent").alias("cell")).distinct()
    leaves = cells.join(inner, "cell", "left_anti").withColumn("leaf", F.lit(True))
    kept = cells.join(inner, "cell").withColumn("leaf", F.lit(False))
    nodes = leaves.unionByName(kept).select("cell", "parent", "centre", "radius", "leaf")
    # A leaf is its own child, so that both sides of a pair go down together.
    down = nodes.where("parent IS NOT NULL").unionByName(
        nodes.where("leaf").withColumn("parent", F.col("cell"))
    )
    down = written(down, "children")
    pairs = written(
        nodes.where("parent IS NULL").select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.col("leaf").alias("ends")),
        "pairs",
    )
    found = []

    def side(name):
        return down.select(
            F.col("parent").alias(name), F.col("cell").alias(f"next_{name}"), F.col("centre").alias(f"centre_{name}"),
            F.col("radius").alias(f"radius_{name}"), F.col("leaf").alias(f"leaf_{name}"),
        )

    first = True
    while first or not pairs.isEmpty():
        going = pairs if first else pairs.where("NOT ends")
        met = going.join(side("a"), "a").join(side("b"), "b").where("a <> b OR next_a <= next_b")
        met = met.select(
            F.col("next_a").alias("a"), F.col("next_b").alias("b"), "radius_a", "radius_b",
            (F.col("leaf_a") & F.col("leaf_b")).alias("ends"), "centre_a", "centre_b",
        ).mapInArrow(
            _judge, "a string, b string, radius_a double, radius_b double, ends boolean, apart double"
        )
        reach = F.col("radius_a") + F.col("radius_b")
        near = met.where(F.col("apart") - reach <= radius + MARGIN)
        pairs = written(
            near.select("a", "b", "ends", (F.col("apart") + reach <= radius - MARGIN).alias("whole")), "pairs"
        )
        found.append(pairs.where("ends").select("a", "b", "whole"))
        pairs = pairs.where("NOT ends")
        first = False
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


class Tree:
    """A cover tree of some points, as arrays; each node is a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.first, self.last, self.centre, self.radius, self.children = [], [], [], [], []
        self.points = points
        self._add(0, len(points), 0)
        at = 0
        while at < len(self.first):  # level by level
            self._split(at)
            at += 1
        self.points = points[self.order]

    def _add(self, a: int, b: int, centre: int) -> int:
        own = self.points[self.order[a:b]]
        self.first.append(a)
        self.last.append(b)
        self.centre.append(self.points[centre])
        self.radius.append(float(np.linalg.norm(own - self.points[centre], axis=1).max()))
        self.children.append([])
        return len(self.first) - 1

    def _split(self, node: int) -> None:
        """Children with half the radius, if that gathers points: eight a child on average."""
        a, b, radius = self.first[node], self.last[node], self.radius[node]
        if b - a <= NODE or radius == 0:
            return
        own = self.order[a:b]
        most = max(2, (b - a) // 8)
        left, groups = own, []
        while len(left):
            if len(groups) >= most:
                return
            close = np.linalg.norm(self.points[left] - self.points[left[0]], axis=1) <= radius / 2
            groups.append(left[close])
            left = left[~close]
        self.order[a:b] = np.concatenate(groups)
        for group in groups:
            self.children[node].append(self._add(a, a + len(group), group[0]))
            a += len(group)


class Links:
    """What two blocks have in common: weight each point links to, and joined groups."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.sums = weights, np.concatenate([[0], np.cumsum(weights)])
        self.linked = np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger root of each pair below the smaller one until all agree."""
        while True:
            ra, rb = self.label[a], self.label[b]
            open_pairs = ra != rb
            if not open_pairs.any():
                return
            a, b, ra, rb = a[open_pairs], b[open_pairs], ra[open_pairs], rb[open_pairs]
            np.minimum.at(self.label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = self.label[self.label]
                if np.array_equal(jumped, self.label):
                    break
                self.label = jumped

    def whole(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """All points of two ranges are linked; a range with itself too."""
        self.linked[a[0] : a[1]] += self.sums[b[1]] - self.sums[b[0]]
        if a != b:
            self.linked[b[0] : b[1]] += self.sums[a[1]] - self.sums[a[0]]
        else:
            self.linked[a[0] : a[1]] -= self.weights[a[0] : a[1]]
        members = np.concatenate([np.arange(*a), np.arange(*b)])
        self.join(members, np.full(len(members), members[0]))

    def compare(self, x, y, a: int, b: int, same: bool, similarity: float) -> None:
        """Points ``x`` from position ``a`` on with points ``y`` from ``b`` on."""
        near = x @ y.T >= similarity
        if same:
            np.fill_diagonal(near, False)
        self.linked[a : a + len(x)] += near @ self.weights[b : b + len(y)]
        if not same:
            self.linked[b : b + len(y)] += self.weights[a : a + len(x)] @ near
        i, j = np.nonzero(near)
        self.join(i + a, j + b)


def dual(x: Tree, y: Tree | None, links: Links, shift: int, similarity: float) -> None:
    """Traverse two trees, or one with itself (``y`` None); ``y`` starts at ``shift``."""
    radius = math.sqrt(max(0.0, 2 - 2 * similarity))
    other = y or x
    waiting = [(0, 0)]
    while waiting:
        p, q = waiting.pop()
        same = y is None and p == q
        apart = 0.0 if same else float(np.linalg.norm(x.centre[p] - other.centre[q]))
        reach = x.radius[p] + other.radius[q]
        if apart - reach > radius + MARGIN:
            continue
        a = (x.first[p], x.last[p])
        b = (other.first[q] + shift, other.last[q] + shift)
        if apart + reach <= radius - MARGIN:
            links.whole(a, b)
        elif same and x.children[p]:
            own = x.children[p]
            waiting += [(c, d) for i, c in enumerate(own) for d in own[i:]]
        elif x.children[p] and (x.radius[p] >= other.radius[q] or not other.children[q]):
            waiting += [(c, q) for c in x.children[p]]
        elif not same and other.children[q]:
            waiting += [(p, d) for d in other.children[q]]
        else:
            for i in range(a[0], a[1], NODE * 4):
                end = min(i + NODE * 4, a[1])
                for j in range(b[0], b[1], NODE * 4):
                    if same and j < i:
                        continue
                    stop = min(j + NODE * 4, b[1])
                    links.compare(
                        x.points[i:end], other.points[j - shift : stop - shift], i, j, same and i == j, similarity
                    )


def _meet(similarity: float):
    """(node, linked, root) of the points of two blocks, or of one with itself."""

    def meet(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy().astype(bool)
        nodes, weights = table.column("node").to_numpy(), table.column("m").to_numpy()
        points = _matrix(table.column("v"))
        sides = [np.flatnonzero(~second), np.flatnonzero(second)]
        trees = [Tree(points[s]) if len(s) else None for s in sides]
        found = {"node": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
        if trees[0] is not None:
            order = np.concatenate([s[t.order] for s, t in zip(sides, trees) if t is not None])
            links, nodes = Links(weights[order]), nodes[order]
            dual(trees[0], trees[1], links, len(sides[0]) if trees[1] else 0, similarity)
            told = np.flatnonzero(links.linked > 0)
            found = {"node": nodes[told], "linked": links.linked[told], "root": nodes[links.label[told]]}
        return pa.table(found)

    return meet


def link_points(points: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(node, linked) and edges (a, b) of ``points`` (node, m, v, key): the weight of the other
    points that each is linked to, and edges with the same components as all links."""
    radius = math.sqrt(max(0.0, 2 - 2 * similarity))
    cells, placed = grow(points, radius, leaf)
    pairs = written(leaf_pairs(cells, radius), "leaf-pairs")
    of_cell = cells.select("cell", "weight", "least", F.ceil(F.col("points") / leaf).cast("int").alias("blocks"))

    # Cells that are linked whole: weights and edges of cells, not of points.
    whole = pairs.where("whole").select("a", "b")
    both = whole.unionByName(whole.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = of_cell.select(F.col("cell").alias("b"), "weight", "least")
    summed = both.join(partner, "b").groupBy(F.col("a").alias("cell")).agg(
        F.sum("weight").alias("gain"), F.min("least").alias("hub"),
        F.max((F.col("a") == F.col("b")).cast("int")).alias("itself"),
    )
    summed, _ = broadcast_if_small(written(summed, "whole"), width=300)
    members = placed.join(summed, "cell").select(
        "node", (F.col("gain") - F.col("itself") * F.col("m")).alias("linked"), F.col("hub").alias("root")
    )
    one = of_cell.select(F.col("cell").alias("a"), F.col("least").alias("x"))
    other = of_cell.select(F.col("cell").alias("b"), F.col("least").alias("y"))
    between = whole.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # The others meet block by block.
    blocks = of_cell.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    some = pairs.where("NOT whole")
    a = blocks.select(F.col("cell").alias("a"), F.col("block").alias("i"))
    b = blocks.select(F.col("cell").alias("b"), F.col("block").alias("j"))
    meetings = some.join(a, "a").join(b, "b").where("a <> b OR i <= j")
    meetings = meetings.withColumn("meeting", F.concat_ws("|", "a", "i", "b", "j"))
    alone = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    sides = meetings.select("meeting", F.col("a").alias("cell"), F.col("i").alias("block"), F.lit(0).alias("second")).unionByName(
        meetings.where(~alone).select("meeting", F.col("b").alias("cell"), F.col("j").alias("block"), F.lit(1).alias("second"))
    )
    sides, _ = broadcast_if_small(written(sides, "meetings"), width=400)
    counts, _ = broadcast_if_small(of_cell.select("cell", "blocks"), width=200)
    dealt = placed.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.join(sides, ["cell", "block"]).select("meeting", "second", "node", "m", "v")
    found = written(
        met.groupBy("meeting").applyInArrow(_meet(similarity), "node long, linked long, root long")
        .unionByName(members),
        "linked",
    )
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(between)
    return found.groupBy("node").agg(F.sum("linked").alias("linked")), edges


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = SIMILARITY, leaf: int = LEAF,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: other rows linked directly, the smallest
    id that links reach, and whether that is its own."""
    ship_package(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
    ).mapInArrow(_read, f"uid long, id {kind}, key string, same binary, v binary")
    rows = written(rows, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key", "same").agg(
        F.min("uid").alias("node"), F.count("*").alias("m"), F.min("id").alias("least"), F.first("v").alias("v"),
    )
    classes = written(classes, "classes")
    linked, edges = link_points(classes.select("node", "m", "v", "key"), similarity, leaf)
    roots = components(edges)
    rooted = classes.select("key", "same", "node", "m", "least").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    ).join(linked, "node", "left")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # A row of a class that many rows have is met in several copies, a salt each.
    judged = written(rooted.join(named, "root").select(
        "key", "same", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    ), "judged")
    salted = rows.select("uid", "id", "key", "same", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(judged, ["key", "same", "salt"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
