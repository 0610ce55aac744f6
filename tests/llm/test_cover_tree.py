import numpy as np
import pytest

from topicloom.llm import cover_tree as ct
from topicloom.llm import queries
from topicloom.llm.contract import components


def by_hand(rows, similarity=0.93):
    """Every row with every other."""
    ok = []
    for _, v, label in rows:
        good = v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        v = np.array(v, float) / np.abs(np.array(v, float)).max() if good else None
        ok.append(v / np.linalg.norm(v) if good else None)
    near = {i: [] for i in range(len(rows))}
    for i, x in enumerate(ok):
        for j, y in enumerate(ok):
            if i != j and x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y):
                if x @ y >= similarity:
                    near[i].append(j)
    answer, seen = {}, set()
    for i in near:
        if i in seen:
            continue
        group, waiting = {i}, [i]
        while waiting:
            for j in near[waiting.pop()]:
                if j not in group:
                    group.add(j)
                    waiting.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            answer[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(map(repr, answer.values()))


def of(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return docs.selectExpr("*", "1 AS id", "2 AS key", "3 AS uid", "4 AS node", "5 AS same", "6 AS v")


def around(rng, centre, n, spread):
    x = centre + rng.normal(0, spread, (n, len(centre)))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("leaf", [5, 5000])
def test_groups_of_all_densities(spark, leaf):
    """Random vectors, chains, dense and loose groups, copies; small leaves force all levels."""
    rng = np.random.default_rng(leaf)
    d, parts = 16, []
    parts.append(around(rng, np.zeros(d), 150, 1.0))
    for spread in (0.0001, 0.03, 0.06, 0.1, 0.2):
        parts.append(around(rng, around(rng, np.zeros(d), 1, 1.0)[0], 70, spread))
    angle = np.arange(40) * 0.3  # each a link to the next only
    chain = np.zeros((40, d))
    chain[:, 0], chain[:, 1], chain[:, 2] = np.cos(angle), np.sin(angle), np.arange(40) * 0.05
    parts.append(chain)
    parts.append(np.repeat(parts[0][:3], [30, 2, 5], axis=0) * rng.uniform(0.5, 2, (37, 1)))
    parts.append(np.repeat(parts[1][:1], 25, axis=0))
    x = np.concatenate(parts)
    ids = rng.permutation(len(x)) - 20
    rows = [(int(i), v.tolist(), int(rng.integers(3) == 0)) for i, v in zip(ids, x)]
    got = ct.near_vectors(frame(spark, rows).repartition(3), leaf=leaf)
    assert of(got) == by_hand(rows)


def test_odd_rows(spark):
    e = [1.0, 0.0]
    rows = [
        (1, e, 0), (2, e, 1), (3, e, None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0),
        (7, [1.0, float("nan")], 0), (8, [float("inf"), 1.0], 0), (9, [1e300, 1e299], 0), (10, [1e-300, 0.0], 0),
        (11, [1.0], 0), (12, [], 0), (None, e, 0), (None, [0.0, 1.0], 0), (13, e, 0), (13, e, 0), (0, [-1.0, 0.0], 0),
        (14, [3.0, 0.0], 0),
    ]
    docs = frame(spark, rows)
    assert of(ct.near_vectors(docs)) == by_hand(rows)
    assert ct.near_vectors(docs.where("false")).collect() == []


def test_a_dense_group_is_linked_by_its_cells(spark):
    """No comparison is needed where the covering radii decide."""
    rng = np.random.default_rng(2)
    x = around(rng, around(rng, np.zeros(8), 1, 1.0)[0], 3000, 0.005)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    points = frame(spark, rows)
    got = ct.near_vectors(points, leaf=100).selectExpr("min(n_links) a", "max(n_links) z", "max(component_id) c").first()
    assert tuple(got) == (2999, 2999, 0)
    sent = spark.createDataFrame([(i, 1, v.tobytes(), "k") for i, v in enumerate(x)], "node long, m long, v binary, key string")
    cells, _ = ct.grow(sent, np.sqrt(0.14), 100)
    pairs = ct.leaf_pairs(cells, np.sqrt(0.14))
    assert pairs.where("NOT whole").isEmpty() and not pairs.isEmpty()


def test_cells_cover_their_points(spark):
    rng = np.random.default_rng(3)
    x = around(rng, np.zeros(6), 900, 1.0)
    sent = spark.createDataFrame([(i, 1, v.tobytes(), "k") for i, v in enumerate(x)], "node long, m long, v binary, key string")
    cells, leaves = ct.grow(sent, 0.3, 30)
    known = {r.cell: r for r in cells.collect()}
    members = leaves.collect()
    assert sorted(r.node for r in members) == list(range(900))
    for r in members:
        cell = known[r.cell]
        assert np.linalg.norm(np.frombuffer(r.v) - np.frombuffer(cell.centre)) <= cell.radius + 1e-12
        assert cell.points <= 30 or 2 * cell.radius < 0.3
        assert cell.parent is None or cell.radius <= 2 * known[cell.parent].radius


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    from topicloom.llm import contract

    rounds = []
    kept = contract.written
    monkeypatch.setattr(contract, "written", lambda df, name: rounds.append(name) or kept(df, name))
    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    roots = components(chain.unionByName(chain.selectExpr("a + 20000 AS a", "b + 20000 AS b")))
    found = roots.groupBy("root").agg({"node": "min", "*": "count"}).collect()
    assert sorted((r["min(node)"], r["count(1)"]) for r in found) == [(0, 10_001), (20_000, 10_001)]
    assert rounds.count("edges") <= 20


def test_query_on_the_table(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    assert of(queries.op11_cover_tree(spark, sf_dir)) == by_hand([tuple(r) for r in rows.collect()])
