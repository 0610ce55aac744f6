import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import simhash


def brute_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def planted(seed, n):
    """Chains and clusters of fingerprints at small distances."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    return sorted(set(out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab A\tÉ\x0b\x1c", max_size=30), min_size=1, max_size=8))
def test_fingerprints(texts):
    got = simhash.fingerprints_of([t.encode() for t in texts], 3)
    assert got[:, 0].tolist() == [brute_fingerprint(t) for t in texts]


def test_forest_finds_every_pair_once():
    fps = np.array(planted(1, 300), np.uint64)[:, None]
    shard = np.sort(np.arange(len(fps)) % 3)
    pairs = [p for a, b in simhash.Forest(fps, shard).links(3) for p in zip(a.tolist(), b.tolist())]
    want = {
        (i, j)
        for i in range(len(fps))
        for j in range(i)
        if shard[i] == shard[j] and (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 3
    }
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_links_and_components(spark):
    fps = planted(2, 800)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = brute_components(fps, 3)
    classes = {}
    for f, (s,) in zip(fps, signed):
        classes.setdefault(want[f], set()).add(got.get(s, s))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (5, "a b c d"), (3, "A b  c\td"), (None, "a b c d"), (7, None), (2, ""), (9, "one"), (9, "one"),
        (4, long), (8, long + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS component_id")
    got = simhash.near_duplicates(docs)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got.collect())
    assert found == [(-1, 3), (2, 2), (3, 3), (4, 4), (5, 3), (7, 2), (8, 4), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_components_of_few_edges_take_few_jobs(spark):
    """Each round is plans, threads and memory of the driver."""
    order = random.Random(3).sample(range(3000), 3000)
    rows = [(a, b) for a, b in zip(order, order[1:]) if a % 100]
    edges = spark.createDataFrame(rows, "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    spark.sparkContext.setJobGroup("others", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 12
    want, label = {}, None
    for at, node in enumerate(order):
        label = node if not at or not order[at - 1] % 100 else label
        want.setdefault(label, set()).add(node)
    for nodes in want.values():
        assert len({got.get(n, n) for n in nodes}) == 1 and got.get(min(nodes), min(nodes)) in nodes


def test_components_over_many_blocks(spark, monkeypatch):
    """Contraction in blocks of three edges keeps all nodes and components, of any type."""
    monkeypatch.setattr("topicloom.llm.contract.BLOCK_EDGES", 3)
    edges = spark.range(500).selectExpr("cast(id as string) AS a", "cast(id - id % 50 + (id + 7) % 50 as string) AS b")
    found = simhash.components(edges.repartition(5)).collect()
    assert {int(r.node) // 50 == int(r.root) // 50 for r in found} == {True}
    assert len(found) == 500 and len({r.root for r in found}) == 10
