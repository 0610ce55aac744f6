import random
from itertools import permutations

import numpy as np
import pytest

from topicloom.llm import filter_audit as fa


def by_hand(rows, labels):
    """The contract, document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    parts = {}
    for key, text, source in rows:
        text = text or ""
        words = text.encode().split()
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows):
            fails.add("E")
        parts.setdefault(source or "", []).append((key, fails))
    answer = []
    for part, docs in parts.items():
        removed_by, own = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(gone)
                own.append((
                    f, "".join(order), step, len(left), len(gone),
                    sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ))
        answer += [(part, *x[1:], removed_by[x[0]]) for x in own]
    return sorted(answer)


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


@pytest.mark.parametrize("per_batch", [10_000, 3])
def test_audit(spark, per_batch):
    rng = random.Random(per_batch)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(rng.choice([20, 5000]))}" for _ in range(rng.choice([5, 199, 200, 600]))]
        text = " ".join(words) + rng.choice(["", "\tABCDE " * 9, " 5$", "é\x1c\x85"])
        rows.append((rng.randrange(40) - 20, text, rng.choice(["hot", "hot", "hot", "cold", None, ""])))
    rows += [(k + 100, t, "hot") for k, t, _ in rows[:20]] + rows[:5]
    rows += [(None, "same", "x"), (None, "same", "x"), (7, "same", "x"), (8, None, None), (9, "", "hot")]
    rows += [(200, "long WORD" * 60_000, "hot"), (201, " ".join(map(str, range(90_000))), "cold")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(-20, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS id", "2 AS part", "3 AS same", "4 AS failed", "5 AS row"
    )
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS bad")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        got = sorted(tuple(r) for r in fa.audit(docs, known).select(*COLUMNS).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_hand(rows, labels)
    assert fa.audit(docs.where("false"), known).collect() == []
    assert len(fa.audit(docs, known.where("false")).collect()) == 120 * 5 * 4


def test_merges_of_sorted_lists():
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 900), (900, 1), (40, 900), (900, 800), (1000, 1000)]:
        a, b = (np.sort(rng.choice(2000, k, replace=False)) for k in (n, m))
        assert np.array_equal(fa.union(a, b), np.union1d(a, b))
        assert np.array_equal(fa.difference(a, b), np.setdiff1d(a, b))
        assert fa.common(a, b) == len(np.intersect1d(a, b))
