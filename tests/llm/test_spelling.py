import collections
import random
import re
import zlib

import pytest

from topicloom.llm import queries, spelling


def by_hand(rows):
    """The contract, word against word."""
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holes = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + "?" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = {w: set() for w in counts}
    for hole, words in holes.items():
        for a in words:
            for b in words:
                together = len(a) == len(b) and "?" in hole or abs(len(a) - len(b)) == 1 and hole in (a, b)
                if a != b and together:
                    near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    answer = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        answer.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(answer)


def of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    got = of(queries.op12_spelling_variants(spark, sf_dir))
    assert got == by_hand(rows) and any(form for _, form, *_ in got)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_dense_words_over_many_ranges(spark, parts):
    """A small alphabet, doubled letters and nested prefixes, ranges cut anywhere."""
    rng = random.Random(parts)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(6, 9))) for _ in range(400)}
    words |= {"a" * n for n in range(6, 30)} | {"zeroes" + "b" * n for n in range(9)}
    rows = []
    for i, w in enumerate(sorted(words)):
        rows += [(i, " ".join([w.upper() if "ÿ" not in w else w] * rng.choice([5, 6, 30, 200])))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    long = "q" * 30_000
    rows = [
        (1, None), (None, "letters Letters"), (2, ""), (3, "letters letterz letters; letter's lettersé"),
        (3, "letters letterz letters; letter's lettersé"), (4, "éééééé×÷ éééééé×÷ " * 3),
    ] + [(5, f"{long} {long}r")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "4 AS part")
    got = of(spelling.variants(docs))
    assert got == by_hand(rows) and len(got) >= 4
    assert spelling.variants(docs.where("false")).collect() == []


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(500)})
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word", "nodes").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    number = {}
    for r in rows:
        for depth, node in enumerate(r.nodes):
            assert number.setdefault(r.word[:depth], node) == node
    assert len(set(number.values())) == len(number)
    assert [r.word for r in sorted(rows, key=lambda r: r.place)] == words
