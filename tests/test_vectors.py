from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.arrays import run_lengths
from topicloom.operators import partitioning as pt
from topicloom.operators import sampling as sm
from topicloom.operators import tokens as tk
from topicloom.operators import vectorize as vz
from topicloom.operators.topk import top_k
from topicloom.operators.vocabulary import term_counts, vocabulary
from topicloom.session import cut_lineage, path_exists, scratch_path, table_complete
from topicloom.plans.corpus import load_corpus
from topicloom.sources import dictionary as dc
from topicloom.sources.reuse import load_or_build, load_or_fit_dictionary


@pytest.fixture(scope="module")
def prepared(documents):
    cleaned = tk.clean_tokens(tk.tokenize(documents))
    stemmed = tk.stem_vocabulary(cleaned).cache()
    return cleaned, stemmed, vocabulary(term_counts(stemmed), 500).cache()


def brute_top(counts, size):
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return [(t, i, n) for i, (t, n) in enumerate(ranked)]


@pytest.mark.parametrize("size", [1, 7, 40, 300, 10_000])
def test_vocabulary_equals_full_sort(spark, size):
    rng = np.random.default_rng(size)
    counts = {f"t{i}": int(rng.zipf(1.3)) for i in range(900)}
    counts["t900"] = 2**45
    df = spark.createDataFrame(list(counts.items()), "term string, freq long")
    got = [tuple(r) for r in vocabulary(df, size).orderBy("term_id").collect()]
    assert got == brute_top(counts, size)


def test_vocabulary_of_documents(prepared):
    cleaned, stemmed, dictionary = prepared
    counts = Counter()
    for r in stemmed.collect():
        if 3 <= len(r.stem) <= 14:
            counts[r.stem] += r.n
    assert [tuple(r) for r in dictionary.orderBy("term_id").collect()] == brute_top(counts, 500)


def test_vectors_equal_brute_force(prepared):
    cleaned, stemmed, dictionary = prepared
    stem = {r.token: r.stem for r in stemmed.collect()}
    ids = {r.term: r.term_id for r in dictionary.collect()}
    want = Counter()
    for r in cleaned.collect():
        if stem[r.token] in ids:
            want[r.doc_id, ids[stem[r.token]]] += 1
    attached = vz.attach_terms(cleaned, stemmed, dictionary)
    long = {(r.doc_id, r.term_id): r.tf for r in vz.doc_term_freq(attached).collect()}
    vectors = vz.doc_vectors(attached)
    again = {(r.doc_id, r.term_id): r.tf for r in vz.long_form(vectors).collect()}
    assert long == dict(want) and again == dict(want)
    for r in vectors.collect():
        assert r.term_ids == sorted(set(r.term_ids))


def test_too_large_index_takes_the_other_way(prepared, monkeypatch):
    cleaned, stemmed, dictionary = prepared
    usual = vz.doc_term_freq(vz.attach_terms(cleaned, stemmed, dictionary))
    real = vz.broadcast_if_small
    monkeypatch.setattr(vz, "broadcast_if_small", lambda df: real(df, 10))
    other = vz.doc_term_freq(vz.attach_terms(cleaned, stemmed, dictionary))
    assert sorted(other.collect()) == sorted(usual.collect())


def test_run_lengths(spark):
    df = spark.createDataFrame([([],), ([3],), ([1, 1, 2, 5, 5, 5],)], "a array<int>")
    rows = df.select(run_lengths(F.col("a"), "v", "c").alias("r")).collect()
    assert [(r.r.v, r.r.c) for r in rows] == [([], []), ([3], [1]), ([1, 2, 5], [2, 1, 3])]


def test_corpus_is_shuffled_once(prepared):
    cleaned, stemmed, dictionary = prepared
    vectors = vz.doc_vectors(vz.attach_terms(cleaned, stemmed, dictionary))
    plan = vectors._jdf.queryExecution().sparkPlan().toString()
    executed = vectors._jdf.queryExecution().executedPlan().toString()
    outer = executed.split("InMemoryTableScan")[0]
    assert "collect_list" in plan and outer.count("Exchange hashpartitioning") == 1


def test_ml_vectors(spark, prepared, tmp_path):
    vectors = vz.doc_vectors(vz.attach_terms(*prepared))
    features = vz.ml_vectors(vectors, 500, str(tmp_path / "ml"))
    want = {r.doc_id: dict(zip(r.term_ids, r.tfs, strict=True)) for r in vectors.collect()}
    for r in features.collect():
        got = dict(zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True))
        assert r.features.size == 500 and got == want[r.doc_id]


def test_sampling_ignores_partitioning(documents):
    a = sm.subsample(documents, 0.5).select("doc_id").collect()
    b = sm.subsample(documents.repartition(7), 0.5).select("doc_id").collect()
    assert sorted(a) == sorted(b) and 60 < len(a) < 140
    assert sm.subsample(documents, 1.0).count() == documents.count()
    assert sm.subsample(documents, 0.0).count() == 0
    assert sorted(sm.subsample(documents, 0.5, 7).select("doc_id").collect()) != sorted(a)
    with pytest.raises(ValueError):
        sm.subsample(documents, 1.5)


def test_split_is_disjoint_and_complete(documents):
    train, test = sm.train_test_split(documents, 0.3)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in (train, test)]
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == documents.count()
    assert sm.train_test_split(documents, 0.0)[1].count() == 0


@pytest.mark.parametrize("partitions", [None, 5])
def test_doc_index_of_strings(spark, partitions):
    names = [f"k{i * 7919 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "doc_id string").repartition(6)
    got = {r.doc_id: r.idx for r in pt.doc_index(df, partitions=partitions).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


@pytest.mark.parametrize("size, block", [(10, 3), (9, 3), (1, 1000), (1001, 1000), (7, 10)])
@pytest.mark.parametrize("bounded", [True, False])
def test_term_blocks(spark, size, block, bounded):
    splits = pt.block_count(size, block, bounded)
    cuts = [-(-i * size // splits) for i in range(splits + 1)]
    ids = spark.range(size).select((F.col("id") + 5).cast("int").alias("id"))
    got = {r.id: r.b for r in ids.select("id", pt.term_block(F.col("id"), size, block, bounded, 5).alias("b")).collect()}
    assert got == {5 + x: i for i in range(splits) for x in range(cuts[i], cuts[i + 1])}
    if bounded:
        assert max(Counter(got.values()).values()) <= block


def test_top_k_cuts_groups_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), "id")
    best = top_k(df, ["g"], [F.desc("id")], 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.id)
    want = {(g, n + 1, i) for g, v in rows.items() for n, i in enumerate(sorted(v)[::-1][:2])}
    assert {(r.g, r["rank"], r.id) for r in best.collect()} == want


def test_dictionary_files(spark, prepared, tmp_path):
    dictionary, path = prepared[2], str(tmp_path / "d")
    dc.write_dictionary(dictionary, path)
    whole = sorted(dictionary.collect())
    assert sorted(dc.read_dictionary(spark, path).collect()) == whole
    terms = dc.read_terms(spark, f"{path}/terms", 10).collect()
    assert sorted(r.term_id for r in terms) == list(range(10))
    assert {(r.term, r.term_id) for r in terms} == {(r.term, r.term_id) for r in whole if r.term_id < 10}
    (tmp_path / "plain.txt").write_text("b\na\nc\n")
    plain = dc.read_dictionary(spark, str(tmp_path / "plain.txt"), 2).collect()
    assert sorted((r.term_id, r.term) for r in plain) == [(0, "b"), (1, "a")]


def test_reuse(spark, prepared, tmp_path):
    dictionary, path, calls = prepared[2], str(tmp_path / "d"), []

    def fit():
        calls.append(1)
        return dictionary

    for _ in range(2):
        assert load_or_fit_dictionary(spark, path, fit).count() == 500
        assert load_or_build(spark, f"{path}-t", fit).count() == 500
    assert len(calls) == 2
    load_or_build(spark, "", fit)
    load_or_fit_dictionary(spark, None, fit)
    assert len(calls) == 4
    half = tmp_path / "half"
    half.mkdir()
    assert path_exists(spark, str(half)) and not table_complete(spark, str(half))
    assert not path_exists(spark, "") and not path_exists(spark, str(tmp_path / "none"))


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert cut_lineage(spark.range(3)).count() == 3


def test_saved_tables_of_more_terms_are_narrowed(spark, tmp_path):
    words, docs = str(tmp_path / "w"), str(tmp_path / "v")
    terms = spark.createDataFrame([(f"t{i}", i, 9 - i) for i in range(5)], "term string, term_id int, freq long")
    dc.write_dictionary(terms, words)
    rows = [(1, [0, 3], [2, 1]), (2, [4], [7])]
    spark.createDataFrame(rows, "doc_id long, term_ids array<int>, tfs array<int>").write.parquet(docs)
    corpus = load_corpus(spark, None, 3, words, docs)
    assert corpus.dictionary.count() == 3
    assert [tuple(r) for r in corpus.vectors.collect()] == [(1, [0], [2])]


def test_incomplete_dictionaries(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert not dc.dictionary_complete(spark, str(tmp_path / "empty"))
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / f"{name}.txt").write_text("x\ny\n")
    with pytest.raises(ValueError):
        dc.read_terms(spark, str(tmp_path / "two"))


def test_broadcasts_are_bounded_by_bytes(spark):
    from topicloom.session import broadcast_if_small, row_bytes

    frame = spark.range(100)
    assert row_bytes(frame) == 48
    assert broadcast_if_small(frame, 4800)[1] and not broadcast_if_small(frame, 4799)[1]
    assert not broadcast_if_small(frame, 4800, width=1000)[1]
