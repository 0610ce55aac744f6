import pytest

from queries_support import write_pages_as_warc
from topicloom.operators.lda.sampler import fit_sampler
from topicloom.plans.run import RunConfig, run
from topicloom.sources.model_file import import_model, model_probs


@pytest.fixture(scope="module")
def archive(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "files")
    write_pages_as_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return path


@pytest.mark.parametrize("algorithm", ["mh", "naive", "sparkem", "sparkonline", "em", "online"])
def test_archive_to_topics(spark, archive, tmp_path, algorithm):
    config = RunConfig(
        archive, algorithm, str(tmp_path / "words"), str(tmp_path / "vectors"),
        str(tmp_path / "model"), iterations=3, partitions=4, force_repartition=True,
        test_fraction=0.2, subsample=0.9, k=4, vocab_size=300,
    )
    first = run(spark, config)
    assert 0 < first.documents <= 50 and first.vocab_size == 300
    topics = first.topics.collect()
    assert {(r.topic, r["rank"]) for r in topics} == {(t, n) for t in range(4) for n in range(1, 51)}
    assert all(r.term for r in topics)
    assert first.metrics["test_perplexity"] > 1 and first.metrics["test_tokens"] > 0
    assert ("train_perplexity" in first.metrics) == (algorithm in ("sparkem", "em"))
    model = import_model(spark, config.final_path, check=True)
    assert model_probs(model).count() == 300 * 4
    # The second run must not need the archive.
    again = run(spark, RunConfig(**{**config.__dict__, "dataset": "/nowhere"}))
    assert (again.documents, again.train_tokens) == (first.documents, first.train_tokens)
    if algorithm in ("mh", "naive"):
        assert sorted(again.probs.collect()) == sorted(first.probs.collect())


def test_model_file_format(spark, tmp_path):
    (tmp_path / "m.txt").write_text("0 0.001 0.25\n1 0.500   0.5\n 2 0.499 0.25 \n\n")
    rows = sorted(import_model(spark, str(tmp_path / "m.txt"), check=True).collect())
    assert [tuple(r) for r in rows] == [(0, [0.001, 0.25]), (1, [0.5, 0.5]), (2, [0.499, 0.25])]
    (tmp_path / "bad.txt").write_text("0 0.1\n1 0.2\n")
    with pytest.raises(ValueError):
        import_model(spark, str(tmp_path / "bad.txt"), check=True)


@pytest.mark.parametrize(
    "bad",
    [
        {"algorithm": "x"}, {"alpha": 0.0}, {"beta": -1}, {"mh_steps": 0}, {"subsample": 1.1},
        {"test_fraction": -0.1}, {"checkpoint_every": 0},
    ],
)
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        RunConfig("x", **bad)


def test_defaults():
    c = RunConfig("x")
    assert (c.algorithm, c.iterations, c.k, c.vocab_size, c.partitions) == ("mh", 100, 30, 60000, 336)
    assert (c.alpha, c.beta, c.mh_steps, c.seed, c.checkpoint_every) == (0.5, 0.01, 2, 42, 1)


def test_tables_of_different_runs_are_refused(spark, sf_dir, tmp_path):
    """Vectors know their dictionary; a resumed training knows its documents."""
    from topicloom.plans.corpus import load_corpus
    from topicloom.sources.manifest import digest, read_manifest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words, vectors, other = (str(tmp_path / n) for n in ("words", "vectors", "other"))
    first = load_corpus(spark, lambda: docs, 300, words, vectors)
    assert read_manifest(spark, vectors)["dictionary"] == digest(first.dictionary, ["term", "term_id"])
    load_corpus(spark, None, 200, words, vectors)
    load_corpus(spark, lambda: docs.where("doc_id % 2 = 0"), 300, other)
    with pytest.raises(ValueError, match="another dictionary"):
        load_corpus(spark, None, 300, other, vectors)

    rows = first.vectors
    assert digest(rows.repartition(7), rows.columns) == digest(rows, rows.columns)
    assert digest(rows.limit(5).unionByName(rows.limit(5)), rows.columns) != digest(rows.limit(5), rows.columns)
    saved = str(tmp_path / "saved")
    fit_sampler(rows, 300, "mh", 3, 1, checkpoint_save=saved)
    fit_sampler(rows.repartition(3), 300, "mh", 3, 2, checkpoint_read=saved)
    with pytest.raises(ValueError, match="corpus"):
        fit_sampler(rows.where("doc_id % 2 = 0"), 300, "mh", 3, 2, checkpoint_read=saved)
