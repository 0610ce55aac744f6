
from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle  # noqa: E402
import queries_support as q  # noqa: E402
from topicloom.operators import model as md  # noqa: E402
from topicloom.operators import pages as pg  # noqa: E402
from topicloom.operators import partitioning as pt  # noqa: E402
from topicloom.operators import sampling as sm  # noqa: E402
from topicloom.operators import tokens as tk  # noqa: E402
from topicloom.operators import vectorize as vz  # noqa: E402
from topicloom.operators.lda import declarative, em, mllib, online, sampler  # noqa: E402
from topicloom.operators.lda import state as st  # noqa: E402
from topicloom.operators.lda.kernel import md5_uniforms  # noqa: E402
from topicloom.operators.topk import top_k  # noqa: E402
from topicloom.operators.vocabulary import term_counts  # noqa: E402
from topicloom.plans.corpus import load_corpus  # noqa: E402
from topicloom.session import scratch_path  # noqa: E402
from topicloom.sources import dictionary as dc  # noqa: E402
from topicloom.sources import model_file as mf  # noqa: E402
from topicloom.sources import warc  # noqa: E402
from topicloom.sources.reuse import load_or_build, load_or_fit_dictionary  # noqa: E402

try:  # these two may be taken out of the repository together, or lack a library
    import corpus_pipeline
    from topicloom.llm import queries as llm
except ImportError:
    llm = None

ITERATIONS = 5
ML_ITERATIONS = 10
SEED = 42
FOLD_IN_ROUNDS = 3
SMALLER = 300


def entry(spark: SparkSession) -> DataFrame:
    """The vocabulary of the smallest document set."""
    return q.dictionary(spark, "/root/testdata/sf0.001")


def _n(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


def _warc_path(spark, sf):
    path = scratch_path(spark, "warc")
    q.write_pages_as_warc(q.pages(spark, sf), path)
    return path


def _record_summary(records):
    return records.select(
        F.coalesce("trec_id", "record_id").cast("long").alias("page_id"),
        "warc_type",
        F.length(F.col("payload").cast("string")).alias("html_chars"),
    )


def warc_records(spark, sf):
    return _record_summary(warc.read_warc(spark, _warc_path(spark, sf)))


def warc_records_hadoop(spark, sf):
    return _record_summary(warc.warc_from_hadoop(spark, _warc_path(spark, sf)))


def response_pages(spark, sf):
    pages = pg.response_pages(warc.read_warc(spark, _warc_path(spark, sf), "response"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html")


def page_text(spark, sf):
    return pg.page_text(q.pages(spark, sf)).select("page_id", "text")


def stem_vocabulary(spark, sf):
    return tk.stem_vocabulary(q.cleaned(spark, sf))


def dictionary_roundtrip(spark, sf):
    path = scratch_path(spark, "dictionary")
    dc.write_dictionary(q.dictionary(spark, sf), path)
    return dc.read_terms(spark, f"{path}/terms")


def vectors_roundtrip(spark, sf):
    path = scratch_path(spark, "vectors")
    q.vectors(spark, sf).write.parquet(path)
    return vz.long_form(spark.read.parquet(path))


def reuse_or_build(spark, sf):
    """Build both tables, then load them: the builders of the second call must not run."""
    words, docs = scratch_path(spark, "dictionary"), scratch_path(spark, "vectors")
    load_or_fit_dictionary(spark, words, lambda: q.known_terms(spark, sf)[0])
    load_or_build(spark, docs, lambda: q.vectors(spark, sf))

    def never():
        raise AssertionError("the table is complete and must be read")

    known = load_or_fit_dictionary(spark, words, never).select("term_id")
    loaded = load_or_build(spark, docs, never)
    return vz.long_form(loaded).join(known, "term_id").select("doc_id", "term_id", "tf")


def ml_vectors(spark, sf):
    features = vz.ml_vectors(q.vectors(spark, sf), q.VOCAB_SIZE, scratch_path(spark, "features"))
    plain = features.select("doc_id", F.unwrap_udt("features").alias("f"))
    pairs = plain.select("doc_id", F.inline(F.arrays_zip("f.indices", "f.values")))
    return pairs.select(
        "doc_id", F.col("indices").alias("term_id"), F.col("values").cast("int").alias("tf")
    )


def corpus_size(spark, sf):
    return vz.corpus_size(sm.subsample(q.vectors(spark, sf), 0.8, SEED))


def token_totals(spark, sf):
    return vz.token_totals(sm.with_split(q.vectors(spark, sf), 0.2, SEED))


def train_test_split(spark, sf):
    train, test = sm.train_test_split(q.table(spark, sf, "documents").select("doc_id"), 0.2, SEED)
    return train.withColumn("split", F.lit("train")).union(
        test.withColumn("split", F.lit("test"))
    )


def force_repartition(spark, sf):
    return vz.long_form(pt.repartition_documents(q.vectors(spark, sf), 16))


def term_blocks(spark, sf):
    dictionary, size = q.known_terms(spark, sf)
    return dictionary.select("term_id", pt.term_block(F.col("term_id"), size, 300).alias("block"))


def word_topic_counts(spark, sf):
    return st.word_topic_counts(q.assigned(spark, sf))


def topic_totals(spark, sf):
    return st.topic_totals(word_topic_counts(spark, sf))


def _probs(spark, sf):
    counts, (dictionary, width) = word_topic_counts(spark, sf), q.known_terms(spark, sf)
    return md.topic_word_probs(counts, st.topic_totals(counts), dictionary, q.K, width, q.BETA)


def _rounded(df):
    return df.withColumn("prob", F.round("prob", 9))


def topic_word_probs(spark, sf):
    return _rounded(_probs(spark, sf))


def model_export(spark, sf):
    """Reads the exported lines field by field."""
    path = scratch_path(spark, "model")
    mf.export_model(_probs(spark, sf), path)
    fields = spark.read.text(path).select(F.split("value", " ").alias("f"))
    cells = fields.select(F.col("f")[0].cast("int").alias("term_id"), F.posexplode("f"))
    return cells.where("pos > 0").select(
        "term_id", (F.col("pos") - 1).alias("topic"), F.round(F.col("col").cast("double"), 9).alias("prob")
    )


def model_import(spark, sf):
    path = scratch_path(spark, "model")
    mf.export_model(_probs(spark, sf), path)
    return _rounded(mf.model_probs(mf.import_model(spark, path, check=True)))


def doc_topics(spark, sf):
    return _rounded(md.doc_topics(q.assigned(spark, sf), q.K, q.ALPHA))


def describe_topics(spark, sf):
    described = md.describe_topics(_probs(spark, sf), q.known_terms(spark, sf)[0], 50)
    return _rounded(described.drop("term_id"))


def top_k_per_group(spark, sf):
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    best = top_k(q.table(spark, sf, "orders"), ["o_custkey"], order, 3, "rnk")
    return best.select("o_custkey", "o_orderkey", "rnk")


def heldout_perplexity(spark, sf):
    theta = md.theta(q.assigned(spark, sf), q.K, q.ALPHA)
    phi = md.phi_rows(_probs(spark, sf))
    scored = md.perplexity(md.log_likelihood(q.vectors(spark, sf), theta, phi))
    return scored.select(F.round("perplexity", 6).alias("perplexity"))


def gibbs_sweep(spark, sf):
    width = q.known_terms(spark, sf)[1]
    swept = declarative.gibbs_sweep(
        q.assigned(spark, sf), q.K, width, q.ALPHA, q.BETA, SEED, 0
    )
    return swept.groupBy("term_id", "topic").agg(F.count("*").alias("n"))


def _below_start(vectors, width, before, after):
    """Whether training lowered the perplexity of the documents, folded in, by a hundredth."""
    start, end = (md.heldout_perplexity(vectors, p, q.K, width, q.ALPHA, 20) for p in (before, after))
    return end < 0.99 * start


def lda_mh(spark, sf):
    """Every token keeps its term, and the model explains the documents better than at the start."""
    (dictionary, width), vectors = q.known_terms(spark, sf), q.vectors(spark, sf)

    def trained(iterations):
        model = sampler.fit_sampler(vectors, width, "mh", q.K, iterations)
        probs = md.topic_word_probs(model.word_topic, model.totals, dictionary, q.K, width, q.BETA)
        return model, probs

    (_, before), (model, after) = trained(0), trained(ITERATIONS)
    better = _below_start(vectors, width, before, after)
    return model.word_topic.groupBy("term_id").agg(F.sum("n").alias("n"), F.lit(better).alias("better"))


def lda_gibbs(spark, sf):
    """Two sweeps with counts refreshed between them, drawn by a uniform that SQL computes."""
    width, vectors = q.known_terms(spark, sf)[1], q.vectors(spark, sf)
    begin = q.assigned(spark, sf).withColumn("doc_key", F.col("doc_id").cast("long"))
    model = sampler.fit_sampler(
        vectors, width, "naive", q.K, 2, q.ALPHA, q.BETA, SEED, begin=begin, groups=1, uniform=md5_uniforms
    )
    return model.word_topic


def lda_gibbs_joined(spark, sf):
    """The same where documents meet the counts that they use, part by part."""
    width, vectors = q.known_terms(spark, sf)[1], q.vectors(spark, sf)
    begin = q.assigned(spark, sf).withColumn("doc_key", F.col("doc_id").cast("long"))
    model = sampler.fit_sampler(
        vectors, width, "naive", q.K, 2, q.ALPHA, q.BETA, SEED, begin=begin, groups=1,
        uniform=md5_uniforms, model_bytes=0,
    )
    return model.word_topic


def _em(spark, sf):
    """Two iterations of expectation maximisation from the deterministic state."""
    width, vectors = q.known_terms(spark, sf)[1], q.vectors(spark, sf)
    state = q.assigned(spark, sf, "term_ids", "tfs")
    counts = F.transform(st.topic_counts(F.col("z"), q.K), lambda n: n.cast("double"))
    begin = state.select("doc_id", "doc_key", "term_ids", "tfs", counts.alias("shares"))
    return em.fit_em(
        vectors, width, q.K, 2, q.ALPHA + 1, q.BETA + 1, begin=(begin, st.word_topic_counts(state))
    )


def lda_em(spark, sf):
    """Expected counts of each term and topic."""
    return _em(spark, sf).word_topic.select("term_id", "topic", F.round("n", 6).alias("n"))


def train_perplexity(spark, sf):
    """Of the training tokens, under the model before the last step."""
    model = _em(spark, sf)
    value = round(math.exp(-model.likelihood / model.tokens), 6)
    return spark.createDataFrame([(model.tokens, value)], "tokens long, perplexity double")


def _ml_topics(spark, sf, method):
    """Topics of a Spark ML model as the engine's own: terms, total, and whether it is better
    than a model with one topic for all."""
    (dictionary, width), vectors = q.known_terms(spark, sf), q.vectors(spark, sf)
    probs = mllib.model_from_ml(mllib.fit_ml(vectors, width, method, q.K, ML_ITERATIONS))
    flat = dictionary.select("term_id", F.explode(F.sequence(F.lit(0), F.lit(q.K - 1))).alias("topic"))
    better = _below_start(vectors, width, flat.withColumn("prob", F.lit(1.0 / width)), probs)
    return probs.groupBy("topic").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("prob"), 6).alias("total"), F.lit(better).alias("better")
    )


def model_from_ml(spark, sf):
    return _ml_topics(spark, sf, "sparkem")


def lda_online(spark, sf):
    return _ml_topics(spark, sf, "sparkonline")


def online_steps(spark, sf):
    """Two steps of online variational Bayes over all documents, from lambdas that SQL computes."""
    (dictionary, width), vectors = q.known_terms(spark, sf), q.vectors(spark, sf)
    begin = dictionary.select("term_id", F.transform(
        F.sequence(F.lit(0), F.lit(q.K - 1)), lambda t: F.lit(1.0) + F.pmod(F.col("term_id") + t, F.lit(q.K)) / 10.0
    ).alias("lambdas"))
    model = online.fit_online(
        vectors, width, q.K, 2, q.ALPHA, q.BETA, SEED, fraction=1.0, tau=1.0, kappa=0.5, rounds=3,
        enough=0.0, begin=begin,
    )
    told = model.lambdas.select("term_id", F.posexplode("lambdas").alias("topic", "x"))
    return told.select("term_id", "topic", F.round("x", 6).alias("x"))


def heldout_left_to_right(spark, sf):
    """Perplexity of tokens predicted from those before them, by two particles whose uniforms
    SQL computes."""
    width = q.known_terms(spark, sf)[1]
    scored = md.left_to_right_likelihood(
        q.vectors(spark, sf), _probs(spark, sf), q.K, width, q.ALPHA, particles=2, moves=0,
        seed=SEED, uniform=md5_uniforms, doc_key=F.col("doc_id").cast("long"),
    )
    return md.perplexity(scored).select(F.round("perplexity", 6).alias("perplexity"))


def checkpoint_resume(spark, sf):
    """Four sweeps, and two more from a checkpoint of two, term by term."""
    saved, width = scratch_path(spark, "saved"), q.known_terms(spark, sf)[1]
    vectors = q.vectors(spark, sf)
    sampler.fit_sampler(vectors, width, "mh", q.K, 2, checkpoint_save=saved)
    resumed = sampler.fit_sampler(vectors, width, "mh", q.K, 4, checkpoint_read=saved).word_topic
    whole = sampler.fit_sampler(vectors, width, "mh", q.K, 4).word_topic
    both = whole.join(resumed.withColumnRenamed("n", "again"), ["term_id", "topic"], "full")
    n, again = (F.coalesce(c, F.lit(0)) for c in ("n", "again"))
    return both.groupBy("term_id").agg(F.sum(n).alias("n"), F.sum(F.abs(n - again)).alias("gap"))


def heldout_fold_in(spark, sf):
    """Perplexity of documents folded into the model of the deterministic state."""
    width = q.known_terms(spark, sf)[1]
    scored = md.heldout_likelihood(
        q.vectors(spark, sf), _probs(spark, sf), q.K, width, q.ALPHA, FOLD_IN_ROUNDS
    )
    return md.perplexity(scored).select(F.round("perplexity", 6).alias("perplexity"))


def heldout_fold_in_joined(spark, sf):
    """The same by the way that models too large to broadcast take."""
    width = q.known_terms(spark, sf)[1]
    scored = md.heldout_likelihood(
        q.vectors(spark, sf), _probs(spark, sf), q.K, width, q.ALPHA, FOLD_IN_ROUNDS, budget=0
    )
    return md.perplexity(scored).select(F.round("perplexity", 6).alias("perplexity"))


def reuse_smaller_vocabulary(spark, sf):
    """Both tables saved, then loaded for fewer terms."""
    words, docs = scratch_path(spark, "dictionary"), scratch_path(spark, "vectors")
    dc.write_dictionary(q.dictionary(spark, sf), words)
    q.vectors(spark, sf).write.parquet(docs)

    def never():
        raise AssertionError("the tables are complete and must be read")

    return vz.long_form(load_corpus(spark, never, SMALLER, words, docs).vectors)


def records_without_ids(spark, sf):
    """Responses without ids: each stays a page of its own."""
    path = scratch_path(spark, "warc")
    q.write_pages_as_warc(q.pages(spark, sf), path, with_ids=False)
    pages = pg.response_pages(warc.read_warc(spark, path, "response"))
    return pages.groupBy("html").agg(F.countDistinct("page_id").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    return more | {
        "warc_records": warc_records,
        "warc_records_hadoop": warc_records_hadoop,
        "response_pages": response_pages,
        "page_text": page_text,
        "tokenize": lambda s, d: _n(tk.tokenize(q.documents(s, d))),
        "tokenize_abbrev": lambda s, d: _n(tk.tokenize_abbrev(q.documents(s, d))),
        "clean_tokens": lambda s, d: _n(q.cleaned(s, d)),
        "stem_vocabulary": stem_vocabulary,
        "preprocess_tokens": lambda s, d: tk.stem_counts(q.documents(s, d)),
        "term_counts": lambda s, d: term_counts(stem_vocabulary(s, d)),
        "vocabulary": q.dictionary,
        "dictionary_listing": q.dictionary,
        "dictionary_roundtrip": dictionary_roundtrip,
        "doc_term_freq": lambda s, d: vz.doc_term_freq(q.attached(s, d)),
        "doc_vectors": lambda s, d: vz.long_form(q.vectors(s, d)),
        "vectors_roundtrip": vectors_roundtrip,
        "reuse_or_build": reuse_or_build,
        "ml_vectors": ml_vectors,
        "nonempty_docs": lambda s, d: vz.nonempty_docs(q.vectors(s, d)),
        "corpus_size": corpus_size,
        "token_totals": token_totals,
        "subsample": lambda s, d: sm.subsample(q.table(s, d, "documents"), 0.8, SEED).select("doc_id"),
        "train_test_split": train_test_split,
        "force_repartition": force_repartition,
        "doc_index": lambda s, d: pt.doc_index(q.table(s, d, "documents")),
        "term_blocks": term_blocks,
        "word_topic_counts": word_topic_counts,
        "topic_totals": topic_totals,
        "topic_word_probs": topic_word_probs,
        "model_export": model_export,
        "model_import": model_import,
        "doc_topics": doc_topics,
        "describe_topics": describe_topics,
        "top_k_per_group": top_k_per_group,
        "minibatch_fraction": lambda s, d: mllib.minibatch_fraction(q.vectors(s, d), 100),
        "heldout_perplexity": heldout_perplexity,
        "gibbs_sweep": gibbs_sweep,
        "lda_mh": lda_mh,
        "lda_gibbs": lda_gibbs,
        "lda_gibbs_joined": lda_gibbs_joined,
        "lda_em": lda_em,
        "lda_online": lda_online,
        "online_steps": online_steps,
        "train_perplexity": train_perplexity,
        "model_from_ml": model_from_ml,
        "checkpoint_resume": checkpoint_resume,
        "heldout_fold_in": heldout_fold_in,
        "heldout_fold_in_joined": heldout_fold_in_joined,
        "heldout_left_to_right": heldout_left_to_right,
        "reuse_smaller_vocabulary": reuse_smaller_vocabulary,
        "records_without_ids": records_without_ids,
    }


def oracle_sql() -> dict[str, str]:
    return (llm.oracle_sql() if llm else {}) | oracle.oracle_sql()
