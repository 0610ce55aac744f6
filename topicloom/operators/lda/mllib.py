"""The two LDA trainers that Spark ML ships, under the engine's parameters.

Both keep a terms x topics matrix on the driver; for models beyond
``MAX_DRIVER_CELLS`` use the samplers, whose model stays a table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.vectorize import ml_vectors
from topicloom.session import keep, scratch_path

MAX_DRIVER_CELLS = 200_000_000
PRIOR_OFFSET = 1.0  # EM needs priors above 1; both trainers get the same offset
#: (document, term) pairs of a task of EM, which makes an object of each: some 70 bytes a pair.
EM_TASK_PAIRS = 1_000_000


@dataclass
class MlTopicModel:
    model: LDAModel
    features: DataFrame
    k: int
    vocab_size: int
    beta: float
    train_ms: int


def minibatch_fraction(vectors: DataFrame, iterations: int) -> DataFrame:
    """One row ``(fraction)``: min(1, 2 / iterations + 1 / documents)."""
    value = F.least(F.lit(1.0), F.lit(2.0 / iterations) + F.lit(1.0) / F.count("*"))
    return vectors.agg(value.alias("fraction"))


def fit_ml(
    vectors: DataFrame, vocab_size: int, method: str, k: int = 30, iterations: int = 100,
    alpha: float = 0.5, beta: float = 0.01, seed: int = 42,
    partitions: int | None = None, prior_offset: float = PRIOR_OFFSET, key: str = "doc_id",
    max_cells: int = MAX_DRIVER_CELLS,
) -> MlTopicModel:
    """Train by ``sparkem`` (expectation maximisation) or ``sparkonline`` (online variational).

    ``max_cells`` bounds the terms x topics matrix that these trainers keep on the driver;
    raise it to what the driver's memory holds.
    """
    if method not in ("sparkem", "sparkonline"):
        raise ValueError("method must be 'sparkem' or 'sparkonline'")
    if k < 1 or alpha <= 0 or beta <= 0 or iterations < 1:
        raise ValueError("k, alpha, beta and iterations must be positive")
    if vocab_size * k > max_cells:
        raise ValueError("the driver-side matrix exceeds max_cells; raise it or use a sampler")
    spark = vectors.sparkSession
    if partitions:
        vectors = vectors.repartition(partitions, key)
    features = ml_vectors(vectors, vocab_size, scratch_path(spark, "features"), key)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "ml"))
    began = time.time()
    lda = LDA(
        k=k, maxIter=iterations, seed=seed, featuresCol="features",
        docConcentration=[alpha + prior_offset], topicConcentration=beta + prior_offset,
    )
    if method == "sparkem":
        model = _fit_em(lda.setOptimizer("em"), em_tasks(features, key))
    else:
        features = keep(features)
        rate = minibatch_fraction(features, iterations).first()[0]
        lda = lda.setOptimizer("online").setSubsamplingRate(rate).setOptimizeDocConcentration(False)
        model = lda.fit(features)
    return MlTopicModel(model, features, k, vocab_size, beta, int((time.time() - began) * 1000))


def em_tasks(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """``features`` in partitions of at most ``EM_TASK_PAIRS`` on average.

    Files are read in tasks of so many bytes, of which a sparse vector has few.  Rows are sorted,
    since Spark ML numbers documents by their place and must find the same each time.
    """
    pairs = features.agg(F.sum(F.size(F.unwrap_udt("features")["indices"]))).first()[0] or 0
    parts = -(-pairs // EM_TASK_PAIRS)
    if parts <= features.rdd.getNumPartitions():
        return features
    return features.repartition(parts, key).sortWithinPartitions(key)


def _fit_em(lda: LDA, features: DataFrame) -> LDAModel:
    """What ``lda.fit`` does by Spark's own optimizer, whose steps are called one by one.

    Spark drops the edges of a step before the next one has made its own from them, so each goes
    back to the first through all between, and what it keeps is in memory alone.  Here all steps
    have the same edges; they and the counts of the last step go to disk where memory ends.
    A step drops the graph it began with, which therefore only looks at what is kept.
    """
    lda._transfer_params_to_java()
    spark, estimator = features.sparkSession, lda._java_obj
    jvm = spark._jvm
    level = jvm.org.apache.spark.storage.StorageLevel

    def companion(package, name):
        return getattr(getattr(package, name + "$"), "MODULE$")

    docs = companion(jvm.org.apache.spark.ml.clustering, "LDA").getOldDataset(features._jdf, "features")
    settings = jvm.org.apache.spark.mllib.clustering.LDA().setK(lda.getK()).setSeed(lda.getSeed())
    settings.setDocConcentration(lda.getDocConcentration()[0]).setTopicConcentration(lda.getTopicConcentration())
    settings.setCheckpointInterval(lda.getCheckpointInterval())
    optimizer = estimator.getOldOptimizer()
    optimizer.initialize(docs, settings)

    first = optimizer.graph()
    counts_kind, number = first.vertices().vdTag(), companion(jvm.scala.reflect, "ClassTag").Double()
    edges = companion(jvm.org.apache.spark.graphx, "EdgeRDD").fromEdges(first.edges(), number, counts_kind)
    edges.withTargetStorageLevel(level.MEMORY_AND_DISK()).cache().count()
    edges = edges.withTargetStorageLevel(level.NONE())
    first.edges().unpersist(False)
    same = getattr(companion(jvm.scala, "Predef"), "$conforms")()

    def held(before=None):
        """Keep the counts of the optimizer's graph and show them to it, with the same edges as ever."""
        made = optimizer.graph().vertices()
        counts = made.mapValues(same, counts_kind).withTargetStorageLevel(level.MEMORY_AND_DISK()).cache()
        counts.count()
        for passed in filter(None, (made, before)):
            passed.unpersist(False)
        shown = counts.mapValues(same, counts_kind).withTargetStorageLevel(level.NONE())
        graphs = companion(jvm.org.apache.spark.graphx.impl, "GraphImpl")
        getattr(optimizer, "graph_$eq")(graphs.apply(shown, edges, counts_kind, number))
        return counts

    counts = held()
    seconds = spark.sparkContext._gateway.new_array(jvm.double, lda.getMaxIter())
    for done in range(lda.getMaxIter()):
        began = time.time()
        optimizer.next()
        counts = held(counts)
        seconds[done] = time.time() - began
    trained = optimizer.getLDAModel(seconds)
    model = jvm.org.apache.spark.ml.clustering.DistributedLDAModel(
        estimator.uid(), trained.vocabSize(), trained, spark._jsparkSession, jvm.scala.Option.empty()
    )
    estimator.copyValues(model, getattr(estimator, "copyValues$default$2")()).setParent(estimator)
    return lda._copyValues(lda._create_model(model))


def model_from_ml(fitted: MlTopicModel) -> DataFrame:
    """``(term_id, topic, prob)``: the local model as the engine's own; topics sum to 1.

    The matrix holds expected counts, smoothed here as the samplers' counts are: EM
    leaves a term it has not seen without any weight, which no held-out text survives.
    """
    matrix = fitted.model.topicsMatrix().toArray() + fitted.beta
    matrix = matrix / matrix.sum(axis=0)
    term_id, topic = np.indices(matrix.shape, dtype=np.int32)
    table = pa.table(
        {"term_id": term_id.ravel(), "topic": topic.ravel(), "prob": matrix.ravel()}
    )
    return fitted.features.sparkSession.createDataFrame(table)


def term_weights(fitted: MlTopicModel) -> DataFrame:
    """``(term_id, weight)``: a term's expected count over all topics, as trained."""
    weights = fitted.model.topicsMatrix().toArray().sum(axis=1)
    table = pa.table({"term_id": np.arange(len(weights), dtype=np.int32), "weight": weights})
    return fitted.features.sparkSession.createDataFrame(table)


def train_perplexity(fitted: MlTopicModel) -> dict[str, float]:
    """Tokens, log likelihood and perplexity on the training set."""
    values = F.unwrap_udt("features")["values"]
    per_doc = F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
    tokens = fitted.features.agg(F.sum(per_doc)).first()[0]
    if fitted.model.isDistributed():
        likelihood = fitted.model.trainingLogLikelihood()
    else:
        likelihood = fitted.model.logLikelihood(fitted.features)
    return {
        "train_tokens": float(tokens),
        "train_log_likelihood": likelihood,
        "train_perplexity": float(np.exp(-likelihood / tokens)),
    }
