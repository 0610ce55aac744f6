"""One frozen-count Gibbs sweep as a pure DataFrame query.

It draws from the same conditional as the sampler's kernel with one position
group, and makes the sweep checkable in SQL, given a uniform that SQL can compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import let
from topicloom.operators.lda.state import topic_counts, topic_totals, word_topic_counts
from topicloom.operators.sampling import hash32
from topicloom.session import broadcast_if_small


def _by_topic(counts: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    pairs = F.map_from_entries(F.collect_list(F.struct("topic", "n")))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda t: F.coalesce(F.try_element_at("_n", t), F.lit(0).cast("long")),
    )
    return counts.groupBy(*keys).agg(pairs.alias("_n")).select(*keys, filled.alias(name))


def gibbs_sweep(
    state: DataFrame, k: int, vocab_size: int, alpha: float, beta: float, seed: int, sweep: int
) -> DataFrame:
    """``(doc_id, term_id, pos, topic)`` after one sweep over all tokens of ``state``."""
    word_topic = word_topic_counts(state)
    words = _by_topic(word_topic, ["term_id"], k, "word_topic")
    words, _ = broadcast_if_small(words, width=64 + 8 * k)
    totals = _by_topic(topic_totals(word_topic).withColumn("all", F.lit(1)), ["all"], k, "totals")
    tokens = (
        state.select("doc_id", topic_counts(F.col("z"), k).alias("doc_topic"), "words", "z")
        .select("doc_id", "doc_topic", F.posexplode(F.arrays_zip("words", "z")).alias("pos", "t"))
        .select("doc_id", "pos", "doc_topic", F.col("t.words").alias("term_id"), F.col("t.z").alias("z"))
        .join(words, "term_id")
        .withColumn("totals", totals.select("totals").scalar())
    )
    smoothing = vocab_size * beta

    def weight(n, t):
        own = F.when(t == F.col("z"), 1).otherwise(0)
        word, total = F.get("word_topic", t), F.get("totals", t)
        return (n - own + alpha) * (word - own + beta) / (total - own + smoothing)

    def summed(weights):
        return F.aggregate(weights, F.lit(0.0), lambda total, w: total + w)

    def below(weights, bar):
        """How many of the running sums lie below ``bar``."""
        begin = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))

        def further(seen, w):
            total = seen["total"] + w
            return F.struct(total.alias("total"), (seen["n"] + F.when(total < bar, 1).otherwise(0)).alias("n"))

        return F.aggregate(weights, begin, further, lambda seen: seen["n"])

    u = hash32(F.lit(seed), F.lit(sweep), F.col("doc_id"), F.col("pos")) / F.lit(2.0**32)

    def first_reaching(weights):
        # The bar has the digest in it, which must not be found anew for each topic.
        return F.least(let(u * summed(weights), lambda bar: below(weights, bar)), F.lit(k - 1))

    drawn = let(F.transform("doc_topic", weight), first_reaching)
    return tokens.select("doc_id", "term_id", "pos", drawn.alias("topic"))
