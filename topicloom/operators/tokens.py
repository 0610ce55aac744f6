"""Text to cleaned, stemmed tokens.

Every operator here is narrow except the counts over distinct tokens, where nothing of
the size of the corpus is shuffled, and the stem counts of documents, for which texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.functions.stem import stem_box
from topicloom.functions.stopwords import STOP_WORDS
from topicloom.session import broadcast_if_small, keep

# A token whose share of all tokens exceeds 1/MEMO_SHARE is memoised, so the memo
# holds fewer than MEMO_SHARE rows whatever the corpus.
MEMO_SHARE = 4_000_000

# Tokens that a task counts in memory, about; more of them, and its table of counts spills.
TASK_TOKENS = 400_000


def _explode(df: DataFrame, keys: Sequence[str], tokens) -> DataFrame:
    return df.select(*keys, F.explode(tokens).alias("token")).where(F.col("token") != "")


def tokenize(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row ``(*keys, token)`` per ASCII word; a null text has none."""
    return _explode(df, keys, tx.words(F.col(text)))


def tokenize_abbrev(
    df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """As ``tokenize``, with abbreviations such as ``U.S.A.`` kept whole."""
    return _explode(df, keys, tx.words_and_abbreviations(F.col(text)))


def clean_tokens(
    tokens: DataFrame, stop_words: Iterable[str] | DataFrame = STOP_WORDS
) -> DataFrame:
    """Drop tokens over 32 letters, lower-case the rest, drop stop words.

    ``stop_words`` may be a DataFrame with a ``token`` column.
    """
    lowered = tokens.where(tx.token_length_ok(F.col("token"))).withColumn(
        "token", F.lower("token")
    )
    if isinstance(stop_words, DataFrame):
        return lowered.join(stop_words.select("token").distinct(), "token", "left_anti").select(
            *tokens.columns
        )
    return lowered.where(~F.col("token").isin(sorted(stop_words)))


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(token, n)``; counts are combined before the shuffle, so a hot token is one row per task."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def stem_vocabulary(cleaned: DataFrame, variant: str = "default") -> DataFrame:
    """``(token, stem, n)``: every distinct cleaned token, stemmed once."""
    return token_counts(cleaned).select(
        "token", F.explode(stem_box(F.col("token"), variant)).alias("stem"), "n"
    )


def stem_memo(stemmed: DataFrame, share: int = MEMO_SHARE) -> DataFrame:
    """The frequent part of a stem vocabulary; fewer than ``share`` rows by construction."""
    total = stemmed.agg(F.sum("n").cast("decimal(38,0)")).scalar()
    return stemmed.where(F.col("n").cast("decimal(38,0)") * share > total).select("token", "stem")


def preprocess_tokens(cleaned: DataFrame, stemmed: DataFrame | None = None) -> DataFrame:
    """``(*keys, stem)`` for cleaned tokens, keeping stems of 3 to 14 letters.

    The stems of all distinct tokens are broadcast when their counted number allows.
    Beyond that only frequent tokens take their stem from a bounded memo, and the
    rare rest is stemmed in place.  Neither way shuffles the corpus.
    """
    keys = [c for c in cleaned.columns if c != "token"]
    if stemmed is None:
        stemmed = keep(stem_vocabulary(cleaned))
    fitting = stemmed.where(tx.stem_length_ok(F.col("stem"))).select("token", "stem")
    lookup, small = broadcast_if_small(fitting)
    if small:
        return cleaned.join(lookup, "token").select(*keys, "stem")
    lookup.unpersist()
    memo = stem_memo(stemmed).select("token", F.array("stem").alias("memo"))
    box = F.coalesce("memo", stem_box(F.col("token")))
    return (
        cleaned.join(F.broadcast(memo), "token", "left")
        .select(*keys, F.explode(box).alias("stem"))
        .where(tx.stem_length_ok(F.col("stem")))
    )


def stem_counts(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``(*keys, stem, n)``: how often each document has each stem of 3 to 14 letters.

    The texts of a key meet in one task before they are taken apart, so that their counts
    need no further shuffle, in as many tasks as the tokens ask for: each has about
    ``TASK_TOKENS`` whatever the corpus.  A key with more is counted by one task, which spills.
    """
    stemmed = keep(stem_vocabulary(clean_tokens(tokenize(docs, keys, text))))
    tokens = stemmed.agg(F.sum("n")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    together = docs.select(*keys, text).repartition(parts, *keys)
    found = preprocess_tokens(clean_tokens(tokenize(together, keys, text)), stemmed)
    return found.groupBy(*keys, "stem").agg(F.count("*").alias("n"))
