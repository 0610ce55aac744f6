"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    ann, cover_tree, decontaminate, filter_audit, packing, phrases, quotes, simhash, spelling, sql,
    token_count, toxicity, url_filter, warc_derive,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("id"))
    return ann.search_rows(ann.build(vectors), asked, k=20)


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.token_counts(table(spark, sf_dir, "documents"), path)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as responses, and their derivatives without the blocks' contents."""
    responses = table(spark, sf_dir, "pages").select(
        warc_derive.urn(F.concat(F.lit("page-"), F.col("page_id").cast("string"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n").alias("http"), "html",
        F.create_map(
            F.lit("WARC-Type"), F.lit("response"),
            F.lit("WARC-Payload-Digest"), F.concat(F.lit("md5:"), F.md5(F.col("html").cast("binary"))),
        ).alias("headers"),
    )
    return warc_derive.derive(responses, "headers").drop("source_id", "date", "block")


#: Words of a line of a quote.
WRAP = 9


def quoting(messages: DataFrame) -> DataFrame:
    """Every message with the one before it quoted, and the one before that quoted twice; the
    quotes are wrapped anew."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")

    def quoted(back, mark):
        line = lambda i: F.concat(F.lit(mark), F.array_join(F.slice("words", i, WRAP), " "), F.lit("\n"))
        lines = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(WRAP)), line)
        return texts.withColumn("words", words).where(F.size("words") > 0).select(
            "conv_id", (F.col("turn") + back).alias("turn"), F.array_join(lines, "").alias(f"quote{back}")
        )

    joined = messages.select("conv_id", "turn", "text")
    for back, mark in ((1, "> "), (2, ">> ")):
        joined = joined.join(quoted(back, mark), ["conv_id", "turn"], "left")
    parts = [F.coalesce(c, F.lit("")) for c in ("quote2", "quote1", "text")]
    return joined.select("conv_id", "turn", F.concat(*parts).alias("text"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that quote their predecessors, made of the conversations and taken apart again."""
    found = quotes.reply_order(quoting(table(spark, sf_dir, "conversations")))
    return found.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        pieces = packing.pack(table(spark, sf_dir, "documents"), file.read())
    return pieces.drop("ids")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_url_filter": op2_url_filter,
        "op3_token_counts": op3_token_counts,
        "op4_warc_derivatives": op4_warc_derivatives,
        "op5_quotes": op5_quotes,
        "op6_phrases": op6_phrases,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
        "op11_cover_tree": op11_cover_tree,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": sql.OP2, "op4_warc_derivatives": sql.OP4, "op5_quotes": sql.OP5, "op6_phrases": sql.OP6,
        "op10_decontaminate": sql.OP10, "op11_cover_tree": sql.OP11, "op13_filter_audit": sql.OP13,
    }
