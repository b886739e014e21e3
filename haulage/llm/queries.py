"""The operators as queries over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import (
    conversation_repair, decontaminate, language_id, lexical_search, line_dedup, mixing, near_dedup,
    quality, sharding, substring_dedup, tokens, toxicity, warc,
)
from haulage.llm.common import documents, whole
from haulage.llm.oracles import ORACLE_SQL  # noqa: F401
from haulage.session import written

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that ten sources or more share are taken out of every document."""
    docs = documents(spark, folder).select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.encode("clean_text", "UTF-8"), 256).alias("clean_sha256")
    )


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget are not kept."""
    docs = documents(spark, folder).select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.find_items(docs, items)
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_items"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"),
        (F.size("hits") == 0).alias("kept"),
    )


@query
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder), size=4)


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return warc.derivatives(warc.responses(pages))


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    facts = docs.select(
        "doc_id", "text",
        (F.octet_length(whole()) + 1).cast("long").alias("size"),
        F.crc32(whole()).alias("text_crc32"),
    )
    return sharding.shard(facts).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * F.col("repeats")).alias("taken"),
    )


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_stop_words",
    )


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder).select("doc_id", "text"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(docs, labels).select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    return language_id.language_id(docs).select(
        "doc_id", (~language_id.learnable()).alias("held_out"), "lang_pred", "score"
    )


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are damaged and repaired; those that lost all rows are in the result."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    damaged = conversation_repair.damage(rows)
    plans = written(conversation_repair.plans(damaged), "repair-plans")
    digests = conversation_repair.digests(conversation_repair.repaired(damaged, plans))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    planned = ids.join(plans, F.expr("id <=> conv_id"), "left").select(
        "id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )
    return planned.join(digests, F.expr("id <=> conv_id"), "left").select(
        F.col("id").alias("conv_id"), *counts, "audit",
        F.coalesce("repaired_sha256", F.lit(conversation_repair.EMPTY_DIGEST)).alias("repaired_sha256"),
    )


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return lexical_search.search(docs, items)
