"""Registered queries of the subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railflow.llm import (
    chat, decontaminate, langid, lexical, licenses, lines, ngrams, packing, phrases, pii, quality, reputation, vocabulary, wordpiece,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_distinct(F.transform("licenses", lambda x: x["name"]))
    return found.select("doc.doc_id", F.size(names).cast("bigint").alias("n_licenses"), "licenses")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = wordpiece.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary.byte_bpe())
    return counted.select("doc.doc_id", "n_words", "n_tokens", "n_unknown")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary.word_bpe())


#: Tools of the calls that ``tool_messages`` derives.
TOOLS: chat.Schemas = {
    "search": {
        "limit": {"type": "integer", "required": True, "min": 1, "max": 15},
        "query": {"type": "string", "required": True, "min_length": 1},
    },
    "lookup": {"exact": {"type": "boolean"}, "key": {"type": "string", "required": True, "max_length": 400}},
    "summarize": {"style": {"type": "string", "required": True}, "text": {"type": "string", "required": True}},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as calls and results: a user's turn calls a tool with its whole text, the assistant's next
    turn is the result. Tool and arguments follow from the text's length; in one conversation of seven the
    calls are logged two turns late."""
    size, user, assistant = F.length("text"), F.col("role") == "user", F.col("role") == "assistant"
    style = F.when(size % 8 == 2, F.lit("short"))
    arguments = (
        F.when(size % 4 == 0, F.to_json(F.struct(F.col("text").alias("query"), (size % 20).alias("limit"))))
        .when(size % 4 == 1, F.to_json(F.struct(F.col("text").alias("key"), F.lit(True).alias("exact"))))
        .when(size % 4 == 2, F.to_json(F.struct(F.col("text").alias("text"), style.alias("style"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"))))
    )
    tool = F.element_at(F.array(*map(F.lit, ("search", "lookup", "summarize", "translate"))), size % 4 + 1)
    name = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - F.when(assistant, 1).otherwise(0)).cast("string"))
    return conversations.select(
        "conv_id",
        (F.col("turn") + F.when(user & (F.col("conv_id") % 7 == 3), 2).otherwise(0)).alias("turn"),
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user, F.col("text")).alias("content"),
        F.when(user | assistant, name).alias("call_id"),
        F.when(user, tool).alias("name"),
        F.when(user, arguments).alias("arguments"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(tool_messages(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumn("errors", F.array_join("errors", ","))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_ngram_join, op3_licenses, op4_decontaminate, op5_quality_rules, op6_token_counts, op7_personal_data,
        op8_language, op9_pack, op10_chat, op11_url_filters, op12_collocations, op13_lexical_search,
    )
}
