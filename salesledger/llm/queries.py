"""The operators as queries over the whole generated tables, and the same in DuckDB's SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesledger.llm import (
    chat_perspectives,
    fill_in_middle,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    nearest,
    packing,
    prefix_trie,
    quality_rules,
    sharding,
    substring_dedup,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sharding.sizes(table(spark, sf_dir, "documents"))
    return sharding.with_shards(sized, SHARDS).selectExpr(
        "doc_id", "size", "text_crc32", "'key' AS law", "shard", "slot", "grown_shard"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs.where(~language_id.held_out()))
    predicted = language_id.predict(docs.select("doc_id", "text"), profiles)
    return predicted.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.digest(chat_perspectives.perspectives(table(spark, sf_dir, "conversations")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    taken = mixing.mixed(table(spark, sf_dir, "documents"), weights)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(docs))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.verdicts(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_perspectives": chat_perspectives.oracle_sql(),
        "op7_quality_rules": quality_rules.oracle_sql(),
        "op9_mixing": mixing.oracle_sql(),
        "op11_prefix_trie": prefix_trie.oracle_sql(),
        "op12_fill_in_middle": fill_in_middle.oracle_sql(),
        "op13_url_filter": url_filter.oracle_sql(),
    }
