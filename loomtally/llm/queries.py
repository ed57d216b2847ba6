"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.llm import bpe, chat, lm_score, media, mixing, ngram_join, pu_quality, quality_rules, sharding, url_rules
from loomtally.llm.shared import documents

#: The vocabulary's file; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Host, path and verdict of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "copies")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.score_quality(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = media.write_shards(documents(spark, sf_dir).select("doc_id", "text"))
    full = media.fill_metadata(media.read_payloads(refs))
    return full.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "digest", "offset", "length"
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.parse_conversations(chat.format_conversations(chat.linear_messages(rows), unique=True))
    loss = F.array_join("loss", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    judged = quality_rules.apply_policy(entries, quality_rules.STRICT)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_upper", "n_shouts", "fail_bits")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir).select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from loomtally.llm import oracles

    return oracles.oracle_sql()
