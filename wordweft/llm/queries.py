"""Registered queries of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cnn, dac, dialogue, langid, lbl, oddsketch, phrases, rules, sharding, simhash, tiling, toxicity
from .common import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_read(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents")).drop("first_rule")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame, apart: bool = False) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(_tokenizer("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, apart=apart)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lbl.score(_read(spark, sf_dir, "documents"), ~lbl.held_out())
    return found.withColumn("held_out", lbl.held_out())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = cnn.score(docs, cnn.fit_on(docs, _read(spark, sf_dir, "labels")))
    verdict = (F.col("score") >= cnn.THRESHOLD).cast("int")
    return found.select("doc_id", cnn.held_out().alias("held_out"), "score", verdict.alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out()).select("text", "lang")))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit_on(docs, _read(spark, sf_dir, "labels")))
    verdict = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", verdict.alias("predicted"), "offending")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(_tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/token_ids"
    dac.write_segments(_read(spark, sf_dir, "documents"), path, tokenizer)
    return dac.read_documents(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_copies(_read(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(_read(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_token_ids": op9_token_ids,
    "op10_decontamination": op10_decontamination,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_conversations": op12_conversations,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {"op3_quality_rules": rules.ORACLE, "op13_phrases": phrases.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
