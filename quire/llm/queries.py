"""The registered queries of the numbered operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, hard_negatives, language, licenses, phrases, quality, secret_scan, simhash, token_files, tool_calls, toxicity, word_bpe
from .common import table


#: Consecutive doc_ids that make up a repository of ``documents``.
REPOSITORY = 1024


def repository() -> Column:
    """The documents of one language among REPOSITORY consecutive doc_ids, whoever owns them."""
    return F.concat_ws("/", "lang", F.floor(F.col("doc_id") / REPOSITORY).cast("string"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's owner is its source; ``repository`` says what its repository is."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), repository())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents"), path, end_id=2))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no calls as such: ``tool_calls.transcript`` says what counts as one."""
    rows = tool_calls.link(tool_calls.transcript(table(spark, sf_dir, "conversations")))
    return rows.withColumn("problems", F.array_join("problems", "; "))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are one further, rows of ids divisible by 100 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = hard_negatives.quantised(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives.mine(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_decontamination": op2_decontamination,
        "op3_token_files": op3_token_files,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_tool_calls": op6_tool_calls,
        "op7_license_scan": op7_license_scan,
        "op8_language_id": op8_language_id,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_word_bpe": op11_word_bpe,
        "op12_collocations": op12_collocations,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": tool_calls.transcript_sql(), "op7_license_scan": licenses.scan_sql(), "op12_collocations": phrases.sql(), "op13_hard_negatives": hard_negatives.sql()}
