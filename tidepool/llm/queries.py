"""The queries of this subpackage: op<N>_<name> over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import langid, licences, maintext, merkle, mixing, packing, privacy, quality, simhash, topk
from tidepool.llm.base import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_fingerprints(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in privacy.KINDS]
    base = F.sha2(privacy.spans_text(F.col("base")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), privacy.spans_text(F.concat("base", "learned")).alias("spans"))


#: Weights of the domains that labels tell apart: what is good and not toxic makes up nearly all.
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'low' when quality = 1 then 'clean' end").alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixed_rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)
    shares = [F.coalesce(F.col("posterior")[x], F.lit(0.0)).alias(f"p_{x}") for x in TARGETS]
    return rates.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_language, op3_quality, op4_top_k, op5_main_text, op6_packing, op7_merkle, op8_personal_data, op9_mixing, op10_licences)
}
#: Hashes, learned models, tokenizers and graph searches are beyond SQL; tests/llm/ hold these queries against brute force.
ORACLE_SQL: dict[str, str] = {}
