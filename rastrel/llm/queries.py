"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import decontaminate, langid, lines, media, packing, pii, repair, search, secrets, sharding, simhash, urls, whitening
from rastrel.llm.common import table
from rastrel.llm.oracles import ORACLES


def op1_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(table(spark, sf_dir, "documents"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_host_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"))


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of spark.rastrel.pseudonym.key; without that setting, the development key, and a warning."""
    key = spark.conf.get("spark.rastrel.pseudonym.key", None)
    if not key:
        warnings.warn("pseudonyms are made with the development key, which anyone can turn back: set spark.rastrel.pseudonym.key", stacklevel=2)
    return pii.pseudonymised(table(spark, sf_dir, "documents"), ["doc_id"], key.encode() if key else pii.DEFAULT_KEY)


def op10_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.told(table(spark, sf_dir, "documents"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.transformed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_multipart_secrets,
        op2_harmonic_packing,
        op3_baseline_jpeg,
        op4_simhash_pigeonring,
        op5_host_segmentation,
        op6_permutation_sharding,
        op7_rank_order_language,
        op8_template_decontamination,
        op9_feistel_pseudonyms,
        op10_repair_tokens,
        op11_bloom_lines,
        op12_threshold_search,
        op13_compensated_whitening,
    )
}

__all__ = ["ORACLES", "QUERIES"]
