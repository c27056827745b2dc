"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicer.llm import decontaminate, html, licenses, oracles, packing, repetition, simhash, substrings, toxicity, urls, warc
from slicer.llm.session import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: The rules of the URL query, as (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.concat_ws(",", "licenses").alias("licenses"), "n_matches")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(read_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality(read_table(spark, sf_dir, "documents"))
    return found.drop("covered", "longest_repeat")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_licenses, op3_url_filter, op4_substring_dedup, op5_simhash, op6_packing, op7_decontamination, op8_html_extraction, op9_quality_rules, op10_warc)
}
ORACLE_SQL = {
    "op2_licenses": oracles.licenses(),
    "op3_url_filter": oracles.urls(URL_RULES),
    "op4_substring_dedup": oracles.substrings(),
    "op7_decontamination": oracles.decontamination(),
    "op9_quality_rules": oracles.quality(),
    "op10_warc": oracles.warc(),
}
