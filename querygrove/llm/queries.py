"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, lzprint, mixing, packing, prefixes, quality, repair, repeats, secrets, simhash, toxicity, warc
from .common import conversations, documents
from .oracles import PREFIXES, REPEATS, WARC


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare_with_edits(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(documents(spark, sf_dir))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(conversations(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(conversations(spark, sf_dir), damage=True)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language, op2_mixing, op3_packing, op4_warc, op5_licenses, op6_quality,
                                   op7_fingerprints, op8_toxicity, op9_simhash, op10_repeats, op11_prefixes, op12_repair,
                                   op13_secrets)}
ORACLES: dict[str, str] = {"op4_warc": WARC, "op10_repeats": REPEATS, "op11_prefixes": PREFIXES}
