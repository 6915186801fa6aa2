"""Registered queries ``opN_<name>``: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, divergence, filter_audit, id_files, licences, mixing, near_dedup, packing, pii, quality, secret_scan, source_audit, toxicity,
)
from .common import read
from .oracles import ORACLES as ORACLES


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumn("spans", F.array_join("spans", ","))


def op5_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(read(spark, sf_dir, "documents"))


def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_retraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


def op12_pointer_sort_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op13_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_divergence_rules": op2_divergence_rules,
    "op3_template_decontamination": op3_template_decontamination,
    "op4_crf_toxicity": op4_crf_toxicity,
    "op5_range_coded_ids": op5_range_coded_ids,
    "op6_crf_pii": op6_crf_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_licence_paragraphs": op8_licence_paragraphs,
    "op9_forest_secrets": op9_forest_secrets,
    "op10_attention_quality": op10_attention_quality,
    "op11_retraction_audit": op11_retraction_audit,
    "op12_pointer_sort_audit": op12_pointer_sort_audit,
    "op13_fair_queueing": op13_fair_queueing,
}
