"""The operators of this folder as queries over whole tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, divergence, exact_dedup, fertility, html_text, licenses, merkle, ngram_join, packing, paragraphs, passages, pii, quality_model, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sized(ngram_join.sized_clusters(_table(spark, sf_dir, "documents")))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


REGISTRY = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_model, op3_ngram_join, op4_licenses,
        op5_url_filter, op6_packing, op7_paragraphs, op7_passages,
        op8_fertility, op9_html_text, op10_pii, op11_merkle_manifest,
        op12_exact_dedup, op13_source_divergence,
    )
}
