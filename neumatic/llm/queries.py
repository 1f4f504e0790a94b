"""Queries over the driver's tables, one per operator, and the SQL that repeats them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neumatic.llm import decontaminate, html_extract, katz, license_scan, line_dedup, ngram_join, packing, quality_pu, quality_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = warc.write(pages, revisit_from_bytes=0)
    return warc.report(warc.read(spark, path, with_payload=False), pages.schema["page_id"].dataType.simpleString())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_pu, op3_html_extraction, op4_best_fit_packing, op5_quality_rules, op6_decontamination, op7_ngram_jaccard, op8_line_dedup, op9_katz_backoff, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op5_quality_rules": quality_rules.oracle(),
        "op7_ngram_jaccard": ngram_join.oracle(),
        "op8_line_dedup": line_dedup.oracle(),
        "op10_warc": warc.oracle(),
    }
