"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extract, line_dedup, media_avi, ngram_join, quality_classifier, secret_scan, sentencepiece_codec, suffix_dedup, url_filter
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "votes", "posterior", "score", "keep")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digests(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(_read(spark, sf_dir, "documents"), n_words=3, num=90, den=100).drop("rep_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_read(spark, sf_dir, "documents"))


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_digests(media_avi.pack(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_suffix_dedup, op4_ngram_join, op5_line_dedup, op6_url_filter, op7_html_extract, op8_secret_scan, op9_media_avi, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {k: ORACLES[k] for k in QUERIES if k in ORACLES}
