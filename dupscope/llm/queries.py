"""The thin queries: each applies one operator to its whole table and names the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, clustering, html_text, line_dedup, mixing, neighbours, ngram_jaccard, packing, quality_classifier, quality_rules, token_counts, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_filter.labelled_urls(pages, _table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("held_out_").alias("held_out"), F.col("score_").alias("score"), F.col("predicted_").alias("predicted"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(_table(spark, sf_dir, "embeddings"))
    return neighbours.search(vectors, vectors.where("id % 100 = 0"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.of_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_ngram_jaccard, op2_html_text, op3_url_filter, op4_quality_classifier, op5_best_fit_packing, op6_nearest_neighbours, op7_source_mix, op8_line_dedup, op9_token_counts, op10_quality_rules, op11_whitening, op12_byte_bpe, op13_centroid_clustering)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.SQL.format(docs="documents"), "op13_centroid_clustering": clustering.sql()}
