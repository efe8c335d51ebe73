"""A corpus from documents to packed sequences, in stages.  Each stage reads what the one before wrote.

1. quality: documents that the classifier rejects go; without a label to learn from none does.
2. lines: later occurrences of repeated three-line windows go from the texts.
3. near_duplicates: of each group of near copies the document with the smallest doc_id stays.
4. mix: documents are taken as often as the target weights of their sources ask, 0 to 3 times.
5. pack: the rows that are left, cut into pieces and packed into sequences.

All stages but the last return the columns of documents; n_chars follows the text.  Null texts count as
empty ones, and stay null; repeated rows are documents of their own up to near_duplicates, which keeps all rows of the
doc_id that it keeps; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscope.llm import line_dedup, mixing, ngram_jaccard, packing, quality_classifier, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if quality_classifier.known(labels).isEmpty():
        return docs
    return quality_classifier.classify(docs, labels).where("predicted_ = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed_") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Trained scores, a random walk and tokenizer ids: not SQL.  Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
