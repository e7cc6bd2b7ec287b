"""Corpus pipeline: STAGES over the table ``documents``, each stage's rows written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarisk.llm import common as C
from stratarisk.llm import decontam, line_dedup, ngram_join, pack, quality, registry
from stratarisk.session import prepare


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; fitted on the labels of the documents given."""
    prepare(spark)
    return quality.keep_good(docs, C.table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; n_chars follows the text. A document left without lines goes."""
    prepare(spark)
    kept = line_dedup.remove_lines(docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle Jaccard of 0.8 or more stays: the one with the smallest id."""
    prepare(spark)
    return ngram_join.one_per_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    prepare(spark)
    return decontam.drop_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 2048 ids."""
    prepare(spark)
    return pack.pack_documents(docs, registry.tokenizer_path())


STAGES = [("quality_classifier", quality_filter), ("line_dedup", repeated_lines), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", benchmark_leaks), ("packing", packing)]
#: a fitted classifier, latent retrieval and a tokenizer cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
