"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import language, lines, minhash, mixing, packing
from prospecta.session import scratch_path

#: Near copies share at least so many percent of their shingles (op4_minhash_near_dedup has its own 85).
NEAR = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or of unclear language go."""
    return language.accepted(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those of which nothing is left go. n_chars follows the text."""
    cut = lines.dedup_lines(docs)
    changed = F.col("__lines_removed") > 0
    return cut.filter(~changed | (F.length(F.trim("text")) > 0)).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest doc_id of their component of near duplicates, which are at least ``NEAR`` percent alike;
    of equal doc_ids, one row each."""
    kept = minhash.near_duplicates(docs, percent=NEAR).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.emitted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document (copies are documents of their own) lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", fresh_lines),
    ("MinHash near-dedup", one_of_each),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Language models and packing are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
