"""The corpus pipeline: five filters over ``documents``, each written as Parquet and read by the next.

Every stage takes null ids, texts and sources, repeated rows, empty and very
long texts, an empty table and columns of any name: rows without an id all
stay in the near-dedup, of rows that repeat an id it keeps one, a null text
is empty and stays null where texts are cut, and columns but for those that
``documents`` has are carried along (the last stage leaves out those named as
its results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, quality, simhash, suffix
from millrace.llm.common import fresh, materialize, table

#: Documents that the quality classifier scores below this go.
LEAST_QUALITY = 0.5


def _lengths(docs: DataFrame) -> DataFrame:
    """n_chars as it is after a stage that cuts texts; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "score")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), score_col=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies (five-word shingles, similarity 0.8 or more); rows without an id all stay."""
    return simhash.near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _lengths(suffix.cut_repeats(docs)).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _lengths(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies and words of each; columns named as the mix's results are left out."""
    rest = [c for c in docs.columns if c not in mixing.RESULTS]
    mixed = mixing.mix(docs, columns=rest).where("copies > 0")
    return mixed.select("doc_id", *rest, F.col("copies").cast("long").alias("copies"), F.col("taken").cast("long").alias("taken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", source_mixing),
]

#: A classifier, fingerprints and an automaton have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
