"""The ten training-data queries, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, nearest, pitman_yor, quality, simhash, suffix, toxicity, urlfilter, warc
from .common import table


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.kept(suffix.repeats(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    dated = pages.withColumn("fetched_at", urlfilter.fetch_time())
    return warc.derive(warc.responses(dated, date_col="fetched_at"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "held_out", "severity", (F.col("p_above") >= 0.5).alias("toxic"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(urlfilter.dated_pages(pages), urlfilter.feed_from(pages)).drop("fetched_at")


QUERIES = {
    "op1_suffix": op1_suffix,
    "op2_warc": op2_warc,
    "op3_nearest": op3_nearest,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix": op6_mix,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_urlfilter": op10_urlfilter,
}

SQL = {
    "op5_decontaminate": decontaminate.CONTAMINATION_SQL,
    "op6_mix": mixing.MIX_SQL.format(docs="documents") + "select doc_id, size, source_size, target, (copies * size)::bigint as taken from mixed",
    "op10_urlfilter": urlfilter.FEED_SQL,
}
