"""Queries that write a table in some form to the shared folder and read it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..sources.shared import scratch
from ..sources.tables import table


def rt_json_lines(spark, sf_dir):
    """Documents as gzip JSON lines, read with a declared schema."""
    path = scratch(spark, "lines")
    d = table(spark, sf_dir, "documents")
    d.select("doc_id", "text", F.struct("lang", "source").alias("meta")).write.option("compression", "gzip").json(path)
    held = readers.json_lines(spark, path, "doc_id long, text string, meta struct<lang: string, source: string>")
    return held.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "meta.lang", "meta.source")


def rt_json_list(spark, sf_dir):
    """Nations as one JSON list."""
    path = scratch(spark, "list")
    n = table(spark, sf_dir, "nation")
    n.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    return readers.json_list(spark, path, "n_nationkey int, n_name string")


def rt_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


def rt_json_to_text(spark, sf_dir):
    """One JSON field of an event, as lines of text."""
    path = scratch(spark, "props")
    table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("value")).where("value is not null").write.text(path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


def rt_shards(spark, sf_dir):
    """Runs of 300 documents by id in folders of split and shard."""
    path = scratch(spark, "shards")
    sinks.sharded(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, "doc_id", 300)
    return spark.read.parquet(path).groupBy("split", F.col("shard_id").cast("long").alias("shard_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def rt_resumed(spark, sf_dir):
    """Partitions written, and one of them written again: the others stay, no row comes twice."""
    path = scratch(spark, "resumed")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.resumable(d, path, "lang")
    sinks.resumable(d.where("lang = 'en'"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))


def rt_text_list(spark, sf_dir):
    path = scratch(spark, "urls")
    sinks.text_list(table(spark, sf_dir, "pages"), "url", path)
    return spark.read.text(path).select(F.col("value").alias("url"))


def rt_provenance(spark, sf_dir):
    path = scratch(spark, "facts")
    sinks.provenance(table(spark, sf_dir, "orders"), path, source="orders")
    return spark.read.json(path).select("n_rows", "columns", "source")


def rt_submission(spark, sf_dir):
    """Of a customer's orders, the one of the latest date as the row that is handed in; customers without one kept."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders")
    done = o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("step"))
    return sinks.latest_submission(done, c, "k", "step").select("k", "o_orderkey")


def file_ranges(spark, sf_dir):
    """The magic bytes of a Parquet file, a file that isn't there and a range beyond the end."""
    wanted = spark.createDataFrame([(1, "nation.parquet", 0, 4), (2, "none.parquet", 0, 4), (3, "nation.parquet", 0, 2**31 - 2), (4, "region.parquet", 1, 3)], "id int, file string, offset long, length long")
    return readers.file_ranges(wanted, f"{sf_dir}/{{nation,region}}.parquet").select("id", F.col("data").cast("string").alias("data"), "error")


def projected_scan(spark, sf_dir):
    """Two columns of documents without nulls: the scan reads no others and filters by itself."""
    return table(spark, sf_dir, "documents").where("lang is not null and n_chars > 1000").select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (rt_json_lines, rt_json_list, rt_csv, rt_json_to_text, rt_shards, rt_resumed, rt_text_list, rt_provenance, rt_submission, file_ranges, projected_scan)}

SQL = {
    "rt_json_lines": "select doc_id, sha256(text) as text_sha256, lang, source from documents",
    "rt_json_list": "select n_nationkey, n_name from nation",
    "rt_csv": "select c_custkey, c_name, c_mktsegment from customer",
    "rt_json_to_text": "select json_extract_string(props, '$.k') as value, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1",
    "rt_shards": "with r as (select doc_id, (row_number() over (order by doc_id) - 1) // 300 as s from documents) select case when s < 2 then 'valid' else 'train' end as split, s::bigint as shard_id, count(*) as n, min(doc_id) as first_doc from r group by s",
    "rt_resumed": "select lang, count(*) as n, count(distinct doc_id) as n_ids from documents group by lang",
    "rt_text_list": "select distinct url from pages where url is not null",
    "rt_provenance": "select count(*) as n_rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' as columns, 'orders' as source from orders",
    "rt_submission": "select c_custkey as k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from customer left join orders on c_custkey = o_custkey group by c_custkey",
    "file_ranges": "select * from (values (1, 'PAR1', null), (2, null, 'no such file'), (3, null, 'range beyond the file'), (4, 'AR1', null)) as v(id, data, error)",
    "projected_scan": "select doc_id, lang from documents where lang is not null and n_chars > 1000",
}
