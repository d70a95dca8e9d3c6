"""Interleaved documents, image hashes, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import images, nodes
from millrace.sources import readers, sinks
from millrace.streaming import curate

T = lambda *xs: [(x, None) if not x.startswith("@") else (None, x[1:]) for x in xs]


def docs(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"doc_id long, nodes array<{nodes.NODE}>")


def shown(row):
    return [n["text"] if n["text"] is not None else "@" + n["src"] for n in row["nodes"]]


def test_merge_texts(spark):
    rows = docs(spark, T("a", "b", "@i", "", "c", "", "d", "@j"), [])
    got = rows.select("doc_id", nodes.merge_texts(F.col("nodes")).alias("nodes")).orderBy("doc_id").collect()
    assert [shown(r) for r in got] == [["a\n\nb", "@i", "c\n\nd", "@j"], []]


def test_markers(spark):
    m = nodes.MARKER
    rows = spark.createDataFrame([(f"a\n\n{m}\n\n{m}\n\nb\n\n{m}",)], "t string")
    got = rows.select(nodes.drop_last_marker(nodes.drop_repeated_markers(F.col("t"))).alias("t")).first()["t"]
    assert got == f"a\n\n{m}\n\nb"
    parts = nodes.split_at_markers(docs(spark, T("a", m, "b", "@i"))).orderBy("part").collect()
    assert [shown(r) for r in parts] == [["a"], ["b", "@i"]]


def test_image_nodes(spark):
    rows = docs(spark, T("@i", "t", "@i", "@j", "@k"))
    got = rows.select(nodes.first_of_each_image(F.col("nodes")).alias("nodes"), nodes.image_count(F.col("nodes")).alias("n"), nodes.longest_image_run(F.col("nodes")).alias("run"), nodes.has_both(F.col("nodes")).alias("both")).first()
    assert shown(got) == ["@i", "t", "@j", "@k"] and (got["n"], got["run"], got["both"]) == (4, 3, True)
    listed = spark.createDataFrame([("j",)], "url string")
    assert shown(nodes.without_images(rows, listed).first()) == ["@i", "t", "@i", "@k"]
    pics = spark.createDataFrame([("i", bytearray(b"x"))], "url string, bytes binary")
    found = nodes.attach(rows, pics).first()
    assert (found["num_found"], found["num_not_found"]) == (2, 2)
    assert {(r["src"], r["caption"]) for r in nodes.captions(rows).collect()} == {("i", "t"), ("i", None), ("j", None), ("k", None)}


def test_image_hashes():
    rng = np.random.default_rng(0)
    x = rng.random((32, 32))
    a, b = images.perceptual_hash(x), images.perceptual_hash(x + 0.001)
    assert (a ^ b).bit_count() <= 2 and (a ^ images.perceptual_hash(rng.random((32, 32)))).bit_count() > 10
    assert images.average_hash(np.eye(10)) == images.average_hash(2 * np.eye(10)) and len(images.average_hash(np.eye(10))) == 25
    assert images.difference_hash(np.tile(np.arange(9), (8, 1))) == 2**64 - 1


def test_tar_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "hello", "txt"), (0, "b", "x", "txt\nmissing")], "s int, k string, txt string, names string")
    tar = sinks.tar_members(rows, "k", "s", {"txt": "txt", "metadata.txt": "names"}).first()["tar"]
    (tmp_path / "a.tar").write_bytes(tar)
    samples = readers.tar_samples(spark, str(tmp_path / "a.tar"))
    assert sorted(r["key"] for r in samples.collect()) == ["a", "b"]
    assert [r["key"] for r in readers.complete_samples(samples).collect()] == ["a"]


def test_sharded(spark, tmp_path):
    sinks.sharded(spark.range(25), str(tmp_path / "out"), "id", 10, 1)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["split"], r["shard_id"], r["count"]) for r in back.groupBy("split", "shard_id").count().collect()} == {("valid", 0, 10), ("train", 1, 10), ("train", 2, 5)}


def test_resumable_partitions(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.resumable(spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string"), out, "p")
    sinks.resumable(spark.createDataFrame([(3, "b")], "id long, p string"), out, "p")
    assert sorted((r["id"], r["p"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "b")]


def test_json_and_schema(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": ["x"]}\n{"a": 2}\n')
    schema = readers.schema_of({"a": "long", "b": ["string"]})
    assert sorted(r["a"] for r in readers.mixture_file(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.mixture_file(spark, "x.txt", schema)


def test_synthetic_and_cone(spark):
    a = readers.synthetic(spark, 200)
    assert sorted(a.collect()) == sorted(a.repartition(7).collect())
    assert readers.cone(a, 180.0, 0.0, 60.0).count() > 0


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    curate.start(curate.files(spark, src, schema, 2), out, ck).awaitTermination()
    spark.range(10, 14).write.mode("append").parquet(src)
    curate.start(curate.files(spark, src, schema, 2), out, ck).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(14))


def test_event_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").limit(400)
    src = str(tmp_path / "events")
    events.repartition(2).write.parquet(src)
    stream = curate.files(spark, src, events.schema, 1)
    q = curate.tumbling(stream, "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from tumbling").first()[0] == events.count()
    q = curate.running_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(m) from (select user_id, max(n) as m from counts group by user_id)").first()[0] == events.count()
