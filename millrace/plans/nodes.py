"""Queries over interleaved documents: the lines of ``documents`` as text, picture and marker nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import dedup, nodes
from ..sources.tables import table

MARK = nodes.MARKER


def _interleaved(spark, sf_dir):
    """A line whose length divides by five is one of seven pictures, by eleven a marker, and else a text."""
    n = lambda x: F.length(x)
    src = lambda x: F.when(n(x) % 5 == 0, F.concat(F.lit("https://img.example/"), (n(x) % 7).cast("string"), F.lit(".jpg")))
    text = lambda x: F.when(n(x) % 5 != 0, F.when(n(x) % 11 == 0, F.lit(MARK)).otherwise(x))
    made = F.transform(F.split("text", "\n"), lambda x: F.struct(text(x).alias("text"), src(x).alias("src")))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("nodes"))


def _shown(array):
    """Nodes as one text: sources in brackets."""
    return F.sha2(F.array_join(F.transform(array, lambda x: F.when(x["src"].isNotNull(), F.concat(F.lit("["), x["src"], F.lit("]"))).otherwise(x["text"])), "|"), 256)


def _marked(spark, sf_dir):
    """Texts with a marker for each line whose length divides by three."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 3 == 0, F.lit(MARK)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("t"))


def node_merge(spark, sf_dir):
    merged = _interleaved(spark, sf_dir).withColumn("m", nodes.merge_texts(F.col("nodes")))
    return merged.select("doc_id", F.size("m").cast("long").alias("n_nodes"), _shown("m").alias("nodes_sha256"))


def node_repeated_markers(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.sha2(nodes.drop_repeated_markers(F.col("t"), "\n"), 256).alias("text_sha256"))


def node_last_marker(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.sha2(nodes.drop_last_marker(F.col("t"), "\n"), 256).alias("text_sha256"))


def node_split(spark, sf_dir):
    parts = nodes.split_at_markers(_interleaved(spark, sf_dir))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.size("nodes").cast("long").alias("n_nodes"), _shown("nodes").alias("nodes_sha256"))


def node_captions(spark, sf_dir):
    found = nodes.captions(_interleaved(spark, sf_dir))
    return found.groupBy("src").agg(F.count("*").alias("n_images"), F.count("caption").alias("n_captions"), F.countDistinct("caption").alias("n_distinct"))


def node_filters(spark, sf_dir):
    """Documents with a text and a picture, with texts that aren't all markers, one to thirty pictures and no run of more than three."""
    held = _interleaved(spark, sf_dir)
    n, run = nodes.image_count(F.col("nodes")), nodes.longest_image_run(F.col("nodes"))
    return held.where(nodes.has_both(F.col("nodes")) & nodes.not_only_markers(F.col("nodes")) & n.between(1, 30) & (run <= 3)).select("doc_id", n.cast("long").alias("n_images"), run.cast("long").alias("longest_run"))


def node_first_images(spark, sf_dir):
    held = _interleaved(spark, sf_dir).withColumn("f", nodes.first_of_each_image(F.col("nodes")))
    return held.select("doc_id", F.size("f").cast("long").alias("n_nodes"), _shown("f").alias("nodes_sha256"))


def node_opt_out(spark, sf_dir):
    listed = spark.createDataFrame([("https://img.example/0.jpg",), ("https://img.example/3.jpg",)], "url string")
    held = nodes.without_images(_interleaved(spark, sf_dir), listed)
    return held.select("doc_id", F.size("nodes").cast("long").alias("n_nodes"), _shown("nodes").alias("nodes_sha256"))


def node_attach(spark, sf_dir):
    """Pictures looked up by address, five of seven found: how many of a document's are, and the bytes that came."""
    images = spark.createDataFrame([(f"https://img.example/{i}.jpg", f"<{i}>") for i in range(5)], "url string, bytes string")
    found = nodes.attach(_interleaved(spark, sf_dir), images)
    held = F.array_join(F.transform(F.filter("nodes", lambda x: x["bytes"].isNotNull()), lambda x: x["bytes"]), "")
    return found.select("doc_id", F.col("num_found"), F.col("num_not_found"), F.sha2(held, 256).alias("bytes_sha256"))


def node_sources(spark, sf_dir):
    """Published copies: pictures as addresses."""
    held = _interleaved(spark, sf_dir).select("doc_id", nodes.sources(F.col("nodes")).alias("s"))
    return held.select("doc_id", F.size(F.filter("s", lambda x: x.isNotNull())).cast("long").alias("n_images"), F.sha2(F.array_join("s", "|", "-"), 256).alias("sources_sha256"))


def image_filter(spark, sf_dir):
    """Formats, sizes and shapes of pictures described by parts."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["jpg", "png", "gif", "webp", None])), (k % 5 + 1).cast("int"))
    w, h = (k * 37 % 1500).cast("double"), (k * 53 % 1500).cast("double")
    shown = F.coalesce(urls.resolved_percent(F.concat((k % 120).cast("string"), F.lit("%")), w), w)
    named = urls.size_in_pixels(F.concat((k % 900).cast("string"), F.element_at(F.array(F.lit("px"), F.lit(""), F.lit("em")), (k % 3 + 1).cast("int"))))
    held = table(spark, sf_dir, "part").select(k, kind.alias("kind"), w.alias("w"), h.alias("h"), shown.alias("shown_w"), named.alias("shown_h"))
    return held.where(nodes.image_passes(F.col("kind"), F.col("w"), F.col("h"), F.col("shown_w"), F.col("shown_h"))).select("p_partkey", F.col("shown_w").alias("shown_w"), "shown_h")


def image_md5_dedup(spark, sf_dir):
    """Of pictures with the same bytes (here: the same first line) the first stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.get(F.split("text", "\n"), F.lit(0)).cast("binary")).alias("md5"))
    return dedup.keep_first(d, F.col("md5"), [F.col("doc_id")]).select("doc_id", "md5")


QUERIES = {f.__name__: f for f in (node_merge, node_repeated_markers, node_last_marker, node_split, node_captions, node_filters, node_first_images, node_opt_out, node_attach, node_sources, image_filter, image_md5_dedup)}

_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)"
_NODES = f"n as (select doc_id, i, case when length(x) % 5 = 0 then 'https://img.example/' || (length(x) % 7) || '.jpg' end as src, case when length(x) % 5 <> 0 then case when length(x) % 11 = 0 then '{MARK}' else x end end as text from {_LINES})"
_SHOW = "sha256(coalesce(string_agg(coalesce('[' || src || ']', text), '|' order by i), ''))"
_MARKED = f"m as (select doc_id, i, case when length(x) % 3 = 0 then '{MARK}' else x end as x from {_LINES})"

SQL = {
    "node_merge": f"with {_NODES}, k as (select * from n where src is not null or text <> ''), r as (select *, sum(case when src is not null or before_src is not null or first then 1 else 0 end) over (partition by doc_id order by i) as run from (select *, lag(src) over (partition by doc_id order by i) as before_src, row_number() over (partition by doc_id order by i) = 1 as first from k)), "
    f"j as (select doc_id, run, min(i) as i, max(src) as src, string_agg(text, chr(10) || chr(10) order by i) as text from r group by doc_id, run) select d.doc_id, count(j.run) as n_nodes, {_SHOW} as nodes_sha256 from (select doc_id from documents) d left join j on d.doc_id = j.doc_id group by d.doc_id",
    "node_repeated_markers": f"with {_MARKED}, k as (select *, lag(x) over (partition by doc_id order by i) as before from m) select doc_id, sha256(string_agg(x, chr(10) order by i)) as text_sha256 from k where not (x = '{MARK}' and coalesce(before = '{MARK}', false)) group by doc_id",
    "node_last_marker": f"with {_MARKED}, k as (select *, max(i) over (partition by doc_id) as last from m) select doc_id, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not (i = last and x = '{MARK}')), '')) as text_sha256 from k group by doc_id",
    "node_split": f"with {_NODES}, k as (select *, sum(case when text = '{MARK}' then 1 else 0 end) over (partition by doc_id order by i) as part from n) select doc_id, part::bigint as part, count(*) as n_nodes, {_SHOW} as nodes_sha256 from k where text is distinct from '{MARK}' group by doc_id, part",
    "node_captions": f"with {_NODES}, k as (select *, lead(text) over (partition by doc_id order by i) as after from n) select src, count(*) as n_images, count(after) as n_captions, count(distinct after) as n_distinct from k where src is not null group by src",
    "node_filters": f"with {_NODES}, r as (select *, i - row_number() over (partition by doc_id, src is not null order by i) as run from n), s as (select doc_id, run, count(*) as k from r where src is not null group by doc_id, run), g as (select doc_id, count(src) as n_images, count(text) as n_texts, count(*) filter (where text <> '{MARK}') as plain from n group by doc_id) "
    "select g.doc_id, n_images, max(k)::bigint as longest_run from g join s on g.doc_id = s.doc_id where n_texts > 0 and plain > 0 and n_images between 1 and 30 group by g.doc_id, n_images having max(k) <= 3",
    "node_first_images": f"with {_NODES}, k as (select *, row_number() over (partition by doc_id, src order by i) as place from n) select doc_id, count(*) as n_nodes, {_SHOW} as nodes_sha256 from k where src is null or place = 1 group by doc_id",
    "node_opt_out": f"with {_NODES}, k as (select * from n where src is null or src not in ('https://img.example/0.jpg', 'https://img.example/3.jpg')) select d.doc_id, count(k.i) as n_nodes, {_SHOW} as nodes_sha256 from (select doc_id from documents) d left join k on d.doc_id = k.doc_id group by d.doc_id",
    "node_attach": f"with {_NODES} select doc_id, count(*) filter (where substr(src, 21, 1) < '5') as num_found, count(*) filter (where substr(src, 21, 1) >= '5') as num_not_found, sha256(coalesce(string_agg('<' || substr(src, 21, 1) || '>', '' order by i) filter (where substr(src, 21, 1) < '5'), '')) as bytes_sha256 from n group by doc_id",
    "node_sources": f"with {_NODES} select doc_id, count(src) as n_images, sha256(string_agg(coalesce(src, '-'), '|' order by i)) as sources_sha256 from n group by doc_id",
    "image_filter": "with k as (select p_partkey, ['jpg', 'png', 'gif', 'webp', null][p_partkey % 5 + 1] as kind, (p_partkey * 37 % 1500)::double as w, (p_partkey * 53 % 1500)::double as h, round_even((p_partkey * 37 % 1500)::double * (p_partkey % 120) / 100, 0) as shown_w, case when p_partkey % 3 < 2 then (p_partkey % 900)::double end as shown_h from part) "
    "select p_partkey, shown_w, shown_h from k where (kind is null or kind in ('jpg', 'png', 'webp')) and w between 150 and 20000 and h between 150 and 20000 and shown_w between 150 and 20000 and coalesce(shown_h between 150 and 20000, true) and w / h between 0.5 and 2",
    "image_md5_dedup": "select min(doc_id) as doc_id, m as md5 from (select doc_id, md5(string_split(text, chr(10))[1]) as m from documents) group by m",
}
