"""Queries over pairs, mixtures, pages as code, and multi-way evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixture, pairs
from ..sources.tables import table
from . import text

WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 1.0}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pair_filter(spark, sf_dir):
    """First line, last line and whole text as three captions of one row."""
    lines = F.split(F.col("text"), "\n")
    held = _docs(spark, sf_dir).select("doc_id", F.get(lines, F.lit(0)).alias("first"), F.try_element_at(lines, F.lit(-1)).alias("last"), F.col("text").alias("whole"))
    return pairs.surviving_texts(held, ["first", "last", "whole"]).select("doc_id", F.array_join("kept_keys", ",").alias("kept"))


def url_ban_words(spark, sf_dir):
    banned = ("spam", "ref=", "utm_")
    return table(spark, sf_dir, "pages").select("page_id", pairs.unbanned(F.col("url"), banned).alias("url"))


def html_code_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(pairs.code_passes(F.col("html"), ("***", "placeholder"), 100)).select("page_id")


def crawl_join(spark, sf_dir):
    """A list of addresses left-joined to the pages: how many match, and how many distinct ones."""
    p = table(spark, sf_dir, "pages")
    listed = p.select(F.regexp_replace("url", "[?#].*$", "").alias("wanted")).distinct()
    index = p.select(F.col("url").alias("held"), "page_id")
    return listed.join(index, F.col("wanted") == F.col("held"), "left").agg(F.count("*").alias("n_listed"), F.count("held").alias("n_matched"), F.countDistinct("held").alias("n_distinct"))


def filled_lookup(spark, sf_dir):
    """Documents' languages looked up in two shards of the table, the first one's answer before the second's."""
    d = _docs(spark, sf_dir)
    a, b = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("a-"), "lang").alias("lang")), d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("b-"), "lang").alias("lang"))
    return pairs.filled(d.select("doc_id"), "doc_id", [a, b], "lang")


def interleave_order(spark, sf_dir):
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("source")), F.lit(1.0))
    return mixture.interleaved(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", weight).select("doc_id", F.round("order_key", 9).alias("order_key"))


def mini_epochs(spark, sf_dir):
    out = mixture.mini_epochs(_docs(spark, sf_dir), "doc_id", "source", WEIGHTS)
    return out.groupBy("epoch", "source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def oversampled(spark, sf_dir):
    out = mixture.oversampled(_docs(spark, sf_dir).select("doc_id", "source"), F.col("doc_id") % 4)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.max("copy").cast("int").alias("most"))


def argmax_accuracy(spark, sf_dir):
    """Ten scores a row, the greatest is the prediction: accuracy of each class and overall share."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("tested", "score"))
    best = e.groupBy("vec_id", "label").agg(F.max_by("tested", F.struct("score", -F.col("tested"))).alias("predicted"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 9).alias("accuracy"))


def caption_matching(spark, sf_dir):
    """Pairs of examples with two captions and two pictures (halves of the vectors): text, image and group scores."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("example"), (F.col("vec_id") % 2).alias("i"), F.slice("embedding", 1, 32).alias("c"), F.slice("embedding", 33, 32).alias("p"))
    both = e.select("example", "i", "c").join(e.select("example", F.col("i").alias("j"), "p"), "example")
    dot = F.aggregate(F.zip_with("c", "p", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    wide = both.groupBy("example").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), dot)).alias(f"s{i}{j}") for i in (0, 1) for j in (0, 1)])
    words, pictures = (F.col("s00") > F.col("s10")) & (F.col("s11") > F.col("s01")), (F.col("s00") > F.col("s01")) & (F.col("s11") > F.col("s10"))
    scored = wide.where("s11 is not null").select(words.cast("double").alias("t"), pictures.cast("double").alias("i"), (words & pictures).cast("double").alias("g"))
    return scored.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(n) for c, n in (("t", "text_score"), ("i", "image_score"), ("g", "group_score"))])


def ratio_divergence(spark, sf_dir):
    """How far the stop-word histogram of each other language lies from that of English."""
    bins = text.ratio_histogram(spark, sf_dir)
    english = bins.where("lang = 'en'").select("bin", F.col("density").alias("q"))
    both = bins.where("lang <> 'en'").join(english, "bin", "left")
    return both.groupBy("lang").agg(F.round(F.sum(F.col("density") * F.log(F.col("density") / F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-12)))), 6).alias("kl"))


def first_wins(spark, sf_dir):
    """Of repeated evaluation rows of one user and type, the first by id counts."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))
    return first.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (pair_filter, url_ban_words, html_code_filter, crawl_join, filled_lookup, interleave_order, mini_epochs, oversampled, argmax_accuracy, caption_matching, ratio_divergence, first_wins)}

_OK = "(len({w}) between 1 and 256 and case when len({w}) > 0 then 1 - len(list_distinct({w})) / len({w}) else 0 end <= 0.7 and {s} <= 0.4)"


def _caption(column):
    return _OK.replace("{w}", text.WORDS.replace("@", column)).replace("{s}", text._special(column))


_U = "(('0x' || substr(sha256('{}:' || doc_id::varchar), 1, 13))::bigint)"
_CODE = r"regexp_replace(regexp_replace(lower(html), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"

SQL = {
    "pair_filter": f"with d as (select doc_id, string_split(text, chr(10))[1] as f, string_split(text, chr(10))[-1] as l, text as w from documents), k as (select doc_id, case when {_caption('f')} then 'first' end as a, case when {_caption('l')} then 'last' end as b, case when {_caption('w')} then 'whole' end as c from d) select doc_id, concat_ws(',', a, b, c) as kept from k where coalesce(a, b, c) is not null",
    "url_ban_words": "select page_id, case when not regexp_matches(lower(url), 'spam|ref=|utm_') then url end as url from pages",
    "html_code_filter": f"select page_id from pages where not contains(lower(html), '***') and not contains(lower(html), 'placeholder') and len(list_filter(regexp_split_to_array({_CODE}, '[ \\n\\t\\r]+'), lambda x: x <> '')) >= 100",
    "crawl_join": "select count(*) as n_listed, count(url) as n_matched, count(distinct url) as n_distinct from (select distinct regexp_replace(url, '[?#].*$', '') as wanted from pages) left join pages on wanted = url",
    "filled_lookup": "select doc_id, case when doc_id % 3 = 0 then 'a-' || lang when doc_id % 2 = 0 then 'b-' || lang end as lang from documents",
    "interleave_order": f"select doc_id, round(-ln(({_U.format(0)} + 0.5::double) / 4503599627370496.0::double) / case source when 'src0' then 4.0 when 'src1' then 2.0 else 1.0 end::double, 9) as order_key from documents",
    "mini_epochs": f"with s as (select doc_id, source, case source when 'src0' then 1 when 'src1' then 2 when 'src2' then 4 else 1 end as n, {_U.format(17)} / 4503599627370496.0::double as u from documents), e as (select *, floor(u * n)::int as own, unnest(range(0, 50)) as epoch from s) select epoch::int as epoch, source, count(*) as n, sum(doc_id)::bigint as ids from e where epoch % n = own group by epoch, source",
    "oversampled": "select source, sum(doc_id % 4)::bigint as n, max(doc_id % 4)::int as most from documents where doc_id % 4 > 0 group by source",
    "argmax_accuracy": "with e as (select vec_id, label, unnest(embedding[1:10]) as score, generate_subscripts(embedding[1:10], 1) - 1 as tested from embeddings), r as (select *, row_number() over (partition by vec_id order by score desc, tested) as i from e) select label, count(*) as n, round(avg((tested = label)::int), 9) as accuracy from r where i = 1 group by label",
    "caption_matching": "with e as (select vec_id // 2 as x, vec_id % 2 as i, embedding[1:32]::double[] as c, embedding[33:64]::double[] as p from embeddings), s as (select a.x, a.i as i, b.i as j, list_dot_product(a.c, b.p) as s from e a join e b on a.x = b.x), w as (select x, max(s) filter (where i = 0 and j = 0) as s00, max(s) filter (where i = 0 and j = 1) as s01, max(s) filter (where i = 1 and j = 0) as s10, max(s) filter (where i = 1 and j = 1) as s11 from s group by x) select count(*) as n, round(avg((s00 > s10 and s11 > s01)::int), 9) as text_score, round(avg((s00 > s01 and s11 > s10)::int), 9) as image_score, round(avg((s00 > s10 and s11 > s01 and s00 > s01 and s11 > s10)::int), 9) as group_score from w where s11 is not null",
    "ratio_divergence": f"with h as ({text.SQL['ratio_histogram']}) select a.lang, round(sum(a.density * ln(a.density / greatest(coalesce(b.density, 0), 1e-12))), 6) as kl from h a left join (select * from h where lang = 'en') b on a.bin = b.bin where a.lang <> 'en' group by a.lang",
    "first_wins": "select event_type, count(*) as n, round(avg(value), 6) as mean from (select user_id, event_type, arg_min(value, event_id) as value from events group by 1, 2) group by 1",
}
