"""Queries over labels, conversations and embeddings; samples and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chat, metrics, sampling, vectors
from ..sources.tables import table

ROLE = "You are a helpful assistant."


def _labelled(spark, sf_dir):
    """Labelled documents with a score any engine can reproduce: the label, blurred by a hash of the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.withColumn("score", F.round(F.col("quality") * 2.2 + 2.9 * sampling.fraction_of(F.col("doc_id"), 5), 6))


def label_scores(spark, sf_dir):
    held = _labelled(spark, sf_dir)
    return held.select("doc_id", "score", metrics.int_score(F.col("score")).alias("int_score"), (F.col("score") >= 3).alias("kept"))


def label_confusion(spark, sf_dir):
    held = _labelled(spark, sf_dir).withColumn("predicted", (metrics.int_score(F.col("score")) >= 3).cast("int"))
    return metrics.confusion(held, "quality", "predicted")


def label_metrics(spark, sf_dir):
    held = _labelled(spark, sf_dir).withColumn("predicted", (metrics.int_score(F.col("score")) >= 3).cast("int"))
    out = metrics.class_report(held, "quality", "predicted")
    return out.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def label_auc(spark, sf_dir):
    return metrics.roc_auc(_labelled(spark, sf_dir), "score", "quality", ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


def label_ndcg(spark, sf_dir):
    return metrics.ndcg(_labelled(spark, sf_dir), "source", "score", "quality", "doc_id").select("source", F.round("ndcg", 9).alias("ndcg"))


def label_folds(spark, sf_dir):
    """Five folds, stratified by label: counts of each."""
    held = sampling.hash_rank(_labelled(spark, sf_dir), "doc_id", ["quality"], 3).withColumn("fold", F.pmod("__rank", F.lit(5)).cast("int"))
    return held.groupBy("fold", "quality").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 3).alias("n_high"))


def domain_recall(spark, sf_dir):
    """Sources of which a tenth or more of the labelled documents score 2 or more, and their documents."""
    good = _labelled(spark, sf_dir).groupBy("source").agg(F.avg((F.col("score") >= 2).cast("double")).alias("share")).where("share >= 0.1")
    return table(spark, sf_dir, "documents").join(good.select("source"), "source", "left_semi").groupBy("source").agg(F.count("*").alias("n_docs"))


def score_summary(spark, sf_dir):
    held = _labelled(spark, sf_dir)
    return held.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.percentile("score", 0.5), 6).alias("median"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def conv_first_turn(spark, sf_dir):
    return chat.first_turn(_turns(spark, sf_dir))


def conv_messages(spark, sf_dir):
    held = chat.messages(_turns(spark, sf_dir))
    return held.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), 256).alias("chat_sha256"))


def conv_refusal_filter(spark, sf_dir):
    return chat.without_phrases(chat.messages(_turns(spark, sf_dir)), (*chat.REFUSALS, "the")).select("conv_id")


def conv_special_token_filter(spark, sf_dir):
    return chat.without_phrases(chat.messages(_turns(spark, sf_dir)), chat.SPECIAL_TOKENS, None).select("conv_id")


def conv_turn_stats(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.length("text")).alias("n_chars"), F.max("turn").alias("last_turn"))


def conv_prompt(spark, sf_dir):
    held = chat.first_turn(_turns(spark, sf_dir)).withColumn("p", chat.prompt(ROLE, F.col("instruction")))
    return held.select("conv_id", F.element_at("p", 1)["role"].alias("first_role"), F.element_at("p", 2)["content"].alias("user"))


def conv_anls(spark, sf_dir):
    """Each assistant turn, whole, against the user turn before it and the one before that, by edit distance over characters."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    held = _turns(spark, sf_dir).withColumn("asked", F.lag("text").over(line)).withColumn("before", F.lag("text", 2).over(line)).where("role = 'assistant' and asked is not null")
    return held.select("conv_id", "turn", F.round(metrics.anls(F.col("text"), F.array("asked", F.coalesce("before", "asked"))), 9).alias("anls"))


def vqa_scores(spark, sf_dir):
    """Answers drawn by hash: agreement with the others, and numbers within five percent."""
    held = _labelled(spark, sf_dir)
    answer = lambda seed: F.floor(sampling.fraction_of(F.col("doc_id"), seed) * 3).cast("int").cast("string")
    answers = F.array(*[answer(s) for s in range(11, 16)])
    return held.select("doc_id", F.round(metrics.vqa_accuracy(answer(20), answers), 9).alias("vqa"), metrics.relaxed_accuracy(answer(20), answers).alias("relaxed"))


def topk_similar(spark, sf_dir):
    found = vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, "vec_id", "embedding", 5)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_label_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = vectors.top_k(e, F.col("vec_id") % 100 == 0, "vec_id", "embedding", 5)
    votes = near.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("voted"))
    return best.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")


def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(vectors.norm(F.col("u")), 6).alias("norm"))


def centroid_by_label(spark, sf_dir):
    return vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


def _sky(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.pmod(at(1) * 90 + 180, F.lit(360.0)).alias("ra"), (F.pmod(at(2) * 90, F.lit(160.0)) - 80).alias("dec"))


def sky_crossmatch(spark, sf_dir):
    """The nearest of the odd points within two degrees of each even one."""
    sky = _sky(spark, sf_dir)
    found = vectors.crossmatch(sky.where("vec_id % 2 = 0"), sky.where("vec_id % 2 = 1"), "vec_id", radius=2.0)
    return found.select("vec_id", "match_id", F.round("distance", 6).alias("distance"))


def sky_unmatched(spark, sf_dir):
    sky = _sky(spark, sf_dir)
    return vectors.crossmatch(sky.where("vec_id % 2 = 0"), sky.where("vec_id % 2 = 1"), "vec_id", radius=2.0, how="anti").select("vec_id")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_docs(spark, sf_dir), "doc_id", "lang").groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def hash_split(spark, sf_dir):
    return sampling.hash_split(_docs(spark, sf_dir), "doc_id", 0.1).select("doc_id", "split")


def sample_percent(spark, sf_dir):
    """A tenth of each source, in hash order."""
    return sampling.sample(_docs(spark, sf_dir), "random:10%", "doc_id", "source").select("doc_id", "source")


def sample_ends(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return sampling.sample(d, "first:2", "doc_id", "source").unionByName(sampling.sample(d, "end:2", "doc_id", "source")).select("doc_id", "source")


def contiguous_shards(spark, sf_dir):
    out = sampling.contiguous_shards(_docs(spark, sf_dir), "doc_id", 90)
    return out.groupBy("shard_id", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def mixture_quota(spark, sf_dir):
    out = sampling.quotas(_docs(spark, sf_dir), "source", {"src0": 5.0, "src1": 2.0, "src2": 0.5})
    return out.select("source", "n", "weight", F.round("share", 9).alias("share"), "n_shards")


def mixture_overview(spark, sf_dir):
    """Counts by language and source with subtotals, and each one's percentage of all."""
    out = _docs(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.grouping_id().cast("int").alias("level"))
    total = _docs(spark, sf_dir).agg(F.count("*").alias("t"))
    return out.join(F.broadcast(total)).select("lang", "source", "n", "n_chars", "level", F.round(F.col("n") * 100 / F.col("t"), 6).alias("percent"))


def pack_next_fit(spark, sf_dir):
    return sampling.pack_next_fit(_docs(spark, sf_dir), "source", "doc_id", "n_chars", 4096)


def pack_first_fit(spark, sf_dir):
    return sampling.pack_first_fit(_docs(spark, sf_dir), "source", "doc_id", "n_chars", 4096)


QUERIES = {f.__name__: f for f in (label_scores, label_confusion, label_metrics, label_auc, label_ndcg, label_folds, domain_recall, score_summary, conv_first_turn, conv_messages, conv_refusal_filter, conv_special_token_filter, conv_turn_stats, conv_prompt, conv_anls, vqa_scores, topk_similar, knn_label_vote, l2_normalize, centroid_by_label, sky_crossmatch, sky_unmatched, stratified_split, hash_split, sample_percent, sample_ends, contiguous_shards, mixture_quota, mixture_overview, pack_next_fit, pack_first_fit)}


def _u(seed, key="doc_id"):
    return f"(('0x' || substr(sha256('{seed}:' || {key}::varchar), 1, 13))::bigint / 4503599627370496.0::double)"


_L = f"with l as (select doc_id, source, lang, n_chars, quality, toxic, round(quality * 2.2 + 2.9 * {_u(5)}, 6) as score from documents join labels using (doc_id)), p as (select *, (round_even(greatest(0, least(score, 5)), 0) >= 3)::int as predicted from l) "
_SKY = "with s as (select vec_id, radians((((embedding[1]::double * 90 + 180) % 360) + 360) % 360) as a, radians(((((embedding[2]::double * 90) % 160) + 160) % 160) - 80) as d from embeddings), u as (select vec_id, cos(d) * cos(a) as x, cos(d) * sin(a) as y, sin(d) as z from s), m as (select a.vec_id, b.vec_id as match_id, degrees(2 * asin(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2)) as distance from u a join u b on a.vec_id % 2 = 0 and b.vec_id % 2 = 1) "
_COS = "with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), c as (select query_id, vec_id, label, list_dot_product(q.e, b.embedding::double[]) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(b.embedding::double[], b.embedding::double[])) as s from q join embeddings b on q.query_id <> b.vec_id), r as (select *, row_number() over (partition by query_id order by round(s, 12) desc, vec_id) as rank from c) "
_PICK = "floor({} * 3)::int::varchar"

SQL = {
    "label_scores": _L + "select doc_id, score, round_even(greatest(0, least(score, 5)), 0)::int as int_score, score >= 3 as kept from l",
    "label_confusion": _L + "select quality, predicted, count(*) as n from p group by quality, predicted",
    "label_metrics": _L + ", c as (select c as class, count(*) filter (where quality = c and predicted = c) as hit, count(*) filter (where predicted = c) as said, count(*) filter (where quality = c) as support from p, (values (0), (1)) v(c) group by c), r as (select *, case when said > 0 then hit / said else 0 end as pr, case when support > 0 then hit / support else 0 end as rc from c) select class, support::bigint as support, round(pr, 9) as precision, round(rc, 9) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9) as f1 from r where support + said > 0",
    "label_auc": _L + "select lang, round(case when count(*) filter (where quality = 1) * count(*) filter (where quality = 0) > 0 then sum(case when quality = 1 then below + (same / 2.0) end) / (count(*) filter (where quality = 1) * count(*) filter (where quality = 0)) end, 9) as auc from (select *, (select count(*) from l m where m.lang = l.lang and m.quality = 0 and m.score < l.score) as below, (select count(*) from l m where m.lang = l.lang and m.quality = 0 and m.score = l.score) as same from l) group by lang",
    "label_ndcg": _L + ", r as (select *, row_number() over (partition by source order by score desc, doc_id) as i, row_number() over (partition by source order by quality desc, doc_id) as j from l) select source, round(case when sum(quality / log2(j + 1)) > 0 then sum(quality / log2(i + 1)) / sum(quality / log2(j + 1)) else 0 end, 9) as ndcg from r group by source",
    "label_folds": _L + ", f as (select *, row_number() over (partition by quality order by sha256('3:' || doc_id::varchar), doc_id) % 5 as fold from l) select fold::int as fold, quality, count(*) as n, count(*) filter (where score >= 3) as n_high from f group by fold, quality",
    "domain_recall": _L + "select source, count(*) as n_docs from documents where source in (select source from l group by source having avg((score >= 2)::int) >= 0.1) group by source",
    "score_summary": _L + "select quality, count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, min(score) as least, max(score) as most, round(quantile_cont(score, 0.5), 6) as median from l group by quality",
    "conv_first_turn": "select conv_id, arg_min(text, turn) as instruction from conversations where role = 'user' group by conv_id",
    "conv_messages": "select conv_id, count(*) as n_messages, sha256(string_agg(role || ': ' || text, chr(10) order by turn, role, text)) as chat_sha256 from conversations group by conv_id",
    "conv_refusal_filter": "select conv_id from conversations group by conv_id having count(*) filter (where role = 'assistant' and (contains(lower(text), 'language model') or contains(lower(text), 'sorry') or contains(lower(text), 'openai') or contains(lower(text), 'the'))) = 0",
    "conv_special_token_filter": "select conv_id from conversations group by conv_id having count(*) filter (where " + " or ".join(f"contains(lower(text), '{t}')" for t in chat.SPECIAL_TOKENS) + ") = 0",
    "conv_turn_stats": "select role, count(*) as n_turns, count(distinct conv_id) as n_conversations, sum(length(text))::bigint as n_chars, max(turn) as last_turn from conversations group by role",
    "conv_prompt": "select conv_id, 'system' as first_role, arg_min(text, turn) as user from conversations where role = 'user' group by conv_id".replace("as user", 'as "user"'),
    "vqa_scores": _L + f", a as (select doc_id, {_PICK.format(_u(20))} as p, [{', '.join(_PICK.format(_u(s)) for s in range(11, 16))}] as a from l), m as (select *, len(list_filter(a, lambda x: x = p)) as m from a) select doc_id, round(list_sum(list_transform(a, lambda x: least(1.0::double, (m - (x = p)::int) / 3))) / 5, 9) as vqa, (case when a[1] = '0' then p = '0' else abs(p::double - a[1]::double) / a[1]::double < 0.05 end)::int::double as relaxed from m",
    "topk_similar": _COS + "select query_id, rank::int as rank, vec_id, round(s, 6) as score from r where rank <= 5",
    "knn_label_vote": _COS + ", v as (select query_id, label, count(*) as n from r where rank <= 5 group by query_id, label), b as (select query_id, label as voted, row_number() over (partition by query_id order by n desc, label) as i from v) select b.query_id, voted, e.label from b join embeddings e on e.vec_id = b.query_id where i = 1",
    "l2_normalize": "with n as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select vec_id, round(e[1] / n, 6) as first, round(e[len(e)] / n, 6) as last, round(1.0::double, 6) as norm from n",
    "centroid_by_label": "select label, (pos - 1)::int as pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos",
    "sky_crossmatch": _SKY + "select u.vec_id, b.match_id, round(b.distance, 6) as distance from u left join (select vec_id, arg_min(match_id, distance) as match_id, min(distance) as distance from m where distance <= 2 group by vec_id) b on u.vec_id = b.vec_id where u.vec_id % 2 = 0",
    "sky_unmatched": _SKY + "select vec_id from u where vec_id % 2 = 0 and vec_id not in (select vec_id from m where distance <= 2)",
    "stratified_split": "with r as (select *, row_number() over (partition by lang order by sha256('42:' || doc_id::varchar), doc_id) as i, count(*) over (partition by lang) as c from documents) select lang, case when i <= floor(c * 0.1 + 0.5) then 'test' else 'train' end as split, count(*) as n, sum(doc_id)::bigint as ids from r group by 1, 2",
    "hash_split": f"select doc_id, case when {_u(0)} < 0.1 then 'val' else 'train' end as split from documents",
    "sample_percent": "with r as (select doc_id, source, row_number() over (partition by source order by sha256('0:' || doc_id::varchar), doc_id) as i, greatest(1, ceil(count(*) over (partition by source) * 10 / 100)) as m from documents) select doc_id, source from r where i <= m",
    "sample_ends": "with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as i, row_number() over (partition by source order by doc_id desc) as j from documents) select doc_id, source from r where i <= 2 union all select doc_id, source from r where j <= 2",
    "contiguous_shards": "with r as (select doc_id, (row_number() over (order by doc_id) - 1) // 90 as shard_id from documents) select shard_id::bigint as shard_id, case when shard_id < 2 then 'valid' else 'train' end as split, count(*) as n, min(doc_id) as first, max(doc_id) as last from r group by shard_id",
    "mixture_quota": "with c as (select source, count(*) as n, case source when 'src0' then 5.0 when 'src1' then 2.0 when 'src2' then 0.5 else 1.0 end::double as weight from documents group by source) select source, n, weight, round(weight / sum(weight) over (), 9) as share, floor(max(weight) over () / weight)::bigint as n_shards from c",
    "mixture_overview": "select lang, source, count(*) as n, sum(n_chars)::bigint as n_chars, grouping_id(lang, source)::int as level, round(count(*) * 100 / (select count(*) from documents), 6) as percent from documents group by rollup(lang, source)",
    "pack_next_fit": "with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as i from documents), p as (select source, doc_id, i, n_chars as used, 0::bigint as bin, 0::bigint as \"offset\" from o where i = 1 union all select o.source, o.doc_id, o.i, case when p.used + o.n_chars > 4096 then o.n_chars else p.used + o.n_chars end, case when p.used + o.n_chars > 4096 then p.bin + 1 else p.bin end, case when p.used + o.n_chars > 4096 then 0 else p.used end from p join o on o.source = p.source and o.i = p.i + 1) select source, doc_id, bin, \"offset\" from p",
}
