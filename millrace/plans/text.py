"""Queries over documents: statistics, ratios and quality filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratios
from ..functions.words import SPECIAL, normalise, split_words, words
from ..operators import quality
from ..sources.tables import table

WORDS = rf"list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(@, ''), '[ \n\t]'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(lower(x), '^[{SPECIAL}]+', ''), '[{SPECIAL}]+$', '')), lambda x: x <> '')"
TEXT_WORDS, P_WORDS = WORDS.replace("@", "text"), WORDS.replace("@", "p")


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(set(items))) + "]"


def _share(of: str, listed) -> str:
    return f"case when len({of}) > 0 then len(list_filter({of}, lambda x: list_contains({_list(listed)}, x))) / len({of}) else 0 end"


def _special(text: str) -> str:
    return f"case when length({text}) > 0 then (length({text}) - length(regexp_replace({text}, '[{SPECIAL}]', '', 'g'))) / length({text}) else 0 end"


def _punctuation(text: str, least: int) -> str:
    tokens = f"regexp_extract_all(coalesce({text}, ''), '{ratios.PUNCTUATED.replace(chr(39), chr(39) * 2)}')"
    return f"case when len({tokens}) < {least} then 1.0 when len({tokens}) > 0 then len(list_filter({tokens}, lambda x: regexp_full_match(x, '[,;:?!.]'))) / len({tokens}) else 0 end"


def _passes(text: str, tokens: str, limits) -> str:
    return f"(len({tokens}) >= {limits.least_words} and len({tokens}) <= {limits.most_words} and {_special(text)} <= {limits.most_special} and {_share(tokens, limits.flagged_words)} <= {limits.most_flagged} and {_share(tokens, limits.stop_words)} >= {limits.least_stop} and {_punctuation(text, limits.punctuation_from)} >= {limits.least_punctuation} and {_word_repetition(tokens)} <= {limits.most_word_repetition})"


def _word_repetition(tokens: str, n: int = 5) -> str:
    grams = f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"
    return f"case when len({tokens}) >= {n} then (select coalesce(sum(c) filter (where c > 1), 0) / sum(c) from (select count(*) as c from (select unnest({grams}) as g) group by g)) else 0 end"


def _char_repetition(rows: str, key: str, text: str, n: int = 10) -> str:
    """A table expression: the key and the character repetition of each row."""
    return (
        f"(select {key}, coalesce(sum(c) filter (where place <= least(floor(sqrt(n)), n - ones)) / sum(c), 0) as char_repetition from "
        f"(select *, count(*) over (partition by {key}) as n, count(*) filter (where c = 1) over (partition by {key}) as ones, row_number() over (partition by {key} order by c desc) as place from "
        f"(select {key}, g, count(*) as c from (select {key}, substring({text}, i, {n}) as g from (select {key}, {text}, unnest(range(1, length({text}) - {n - 2})) as i from {rows})) group by {key}, g)) group by {key})"
    )


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def doc_word_stats(spark, sf_dir):
    held = _docs(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w"))
    length = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    return held.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), length.cast("long").alias("n_letters"), F.round(ratios.unigram_repetition(F.col("w")), 9).alias("repetition"))


def _ratio(name, of, digits=9):
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).withColumn("w", words(F.col("text"))).select("doc_id", F.round(of(), digits).alias(name))

    return run


def doc_char_rep(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(ratios.character_repetition(10)("text"), 9).alias("char_repetition"))


def doc_word_rep(spark, sf_dir):
    held = _docs(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w"))
    return held.select("doc_id", F.round(ratios.word_repetition_of(F.col("w"), 5), 9).alias("word_repetition"))


def doc_common_word_ratio(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = quality.common_word_ratio(docs, quality.OWN, "doc_id")
    return found.select("doc_id", F.round("common_ratio", 9).alias("common_ratio"))


def common_word_counts(spark, sf_dir):
    return quality.common_words(_docs(spark, sf_dir), least=2)


def doc_quality_filter(spark, sf_dir):
    """All tests of the recipe; the dictionary of common words is the corpus's own."""
    docs = _docs(spark, sf_dir)
    return quality.filter_documents(docs, key="doc_id", common=quality.OWN).select("doc_id", "lang", "source", "n_chars")


def doc_quality_by_lang(spark, sf_dir):
    held = _docs(spark, sf_dir).select("lang", quality.text_passes(F.col("text"), quality.DOCUMENT).alias("ok"))
    return held.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("ok").alias("n_kept"))


def para_quality_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    kept = quality.filter_paragraphs(docs, sep="\n", marker="END_OF_DOCUMENT_TOKEN_TO_BE_REPLACED", key="doc_id", common=quality.OWN)
    return kept.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs"))


def spam_paragraph_filter(spark, sf_dir):
    kept = quality.drop_spam_paragraphs(_docs(spark, sf_dir).select("doc_id", "text"), sep="\n")
    return kept.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs"))


def doc_normalised(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), r"\p{Nd}", "0"), 256).alias("zeroed_sha256"), F.size(split_words(F.col("text"))).cast("long").alias("n_pieces"), F.length(normalise(F.col("text"), spaces=False, punctuation=False, unprintable=True)).cast("long").alias("n_printable"))


def threshold_report(spark, sf_dir):
    """How many documents each limit alone rejects: for tuning."""
    held = _docs(spark, sf_dir).withColumn("w", words(F.col("text")))
    limits = quality.DOCUMENT
    tests = {"words": (F.size("w") < limits.least_words) | (F.size("w") > limits.most_words), "special": ratios.special_ratio(F.col("text")) > limits.most_special, "stop": ratios.listed_ratio(F.col("w"), limits.stop_words) < limits.least_stop, "flagged": ratios.listed_ratio(F.col("w"), limits.flagged_words) > limits.most_flagged}
    return held.agg(F.count("*").alias("n_docs"), *[F.count_if(c).alias(f"by_{k}") for k, c in tests.items()])


def ratio_histogram(spark, sf_dir):
    """Forty equal bins of the stop-word ratio with their density, by language."""
    held = _docs(spark, sf_dir).withColumn("w", words(F.col("text"))).select("lang", F.least(F.floor(F.round(ratios.listed_ratio(F.col("w"), ratios.STOP_WORDS), 9) * 40), F.lit(39)).cast("long").alias("bin"))
    total = held.groupBy("lang").agg(F.count("*").alias("total"))
    return held.groupBy("lang", "bin").agg(F.count("*").alias("n")).join(total, "lang").select("lang", "bin", "n", F.round(F.col("n") * 40 / F.col("total"), 9).alias("density"))


QUERIES = {
    "doc_word_stats": doc_word_stats,
    "doc_special_ratio": _ratio("special_ratio", lambda: ratios.special_ratio(F.col("text"))),
    "doc_stopword_ratio": _ratio("stop_ratio", lambda: ratios.listed_ratio(F.col("w"), ratios.STOP_WORDS)),
    "doc_flagged_ratio": _ratio("flagged_ratio", lambda: ratios.listed_ratio(F.col("w"), ratios.FLAGGED_WORDS)),
    "doc_punct_ratio": _ratio("punctuation_ratio", lambda: ratios.punctuation_ratio(F.col("text"), 12)),
    "doc_common_word_ratio": doc_common_word_ratio,
    "common_word_counts": common_word_counts,
    "doc_char_rep": doc_char_rep,
    "doc_word_rep": doc_word_rep,
    "doc_quality_filter": doc_quality_filter,
    "doc_quality_by_lang": doc_quality_by_lang,
    "para_quality_filter": para_quality_filter,
    "spam_paragraph_filter": spam_paragraph_filter,
    "doc_normalised": doc_normalised,
    "threshold_report": threshold_report,
    "ratio_histogram": ratio_histogram,
}

_W = f"with d as (select *, {TEXT_WORDS} as w from documents) "
_D, _P = quality.DOCUMENT, quality.PARAGRAPH
_PARAGRAPHS = "with p as (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), "

SQL = {
    "doc_word_stats": _W + "select doc_id, len(w)::bigint as n_words, len(list_distinct(w))::bigint as n_distinct, length(array_to_string(w, ''))::bigint as n_letters, round(case when len(w) > 0 then 1 - len(list_distinct(w)) / len(w) else 0 end, 9) as repetition from d",
    "doc_special_ratio": f"select doc_id, round({_special('text')}, 9) as special_ratio from documents",
    "doc_stopword_ratio": _W + f"select doc_id, round({_share('w', ratios.STOP_WORDS)}, 9) as stop_ratio from d",
    "doc_flagged_ratio": _W + f"select doc_id, round({_share('w', ratios.FLAGGED_WORDS)}, 9) as flagged_ratio from d",
    "doc_punct_ratio": f"select doc_id, round({_punctuation('text', 12)}, 9) as punctuation_ratio from documents",
    "doc_common_word_ratio": _W + ", e as (select doc_id, unnest(w) as word from d), c as (select word from e group by word having count(*) >= 2), r as (select e.doc_id, count(c.word) / count(*) as r from e left join c on e.word = c.word group by e.doc_id) select d.doc_id, round(coalesce(r, 0), 9) as common_ratio from d left join r on d.doc_id = r.doc_id",
    "common_word_counts": _W + ", e as (select unnest(w) as word from d) select word, count(*) as n from e group by word having count(*) >= 2",
    "doc_word_rep": _W + ", g as (select doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)), c as (select doc_id, g, count(*) as n from g group by doc_id, g), r as (select doc_id, coalesce(sum(n) filter (where n > 1), 0) / sum(n) as r from c group by doc_id) select d.doc_id, round(coalesce(r, 0), 9) as word_repetition from d left join r on d.doc_id = r.doc_id",
    "doc_char_rep": f"select d.doc_id, round(coalesce(char_repetition, 0), 9) as char_repetition from documents d left join {_char_repetition('documents', 'doc_id', 'text')} r on d.doc_id = r.doc_id",
    "doc_quality_filter": _W + f", e as (select doc_id, unnest(w) as word from d), c as (select word from e group by word having count(*) >= 2), r as (select e.doc_id, count(c.word) / count(*) as r from e left join c on e.word = c.word group by e.doc_id), "
    f"k as (select * from d where {_passes('text', 'w', _D)}) select k.doc_id, lang, source, n_chars from k left join {_char_repetition('k', 'doc_id', 'text')} x on k.doc_id = x.doc_id left join r on k.doc_id = r.doc_id "
    f"where coalesce(char_repetition, 0) <= {_D.most_char_repetition} and coalesce(r, 0) >= {_D.least_common}",
    "doc_quality_by_lang": _W + f"select lang, count(*) as n_docs, count(*) filter (where {_passes('text', 'w', _D)}) as n_kept from d group by lang",
    "para_quality_filter": _PARAGRAPHS + f"w as (select *, doc_id || '/' || i as pk, {P_WORDS} as w from p), c as (select word from (select unnest(w) as word from w) group by word having count(*) >= 2), "
    f"e as (select pk, unnest(w) as word from w), r as (select e.pk, count(c.word) / count(*) as r from e left join c on e.word = c.word group by e.pk), "
    f"o as (select * from w where {_passes('p', 'w', _P)}), x as {_char_repetition('o', 'pk', 'p')}, "
    f"k as (select o.* from o left join x on o.pk = x.pk left join r on o.pk = r.pk where coalesce(char_repetition, 0) <= {_P.most_char_repetition} and coalesce(r, 0) >= {_P.least_common} "
    "union select * from w where p = 'END_OF_DOCUMENT_TOKEN_TO_BE_REPLACED') select doc_id, sha256(string_agg(p, chr(10) order by i)) as text_sha256, count(*) as n_paragraphs from k group by doc_id",
    "spam_paragraph_filter": _PARAGRAPHS + f"w as (select *, {P_WORDS} as w from p), k as (select * from w where {_share('w', quality.SPAM_WORDS)} < 0.12) select doc_id, sha256(string_agg(p, chr(10) order by i)) as text_sha256, count(*) as n_paragraphs from k group by doc_id",
    "doc_normalised": r"select doc_id, sha256(regexp_replace(lower(text), '\p{Nd}', '0', 'g')) as zeroed_sha256, len(list_filter(regexp_split_to_array(text, '[ \n\t]'), lambda x: x <> ''))::bigint as n_pieces, length(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'))::bigint as n_printable from documents",
    "threshold_report": _W + f"select count(*) as n_docs, count(*) filter (where len(w) < {_D.least_words} or len(w) > {_D.most_words}) as by_words, count(*) filter (where {_special('text')} > {_D.most_special}) as by_special, count(*) filter (where {_share('w', _D.stop_words)} < {_D.least_stop}) as by_stop, count(*) filter (where {_share('w', _D.flagged_words)} > {_D.most_flagged}) as by_flagged from d",
    "ratio_histogram": _W + f", b as (select lang, least(floor(round({_share('w', ratios.STOP_WORDS)}, 9) * 40), 39)::bigint as bin from d) select lang, bin, count(*) as n, round(count(*) * 40 / sum(count(*)) over (partition by lang), 9) as density from b group by lang, bin",
}
