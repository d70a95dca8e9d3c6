"""Queries of text rules, answers, constraints, numbers and arrays, over tables and over small literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, texts
from ..functions.words import words
from ..operators import chat, dedup, images, metrics, mixture, sampling, shapes, vectors
from ..sources.shared import materialize
from ..sources.tables import table

#: Small tables that the test data lacks: columns with their types, and rows.
LITERALS = {
    "articles": ("id int, t string", [(1, "LONDON (News) -- The body. E-mail to a friend . More"), (2, "No dateline here"), (3, "A -- b -- c"), (4, ""), (5, None)]),
    "summaries": ("id int, t string", [(1, "Summary: one\ntwo Highlights: three"), (2, " summary one HIGHLIGHTS two "), (3, "Highlights: x Summary: y"), (4, "nothing"), (5, None)]),
    "sayings": ("id int, t string", [(1, "Really?. Yes!. No:. "), (2, "fine"), (3, " what is it?"), (4, ""), (5, "a. B"), (6, None)]),
    "codes": ("id int, t string", [(1, "x```html\n<body>a</body>```y```css\np {\n}```z"), (2, "```a```"), (3, "a```b```c```\nq\nr { }```d"), (4, None)]),
    "problems": ("id int, t string", [(1, "So 4+4=8 #### 1,234"), (2, "no gold"), (3, "#### 7 "), (4, None)]),
    "clozes": ("id int, t string", [(1, "Fry [title] Heat  oil [step] now"), (2, "plain"), (3, "[a]b[c]"), (4, None)]),
    "names": ("id int, t string", [(1, "img_0042-a.jpg"), (2, "b_a.png"), (3, "a-b.txt"), (4, "17.20"), (5, "x"), (6, None)]),
    "questions": ("id int, o array<string>, a string", [(1, ["red", "blue"], "blue"), (2, ["x"], "y"), (3, ["a", "b", "a"], "a"), (4, [], "a")]),
    "grids": ("id int, h array<string>, r array<array<string>>", [(1, ["a", "b"], [["1", "2"], ["3", "4"]]), (2, ["x"], []), (3, ["k"], [["v"]])]),
    "solutions": ("id int, t string", [(1, "thus \\boxed{\\frac{1}{2}} done"), (2, "The answer is 1,234."), (3, "we get 3 then 5.0"), (4, "x = \\boxed{x = 12\\%}"), (5, "none"), (6, "\\boxed{\\text{yes}}"), (7, "answer is $7$."), (8, "\\boxed{\\sqrt2}")]),
    "answers": ("id int, t string", [(1, "The Cat, sat!"), (2, "two dogs and a bird"), (3, " None "), (4, ""), (5, None)]),
    "calls": ("id int, t string", [(1, "a<tool_call>{x}</tool_call>b<tool_call>y\nz</tool_call>"), (2, "none"), (3, "<tool_call></tool_call>"), (4, None)]),
    "verdicts": ("id int, t string", [(1, "safe"), (2, " unsafe\nS14"), (3, "unsafe S2 and more"), (4, "unsafe S15"), (5, "unclear"), (6, None)]),
    "instructions": (
        "id int, ids array<string>, kwargs string, response string",
        [
            (1, ["punctuation:no_comma"], "[{}]", "no commas here"),
            (2, ["punctuation:no_comma", "punctuation:no_comma"], "[{}, {}]", "a"),
            (3, ["change_case:english_capital", "change_case:english_lowercase"], "[{}, {}]", "a"),
            (4, ["length_constraints:number_words", "punctuation:no_comma"], '[{"num_words": 3, "relation": "at least"}, {}]', "one two three"),
            (5, ["length_constraints:number_words"], '[{"num_words": 3, "relation": "less than"}]', "one two three"),
            (6, ["startend:quotation", "detectable_format:title"], "[{}, {}]", '"x"'),
            (7, ["keywords:existence"], '[{"keywords": ["Alpha"]}]', "an alpha beta"),
            (8, ["combination:two_responses", "punctuation:no_comma"], "[{}, {}]", "a ****** b"),
            (9, ["detectable_format:json_format"], "[{}]", '```json\n{"a": 1}\n```'),
            (10, ["keywords:existence"], "[{}]", "lacks an argument"),
            (11, ["keywords:existence"], "not json", "x"),
        ],
    ),
    "arguments": ("id int, kwargs string", [(1, '{"a": 1}'), (2, "[1]"), (3, "{bad"), (4, ""), (5, None), (6, '{"b": "x", "c": null}')]),
    "replies": ("id int, p string, r string", [(1, "the cat sat", "the cat sat on the mat"), (2, "", "a"), (3, "a b c d e", "a b c d e"), (4, "x y", "y x")]),
    "openings": ("id int, t string, a array<string>", [(1, "So the answer is 12.", ["12"]), (2, "It is blue", ["Blue"]), (3, "about 3.14159", ["3.14"]), (4, "no", ["yes"]), (5, None, ["x"])]),
    "stars": ("id int, z double, warned boolean", [(1, 0.5, False), (2, float("nan"), False), (3, 1.5, True), (4, float("inf"), None), (5, 2.5, None), (6, None, False)]),
    "clips": ("id int, kind string, seconds double", [(1, "image", None), (2, "video", 5.0), (3, "video", 59.9), (4, "video", 60.0), (5, "video", 900.0), (6, "video", None)]),
    "pixels": ("id int, order_a int, pixel_a bigint, order_b int, pixel_b bigint", [(1, 6, 9145, 5, 2286), (2, 6, 9145, 8, 146320), (3, 6, 9145, 6, 9145), (4, 6, 9145, 6, 9146), (5, 6, 9145, 5, 2287), (6, 5, 0, 7, 15), (7, 5, 0, 7, 16)]),
}


def _literal(spark, name):
    columns, rows = LITERALS[name]
    return spark.createDataFrame(rows, columns)


def _sql(name):
    """The table in SQL."""

    def shown(x):
        if isinstance(x, list):
            return "[" + ", ".join(map(shown, x)) + "]"
        if x is None:
            return "null"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, float) and (x != x or abs(x) == float("inf")):
            return f"'{x}'::double"
        return str(x).lower() if isinstance(x, bool) else str(x)

    columns, rows = LITERALS[name]
    kinds = {"string": "varchar", "array<string>": "varchar[]", "array<array<string>>": "varchar[][]"}
    named = [c.split(" ", 1) for c in columns.split(", ")]
    cast = ", ".join(f"{c}::{kinds.get(k, k)} as {c}" for c, k in named)
    return f"(select {cast} from (values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") as v({', '.join(c for c, _ in named)}))"


# Texts


def text_articles(spark, sf_dir):
    return _literal(spark, "articles").select("id", texts.after_dateline(F.col("t")).alias("body"))


def text_sections(spark, sf_dir):
    found = _literal(spark, "summaries").withColumn("s", texts.two_sections(F.col("t"), "summary", "highlights"))
    return found.select("id", "s.first", "s.second")


def text_ends(spark, sf_dir):
    return _literal(spark, "sayings").select("id", texts.repaired_ends(F.col("t")).alias("repaired"), texts.bad_ends(F.col("t")).cast("long").alias("n_bad"), texts.sentence(F.col("t")).alias("sentence"))


def text_code(spark, sf_dir):
    return _literal(spark, "codes").withColumn("c", texts.code_blocks(F.col("t"))).select("id", "c.html", "c.css", "c.body")


def text_gold(spark, sf_dir):
    return _literal(spark, "problems").select("id", texts.gold_answer(F.col("t")).alias("gold"))


def text_cloze(spark, sf_dir):
    return _literal(spark, "clozes").select("id", texts.cloze_text(F.col("t")).alias("cloze"))


def text_shared_keys(spark, sf_dir):
    """Names of one object meet by the key they share."""
    keyed = _literal(spark, "names").select("id", texts.shared_key(F.col("t")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def text_choices(spark, sf_dir):
    return _literal(spark, "questions").withColumn("c", texts.choices(F.col("o"), F.col("a"))).select("id", "c.lines", "c.letter")


def text_tables(spark, sf_dir):
    return _literal(spark, "grids").select("id", texts.table_text(F.col("h"), F.col("r")).alias("lines"))


def text_answers(spark, sf_dir):
    return _literal(spark, "answers").select("id", metrics.normalise_answer(F.col("t")).alias("normal"))


def text_tool_calls(spark, sf_dir):
    calls = chat.tool_calls(F.col("t"))
    return _literal(spark, "calls").select("id", F.size(calls).cast("long").alias("n_calls"), F.array_join(calls, "|").alias("calls"))


def text_verdicts(spark, sf_dir):
    return _literal(spark, "verdicts").select("id", chat.guard_verdict(F.col("t")).alias("verdict"))


def math_answers(spark, sf_dir):
    f = F.udf(texts.final_answer, "string", useArrow=True)
    return _literal(spark, "solutions").select("id", f("t").alias("answer"))


def open_answers(spark, sf_dir):
    f = F.udf(texts.open_answer_correct, "boolean", useArrow=True)
    return _literal(spark, "openings").select("id", f("t", "a").alias("correct"))


def reply_scores(spark, sf_dir):
    rouge, bleu = F.udf(texts.rouge_l, "double", useArrow=True), F.udf(texts.bleu, "double", useArrow=True)
    return _literal(spark, "replies").select("id", F.round(rouge("p", "r"), 6).alias("rouge_l"), F.round(bleu("p", "r"), 6).alias("bleu"))


# Constraints


def constraint_conflicts(spark, sf_dir):
    return chat.conflict_free(_literal(spark, "instructions"), "ids").select("id")


def constraint_arguments(spark, sf_dir):
    return chat.parsed_kwargs(_literal(spark, "arguments")).select("id", F.size("kwargs_map").cast("long").alias("n_arguments"))


def constraint_strict(spark, sf_dir):
    return chat.strict_accuracy(_literal(spark, "instructions"), "response", "ids", "kwargs").select("id", "strict")


# Conversations and records


def conv_masked(spark, sf_dir):
    """Tokens of a conversation that are learned from: those of the assistant's turns."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(F.split("text", " ")).alias("n"))
    line = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n", "role"))).alias("s"))
    flags = chat.mask_roles(F.col("s.n"), F.col("s.role"))
    return line.select("conv_id", F.size(flags).cast("long").alias("n_tokens"), F.aggregate(flags, F.lit(0), lambda a, x: a + x).cast("long").alias("n_learned"))


def conv_merged(spark, sf_dir):
    """Turns of one conversation as one record of question and answer pairs."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    one = t.select("conv_id", "turn", F.array(F.struct(F.col("text").alias("user"), F.lit("").alias("assistant"), F.lit("s").alias("source"))).alias("texts"))
    merged = shapes.merged_turns(one, "conv_id", "turn")
    return merged.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("texts", lambda x: x["user"]), "|"), 256).alias("asked_sha256"))


def conv_fits(spark, sf_dir):
    """Records of at most 60 words without a picture token."""
    t = table(spark, sf_dir, "conversations")
    one = t.select("conv_id", "turn", F.array(F.struct(F.col("text").alias("user"), F.col("role").alias("assistant"))).alias("texts"))
    return shapes.fits(one, "texts", 60, ("<image>",), 400).select("conv_id", "turn")


def mails(spark, sf_dir):
    """A conversation's turns as mails, one row each."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("subject"), F.col("text").alias("body"))).alias("mails"))
    return shapes.exploded_mails(t).select("conv_id", F.sha2("text", 256).alias("text_sha256"))


def first_reply(spark, sf_dir):
    """The first reply, where there is one."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").alias("n"))))).alias("said"))
    return shapes.first_or_none(t, "said", "first").select("conv_id", F.col("first.turn").alias("turn"), F.col("first.n").cast("long").alias("n_chars"))


def decoded_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ids = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ids"))
    found = shapes.decoded(ids, "n_regionkey", "ids", n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return found.select("n_regionkey", F.array_join("names", ",").alias("names"))


def projected(spark, sf_dir):
    """Columns chosen, renamed, cast, added and numbered."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").withColumnRenamed("s_name", "name").withColumn("kind", F.lit("supplier"))
    from ..sources.sinks import with_position

    return with_position(s.withColumn("s_acctbal", F.col("s_acctbal").cast("int")), "s_suppkey").select("s_suppkey", "name", "s_acctbal", "kind", "position")


def zipped(spark, sf_dir):
    """Two tables side by side by position."""
    a = sampling.rank_all(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    b = sampling.rank_all(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return a.join(b, "rank").select("rank", "doc_id", "vec_id", "label")


def annotation_branches(spark, sf_dir):
    """Three annotations of the same documents, each by its own branch, joined again."""
    d = table(spark, sf_dir, "documents")
    a = d.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    b = d.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    c = d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")
    return a.join(b, "doc_id").join(c, "doc_id", "left")


def success_rates(spark, sf_dir):
    """Share of events with a positive value and counts, by type and by shard of ids."""
    e = table(spark, sf_dir, "events").withColumn("shard", F.col("event_id") % 4)
    return e.groupBy("event_type", "shard").agg(F.count("*").alias("n_done"), F.round(F.avg((F.col("value") > 10).cast("double")), 9).alias("rate"))


# Numbers and arrays


def vector_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("p", maths.softmax(F.col("v")))
    return e.select("vec_id", F.round(F.array_max("p"), 6).alias("most"), F.round(maths.entropy(F.col("p")), 6).alias("entropy"))


def vector_patches(spark, sf_dir):
    """Eight patches of eight, standardised, in spiral order of a 3 x 3 grid's first eight places."""
    order = [i for i in maths.spiral(3) if i < 8]
    e = table(spark, sf_dir, "embeddings").select("vec_id", maths.patches(F.col("embedding").cast("array<double>"), 8).alias("p"))
    line = maths.reordered(F.transform("p", lambda x: F.get(maths.standardised(x), F.lit(0))), order)
    return e.select("vec_id", *[F.round(F.get(line, F.lit(i)), 5).alias(f"p{i}") for i in range(8)])


def flux_scaled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = F.get("v", F.lit(0))
    a = maths.arcsinh_scaled(x, F.lit(0.01), 3.0)
    wave = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: i * 1000.0)
    nu = maths.per_frequency(F.transform("v", lambda y: y * 1e10), wave)
    return e.select("vec_id", F.round(a, 6).alias("scaled"), F.round(maths.flux_of(a, F.lit(0.01)), 6).alias("flux"), F.round(F.get(nu, F.lit(9)), 6).alias("tenth"))


def sizes_and_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"))
    k = F.col("p_partkey")
    return p.select("p_partkey", F.round(maths.length_weight(F.col("n"), "sample"), 9).alias("by_sample"), F.round(maths.length_weight(F.col("n"), "square"), 9).alias("by_root"), *[maths.to_multiple(k, 14, how).alias(f"by_{how}") for how in ("round", "ceil", "floor")], maths.gram_id(F.array(k % 50, k % 7, k % 11), 1000).alias("gram_id"), F.array_join(sampling.uniform_indices(k % 40 + 1, 5), ",").alias("indices"))


def clean_redshifts(spark, sf_dir):
    return _literal(spark, "stars").select("id", maths.clean_number(F.col("z"), F.col("warned")).alias("z"))


def video_fractions(spark, sf_dir):
    return _literal(spark, "clips").select("id", mixture.video_fraction(F.col("kind"), F.col("seconds"), [(10, 0.1), (60, 0.5), (600, 1.0)]).alias("share"))


def pixel_overlap(spark, sf_dir):
    return _literal(spark, "pixels").select("id", vectors.contains_pixel(F.col("order_a"), F.col("pixel_a"), F.col("order_b"), F.col("pixel_b")).alias("overlap"))


def pixel_split(spark, sf_dir):
    """Sky points by the ancestor of their pixel (here of an id as pixel of order 10) at order 6."""
    return sampling.pixel_split(table(spark, sf_dir, "events").select("event_id"), "event_id", 10, 6, 0.1).select("event_id", "split")


def image_difference(spark, sf_dir):
    """Difference hashes of 9 x 8 pixels (vectors, their start repeated), with how many pictures share one with the evaluation set (every tenth)."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.round(F.get("embedding", i % 64) * 3))
    h = table(spark, sf_dir, "embeddings").select("vec_id", images.difference_bits(grey).alias("bits"))
    held = h.where("vec_id % 10 = 0").select(F.col("bits").alias("b")).distinct()
    return h.join(held, F.col("bits") == F.col("b"), "left").select("vec_id", "bits", F.col("b").isNotNull().alias("in_evaluation"))


def image_hashes(spark, sf_dir):
    """Average, wavelet and perceptual hashes of pictures made of vectors; pictures that share all three are one."""
    pixels = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("embedding", i % 64).cast("double"))
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", images.hash_column(images.average_hash)(pixels(100)).alias("average"), images.hash_column(images.wavelet_hash)(pixels(64)).alias("wavelet"), images.hash_column(images.perceptual_hash)(pixels(1024)).alias("perceptual"))


def perplexity_filter(spark, sf_dir):
    """Documents whose perplexity under the corpus's own word frequencies is 1500 at most."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    counts = materialize(each.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    first, others = dedup.most_frequent(counts)
    # The most frequent words are summed up in the document's own task; only others are shuffled, as words, to meet their numbers.
    log = F.log10(F.col("n") / F.lit(total))
    met = each.join(F.broadcast(first), "w", "left").groupBy("doc_id", F.when(F.col("n").isNull(), F.col("w")).alias("w")).agg(F.sum(log).alias("s"), F.count("*").alias("k"))
    if others is not None:
        met = met.withColumn("w", F.coalesce("w", F.concat(F.lit(" "), "doc_id"))).join(others, "w", "left").withColumn("s", F.coalesce("s", F.col("k") * log))
    scored = met.groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum("k").alias("n_words"))
    found = scored.select("doc_id", maths.perplexity(F.array(F.round("s", 6)), F.array(F.col("n_words").cast("double"))).alias("perplexity"))
    return found.where("perplexity <= 1500")


def fuzzy_names(spark, sf_dir):
    """Supplier names, every third with a letter missing, looked up among all names by shared trigrams."""
    from ..operators import pairs

    n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    asked = n.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.expr("substring(s_name, 2)")).otherwise(F.col("s_name")).alias("asked"))
    return pairs.nearest_names(asked, n, "s_suppkey", "asked", "s_suppkey", "s_name")


def caption_first_word(spark, sf_dir):
    """The first word of each turn against the roles as references."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", metrics.first_word_match(F.concat(F.col("role"), F.lit("! "), F.col("text")), F.array(F.lit("User"), F.lit(" assistant "))).alias("matched"))


def packed_with_images(spark, sf_dir):
    """Documents in bins of 3000 characters and six pictures at most (here: of a hundred ids a group)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("g"), F.col("n_chars").alias("n"), (F.col("doc_id") % 4).alias("k"))
    return sampling.pack_first_fit(d, "g", "doc_id", "n", 3000, "k", 6)


def packed_whole(spark, sf_dir):
    """Whole documents up to 4000 characters behind one another, with positions and padding."""
    d = table(spark, sf_dir, "documents").where("n_chars <= 4000").select("doc_id", F.floor(F.col("doc_id") / 100).alias("g"), F.col("n_chars").alias("n"))
    return sampling.pack_whole(d, "g", "doc_id", "n", 4000)


def ridge_fit(spark, sf_dir):
    """A vector's last component from its first eight: the penalty chosen and the determination on rows never seen."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).alias(f"x{i}") for i in range(8)], (F.element_at("embedding", 1) * 2 + F.element_at("embedding", 64)).alias("y"))
    found = metrics.ridge_selected(e, "vec_id", [f"x{i}" for i in range(8)], "y")
    return spark.createDataFrame([(found["penalty"], round(found["r2"], 9), found["n_test"])], "penalty double, r2 double, n_test long")


QUERIES = {
    f.__name__: f
    for f in (
        fuzzy_names, caption_first_word, packed_with_images, packed_whole, ridge_fit,
        text_articles, text_sections, text_ends, text_code, text_gold, text_cloze, text_shared_keys, text_choices, text_tables, text_answers, text_tool_calls, text_verdicts, math_answers, open_answers, reply_scores,
        constraint_conflicts, constraint_arguments, constraint_strict, conv_masked, conv_merged, conv_fits, mails, first_reply, decoded_names, projected, zipped, annotation_branches, success_rates,
        vector_softmax, vector_patches, flux_scaled, sizes_and_weights, clean_redshifts, video_fractions, pixel_overlap, pixel_split, image_difference, image_hashes, perplexity_filter,
    )
}

from .text import TEXT_WORDS  # noqa: E402

_FENCED = "regexp_replace(string_split(t, '```')[{}], '^[A-Za-z]*\\n', '')"
_ANSWER = "trim(regexp_replace(regexp_replace({}, '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_DIGITS = "regexp_replace(lower(trim(t)), '[^\\p{L}\\p{N}\\s'']', ' ', 'g')"
for _word, _digit in [("zero", 0), ("none", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10)]:
    _DIGITS = f"regexp_replace({_DIGITS}, '\\b{_word}\\b', '{_digit}', 'g')"
_PATCH = "embedding[{a}:{b}]::double[]"


def _first_standard(i: int) -> str:
    """The first value of patch ``i``, standardised."""
    x = _PATCH.format(a=8 * i + 1, b=8 * i + 8)
    return f"round((list_extract({x}, 1) - list_avg({x})) / list_stddev_pop({x}), 5)"


SQL = {
    "text_articles": f"select id, trim(split_part(case when contains(t, '-- ') then substr(t, strpos(t, '-- ') + 3) else t end, ' E-mail to a friend', 1)) as body from {_sql('articles')}",
    "text_sections": "select id, case when hit then nullif(regexp_extract(t, p, 1), '') end as first, case when hit then nullif(regexp_extract(t, p, 2), '') end as second from (select *, regexp_matches(t, p) as hit from (select *, '(?is)^\\s*summary\\s*:?\\s*(.*?)\\s*highlights\\s*:?\\s*(.*?)\\s*$' as p from " + _sql("summaries") + "))",
    "text_ends": "select id, replace(replace(t, '?.', '?'), '!.', '?') as repaired, len(regexp_extract_all(t, '[?!:]\\.'))::bigint as n_bad, case when trim(t) = '' then '' else upper(trim(t)[1]) || trim(t)[2:] || case when trim(t)[-1] in ('.', '!', '?') then '' else '.' end end as sentence from " + _sql("sayings"),
    "text_code": f"select id, case when ok then {_FENCED.format(2)} end as html, case when ok then regexp_extract({_FENCED.format(4)}, '(?s)((?:^|\\n)[^\\n]*\\{{.*)$', 1).ltrim(chr(10)) end as css, case when ok then regexp_extract({_FENCED.format(2)}, '(?is)(<body.*</body>)', 1) end as body from (select *, len(string_split(t, '```')) = 5 as ok from {_sql('codes')})",
    "text_gold": f"select id, replace(trim(string_split(t, '####')[2]), ',', '') as gold from {_sql('problems')}",
    "text_cloze": f"select id, trim(regexp_replace(regexp_replace(replace(t, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  +', ' ', 'g')) as cloze from {_sql('clozes')}",
    "text_shared_keys": "select key, count(*) as n, min(id) as first_id from (select id, coalesce(list_filter(p, lambda x: regexp_full_match(x, '[0-9]+'))[1], array_to_string(list_sort(p), '_')) as key from (select id, list_filter(regexp_split_to_array(regexp_replace(t, '\\.[A-Za-z]+$', ''), '[-_.]'), lambda x: x <> '') as p from " + _sql("names") + ")) group by key",
    "text_choices": f"select id, array_to_string(list_transform(o, lambda x, i: chr(64 + i::int) || '. ' || x), chr(10)) as lines, case when list_position(o, a) > 0 then chr(64 + list_position(o, a)::int) end as letter from {_sql('questions')}",
    "text_tables": f"select id, '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) as lines from {_sql('grids')}",
    "text_answers": f"select id, {_ANSWER.format(_DIGITS)} as normal from {_sql('answers')}",
    "text_tool_calls": f"select id, len(c)::bigint as n_calls, array_to_string(c, '|') as calls from (select id, regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1) as c from {_sql('calls')})",
    "text_verdicts": f"select id, case when regexp_matches(t, '^\\s*safe\\b') then 'safe' when regexp_extract(t, '^\\s*unsafe\\s*(S(?:[1-9]|1[0-4]))\\b', 1) <> '' then 'unsafe ' || regexp_extract(t, '^\\s*unsafe\\s*(S(?:[1-9]|1[0-4]))\\b', 1) end as verdict from {_sql('verdicts')}",
    "math_answers": "select * from (values (1, '1/2'), (2, '1234'), (3, '5'), (4, '12'), (5, null), (6, 'yes'), (7, '7'), (8, '\\sqrt{2}')) as v(id, answer)",
    "open_answers": "select * from (values (1, true), (2, true), (3, true), (4, false), (5, false)) as v(id, correct)",
    "reply_scores": "select * from (values (1, 0.666667::double, 0.0::double), (2, 0, 0), (3, 1, 1), (4, 0.5, 0)) as v(id, rouge_l, bleu)",
    "constraint_conflicts": "select * from (values (1), (4), (5), (7), (8), (9), (10), (11)) as v(id)",
    "constraint_arguments": "select * from (values (1, 1::bigint), (6, 2)) as v(id, n_arguments)",
    "constraint_strict": "select * from (values (1, true), (2, true), (3, false), (4, true), (5, false), (6, false), (7, true), (8, true), (9, true), (10, null), (11, null)) as v(id, strict)",
    "conv_masked": "select conv_id, sum(n)::bigint as n_tokens, sum(case when role = 'assistant' then n else 0 end)::bigint as n_learned from (select *, len(string_split(text, ' ')) as n from conversations) group by conv_id",
    "conv_merged": "select conv_id, count(*) as n_turns, sha256(string_agg(text, '|' order by turn)) as asked_sha256 from conversations where role = 'user' group by conv_id",
    "conv_fits": "select conv_id, turn from conversations where not contains(text || ' ' || role, '<image>') and len(regexp_split_to_array(text || ' ' || role, '\\s+')) <= 60 and length(text || ' ' || role) <= 400",
    "mails": "select conv_id, sha256('Subject: ' || role || chr(10) || chr(10) || text) as text_sha256 from conversations",
    "first_reply": "select conv_id, min(turn) as turn, length(arg_min(text, turn))::bigint as n_chars from conversations where role = 'assistant' group by conv_id",
    "decoded_names": "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by n_regionkey",
    "projected": "select s_suppkey, s_name as name, trunc(s_acctbal)::int as s_acctbal, 'supplier' as kind, row_number() over (order by s_suppkey) - 1 as position from supplier",
    "zipped": "select rank, doc_id, vec_id, label from (select doc_id, row_number() over (order by doc_id) as rank from documents) join (select vec_id, label, row_number() over (order by vec_id) as rank from embeddings) using (rank)",
    "annotation_branches": f"select d.doc_id, len({TEXT_WORDS})::bigint as n_words, length(text)::bigint as n_chars, quality from documents d left join labels l on d.doc_id = l.doc_id",
    "success_rates": "select event_type, event_id % 4 as shard, count(*) as n_done, round(avg((value > 10)::int), 9) as rate from events group by 1, 2",
    "vector_softmax": "with e as (select vec_id, list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) as e from embeddings), p as (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from e) select vec_id, round(list_max(p), 6) as most, round(-list_sum(list_transform(p, lambda x: case when x > 0 then x * ln(x) else 0 end)), 6) as entropy from p",
    "vector_patches": "select vec_id, " + ", ".join(f"{_first_standard(p)} as p{i}" for i, p in enumerate(x for x in (4, 5, 8, 7, 6, 3, 0, 1, 2) if x < 8)) + " from embeddings",
    "flux_scaled": "select vec_id, round(a, 6) as scaled, round((exp(a) - exp(-a)) / 2 * 0.01, 6) as flux, round(asinh(embedding[10]::double * 1e10 * 1e4 * 1e4 / 2.99792458e18), 6) as tenth from (select *, greatest(-3.0::double, least(3.0::double, asinh(embedding[1]::double / 0.01))) as a from embeddings)",
    "sizes_and_weights": "select p_partkey, round(1.0 / p_size, 9) as by_sample, round(1.0 / sqrt(p_size), 9) as by_root, (round_even(p_partkey / 14, 0) * 14)::bigint as by_round, (ceil(p_partkey / 14) * 14)::bigint as by_ceil, (floor(p_partkey / 14) * 14)::bigint as by_floor, ((p_partkey % 50 + 1) + (p_partkey % 7 + 1) * 1000 + (p_partkey % 11 + 1) * 1000000)::bigint as gram_id, "
    "array_to_string(list_transform(list_sort(list_distinct(list_transform([0, 1, 2, 3, 4], lambda i: floor(i * ((p_partkey % 40) / 4.0::double))::bigint))), lambda x: x::varchar), ',') as indices from part",
    "clean_redshifts": "select * from (values (1, 0.5::double), (2, null), (3, null), (4, null), (5, 2.5), (6, null)) as v(id, z)",
    "video_fractions": f"select id, case when kind = 'image' then 1.0::double when seconds < 10 then 0.1 when seconds < 60 then 0.5 when seconds < 600 then 1.0 else 0.0 end as share from {_sql('clips')}",
    "pixel_overlap": f"select id, (pixel_a >> (2 * (order_a - least(order_a, order_b)))) = (pixel_b >> (2 * (order_b - least(order_a, order_b)))) as overlap from {_sql('pixels')}",
    "pixel_split": "select event_id, case when ('0x' || substr(sha256('0:' || (event_id // 256)::varchar), 1, 13))::bigint / 4503599627370496.0::double < 0.1 then 'val' else 'train' end as split from events",
    "image_difference": "with h as (select vec_id, array_to_string(list_transform(range(0, 64), lambda i: case when round(embedding[((i // 8) * 9 + i % 8 + 1) % 64 + 1] * 3.0::double) > round(embedding[((i // 8) * 9 + i % 8) % 64 + 1] * 3.0::double) then '1' else '0' end), '') as bits from embeddings) select vec_id, bits, bits in (select bits from h where vec_id % 10 = 0) as in_evaluation from h",
    "fuzzy_names": "with q as (select s_suppkey, case when s_suppkey % 3 = 0 then s_name[2:] else s_name end as asked from supplier), a as (select distinct s_suppkey, unnest(list_transform(range(1, length(asked) + 1), lambda i: substr('^' || lower(asked) || '$', i, 3))) as g from q), b as (select distinct s_suppkey as m, s_name, unnest(list_transform(range(1, length(s_name) + 1), lambda i: substr('^' || lower(s_name) || '$', i, 3))) as g from supplier), "
    "s as (select a.s_suppkey, b.m, b.s_name, count(*) as n from a join b on a.g = b.g group by all), r as (select *, row_number() over (partition by s_suppkey order by n desc, length(s_name), m) as place from s) select q.s_suppkey, r.m as match, coalesce(q.asked = r.s_name, false) as found from q left join r on q.s_suppkey = r.s_suppkey and r.place = 1",
    "caption_first_word": "select conv_id, turn, (role in ('user', 'assistant'))::int as matched from conversations",
    "packed_whole": "with recursive d as (select doc_id, doc_id // 100 as g, n_chars as n, row_number() over (partition by doc_id // 100 order by doc_id) as i from documents where n_chars <= 4000), "
    "w as (select doc_id, g, n, i, 0 as bin, 0::bigint as o from d where i = 1 union all select d.doc_id, d.g, d.n, d.i, w.bin + (w.o + w.n + d.n > 4000)::int, case when w.o + w.n + d.n > 4000 then 0 else w.o + w.n end from w join d on d.g = w.g and d.i = w.i + 1) "
    "select g, doc_id, bin::bigint as bin, o as offset, (o + n)::bigint as end, (case when o + n = max(o + n) over (partition by g, bin) then 4000 - o - n else 0 end)::bigint as padding from w",
    "perplexity_filter": f"with e as (select doc_id, unnest({TEXT_WORDS}) as w from documents), c as (select w, count(*) as n from e group by w), s as (select doc_id, sum(log10(n / (select count(*) from e))) as s, count(*) as k from e join c on e.w = c.w group by doc_id), p as (select doc_id, round(pow(10.0, -round(s, 6) / (k + 1)), 1) as perplexity from s) select doc_id, perplexity from p where perplexity <= 1500",
}
