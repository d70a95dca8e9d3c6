"""Operators on small hand-made rows, with the exact results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import ratios, urls
from millrace.functions.words import normalise, words
from millrace.operators import chat, dedup, html, images, metrics, quality, sampling, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_words(spark):
    assert one(spark, words(F.lit("Hello,  (World)\n42 it's ok --"))) == ["hello", "world", "it's ok"]
    assert one(spark, words(F.lit(None).cast("string"))) == []


def test_normalise(spark):
    assert one(spark, normalise(F.lit(" Ab１ 9… "))) == 'ab" 0...' or one(spark, normalise(F.lit(" Ab 9… "))) == "ab 0..."


def test_character_repetition():
    assert ratios.character_repetition_of("ok_ok_good_ok", 3) == pytest.approx(4 / 11)
    assert ratios.character_repetition_of("", 10) == 0
    assert ratios.character_repetition_of(None, 10) == 0


def test_word_repetition(spark):
    rows = spark.createDataFrame([(1, "a b a b c".split()), (2, [])], "id long, w array<string>")
    got = {r["id"]: r["word_repetition"] for r in ratios.word_repetition(rows, "id", "w", 2).collect()}
    assert got == {1: 2 / 4, 2: 0.0}


def test_empty_text_fails_minimum_and_passes_maximum(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "id long, text string")
    assert quality.filter_documents(rows).count() == 0


def test_paragraph_filter_keeps_marker(spark):
    good = "the cat sat on the mat, and it was in the sun for the day."
    rows = spark.createDataFrame([(1, f"{good}\n\n$$$$ ####\n\nEOD"), (2, "$$$$")], "id long, text string")
    out = quality.filter_paragraphs(rows, marker="EOD").collect()
    assert [(r["id"], r["text"]) for r in out] == [(1, f"{good}\n\nEOD")]


def test_url_versions_tie(spark):
    rows = spark.createDataFrame([(1, "u", "w1"), (2, "u", "w2"), (3, "u", "w2"), (4, "v", "w0"), (5, None, "w")], "id long, url string, warc string")
    assert sorted(r["id"] for r in dedup.keep_latest_url(rows, "url", "warc").collect()) == [2, 3, 4, 5]


def test_frequent_elements(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["b"])], "id long, x array<string>")
    got = {r["id"]: r["x"] for r in dedup.drop_frequent_elements(rows, "id", "x", 2).collect()}
    assert got == {1: ["a"], 2: ["c"], 3: []}


def test_paragraphs_by_group(spark):
    rows = spark.createDataFrame([(1, "s", "x\n\ny"), (2, "s", "x\n\nEOD"), (3, "s", "x\n\nEOD"), (4, "t", "x\n\nEOD")], "id long, g string, text string")
    got = {r["id"]: r["text"] for r in dedup.drop_repeated_paragraphs(rows, "id", "g", "text", least=2, marker="EOD").collect()}
    assert got == {1: "y", 2: "EOD", 3: "EOD", 4: "x\n\nEOD"}


def test_minhash_keeps_smallest_of_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(200))
    near = base.replace("word100 ", "other ")
    rows = spark.createDataFrame([(5, base), (2, near), (9, base), (7, "quite another text of some words here"), (8, None), (4, "")], "id long, text string")
    got = {r["id"]: r["kept_as"] for r in dedup.minhash_dedup(rows, "id", "text").collect()}
    assert got == {5: 2, 2: 2, 9: 2, 7: 7, 8: 8, 4: 4}


def test_minhash_finds_pairs_behind_smaller_ids_and_chains(spark):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(400)]
    changed = lambda t, at: " ".join(f"new{rng.random()}" if i in at else w for i, w in enumerate(t))
    texts = {i: changed(base, set(rng.sample(range(400), 14))) for i in range(60)}
    texts |= {1000: " ".join(base), 1001: changed(base, {200})}
    chain = [f"link{i}" for i in range(200)]
    texts |= {2000: changed(chain, {20, 60}), 2001: " ".join(chain), 2002: changed(chain, {100, 140}), 2003: changed(chain, {25, 70, 110, 145})}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, re.findall(r"\w+", t)) for i, t in texts.items())}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r["id"]: r["kept_as"] for r in dedup.minhash_dedup(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text").collect()}
    assert got == root and root[1001] == 1000 and root[2002] == 2000


def test_hamming_pairs(spark):
    rows = spark.createDataFrame([(1, 0), (2, 7), (3, 0), (4, -1)], "id long, c long")
    got = sorted((r["a"], r["b"], r["distance"]) for r in dedup.hamming_pairs(rows, "id", "c", 3).collect())
    assert got == [(1, 2, 3), (1, 3, 0), (2, 3, 3)]


def test_html_nodes():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>one <b>two</b><p>three<br>four<!-- x --><div class='date-line'>May</div><img data-src='a.png' alt='A'><script>no()</script><footer>f</footer></body></html>"
    nodes = html.nodes_of(page)
    assert [n["text"] for n in nodes if n["text"]] == ["one two\n\nthree\nfour"]
    assert [(n["src"], n["alt"]) for n in nodes if n["src"]] == [("a.png", "A")]
    assert html.nodes_of(None) == [] and html.nodes_of("") == []


def test_urls(spark):
    assert one(spark, urls.netloc(F.lit("https://u@h.com:80/a?b"))) == "u@h.com:80"
    assert one(spark, urls.is_valid(F.lit("https://h.com/a"))) and not one(spark, urls.is_valid(F.lit("h.com/a")))
    page = F.lit("https://h.com/x/y")
    assert one(spark, urls.absolute(F.lit("//c.com/i.png"), page)) == "http://c.com/i.png"
    assert one(spark, urls.absolute(F.lit("./i.png"), page)) == "https://h.com/i.png"
    assert one(spark, urls.size_in_pixels(F.lit("12.5px"))) == 12.5 and one(spark, urls.size_in_pixels(F.lit("50%"))) is None
    assert one(spark, urls.resolved_percent(F.lit("50%"), F.lit(5))) == 2


def test_constraints(spark):
    rows = spark.createDataFrame([(1, ["change_case:english_capital", "change_case:english_lowercase"], '{"a": 1}'), (2, ["punctuation:no_comma"], "{bad"), (3, ["punctuation:no_comma"], "{}")], "id long, instruction_id_list array<string>, kwargs string")
    assert [r["id"] for r in chat.conflict_free(chat.parsed_kwargs(rows)).collect()] == [3]


def test_strict_accuracy(spark):
    rows = spark.createDataFrame([(1, "no commas here", ["punctuation:no_comma"], "[{}]"), (2, "a, b", ["punctuation:no_comma"], "[{}]"), (3, "x", ["keywords:existence"], "[{}]"), (4, "{}", ["detectable_format:json_format"], "[{}]")], "id long, response string, instruction_id_list array<string>, kwargs string")
    assert {r["id"]: r["strict"] for r in chat.strict_accuracy(rows).collect()} == {1: True, 2: False, 3: None, 4: True}


def test_guard_and_tools(spark):
    assert one(spark, chat.guard_verdict(F.lit("\n\nunsafe\nS10"))) == "unsafe S10"
    assert one(spark, chat.guard_verdict(F.lit("safe"))) == "safe" and one(spark, chat.guard_verdict(F.lit("?"))) is None
    assert one(spark, chat.tool_calls(F.lit('x<tool_call>{"a":\n1}</tool_call>'))) == ['{"a":\n1}']
    assert one(spark, chat.mask_roles(F.array(F.lit(2), F.lit(1)), F.array(F.lit("user"), F.lit("assistant")))) == [0, 0, 1]


def test_metrics(spark):
    answers = lambda *a: F.array(*map(F.lit, a))
    assert one(spark, metrics.anls(F.lit("abcd"), answers("abce", "zzzz"))) == 0.75
    assert one(spark, metrics.anls(F.lit(""), answers("a"))) == 0
    assert one(spark, metrics.vqa_accuracy(F.lit("y"), answers("y", "y", "n", "n"))) == pytest.approx((1 / 3 + 1 / 3 + 2 / 3 + 2 / 3) / 4)
    assert one(spark, metrics.relaxed_accuracy(F.lit("104"), answers("100"))) == 1 and one(spark, metrics.relaxed_accuracy(F.lit("106"), answers("100"))) == 0
    assert one(spark, metrics.relaxed_accuracy(F.lit("3"), answers("0"))) == 0
    assert one(spark, metrics.int_score(F.lit(2.5))) == 2 and one(spark, metrics.int_score(F.lit(9.0))) == 5
    assert one(spark, metrics.normalise_answer(F.lit("The two, dogs!"))) == "2 dogs"


def test_ridge_recovers_weights(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("x"), (3.0 * F.col("id") + 5).alias("y"))
    w = metrics.ridge(rows, ["x"], "y", 1e-6)
    assert w[0] == pytest.approx(3, abs=1e-4) and w[1] == pytest.approx(5, abs=1e-2)


def test_packing(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 5, 3, 12, 4, 6])], "g long, i long, n long")
    assert [r["bin"] for r in sampling.pack_next_fit(rows, "g", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    assert [r["bin"] for r in sampling.pack_first_fit(rows, "g", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, None, 1, 2]


@pytest.mark.parametrize("parts", [1, 4])
def test_splits_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("s")).repartition(parts)
    out = sampling.stratified_split(rows, "id", "s").where("split = 'test'")
    assert 97 <= out.count() <= 102
    assert out.agg(F.sum("id")).first()[0] == sampling.stratified_split(rows.repartition(7), "id", "s").where("split = 'test'").agg(F.sum("id")).first()[0]
    assert 0.01 < sampling.hash_split(rows, "id", 0.02).where("split = 'val'").count() / 1000 < 0.04


def test_rank_all(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(5)
    assert all(r["rank"] == r["k"] + 1 for r in sampling.rank_all(rows, "k").collect())


def test_crossmatch(spark):
    a = spark.createDataFrame([(1, 10.0, 0.0), (2, 359.9999, 0.0), (3, 50.0, 89.99)], "id long, ra double, dec double")
    b = spark.createDataFrame([(7, 10.0001, 0.0), (8, 10.00005, 0.0), (9, 0.0, 0.0)], "id long, ra double, dec double")
    got = {r["id"]: r["match_id"] for r in vectors.crossmatch(a, b, "id", radius=1 / 3600).collect()}
    assert got == {1: 8, 2: 9, 3: None}
    assert [r["id"] for r in vectors.crossmatch(a, b, "id", radius=1 / 3600, how="anti").collect()] == [3]


@pytest.mark.parametrize(("a", "b", "want"), [((6, 9145), (5, 2286), True), ((6, 9145), (8, 146320), True), ((6, 9145), (5, 2287), False)])
def test_pixels(spark, a, b, want):
    assert one(spark, vectors.contains_pixel(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1]))) is want


def test_top_k_ties(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [0.0, 0.0])], "id long, v array<double>")
    got = [(r["rank"], r["id"]) for r in vectors.top_k(rows, F.col("id") == 0, "id", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 5)]


def test_first_fit_with_a_second_size_matches_a_plain_search(spark):
    import random

    rng = random.Random(3)
    items = [(i % 2, i, rng.choice([0, 1, 3, 7, 10, 11]), rng.randrange(4)) for i in range(300)]
    rows = spark.createDataFrame(items, "g int, i int, n int, k int")
    for count, most in ((None, None), ("k", 5), ("k", 2)):
        want = {}
        for g in (0, 1):
            left, held = [], []
            for _, i, n, k in (x for x in items if x[0] == g):
                if n > 10 or (most is not None and k > most):
                    want[i] = None
                    continue
                at = next((b for b in range(len(left)) if left[b] >= n and (most is None or held[b] + k <= most)), len(left))
                if at == len(left):
                    left.append(10)
                    held.append(0)
                left[at] -= n
                held[at] += k
                want[i] = at
        got = {r["i"]: r["bin"] for r in sampling.pack_first_fit(rows, "g", "i", "n", 10, count, most).collect()}
        assert got == want


def test_whole_objects_have_places_and_too_long_ones_raise(spark):
    rows = spark.createDataFrame([(0, 1, 3), (0, 2, 4), (0, 3, 5)], "g int, i int, n int")
    got = [tuple(r) for r in sampling.pack_whole(rows, "g", "i", "n", 8).orderBy("i").collect()]
    assert got == [(0, 1, 0, 0, 3, 0), (0, 2, 0, 3, 7, 1), (0, 3, 1, 0, 5, 3)]
    with pytest.raises(Exception, match="longer than the room"):
        sampling.pack_whole(rows, "g", "i", "n", 4).collect()


def test_hash_rank_is_the_rank_in_hash_order(spark):
    import hashlib

    rows = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2) for i in range(500)], "id int, s int")
    want = {}
    for s in (None, 0, 1):
        own = sorted((hashlib.sha256(f"7:{i}".encode()).hexdigest(), i) for i in range(500) if (None if i % 9 == 0 else i % 2) == s)
        want |= {i: (at, len(own)) for at, (_, i) in enumerate(own, 1)}
    got = {r["id"]: (r["__rank"], r["__total"]) for r in sampling.hash_rank(rows, "id", ["s"], 7).collect()}
    assert got == want
    first = sorted(i for i in range(500) if sum(hashlib.sha256(f"1:{j}".encode()).hexdigest() < hashlib.sha256(f"1:{i}".encode()).hexdigest() for j in range(500)) < 20)
    assert sorted(r["id"] for r in sampling.sample(rows, "random:20", "id", seed=1).collect()) == first


def test_ridge_selection_matches_numpy(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = x @ [1.0, -0.5, 4.0] + 0.3 * rng.standard_normal(400) + 7
    u = np.array([int(hashlib.sha256(f"0:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(400)])
    part = np.where(u < 0.2, 2, np.where(u < 0.36, 1, 0))
    mean, spread, middle = x[part == 0].mean(0), x[part == 0].std(0), y[part == 0].mean()
    z = (x - mean) / spread
    fit = lambda keep, p: np.linalg.solve(z[keep].T @ z[keep] + p * np.eye(3), z[keep].T @ (y[keep] - middle))
    r2 = lambda w, keep: 1 - ((y[keep] - z[keep] @ w - middle) ** 2).sum() / ((y[keep] - y[keep].mean()) ** 2).sum()
    penalties = (1e-3, 1e-1, 10.0, 1000.0)
    best = max(penalties, key=lambda p: r2(fit(part == 0, p), part == 1))
    got = metrics.ridge_selected(spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y double"), "id", ["a", "b", "c"], "y", penalties)
    assert got["penalty"] == best and got["n_test"] == int((part == 2).sum()) and got["r2"] == pytest.approx(r2(fit(part < 2, best), part == 2))


def test_html_pictures_kept_and_rest_cut():
    page = "<p>a</p><nav><img src='n.jpg'></nav><div><p>b</p><h2 id='ref'>c</h2><p>d<img src='x.jpg'></p></div><p>e</p>"
    shown = lambda *a: [n["text"] or n["src"] for n in html.nodes_of(page, *a)]
    assert shown() == ["a\n\nb\n\nc\n\nd", "x.jpg", "e"]
    assert shown(True) == ["a", "n.jpg", "b\n\nc\n\nd", "x.jpg", "e"]
    assert shown(False, ["ref"]) == ["a\n\nb\n\ne"]


def test_image_hashes_of_known_pictures():
    import numpy as np

    assert images.wavelet_hash(np.zeros((8, 8))) == 0
    left = np.tile([1.0] * 4 + [0.0] * 4, (8, 1))
    assert images.wavelet_hash(left) == int("11" + "0" * 62, 2)  # the mean, and the first step between the halves
    bits = images.difference_hash(np.tile(np.arange(9), (8, 1)))
    assert bits == 2**64 - 1
