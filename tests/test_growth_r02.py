"""F3, F5, F7, F8, F10 of round 2: no word of a text is shuffled with its document, but for those that are rare."""

import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import dedup, quality
from millrace.plans import registry

OFF = {"least_words": None, "most_words": None, "most_special": None, "least_stop": None, "most_flagged": None, "least_punctuation": None, "most_word_repetition": None, "most_char_repetition": None}
TEXTS = [(1, "the cat sat\nthe dog\n\nEND"), (2, "The cat ran\nzebra yak\nEND"), (3, ""), (4, None), (5, "lion lion"), (6, "puma\nthe\nox cat sat dog"), (7, "END")]


def exchanges(df):
    """The columns by which the plan deals rows out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*), \d+\)", plan)]


def rows(spark):
    return spark.createDataFrame(TEXTS, "k long, t string")


def shares(texts):
    """(share of words that occur twice or more, 0 without words) of each text."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    n = Counter(w for ws in words for w in ws)
    return [sum(n[w] > 1 for w in ws) / len(ws) if ws else 0.0 for ws in words]


def test_documents_meet_their_rare_words_by_number(spark, data):
    """all words of the documents were shuffled twice, and those of one common word met in one task."""
    assert not [x for x in exchanges(registry.QUERIES["doc_quality_filter"](spark, data)) if re.search("doc_id.*word", x)]
    limits = quality.Limits(**OFF, least_common=0.75)
    want = {k for (k, t), s in zip(TEXTS, shares([t for _, t in TEXTS]), strict=True) if s >= 0.75}
    got = quality.filter_documents(rows(spark), "t", limits, "k", quality.OWN)
    assert {r["k"] for r in got.collect()} == want and got.columns == ["k", "t"]


def test_any_dictionary_of_common_words(spark, monkeypatch):
    """the same with a dictionary that is broadcast and with one that is too large for that."""
    listed = spark.createDataFrame([("the",), ("cat",), ("lion",), ("cat",)], "word string")
    for most in (300_000, 1):
        monkeypatch.setattr(quality, "BROADCAST_WORDS", most)
        rare = {r["k"]: r["n_rare"] for r in quality.rare_words(rows(spark), listed, ["k"], "t").collect()}
        assert rare == {1: 3, 2: 4, 6: 4, 7: 1}


def test_frequent_elements_go_before_the_shuffle(spark, monkeypatch):
    """every element was shuffled with its place, and those of one common element met in one task."""
    held = [(i, [f"r{i}", "a", f"h{i % 4}", "a", None, "b" if i % 3 else "c"]) for i in range(20)] + [(50, []), (51, None)]
    n = Counter(x for _, xs in held for x in xs or [])
    want = {i: [x for x in xs or [] if x is None or n[x] <= 5] for i, xs in held}
    df = spark.createDataFrame(held, "k long, w array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for most in (300_000, 2, 0):
        monkeypatch.setattr(dedup, "BROADCAST_WORDS", most)
        out = dedup.drop_frequent_elements(df, "k", "w", 5)
        assert {r["k"]: r["w"] for r in out.collect()} == want
        assert ("x" in exchanges(out)) == (most < 300_000)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 4), ("e", 1)], "x string, n long")
    monkeypatch.setattr(dedup, "BROADCAST_WORDS", 3)
    first, others = dedup.most_frequent(counts)
    assert {r["x"] for r in first.collect()} == {"a", "b"} and {r["x"] for r in others.collect()} == {"c", "d", "e"}


def test_perplexity_sums_frequent_words_in_place(spark, data, monkeypatch):
    """all words of all documents were shuffled to meet their numbers."""
    whole = registry.QUERIES["perplexity_filter"](spark, data)
    assert not [x for x in exchanges(whole) if x == "w"]
    want = sorted(tuple(r) for r in whole.collect())
    for most in (100, 0):
        monkeypatch.setattr(dedup, "BROADCAST_WORDS", most)
        parts = registry.QUERIES["perplexity_filter"](spark, data)
        assert sorted(tuple(r) for r in parts.collect()) == want


def test_paragraphs_meet_their_rare_words_by_number(spark, data):
    """F8: all words of all paragraphs were shuffled twice, and the texts before any test."""
    assert not [x for x in exchanges(registry.QUERIES["para_quality_filter"](spark, data)) if "word" in x and "," in x]
    limits = quality.Limits(**OFF, least_common=0.75)
    parts = [(k, p) for k, t in TEXTS if t is not None for p in t.split("\n")]
    want = {}
    for (k, p), s in zip(parts, shares([p for _, p in parts]), strict=True):
        if s >= 0.75 or p == "END":
            want.setdefault(k, []).append(p)
    got = quality.filter_paragraphs(rows(spark), "t", "\n", limits, "END", "k", quality.OWN)
    assert {r["k"]: r["t"] for r in got.collect()} == {k: "\n".join(x) for k, x in want.items()} and got.columns == ["k", "t"]


def test_common_ratio_is_by_the_rare_words(spark, data):
    """all words of all documents were shuffled twice."""
    assert not [x for x in exchanges(registry.QUERIES["doc_common_word_ratio"](spark, data)) if re.search("doc_id.*word", x)]
    got = {r["k"]: r["common_ratio"] for r in quality.common_word_ratio(rows(spark), quality.OWN, "k", "t").collect()}
    assert got == {k: s for (k, _), s in zip(TEXTS, shares([t for _, t in TEXTS]), strict=True)}
