"""Text, number and annotation functions on single values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import maths, texts
from millrace.operators.annotate import Annotator, language_of


@pytest.fixture
def one(spark):
    return lambda expr: spark.range(1).select(expr.alias("x")).first()["x"]


def test_articles(one):
    assert one(texts.after_dateline(F.lit("CITY (X) -- Body -- more. E-mail to a friend ."))) == "Body -- more."
    assert one(texts.after_dateline(F.lit("plain"))) == "plain"
    got = one(texts.two_sections(F.lit("Summary: one\nKey points: two\n"), "summary", "key points"))
    assert (got["first"], got["second"]) == ("one", "two") and one(texts.two_sections(F.lit("x"), "a", "b")) is None


def test_ends(one):
    assert one(texts.repaired_ends(F.lit("What?. Oh!."))) == "What? Oh?" and one(texts.bad_ends(F.lit("a?. b:. c."))) == 2
    assert one(texts.sentence(F.lit(" hello"))) == "Hello." and one(texts.sentence(F.lit("Ok!"))) == "Ok!"


def test_code_and_choices(one):
    got = one(texts.code_blocks(F.lit("x\n```html\n<body>a</body>\n```\ny\n```css\n/* c */\np { }\n```\n")))
    assert got["css"].startswith("p {") and got["body"] == "<body>a</body>" and one(texts.code_blocks(F.lit("none"))) is None
    got = one(texts.choices(F.array(F.lit("x"), F.lit("y")), F.lit("y")))
    assert (got["lines"], got["letter"]) == ("A. x\nB. y", "B")
    assert one(texts.table_text(F.array(F.lit("h"), F.lit("k")), F.array(F.array(F.lit("1"), F.lit("2"))))) == "| h | k |\n| 1 | 2 |"


def test_keys(one):
    assert one(texts.shared_key(F.lit("img_0042-x.png"))) == "0042" and one(texts.shared_key(F.lit("b-a.png"))) == "a_b"
    assert one(texts.gold_answer(F.lit("so #### 1,234"))) == "1234"


@pytest.mark.parametrize(("text", "want"), [("\\boxed{\\frac{1}{2}}", "1/2"), ("The answer is 1,200.", "1200"), ("a 3 b 4.0", "4"), ("\\boxed{x = .5}", "0.5"), ("none", None), (None, None), ("\\boxed{90^\\circ}", "90")])
def test_final_answer(text, want):
    assert texts.final_answer(text) == want


def test_same_answer_and_rouge():
    assert texts.same_answer("1,000", "1000.0") and not texts.same_answer(None, "1")
    assert texts.rouge_l("a b c", "a c") == pytest.approx(0.8) and texts.rouge_l("", "a") == 0


def test_numbers(one):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(maths.flux_of(maths.arcsinh_scaled(F.lit(3.5), F.lit(0.2)), F.lit(0.2))) == pytest.approx(3.5)
    assert one(maths.clean_number(F.lit(float("nan")))) is None and one(maths.clean_number(F.lit(1.0), F.lit(True))) is None
    assert one(maths.gram_id(F.array(F.lit(0), F.lit(2)), 10)) == 31
    assert sum(one(maths.softmax(a(1, 2, 3)))) == pytest.approx(1) and one(maths.entropy(a(0.5, 0.5))) == pytest.approx(0.693147, abs=1e-6)
    assert one(maths.patches(a(1, 2, 3, 4, 5), 2)) == [[1, 2], [3, 4]] and one(maths.standardised(a(2, 2))) == [0, 0]
    order = maths.spiral(3)
    assert sorted(order) == list(range(9)) and order[0] == 4
    assert one(maths.minutes_seconds(F.lit(1950), 30.0)) == "01:05" and one(maths.to_multiple(F.lit(45), 28)) == 56


def test_annotator(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog"), (2, "le chat et le chien"), (3, None)], "id long, text string")
    lang = Annotator("lang", F.col("text"), language_of({"en": {"the", "and"}, "fr": {"le", "et"}}), "string")
    assert {r["id"]: r["lang"] for r in lang.apply(rows).collect()} == {1: "en", 2: "fr", 3: None}
    broken = Annotator("score", F.col("text"), lambda: lambda texts: 1 / 0)
    got = broken.apply(rows).collect()
    assert all(r["score"] is None and "ZeroDivision" in r["score_error"] for r in got)


def test_open_answers():
    assert texts.open_answer_correct("So the answer is 3.50 dollars.", ["3.5"]) and not texts.open_answer_correct("It is 4.", ["3.5"])
    assert texts.open_answer_correct("The result is Red Fox", ["red fox"]) and not texts.open_answer_correct(None, ["x"])
    assert texts.bleu("a b c d e", "a b c d e") == pytest.approx(1) and texts.bleu("", "a") == 0


def test_shapes(spark):
    from millrace.operators import shapes

    a = spark.createDataFrame([("t1", "u", 5)], "text string, url string, n long")
    b = spark.createDataFrame([("t2",)], "text string")
    got = sorted((r["text"], r["url"], r["source"], r["meta"]) for r in shapes.one_schema({"a": a, "b": b}, ["text", "url"]).collect())
    assert got == [("t1", "u", "a", '{"n":5}'), ("t2", None, "b", "{}")]
    asked = shapes.asked_turns(spark.createDataFrame([(1, "q", "r")], "id long, q string, a string"), F.col("q"), F.col("a"), "s", ["Be short."], "id")
    turn = asked.first()["texts"][0]
    assert (turn["user"], turn["assistant"], turn["source"]) == ("q\nBe short.", "r", "s")
    assert shapes.fits(asked, "texts", 10).count() == 1 and shapes.fits(asked, "texts", 2).count() == 0
    merged = shapes.merged_turns(asked.withColumn("k", F.lit("p")).union(asked.withColumn("id", F.lit(0)).withColumn("k", F.lit("p"))), "k", "id")
    assert len(merged.first()["texts"]) == 2
    names = spark.createDataFrame([(7, "seven")], "id long, name string")
    assert shapes.decoded(spark.createDataFrame([(1, [7, 8])], "k long, ids array<long>"), "k", "ids", names).first()["names"] == ["seven", None]
    assert spark.range(1).select(shapes.window_of(F.array(*[F.lit(i) for i in range(9)]), F.lit(3), 4).alias("w")).first()["w"][3] <= 8
