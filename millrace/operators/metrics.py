"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def int_score(score: Column, most: int = 5) -> Column:
    """A score clipped to 0..most and rounded half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(score, F.lit(float(most))))).cast("int")


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion counts alone; 0 where undefined."""
    counts = confusion(rows, label, predicted)
    both = counts.select(F.explode(F.array_distinct(F.array(F.col(label), F.col(predicted)))).alias("class"), label, predicted, "n")
    hit, said, true = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in ((F.col(label) == F.col("class")) & (F.col(predicted) == F.col("class")), F.col(predicted) == F.col("class"), F.col(label) == F.col("class")))
    out = both.groupBy("class").agg(hit.alias("hit"), said.alias("said"), true.alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("hit", "said")


def roc_auc(rows: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by summed ranks over distinct scores (ties count half)."""
    group = group or []
    each = rows.groupBy(*group, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    won = each.withColumn("won", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return won.groupBy(*group).agg(F.when(total > 0, F.sum("won") / total).alias("auc"))


def ndcg(rows: DataFrame, query: str, score: str, relevance: str, tie: str) -> DataFrame:
    """Per query: discounted gain in order of score over that in order of relevance."""
    own = Window.partitionBy(query)
    at = F.row_number().over(own.orderBy(F.col(score).desc(), F.col(tie)))
    best = F.row_number().over(own.orderBy(F.col(relevance).desc(), F.col(tie)))
    gain = lambda n: F.col(relevance) / F.log2(n + 1)
    held = rows.withColumn("__g", gain(at)).withColumn("__b", gain(best))
    return held.groupBy(query).agg(F.when(F.sum("__b") > 0, F.sum("__g") / F.sum("__b")).otherwise(0.0).alias("ndcg"))


def anls(prediction: Column, answers: Column) -> Column:
    """One less the least normalised edit distance to an answer, 0 from one half up; an empty prediction scores 0."""
    p = F.lower(F.trim(prediction))
    near = lambda a: F.levenshtein(p, F.lower(F.trim(a))) / F.greatest(F.length(p), F.length(F.trim(a)), F.lit(1))
    score = F.array_max(F.transform(answers, lambda a: F.when(near(a) < 0.5, 1 - near(a)).otherwise(0.0)))
    return F.when(F.coalesce(F.length(p), F.lit(0)) == 0, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def vqa_accuracy(prediction: Column, answers: Column) -> Column:
    """Mean over answers left out in turn of min(1, matches among the rest / 3); with one answer, equality."""
    n = F.size(answers)
    matches = F.size(F.filter(answers, lambda a: a == prediction))
    each = F.transform(answers, lambda a: F.least(F.lit(1.0), (matches - F.when(a == prediction, 1).otherwise(0)) / 3))
    return F.when(n == 1, (F.element_at(answers, 1) == prediction).cast("double")).when(n > 1, F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / n).otherwise(0.0)


def relaxed_accuracy(prediction: Column, answers: Column, most: float = 0.05) -> Column:
    """Numbers within 5 % of the first numeric answer (by the signed answer), or else equal text."""
    p = prediction.try_cast("double")
    first = F.get(F.filter(F.transform(answers, lambda a: a.try_cast("double")), lambda a: a.isNotNull()), F.lit(0))
    return F.when(p.isNotNull() & first.isNotNull(), F.when(first == 0, (p == 0).cast("double")).otherwise((F.abs(p - first) / F.nullif(first, F.lit(0.0)) < most).cast("double"))).otherwise(F.array_contains(answers, prediction).cast("double"))


def normalise_answer(text: Column) -> Column:
    """Lower case without articles and punctuation, number words as digits."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s']", " ")
    for word, digit in {"zero": "0", "none": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}.items():
        out = F.regexp_replace(out, rf"\b{word}\b", digit)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(a|an|the)\b", " "), " +", " "))


def kl_divergence(p: DataFrame, q: DataFrame, key: str, value: str = "density", floor: float = 1e-12) -> DataFrame:
    """Sum of p ln(p/q) over the keys of p."""
    both = p.join(q.select(key, F.col(value).alias("__q")), key, "left")
    return both.agg(F.sum(F.when(F.col(value) > 0, F.col(value) * F.log(F.col(value) / F.greatest(F.coalesce("__q", F.lit(0.0)), F.lit(floor)))).otherwise(0.0)).alias("kl"))


def _moments(held: DataFrame, names: list[str], by: str) -> dict:
    """For each part: the matrix of summed products of the columns (a one at the end), in one aggregate."""
    import numpy as np

    names = [*names, "__one"]
    held = held.withColumn("__one", F.lit(1.0))
    sums = held.groupBy(by).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).collect()  # one row a part
    return {r[by]: np.array([[r[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))]) for r in sums}


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0):
    """Closed-form ridge weights (intercept last): the sums of products are one aggregate, the solve is small."""
    import numpy as np

    held = rows.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna().withColumn("__part", F.lit(0))
    m = _moments(held, [*features, target], "__part").get(0, np.zeros((len(features) + 2,) * 2))
    x = [*range(len(features)), len(features) + 1]
    return np.linalg.solve(m[np.ix_(x, x)] + penalty * np.diag([1.0] * len(features) + [1e-9]), m[x, len(features)])


def ridge_selected(rows: DataFrame, key: str, features: list[str], target: str, penalties=(1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0), seed: int = 0) -> dict:
    """The penalty that fits a validation part best, and the determination (R squared) on a test part it never saw.

    Parts come from the key's hash: a fifth to test, a fifth of the rest to
    validate. Features are standardised by the training part. Everything is
    computed from one aggregate of products a part, whatever the rows.
    """
    import numpy as np

    from .sampling import fraction_of

    u = fraction_of(F.col(key), seed)
    held = rows.select(F.when(u < 0.2, 2).when(u < 0.36, 1).otherwise(0).alias("__part"), *[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna()
    moments = _moments(held, [*features, target], "__part")
    n = len(features)
    train, valid, test = (moments.get(i, np.zeros((n + 2,) * 2)) for i in range(3))
    mean = train[n + 1, : n + 1] / max(1.0, train[n + 1, n + 1])
    spread = np.sqrt(np.maximum(np.diag(train)[:n] / max(1.0, train[n + 1, n + 1]) - mean[:n] ** 2, 0))
    spread[spread == 0] = 1.0
    # Rows of the new columns in terms of the old: standardised features, centred target.
    change = np.zeros((n + 1, n + 2))
    change[:n, :n], change[n, n] = np.diag(1 / spread), 1.0
    change[:n, n + 1], change[n, n + 1] = -mean[:n] / spread, -mean[n]
    moved = lambda m: change @ m @ change.T

    def fit(m, penalty):
        m = moved(m)
        return np.linalg.solve(m[:n, :n] + penalty * np.eye(n), m[:n, n])

    def r2(w, m):
        a = moved(m)
        left = a[n, n] - 2 * w @ a[:n, n] + w @ a[:n, :n] @ w
        count = m[n + 1, n + 1]
        total = m[n, n] - m[n, n + 1] ** 2 / count if count else 0.0
        return 1 - left / total if total > 0 else float("nan")

    best = max(penalties, key=lambda x: r2(fit(train, x), valid))
    return {"penalty": best, "r2": float(r2(fit(train + valid, best), test)), "n_test": int(test[n + 1, n + 1])}


def first_word_match(generated: Column, references: Column) -> Column:
    """1 where the first word of a generated caption equals a reference, letter case and blanks aside; else 0."""
    from ..functions.words import standard_spaces, words

    first = F.coalesce(F.get(words(standard_spaces(generated)), F.lit(0)), F.lit(""))
    return F.when(F.exists(references, lambda r: F.trim(standard_spaces(F.lower(r))) == first), 1).otherwise(0)
