"""Ratios that tell prose from junk. Texts with nothing to count have ratio 0."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPECIAL_CLASS, ngrams

#: Small closed-class words of English, French, German and Spanish; callers with better lists pass their own.
STOP_WORDS = ("a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were will with you "
              "au aux ce cette dans de des du elle en est et il ils je la le les leur ne nous ou par pas pour qui que se son sur un une vous "
              "als am auch auf aus bei das dem den der die ein eine einen er es für haben ich ihr im ist mit nicht sich sie sind und von war wie wir zu zum zur "
              "al como con del el ella ellos esta este lo los las más no para pero por su sus te una y").split()  # fmt: skip
FLAGGED_WORDS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
PUNCTUATED = r"[\p{L}\p{M}\p{N}_']+|[,;:?!.]"
#: The same for Java, which looks up listed characters in one table and asks a property for every other.
PUNCTUATED_LISTED = rf"[{string.ascii_letters}{string.digits}_'[[^\x00-\x7F]&&[\p{{L}}\p{{M}}\p{{N}}]]]+|[,;:?!.]"


def share(count: Column, of: Column) -> Column:
    return F.when(of > 0, count / of).otherwise(0.0)


def special_ratio(text: Column) -> Column:
    """Special characters among all."""
    kept = F.length(F.regexp_replace(text, f"{SPECIAL_CLASS}+", ""))
    return F.coalesce(share(F.length(text) - kept, F.length(text)), F.lit(0.0))


def listed_ratio(words: Column, listed) -> Column:
    """Words of the list among all."""
    held = sorted(set(listed))  # a literal set: the optimiser makes it a hash lookup
    return share(F.size(F.filter(words, lambda w: w.isin(*held))), F.size(words))


def punctuation_ratio(text: Column, least: int = 0) -> Column:
    """Punctuation marks among words and marks; with fewer tokens than ``least`` it is 1, so that a minimum passes."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PUNCTUATED_LISTED), F.lit(0))
    marks = F.size(F.filter(tokens, lambda t: t.isin(*",;:?!.")))
    return F.when(F.size(tokens) < least, 1.0).otherwise(share(marks, F.size(tokens)))


def unigram_repetition(words: Column) -> Column:
    return F.when(F.size(words) > 0, 1 - F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


def with_gram_counts(rows: DataFrame, key: str, grams: Column) -> DataFrame:
    """(key, count of occurrences, number of grams with that count): what repetition ratios need, summed before the shuffle."""
    each = rows.select(key, F.explode(grams).alias("__g")).groupBy(key, F.xxhash64("__g").alias("__h")).agg(F.count("*").alias("n"))
    return each.groupBy(key, "n").agg(F.count("*").alias("grams"))


def word_repetition(rows: DataFrame, key: str, words: str, n: int = 5) -> DataFrame:
    """(key, word_repetition): occurrences of n-grams that occur twice or more among all occurrences."""
    counts = with_gram_counts(rows, key, ngrams(F.col(words), n))
    found = counts.groupBy(key).agg((F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("grams")).otherwise(0)) / F.sum(F.col("n") * F.col("grams"))).alias("word_repetition"))
    return rows.select(key).join(found, key, "left").withColumn("word_repetition", F.coalesce("word_repetition", F.lit(0.0)))


def word_repetition_of(words: Column, n: int = 5) -> Column:
    """Occurrences of n-grams that occur twice or more among all occurrences, from a row's own words."""
    size = F.size(words)
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    # Sorted hashes: an n-gram occurs again if a neighbour is the same.
    line = F.array_sort(F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n))))
    again = lambda g: F.size(F.filter(g, lambda x, i: F.coalesce(F.get(g, i - 1) == x, F.lit(False)) | F.coalesce(F.get(g, i + 1) == x, F.lit(False))))
    return F.transform(F.array(line), lambda g: share(again(g), F.size(g)))[0]


def character_repetition_of(text: str | None, n: int = 10) -> float:
    """Occurrences of the most frequent character n-grams among all.

    As many as the root of the number of distinct n-grams count as the most
    frequent, but none that occurs once.
    """
    import math
    from collections import Counter

    import numpy as np

    if not text or len(text) < n:
        return 0.0
    if len(text) < 400:  # below that, counting beats arrays
        few = sorted(Counter(text[i : i + n] for i in range(len(text) - n + 1)).values(), reverse=True)
        return sum(few[: min(int(math.sqrt(len(few))), sum(v > 1 for v in few))]) / sum(few)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(x) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    counts = np.sort(np.unique(h, return_counts=True)[1])[::-1]
    top = min(int(math.sqrt(len(counts))), int((counts > 1).sum()))
    return float(counts[:top].sum() / counts.sum())


def character_repetition(n: int = 10):
    """A vectorised function of a text column: an n-gram for each character is too many for an array expression."""
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: character_repetition_of(t, n), na_action=None).astype(float)

    return run


def character_repetition_each(n: int = 10):
    """As ``character_repetition``, of each string of an array column."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [] if x is None else [character_repetition_of(t, n) for t in x])

    return run
