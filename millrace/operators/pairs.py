"""Caption pairs, pages and code: filters on several texts of one row, and lists of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratios
from ..functions.words import words

#: Substrings of an address that mark a picture as furniture: fixed values.
BANNED = ("logo", "button", "icon", "plugin", "widget", "porn", "xxx", "sex")


def caption_passes(text: Column, w: Column, least: int = 1, most: int = 256, repetition: float = 0.7, special: float = 0.4) -> Column:
    """``w``: the words of ``text``."""
    return F.size(w).between(least, most) & (ratios.unigram_repetition(w) <= repetition) & (ratios.special_ratio(text) <= special)


def surviving_texts(rows: DataFrame, keys: list[str], passes=caption_passes) -> DataFrame:
    """Rows of which at least one of the texts passes, with ``kept_keys`` naming those that do, in order."""
    split = rows.withColumn("__texts", F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("t"), words(F.col(k)).alias("w")) for k in keys]))
    kept = F.filter("__texts", lambda x: F.coalesce(passes(x["t"], x["w"]), F.lit(False)))
    return split.withColumn("kept_keys", F.transform(kept, lambda x: x["k"])).drop("__texts").where(F.size("kept_keys") > 0)


def known_score_passes(score: Column, least: float) -> Column:
    """A score that is missing passes."""
    return F.coalesce(score >= least, F.lit(True))


def unbanned(url: Column, banned=BANNED) -> Column:
    """The address, or null if it holds a banned word."""
    return F.when(~F.coalesce(F.lower(url).rlike("|".join(banned)), F.lit(False)), url)


def code_passes(html: Column, banned=("lorem ipsum", "placeholder"), least_words: int = 10) -> Column:
    """Code without a banned string and with enough visible words."""
    lowered = F.lower(html)
    visible = F.regexp_replace(F.regexp_replace(lowered, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    n = F.size(F.filter(F.split(visible, r"[ \n\t\r]+"), lambda x: x != ""))
    clean = F.lit(True)
    for b in banned:
        clean = clean & ~F.contains(lowered, F.lit(b))
    return F.coalesce(clean & (n >= least_words), F.lit(False))


def tagged_safe(meta: Column, unsafe=("UNSURE", "NSFW")) -> Column:
    """The NSFW tag of a JSON text isn't among those; without one it passes."""
    return F.coalesce(~F.get_json_object(meta, "$.NSFW").isin(*unsafe), F.lit(True))


def filled(rows: DataFrame, key: str, shards: list[DataFrame], value: str) -> DataFrame:
    """``rows`` with the value of the first shard that has their key: one join for all shards."""
    every = None
    for i, s in enumerate(shards):
        one = s.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.lit(i).alias("__shard"))
        every = one if every is None else every.unionByName(one)
    first = every.where("__value is not null").groupBy("__key").agg(F.min_by("__value", "__shard").alias("__value"))
    return rows.join(first, F.col(key) == F.col("__key"), "left").drop("__key").withColumnRenamed("__value", value)


def visible_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


def nearest_names(asked: DataFrame, held: DataFrame, key: str, name: str, held_key: str, held_name: str) -> DataFrame:
    """(key, match, found): for each name that of the index sharing most trigrams (ties: fewer letters, then the lesser key), accepted only if both are equal.

    Equal names are looked up once. A name's trigrams that the index has are
    ordered by how many names have them. A name that shares all but ``p - 1``
    of them has both of one of ``p`` disjoint pairs, so names meet on the
    rarest pair, then what is open on up to four; the rest meets on single
    trigrams, as many of the rarest as a better match must have one of.
    """
    from ..functions.texts import trigrams
    from ..sources.shared import materialize

    a = asked.select(F.col(name).alias("a")).where("a is not null").distinct().select("a", F.explode(trigrams(F.col("a"))).alias("g"))
    b = held.where(F.col(held_name).isNotNull()).groupBy(F.col(held_name).alias("b")).agg(F.min(held_key).alias("m"))
    b = materialize(b.select("m", F.length("b").alias("len"), F.array_sort(trigrams(F.col("b"))).alias("own")), "names")
    counts = b.select(F.explode("own").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    known = a.join(counts, "g").groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("known"))
    rest = materialize(known.withColumn("bound", F.lit(0)), "asked")

    both = lambda x, y: F.xxhash64(F.least(x, y), F.greatest(x, y))
    pairs_of = b.select("m", F.explode(F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: both(x, y))))).alias("k"))

    def best_of(met: DataFrame) -> DataFrame:
        """The best of the names met, counted in full."""
        n = F.size(F.array_intersect("known", "own"))
        full = met.distinct().join(rest.select("a", "known"), "a").join(b, "m")
        return full.groupBy("a").agg(F.max(F.struct(n.alias("n"), (-F.col("len")).alias("l"), (-F.col("m")).alias("o"))).alias("b"))

    done = None
    for most in (1, 4):
        p = F.least(F.lit(most), F.floor(F.size("known") / 2).cast("int"))
        at = F.when(p > 0, F.sequence(F.lit(0), p - 1)).otherwise(F.array().cast("array<int>"))
        keys = rest.select("a", F.explode(F.transform(at, lambda i: both(F.get("known", 2 * i), F.get("known", 2 * i + 1)))).alias("k"))
        found = materialize(rest.join(best_of(keys.join(pairs_of, "k").select("a", "m")), "a", "left"), "found")
        sure = F.coalesce(F.col("b.n") > F.size("known") - p, F.lit(False))
        settled = found.where(sure).select("a", "b")
        done = settled if done is None else done.unionByName(settled)
        rest = found.where(~sure).select("a", "known", F.greatest("bound", F.coalesce("b.n", F.lit(0))).alias("bound"))
    few = F.slice("known", 1, F.size("known") - F.greatest("bound", F.lit(1)) + 1)
    single = rest.select("a", F.explode(few).alias("g")).join(b.select("m", F.explode("own").alias("g")), "g").select("a", "m")
    best = done.unionByName(best_of(single)).select(F.col("a").alias("__k"), (-F.col("b.o")).alias("match"))
    found = asked.join(best, F.col(name) == F.col("__k"), "left").drop("__k")
    names = held.select(F.col(held_key).alias("__m"), F.col(held_name).alias("__name"))
    return found.join(names, F.col("match") == F.col("__m"), "left").select(key, "match", F.coalesce(F.col(name) == F.col("__name"), F.lit(False)).alias("found"))
