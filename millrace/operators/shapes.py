"""Rows of different sources in one shape: captions, question turns, mails, training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_schema(sources: dict[str, DataFrame], core: list[str]) -> DataFrame:
    """All sources as (core columns, source, meta): what a source has beyond the core is folded into JSON."""
    out = None
    for name, rows in sources.items():
        rest = [c for c in rows.columns if c not in core]
        have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in core]
        one = rows.select(*have, F.lit(name).alias("source"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("meta"))
        out = one if out is None else out.unionByName(one)
    return out


def exploded_mails(rows: DataFrame, mails: str = "mails") -> DataFrame:
    """One row a mail, its subject over its body."""
    each = rows.select(*[c for c in rows.columns if c != mails], F.explode(mails).alias("m"))
    return each.withColumn("text", F.concat(F.lit("Subject: "), F.col("m.subject"), F.lit("\n\n"), F.col("m.body"))).drop("m")


def first_or_none(rows: DataFrame, array: str, name: str) -> DataFrame:
    """The first element of an array; rows without one go."""
    return rows.withColumn(name, F.get(array, F.lit(0))).where(F.col(name).isNotNull()).drop(array)


def asked_turns(rows: DataFrame, question: Column, answer: Column, source: str, prompts: list[str], key: str) -> DataFrame:
    """(key, texts): a question and its answer as one turn, under a prompt that the key's hash picks."""
    pick = F.get(F.array(*map(F.lit, prompts)), F.pmod(F.xxhash64(key), F.lit(len(prompts))).cast("int")) if prompts else F.lit("")
    user = F.concat_ws("\n", F.nullif(question, F.lit("")), F.nullif(pick, F.lit("")))
    return rows.select(key, F.array(F.struct(user.alias("user"), answer.alias("assistant"), F.lit(source).alias("source"))).alias("texts"))


def merged_turns(rows: DataFrame, key: str, order: str, texts: str = "texts") -> DataFrame:
    """Rows of one key as one row, their turns in order: what is asked of one picture meets in one conversation."""
    packed = F.sort_array(F.collect_list(F.struct(order, texts)))
    return rows.groupBy(key).agg(F.flatten(F.transform(packed, lambda x: x[texts])).alias(texts))


def fits(rows: DataFrame, texts: str, most_tokens: int, banned=("<image>",), most_chars: int | None = None) -> DataFrame:
    """Conversations without a banned token, within a length in words, and without an over-long turn."""
    said = lambda t: F.concat_ws(" ", t["user"], t["assistant"])
    clean = ~F.exists(texts, lambda t: _any([F.contains(said(t), F.lit(b)) for b in banned]))
    n = F.aggregate(texts, F.lit(0), lambda a, t: a + F.size(F.split(said(t), r"\s+")))
    short = F.forall(texts, lambda t: F.length(said(t)) <= most_chars) if most_chars else F.lit(True)
    return rows.where(clean & (n <= most_tokens) & short)


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def window_of(tokens: Column, key: Column, most: int) -> Column:
    """At most ``most`` tokens from a place that the key's hash picks."""
    room = F.greatest(F.size(tokens) - most, F.lit(0))
    return F.slice(tokens, (F.pmod(F.xxhash64(key), room + 1) + 1).cast("int"), most)


def decoded(rows: DataFrame, key: str, ids: str, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """An array of ids as an array of names, in order; unknown ids become null."""
    each = rows.select(key, F.posexplode(ids).alias("pos", "__id"))
    held = names.select(F.col(id_col).alias("__key"), F.col(name_col).alias("__name"))
    found = each.join(held, F.col("__id") == F.col("__key"), "left")
    packed = F.sort_array(F.collect_list(F.struct("pos", "__name")))
    return found.groupBy(key).agg(F.transform(packed, lambda x: x["__name"]).alias(name_col + "s"))
