"""Interleaved documents: arrays of text and image nodes, rebuilt by array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = "END_OF_DOCUMENT_TOKEN_TO_BE_REPLACED"
NODE = "struct<text: string, src: string>"
#: Formats that are kept, sides and shapes: the numbers of the curation recipe.
FORMATS = ("jpg", "jpeg", "png", "webp")


def image_passes(kind: Column, width: Column, height: Column, shown_width: Column, shown_height: Column, least: int = 150, most: int = 20000, aspect: float = 2.0) -> Column:
    """Format, original and shown size and shape; what isn't known passes."""
    side = lambda c: F.coalesce(c.between(least, most), F.lit(True))
    shape = F.coalesce((width / height).between(1 / aspect, aspect), F.lit(True))
    return (kind.isNull() | kind.isin(*FORMATS)) & side(width) & side(height) & side(shown_width) & side(shown_height) & shape


def merge_texts(nodes: Column, sep: str = "\n\n") -> Column:
    """Neighbouring texts as one; empty texts vanish, an image parts them."""
    empty = F.array().cast(f"array<{NODE}>")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, n):
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(last(acc)["text"], F.lit(sep), n["text"]).alias("text"), F.lit(None).cast("string").alias("src"))))
        own = F.concat(acc, F.array(F.struct(n["text"].alias("text"), n["src"].alias("src"))))
        is_text = n["src"].isNull()
        return F.when(is_text & (F.coalesce(n["text"], F.lit("")) == ""), acc).when(is_text & (F.size(acc) > 0), F.when(F.try_element_at(acc, F.lit(-1))["text"].isNotNull(), joined).otherwise(own)).otherwise(own)

    return F.aggregate(nodes, empty, step)


def drop_repeated_markers(text: Column, sep: str = "\n\n", marker: str = MARKER) -> Column:
    parts = F.split(text, sep)
    return F.array_join(F.filter(parts, lambda p, i: ~((p == marker) & (i > 0) & (F.get(parts, i - 1) == marker))), sep)


def drop_last_marker(text: Column, sep: str = "\n\n", marker: str = MARKER) -> Column:
    parts = F.split(text, sep)
    return F.when(F.element_at(parts, -1) == marker, F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)).otherwise(text)


def first_of_each_image(nodes: Column) -> Column:
    """Later nodes with an image that came before go."""
    sources = F.transform(nodes, lambda n: n["src"])
    return F.filter(nodes, lambda n, i: n["src"].isNull() | (F.array_position(sources, n["src"]) == i + 1))


def has_both(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: n["src"].isNotNull()) & F.exists(nodes, lambda n: n["text"].isNotNull())


def not_only_markers(nodes: Column, marker: str = MARKER) -> Column:
    return ~F.forall(F.filter(nodes, lambda n: n["text"].isNotNull()), lambda n: n["text"] == marker)


def image_count(nodes: Column) -> Column:
    return F.size(F.filter(nodes, lambda n: n["src"].isNotNull()))


def longest_image_run(nodes: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc, n):
        run = F.when(n["src"].isNotNull(), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(nodes, start, step, lambda acc: acc["most"])


def attach(docs: DataFrame, images: DataFrame, key: str = "doc_id", url: str = "url", value: str = "bytes") -> DataFrame:
    """(key, nodes, num_found, num_not_found): an outer join of exploded nodes with the images, regrouped in order."""
    each = docs.select(key, F.posexplode("nodes").alias("pos", "n"))
    held = images.select(F.col(url).alias("__url"), F.col(value).alias("__value"))
    joined = each.join(held, F.col("n.src") == F.col("__url"), "left")
    packed = F.sort_array(F.collect_list(F.struct("pos", F.col("n.text").alias("text"), F.col("n.src").alias("src"), F.col("__value").alias(value))))
    asked = F.col("n.src").isNotNull()
    return joined.groupBy(key).agg(F.transform(packed, lambda x: F.struct(x["text"].alias("text"), x["src"].alias("src"), x[value].alias(value))).alias("nodes"), F.count_if(asked & F.col("__url").isNotNull()).alias("num_found"), F.count_if(asked & F.col("__url").isNull()).alias("num_not_found"))


def without_images(docs: DataFrame, listed: DataFrame, key: str = "doc_id", url: str = "url") -> DataFrame:
    """Image nodes whose address is listed go; the join is on addresses, so the list may be of any size."""
    each = docs.select(key, F.posexplode_outer("nodes").alias("pos", "n"))
    kept = each.join(listed.select(F.col(url).alias("__url")).distinct(), F.col("n.src") == F.col("__url"), "left_anti").where("n is not null")
    back = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("n.text").alias("text"), F.col("n.src").alias("src")))), lambda x: F.struct(x["text"].alias("text"), x["src"].alias("src"))).alias("nodes"))
    return docs.drop("nodes").join(back, key, "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(f"array<{NODE}>")))


def captions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, src, caption): each image with the first paragraph of the text right after it."""
    each = docs.select(key, F.posexplode("nodes").alias("pos", "n"))
    after = F.lead("n.text").over(Window.partitionBy(key).orderBy("pos"))
    return each.withColumn("after", after).where("n.src is not null").select(key, F.col("n.src").alias("src"), F.get(F.split("after", "\n\n"), F.lit(0)).alias("caption"))


def split_at_markers(docs: DataFrame, key: str = "doc_id", marker: str = MARKER) -> DataFrame:
    """(key, part, nodes): a document cut where a marker stands alone in a node."""
    each = docs.select(key, F.posexplode("nodes").alias("pos", "n"))
    is_marker = F.coalesce(F.col("n.text") == marker, F.lit(False))
    part = F.sum(is_marker.cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    held = each.withColumn("part", part).where(~is_marker)
    return held.groupBy(key, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("nodes"))


def sources(nodes: Column) -> Column:
    """Pictures as their addresses: what a published copy holds in place of bytes; null where a text stands."""
    return F.transform(nodes, lambda n: n["src"])
