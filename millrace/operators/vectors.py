"""Embeddings: normalisation, centroids, exact top-k and votes; crossmatch on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean): means by component, summed before the shuffle."""
    return rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


#: Scores that a task of ``top_k`` holds at once.
SCORES = 4_000_000


def top_k(rows: DataFrame, is_query: Column, key: str, vector: str, k: int = 5, query_block: int = 4096, row_block: int = 50_000) -> DataFrame:
    """(query_id, rank, key, score): each query's k rows of largest cosine, itself left out, ties to smaller ids.

    Queries and rows are dealt into blocks, and each pair of blocks is one
    matrix product in a task of its own, of which each query's k best (and
    ties) go on: nothing passes through the driver, and blocks are bounded.
    """
    whole = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    n = whole.agg(F.count("*").alias("rows"), F.count_if("q").alias("queries")).first()
    deals, blocks = max(1, -(-n["queries"] // query_block)), max(1, -(-n["rows"] // row_block))
    part = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    held = whole.select("id", "v", part(blocks, 1).alias("i"), every(deals).alias("j"))
    asked = whole.where("q").select(F.col("id").alias("qid"), F.col("v").alias("w"), part(deals, 2).alias("qj"), every(blocks).alias("qi"))

    def compare(_, table, queries):
        import numpy as np
        import pyarrow as pa

        kinds = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        if not len(table) or not len(queries):
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        def matrix(x):
            vectors = x.column(1).combine_chunks()
            return np.asarray(x.column(0).combine_chunks()), np.asarray(vectors.flatten()).reshape(len(vectors), -1)

        (own, v), (qid, q) = (matrix(x.select([c, w])) for x, c, w in ((table, "id", "v"), (queries, "qid", "w")))
        lengths, found = np.sqrt((v * v).sum(axis=1)), []
        # Queries in parts, so that a part's scores are some 32 MB.
        step = max(1, SCORES // len(own))
        for at in range(0, len(qid), step):
            ids, part = qid[at : at + step], q[at : at + step]
            score = (part @ v.T) / (np.sqrt((part * part).sum(axis=1))[:, None] * lengths[None, :])
            score[ids[:, None] == own[None, :]] = -np.inf
            last = min(k, len(own)) - 1
            # Ties at the edge: take every row as good as the k-th best, of equal scores the k smallest ids.
            least = -np.partition(-score, last, axis=1)[:, : last + 1].max(axis=1)
            a, b = np.nonzero((score >= least[:, None] - 1e-12) & (score > -np.inf))
            s = score[a, b]
            order = np.lexsort((own[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.ones(len(a), dtype=bool)
            first[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            found.append((ids[a[place < k]], own[b[place < k]], s[place < k]))
        return pa.table({c: pa.array(np.concatenate(x), t) for (c, t), x in zip(kinds.items(), zip(*found, strict=True), strict=True)})

    out = held.groupBy("i", "j").cogroup(asked.groupBy("qi", "qj")).applyInArrow(compare, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]


def crossmatch(left: DataFrame, right: DataFrame, key: str, ra: str = "ra", dec: str = "dec", radius: float = 1.0 / 3600, how: str = "left") -> DataFrame:
    """Each left point's nearest right point within ``radius`` degrees: (left columns, match_id, distance in degrees).

    Points meet in cells of a cube around the sphere, a cell being wider than
    the chord of the radius: right points are copied to their 27 cells, left
    points stand in one. So that dense regions make few pairs, equal places
    are one, and left points look within a small radius first; those without
    a match there go on to four times that radius, up to ``radius``.
    ``how``: ``left``, ``inner`` or ``anti`` (no match).
    """
    import math

    from ..sources.shared import materialize

    x, y, z = unit_vector(F.col(ra), F.col(dec))
    rest = materialize(left.select(F.col(ra).alias("__ra"), F.col(dec).alias("__dec"), x.alias("__x"), y.alias("__y"), z.alias("__z")).where("__ra is not null and __dec is not null").dropDuplicates(["__ra", "__dec"]), "left")
    b = materialize(right.select(F.col(key).alias("match_id"), x.alias("__u"), y.alias("__v"), z.alias("__w")).groupBy("__u", "__v", "__w").agg(F.min("match_id").alias("match_id")), "right")
    # A first radius within which few right places are on average, if they cover a quarter of the sphere.
    steps = max(0, math.ceil(math.log(max(1.0, b.count() * radius * radius / 10_000), 16)))
    d2 = F.pow(F.col("__x") - F.col("__u"), 2) + F.pow(F.col("__y") - F.col("__v"), 2) + F.pow(F.col("__z") - F.col("__w"), 2)
    matched = None
    for step in range(steps, -1, -1):
        chord = 2 * math.sin(math.radians(radius / 4**step) / 2)
        width = max(chord * 1.0001, 1e-9)
        cell = lambda c: F.floor(c / width).cast("long")  # noqa: B023, E731
        near = lambda c: F.explode(F.array(*[cell(F.col(c)) + i for i in (-1, 0, 1)]))
        here = rest.withColumns({"__cx": cell(F.col("__x")), "__cy": cell(F.col("__y")), "__cz": cell(F.col("__z"))})
        there = b.select("*", near("__u").alias("__cx")).select("*", near("__v").alias("__cy")).select("*", near("__w").alias("__cz"))
        met = here.join(there.hint("shuffle_merge"), ["__cx", "__cy", "__cz"]).where(d2 <= chord * chord)
        found = materialize(met.groupBy("__ra", "__dec").agg(F.min(F.struct(d2.alias("d2"), "match_id")).alias("m")), "found")
        matched = found if matched is None else matched.unionByName(found)
        if step:
            rest = materialize(rest.join(found.select("__ra", "__dec"), ["__ra", "__dec"], "left_anti"), "left")
    pairs = left.select(F.col(key), F.col(ra).alias("__ra"), F.col(dec).alias("__dec")).join(matched, ["__ra", "__dec"]).select(key, "m")
    if how == "anti":
        return left.join(pairs.select(key), key, "left_anti")
    distance = F.degrees(2 * F.asin(F.sqrt("m.d2") / 2))
    return left.join(pairs, key, how).select(*left.columns, F.col("m.match_id").alias("match_id"), distance.alias("distance"))


def contains_pixel(order_a: Column, pixel_a: Column, order_b: Column, pixel_b: Column) -> Column:
    """Whether two pixels of a hierarchical grid (four children each) overlap: one is the other or its ancestor."""
    up = lambda pixel, steps: F.floor(pixel / F.pow(F.lit(4.0), steps)).cast("long")
    low = F.least(order_a, order_b)
    return up(pixel_a, order_a - low) == up(pixel_b, order_b - low)


def asinh_flux(flux: Column, scale: Column) -> Column:
    return F.asinh(flux / scale)
