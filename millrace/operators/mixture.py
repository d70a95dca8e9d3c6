"""Orders and epochs of mixed sources, reproducible from ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import fraction_of


def interleaved(rows: DataFrame, key: str, weight: Column, seed: int = 0) -> DataFrame:
    """``rows`` with ``order_key``: sorted by it, the next row comes from a source in proportion to its weight."""
    u = (fraction_of(F.col(key), seed) * float(1 << 52) + 0.5) / float(1 << 52)
    return rows.withColumn("order_key", -F.log(u) / weight)


def mini_epochs(rows: DataFrame, key: str, source: str, weights: dict[str, float], epochs: int = 50) -> DataFrame:
    """(key, source, epoch): a source of weight w (over the greatest) is cut into floor(1/w) shards, one an epoch, in turn.

    Shards come from the key's hash, so an epoch's rows are found without looking at other rows.
    """
    top = max(weights.values())
    shards = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, max(1, math.floor(top / w)))])
    n = F.coalesce(F.element_at(shards, F.col(source)), F.lit(1))
    own = F.floor(fraction_of(F.col(key), 17) * n).cast("int")
    turns = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.pmod(e, n) == own)
    return rows.select(key, source, F.explode(turns).alias("epoch"))


def video_fraction(modality: Column, seconds: Column, rules: list[tuple[float, float]], image: float = 1.0) -> Column:
    """What share of a data set a mixture takes: images as given, videos by the first bound that their length stays under, and none beyond the last."""
    out = None
    for bound, share in rules:
        out = F.when(seconds < bound, share) if out is None else out.when(seconds < bound, share)
    return F.when(modality == "image", image).otherwise(F.lit(0.0) if out is None else out.otherwise(0.0))


def oversampled(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as asked for, numbered; zero or null drops it."""
    n = F.coalesce(times.cast("int"), F.lit(0))
    return rows.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
