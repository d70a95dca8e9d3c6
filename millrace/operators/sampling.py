"""Reproducible sampling, splits, shards and packing: order comes from hashes of ids, never from chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(key: Column, seed: int = 0) -> Column:
    """A shuffled order that any engine can reproduce: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def fraction_of(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the key: 52 bits of its SHA-256."""
    return F.conv(F.substring(order_of(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_rank(rows: DataFrame, key: str, by: list[str], seed: int = 0) -> DataFrame:
    """``rows`` with ``__rank``, from 1 in hash order of the key within each ``by``, and ``__total``, the rows of that.

    Rows are ranked within 4096 ranges of the hash, to which the counts of the
    ranges before are added, so a stratum however large is no one task.
    """
    order = order_of(F.col(key), seed)
    held = rows.withColumns({"__order": order, "__bin": F.conv(F.substring(order, 1, 3), 16, 10).cast("int")})
    counts = held.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__bin").alias("__at")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*[f"__by{i}" for i in range(len(by))])
    counts = counts.withColumns({"__before": F.coalesce(F.sum("n").over(own.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__total": F.sum("n").over(own)}).drop("n")
    same = F.col("__bin") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "__bin").orderBy("__order", key))
    ranked = held.join(counts, same).withColumn("__rank", (place + F.col("__before")).cast("long"))
    return ranked.select(*rows.columns, "__rank", "__total")


def stratified_split(rows: DataFrame, key: str, stratum: str, held: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: of each stratum, the first ``held`` share in hash order is ``test``."""
    ranked = hash_rank(rows, key, [stratum], seed)
    return ranked.select(*rows.columns, F.when(F.col("__rank") <= F.floor(F.col("__total") * held + 0.5), "test").otherwise("train").alias("split"))


def hash_split(rows: DataFrame, key: str, held: float = 0.02, seed: int = 0) -> DataFrame:
    """``rows`` with ``split`` from the key alone: no shuffle, and new rows never move old ones."""
    return rows.withColumn("split", F.when(fraction_of(F.col(key), seed) < held, "val").otherwise("train"))


def sample(rows: DataFrame, strategy: str, key: str, by: str | None = None, seed: int = 0) -> DataFrame:
    """``all``, ``first:N``, ``end:N`` or ``random:N`` rows by key, of each ``by``; N may be a percentage (one row at least)."""
    if strategy == "all":
        return rows
    kind, _, amount = strategy.partition(":")
    share = float(amount[:-1]) if amount.endswith("%") else None
    if kind == "random":
        ranked = hash_rank(rows, key, [by] if by else [], seed)
        most = F.greatest(F.lit(1), F.ceil(F.col("__total") * share / 100)) if share is not None else F.lit(int(amount))
        return ranked.where(F.col("__rank") <= most).select(*rows.columns)
    order = F.col(key) if kind == "first" else F.col(key).desc()
    if by is None:  # a sorted limit keeps no more than so many rows of each task
        n = int(amount) if share is None else max(1, -(-rows.count() * share // 100))
        return rows.orderBy(order).limit(int(n))
    group = Window.partitionBy(by)
    most = F.greatest(F.lit(1), F.ceil(F.count("*").over(group) * share / 100)) if share is not None else F.lit(int(amount))
    return rows.withColumns({"__n": F.row_number().over(group.orderBy(order)), "__most": most}).where("__n <= __most").drop("__n", "__most")


def contiguous_shards(rows: DataFrame, key: str, size: int, held_shards: int = 2) -> DataFrame:
    """``rows`` with shard_id and split: runs of ``size`` rows by key, the first shards held out.

    Ranks come from range partitions and their counts, so no task sees all rows.
    """
    ranked = rank_all(rows, key)
    shard = F.floor((F.col("rank") - 1) / size).cast("long")
    return ranked.withColumn("shard_id", shard).withColumn("split", F.when(shard < held_shards, "valid").otherwise("train")).drop("rank")


def rank_all(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 in order of a unique key, by range partitions: each counts, then each ranks its own."""
    n = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bins = rows.select(F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10 * n)).alias("cuts"))
    edges = sorted(set(bins.first()["cuts"] or []))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key))) if edges else F.lit(0)
    held = rows.withColumn("__part", part)
    counts = held.groupBy("__part").agg(F.count("*").alias("n"))  # as many rows as ranges
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return held.join(F.broadcast(before), "__part").withColumn("rank", (own + F.col("__before")).cast("long")).drop("__part", "__before")


def quotas(rows: DataFrame, source: str, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """(source, n, weight, share, copies): weights over their sum, and whole copies when the greatest weight has one pass."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(source)) if weights else F.lit(None).cast("double"), F.lit(default))
    counts = rows.groupBy(source).agg(F.count("*").alias("n")).withColumn("weight", weight)
    every = Window.partitionBy()
    return counts.withColumn("share", F.col("weight") / F.sum("weight").over(every)).withColumn("normalised", F.col("weight") / F.max("weight").over(every)).withColumn("n_shards", F.floor(1 / F.col("normalised")).cast("long"))


def pack_next_fit(rows: DataFrame, group: str, order: str, size: str, room: int) -> DataFrame:
    """(group, order, bin, offset): items in order, a new bin when the next one doesn't fit; an over-long item has a bin alone.

    Order decides, so a group is packed in one task: choose groups (shards) that are bounded.
    """
    import pyarrow as pa

    def run(table):
        t = table.sort_by(order)
        bins, offsets, at, used = [], [], -1, None
        for n in t.column(size).to_pylist():
            n = n or 0
            if used is None or used + n > room:
                at, used = at + 1, 0
            bins.append(at)
            offsets.append(used)
            used += n
        return pa.table({group: t.column(group), order: t.column(order), "bin": pa.array(bins, pa.int64()), "offset": pa.array(offsets, pa.int64())})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, size).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, bin long, offset long")


def pack_first_fit(rows: DataFrame, group: str, order: str, size: str, room: int, count: str | None = None, most: int | None = None) -> DataFrame:
    """(group, order, bin): each item in the first open bin with room for its size, and for its ``count`` (pictures, say) up to ``most``.

    Items beyond ``room`` or ``most`` are left out (bin null). The first bin
    with room is found in a tree over the bins, so an item costs the logarithm
    of their number where only sizes count.
    """
    import pyarrow as pa

    def run(table):
        t = table.sort_by(order)
        sizes = [n or 0 for n in t.column(size).to_pylist()]
        counts = [n or 0 for n in t.column(count).to_pylist()] if count else [0] * len(sizes)
        limit = most if most is not None else 0
        width = 1 << max(0, len(sizes) - 1).bit_length()
        tree, held, open_ = [-1] * (2 * width), [0] * width, 0  # the most room below each node, -1 where no bin is open; what bins hold of the second size
        bins = []
        for n, k in zip(sizes, counts, strict=True):
            if n > room or (most is not None and k > limit):
                bins.append(None)
                continue
            at, stack = -1, [1]
            while stack:  # leftmost leaf with room for both
                x = stack.pop()
                if tree[x] < n:
                    continue
                if x >= width:
                    if most is None or held[x - width] + k <= limit:
                        at = x - width
                        break
                    continue
                stack += [2 * x + 1, 2 * x]
            if at < 0:
                at, open_ = open_, open_ + 1
                left = room
            else:
                left = tree[at + width]
            held[at] += k
            x = at + width
            tree[x] = left - n
            while x > 1:
                x //= 2
                tree[x] = max(tree[2 * x], tree[2 * x + 1])
            bins.append(at)
        return pa.table({group: t.column(group), order: t.column(order), "bin": pa.array(bins, pa.int64())})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, size, *([count] if count else [])).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, bin long")


def pack_whole(rows: DataFrame, group: str, order: str, size: str, room: int) -> DataFrame:
    """``pack_next_fit`` of whole objects: also where each starts and ends in its bin, and the padding behind the bin's last. Raises for an object beyond ``room``."""
    packed = pack_next_fit(rows.withColumn(size, F.when(F.col(size) > room, F.raise_error(F.concat(F.lit("an object is longer than the room: "), F.col(size).cast("string"))).cast("int")).otherwise(F.col(size))), group, order, size, room)
    sized = packed.join(rows.select(F.col(group).alias("__g"), F.col(order).alias("__o"), F.col(size).alias("__n")), F.col(group).eqNullSafe(F.col("__g")) & (F.col(order) == F.col("__o"))).drop("__g", "__o")
    last = F.max(F.col("offset") + F.col("__n")).over(Window.partitionBy(group, "bin"))
    end = F.col("offset") + F.col("__n")
    return sized.select(group, order, "bin", "offset", end.cast("long").alias("end"), F.when(end == last, F.lit(room) - end).otherwise(0).cast("long").alias("padding"))


def uniform_indices(n: Column, count: int) -> Column:
    """``count`` evenly spaced indices of 0..n-1, ends included, repeats removed."""
    step = F.when(F.lit(count) > 1, (n - 1) / F.lit(max(1, count - 1))).otherwise(0.0)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * step).cast("long")))


def pixel_split(rows: DataFrame, pixel: str, order: int, ancestor: int, held: float = 0.02, seed: int = 0) -> DataFrame:
    """``rows`` with ``split`` by the ancestor of their sky pixel, so neighbours stay on one side; no shuffle."""
    above = F.shiftright(F.col(pixel).cast("long"), 2 * (order - ancestor))
    return rows.withColumn("split", F.when(fraction_of(above, seed) < held, "val").otherwise("train"))
