"""Connected components of an edge list by alternating star contraction.

No node's neighbours are ever gathered in one row: every step is a grouped
minimum, summed before the shuffle, followed by an equi-join on the node and
one of ``SALTS`` salts of the edge, so a hub's edges go to as many tasks (and
Spark can split these further). Before the first step tasks of ``TASK_EDGES``
edges each contract their own by union-find, whatever the graph; where those
are all, the stars are done at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, release

#: Tasks over which a node's edges are dealt.
SALTS = 8
#: Edges that a task contracts by itself.
TASK_EDGES = 200_000


class Forest:
    """Union-find over the links that one task sees: what it gives on is no more than its nodes."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def link(self, a: int, b: int) -> None:
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def batch(self):
        """(node, its root) for the nodes that aren't roots."""
        import numpy as np
        import pyarrow as pa

        nodes = [x for x in self.parent if self.find(x) != x]
        pairs = [np.array(x, dtype=np.int64) for x in (nodes, [self.find(x) for x in nodes])]
        return pa.RecordBatch.from_arrays(list(map(pa.array, pairs)), names=["a", "b"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the least m of its a (``least``: n, m)."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.select("n", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    return dealt.join(copies, (F.col("a") == F.col("n")) & (F.col("salt") == F.col("copy"))).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """Edges of the same components, no more than each task has nodes."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
        yield forest.batch()

    return edges.repartition(max(1, -(-n // TASK_EDGES))).mapInArrow(run, "a long, b long")


def _is_done(edges: DataFrame) -> bool:
    """Edges (child, parent) are final once no parent is a child and no child hangs on two parents."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    odd = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)")
    return odd.limit(1).count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't the smallest of its component.

    Null ends and self-loops are ignored; an empty list gives an empty result.
    Raises if ``max_rounds`` rounds don't suffice (they double the reach each).
    """
    raw = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    now = materialize(_contracted(raw, raw.count()), "stars")
    release(raw)
    for _ in range(max_rounds):
        if _is_done(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        new = materialize(_small_star(_large_star(now)), "stars")
        release(now)
        now = new
    raise RuntimeError("connected components did not converge")
