"""Approximate nearest neighbours by cosine over low-dimensional stable projections.

Unit vectors are projected to ``dims`` dimensions by a fixed Gaussian
(2-stable) matrix, where the squared projected distance over the squared true
distance is chi-square with ``dims`` degrees of freedom. A kd-tree over a
bounded sample of projections cuts the space into cells, one block of rows
each; every block builds a kd-tree of its own projections. A query walks the
tree outward: the next nearest projected leaf is verified with true cosines,
and the walk ends once the next projected distance is so far beyond the k-th
best true distance that the chi-square test holds with confidence ``sure``.
A query first searches its own cell; the bound found there names, by the same
test, the other cells that it must visit.

Every row is indexed; only the cell boundaries come from a sample (vectors of a
length that the sample misses share one cell). Cells are numbered so that each
falls into a partition of its own. Of rows with one and the same vector, the
k + 1 smallest ids are indexed: further ones can't be among any query's k
nearest, ties going to smaller ids.

Defined results: ids are integers; columns but for id and vector are ignored,
whatever their names, except by the condition for queries; vectors that are null, empty, zero or hold a null, NaN or
infinite component take no part, nor do null ids; vectors are compared with
those of their own length only; rows that repeat an id and a vector count once;
a query has fewer than k rows where there are fewer candidates, and none where
there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_parts

DIMS = 8
SURE = 0.98
#: Rows from which the cells' boundaries are taken.
SAMPLE_ROWS = 20_000
LEAF = 64
#: Rows of a cell, which a task holds whole, and the fewest that are worth a cell of their own.
CELL_ROWS, LEAST_ROWS = 100_000, 500


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which chi-square with an even number of degrees of freedom lies with probability p."""
    import math

    def cdf(x):
        half, term, total = x / 2, 1.0, 1.0
        for i in range(1, dims // 2):
            term *= half / i
            total += term
        return 1 - math.exp(-half) * total

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(length: int, dims: int):
    import numpy as np

    return np.random.default_rng([20_14, length]).standard_normal((length, dims))


def project(vectors, dims: int):
    import numpy as np

    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return unit @ projection(vectors.shape[1], dims)


class Tree:
    """A kd-tree of points: leaves of at most ``leaf`` points with their bounding boxes."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        self.nodes = []  # (low corner, high corner, members or None, left, right)
        stack = [(np.arange(len(points)), -1, 0)] if len(points) else []
        while stack:
            own, up, side = stack.pop()
            box = points[own]
            low, high = box.min(axis=0), box.max(axis=0)
            at = len(self.nodes)
            if up >= 0:
                self.nodes[up][3 + side] = at
            wide = int(np.argmax(high - low))
            if len(own) <= leaf or low[wide] == high[wide]:
                self.nodes.append([low, high, own, -1, -1])
                continue
            self.nodes.append([low, high, None, -1, -1])
            half = len(own) // 2
            own = own[np.argpartition(box[:, wide], half)]
            stack += [(own[:half], at, 0), (own[half:], at, 1)]
        self.low = np.array([x[0] for x in self.nodes])
        self.high = np.array([x[1] for x in self.nodes])

    def walk(self, point):
        """(squared projected distance, members) of the leaves, nearest first."""
        import heapq

        import numpy as np

        if not self.nodes:
            return
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        far = (gap * gap).sum(axis=1).tolist()
        heap = [(far[0], 0)]
        while heap:
            d, at = heapq.heappop(heap)
            _, _, own, left, right = self.nodes[at]
            if own is not None:
                yield d, own
            else:
                heapq.heappush(heap, (far[left], left))
                heapq.heappush(heap, (far[right], right))


def search(tree: Tree, ids, unit, norms, query_id, query, at, k: int, limit: float, bound: float):
    """The k best (cosine, id) of a block for one query; ``bound``: a k-th best squared distance known from elsewhere."""
    import numpy as np

    best_s, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
    length = float(np.sqrt((query * query).sum()))
    for d, own in tree.walk(at):
        if d > limit * bound * (1 + 1e-9) + 1e-12:
            break
        own = own[ids[own] != query_id]
        s = (unit[own] * query).sum(axis=1) / (norms[own] * length)
        s, i = np.concatenate((best_s, s)), np.concatenate((best_i, ids[own]))
        keep = np.lexsort((i, -s))[:k]
        best_s, best_i = s[keep], i[keep]
        if len(best_s) == k:
            bound = min(bound, max(0.0, 2 - 2 * float(best_s[-1])))
    return best_s, best_i


class Cells:
    """Cuts of the projected space for each vector length: who belongs where, and how far a point is from each cell."""

    def __init__(self, samples: dict, cells: int, numbers: list[int]):
        import numpy as np

        self.boxes, self.numbers, at = {}, {}, 0
        for length, points in sorted(samples.items()):
            self.boxes[length] = self._cut(points, max(1, cells))
            more = len(self.boxes[length][0])
            self.numbers[length] = np.array([numbers[i % len(numbers)] + (i // len(numbers)) * (max(numbers) + 1) for i in range(at, at + more)], dtype=np.int64)
            at += more

    @staticmethod
    def _cut(points, cells):
        import numpy as np

        dims = points.shape[1]
        open_ = [(np.full(dims, -np.inf), np.full(dims, np.inf), points)]
        while len(open_) < cells:
            at = max(range(len(open_)), key=lambda i: len(open_[i][2]))
            low, high, own = open_.pop(at)
            if len(own) < 2:
                open_.append((low, high, own))
                break
            wide = int(np.argmax(own.std(axis=0)))
            value = float(np.median(own[:, wide]))
            left = own[:, wide] < value
            if not left.any():
                open_.append((low, high, own[:0]))  # all alike: can't be cut further
                continue
            l_high, r_low = high.copy(), low.copy()
            l_high[wide] = r_low[wide] = value
            open_ += [(low, l_high, own[left]), (r_low, high, own[~left])]
        return np.array([x[0] for x in open_]), np.array([x[1] for x in open_])

    def home(self, length: int, points):
        """The cell of each point: boxes are half open, so there is exactly one."""
        import numpy as np

        if length not in self.boxes:
            return np.full(len(points), -1 - length, dtype=np.int64)
        low, high = self.boxes[length]
        out = np.zeros(len(points), dtype=np.int64)
        for c in range(len(low)):
            out[((points >= low[c]) & (points < high[c])).all(axis=1)] = c
        return self.numbers[length][out]

    def within(self, length: int, point, reach: float):
        """Cells whose nearest point lies within the squared distance ``reach``."""
        import numpy as np

        if length not in self.boxes:
            return [-1 - length]
        low, high = self.boxes[length]
        gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
        return self.numbers[length][(gap * gap).sum(axis=1) <= reach * (1 + 1e-9) + 1e-12].tolist()


def _spread(spark, parts: int) -> list[int]:
    """A number for each of ``parts`` hash partitions: Spark deals it there."""
    found = spark.range(16 * parts + 64).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(parts)).alias("p")).agg(F.min("x").alias("x")).collect()
    return [r["x"] for r in sorted(found, key=lambda r: r["p"])]


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, sure: float = SURE, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its k nearest others found."""
    spark = rows.sparkSession
    limit = chi_square_quantile(sure, dims)
    value = F.col("v")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & value.isNotNull() & whole)
    clean = clean.dropDuplicates(["vec_id", "v"])
    alike = Window.partitionBy("v").orderBy("vec_id")
    indexed = clean.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)

    def vectors(batch, at):
        """Rows of the batch by vector length, as matrices."""
        import numpy as np

        lists = batch.column(at)
        offsets = np.asarray(lists.offsets)
        values = np.asarray(lists.values)
        lengths = np.diff(offsets)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            yield n, own, values[offsets[own][:, None] + np.arange(n)]

    n = clean.count()
    cells = cells or max(1, -(-n // CELL_ROWS), min(session_parts(spark), -(-n // LEAST_ROWS)))

    def projected(batches):
        import pyarrow as pa

        for batch in batches:
            for n, _, v in vectors(batch, 0):
                p = project(v, dims)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(p), pa.int32()), pa.array([x.tobytes() for x in p], pa.binary())], names=["n", "p"])

    sample = clean.select("v") if n <= SAMPLE_ROWS else clean.select("v").sample(fraction=SAMPLE_ROWS / n, seed=1)
    import numpy as np

    drawn: dict = {}
    for r in sample.mapInArrow(projected, "n int, p binary").collect():
        drawn.setdefault(int(r["n"]), []).append(np.frombuffer(bytes(r["p"])))
    cut = Cells({n: np.array(p).reshape(-1, dims) for n, p in drawn.items()}, cells, _spread(spark, cells))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            for length, own, v in vectors(batch, 1):
                p = project(v, dims)
                cell = cut.home(length, p)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).take(pa.array(own)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in p], pa.binary())], names=["cell", "vec_id", "v", "p"])

    schema = "cell int, vec_id long, v binary, p binary"
    blocks = indexed.select("vec_id", "v").mapInArrow(place, schema).repartition(cells, "cell")
    queries = clean.where("q").select("vec_id", "v").mapInArrow(place, schema).withColumn("bound", F.lit(float("inf"))).withColumn("home", F.col("cell"))

    def visit(key, table, asked):
        import pyarrow as pa

        out = {"query_id": [], "v": [], "p": [], "home": [], "bound": [], "vec_id": [], "score": []}
        ids = np.asarray(table.column("vec_id").combine_chunks()) if len(table) else np.zeros(0, dtype=np.int64)
        mat = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist())).reshape(len(ids), -1)
        tree = Tree(mat("p") if len(ids) else np.zeros((0, dims)))
        unit = mat("v") if len(ids) else np.zeros((0, 0))
        norms = np.sqrt((unit * unit).sum(axis=1))
        for q, v, p, home, bound in zip(*[asked.column(c).to_pylist() for c in ("vec_id", "v", "p", "home", "bound")], strict=True):
            s, i = search(tree, ids, unit, norms, q, np.frombuffer(v), np.frombuffer(p), k, limit, bound)
            out["query_id"].append(q)
            out["v"].append(v)
            out["p"].append(p)
            out["home"].append(home)
            out["bound"].append(max(0.0, 2 - 2 * float(s[-1])) if len(s) == k else float("inf"))
            out["vec_id"].append(i.tolist())
            out["score"].append(s.tolist())
        kinds = {"query_id": pa.int64(), "v": pa.binary(), "p": pa.binary(), "home": pa.int32(), "bound": pa.float64(), "vec_id": pa.list_(pa.int64()), "score": pa.list_(pa.float64())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    seen = "query_id long, v binary, p binary, home int, bound double, vec_id array<long>, score array<double>"
    at_home = blocks.groupBy("cell").cogroup(queries.groupBy("cell")).applyInArrow(visit, seen)

    def elsewhere(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"cell": [], "vec_id": [], "v": [], "p": [], "bound": [], "home": []}
            for q, v, p, home, bound in zip(*[batch.column(c).to_pylist() for c in ("query_id", "v", "p", "home", "bound")], strict=True):
                for cell in cut.within(len(v) // 8, np.frombuffer(p), limit * bound):
                    if cell != home:
                        for c, x in zip(out, (cell, q, v, p, bound, home), strict=True):
                            out[c].append(x)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

    further = at_home.select("query_id", "v", "p", "home", "bound").mapInArrow(elsewhere, "cell int, vec_id long, v binary, p binary, bound double, home int")
    away = blocks.groupBy("cell").cogroup(further.groupBy("cell")).applyInArrow(visit, seen)
    found = at_home.unionByName(away).select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
