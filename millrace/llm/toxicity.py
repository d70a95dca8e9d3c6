"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are the distinct words of a text and their beginnings, hashed into
``BUCKETS``. One weight vector serves all thresholds: the probability of a
grade above k is the logistic of the text's score less threshold k, and
thresholds keep their order by being sums of positive steps. The output is the
expected grade. Labels of two grades only are spread to three (``spread``): of
the upper ones, those with more features than the median that go with the
upper grade at ``LEAST_Z`` standard errors are severe. Weights are learned on the driver from at most
``MAX_LABELLED`` labelled texts, drawn by hash, of which executors send only
hashed features; those that go with the grade at less than ``LEAST_Z``
standard errors, or occur in fewer than ``LEAST_TEXTS`` texts, weigh nothing, so
a long text gathers no noise.

Defined results: null and empty texts have no features and the grade of the
thresholds alone; null grades and null ids aren't learned from, nor are rows of
``held_out``; of rows that repeat a labelled id one text is learned from (that
of least features, by their bytes), and each gets its answer; without two
different grades every text gets the one there is (0 without any); columns but
for id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, small_batches
from .decontaminate import NORMAL

BUCKETS = 1 << 20
START = 6
#: Labelled texts from which the weights are learned, at most.
MAX_LABELLED = 10_000
LEAST_TEXTS, LEAST_Z = 3, 4.0


def features(text: str | None):
    """The distinct hashed features of a whole text."""
    import zlib

    import numpy as np

    words = set((text or "").lower().encode().translate(NORMAL).split())
    starts = {w[:START] for w in words}
    ids = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
    more = np.fromiter((zlib.crc32(w, 1) for w in starts), dtype=np.int64, count=len(starts))
    return np.unique(np.concatenate((ids, more)) % BUCKETS)


class OrdinalModel:
    """P(grade > k) = logistic(score - threshold[k]), thresholds rising."""

    def __init__(self, rows, grades, rounds: int = 600, shrink: float = 1e-4, spread: bool = False):
        """``rows``: arrays of distinct features; ``grades``: any ordered numbers."""
        import numpy as np

        y = np.asarray(grades)
        self.grades = np.unique(y)
        self.weights = np.zeros(BUCKETS, dtype=np.float32)
        self.thresholds = np.zeros(0)
        if len(self.grades) < 2:
            return
        level = np.searchsorted(self.grades, y)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        column, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        # A feature's texts should differ in grade from the average by LEAST_Z standard errors.
        texts = np.bincount(column, minlength=BUCKETS)
        total = np.bincount(column, weights=level[row], minlength=BUCKETS)
        n = len(rows)
        error = np.sqrt(np.maximum(texts * (1 - texts / n), 1e-9) * level.var())
        good = (texts >= LEAST_TEXTS) & (np.abs(total - texts * level.mean()) >= LEAST_Z * error)
        self.chosen = np.flatnonzero(good)
        if spread and len(self.grades) == 2:
            hits = np.bincount(row, weights=(good & (total > texts * level.mean()))[column], minlength=n)
            severe = (level == 1) & (hits > np.median(hits[level == 1]))
            if severe.any() and (level == 1).sum() > severe.sum():
                level = level + severe
                self.grades = np.append(self.grades, 2 * self.grades[1] - self.grades[0])
        keep = good[column]
        column, row = np.searchsorted(self.chosen, column[keep]), row[keep]
        k = len(self.grades) - 1
        above = np.array([(level > i).mean() for i in range(k)])
        cuts = -np.log(above / (1 - above))
        params = np.concatenate((np.zeros(len(self.chosen)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))))
        m, v, f = np.zeros_like(params), np.zeros_like(params), len(self.chosen)
        for step in range(1, rounds + 1):
            w, cuts = params[:f], self._cuts(params[f:])
            score = np.bincount(row, weights=w[column], minlength=n)
            p = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30))), np.zeros((n, 1))), axis=1)
            own = np.maximum(p[np.arange(n), level] - p[np.arange(n), level + 1], 1e-9)
            slope = p * (1 - p)
            up, down = slope[np.arange(n), level], slope[np.arange(n), level + 1]
            d_score = -(up - down) / own / n
            d_cut = np.zeros(k + 2)
            np.add.at(d_cut, level, up / own / n)
            np.add.at(d_cut, level + 1, -down / own / n)
            d_cut = d_cut[1:-1]
            tail = np.cumsum(d_cut[::-1])[::-1]
            grad = np.concatenate((np.bincount(column, weights=d_score[row], minlength=f) + shrink * w, [tail[0]], tail[1:] * np.exp(params[f + 1 :])))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            params = params - 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights[self.chosen] = params[:f]
        self.thresholds = self._cuts(params[f:])

    @staticmethod
    def _cuts(params):
        import numpy as np

        return params[0] + np.concatenate(([0.0], np.cumsum(np.exp(params[1:]))))

    def above(self, ids):
        """The probabilities that a text with these features has a grade above the first, the second and so on."""
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(float(self.weights[ids].sum()) - self.thresholds, -30, 30)))

    def expected(self, ids) -> float:
        """The expected grade of a text with these features."""
        import numpy as np

        if len(self.grades) < 2:
            return float(self.grades[0]) if len(self.grades) else 0.0
        return float(self.grades[0] + (np.diff(self.grades) * self.above(ids)).sum())


def held_out(id_col: str = "doc_id"):
    """Documents kept out of learning, to measure on: crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", max_labelled: int = MAX_LABELLED, spread: bool = True) -> OrdinalModel:
    import numpy as np

    small_batches(docs.sparkSession)
    known = labelled(labels, id_col, F.col(grade_col).cast("double"), held_out(id_col), max_labelled, 8)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x).astype(np.int32).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    found = texts.join(F.broadcast(known), "id").select("id", "y", "t").mapInArrow(run, "id string, y double, x binary")
    rows = sorted((r["y"], bytes(r["x"])) for r in found.groupBy("id", "y").agg(F.min("x").alias("x")).toLocalIterator())
    return OrdinalModel([np.frombuffer(x, dtype=np.int32) for _, x in rows], [y for y, _ in rows], spread=spread)


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", max_labelled: int = MAX_LABELLED, spread: bool = True) -> DataFrame:
    """(doc_id, held_out, severity, p_above) for every row of ``docs``: the whole text's expected grade, and the probability of any but the least."""
    model = fit(docs, labels, id_col, text_col, grade_col, max_labelled, spread)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            ids = [features(x) for x in batch.column(2).to_pylist()]
            above = [float(model.above(x)[0]) if len(model.thresholds) else 0.0 for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.expected(x) for x in ids], pa.float64()), pa.array(above, pa.float64())], names=["doc_id", "held_out", "severity", "p_above"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, severity double, p_above double")
