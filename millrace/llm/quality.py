"""Quality classifier: random-indexing word vectors, pooled, into a calibrated two-layer network.

Random indexing gives each word a fixed sparse random *index vector* and, as
its *word vector*, the sum of its neighbours' index vectors over the whole
corpus. Words share ``SLOTS`` hashed slots, so the table that tasks add up
and the driver broadcasts is a few megabytes whatever the corpus. A document
is the mean and the spread of its word vectors (a text that repeats itself has
next to none) and its length. A two-layer network in numpy learns the labels
from at most ``MAX_LABELLED`` labelled documents, drawn by hash, and a
temperature fitted on a fifth of them, which the weights never see, calibrates
its probabilities. Text is the only input.

Defined results: null and empty texts are scored like any other, from a zero
vector; unlabelled, null-labelled and repeated documents are scored; a
document whose rows in the labels disagree is learned once for each; of rows
that repeat a labelled id one text is learned from (that whose vector's bytes
are least); without labels of both kinds every score is the share of label 1
(0.5 without any); other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, small_batches, utf8

SLOTS, DIMS, NONZERO, WINDOW = 1 << 15, 32, 2, 2
SHARDS = 16
POOLED = 2 * DIMS + 3
#: Labelled documents from which the network learns, at most.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS = 32, 60
TOKEN = rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+"


def _index():
    """The places and signs of each slot's index vector."""
    import numpy as np

    rng = np.random.default_rng(20_05)
    return rng.integers(0, DIMS, (NONZERO, SLOTS)), rng.choice(np.array([-1, 1], dtype=np.int32), (NONZERO, SLOTS))


def slots(data: bytes, find):
    import zlib

    import numpy as np

    words = find(data)
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) & (SLOTS - 1)


def context_sums(docs: DataFrame, text_col: str = "text"):
    """The slots' summed neighbours over all documents, as an array of SLOTS x DIMS."""
    import numpy as np

    small_batches(docs.sparkSession)

    def add(batches):
        import re

        import numpy as np
        import pyarrow as pa

        find = re.compile(TOKEN).findall
        places, signs = _index()
        total = np.zeros(SLOTS * DIMS, dtype=np.int64)
        seen = False
        for batch in batches:
            lines = [slots(x, find) for x in batch.column(0).to_pylist()]
            for at in range(0, len(lines), 64):
                part = lines[at : at + 64]
                s = np.concatenate(part)
                seen = seen or len(s) > 0
                doc = np.repeat(np.arange(len(part)), list(map(len, part)))
                for step in range(1, WINDOW + 1):
                    near = doc[step:] == doc[:-step]
                    a, b = s[:-step][near], s[step:][near]
                    for i in range(NONZERO):
                        np.add.at(total, a * DIMS + places[i][b], signs[i][b].astype(np.int64))
                        np.add.at(total, b * DIMS + places[i][a], signs[i][a].astype(np.int64))
        if seen:
            rows = total.reshape(SHARDS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([x.astype(np.int32 if np.abs(x).max(initial=0) < 2**31 else np.int64).tobytes() for x in rows], pa.binary())], names=["shard", "sums"])

    def merge(key, table):
        import numpy as np
        import pyarrow as pa

        size = SLOTS * DIMS // SHARDS
        total = np.zeros(size, dtype=np.int64)
        for x in table.column("sums"):
            x = x.as_buffer()
            total += np.frombuffer(x, dtype=np.int32 if x.size == 4 * size else np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    sums = docs.select(utf8(text_col).alias("b")).mapInArrow(add, "shard int, sums binary").groupBy("shard").applyInArrow(merge, "shard int, sums binary")
    out = np.zeros((SHARDS, SLOTS * DIMS // SHARDS), dtype=np.float32)
    for r in sums.collect():
        out[r["shard"]] = np.frombuffer(bytes(r["sums"]), dtype=np.float32)
    return out.reshape(SLOTS, DIMS)


def word_vectors(sums):
    """Unit context vectors with a share of the index vectors, so that words with alike neighbours stay apart."""
    import numpy as np

    places, signs = _index()
    own = np.zeros((SLOTS, DIMS), dtype=np.float32)
    for i in range(NONZERO):
        own[np.arange(SLOTS), places[i]] += signs[i]
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (np.divide(sums, length, out=np.zeros_like(sums), where=length > 0) + 0.5 * own).astype(np.float32)


def pooled(s, vectors):
    import numpy as np

    if not len(s):
        return np.zeros(POOLED, dtype=np.float32)
    mean, square, move = np.zeros(DIMS), np.zeros(DIMS), 0.0
    for at in range(0, len(s), 8192):
        x = vectors[s[max(0, at - 1) : at + 8192]]
        step = x[1:] - x[:-1]
        move += float((step * step).sum())
        x = x[1:] if at else x
        mean += x.sum(axis=0)
        square += (x * x).sum(axis=0)
    mean /= len(s)
    spread = np.sqrt(np.maximum(square / len(s) - mean * mean, 0))
    moves = max(1, len(s) - 1)
    still = float((s[1:] == s[:-1]).sum()) / moves
    return np.concatenate((mean, spread, [np.log1p(len(s)) / 4, np.sqrt(move / moves), still])).astype(np.float32)


class Network:
    """Two layers and a temperature."""

    def __init__(self, x, y, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 9):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.ready = len(y) >= 10 and 0 < y.mean() < 1
        if not self.ready:
            return
        held = rng.random(len(y)) < 0.2
        if held.all() or not held.any() or not 0 < y[~held].mean() < 1:
            held[:] = False
        self.centre, self.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
        z, t = (x - self.centre) / self.scale, y.astype(np.float64)
        weight = np.where(t > 0, 0.5 / t[~held].mean(), 0.5 / (1 - t[~held].mean()))
        weight = np.sqrt(weight / weight.mean())
        n = x.shape[1]
        p = [rng.standard_normal((n, hidden)) / np.sqrt(n), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        train = np.flatnonzero(~held)
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs)
            for own in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                a = np.tanh(z[own] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - t[own]) * weight[own] / len(own)
                back = np.outer(d, p[2]) * (1 - a * a)
                grads = [z[own].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = p, 1.0
        check = np.flatnonzero(held) if held.any() else train
        logit = self._logit(x[check])
        loss = lambda temp: np.logaddexp(0, np.where(y[check] > 0, -1, 1) * logit / temp).mean()
        self.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)

    def _logit(self, x):
        import numpy as np

        p = self.weights
        return np.tanh(((x - self.centre) / self.scale) @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, x):
        import numpy as np

        if not self.ready:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Documents that labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, vectors, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Network:
    """The network, learned from labelled documents that aren't held out."""
    import numpy as np

    known = labelled(labels, id_col, F.col(label_col).cast("int"), held_out(id_col), max_labelled, 9)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        import re

        import pyarrow as pa

        find = re.compile(TOKEN).findall
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pooled(slots(x, find), held.value).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("b"))
    found = texts.join(F.broadcast(known), "id").select("id", "y", "b").mapInArrow(pool, "id string, y int, x binary")
    rows = sorted((r["y"], bytes(r["x"])) for r in found.groupBy("id", "y").agg(F.min("x").alias("x")).toLocalIterator())
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float32).reshape(len(rows), POOLED).astype(np.float64)
    return Network(x, np.array([r[0] > 0 for r in rows], dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, score_col: str = "score") -> DataFrame:
    """``docs`` with their score (0 to 1) as ``score_col``, which replaces a column of that name."""
    vectors = word_vectors(context_sums(docs, text_col))
    network = fit(docs, labels, vectors, id_col, text_col, label_col, max_labelled)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at = docs.columns.index(text_col)
    schema = docs.drop(score_col).schema.add(score_col, "double", False)
    keep = [i for i, c in enumerate(docs.columns) if c != score_col]

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa

        find = re.compile(TOKEN).findall
        vectors, network = held.value
        for batch in batches:
            x = [pooled(slots((t or "").encode(), find), vectors) for t in batch.column(at).to_pylist()]
            scores = network.score(np.array(x, dtype=np.float64).reshape(len(x), POOLED))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(scores)], names=[*[batch.schema.names[i] for i in keep], score_col])

    return docs.mapInArrow(run, schema)
