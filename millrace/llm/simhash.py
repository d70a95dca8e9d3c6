"""SimHash near-duplicates: fingerprints compared exactly, tile by tile.

A fingerprint's bit is set where more than half of the document's shingle
hashes set it. Distinct fingerprints are range-partitioned by a cell and then
by themselves, and cut into tiles, so no cell however full is one task. Tiles
of cells that can hold fingerprints within the radius meet; tile pairs whose
population counts differ beyond it are skipped, the others are compared in
full by exclusive-or and bit counts in numpy. A tile pair reports a spanning
forest of its links, never all pairs, so a large group of near copies yields
no more links than it has fingerprints.

* ``simhash_components``: 64 bits; a cell is the population counts of the four
  16-bit words, and cells meet whose counts differ by ``radius`` at most in sum.
  A radius of 3 bits finds nearly equal texts only: of pairs with a Jaccard
  similarity of 0.8 to 0.9 over five words it links about one in twelve.
* ``near_classes``: 256 bits at a radius that misses a pair of Jaccard
  similarity 0.8 once in some thousand times; a cell is a class of texts whose
  numbers of shingles are within a quarter, and classes meet their neighbours
  (others can't reach 0.8). What the tiles link are candidates: groups of them
  are verified by the exact similarity of their shingle sets.

The work of comparing grows with the square of the distinct fingerprints, over
about 40 in the first and over about 8 in the second, by design of the method.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a null ``doc_id`` keeps its row but
can't name a component (null only if the whole component has none); repeated
rows stay, each with the same answer; extra columns of the input, whatever
their names, are ignored, or kept by ``simhash_dedup`` and ``near_dedup``.
Ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup
from .common import fresh, materialize, small_batches, utf8
from .components import Forest, components

SHINGLE, SEED, RADIUS, TILE = 3, 42, 3, 4096
#: Near copies: shingle length, least Jaccard similarity, and bits that a pair may differ in: of the first 64 and of all 256.
#: At 0.8 a bit differs with odds of 0.15 (0.19 in the shortest texts), that is 39 of 256 bits (48), give or take 6.
NEAR_SHINGLE, NEAR, NEAR_FIRST, NEAR_ALL = 5, 0.8, 24, 72


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one whole text, given as UTF-8."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # splits at space and \\t..\\r only, and lower-cases A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(line[i:j], seed) for i, j in zip(starts.tolist(), last, strict=False)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) per row; ``fp`` holds the fingerprint's 64 bits."""
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("b"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _tiles(rows: DataFrame, cell: list[str], words: list[str], tile: int) -> DataFrame:
    """(``cell``, tile: number of its first row, data) of distinct rows: at most ``tile`` rows of one cell, their ``words`` as longs."""
    line = [*cell, *words]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        def out(own):
            key = own[0, : len(cell)].tolist()
            arrays = [*[pa.array([x], pa.int64()) for x in key], pa.array([int(own[0, -1])], pa.int64()), pa.array([np.ascontiguousarray(own[:, len(cell) :]).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*cell, "tile", "data"])

        held = np.zeros((0, len(line)), dtype=np.int64)
        for batch in batches:
            held = np.concatenate((held, np.column_stack([np.asarray(x) for x in batch.columns])))
            while len(held):
                same = int((held[:, : len(cell)] == held[0, : len(cell)]).all(axis=1).argmin()) or len(held)
                if same == len(held) < tile:
                    break  # the next batch may go on
                yield out(held[: min(same, tile)])
                held = held[min(same, tile) :]
        if len(held):
            yield out(held)

    longs = rows.select(*[F.col(c).cast("long").alias(c) for c in line])
    cuts = longs.repartitionByRange(*line).sortWithinPartitions(*line).mapInArrow(cut, ", ".join(f"{c} long" for c in [*cell, "tile"]) + ", data binary")
    return materialize(cuts, "tiles")


def _near(radius: int) -> list[tuple[int, ...]]:
    """Half of the steps between count vectors that lie within the radius; the zero step comes first."""
    side = range(-radius, radius + 1)
    return sorted(s for a in side for b in side for c in side for d in side if abs(a) + abs(b) + abs(c) + abs(d) <= radius and (s := (a, b, c, d)) >= (0, 0, 0, 0))


def tile_links(a, b, radius: int = RADIUS, most: int | None = None):
    """A spanning forest of the links between two tiles: pairs of the rows' last numbers.

    A row is a fingerprint's 64-bit words, then the number that names it (a
    fingerprint of one word names itself). Rows link at ``radius`` differing
    bits of the first word and ``most`` of all.
    """
    import numpy as np

    if not len(a) or not len(b):
        return []
    a, b = (z.reshape(len(z), -1) for z in (a, b))
    x, y = np.ascontiguousarray(a.T).view(np.uint64), np.ascontiguousarray(b.T).view(np.uint64)
    ones = [np.bitwise_count(w[0]) for w in (x, y)]
    if int(ones[0].min()) - int(ones[1].max()) > radius or int(ones[1].min()) - int(ones[0].max()) > radius:
        return []
    label = np.arange(len(a) + len(b))
    found = []
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        close = np.bitwise_count(x[0, at : at + step, None] ^ y[0][None, :]) <= radius
        if most is not None:
            i, j = np.nonzero(close)
            apart = sum(np.bitwise_count(w[at + i] ^ z[j]).astype(np.int64) for w, z in zip(x[:-1], y[:-1], strict=True))
            close[i, j] = apart <= most
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            to = np.flatnonzero(close[i])
            own = label[at + i]
            of, first = np.unique(label[len(a) + to], return_index=True)
            for other, j in zip(of.tolist(), to[first].tolist(), strict=True):
                if other != own:
                    label[label == other] = own
                    if a[at + i, -1] != b[j, -1]:
                        found.append((int(a[at + i, -1]), int(b[j, -1])))
    return found


def _links(tiles: DataFrame, cell: list[str], steps: list[tuple[int, ...]], width: int, radius: int, most: int | None = None) -> DataFrame:
    """Links (a, b) between the rows of tiles whose cells are one of ``steps`` apart, enough to connect each component."""
    # A full cell's tiles are dealt out by number, eight to a deal, and each of its partners goes to every deal.
    full = tiles.groupBy(*cell).count().agg(F.max("count")).first()[0] or 1
    deals = -(-full // 8)
    step = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in steps])
    left = tiles.select(F.explode(step).alias("s"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(cell)], F.col("tile").alias("lt"), F.col("data").alias("ld"))
    own = F.greatest(*[F.abs(f"s.d{i}") for i in range(len(cell))], F.lit(0)) == 0
    left = left.select(*[(F.col(f"l{i}") + F.col(f"s.d{i}")).alias(c) for i, c in enumerate(cell)], "lt", "ld", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    right = tiles.withColumn("deal", F.pmod(F.xxhash64("tile"), F.lit(deals)).cast("int"))
    pairs = left.join(right, [*cell, "deal"]).where("not own or lt <= tile").select("ld", "data")

    def compare(batches):
        import numpy as np

        forest = Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in tile_links(*[np.frombuffer(z, dtype=np.int64).reshape(-1, width) for z in (x, y)], radius, most):
                    forest.link(a, b)
        yield forest.batch()

    return pairs.mapInArrow(compare, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints, enough to connect each component."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"c{i}") for i in range(4)]
    cell = [f"c{i}" for i in range(4)]
    return _links(_tiles(fps.select("fp", *counts), cell, ["fp"], tile), cell, _near(radius), 1, radius)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp long, component_id: the smallest id reachable) for every row of ``docs``."""
    of_doc = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    least = materialize(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), radius, tile))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return of_doc.join(named, "fp").select("doc_id", "fp", "component_id")


def _one_of_each(docs: DataFrame, keep: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is in ``keep`` (one column), one row an id, and all rows without an id."""
    name = fresh(docs, "keep")
    kept = docs.join(keep.toDF(name), F.col(id_col) == F.col(name), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` with the document of smallest id in each component.

    Rows that repeat an id count as one document, of which one row stays; rows
    without an id can't be told apart, and all stay.
    """
    return _one_of_each(docs, simhash_components(docs, id_col, **kw).where("doc_id = component_id").select("doc_id").distinct(), id_col)


def word_shingles(data: bytes, n: int):
    """The distinct 64-bit hashes of a text's n-word shingles, split and lower-cased as in ``fingerprint``; no words make one shingle."""
    import numpy as np

    found = dedup.hashed_shingles(data.lower().split(), n)
    return found if len(found) else np.zeros(1, dtype=np.int64)


def wide_fingerprint(hashes):
    """256 bits as four longs: a bit is 1 if set in over half of the hashes, each taken through four mixers."""
    import numpy as np

    total = np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096].view(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR, tile: int = TILE) -> DataFrame:
    """(id, sid, root) per row: documents of one ``root`` are near copies, or connected by a chain of near copies.

    Near copies' shingle sets have a Jaccard similarity of ``least`` (0.8 or more) at least.
    """
    import math

    if least < NEAR:
        raise ValueError(f"the radius is meant for a similarity of {NEAR} or more")
    small_batches(docs.sparkSession)
    ratio = math.log(1 / NEAR) * (1 + 1e-9)
    shingles = lambda x: word_shingles(x, shingle)

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            wide = np.array([wide_fingerprint(s) for s in sets], dtype=np.int64).reshape(-1, 4)
            size = np.floor(np.log(np.fromiter(map(len, sets), dtype=np.float64, count=len(sets))) / ratio).astype(np.int64)
            arrays = [batch.column(0), pa.array([dedup.set_number(s) for s in sets], pa.int64()), pa.array(size), *[pa.array(np.ascontiguousarray(wide[:, i])) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "sid", "c", "w0", "w1", "w2", "w3"])

    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    held = materialize(texts.mapInArrow(sign, f"id {dict(texts.dtypes)['id']}, sid long, c long, w0 long, w1 long, w2 long, w3 long"), "signatures")
    words = ["w0", "w1", "w2", "w3", "sid"]
    distinct = held.groupBy("sid").agg(*[F.min(c).alias(c) for c in ["c", *words[:-1]]])
    groups = components(_links(_tiles(distinct, ["c"], words, tile), ["c"], [(0,), (1,)], len(words), NEAR_FIRST, NEAR_ALL))
    each = groups.select(F.col("node").alias("sid"), F.col("root").alias("g")).unionByName(groups.select(F.col("root").alias("sid"), F.col("root").alias("g")).distinct())
    roots = dedup.jaccard_components(each, dedup.shingle_sets(texts, "b", shingles), least)
    return held.select("id", "sid").join(roots, "sid", "left").select("id", "sid", F.coalesce("root", "sid").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the document of smallest id in each class of near copies; ids that repeat and null ids as in ``simhash_dedup``."""
    classes = near_classes(docs, id_col, text_col, **kw)
    return _one_of_each(docs, classes.groupBy("root").agg(F.min("id").alias("id")).select("id").distinct(), id_col)
