"""Exact substring deduplication over a distributed, sparse suffix array.

Every byte covered by a ``length``-byte string that starts anywhere else in
the corpus is found. Sorting a suffix for each byte would move two hundred
times the corpus, so suffixes are taken where content says so: a window of
``length`` bytes is represented by the leftmost of its ``gram``-byte strings of
least hash, its *anchor*. Equal windows have their anchors at equal offsets,
so every match can be found at anchors, about one in seventy bytes. Windows in
a row share an anchor; they form a *run*, whose bytes are its *context*.

1. Documents are dealt into blocks of bounded size. Each block sends the hashes
   of its anchors' leading grams, each once, to the bucket of that hash range,
   and gets back which of them occur elsewhere: suffixes alone with their
   leading gram have no match and go no further.
2. A gram may be followed and preceded by very many texts (a boilerplate line,
   the edge of a passage that a third of all documents share). The bucket adds
   up how many distinct contexts of a gram the blocks hold beyond one each;
   beyond ``HEAVY`` of them, blocks ask in the same way, by hash, for each
   window of such contexts, and what is left of a context are the windows that
   occur elsewhere. At the edge of a passage that is the passage, the same in
   all documents, so what meets in one bucket is a few strings.
3. The suffixes left are range-partitioned by their leading bytes, between
   splitters sampled from anchors of sampled documents. A block sends each
   distinct context once, with whether it repeats, so a passage in a third of
   all documents reaches a bucket once from each block.
4. A bucket sorts its suffixes by multikey quicksort (eight bytes at a time),
   and compares neighbours to the right of the anchor and to its left, which
   gives the windows that both share. Where three or more suffixes share a
   gram, windows that neighbours can't settle are themselves sorted by
   multikey quicksort and compared with their neighbours. Splitters are whole
   grams: suffixes on two sides of a boundary differ within their grams, so
   what a comparison across it would find is known, and no match is cut.
5. Each block gets back one bit for each window sent, and marks its documents.

All bytes are compared; hashes only choose anchors and spare the suffixes that
have no partner. Messages go by block and bucket, never by string, and only
where there is something to tell; no string however common makes a large
task. The documents are shuffled once; all passes over them read that one
exchange.

Defined results: null text is empty; texts under ``length`` bytes keep all;
matches never cross documents; repeated rows are each other's copies, so both
lose what they share; ids may be null, repeat, and be of any type; an empty
table gives an empty result; other columns, whatever their names, are ignored
by ``repeats`` and carried along by ``cut_repeats``.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, fresh, lean, lean_cogroup, small_batches, utf8

LENGTH = 200
#: Documents from which splitters are sampled.
SAMPLE_DOCS = 2000
SLICE = 1 << 20
SMALL = 48
#: Blocks of documents to a bucket of suffixes: a block holds its texts more than once.
BLOCKS = 2
#: Distinct contexts of a gram, beyond one a block, from which on its windows are asked for one by one.
HEAVY = 500
#: Windows of a bucket that are sorted at once.
WINDOWS = 1 << 21
#: The base of the hash of a context or a window, odd.
BASE = 0x5851F42D4C957F2D


def _gram(length: int) -> int:
    """Bytes of an anchor: a power of two, about a third of the match."""
    return 1 << max(0, (max(1, length // 3)).bit_length() - 1)


def _table():
    """A pseudo-random 64-bit number for each byte."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _prefix_hashes(data):
    """Sums of byte values times rising powers of the base, before each byte and at the end, and the powers of the base's inverse."""
    import numpy as np

    n = len(data)
    up, down = np.full(n + 1, BASE, dtype=np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_table()[data] * up[:-1], out=total[1:])
    return total, down


def _between(total, down, lo, hi):
    """The hash of the bytes from lo to hi, wherever they lie."""
    import numpy as np

    h = (total[hi] - total[lo]) * down[lo]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Block:
    """Texts one after another, their windows and the runs of windows that share an anchor."""

    def __init__(self, texts, length: int = LENGTH):
        import numpy as np

        self.length, self.gram = length, _gram(length)
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64) if len(texts) else self.ends
        valid = np.zeros(len(self.data), dtype=bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if b - a >= length:
                valid[a : b - length + 1] = True
        self.valid = valid
        parts = [x for at in range(0, len(self.data), SLICE) if (x := self._slice(at)) is not None]
        self.lo, self.hi, self.at, self.token, self.context = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.uint64 if i >= 3 else np.int64) for i in range(5))

    def _slice(self, x: int):
        """First and last window, anchor, gram hash and context hash of each run among the windows from x."""
        import numpy as np

        part = self.data[x : x + SLICE + self.length - 1]
        n = len(part) - self.length + 1
        if n <= 0 or not (ok := self.valid[x : x + n]).any():
            return None
        h = _table()[part]
        step, power = 1, 0xD6E8FEB86659FD93
        while step < self.gram:
            h = h[:-step] * np.uint64(power) + h[step:]
            step, power = 2 * step, power * power % (1 << 64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        # The least of each window's hashes; the place, in the low half, breaks ties to the left.
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wide, step = self.length - self.gram + 1, 1
        while 2 * step <= wide:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        key = np.minimum(key[:n], key[wide - step : wide - step + n])
        s = np.flatnonzero(ok)
        a = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 1)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(s) - 1]))
        return s[first] + x, s[last] + x, a[first] + x, h[a[first]], _between(*_prefix_hashes(part), s[first], s[last] + self.length)

    def tokens(self):
        """The distinct gram hashes, sorted, a code for each (0: it occurs once, k: with k distinct contexts), and each run's place among them."""
        import numpy as np

        if not len(self.token):
            return self.token, np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
        distinct, inverse, count = np.unique(self.token, return_inverse=True, return_counts=True)
        _, one = np.unique(self.context ^ (self.token * np.uint64(BASE)), return_index=True)
        contexts = np.bincount(inverse[one], minlength=len(distinct))
        return distinct, np.where(count > 1, np.minimum(contexts, 65535), 0).astype(np.uint16), inverse

    def contexts(self, lo, hi, at):
        """The distinct contexts of these runs in order of appearance, how often each occurs, and each run's own."""
        import numpy as np

        place: dict[tuple[bytes, int], int] = {}
        own, times = [], []
        data, k = self.bytes, self.length
        for x, y, z in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True):
            i = place.setdefault((data[x : y + k], z - x), len(times))
            if i == len(times):
                times.append(0)
            times[i] += 1
            own.append(i)
        return list(place), np.array(times, dtype=np.int64), np.array(own, dtype=np.int64)


def window_hashes(contexts, length: int):
    """The hashes of all windows of these contexts, one context after another, and how many each has."""
    import numpy as np

    n = np.fromiter((len(c) - length + 1 for c, _ in contexts), dtype=np.int64, count=len(contexts))
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(contexts):
        to, size = at, 0
        while to < len(contexts) and (to == at or size < SLICE):
            size += len(contexts[to][0])
            to += 1
        data = b"".join(c for c, _ in contexts[at:to])
        own = n[at:to]
        start = np.cumsum(own + length - 1) - (own + length - 1)
        w = np.repeat(start - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        out.append(_between(*_prefix_hashes(np.frombuffer(data, dtype=np.uint8)), w, w + length))
        at = to
    return np.concatenate(out), n


def pieces(n, kept):
    """The stretches of kept windows: the context of each, its first and last window, and how many a context has."""
    import numpy as np

    total = int(n.sum())
    own = np.repeat(np.arange(len(n)), n)
    new = np.concatenate(([True], own[1:] != own[:-1])) if total else np.zeros(0, dtype=bool)
    before = np.concatenate(([False], kept[:-1])) & ~new
    after = np.concatenate((kept[1:], [False])) & ~np.concatenate((new[1:], [True])) if total else kept
    first, last = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after)
    zero = np.cumsum(n) - n
    return own[first], first - zero[own[first]], last - zero[own[last]], np.bincount(own[first], minlength=len(n))


class Bytes:
    """A buffer read eight bytes at a time from any place."""

    def __init__(self, data: bytes):
        import numpy as np

        self.data = data
        padded = data + bytes(8)
        self.words = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
        self.masks = np.array([((1 << (8 * i)) - 1) << (8 * (8 - i)) for i in range(9)], dtype=np.uint64)

    def word(self, at, end):
        """The words at ``at``, with zeros from ``end`` on."""
        import numpy as np

        left = np.clip(end - at, 0, 8)
        return self.words[np.minimum(at, len(self.words) - 1)].astype(np.uint64) & self.masks[left]


def multikey_quicksort(text: Bytes, at, end):
    """The order that sorts the strings text[at:end]."""
    import numpy as np

    order, stack, data = np.arange(len(at)), [(0, len(at), 0)], text.data
    while stack:
        lo, hi, depth = stack.pop()
        own = order[lo:hi]
        if hi - lo <= SMALL:
            if hi - lo > 1:
                a, b = (at[own] + depth).tolist(), end[own].tolist()
                order[lo:hi] = own[sorted(range(hi - lo), key=lambda i: data[a[i] : b[i]])]
            continue
        here = at[own] + depth
        w = text.word(here, end[own])
        pivot = np.sort(w[[0, (hi - lo) // 2, hi - lo - 1]])[1]
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        if not less.any() and not more.any():
            if (end[own] - here > 8).any():
                stack.append((lo, hi, depth + 8))
            continue
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate((own[less], own[same], own[more]))
        stack += [(lo, a, depth), (b, hi, depth)]
        if b - a > 1 and (end[order[a:b]] - at[order[a:b]] > depth + 8).any():
            stack.append((a, b, depth + 8))
    return order


def common_prefix(text: Bytes, a, a_end, b, b_end):
    """Bytes that text[a:a_end] and text[b:b_end] have in common at their start."""
    import numpy as np

    limit = np.minimum(a_end - a, b_end - b)
    out, open_, depth = limit.copy(), np.flatnonzero(limit > 0), 0
    while len(open_):
        x = text.word(a[open_] + depth, a_end[open_]) ^ text.word(b[open_] + depth, b_end[open_])
        differ = x != 0
        zeros = sum((x[differ] < np.uint64(1 << (8 * i))).astype(np.int64) for i in range(1, 8))
        done = open_[differ]
        out[done] = np.minimum(limit[done], depth + zeros)
        depth += 8
        open_ = open_[~differ]
        open_ = open_[limit[open_] > depth]
    return out


def settle(contexts, times, length: int = LENGTH):
    """For each distinct context (bytes, anchor's place) of a bucket: which of its windows occur elsewhere."""
    import numpy as np

    n = len(contexts)
    sizes = np.fromiter((len(c) for c, _ in contexts), dtype=np.int64, count=n)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    end, windows = start + sizes, sizes - length + 1
    anchor = start + np.fromiter((a for _, a in contexts), dtype=np.int64, count=n)
    first = np.concatenate(([0], np.cumsum(windows)))
    # At window w of a context, the offset of the anchor is (anchor - start) - w; w counts from the context's start.
    edges = np.zeros(int(first[-1]) + 1, dtype=np.int64)

    def mark(i, lo, hi):
        lo, hi = np.maximum(lo, 0), np.minimum(hi, windows[i] - 1)
        ok = lo <= hi
        np.add.at(edges, first[i[ok]] + lo[ok], 1)
        np.add.at(edges, first[i[ok]] + hi[ok] + 1, -1)

    every = np.arange(n)
    again = every[np.asarray(times) > 1]
    mark(again, np.zeros(len(again), dtype=np.int64), windows[again] - 1)
    data = b"".join(c for c, _ in contexts)
    text, back = Bytes(data), Bytes(data[::-1])
    order = multikey_quicksort(text, anchor, end)
    i, j = order[:-1], order[1:]
    right = common_prefix(text, anchor[i], end[i], anchor[j], end[j])
    gram = _gram(length)
    near = right >= gram
    i, j, right = i[near], j[near], right[near]
    left = common_prefix(back, len(data) - anchor[i], len(data) - start[i], len(data) - anchor[j], len(data) - start[j])
    # Windows with the anchor at offset o are shared if o <= left and length - o <= right, and both contexts have them.
    oi, oj = anchor[i] - start[i], anchor[j] - start[j]
    most = np.minimum(left, np.minimum(oi, oj))
    least = np.maximum(length - right, np.maximum(oi - windows[i] + 1, oj - windows[j] + 1))
    ok = least <= most
    mark(i[ok], (oi - most)[ok], (oi - least)[ok])
    mark(j[ok], (oj - most)[ok], (oj - least)[ok])
    # Of three or more with one gram, neighbours to the right needn't be neighbours to the left.
    cut = np.concatenate(([True], ~near, [True]))
    bounds = np.flatnonzero(cut)
    size = np.diff(bounds)
    inside = np.repeat(size >= 3, size)
    reach = np.zeros(n, dtype=np.int64)
    np.maximum.at(reach, i, right)
    np.maximum.at(reach, j, right)
    many = order[inside]
    if len(many):
        group = np.repeat(np.arange(len(size)), size)[inside]
        back_reach = _left_reach(back, len(data) - anchor[many], len(data) - start[many], group)
        lo = np.maximum(anchor[many] - start[many] - back_reach, 0)
        hi = np.minimum(anchor[many] - start[many] - length + reach[many], windows[many] - 1)
        count = np.maximum(hi - lo + 1, 0)
        # Whole groups at a time: windows of two groups are never equal.
        ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
        upto = np.cumsum(count)[ends - 1]
        at = done = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WINDOWS, side="right")))
            part = slice(done, int(ends[to - 1]))
            own = np.repeat(many[part], count[part])
            w = np.arange(int(count[part].sum())) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + np.repeat(lo[part], count[part])
            place = start[own] + w
            o = multikey_quicksort(text, place, place + length)
            a, b = place[o[:-1]], place[o[1:]]
            same = common_prefix(text, a, a + length, b, b + length) == length
            hit = np.zeros(len(o), dtype=bool)
            hit[o[:-1][same]] = True
            hit[o[1:][same]] = True
            mark(own[hit], w[hit], w[hit])
            at, done = to, int(ends[to - 1])
    found = np.cumsum(edges[:-1]) > 0
    return found, first


def _left_reach(back: Bytes, at, end, group):
    """The longest common text to the left of each suffix's anchor with any other of its group."""
    import numpy as np

    order = multikey_quicksort(back, at, end)
    order = order[np.argsort(group[order], kind="stable")]
    i, j = order[:-1], order[1:]
    shared = np.where(group[i] == group[j], common_prefix(back, at[i], end[i], at[j], end[j]), 0)
    reach = np.zeros(len(at), dtype=np.int64)
    np.maximum.at(reach, i, shared)
    np.maximum.at(reach, j, shared)
    return reach


def _splitters(rows: DataFrame, n: int, length: int, parts: int) -> list[bytes]:
    """At most ``parts`` - 1 leading grams that cut the anchors of sampled documents into even ranges; a frequent gram counts as often as it occurs."""
    sample = rows.select("b") if n <= SAMPLE_DOCS else rows.select("b").sample(fraction=SAMPLE_DOCS / n, seed=1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            block = Block(batch.column(0).to_pylist(), length)
            grams = [block.bytes[a : a + block.gram] for a in block.at.tolist()[::8]]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary())], names=["g"])

    grams = sorted(bytes(r["g"]) for r in sample.mapInArrow(run, "g binary").toLocalIterator())
    return sorted({grams[len(grams) * i // parts] for i in range(1, parts)}) if grams else []


def _texts(table):
    """The rows' places and their texts in an order that doesn't depend on the shuffle."""
    ids = table.column("doc_id").to_pylist()
    rows = sorted(zip(ids, table.column("b").to_pylist(), range(len(table)), strict=True), key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[1]))
    return [r[2] for r in rows], [r[1] for r in rows]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, heavy: int = HEAVY, parts: int | None = None) -> DataFrame:
    """(doc_id, b: the text's bytes, spans: array<struct<start, end>> of the bytes that repeat), one row for each row of ``docs``.

    ``parts``: buckets, and half the blocks; by default as many as the bytes ask for.
    """
    return _passes(docs, id_col, text_col, length, heavy, parts, cut=False)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, heavy: int = HEAVY, parts: int | None = None) -> DataFrame:
    """``docs`` without the bytes that repeat; what a cut leaves of a character goes with it, and a null text stays null."""
    return _passes(docs, id_col, text_col, length, heavy, parts, cut=True)


def _passes(docs: DataFrame, id_col: str, text_col: str, length: int, heavy: int, parts: int | None, cut: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    names = list(docs.columns)
    others = [c for c in names if c != text_col]
    at = names.index(text_col)
    rest = F.struct(*[F.col(c) for c in others], F.col(text_col).isNull().alias(fresh(docs, "null"))) if cut else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("b"), rest.alias("rest"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("b")).alias("b")).first()
    parts = parts or block_count(spark, size["b"] or 0)
    blocks = BLOCKS * parts
    splitters = _splitters(rows, size["n"], length, parts)
    # Rows that repeat both id and text are parted by where they come from.
    dealt = rows.withColumn("m", F.pmod(F.xxhash64("doc_id", F.length("b"), F.substring("b", 1, 64), F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(blocks, "m")

    def by_range(hashes):
        """(range of hashes, its first and last place) of sorted hashes."""
        import numpy as np

        bucket = ((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        ends = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64)).tolist()
        return [(b, ends[b], ends[b + 1]) for b in range(parts) if ends[b] < ends[b + 1]]

    def gram_hashes(key, table):
        import pyarrow as pa

        distinct, codes, _ = Block(_texts(table)[1], length).tokens()
        out = [(b, key[0].as_py(), distinct[x:y].tobytes(), codes[x:y].tobytes()) for b, x, y in by_range(distinct)]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate([("bucket", pa.int32()), ("m", pa.int32()), ("tokens", pa.binary()), ("codes", pa.binary())])})

    def replies(out):
        import pyarrow as pa

        kinds = {"m": pa.int32(), "bucket": pa.int32(), "step": pa.int32(), "size": pa.int64(), "bits": pa.binary(), "heavy": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds.items())})

    def looked_up(bucket, step, table):
        """Which of the hashes sent occur elsewhere, and which with many contexts."""
        import numpy as np

        sent = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
        codes = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in table.column("codes").to_pylist()]).astype(np.int64)
        distinct, inverse, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = (n + np.bincount(inverse, weights=codes > 0, minlength=len(distinct)) > 1)[inverse]
        many = (np.bincount(inverse, weights=np.maximum(codes - 1, 0), minlength=len(distinct)) > heavy)[inverse]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        return [(m, bucket, step, len(x), np.packbits(x).tobytes(), np.packbits(y).tobytes() if y.any() else None) for m, x, y in zip(table.column("m").to_pylist(), np.split(shared, ends), np.split(many, ends), strict=True)]

    def shared_hashes(key, table):
        return replies(looked_up(key[0].as_py(), 1, table))

    def unpack(table, wanted):
        """The bits of a step's replies, bucket after bucket, and those of ``heavy``."""
        import numpy as np

        found = sorted((r for r in zip(*[table.column(c).to_pylist() for c in ("bucket", "size", "bits", "heavy", "step")], strict=True) if r[4] == wanted), key=lambda r: r[0])
        flags = lambda x, n: np.zeros(n, dtype=bool) if x is None else np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool)
        return [np.concatenate([np.zeros(0, dtype=bool), *[flags(r[i], r[1]) for r in found]]) for i in (2, 3)]

    def runs_of(block, table):
        """The runs whose gram occurs elsewhere: those to be sent, and those of a heavy gram."""
        import numpy as np

        shared, many = unpack(table, 1)
        _, _, inverse = block.tokens()
        if not len(inverse):
            return inverse, inverse
        return np.flatnonzero((shared & ~many)[inverse]), np.flatnonzero((shared & many)[inverse])

    def windows(block, runs):
        """The distinct window hashes of these runs' contexts, codes as for grams, each window's place among them, windows by context, each run's context."""
        import numpy as np

        contexts, times, own = block.contexts(block.lo[runs], block.hi[runs], block.at[runs])
        hashes, n = window_hashes(contexts, length)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        return distinct, (np.bincount(inverse, weights=np.repeat(times, n), minlength=len(distinct)) > 1).astype(np.uint16), inverse, n, own

    def clipped(block, runs, table):
        """What is left of runs of heavy grams: first and last window and anchor of each stretch of windows that occur elsewhere."""
        import numpy as np

        if not len(runs):
            return runs, runs, runs
        _, _, inverse, n, own = windows(block, runs)
        shared, _ = unpack(table, 3)
        _, first, last, many = pieces(n, shared[inverse])
        count = many[own]
        place = np.repeat((np.cumsum(many) - many)[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        lo = np.repeat(block.lo[runs], count)
        return lo + first[place], lo + last[place], np.repeat(block.at[runs], count)

    def bucket_of(block, contexts):
        import numpy as np

        # A zero byte at the end of a gram counts: grams are compared as void, not as text.
        grams = [c[a : a + block.gram] for c, a in contexts]
        return np.fromiter((bisect_right(splitters, g) for g in grams), dtype=np.int64, count=len(grams))

    def sent_contexts(block, m, lo, hi, at_):
        import numpy as np

        contexts, times, _ = block.contexts(lo, hi, at_)
        bucket = bucket_of(block, contexts)
        out = []
        for b in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == b).tolist()
            out.append((b, m, b"".join(contexts[i][0] for i in own), np.array([len(contexts[i][0]) for i in own], dtype=np.int32).tobytes(), np.array([contexts[i][1] for i in own], dtype=np.int32).tobytes(), (times[own] > 1).astype(np.uint8).tobytes()))
        return out

    def sending(out):
        import pyarrow as pa

        kinds = [("bucket", pa.int32()), ("m", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "sizes", "anchors", "codes")]]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds)})

    def suffixes(key, table, told):
        m, block = key[0].as_py(), Block(_texts(table)[1], length)
        runs, many = runs_of(block, told)
        out = sent_contexts(block, m, block.lo[runs], block.hi[runs], block.at[runs])
        if len(many):
            distinct, codes, *_ = windows(block, many)
            out += [(parts + b, m, distinct[x:y].tobytes(), None, None, codes[x:y].tobytes()) for b, x, y in by_range(distinct)]
        return sending(out)

    def clipped_suffixes(key, table, told):
        if not unpack(told, 3)[0].any():
            return sending([])
        block = Block(_texts(table)[1], length)
        return sending(sent_contexts(block, key[0].as_py(), *clipped(block, runs_of(block, told)[1], told)))

    def sort_bucket(step):
        def run(key, table):
            import numpy as np

            bucket = key[0].as_py()
            if bucket >= parts:
                return replies(looked_up(bucket - parts, 3, table))
            place: dict[tuple[bytes, int], int] = {}
            times, own = [], []
            for data, sizes, anchors, multi in zip(*[table.column(c).to_pylist() for c in ("tokens", "sizes", "anchors", "codes")], strict=True):
                at, mine = 0, []
                for n, a, twice in zip(np.frombuffer(sizes, dtype=np.int32).tolist(), np.frombuffer(anchors, dtype=np.int32).tolist(), np.frombuffer(multi, dtype=np.uint8).tolist(), strict=True):
                    i = place.setdefault((data[at : at + n], a), len(times))
                    if i == len(times):
                        times.append(0)
                    times[i] += 1 + twice
                    mine.append(i)
                    at += n
                own.append(np.array(mine, dtype=np.int64))
            found, first = settle(list(place), times, length)
            out = []
            for m, mine in zip(table.column("m").to_pylist(), own, strict=True):
                n = first[mine + 1] - first[mine]
                w = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append((m, bucket, step, len(w), np.packbits(found[w]).tobytes(), None))
            return replies(out)

        run.__name__ = f"sort_bucket_{step}"
        return run

    def starts_of(block, lo, hi, at_, hit):
        """The windows found among these runs, by the bits that came back."""
        import numpy as np

        if not len(lo):
            return np.zeros(0, dtype=np.int64)
        contexts, _, own = block.contexts(lo, hi, at_)
        n = np.fromiter((len(c) - length + 1 for c, _ in contexts), dtype=np.int64, count=len(contexts))
        by_bucket = np.argsort(bucket_of(block, contexts), kind="stable")
        first = np.zeros(len(contexts), dtype=np.int64)
        first[by_bucket] = np.cumsum(n[by_bucket]) - n[by_bucket]
        return np.concatenate([np.flatnonzero(hit[f : f + k]) + x for f, k, x in zip(first[own].tolist(), n[own].tolist(), lo.tolist(), strict=True)])

    def spans(key, table, told):
        import numpy as np
        import pyarrow as pa

        places, texts = _texts(table)
        table = table.take(pa.array(places, pa.int64()))
        block = Block(texts, length)
        runs, many = runs_of(block, told)
        starts = np.sort(np.concatenate([starts_of(block, block.lo[runs], block.hi[runs], block.at[runs], unpack(told, 2)[0]), starts_of(block, *clipped(block, many, told), unpack(told, 4)[0])]))
        doc = np.searchsorted(block.ends, starts, side="right")
        new = np.flatnonzero((np.diff(starts, prepend=-length - 1) > length) | (np.diff(doc, prepend=-1) != 0))
        last = np.append(new[1:] - 1, len(starts) - 1)[: len(new)]
        out: list[list[dict]] = [[] for _ in texts]
        for d, x, y in zip(doc[new].tolist(), starts[new].tolist(), (starts[last] + length).tolist(), strict=True):
            base = int(block.starts[d])
            out[d].append({"start": x - base, "end": y - base})
        if cut:
            held = table.column("rest").combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            columns = held.flatten()
            null = columns.pop().to_pylist()
            left_over = [None if x else keep_rest(t, o).decode(errors="ignore") for t, o, x in zip(texts, out, null, strict=True)]
            columns.insert(at, pa.array(left_over, pa.string()))
            return pa.Table.from_arrays(columns, names=names)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": table.column("doc_id"), "b": table.column("b"), "spans": pa.array(out, kind)})

    reply = "m int, bucket int, step int, size long, bits binary, heavy binary"
    message = "bucket int, m int, tokens binary, sizes binary, anchors binary, codes binary"
    by_block = lambda told, f, schema: dealt.groupBy("m").cogroup(told.groupBy("m")).applyInArrow(lean_cogroup(f), schema)
    sent = dealt.groupBy("m").applyInArrow(lean(gram_hashes), "bucket int, m int, tokens binary, codes binary")
    first = sent.groupBy("bucket").applyInArrow(lean(shared_hashes), reply).repartition(blocks, "m")
    second = by_block(first, suffixes, message).groupBy("bucket").applyInArrow(lean(sort_bucket(2)), reply).repartition(blocks, "m")
    asked = first.unionByName(second)
    third = by_block(asked, clipped_suffixes, message).groupBy("bucket").applyInArrow(lean(sort_bucket(4)), reply)
    schema = docs.schema if cut else f"doc_id {dict(rows.dtypes)['doc_id']}, b binary, spans array<struct<start: long, end: long>>"
    return by_block(asked.unionByName(third), spans, schema)


def keep_rest(data: bytes, spans) -> bytes:
    """``data`` without the bytes in ``spans``."""
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def kept(found: DataFrame) -> DataFrame:
    """Per row of ``repeats``: doc_id, n_bytes, n_removed, n_spans and the remaining bytes as ``kept``."""
    cut = F.transform("spans", lambda s: s["end"] - s["start"])
    n = F.size("spans")
    # What lies before the first span, between spans and after the last.
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    tos = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("b").cast("long")))
    pieces = F.zip_with(froms, tos, lambda a, z: F.substring(F.col("b"), (a + 1).cast("int"), (z - a).cast("int")))
    joined = F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y))
    return found.select("doc_id", F.length("b").cast("long").alias("n_bytes"), F.aggregate(cut, F.lit(0).cast("long"), lambda x, y: x + y).alias("n_removed"), n.cast("long").alias("n_spans"), F.when(n == 0, F.col("b")).otherwise(joined).alias("kept"))
