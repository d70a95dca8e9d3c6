"""Benchmark decontamination by a generalised suffix automaton over words.

All benchmark items go into one automaton (one state per set of equal end
positions, words as symbols). Documents stream through it: at each word the
automaton's state and length give the longest run of words, ending there, that
occurs in some item. Wherever that length reaches the window (or the whole of
a shorter item), the window's words are hit, and the state names the items.

The benchmark is cut into shards of at most ``SHARD_WORDS`` words (an item is
never cut). Each shard is one automaton, built and broadcast alone, and one
pass over the documents, whose findings so far are written to the shared
folder between passes; so the driver and a worker hold one shard at a time,
however large the benchmark grows.

Defined results: a null or wordless document has no hits; null and wordless
items are no windows; an item with a null id can hit but isn't listed;
repeated items with one id are listed once; repeated documents keep their
rows; an empty benchmark hits nothing; other columns, whatever their names, are
ignored by ``contamination`` and carried along by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, materialize, release, small_batches, utf8

WINDOW = 10
#: Words of the benchmark in one broadcast automaton (about 200 bytes each in memory).
SHARD_WORDS = 1_000_000
#: A document with a larger share of hit words is dropped by ``decontaminate``.
MAX_COVERAGE = 0.5

#: Lower-cases A-Z; whatever isn't a digit, a letter or beyond ASCII becomes a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that own each window."""

    def __init__(self, items, window: int = WINDOW):
        """``items``: (id as string or None, words) pairs; those without words are left out."""
        items = [(k, w) for k, w in items if w]
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocab.setdefault(x, len(self.vocab)) for x in w]) for k, w in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.spans = sorted({min(window, len(c)) for _, c in coded})
        self._owners(coded)
        self._pairs(coded)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.next, self.link, self.length
        if (q := step[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _owners(self, coded) -> None:
        """For each window length: the state that stands for a state's last so many words, and the items of that state."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.stands: dict[int, list[int]] = {}
        self.items: dict[int, dict[int, set]] = {}
        for span in self.spans:
            stands = [-1] * len(self.link)
            for s in order:
                if self.length[s] >= span:
                    up = self.link[s]
                    stands[s] = s if self.length[up] < span else stands[up]
            self.stands[span], self.items[span] = stands, {}
        for key, codes in coded:
            span = min(self.window, len(codes))
            for at, state, longest in self.stream(codes):
                if at + 1 >= span and longest >= span:
                    self.items[span].setdefault(self.stands[span][state], set()).add(key)

    def _pairs(self, coded) -> None:
        """A bit table of the adjacent word pairs of all items; other pairs can't lie inside a window."""
        import numpy as np

        pairs = {(a << 32) | b for _, w in coded for a, b in zip(w, w[1:], strict=False)}
        self.bits = max(16, (8 * len(pairs)).bit_length())
        self.pairs = np.zeros(1 << self.bits, dtype=bool)
        self.pairs[self._slot(np.array(sorted(pairs), dtype=np.uint64))] = True

    def _slot(self, code):
        import numpy as np

        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def stream(self, codes):
        """(index, state, longest matching length) after each code."""
        step, link, length = self.next, self.link, self.length
        state = longest = 0
        for at, c in enumerate(codes):
            while (to := step[state].get(c)) is None and state:
                state = link[state]
                longest = length[state]
            if to is None:
                longest = 0
            else:
                state, longest = to, longest + 1
            yield at, state, longest

    def match(self, words: list[bytes]):
        """The words hit, as maximal (start, end) ranges, and the ids of the items with windows here."""
        import numpy as np

        n = len(words)
        if not n or not self.spans or n < self.spans[0]:
            return [], set()
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        known = codes >= 0
        joined = known[1:] & known[:-1]
        where = np.flatnonzero(joined)
        joined[where] = self.pairs[self._slot((codes[where].astype(np.uint64) << np.uint64(32)) | codes[where + 1].astype(np.uint64))]
        # Runs of known words whose neighbours occur side by side somewhere in the items.
        cut = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
        starts, ends = cut[:-1], cut[1:]
        good = (ends - starts >= self.spans[0]) & known[starts]
        hits, found = [], set()
        for a, b in zip(starts[good].tolist(), ends[good].tolist(), strict=True):
            for at, state, longest in self.stream(codes[a:b].tolist()):
                for span in self.spans:
                    if longest < span:
                        break
                    owners = self.items[span].get(self.stands[span][state])
                    if owners:
                        found |= owners
                        start, end = a + at - span + 1, a + at + 1
                        while hits and hits[-1][1] >= start:  # ranges come by their ends
                            start = min(start, hits.pop()[0])
                        hits.append((start, end))
        return hits, found


def _shards(bench: DataFrame, id_col: str, text_col: str, shard_words: int):
    """Lists of (id, words) of items, none with more than ``shard_words`` words (one item at least)."""
    rows = bench.select(F.col(id_col).cast("string").alias("k"), utf8(text_col).alias("b")).distinct()
    held, words = [], 0
    for row in rows.toLocalIterator():
        w = normal_words(bytes(row["b"]))
        if held and words + len(w) > shard_words:
            yield held
            held, words = [], 0
        if w:
            held.append((row["k"], w))
            words += len(w)
    if held:
        yield held


def _union(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start: bigint, end: bigint>>"


def _passes(rows: DataFrame, text_col: str, bench: DataFrame, item_col: str, window: int, shard_words: int, finish, schema) -> DataFrame:
    """``rows`` through the automaton of each shard, one pass each; ``finish(batch, texts, found)`` makes the last pass's output.

    ``texts`` are the whole texts as bytes, ``found`` the hit ranges of words and the set of items of each.
    """
    spark = rows.sparkSession
    small_batches(spark)
    names = [fresh(rows, "spans"), fresh(rows, "items")]
    width, at = len(rows.columns), rows.columns.index(text_col)
    between = StructType([*rows.schema.fields, *StructType.fromDDL(f"{names[0]} {SPANS}, {names[1]} array<string>").fields])

    def one(held, first, last):
        def run(batches):
            import pyarrow as pa

            automaton = held.value
            for batch in batches:
                texts = [x.encode() if isinstance(x, str) else x or b"" for x in batch.column(at).to_pylist()]
                before = [([], [])] * len(texts) if first else [([(x["start"], x["end"]) for x in a], b) for a, b in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)]
                found = []
                for data, (spans, items) in zip(texts, before, strict=True):
                    more, names_here = automaton.match(normal_words(data)) if automaton else ([], set())
                    found.append((_union(spans + more), set(items) | names_here))
                kept = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
                if last:
                    yield finish(kept, texts, found)
                else:
                    spans = pa.array([[{"start": a, "end": b} for a, b in x] for x, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                    items = pa.array([sorted(y, key=lambda k: (k is None, k or "")) for _, y in found], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, spans, items], names=[*kept.schema.names, *names])

        return run

    shards = _shards(bench, item_col, "text", shard_words)
    now, state, first = next(shards, None), rows, True
    while (following := next(shards, None)) is not None:
        held = spark.sparkContext.broadcast(SuffixAutomaton(now, window))
        done = materialize(state.mapInArrow(one(held, first, False), between), "hits")
        held.destroy()
        release(state)
        now, state, first = following, done, False
    return state.mapInArrow(one(spark.sparkContext.broadcast(SuffixAutomaton(now, window) if now else None), first, True), schema)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit long, items array<string>, spans array<struct<start, end>> in words."""

    def digest(batch, texts, found):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {
            "n_words": pa.array([len(normal_words(x)) for x in texts], pa.int64()),
            "n_hit": pa.array([sum(b - a for a, b in spans) for spans, _ in found], pa.int64()),
            "items": pa.array([sorted(x for x in items if x is not None) for _, items in found], pa.list_(pa.string())),
            "spans": pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in found], kind),
        }
        return pa.RecordBatch.from_arrays([batch.column(0), *out.values()], names=["doc_id", *out])

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("b"))
    return _passes(rows, "b", bench, item_col, window, shard_words, digest, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_hit long, items array<string>, spans {SPANS}")


def remove_spans(data: bytes, spans) -> bytes:
    """``data`` without the words in ``spans`` and the blanks between them."""
    import numpy as np

    line = np.frombuffer(data.translate(NORMAL), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], line.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]])


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with hit spans cut out of the text; documents hit beyond ``max_coverage`` of their words go.

    Untouched documents keep their text byte for byte; a null text stays null.
    """
    at = docs.columns.index(text_col)

    def cut(batch, texts, found):
        import pyarrow as pa

        keep, out = [], []
        for row, (text, data, (spans, _)) in enumerate(zip(batch.column(at).to_pylist(), texts, found, strict=True)):
            if spans:
                if sum(b - a for a, b in spans) > max_coverage * len(normal_words(data)):
                    continue
                text = remove_spans(data, spans).decode()
            keep.append(row)
            out.append(text)
        columns = batch.take(pa.array(keep, pa.int64())).columns
        columns[at] = pa.array(out, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _passes(docs, text_col, bench, item_col, window, shard_words, cut, docs.schema)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The digest of ``contamination`` over whole tables, by windows instead of an automaton.
CONTAMINATION_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
items as (select item_id::varchar as k, {_WORDS} as w from benchmark),
sized as (select k, w, least(10, len(w)) as n from items where len(w) > 0),
windows as (select distinct k, n, array_to_string(w[s:s + n - 1], ' ') as g from (select k, w, n, unnest(range(1, len(w) - n + 2)) as s from sized)),
spans as (select distinct n from windows),
own as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
        from (select d.doc_id, d.w, spans.n, unnest(range(1, len(d.w) - spans.n + 2)) as s from d join spans on len(d.w) >= spans.n)),
hits as (select own.doc_id, own.s, own.n, windows.k from own join windows on own.n = windows.n and own.g = windows.g),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct k) as n_items, string_agg(distinct k, ',' order by k) as names from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places on d.doc_id = places.doc_id left join found on d.doc_id = found.doc_id
"""
