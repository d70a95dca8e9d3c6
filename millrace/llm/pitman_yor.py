"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Each word's successors sit in a restaurant of that context; all contexts share
one parent restaurant of single words, whose base is uniform over the training
words and one unknown. A context's tables are the parent's customers. Seating
starts with one table for each dish. A sweep moves all customers of every dish
with two or more: up to ``AT_ONCE`` customers, the dish's table count is drawn
from its exact conditional (generalised Stirling numbers, the tables of the
context's other dishes, the parent's probability); beyond, each customer is
unseated and seated again by the Gibbs conditional. Dishes of a context with
equally many customers move in parallel, the others one after another. The
parent's tables go on from step to step, as far as it has customers for them.
Predictive probabilities are averaged over the states after each sweep.

Nothing is gathered in one place: blocks of documents send each distinct word
to a shard of the vocabulary and each distinct word pair to the bucket of its
context; buckets and shards exchange table counts and parent probabilities
once each sweep; both answer each block in the order it asked. A block sends
a word or pair once however often it occurs, so frequent ones weigh no more
than rare ones. All statistics come from all training documents. The text is
shuffled once; the three passes over it read that one exchange. A bucket's and
a shard's seating goes from sweep to sweep as a message to itself. The first
``BURN_IN`` sweeps aren't averaged.

Words are known by a 64-bit polynomial hash of their bytes; at ten billion
distinct words two or three would be taken for another.

Defined results: null text is empty and has its end token only; a document's
fold comes from its id as text (null: the empty text); repeated rows are
scored each, and learned from each; words are read whole, however long; ids may
be of any type; with no training documents every token has the uniform
probability; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import block_count, lean, lean_cogroup, small_batches, utf8

#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.85, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
#: Sweeps in all, and the first of them, which aren't averaged.
SWEEPS, BURN_IN = 3, 1
#: Steps of the messages of a sweep: the buckets' table counts have its number, these come besides: the seating of a bucket, that of a shard, and the parent's answers.
BUCKET_STATE, SHARD_STATE, ANSWER = 1000, 2000, 3000
MESSAGE = "target int, origin int, step int, data binary"


def _pack(*arrays) -> bytes:
    """Arrays as bytes, the first byte of every number first: small numbers compress well."""
    import pickle

    import numpy as np

    return pickle.dumps([(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in map(np.asarray, arrays)])


def _unpack(data: bytes):
    import pickle

    import numpy as np

    out = []
    for kind, x in pickle.loads(data):  # noqa: S301  our own message
        n = np.dtype(kind).itemsize
        out.append(np.frombuffer(x, dtype=np.uint8).reshape(n, -1).T.copy().view(kind).reshape(-1))
    return out


def _messages(rows):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(("target", "origin", "step", "data"), kinds, strict=True))})


def _read(table, step=None):
    """(origin, arrays) of the messages of a step, by origin; all steps: {step: ...}."""
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("step", "origin", "data")], strict=True), key=lambda r: r[:2])
    if step is not None:
        return [(o, _unpack(d)) for s, o, d in rows if s == step]
    out: dict = {}
    for s, o, d in rows:
        out.setdefault(s, []).append((o, _unpack(d)))
    return out


def _order(x):
    """The stable order of non-negative whole numbers. Number and place are sorted as one number where they fit: several times as fast as ``argsort``."""
    import numpy as np

    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 64:
        return np.argsort(x, kind="stable")
    key = (x.astype(np.uint64) << np.uint64(bits)) | np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= np.uint64((1 << bits) - 1)
    return key.view(np.int64)


def _distinct(x):
    """``np.unique`` with the inverse, of non-negative whole numbers, sorted with their places as ``_order`` does.

    Where they don't fit, the upper bits of the number are sorted; if two numbers have these in common, they may be left
    unsorted, which is seen, and ``np.unique`` does it.
    """
    import numpy as np

    bits = len(x).bit_length()
    drop = max(0, int(x.max(initial=0)).bit_length() + bits - 64)
    key = ((x.astype(np.uint64) >> np.uint64(drop)) << np.uint64(bits)) | np.arange(len(x), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).view(np.int64)
    if drop:
        key = x[order]
        if (key[1:] < key[:-1]).any():
            return np.unique(x, return_inverse=True)
    else:
        key >>= np.uint64(bits)
        key = key.astype(x.dtype, copy=False)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return key[new], inverse


def trains(doc_id) -> bool:
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


#: Bytes hashed at once: few enough for their numbers to stay in a core's cache.
SLICE = 1 << 18
#: The hash of the end token, and of the context of a first word.
END = 0x9E3779B97F4A7C15


def _byte_values():
    """A pseudo-random odd number for each byte of a word, 0 for the blanks that part words."""
    import numpy as np

    x = np.random.default_rng(20_06).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x[[0x20, *range(0x09, 0x0E)]] = 0
    return x


#: The base of the word hash, odd.
BASE = 0xD1342543DE82EF95


def _powers(n: int):
    """The first ``n`` powers of the base, and those of its inverse."""
    import numpy as np

    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, x, dtype=np.uint64)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers))
    return out


def word_hashes(data: bytes, values=None, powers=None):
    """Start and hash of each word, by reading all bytes at once: the sum of byte values times powers of a base.

    Powers count from the first byte of all; sums up to the words' starts are parted and divided by the power at the start.
    """
    import numpy as np

    values = _byte_values() if values is None else values
    word = np.frombuffer(data.translate((values != 0).tobytes()), dtype=bool)
    start = word.copy()
    start[1:] &= ~word[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    up, down = powers if powers is not None and len(data) <= len(powers[0]) else _powers(len(data))
    x = values[np.frombuffer(data, dtype=np.uint8)]
    x *= up[: len(x)]
    np.cumsum(x, out=x)
    h = np.diff(x[starts[1:] - 1], prepend=np.uint64(0), append=x[-1:]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, h ^ (h >> np.uint64(32))


def _slices(texts):
    """(text's place, bytes, whether they end it): a text longer than a slice is cut at blanks."""
    import re

    blank = re.compile(rb"[\x20\x09-\x0D]")
    for i, t in enumerate(texts):
        while len(t) > SLICE and (cut := blank.search(t, SLICE)):
            yield i, t[: cut.start()] + b" ", False
            t = t[cut.end() :]
        yield i, t + b" ", True


class Lines:
    """The tokens of a block's documents as local numbers of their hashes; an end token closes each document, and is the context of a first word."""

    def __init__(self, table):
        import numpy as np

        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("b").to_pylist(), strict=True), key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[1]))
        self.ids = [r[0] for r in rows]
        values, powers, parts = _byte_values(), _powers(2 * SLICE), []
        self.sizes = np.ones(len(rows), dtype=np.int64)
        held: list = []

        def flush():
            sizes = [len(x) for _, x, _ in held]
            starts, h = word_hashes(b"".join(x for _, x, _ in held).lower(), values, powers)
            n = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
            last = np.fromiter((x for _, _, x in held), dtype=bool, count=len(held))
            np.add.at(self.sizes, [i for i, _, _ in held], n)
            # Each text's words, then its end token.
            at = np.cumsum(n + last)
            out = np.full(int(at[-1]), END, dtype=np.uint64)
            is_word = np.ones(len(out), dtype=bool)
            is_word[at[last] - 1] = False
            out[is_word] = h
            parts.append(out)
            held.clear()

        size = 0
        for piece in _slices([r[1] for r in rows]):
            held.append(piece)
            size += len(piece[1])
            if size >= SLICE:
                flush()
                size = 0
        if held:
            flush()
        self.hashes, tokens = _distinct(np.concatenate([np.array([END], dtype=np.uint64), *parts]))
        self.tokens = tokens[1:].astype(np.int32)
        self.order = np.arange(len(self.hashes))  # the order of asking
        self.before = np.full_like(self.tokens, tokens[0])
        self.before[1:] = self.tokens[:-1]  # an end token comes before each first word
        self.train = np.fromiter(map(trains, self.ids), dtype=bool, count=len(rows))

    def words_by_shard(self, shards: int):
        """(shard, places in the order of asking)"""
        import numpy as np

        shard = _shard_of(self.hashes[self.order], shards)
        cut = np.searchsorted(shard, np.arange(shards + 1))
        return [(s, self.order[cut[s] : cut[s + 1]]) for s in range(shards)]

    def pairs(self, number, shards: int):
        """The distinct pairs of known words, sorted by bucket, context and word.

        Gives all known contexts (numbers), pairs for each, bucket of each context, local context and word of each pair, and
        for each token the place of its pair (-1: none).
        """
        import numpy as np

        known = number >= 0
        by_w = _order(number + 1)
        by_u = by_w[_order(_bucket_of(number[by_w], shards))]
        rank_u, rank_w = np.empty(len(number), dtype=np.int64), np.empty(len(number), dtype=np.int64)
        rank_u[by_u] = rank_w[by_w] = np.arange(len(number))
        bits = len(number).bit_length()
        before = known[self.before]
        use = known[self.tokens] & before
        distinct, inverse = _distinct(rank_u[self.before[use]] << bits | rank_w[self.tokens[use]])
        place = np.full(len(self.tokens), -1, dtype=np.int64)
        place[use] = inverse
        u, w = distinct >> bits, by_w[distinct & ((1 << bits) - 1)]
        every = np.zeros(len(number), dtype=bool)
        every[self.before[before]] = True
        every = np.flatnonzero(every[by_u])
        contexts = number[by_u[every]]
        return contexts, np.bincount(u, minlength=len(number))[every], _bucket_of(contexts, shards), by_u[u], w, place


def _shard_of(hashes, shards: int):
    import numpy as np

    return (((hashes >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _bucket_of(number, shards: int):
    import numpy as np

    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _shard_of(x ^ (x >> np.uint64(32)), shards)


class Restaurants:
    """Seating by single moves, ``reseats`` a dish at most in all: what ``Seating`` is held against."""

    def __init__(self, restaurant, customers, discount: float, strength: float, reseats: int):
        import numpy as np

        self.restaurant, self.customers, self.discount, self.strength = restaurant, customers.astype(np.int64), discount, strength
        self.tables = np.minimum(self.customers, 1)
        self.moving = np.flatnonzero(self.customers >= 2)
        self.sizes = np.zeros((len(self.moving), 2 + reseats), dtype=np.int64)
        self.sizes[:, 0] = self.customers[self.moving]
        n = int(restaurant.max()) + 1 if len(restaurant) else 0
        self.table_total = np.bincount(restaurant, weights=self.tables, minlength=n)

    def sweep(self, base, rng, reseats: int) -> None:
        """``base``: the parent's probability of each moving dish."""
        import numpy as np

        rows = np.arange(len(self.moving))
        if not len(rows):
            return
        where = self.restaurant[self.moving]
        number = self.customers[self.moving]
        for _ in range(reseats):
            room = np.cumsum(self.sizes, axis=1)
            k = (room <= (rng.random(len(rows)) * number)[:, None]).sum(axis=1)
            self.sizes[rows, k] -= 1
            gone = (self.sizes[rows, k] == 0).astype(np.int64)
            new = (self.strength + self.discount * (self.table_total[where] - gone)) * base
            weight = np.cumsum(np.maximum(self.sizes - self.discount, 0), axis=1)
            draw = rng.random(len(rows)) * (weight[:, -1] + new)
            fresh = draw >= weight[:, -1]
            k = np.where(fresh, np.argmin(self.sizes, axis=1), (weight <= draw[:, None]).sum(axis=1))
            k = np.minimum(k, self.sizes.shape[1] - 1)
            self.sizes[rows, k] += 1
            change = fresh.astype(np.int64) - gone
            self.tables[self.moving] += change
            self.table_total += np.bincount(where, weights=change, minlength=len(self.table_total))


#: Dishes of up to so many customers have their table count drawn at once from its exact conditional; larger ones reseat each customer.
AT_ONCE = 1024


#: By discount, the rows of ``log_stirling`` known so far: AT_ONCE at most (4 MB), for all sweeps of a worker.
_STIRLING: dict = {}


def log_stirling(counts, discount: float) -> dict:
    """For each count c: the logarithms of the generalised Stirling numbers of c customers at 1..c tables."""
    import numpy as np

    wanted = set(np.asarray(counts).tolist())
    rows = _STIRLING.setdefault(discount, [np.zeros(1)])
    for c in range(len(rows) + 1, max(wanted, default=0) + 1):
        t = np.arange(1, c + 1)
        stay = np.append(rows[-1] + np.log(c - 1 - discount * t[:-1]), -np.inf)
        rows.append(np.logaddexp(stay, np.append(-np.inf, rows[-1])))
    return {c: rows[c - 1] for c in wanted}


class Seats:
    """The customers of one dish, each with its table: ``sizes`` of them at each."""

    def __init__(self, sizes: list[int]):
        import numpy as np

        self.at = np.repeat(np.arange(len(sizes)), sizes).tolist()
        self.size, self.free, self.tables = list(sizes), [], len(sizes)

    def resize(self, n: int, other_tables: float, base: float, discount: float, strength: float, rng) -> None:
        """Customers drawn at random leave, or new ones come, until there are ``n``."""
        at, size, free, tables, random = self.at, self.size, self.free, self.tables, rng.random
        while len(at) > n:
            i = int(random() * len(at))
            at[i], at[-1] = at[-1], at[i]
            k = at.pop()
            size[k] -= 1
            if not size[k]:
                free.append(k)
                tables -= 1
        for seated in range(len(at), n):
            old = seated - discount * tables
            if random() * (old + (strength + discount * (other_tables + tables)) * base) >= old:
                if not free:
                    size.append(0)
                k = free.pop() if free else len(size) - 1
                tables += 1
            else:
                while True:  # a table by a customer at it, then given up with odds of discount / size
                    k = at[int(random() * seated)]
                    if random() * size[k] >= discount:
                        break
            size[k] += 1
            at.append(k)
        self.tables = tables

    def sweep(self, other_tables: float, base: float, discount: float, strength: float, rng) -> None:
        """Unseats each customer once and seats it again: at one of the tables in proportion to size less discount, or at a new one. The last place is the moving customer's."""
        at, size, free, tables, random = self.at, self.size, self.free, self.tables, rng.random
        last, weighed = len(at) - 1, -1
        for i in range(len(at)):
            k = at[i]
            at[i] = at[last]
            size[k] -= 1
            if not size[k]:
                free.append(k)
                tables -= 1
            if tables != weighed:  # weights change with the tables only
                weighed, old = tables, last - discount * tables
                every = old + (strength + discount * (other_tables + tables)) * base
            if random() * every >= old:
                if not free:
                    size.append(0)
                k = free.pop() if free else len(size) - 1
                tables += 1
            else:
                while True:
                    k = at[int(random() * last)]
                    if random() * size[k] >= discount:
                        break
            size[k] += 1
            at[last] = k
        self.tables = tables


class Seating:
    """Dishes with their customers at tables, by restaurant; dishes of one customer have one table and never move."""

    def __init__(self, restaurant, customers, discount: float, strength: float, n: int = 1):
        import numpy as np

        self.restaurant, self.customers, self.discount, self.strength = restaurant, customers.astype(np.int64), discount, strength
        self.tables = np.minimum(self.customers, 1)
        self.n = n
        self.seats: dict = {}
        self._count()

    def _count(self) -> None:
        import numpy as np

        self.moving = np.flatnonzero(self.customers >= 2)
        self.table_total = np.bincount(self.restaurant, weights=self.tables, minlength=self.n)

    def state(self):
        """The seating as arrays: tables of the moving dishes, then the dishes seated one by one, their tables and the customers at each."""
        import numpy as np

        big = sorted(self.seats)
        sizes = [[n for n in self.seats[d].size if n] for d in big]
        return [self.tables[self.moving].astype(np.uint32), np.array(big, dtype=np.uint32), np.array([len(x) for x in sizes], dtype=np.uint32), np.array([n for x in sizes for n in x], dtype=np.uint32)]

    def restore(self, tables, big, n, sizes) -> None:
        """Takes up a ``state`` of the same dishes and customers."""
        import numpy as np

        self.restore_tables(tables)
        ends = np.cumsum(n.astype(np.int64)).tolist()
        self.seats = {d: Seats(sizes[e - k : e].tolist()) for d, k, e in zip(big.tolist(), n.tolist(), ends, strict=True)}

    def restore_tables(self, tables) -> None:
        """Takes up the first array of a ``state``, how many tables the moving dishes have, not who sits where."""
        import numpy as np

        self.tables[self.moving] = tables
        self.table_total = np.bincount(self.restaurant, weights=self.tables, minlength=self.n)

    def seat(self, customers) -> None:
        """As many customers as this from now on; a dish keeps its tables as far as it has customers for them."""
        import numpy as np

        self.customers = customers.astype(np.int64)
        self.tables = np.clip(self.tables, np.minimum(self.customers, 1), self.customers)
        self._count()

    def sweep(self, base, rng) -> None:
        """All customers of all moving dishes once. ``base``: the parent's probability of each moving dish."""
        import random

        import numpy as np

        if not len(self.moving):
            return
        number = self.customers[self.moving]
        order = _order(number)
        ordered = number[order]
        cut = np.flatnonzero(np.diff(ordered, prepend=0))
        small = ordered[cut][ordered[cut] <= AT_ONCE]
        stirling = log_stirling(small, self.discount)
        for i in np.split(order, cut[1:]):
            c = int(number[i[0]])
            if c > AT_ONCE:
                break
            t = np.arange(1, c + 1)
            if c <= 16:  # the same weights over that of one table, as products
                own, p = self.moving[i], base[i]
                r = self.restaurant[own]
                grown = self.strength + self.discount * (self.table_total[r] - self.tables[own])
                times = np.exp(stirling[c] - stirling[c][0])
                product, sums = np.ones(len(own)), [np.ones(len(own))]
                for k in range(1, c):
                    product = product * ((grown + self.discount * k) * p)
                    sums.append(sums[-1] + product * times[k])
                draw = rng.random(len(own)) * sums[-1]
                new = np.ones(len(own), dtype=np.int64)
                for x in sums[:-1]:
                    new += x <= draw
                change = new - self.tables[own]
                self.tables[own] = new
                self.table_total += np.bincount(r, weights=change, minlength=self.n)
                continue
            step = max(1, (1 << 20) // c)
            for at in range(0, len(i), step):
                own = self.moving[i[at : at + step]]
                other = self.table_total[self.restaurant[own]] - self.tables[own]
                # Each new table has weight (strength + discount * tables so far) * base.
                grown = np.log((self.strength + self.discount * (other[:, None] + t[None, :] - 1)) * base[i[at : at + step], None])
                weight = np.cumsum(grown, axis=1) + stirling[c]
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                new = 1 + (weight <= (rng.random(len(own)) * weight[:, -1])[:, None]).sum(axis=1)
                change = np.minimum(new, c) - self.tables[own]
                self.tables[own] += change
                self.table_total += np.bincount(self.restaurant[own], weights=change, minlength=self.n)
        draw = random.Random(int(rng.integers(1 << 62)))
        for i in order[np.searchsorted(ordered, AT_ONCE, side="right") :].tolist():
            dish, c, p = int(self.moving[i]), int(number[i]), float(base[i])
            r = self.restaurant[dish]
            other = float(self.table_total[r] - self.tables[dish])
            tables = int(self.tables[dish])
            seats = self.seats.get(dish) or Seats([c - tables + 1, *[1] * (tables - 1)])
            seats.resize(c, other, p, self.discount, self.strength, draw)
            seats.sweep(other, p, self.discount, self.strength, draw)
            self.seats[dish] = seats
            self.table_total[r] += seats.tables - self.tables[dish]
            self.tables[dish] = seats.tables


class Bucket:
    """The contexts of one bucket, from what the blocks sent."""

    def __init__(self, table, key: int):
        import numpy as np

        self.key = key
        self.blocks, us, ns, ws, cs = [], [], [], [], []
        for origin, (contexts, n, steps, counts) in _read(table, 0):
            u = np.cumsum(contexts.astype(np.int64))
            n = n.astype(np.int64)
            first = (np.cumsum(n) - n)[n > 0]
            total = np.cumsum(steps.astype(np.int64))
            w = total - np.repeat(total[first] - steps[first].astype(np.int64), n[n > 0])
            self.blocks.append((origin, u, len(w)))
            us.append(u)
            ns.append(n)
            ws.append(w)
            cs.append(counts.astype(np.int64))
        u, n, w, c = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, ns, ws, cs))
        self.contexts, u = _distinct(u)
        self.words, w = _distinct(w)
        bits = len(self.words).bit_length()
        codes, self.of_message = _distinct(np.repeat(u, n) << bits | w)
        self.u, self.w = codes >> bits, codes & ((1 << bits) - 1)
        self.c = np.bincount(self.of_message, weights=c, minlength=len(codes)).astype(np.int64)
        self.total = np.bincount(self.u, weights=self.c, minlength=len(self.contexts))
        self.seats = Seating(self.u, self.c, DISCOUNT, STRENGTH, len(self.contexts))
        seen, wanted = np.zeros(len(self.words), dtype=bool), np.zeros(len(self.words), dtype=bool)
        seen[self.w[self.c > 0]] = True
        wanted[self.w[self.c >= 2]] = True
        self.told = np.flatnonzero(seen)  # words that the parent hears of
        self.wanted = wanted[self.told]

    def sums(self):
        import numpy as np

        return np.bincount(self.w, weights=self.seats.tables, minlength=len(self.words))[self.told]

    def by_shard(self, shards: int):
        import numpy as np

        shard = self.words[self.told] % shards
        order = _order(shard)
        cut = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
        return [(s, order[cut[s] : cut[s + 1]]) for s in range(shards) if cut[s] < cut[s + 1]]

    def sweep(self, step: int, answers, shards: int) -> None:
        """One sweep, given the parent's answers."""
        import numpy as np

        mass, n, t, v = np.zeros(len(self.words)), 0.0, 0.0, 0.0
        places = dict(self.by_shard(shards))
        for shard, (a, totals) in answers:
            own = places.get(shard)
            if own is not None:
                own = own[self.wanted[own]]
                mass[self.told[own]] = a
            n, t, v = n + totals[0], t + totals[1], v + totals[2]
        base = (mass + (PARENT_STRENGTH + PARENT_DISCOUNT * t) / (v + 1)) / (PARENT_STRENGTH + n)
        self.seats.sweep(base[self.w[self.seats.moving]], np.random.default_rng([7, step, self.key]))


class Shard:
    """One shard of the vocabulary: counts of its words, and their seats in the parent restaurant."""

    def __init__(self, table, key: int):
        import numpy as np

        self.key = key
        sent = _read(table, 0)
        every = np.concatenate([x[0] for _, x in sent]) if sent else np.zeros(0, dtype=np.uint64)
        counts = np.concatenate([x[1].astype(np.int64) for _, x in sent]) if sent else np.zeros(0, dtype=np.int64)
        hashes, inverse = _distinct(every)
        count = np.bincount(inverse, weights=counts, minlength=len(hashes)).astype(np.int64)
        order = np.lexsort((hashes, -count))
        self.size = int((count > 0).sum())  # training words come first
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[order] = np.arange(len(hashes))
        self.total = int(count.sum())
        ends = np.cumsum([len(x[0]) for _, x in sent])
        self.asked = {o: (rank[i], count[i]) for (o, _), i in zip(sent, np.split(inverse, ends[:-1]) if sent else [], strict=True)}

    def parent(self, step: int, messages):
        """The seating after the buckets' sweep ``step``: seats, each word's customers less discount, totals, and who told which words and wants which.

        ``messages`` has the buckets' first message, that of the step, and the state after the step before.
        """
        import numpy as np

        first = messages.get(0, [])
        words = {o: x[0].astype(np.int64) for o, x in first}
        wanted = {o: x[2].astype(bool) for o, x in first}

        def customers(at):
            n = np.zeros(self.size, dtype=np.int64)
            later = {o: x[0] for o, x in messages.get(at, [])} if at else {}
            for o, x in first:
                now = x[1].astype(np.int64)
                if o in later:
                    now[wanted[o]] = later[o]
                n[words[o]] += now
            return n

        seats = Seating(np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64), PARENT_DISCOUNT, PARENT_STRENGTH)
        if step:
            (_, (before, *state, _, _)), = messages[SHARD_STATE + step - 1]
            seats.seat(before)
            seats.restore(*state)
        n = customers(step)
        seats.seat(n)
        # A new table's weight is (strength + discount * tables) / (words + 1); tables a word are here as everywhere.
        own = float(seats.tables.sum())
        base = PARENT_DISCOUNT * own / max(1, self.size) / (PARENT_STRENGTH + PARENT_DISCOUNT * own)
        seats.sweep(np.full(len(seats.moving), base), np.random.default_rng([8, step, self.key]))
        totals = np.array([n.sum(), seats.tables.sum(), self.size, self.total], dtype=np.float64)
        return seats, n - PARENT_DISCOUNT * seats.tables, totals, words, wanted


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text), perplexity (10 to the minus score a token).

    ``parts``: blocks, buckets and shards; by default as many as the bytes ask for.
    """
    import numpy as np

    if not 0 <= burn_in < sweeps:
        raise ValueError("some sweep has to be averaged")
    samples = sweeps - burn_in
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("b"))
    parts = parts or block_count(docs.sparkSession, rows.agg(F.sum(F.length("b"))).first()[0] or 0)
    # Rows that repeat both id and text are parted by where they come from.
    dealt = rows.withColumn("target", F.pmod(F.xxhash64("doc_id", F.length("b"), F.substring("b", 1, 64), F.spark_partition_id()), F.lit(parts)).cast("int")).repartition(parts, "target")
    unseen = np.uint32(0xFFFFFFFF)

    def count_words(key, table):
        lines = Lines(table)
        train = np.bincount(lines.tokens, weights=np.repeat(lines.train, lines.sizes), minlength=len(lines.hashes)).astype(np.uint32)
        return _messages([(s, key[0].as_py(), 0, _pack(lines.hashes[i], train[i])) for s, i in lines.words_by_shard(parts) if len(i)])

    def number_words(key, table):
        shard = Shard(table, key[0].as_py())
        totals, none = np.array([shard.total, shard.size], dtype=np.float64), np.zeros(0, dtype=np.uint32)
        out = []
        for m in range(parts):
            rank, count = shard.asked.get(m, (none, none))
            out.append((m, shard.key, 0, _pack(np.where(count > 0, rank, unseen).astype(np.uint32), count.astype(np.uint32), totals)))
        return _messages(out)

    def numbered(lines, table):
        """Number (-1: unseen) and count of each local word, training tokens and words."""
        number, count = np.full(len(lines.hashes), -1, dtype=np.int64), np.zeros(len(lines.hashes), dtype=np.int64)
        places, n, v = dict(lines.words_by_shard(parts)), 0, 0
        for shard, (rank, c, totals) in _read(table, 0):
            if len(rank):
                number[places[shard]] = np.where(rank == unseen, -1, rank.astype(np.int64) * parts + shard)
                count[places[shard]] = c
            n, v = n + int(totals[0]), v + int(totals[1])
        return number, count, n, v

    def send_pairs(key, table, answers):
        if not len(table):
            return _messages([])
        lines = Lines(table)
        number, _, _, _ = numbered(lines, answers)
        contexts, n, bucket, _, words, place = lines.pairs(number, parts)
        counts, words = np.bincount(place[np.repeat(lines.train, lines.sizes) & (place >= 0)], minlength=len(words)), number[words]
        ends = np.cumsum(n)
        out, cut = [], np.searchsorted(bucket, np.arange(parts + 1)).tolist()
        for b in range(parts):
            i = np.arange(cut[b], cut[b + 1])
            if not len(i):
                continue
            at, to = int(ends[i[0]] - n[i[0]]), int(ends[i[-1]])
            w, c = words[at:to], counts[at:to]
            step = np.diff(w, prepend=0)
            first = (ends[i] - n[i] - at)[n[i] > 0]
            step[first] = w[first]
            small = np.uint32 if step.max(initial=0) < 1 << 32 else np.uint64
            u = np.diff(contexts[i], prepend=0)
            out.append((b, key[0].as_py(), 0, _pack(u.astype(np.uint32 if u.max() < 1 << 32 else np.uint64), n[i].astype(np.uint32), step.astype(small), c.astype(np.uint32))))
        return _messages(out)

    def seat(key, table):
        bucket = Bucket(table, key[0].as_py())
        sums = bucket.sums()
        return _messages([(s, bucket.key, 0, _pack((bucket.words[bucket.told[i]] // parts).astype(np.uint32), sums[i].astype(np.uint32), bucket.wanted[i])) for s, i in bucket.by_shard(parts)])

    def parent(step):
        def run(key, table, messages):
            if not len(table):
                return _messages([])
            shard = Shard(table, key[0].as_py())
            seats, mass, totals, words, wanted = shard.parent(step - 1, _read(messages))
            out = [(shard.key, shard.key, SHARD_STATE + step - 1, _pack(seats.customers.astype(np.uint32), *seats.state(), mass.astype(np.float32), totals))]
            for b in range(parts):
                own = words[b][wanted[b]] if b in words else np.zeros(0, dtype=np.int64)
                out.append((b, shard.key, ANSWER + step, _pack(mass[own].astype(np.float32), totals)))
            return _messages(out)

        run.__name__ = f"parent_{step}"
        return run

    def sweep(step):
        def run(key, table, told):
            if not len(table):
                return _messages([])
            bucket, messages = Bucket(table, key[0].as_py()), _read(told)
            if step > 1:
                bucket.seats.restore(*messages[BUCKET_STATE + step - 1][0][1])
            bucket.sweep(step, messages.get(ANSWER + step, []), parts)
            sums = bucket.sums()
            state = (bucket.key, bucket.key, BUCKET_STATE + step, _pack(*bucket.seats.state()))
            return _messages([state, *[(s, bucket.key, step, _pack(sums[i][bucket.wanted[i]].astype(np.uint32))) for s, i in bucket.by_shard(parts)]])

        run.__name__ = f"sweep_{step}"
        return run

    def tell_words(key, table, told):
        if not len(table):
            return _messages([])
        shard, messages = Shard(table, key[0].as_py()), _read(told)
        if SHARD_STATE + sweeps - 1 in messages:
            _, mass, totals, _, _ = shard.parent(sweeps, messages)
            kept = [tuple(messages[SHARD_STATE + at][0][1][-2:]) for at in range(burn_in + 1, sweeps)] + [(mass, totals)]
        else:
            kept = [(np.zeros(shard.size), np.array([0.0, 0.0, shard.size, shard.total]))] * samples
        out = []
        for m in range(parts):
            rank, count = shard.asked.get(m, (np.zeros(0, dtype=np.int64),) * 2)
            seen = count > 0
            masses = []
            for mass, _ in kept:
                x = np.zeros(len(rank), dtype=np.float32)
                x[seen] = mass[rank[seen]]
                masses.append(x)
            out.append((m, shard.key, 1, _pack(np.concatenate(masses), np.concatenate([t for _, t in kept]))))
        return _messages(out)

    def tell_pairs(key, table, told):
        if not len(table):
            return _messages([])
        bucket, messages = Bucket(table, key[0].as_py()), _read(told)
        seats, full = bucket.seats, STRENGTH + bucket.total
        seen, back = np.zeros(len(bucket.c)), []
        for step in range(burn_in + 1, sweeps + 1):
            seats.restore_tables(messages[BUCKET_STATE + step][0][1][0])
            seen += np.maximum(bucket.c - DISCOUNT * seats.tables, 0) / full[bucket.u] / samples
            back.append(((STRENGTH + DISCOUNT * seats.table_total) / full).astype(np.float32))
        seen = seen.astype(np.float32)
        out, at = [], 0
        for m, contexts, pairs in bucket.blocks:
            own, u = bucket.of_message[at : at + pairs], np.searchsorted(bucket.contexts, contexts)
            out.append((m, bucket.key, 2, _pack(seen[own], *[x[u] for x in back])))
            at += pairs
        return _messages(out)

    def finish(key, table, answers):
        import pyarrow as pa

        if not len(table):
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        lines = Lines(table)
        number, count, n, v = numbered(lines, answers)
        contexts, _, bucket, context, word, place = lines.pairs(number, parts)
        masses, places = np.zeros((samples, len(number))), dict(lines.words_by_shard(parts))
        totals = np.zeros((samples, 4))
        for shard, (mass, total) in _read(answers, 1):
            masses[:, places[shard]] = mass.reshape(samples, -1)
            totals += total.reshape(samples, 4)
        root = (masses + ((PARENT_STRENGTH + PARENT_DISCOUNT * totals[:, 1]) / (v + 1))[:, None]) / (PARENT_STRENGTH + totals[:, 0])[:, None]
        told = dict(_read(answers, 2))
        seen = np.concatenate([np.zeros(0), *[told[b][0] for b in np.unique(bucket).tolist()]])
        # What is left to the parent, by context and sample: a context not seen in training leaves all.
        left = np.ones((samples, len(number)))
        back = [np.concatenate([np.zeros(0), *[told[b][1 + s] for b in np.unique(bucket).tolist()]]) for s in range(samples)]
        by_number = np.argsort(number, kind="stable")
        local = by_number[np.searchsorted(number[by_number], contexts)] if len(contexts) else contexts
        for s in range(samples):
            left[s, local] = back[s]

        def to_parent(u, w):
            p = np.zeros(len(u))
            for s in range(samples):
                p += left[s, u] * root[s, w] / samples
            return p

        # Once for each distinct pair, and for each token of an unknown word or context.
        none = np.flatnonzero(place < 0)
        place[none] = len(seen) + np.arange(len(none))
        log = np.log10(np.concatenate([to_parent(context, word) + seen, to_parent(lines.before[none], lines.tokens[none])]))
        start = np.cumsum(lines.sizes) - lines.sizes
        add = lambda x: np.add.reduceat(x, start)
        base = add(np.log10((count + 1.0) / (n + v + 1.0))[lines.tokens])
        score = add(log[place])
        out = {"doc_id": lines.ids, "held_out": ~lines.train, "n_tokens": lines.sizes, "n_known": add((count > 0).astype(np.int64)[lines.tokens]), "train_tokens": np.full(len(start), n), "base_score": base, "score": score, "perplexity": 10 ** (-score / lines.sizes)}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    import pyarrow as pa

    kinds = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "perplexity": pa.float64()}
    kinds = {"doc_id": to_arrow_type(rows.schema["doc_id"].dataType), **kinds}
    deal = lambda df: df.repartition(parts, "target")
    both = lambda a, b, f: a.groupBy("target").cogroup(b.groupBy("target")).applyInArrow(lean_cogroup(f), MESSAGE)
    words = deal(dealt.groupBy("target").applyInArrow(lean(count_words), MESSAGE))
    numbers = deal(words.groupBy("target").applyInArrow(lean(number_words), MESSAGE))
    pairs = deal(both(dealt, numbers, send_pairs))
    tables = [deal(pairs.groupBy("target").applyInArrow(lean(seat), MESSAGE))]
    answers: list = []
    for step in range(1, sweeps + 1):
        told = tables[0]
        if step > 1:  # the shards' states are among the parent's answers, the buckets' among their tables
            told = told.unionByName(tables[-1]).unionByName(answers[-1])
        answers.append(deal(both(words, told, parent(step))))
        told = answers[-1] if step == 1 else answers[-1].unionByName(tables[-1])
        tables.append(deal(both(pairs, told, sweep(step))))
    told = tables[0].unionByName(tables[-1])
    for x in answers[burn_in + 1 :] if sweeps > burn_in + 1 else answers[-1:]:
        told = told.unionByName(x)
    states = tables[burn_in + 1]
    for x in tables[burn_in + 2 :]:
        states = states.unionByName(x)
    told = both(words, told, tell_words).unionByName(both(pairs, states, tell_pairs)).unionByName(numbers)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return dealt.groupBy("target").cogroup(deal(told).groupBy("target")).applyInArrow(lean_cogroup(finish), schema)
