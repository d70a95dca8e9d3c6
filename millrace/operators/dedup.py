"""Exact, per-source, per-URL and near-duplicate removal; n-gram contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import ngrams
from ..sources.shared import materialize, small_batches
from .graph import Forest, components


def keep_first(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order``. The key is hashed before the shuffle."""
    line = Window.partitionBy(F.sha2(key.cast("string"), 256)).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(line)).where("__n = 1").drop("__n")


def keep_latest_url(pages: DataFrame, url: str, version: str) -> DataFrame:
    """All rows of a url's greatest version; rows that tie on it stay."""
    latest = pages.groupBy(F.col(url).alias("__url")).agg(F.max(version).alias("__latest"))
    return pages.join(latest, F.col(url).eqNullSafe(F.col("__url")) & F.col(version).eqNullSafe(F.col("__latest")), "left_semi")


def latest_and_largest(pages: DataFrame, url: str, version: str, body: str) -> DataFrame:
    """The latest and the largest row of each url; one row if they are the same."""
    packed = F.struct(*pages.columns)
    best = pages.groupBy(url).agg(F.max_by(packed, F.struct(version)).alias("a"), F.max_by(packed, F.struct(F.length(body), F.col(version))).alias("b"))
    return best.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("x.*")


def too_frequent(elements: DataFrame, key: str, most: int = 10) -> DataFrame:
    return elements.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


#: Words or other elements that are broadcast at most.
BROADCAST_WORDS = 300_000


def most_frequent(counts: DataFrame, n: str = "n") -> tuple[DataFrame, DataFrame | None]:
    """Counted elements in two: the most frequent, ``BROADCAST_WORDS`` at most and down to a power of two of occurrences, and the others, None if there are none.

    What meets the first by a broadcast is most of a corpus, and no other element has enough occurrences to load one task.
    """
    bits = F.length(F.bin(n))
    classes = {r["bits"]: r["many"] for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("many")).collect()}
    held, least = 0, 63
    for b in sorted(classes, reverse=True):
        held += classes[b]
        if held > BROADCAST_WORDS:
            return counts.where(F.col(n) >= 1 << least - 1), counts.where(F.col(n) < 1 << least - 1)
        least = b
    return counts, None


def drop_frequent_elements(docs: DataFrame, key: str, array: str, most: int = 10) -> DataFrame:
    """Removes array elements that occur more than ``most`` times in the corpus; order stays.

    The most frequent are dropped by a broadcast in the task that reads them; only what is left is shuffled.
    """
    each = docs.select(key, F.posexplode(array).alias("pos", "x"))
    first, others = most_frequent(materialize(too_frequent(docs.select(F.explode(array).alias("x")), "x", most), "frequent"))
    kept = each.join(F.broadcast(first.select("x")), "x", "left_anti")
    if others is not None:
        kept = kept.join(others.select("x"), "x", "left_anti")
    back = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(array))
    return docs.drop(array).join(back, key, "left").withColumn(array, F.coalesce(array, F.array().cast(dict(docs.dtypes)[array])))


def paragraph_counts(docs: DataFrame, group: str, text: str, sep: str = "\n\n") -> DataFrame:
    """(group, paragraph hash, n): every occurrence counts, also within one document."""
    each = docs.select(group, F.explode(F.split(F.col(text), sep)).alias("p"))
    return each.groupBy(group, F.sha2("p", 256).alias("p_sha256")).agg(F.count("*").alias("n"))


def drop_repeated_paragraphs(docs: DataFrame, key: str, group: str, text: str, sep: str = "\n\n", least: int = 3, marker: str | None = None) -> DataFrame:
    """Removes paragraphs that occur ``least`` times or more within their group, except the marker; emptied documents go.

    Only the hashes of repeated paragraphs are joined back, so a common line costs one row a document.
    """
    repeated = paragraph_counts(docs, group, text, sep).where(F.col("n") >= least).select(F.col(group).alias("__g"), F.col("p_sha256"), F.lit(1).alias("gone"))
    each = docs.select(key, group, F.posexplode(F.split(F.col(text), sep)).alias("pos", "p"))
    keep = F.col("gone").isNull() | (F.col("p") == F.lit(marker) if marker is not None else F.lit(False))
    kept = each.join(repeated, F.col(group).eqNullSafe(F.col("__g")) & (F.sha2("p", 256) == F.col("p_sha256")), "left").where(keep)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]), sep).alias(text))


def keep_first_in_array(array: Column, by=lambda x: x) -> Column:
    """An array without elements whose key occurs earlier in it."""
    keys = F.transform(array, by)
    return F.filter(array, lambda x, i: F.array_position(keys, by(x)) == i + 1)


def set_key(array: Column) -> Column:
    """One key for arrays with the same set of elements."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(array)), "\x1f"), 256)


#: Odd factors of a word's place in a shingle.
PLACE_ODD = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, n: int = 5):
    """The distinct 64-bit hashes of a text's n-word shingles, sorted; fewer words make one shingle, none makes none."""
    import re

    return hashed_shingles([w.encode() for w in re.findall(r"\w+", (text or "").lower())], n)


def hashed_shingles(words: list[bytes], n: int):
    """The distinct 64-bit hashes of the n-word shingles of these words, sorted."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.int64)
    known = {w: xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ h[i : len(h) - size + 1 + i]) * np.uint64(PLACE_ODD)
        total ^= total >> np.uint64(32)
    return np.unique(total.view(np.int64))


#: Mixes shingle hashes to the number of their set.
SET_ODD = 0xD6E8FEB86659FD93


def set_number(s) -> int:
    import numpy as np

    mixed = s.astype(np.uint64) * np.uint64(SET_ODD)
    return (mixed ^ (mixed >> np.uint64(31))).sum(dtype=np.uint64).astype(np.int64)


def shingle_sets(docs: DataFrame, text: str, shingles) -> DataFrame:
    """(sid, s) of texts with shingles; computed again where needed, as sets take more room than texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [s for x in batch.column(0).to_pylist() if len(s := shingles(x))]
            yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["sid", "s"])

    return docs.select(text).mapInArrow(run, "sid long, s array<long>")


def _signed(docs: DataFrame, key: str, text: str, shingles, bands: int, rows: int) -> DataFrame:
    """(id, sid, bands) of texts with shingles: ``sid`` is one number for equal shingle sets, ``bands`` a hash of each band's minima."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20_16)
        odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        place = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        for batch in batches:
            ids, sids, signs = [], [], []
            for i, x in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = shingles(x)
                if len(s):
                    least_of = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                    for at in range(0, len(s), 1024):
                        part = s[at : at + 1024].astype(np.uint64)[:, None] * odd[None, :]
                        least_of = np.minimum(least_of, (part ^ (part >> np.uint64(29))).min(axis=0))
                    ids.append(i.as_py())
                    sids.append(set_number(s))
                    signs.append(((least_of.reshape(bands, rows) * odd[:rows]).sum(axis=1) + place).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(sids, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], names=["id", "sid", "bands"])

    rows_in = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    return rows_in.mapInArrow(sign, f"id {dict(rows_in.dtypes)['id']}, sid long, bands array<long>")


#: Sets of a band's group that are compared with one another at once.
BLOCK = 512


def _block_links(key, table, least: float):
    """Links between sets of one group, or of two blocks of it, enough to connect what is alike; same labels are connected already."""
    import numpy as np
    import pyarrow as pa


    sid, label, block = (np.asarray(table.column(c).combine_chunks()) for c in ("sid", "label", "block"))
    sets = table.column("s").combine_chunks()
    sizes = np.diff(np.asarray(sets.offsets))
    flat = np.asarray(sets.flatten())
    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(sid)), sizes)[order]
    count = np.bincount(token)
    start = np.cumsum(count) - count
    ends = np.cumsum(sizes)
    forest, found = Forest(), []
    two = len(set(block.tolist())) > 1
    for i in range(len(sid)):
        own = token[ends[i] - sizes[i] : ends[i]]
        n = count[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sid))
        near = shared / (sizes + sizes[i] - shared) >= least
        near &= (label != label[i]) & (block != block[i] if two else True)
        for j in np.flatnonzero(near[:i]).tolist():
            x, y = int(label[i]), int(label[j])
            if forest.find(x) != forest.find(y):
                forest.link(x, y)
                found.append((int(sid[i]), int(sid[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


#: Sets in groups up to which their numbers are broadcast (32 bytes each), so that of all sets only those are shuffled.
BROADCAST_SETS = 1_000_000


def jaccard_components(each: DataFrame, every: DataFrame, least: float) -> DataFrame:
    """(sid, root) of the sets that are alike through a chain of pairs, each of one group (``each``: sid, g) and verified exactly (``every``: sid, s).

    First each set is verified against the smallest of its group.
    Groups whose sets don't all hang on one and the same set after that are
    compared in full, in blocks; of groups with the same members, one is.
    """
    groups = each.groupBy("g").agg(F.min("sid").alias("rep"), F.max("sid").alias("top")).where("rep < top").select("g", "rep")
    member = materialize(each.join(groups, "g").distinct(), "bands")
    listed = member.select("sid").distinct()
    few = listed.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    sets = materialize(every.join(F.broadcast(listed) if few else listed, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    pairs = member.where("sid <> rep").select("sid", "rep").distinct()
    both = pairs.join(sets, "sid").join(sets.select(F.col("sid").alias("rep"), F.col("s").alias("t")), "rep")
    shared = F.size(F.array_intersect("s", "t"))
    first = materialize(both.where(shared / (F.size("s") + F.size("t") - shared) >= least).select(F.col("sid").alias("a"), F.col("rep").alias("b")), "links")
    label = first.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("label"))
    labelled = member.select("g", "sid").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_groups = labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x")).where("lo < hi")
    open_groups = open_groups.groupBy("n", "x").agg(F.min("g").alias("g"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = labelled.join(open_groups, "g").withColumn("m", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "label", "block").join(sets, "sid")
    second = dealt.groupBy("g", "i", "j").applyInArrow(lambda key, table: _block_links(key, table, least), "a long, b long")
    return components(first.unionByName(second)).withColumnRenamed("node", "sid")


def minhash_dedup(docs: DataFrame, key: str, text: str, n: int = 5, bands: int = 20, rows: int = 5, least: float = 0.8) -> DataFrame:
    """(key, kept_as): each document with the smallest id of its class of near copies.

    Words go in shingles of ``n``; two documents are near copies if they share
    a band of ``rows`` minima and their shingle sets have a Jaccard similarity
    of ``least`` or more, and a class is what chains of near copies connect.
    Texts without words are copies of none. Signatures come from one
    vectorised function: a hundred minima of an exploded column would read
    every shingle a hundred times.
    """
    small_batches(docs.sparkSession)
    shingles = lambda x: shingle_hashes(x, n)
    held = materialize(_signed(docs, key, text, shingles, bands, rows), "signatures")
    roots = jaccard_components(held.select("sid", F.explode("bands").alias("g")), shingle_sets(docs, text, shingles), least)
    rooted = held.select("id", "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("kept_as")), "root").groupBy(F.col("id").alias("__id")).agg(F.min("kept_as").alias("kept_as"))
    return docs.select(F.col(key)).join(named, F.col(key) == F.col("__id"), "left").select(key, F.coalesce("kept_as", F.col(key)).alias("kept_as"))


def gram_rows(docs: DataFrame, key: str, text: str, n: int = 13) -> DataFrame:
    """(key, gram): the distinct n-grams of lower-cased white-space words."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \n\t\r]+"), lambda x: x != "")
    split = docs.select(key, tokens.alias("t"))  # a column of its own: a lambda would split the text again for each n-gram
    return split.select(key, F.explode(F.array_distinct(ngrams(F.col("t"), n))).alias("gram"))


def gram_hashes(docs: DataFrame, key: str, text: str, n: int = 13) -> DataFrame:
    """(key, gram: two 64-bit hashes) for each n-gram, as often as it occurs: nothing longer than the hashes is ever made a row."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \n\t\r]+"), lambda x: x != "")

    def grams(t):
        size = F.size(t)
        at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        part = lambda i: F.slice(t, i, n)
        return F.transform(at, lambda i: F.struct(F.xxhash64(part(i)).alias("h"), F.xxhash64(F.lit(1), part(i)).alias("g")))

    return docs.select(key, F.explode(F.transform(F.array(tokens), grams)[0]).alias("gram"))


#: n-grams of a benchmark up to which they are broadcast (16 bytes each).
BROADCAST_GRAMS = 1_000_000


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """(key, item, n_grams): shared n-grams of documents and benchmark items, equal in 128 bits of hash."""
    right = gram_hashes(bench, item, text, n).distinct()
    few = right.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return gram_hashes(docs, key, text, n).join(F.broadcast(right) if few else right, "gram").select(key, item, "gram").distinct().groupBy(key, item).agg(F.count("*").alias("n_grams"))


def gram_lookup(docs: DataFrame, key: str, text: str, wanted: DataFrame, gram: str = "gram", longest: int = 4) -> DataFrame:
    """(gram, key): the documents that hold each of the wanted n-grams of 1 to ``longest`` words, equal in 128 bits of hash.

    The n-grams of documents meet the wanted ones as hashes in the row's own task; what meets is made distinct.
    """
    asked = wanted.select(F.col(gram).alias("gram"), F.split(gram, " ").alias("t")).where(F.size("t") <= longest)
    asked = asked.select("gram", F.size("t").alias("n"), F.struct(F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")).alias("x"))
    few = asked.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    lengths = [r["n"] for r in asked.select("n").distinct().collect()]
    out = None
    for n in sorted(lengths):
        one = gram_hashes(docs, key, text, n).withColumnRenamed("gram", "x")
        held = asked.where(F.col("n") == n).select("x", "gram")
        one = one.join(F.broadcast(held) if few else held, "x").select("gram", key)
        out = one if out is None else out.unionByName(one)
    return (docs.select(F.lit("").alias("gram"), key).limit(0) if out is None else out).distinct()


def gram_index(docs: DataFrame, key: str, text: str, longest: int = 4) -> DataFrame:
    """(key, gram): the distinct n-grams of 1 to ``longest`` words of each document."""
    out = None
    for n in range(1, longest + 1):
        one = gram_rows(docs, key, text, n)
        out = one if out is None else out.unionByName(one)
    return out


def hamming_pairs(codes: DataFrame, key: str, code: str, most: int = 7) -> DataFrame:
    """Pairs (a < b) of ids whose 64-bit codes differ in at most ``most`` bits.

    Of four bands of 16 bits, codes that near differ in a quarter of ``most``
    at most in one, so the join is by equality on a band, in which one side
    turns every choice of so many bits; equal codes are grouped first and
    expanded last.
    """
    from itertools import combinations

    turns = [sum(1 << b for b in bits) for n in range(most // 4 + 1) for bits in combinations(range(16), n)]
    distinct = codes.select(F.col(code).alias("c")).distinct()
    banded = distinct.select("c", F.posexplode(F.array(*[F.shiftrightunsigned("c", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)])).alias("i", "v"))
    turned = banded.select(F.col("c").alias("d"), "i", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in turns]), lambda x: F.col("v").bitwiseXOR(x))).alias("v"))
    near = banded.join(turned, ["i", "v"]).where((F.col("c") < F.col("d")) & (F.bit_count(F.col("c").bitwiseXOR(F.col("d"))) <= most)).select("c", "d").distinct()
    same = distinct.select("c", F.col("c").alias("d"))
    ids = codes.select(F.col(key).alias("id"), F.col(code).alias("c"))
    every = near.unionByName(same)
    pairs = every.join(ids.withColumnRenamed("id", "x"), "c").join(ids.select(F.col("id").alias("y"), F.col("c").alias("d")), "d").where("c <> d or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.bit_count(F.col("c").bitwiseXOR(F.col("d"))).cast("long").alias("distance"))
