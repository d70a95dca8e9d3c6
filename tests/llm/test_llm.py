"""The training-data operators against brute force, and on awkward rows."""

import gzip
import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import common, components, decontaminate, mixing, nearest, pitman_yor, quality, simhash, suffix, toxicity, urlfilter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def blanks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghé"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = text(120), text(60)
    out = [(i, text(int(rng.integers(1, 90)))) for i in range(60)]
    out += [(100 + i, base) for i in range(8)]
    out += [(120 + i, base.replace(base.split()[40 + i], "ZZ", 1)) for i in range(8)]
    out += [(140 + i, f"{text(20)} {passage} {text(25)}") for i in range(6)]
    out += [(160, None), (161, ""), (162, " \n\t "), (163, "a" * 3000), (164, text(9000)), (165, "ab" * 900), (166, f"{passage} {passage}"), (None, base), (170, "One"), (170, "One"), (171, "x"), (172, "É" * 150)]
    return [(i, t, "en", None if k % 11 == 0 else f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def bench(spark, rows):
    words = next(r[1] for r in rows if r[0] == 164).split()
    items = [(1, " ".join(words[100:125])), (2, " ".join(words[300:306]).upper()), (3, None), (4, "..."), (5, " ".join(words[110:122])), (6, "unseen words only here and nowhere else in any of these documents at all"), (None, " ".join(words[500:520])), (1, " ".join(words[100:125]))]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 1. Suffix array


def repeats_of(texts, k):
    count = Counter(b[i : i + k] for b in texts for i in range(len(b) - k + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i] += 1
                gone[i + k] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


@pytest.mark.parametrize(("length", "heavy"), [(200, 500), (24, 500), (200, 0), (24, 0), (24, 3)])
@pytest.mark.parametrize("parts", [None, 5])
def test_suffix_matches_brute_force(docs, rows, length, heavy, parts):
    texts = [(r[1] or "").encode() for r in rows]
    spans = lambda g: int((np.diff(g.astype(int), prepend=0) == 1).sum())
    want = sorted((r[0] is not None, r[0] or 0, len(b), int(g.sum()), spans(g), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()) for r, b, g in zip(rows, texts, repeats_of(texts, length), strict=True))
    got = suffix.kept(suffix.repeats(docs.withColumns({c: F.lit("clash") for c in ("b", "m", "rest", "spans", "kept", "bucket")}), length=length, heavy=heavy, parts=parts)).withColumn("h", F.sha2("kept", 256)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in got) == want


def test_suffix_cut_keeps_columns_and_nulls(docs, empty):
    out = suffix.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[160]["text"] is None and got[161]["text"] == "" and got[100]["text"] == "" and got[164]["text"].startswith(docs.where("doc_id = 164").first()["text"][:50])
    assert got[172]["text"] == "" and suffix.cut_repeats(empty).count() == 0 and suffix.repeats(empty).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    at = np.arange(2900)
    order = suffix.multikey_quicksort(suffix.Bytes(data), at, at + 100)
    strings = [data[i : i + 100] for i in order]
    assert strings == sorted(strings)
    lcp = suffix.common_prefix(suffix.Bytes(data), order[:-1], order[:-1] + 100, order[1:], order[1:] + 100)
    assert all(n == next((k for k in range(100) if a[k] != b[k]), 100) for n, a, b in zip(lcp.tolist(), strings, strings[1:], strict=False))


# 2. WARC


def test_warc_derivatives_link_and_digest(spark):
    page = "<html><head><title>T &amp; x</title><script>no</script></head><body><p>One<br>two</p><a href='/n'>link</a><!-- c --></body></html>"
    pages = spark.createDataFrame([(1, "https://h.com/a", page), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    raw = warc.responses(pages)
    out = warc.derive(raw).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in out) == [(i, k) for i in (1, 2, 3) for k in ("conversion", "metadata")]
    source = {r["page_id"]: bytes(r["record"]) for r in raw.collect()}
    by = {(r["page_id"], r["record_type"]): r for r in out}
    for (page_id, kind), r in by.items():
        headers, block = warc.parse_record(bytes(r["record"]))
        named = dict(headers)
        assert named["WARC-Refers-To"] == r["refers_to"] == dict(warc.parse_record(source[page_id])[0])["WARC-Record-ID"]
        assert named["WARC-Block-Digest"] == warc.digest(block) and int(named["Content-Length"]) == len(block)
        assert named["WARC-Concurrent-To"] == by[page_id, "conversion" if kind == "metadata" else "metadata"]["record_id"]
    assert warc.parse_record(bytes(by[1, "conversion"]["record"]))[1].decode() == "One\ntwo\nlink"
    meta = json.loads(warc.parse_record(bytes(by[1, "metadata"]["record"]))[1])
    assert meta["html"] == {"title": "T & x", "links": [{"tag": "a", "url": "https://h.com/n"}]}
    assert meta["payload"]["digest"] == meta["payload"]["computed_digest"] == warc.digest(page.encode())
    assert meta["warc"] == [list(x) for x in warc.parse_record(source[1])[0]]


def test_warc_charset_named_late():
    page = b"<html><head><script>" + b"x = 1;" * 1500 + b"</script><meta charset='windows-1251'></head><body>\xcf\xf0\xe8</body></html>"
    text, charset = warc.decode(page, "text/html")
    assert charset == "windows-1251" and "\u041f\u0440\u0438" in text


def test_warc_errors_and_files(spark, tmp_path):
    bad = spark.createDataFrame([(1, bytearray(b"junk"), "x"), (2, None, "y")], "id long, record binary, error string")
    assert sorted((r["id"], r["record_type"]) for r in warc.derive(bad).collect()) == [(1, "error"), (2, "error")]
    records = [warc.response_record(f"https://h.com/{i}", "x" * i, "2024-01-01T00:00:00Z") for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    back = [bytes(r["record"]) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(back) == sorted(records * 2) and gzip.decompress(warc.gzip_member(records[0])) == records[0]
    latin = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Date", "d")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9")
    assert warc.derivatives(latin)[1][4].decode() == "café"


def test_warc_broken_pages_take_time_in_proportion():
    for bad in ("<a x ", "<script>", "<title>", "<!--", "<!", "<meta x ", "<svg><p "):
        began = time.time()
        page = bad * 50_000
        warc.plain_text(page), warc._title(page), warc._page_links(page, "http://x/"), warc.decode(page.encode(), "")
        assert time.time() - began < 10, bad
    assert warc.plain_text("a<script>b</script >c<!-- e --><p>f</p><svg>g</svg>3 < 4<style>d") == "a c\nf\n3 < 4d"


def test_warc_matches_brute_force_text(spark):
    """Plain text by the standard library's parser, block tags as line ends."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head")
            self.out.append("\n" if tag in ("p", "div", "br", "h1", "li", "ul", "body", "html") else "")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head"):  # what isn't shown parts words
                self.skip -= 1
                self.out.append(" ")
            self.out.append("\n" if tag in ("p", "div", "h1", "li", "ul", "body", "html") else "")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data.replace("\n", " "))

    rng = np.random.default_rng(4)
    pages = []
    for i in range(40):
        inner = "".join(f"<{t}>{' '.join(rng.choice(['one', 'two &amp; x', 'thr&eacute;e', '  '], 4))}</{t}>" for t in rng.choice(["p", "div", "b", "h1", "i", "script"], 8))
        pages.append((i, "http://h/", f"<html><head><title>t</title></head><body>{inner}</body></html>"))
    pages += [(50, "http://h/", "x " * 300_000), (51, None, None), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("record_type", "error", "payload_digest", "headers")})
    out = warc.derive(warc.responses(df)).where("record_type = 'conversion'").collect()
    assert len(out) == len(pages) and {r["headers"] for r in out} == {"clash"}
    html = {i: h for i, _, h in pages}
    for r in out:
        plain = Plain()
        plain.feed(html[r["page_id"]] or "")
        want = re.sub(r" ?\n[ \n]*", "\n", re.sub(" +", " ", "".join(plain.out))).strip()
        assert warc.parse_record(bytes(r["record"]))[1].decode() == want
    assert warc.derive(warc.responses(df.limit(0))).count() == 0


# 3. Nearest neighbours


def test_nearest_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))).tolist()
    x[20:60] = [x[10]] * 40  # ties
    data = [(i, v) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, []), (2050, [1.0, 2.0]), (None, x[0]), (7, x[7])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got: dict = {}
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = np.array(x)
    m /= np.sqrt((m * m).sum(1))[:, None]
    hit = 0
    for q in range(0, 900, 50):
        s = m @ m[q]
        s[q] = -9
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:5].tolist()
        rows = sorted(got[q])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r[2] - s[r[1]]) < 1e-12 for r in rows)
        hit += len(set(want) & {r[1] for r in rows})
    assert hit >= 0.9 * 5 * 18
    assert [r[1] for r in sorted(got[50])] == [10, 20, 21, 22, 23]
    assert 2050 not in got and set(got) == set(range(0, 900, 50))
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square_quantile():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# 4. SimHash


def fingerprint_of(text):
    w = blanks(text)
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs, rows):
    fps = [fingerprint_of(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    want = sorted((str(r[0]), f % 2**64, least[k]) for r, f, k in zip(rows, fps, label, strict=True))
    got = simhash.simhash_components(docs.withColumn("fp", F.lit("clash")))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got.collect()) == want


def test_simhash_dedup(docs, empty):
    kept = [r["doc_id"] for r in simhash.simhash_dedup(docs).collect()]
    assert kept.count(170) == 1 and 100 in kept and 101 not in kept and None in kept and 160 in kept and 161 not in kept
    assert simhash.simhash_dedup(empty).count() == 0


def test_tile_links_span_what_is_near():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 20)
    a = np.concatenate([base, base ^ 1, base ^ 6])
    found = simhash.tile_links(a, a)
    assert 40 <= len(found) <= 2 * len(a) and all((x ^ y).bit_count() <= 3 for x, y in found)


@pytest.mark.parametrize("task", [200_000, 10])
def test_components_of_a_long_path(spark, monkeypatch, task):
    monkeypatch.setattr("millrace.operators.graph.TASK_EDGES", task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 180)] + [(5, 5), (None, 3), (7, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges.repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(101, 181)}, 900: 7}


@pytest.mark.parametrize("task", [200_000, 50])
def test_components_of_hubs(spark, monkeypatch, task):
    monkeypatch.setattr("millrace.operators.graph.TASK_EDGES", task)
    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(300, 700)] + [(5000 + i, 9000) for i in range(100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in [*range(1, 700), 1000]}, **{i: 5000 for i in [*range(5001, 5100), 9000]}}


def test_block_count(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [common.block_count(spark, n) for n in (0, 10, 3 << 20, 1 << 30)] == [1, 1, min(parts, 3), 64]
    for n in (1 << 40, 1 << 47):
        assert common.block_count(spark, n) ** 2 <= n / common.MESSAGE_BYTES
    assert common.block_count(spark, 1 << 37) == 1 << 13


# 5. Decontamination


def windows_of(items):
    out: dict = {}
    for k, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[i : i + n]), set()).add(k)
    return out


@pytest.mark.parametrize("shard", [1_000_000, 20])
def test_contamination_matches_brute_force(docs, rows, bench, shard):
    wins = windows_of([(r["item_id"], r["text"]) for r in bench.collect()])
    want = []
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r[1]))
        hit, items = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[k]
        want.append((str(r[0]), len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    got = decontaminate.contamination(docs, bench, shard_words=shard).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got) == sorted(want)
    assert any(x[2] for x in want)


def test_decontaminate_cuts_spans_and_drops_covered(spark, bench, empty):
    item = bench.where("item_id = 5").first()["text"]
    df = spark.createDataFrame([(1, f"Clean start, {item} and a clean end of the text that goes on for quite some words more."), (2, item), (3, "nothing here"), (4, None)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {1: "Clean start,  and a clean end of the text that goes on for quite some words more.", 3: "nothing here", 4: None}
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


# 6. Mixing


def targets_of(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs, rows, empty):
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets_of(sizes)
    got = mixing.mix(docs.withColumn("size", F.lit("clash")), columns=["source"]).collect()
    taken: Counter = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = 9000
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.withColumn("size", F.lit("clash")).repartition(7), columns=["source"]).collect()))
    assert len(got) == len(rows) and mixing.mix(empty).count() == 0


def test_mix_is_close_and_unequal_odds_count(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), (F.col("id") % 4 + 1).alias("odds"))
    got = mixing.mix(df, columns=["source", "odds"]).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 30 for r in got)
    by = {r["odds"]: r["c"] for r in mixing.mix(df, odds_col="odds", columns=["odds"]).groupBy("odds").agg(F.avg("copies").alias("c")).collect()}
    assert by[1] < by[3] and by[2] < by[4]  # of each source


# 7. Pitman-Yor


@pytest.mark.parametrize("parts", [None, 7])
def test_pitman_yor_counts_and_probabilities(docs, rows, empty, parts):
    train: Counter = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    for r in rows:
        if learns(r[0]):
            train.update(tokens(r[1]))
    n, v = sum(train.values()), len(train)
    got = sorted(pitman_yor.score(docs, parts=parts).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
    want = sorted(((str(r[0]), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(r[1])), not learns(r[0]), len(tokens(r[1])), sum(train[w] > 0 for w in tokens(r[1]))) for r in rows), key=lambda r: r[:2])
    for a, b in zip(got, want, strict=True):
        assert (str(a["doc_id"]), a["held_out"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b[0], *b[2:], n)
        assert a["base_score"] == pytest.approx(b[1]) and a["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert pitman_yor.score(empty).count() == 0


def test_pitman_yor_prefers_what_it_saw(spark):
    """"a b" ends every training text: P(a) is near 1, P(b after a) 3/5 and P(end after b) 1/3. Unseen pairs fall to the parent."""
    learns = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = {"seen": "a b", "new": "a a", "unknown": "a zz", "empty": ""}
    df = spark.createDataFrame([(i, "a b a c a b a d a b") for i in learns] + list(zip(held, probes.values(), strict=False)), "doc_id long, text string")
    by_id = {r["doc_id"]: r["score"] for r in pitman_yor.score(df).collect()}
    got = dict(zip(probes, (by_id[h] for h in held), strict=False))
    assert got["seen"] == pytest.approx(math.log10(3 / 5 / 3), abs=0.1) and max(got["new"], got["unknown"]) < -2.5 and all(x < 0 for x in got.values())
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score(df.repartition(6), parts=1).collect()}
    assert all(again[k] == pytest.approx(v) for k, v in by_id.items())
    # Other blocks and shards draw other numbers; of what training settles little changes.
    apart = {r["doc_id"]: r["score"] for r in pitman_yor.score(df, parts=6).collect()}
    assert all(abs(apart[k] - v) < 0.15 * max(1, abs(v)) for k, v in by_id.items())


def test_word_hashes_split_as_bytes_do():
    data = b"  Ab\tcd\n\x0b ab\xc3\xa9 x" + b"y" * 300
    starts, h = pitman_yor.word_hashes(data)
    assert len(starts) == len(data.split()) and len(set(h.tolist())) == 4
    assert pitman_yor.word_hashes(b"cd")[1][0] == h[1] and len(pitman_yor.word_hashes(b" \n")[0]) == 0


def test_gibbs_keeps_counts():
    where = np.array([0, 0, 1, 1, 1])
    seats = pitman_yor.Restaurants(where, np.array([5, 1, 9, 0, 2]), 0.8, 2.0, 6)
    for s in range(2):
        seats.sweep(np.full(len(seats.moving), 0.2), np.random.default_rng(s), 3)
    assert seats.sizes.sum(axis=1).tolist() == [5, 9, 2] and ((seats.sizes > 0).sum(axis=1) == seats.tables[seats.moving]).all()
    assert seats.table_total.tolist() == [seats.tables[:2].sum(), seats.tables[2:].sum()] and (seats.tables <= seats.customers).all()


@pytest.mark.parametrize(("at_once", "c"), [(1024, 6), (1024, 20), (1, 6)])
def test_seating_draws_every_customer(monkeypatch, at_once, c):
    """Table counts of a dish's customers against the recursion of the restaurant, at once and one by one."""
    monkeypatch.setattr(pitman_yor, "AT_ONCE", at_once)
    d, s, p, n = 0.8, 2.0, 0.3, 4000
    odds = {1: 1.0}
    for i in range(1, c):
        odds = {t: odds.get(t, 0) * (i - d * t) + odds.get(t - 1, 0) * (s + d * (t - 1)) * p for t in range(1, i + 2)}
    seats = pitman_yor.Seating(np.arange(n), np.full(n, c), d, s, n)
    rng = np.random.default_rng(1)
    for _ in range(12):
        seats.sweep(np.full(n, p), rng)
    got = np.bincount(seats.tables, minlength=c + 1)[1:] / n
    assert got == pytest.approx([odds[t] / sum(odds.values()) for t in range(1, c + 1)], abs=0.03)
    assert (seats.table_total == seats.tables).all()


def test_parent_goes_on_and_has_no_cap():
    """Three moves a step from one table left about one table a word; a word whose customers fall to two has two at most."""
    v, count = 50, np.full(50, 1500, dtype=np.uint32)
    table = pitman_yor._messages([(0, 0, 0, pitman_yor._pack(np.arange(1, v + 1, dtype=np.uint64), count))])
    n = [count, np.full(v, 500, dtype=np.uint32), np.where(np.arange(v) < 5, 2, 1600).astype(np.uint32)]
    messages = {0: [(0, (np.arange(v, dtype=np.uint32), n[0], np.ones(v, dtype=bool)))], 1: [(0, (n[1],))], 2: [(0, (n[2],))]}
    tables = []
    for step in range(3):
        seats, mass, totals, _, _ = pitman_yor.Shard(table, 0).parent(step, messages)
        messages[pitman_yor.SHARD_STATE + step] = [(0, (seats.customers.astype(np.uint32), *seats.state(), mass, totals))]
        tables.append((n[step] - mass) / pitman_yor.PARENT_DISCOUNT)
        assert (seats.tables == np.round(tables[-1])).all()
    assert tables[0].mean() > 1.4 and all(t[5:].mean() > 2 for t in tables[1:]) and max(t.max() for t in tables) > 4 and tables[2][:5].max() < 2.01
    assert all((t > 0.99).all() and (t <= x + 0.01).all() for t, x in zip(tables, n, strict=True))


def test_seating_goes_on_from_its_state():
    where, customers = np.array([0, 0, 1, 1, 1]), np.array([5, 1, 3000, 0, 1030])
    make = lambda: pitman_yor.Seating(where, customers, 0.8, 2.0, 2)
    seats, again = make(), make()
    seats.sweep(np.full(3, 0.2), np.random.default_rng(0))
    again.restore(*seats.state())
    assert again.tables.tolist() == seats.tables.tolist() and again.table_total.tolist() == seats.table_total.tolist()
    assert sorted(again.seats[2].size) == sorted(n for n in seats.seats[2].size if n) and len(again.seats[2].at) == 3000


def test_pitman_yor_does_not_depend_on_blocks_for_unknown_words(spark):
    """"a zz" and "a b": the unknown word's probability is what "a" leaves to the parent, whether "a b" is in its block or not."""
    learns = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a b a c a b a d a b") for i in learns]
    score = lambda parts, *more: {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows + list(more), "doc_id long, text string").coalesce(1), parts=parts).collect()}
    together, alone = score(1, (held[0], "a zz"))[held[0]], score(64, (held[0], "a zz"))[held[0]]
    assert alone == pytest.approx(together, abs=0.15)


# 8 and 9. Classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(500):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = rng.choice(words, 40).tolist()
        if bad:
            w = [x + "$$$" for x in w]
        if toxic:
            w[7] = ["idiot", "moron"][i % 2]
        docs.append((i, " ".join(w)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None), (901, ""), (902, "w1 " * 30000), (None, "w1 w2")]
    labels += [(900, None, None), (None, 1, 0), (7777, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_from_text(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in held) / len(held) > 0.95
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == 504


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in quality.score_quality(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_toxicity_grades(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r["severity"] for r in toxicity.grade(docs, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(500)) and got[900] < 0.5 and got[902] < 0.5
    assert {r["severity"] for r in toxicity.grade(docs.limit(3), labels.limit(0)).collect()} == {0.0}
    assert toxicity.grade(docs.limit(0), labels).count() == 0


def test_ordinal_thresholds_rise():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    model = toxicity.OrdinalModel([np.array([10 + g]) if rng.random() < 0.9 else np.array([50]) for g in y], y)
    assert model.thresholds[0] < model.thresholds[1]
    assert [round(model.expected(np.array([10 + g]))) for g in range(3)] == [0, 1, 2]


def test_labels_held_out_are_never_learned_from(labelled):
    docs, labels = labelled
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turned = lambda n, c: labels.withColumn(c, F.when(key % n == 1, 1 - F.col(c)).otherwise(F.col(c)))
    score = lambda x: {r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()}
    assert score(labels) == score(turned(3, "quality"))
    grade = lambda x: {r["doc_id"]: r["severity"] for r in toxicity.grade(docs, x).collect()}
    assert grade(labels) == grade(turned(5, "toxic"))


def test_repeated_rows_and_clashing_names_in_the_classifiers(labelled):
    docs, labels = labelled
    extra = docs.unionByName(docs.where("doc_id < 3")).withColumns({c: F.lit("clash") for c in ("y", "id", "t", "b", "x", "quality", "toxic", "severity", "held_out", "__id")})
    a = quality.score_quality(extra, labels)
    assert a.count() == docs.count() + 3 and set(a.columns) == set(extra.columns)
    twice: dict = {}
    for r in a.where("doc_id < 3").collect():
        twice.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
    assert all(len(x) == 1 for x in twice.values())
    b = toxicity.grade(extra, labels)
    assert b.count() == docs.count() + 3 and b.where("doc_id < 3").select("doc_id", "severity").distinct().count() == 3


def test_two_grades_are_spread_to_three():
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.3).astype(int)
    rows = [np.unique(np.concatenate((rng.integers(100, 900, 12), rng.choice([1, 2, 3, 4], rng.integers(1, 5), replace=False) if g else []))).astype(np.int64) for g in y]
    model = toxicity.OrdinalModel(rows, y, spread=True)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1] and model.grades.tolist() == [0, 1, 2]
    mean = lambda ids: model.expected(np.array(ids))
    assert mean([200, 300]) < 0.5 < mean([1, 200]) < mean([1, 2, 3, 4])


# 10. URL filters


def test_url_filter_is_as_of_the_fetch(spark):
    ts = lambda d: f"2024-{d} 00:00:00"
    entries = spark.createDataFrame([("l", "domain", "bad.com", "add", ts("02-01")), ("l", "domain", "bad.com", "remove", ts("03-01")), ("l", "domain", "bad.com", "add", ts("04-01")), ("l", "domain", "bad.com", "add", ts("05-01")), ("m", "url", "x.org/a?b", "add", ts("01-01")), ("m", "prefix", "y.org/p", "add", ts("01-01")), ("m", "domain", "z.org", "add", ts("01-01")), ("m", "domain", "z.org", "remove", ts("01-01")), (None, "domain", "q.org", "add", ts("01-01"))], "list string, kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    seen = [(1, "http://bad.com/", "01-15"), (2, "http://Sub.Bad.com:80/x#f", "02-01"), (3, "http://bad.com/", "03-01"), (4, "http://bad.com/", "12-01"), (5, "https://x.org/a?b#c", "06-01"), (6, "https://x.org/a", "06-01"), (7, "http://y.org/p/q", "06-01"), (8, "http://y.org/pp", "06-01"), (9, None, "06-01"), (10, "not a url", "06-01"), (11, "http://z.org", "06-01"), (12, "http://notbad.com/", "02-15"), (13, "http://q.org", "06-01"), (1, "http://bad.com/", "02-15")]
    captures = spark.createDataFrame([(i, u, ts(d)) for i, u, d in seen] + [(14, "http://bad.com/", None)], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("held", F.lit(1))
    out = urlfilter.filter_urls(captures, entries)
    assert sorted((r["page_id"], r["lists"]) for r in out.where("blocked").collect()) == [(1, "l"), (2, "l"), (4, "l"), (5, "m"), (7, "m")]
    assert out.count() == 15 and urlfilter.filter_urls(captures.limit(0), entries).count() == 0
    assert urlfilter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


def test_url_filter_hosts_and_clashing_names(spark):
    entries = spark.createDataFrame([("l", "domain", "bad.com", "add", "2024-01-01 00:00:00"), ("l", "domain", "[::1]", "add", "2024-01-01 00:00:00")], "list string, kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    seen = [(1, "http://bad.com./x"), (2, "http://[::1]:80/"), (3, "http://ok.com/" + "x" * 200_000), (4, "")]
    captures = spark.createDataFrame(seen, "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")).withColumns({c: F.lit("clash") for c in ("host", "lists", "n_active", "blocked", "row", "at", "held", "active", "prefix_key", "by_host")})
    out = urlfilter.filter_urls(captures, entries)
    assert len(out.columns) == len(set(out.columns)) and set(captures.columns) <= set(out.columns)
    assert {r["page_id"]: (r["host"], r["blocked"], r["row"]) for r in out.collect()} == {1: ("bad.com", True, "clash"), 2: ("[::1]", True, "clash"), 3: ("ok.com", False, "clash"), 4: (None, False, "clash")}


def test_ids_of_any_type_and_clashing_names(docs, bench):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumns({c: F.lit("clash") for c in ("target", "spans", "items", "cell", "copies", "size", "taken", "source_size", "rank", "b", "id", "__keep", "__keep0", "sid", "root", "held_out", "n_words")})
    n = docs.count()
    assert suffix.repeats(named).count() == pitman_yor.score(named).count() == simhash.simhash_components(named).count() == decontaminate.contamination(named, bench).count() == n
    for out in (suffix.cut_repeats(named), simhash.simhash_dedup(named), simhash.near_dedup(named), decontaminate.decontaminate(named, bench)):
        assert out.columns == named.columns and out.where("doc_id = 'd100'").count() <= 1
    mixed = mixing.mix(named, columns=[c for c in named.columns if c not in ("doc_id", "text")])
    assert mixed.count() == n and len(mixed.columns) == len(set(mixed.columns))
