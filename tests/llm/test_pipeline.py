"""The pipeline's stages one after another, and the registered queries on the smallest data set."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.common import table
from test_llm import repeats_of


def test_stages_take_effect(spark, data):
    docs = table(spark, data, "documents")
    n = docs.count()
    held = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, data)
        assert held.columns == docs.columns, name
        counts.append(held.count())
    assert n > counts[0] > counts[1] >= counts[2] >= counts[3] > 0.6 * n


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.where("copies < 1 or taken > copies * length(text)").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else str(v)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_its_whole_table(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    n = {"op2_warc": 2 * table(spark, data, "pages").count(), "op10_urlfilter": table(spark, data, "pages").count(), "op3_nearest": 5 * table(spark, data, "embeddings").where("vec_id % 50 = 0").count()}
    assert out.count() == n.get(name, table(spark, data, "documents").count())


def test_near_dedup_matches_brute_force_jaccard(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.choice(vocab, 200).tolist()
        for k in range(8):
            own = list(base)
            for at in rng.choice(200, k, replace=False):
                own[at] = "X" + str(at)
            texts.append(" ".join(own))
    texts += ["", " ", "one two", "One  two", *[" ".join(rng.choice(vocab, 60)) for _ in range(20)]]
    ids = rng.permutation(len(texts)).tolist()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for i, j in linked:
        root[find(i)] = find(j)
    want = {min(ids[k] for k in range(len(texts)) if find(k) == r) for r in {find(k) for k in range(len(texts))}}
    rows = spark.createDataFrame([*zip(ids, texts, strict=True), (None, texts[0])], "doc_id long, text string").repartition(3)
    out = [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, rows, "").collect()]
    assert out.count(None) == 1 and sorted(x for x in out if x is not None) == sorted(want)


def jaccard_classes(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_stages_match_brute_force(spark, tmp_path):
    """The second to the fourth stage on awkward rows, each against brute force on what it was given; the first's and the last's promises."""
    rng = np.random.default_rng(8)
    vocab = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    passage, item, base = say(60), say(12), say(80)
    texts = [say(int(rng.integers(20, 80))) for _ in range(60)] + [base, base, base.replace(base.split()[3], "zz", 1)] + [f"{say(30)} {passage} {say(30)}" for _ in range(4)] + [f"{say(40)} {item} {say(40)}", item, "", None, None, "\u00e9" * 150]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, base, "en", "s0", len(base)), (None, None, None, None, None), (3, texts[3], "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("y", "__score", "__keep", "copies", "size", "target", "taken", "id", "b", "spans")})
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (41, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    scored = stages["quality classifier"](spark, docs, at)
    assert scored.columns == docs.columns and scored.count() == len(rows)  # all labels are good
    near = stages["simhash near-dedup"](spark, scored, at)
    known = {r[0]: r[1] for r in rows if r[0] is not None}
    ids = sorted(known)
    classes = jaccard_classes([known[i] or "" for i in ids])
    want = sorted({ids[c] for c in classes})
    got = near.select("doc_id").collect()
    assert sorted(r[0] for r in got if r[0] is not None) == want and sum(r[0] is None for r in got) == 2 and near.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in near.select("doc_id", "text").collect()), key=str)
    cut = stages["suffix-array dedup"](spark, near, at)
    data = [(t or "").encode() for _, t in left]
    gone = repeats_of(data, 200)
    kept = [None if t is None else bytes(np.frombuffer(b, np.uint8)[~g]).decode(errors="ignore") for (_, t), b, g in zip(left, data, gone, strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted(((i, k) for (i, _), k in zip(left, kept, strict=True)), key=str)
    assert cut.columns == docs.columns and cut.where("text is not null and n_chars <> length(text)").count() == 0
    clean = stages["benchmark decontamination"](spark, cut, at)
    bad = item.split()
    out = {}
    for r in cut.collect():
        w = (r["text"] or "").split()
        hit = {j for i in range(len(w) - 9) for k in range(len(bad) - 9) if w[i : i + 10] == bad[k : k + 10] for j in range(i, i + 10)}
        if len(hit) <= 0.5 * len(w):
            out.setdefault(r["doc_id"], []).append([x for j, x in enumerate(w) if j not in hit])
    assert {i: sorted(x) for i, x in out.items()} == {i: sorted((r["text"] or "").split() for r in clean.collect() if r["doc_id"] == i) for i in out}
    assert clean.count() == sum(map(len, out.values())) < cut.count()
    mixed = stages["mixing to target weights"](spark, clean, at)
    assert mixed.where("copies < 1 or copies > 3").count() == 0 and len(mixed.columns) == len(set(mixed.columns)) and {"lang", "source", "id"} <= set(mixed.columns)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0, name
