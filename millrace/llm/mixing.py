"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: all words are shared out by
weight, a source stops at ``max_copies`` times its own words, and the excess is
shared again (a closed form over the sources sorted by cap per weight). Within
a source the target is shared in the same way among classes of documents with
like odds, by their words times their odds. A document is then expected
``e = target / words`` of its class times, at most ``max_copies``. ``floor(e)``
whole copies are certain; the fractional part is its inclusion probability in
a Pareto order sample: with u uniform from the document's id, documents rank
by ``u/(1-u)`` divided by ``p/(1-p)``, and the lowest ranks are taken for as
long as their words stay within those still wanted; of the documents beyond,
the one whose size is nearest to what is then missing comes too, if that
brings the source nearer to its target. The same ids give the same mix.

Odds are the quality or preference that ``odds_col`` holds, or by default the
fourth root of one over the size's power of two: longer documents, of which few
fill a source, are repeated a little less. Odds are rounded to an eighth of an
octave, so classes are few.

Ranks are cut without sorting a source in one task: words are summed in
``BINS`` bins of the rank, and only the bin in which the cut falls is sorted.

Defined results: a null text has size 0 and takes nothing; null is a source of
its own, the last; a source without words has target 0; odds that are null,
not positive or not finite count as the least odds of all; repeated rows count
each; with an empty table the result is empty. Columns of the input that are
carried along keep their names, but for those of the results, which replace
them; all others are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_small, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BINS = 4096
#: Sources (and classes of documents in them) up to this number are broadcast (a few MB); beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ["doc_id", "size", "source_size", "target", "taken", "copies"]
#: Odds lie in classes of an eighth of an octave, from 2 ** -LEAST_CLASS / 8 on.
LEAST_CLASS = 800


def _filled(rows: DataFrame, within: list[str], total, weight: str, cap: str, order) -> DataFrame:
    """``rows`` with ``share``: ``total`` shared among the rows of ``within`` by weight, none above its cap."""
    zero = F.lit(0.0)
    per = F.col(cap) / F.nullif(F.col(weight), zero)
    line = Window.partitionBy(*within).orderBy(per.asc_nulls_last(), order)
    every = Window.partitionBy(*within)
    level = (total - (F.sum(cap).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col(cap))) / F.nullif(F.sum(weight).over(line.rowsBetween(0, Window.unboundedFollowing)), zero)
    levelled = rows.withColumn("__level", level)
    # The first row, in order of cap per weight, that the level doesn't fill sets the level of all.
    final = F.min(F.when(F.col("__level") <= per, F.struct(per.alias("o"), F.col("__level").alias("v")))).over(every)["v"]
    out = levelled.withColumn("__final", final)
    return out.withColumn("share", F.when(F.col("__final").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("__final") * F.col(weight)))).drop("__level", "__final")


def _targets(sizes: DataFrame, weights, max_copies: int) -> DataFrame:
    """(source, source_size, target) of each source, in words: one row a source, however many documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int")))
    weighed = weighed.withColumn("cap", max_copies * F.col("source_size").cast("double"))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    return _filled(weighed, [], total, "w", "cap", F.col("source").asc_nulls_last()).select("source", "source_size", F.col("share").alias("target"))


def uniform(id_col: str, seed: int = 0):
    """A number in (0, 1) from the id alone: 52 bits of SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def odds_class(odds):
    """The class of these odds: eighths of an octave, rounded."""
    fit = odds.isNotNull() & (odds > 0) & (odds < float("inf"))
    return F.when(fit, F.greatest(F.round(8 * F.log2(odds)), F.lit(-LEAST_CLASS))).otherwise(F.lit(-LEAST_CLASS)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_copies: int = MAX_COPIES, odds_col: str | None = None, seed: int = 0, columns=()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies, and ``columns``.

    ``odds_col`` gives documents unequal odds (a quality score, say): the
    expected copies of a source's documents are in proportion to them, up to
    ``max_copies``.
    """
    columns = [c for c in columns if c not in RESULTS]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # The power of two of a size is the number of its binary digits less one; a quarter octave is two classes.
    kind = odds_class(F.col(odds_col).cast("double")) if odds_col else -2 * (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), kind.cast("int").alias("kind"), uniform(id_col, seed).alias("u"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = materialize(rows, "sized")  # texts are read and counted once
    classes = rows.groupBy("source", "kind").agg(F.sum("size").alias("mass"))
    classes = materialize(classes, "classes")
    held = F.broadcast if is_small(classes, BROADCAST_SOURCES) else (lambda x: x)
    sizes = classes.groupBy("source").agg(F.sum("mass").alias("source_size"))
    totals = _targets(sizes, weights, max_copies)
    shared = classes.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shared = shared.withColumn("cap", max_copies * F.col("mass").cast("double")).withColumn("w", F.col("mass") * F.pow(F.lit(2.0), F.col("kind") / 8.0))
    shared = _filled(shared, ["source"], F.col("target"), "w", "cap", F.col("kind"))
    expected = F.when(F.col("mass") > 0, F.least(F.col("share") / F.col("mass"), F.lit(float(max_copies)))).otherwise(0.0)
    shared = materialize(shared.select(F.col("source").alias("s"), F.col("kind").alias("k"), "source_size", "target", expected.alias("e")), "shares")
    joined = rows.join(held(shared), F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k"))).drop("s", "k")

    joined = joined.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = joined.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rank)).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))

    # Words still wanted after the whole copies, by source; words by bin; the bin in which they run out.
    wanted = drawn.groupBy("source").agg(F.round(F.first("target") - F.sum(F.col("whole") * F.col("size")), 3).alias("want"))
    in_bin = drawn.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    line = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = in_bin.withColumn("upto", F.sum("words").over(line)).withColumnRenamed("source", "s")
    cut = wanted.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cut = cut.groupBy("source", "want").agg(F.min(F.when(F.col("upto") > F.col("want"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("c"))
    cut = materialize(cut.select(F.col("source").alias("s"), "want", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("before")), "cuts")
    drawn = drawn.join(held(cut), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    at_cut = F.col("bin").eqNullSafe(F.col("cut_bin"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = drawn.where(F.col("bin").isNotNull() & at_cut).withColumn("upto", F.col("before") + F.sum("size").over(order))
    edge = edge.withColumn("extra", (F.col("upto") <= F.col("want")).cast("long"))
    # What the cut leaves missing, and the document beyond it that fills that best: one row a source.
    left = edge.groupBy("source").agg(F.first("want").alias("w"), F.coalesce(F.max(F.when(F.col("extra") == 1, F.col("upto"))), F.first("before")).alias("got"))
    left = held(left.select(F.col("source").alias("s"), (F.col("w") - F.col("got")).alias("missing")))
    beyond = drawn.where(F.col("bin") > F.col("cut_bin")).select("source", "size", "rank", "doc_id").unionByName(edge.where("extra = 0").select("source", "size", "rank", "doc_id"))
    off = F.abs(F.col("size") - F.col("missing"))
    fits = beyond.join(left, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("missing"))
    pick = fits.groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))).alias("f"))
    pick = materialize(pick.select(F.col("source").alias("s"), F.col("f.rank").alias("f_rank"), F.col("f.doc_id").alias("f_id"), F.col("f.size").alias("f_size")), "picked")

    rest = drawn.where(F.col("bin").isNull() | ~at_cut)
    rest = rest.withColumn("extra", F.coalesce(F.col("bin") < F.col("cut_bin"), F.col("bin").isNotNull() & F.col("want").isNotNull()).cast("long"))
    done = rest.unionByName(edge.drop("upto")).join(held(pick), F.col("source").eqNullSafe(F.col("s")), "left")
    # Of repeated rows one is as good as another: the first by any order is the one picked.
    is_pick = (F.col("extra") == 0) & (F.col("rank") == F.col("f_rank")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("size") == F.col("f_size"))
    done = done.withColumn("picked", F.coalesce(is_pick, F.lit(False)))
    first = Window.partitionBy("source").orderBy("doc_id")
    chosen = done.where("picked").withColumn("extra", (F.row_number().over(first) == 1).cast("long"))
    done = done.where("not picked").unionByName(chosen).withColumn("copies", F.col("whole") + F.col("extra"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col(f"__{c}").alias(c) for c in columns])


#: What ``mix`` computes with the default odds, in SQL: name the table of documents.
MIX_SQL = r"""
with sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(sha256('0:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from {docs}),
kinds as (select *, -2 * (length(bin(greatest(size, 1))) - 1) as kind from sized),
classes as (select source, kind, sum(size)::bigint as mass from kinds group by source, kind),
sources as (
  select source, sum(mass)::bigint as source_size, row_number() over (order by source asc nulls last) as i
  from classes group by source),
weighed as (
  select source, source_size, case (i - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w, 3.0::double * source_size as cap
  from sources),
levelled as (
  select *, (sum(source_size::double) over () - (sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and current row) - cap))
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
  from weighed),
final as (select level as v from levelled where level <= cap / w order by cap / w limit 1),
targets as (
  select source, source_size, case when (select v from final) is null then cap else least(cap, (select v from final) * w) end as target from levelled),
parts as (
  select c.source, c.kind, c.mass, t.source_size, t.target, 3.0::double * c.mass as cap, c.mass * pow(2.0::double, c.kind / 8.0) as w
  from classes c join targets t on c.source is not distinct from t.source),
part_levels as (
  select *, (target - (sum(cap) over (partition by source order by cap / nullif(w, 0) nulls last, kind rows between unbounded preceding and current row) - cap))
            / nullif(sum(w) over (partition by source order by cap / nullif(w, 0) nulls last, kind rows between current row and unbounded following), 0) as level
  from parts),
part_final as (select source, arg_min(level, cap / nullif(w, 0)) as v from part_levels where level <= cap / nullif(w, 0) group by source),
shares as (
  select p.*, case when mass > 0 then least((case when f.v is null then cap else least(cap, f.v * w) end) / mass, 3.0) else 0.0 end as e
  from part_levels p left join part_final f on p.source is not distinct from f.source),
ranked as (
  select d.*, s.source_size, s.target, floor(s.e) as whole, s.e - floor(s.e) as p,
         case when s.e > floor(s.e) and d.size > 0 then (u / (1 - u)) / ((s.e - floor(s.e)) / (1 - (s.e - floor(s.e)))) end as rank
  from kinds d join shares s on d.source is not distinct from s.source and d.kind = s.kind),
wanted as (select source, round(max(target) - sum(whole * size), 3) as want from ranked group by source),
summed as (
  select r.*, w.want, row_number() over (partition by r.source order by rank nulls last, doc_id, size) as n,
         sum(case when rank is not null then size else 0 end) over (partition by r.source order by rank nulls last, doc_id, size rows between unbounded preceding and current row) as upto
  from ranked r join wanted w on r.source is not distinct from w.source),
cut as (
  select *, coalesce(rank is not null and upto <= want, false) as taken_by_rank,
         want - coalesce(max(case when rank is not null and upto <= want then upto end) over (partition by source), 0) as missing
  from summed),
picked as (
  select *, row_number() over (partition by source, not taken_by_rank and rank is not null and abs(size - missing) < missing
                               order by abs(size - missing), rank, doc_id, size, n) as place from cut),
mixed as (
  select *, whole + case when taken_by_rank or (not taken_by_rank and rank is not null and abs(size - missing) < missing and place = 1) then 1 else 0 end as copies
  from picked)
"""
