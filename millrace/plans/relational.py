"""The relational surface on the star schema, and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


def tpch_pricing_summary(spark, sf_dir):
    (l,) = _t(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def tpch_shipping_priority(spark, sf_dir):
    c, o, l = _t(spark, sf_dir, "customer", "orders", "lineitem")
    joined = c.where("c_mktsegment = 'BUILDING'").join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.col("revenue").desc(), "o_orderkey").limit(10)


def tpch_local_supplier(spark, sf_dir):
    c, o, l, s, n, r = _t(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "region")
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    named = joined.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def tpch_forecast(spark, sf_dir):
    (l,) = _t(spark, sf_dir, "lineitem")
    return l.where("l_discount between 0.05 and 0.07 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))


def join_left_counts(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("spent"))


def join_semi(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def join_anti(spark, sf_dir):
    """Customers without a large order."""
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def join_full(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier", "customer")
    a = s.groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    b = c.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n_rich"))
    return a.join(b, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "n_suppliers", "n_rich")


def join_regroup(spark, sf_dir):
    """Explode, look up, regroup in order: the order lines' part names by line number, with found and missing counts."""
    l, p = _t(spark, sf_dir, "lineitem", "part")
    found = l.join(p.where("p_size <= 25").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    packed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.coalesce("p_name", F.lit("")).alias("name"))))
    return found.groupBy("l_orderkey").agg(F.array_join(F.transform(packed, lambda x: x["name"]), "|").alias("names"), F.count("p_name").alias("num_found"), F.count_if(F.col("p_name").isNull()).alias("num_missing"))


def join_as_of(spark, sf_dir):
    """Each purchase with its user's latest event of another type before it: a union and a running last value."""
    (e,) = _t(spark, sf_dir, "events")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type") == "purchase"
    held = e.withColumn("prior", F.last(F.when(~kind, F.col("event_id")), ignorenulls=True).over(line))
    return held.where(kind).select("event_id", "user_id", "prior")


def join_range(spark, sf_dir):
    """Orders in half-open price bands: a join by the bucket of the price, then the exact bounds."""
    (o,) = _t(spark, sf_dir, "orders")
    bands = o.sparkSession.range(0, 40).select(F.col("id").alias("band"), (F.col("id") * 15000).alias("lo"), ((F.col("id") + 1) * 15000).alias("hi"))
    keyed = bands.select("*", F.explode(F.sequence(F.floor(F.col("lo") / 10000), F.floor((F.col("hi") - 1) / 10000))).alias("slot"))
    return o.withColumn("slot", F.floor(F.col("o_totalprice") / 10000)).join(keyed, "slot").where("o_totalprice >= lo and o_totalprice < hi").groupBy("band").agg(F.count("*").alias("n"))


def set_operations(spark, sf_dir):
    c, s, o = _t(spark, sf_dir, "customer", "supplier", "orders")
    a = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tagged = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tagged(a.intersect(b), "both").unionByName(tagged(a.exceptAll(b).distinct(), "left_all")).unionByName(tagged(a.select("k").subtract(b), "left")).unionByName(tagged(a.union(b).distinct(), "any"))


def set_disjoint(spark, sf_dir):
    """Whether the hash split's two sides share an id, and their sizes: one aggregate over the ids of both."""
    (d,) = _t(spark, sf_dir, "documents")
    side = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 6), 16, 10).cast("long") % 10 == 0
    sides = d.select("doc_id", side.alias("a")).groupBy("doc_id").agg(F.max("a").alias("in_a"), F.max(~F.col("a")).alias("in_b"))
    return sides.agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))


def win_top_per_group(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    line = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(line)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def win_running(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = line.rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(rows), 2).alias("running"), F.lag("o_orderkey").over(line).alias("before"), F.lead("o_orderkey").over(line).alias("after"), F.ntile(4).over(line).alias("quarter"), F.round(F.percent_rank().over(line), 9).alias("pct"))


def win_islands(spark, sf_dir):
    """Runs of one event type in each user's stream: gaps and islands."""
    (e,) = _t(spark, sf_dir, "events")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(line)), 0).otherwise(1)
    held = e.withColumn("new", new).withColumn("island", F.sum("new").over(line))
    runs = held.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("length"))
    return runs.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"))


def win_offsets(spark, sf_dir):
    """Cumulative offsets of the order lines, as packed sequences start."""
    (l,) = _t(spark, sf_dir, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum("l_quantity").over(line), F.lit(0.0)).alias("starts"))


def agg_rollup(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


def agg_cube(spark, sf_dir):
    (l,) = _t(spark, sf_dir, "lineitem")
    return l.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.grouping_id().cast("int").alias("level"))


def agg_pivot(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def agg_statistics(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("std"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.countDistinct("o_custkey").alias("n_customers"))


def event_tumbling(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sliding(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users")).select(F.col("w.start").alias("start"), "n", "n_users")


def event_session(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def event_json(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def meta_json(spark, sf_dir):
    """Every column but the key folded into one JSON column, and a field read back from it."""
    (c,) = _t(spark, sf_dir, "customer")
    rest = F.to_json(F.struct("c_nationkey", "c_mktsegment"))
    return c.select("c_custkey", F.get_json_object(rest, "$.c_mktsegment").alias("segment"), F.get_json_object(rest, "$.c_nationkey").cast("int").alias("nation"))


def timestamps(spark, sf_dir):
    """Frame numbers at 30 a second as minutes and seconds."""
    (e,) = _t(spark, sf_dir, "events")
    seconds = F.floor(F.col("event_id") / 30)
    return e.select("event_id", F.format_string("%02d:%02d", F.floor(seconds / 60), F.pmod(seconds, F.lit(60))).alias("mmss"))


QUERIES = {f.__name__: f for f in (tpch_pricing_summary, tpch_shipping_priority, tpch_local_supplier, tpch_forecast, join_left_counts, join_semi, join_anti, join_full, join_regroup, join_as_of, join_range, set_operations, set_disjoint, win_top_per_group, win_running, win_islands, win_offsets, agg_rollup, agg_cube, agg_pivot, agg_statistics, event_tumbling, event_sliding, event_session, event_json, meta_json, timestamps)}

_NET = "l_extendedprice * (1 - l_discount)"

SQL = {
    "tpch_pricing_summary": f"select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum({_NET}), 2) as sum_net, round(sum({_NET} * (1 + l_tax)), 2) as sum_charge, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "tpch_shipping_priority": f"select o_orderkey, o_orderdate, round(sum({_NET}), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by 1, 2 order by revenue desc, o_orderkey limit 10",
    "tpch_local_supplier": f"select r_name, n_name, round(sum({_NET}), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "tpch_forecast": "select round(sum(l_extendedprice * l_discount), 2) as revenue, count(*) as n from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "join_left_counts": "select c_custkey, count(o_orderkey) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as spent from customer left join orders on c_custkey = o_custkey group by 1",
    "join_semi": "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)",
    "set_disjoint": "with s as (select distinct doc_id, ('0x' || substr(sha256(doc_id::varchar), 1, 6))::bigint % 10 = 0 as a from documents) select count(*) filter (where a) as n_a, count(*) filter (where not a) as n_b, count(*) - count(distinct doc_id) as n_both from s",
    "join_anti": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)",
    "join_full": "select coalesce(s_nationkey, c_nationkey) as nation, n_suppliers, n_rich from (select s_nationkey, count(*) as n_suppliers from supplier group by 1) full join (select c_nationkey, count(*) as n_rich from customer where c_acctbal > 9000 group by 1) on s_nationkey = c_nationkey",
    "join_regroup": "select l_orderkey, string_agg(coalesce(p_name, ''), '|' order by l_linenumber, l_partkey) as names, count(p_name) as num_found, count(*) - count(p_name) as num_missing from lineitem left join (select * from part where p_size <= 25) on l_partkey = p_partkey group by 1",
    "join_as_of": "select event_id, user_id, prior from (select *, last_value(case when event_type <> 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as prior from events) where event_type = 'purchase'",
    "join_range": "select floor(o_totalprice / 15000)::bigint as band, count(*) as n from orders where o_totalprice < 600000 group by 1",
    "set_operations": "with a as (select c_nationkey as k from customer where c_acctbal > 5000), b as (select s_nationkey as k from supplier where s_acctbal > 5000) select 'both' as op, k from (select k from a intersect select k from b) union all select 'left_all', k from (select distinct k from (select k from a except all select k from b)) union all select 'left', k from (select k from a except select k from b) union all select 'any', k from (select k from a union select k from b)",
    "win_top_per_group": "select o_custkey, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3",
    "win_running": "select o_orderkey, round(sum(o_totalprice) over (w rows between unbounded preceding and current row), 2) as running, lag(o_orderkey) over w as before, lead(o_orderkey) over w as after, ntile(4) over w as quarter, round(percent_rank() over w, 9) as pct from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "win_islands": "with n as (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from events), i as (select *, sum(new) over (partition by user_id order by ts, event_id) as island from n), r as (select user_id, island, count(*) as length from i group by 1, 2) select user_id, count(*) as n_runs, max(length) as longest from r group by 1",
    "win_offsets": "select l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0)::double as starts from lineitem",
    "agg_rollup": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, grouping_id(o_orderstatus, o_orderpriority)::int as level from orders group by rollup(o_orderstatus, o_orderpriority)",
    "agg_cube": "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as n_suppliers, grouping_id(l_returnflag, l_linestatus)::int as level from lineitem group by cube(l_returnflag, l_linestatus)",
    "agg_pivot": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by 1",
    "agg_statistics": "select o_orderstatus, round(stddev_pop(o_totalprice), 4) as std, round(quantile_cont(o_totalprice, 0.5), 4) as median, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest, count(distinct o_custkey) as n_customers from orders group by 1",
    "event_tumbling": "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sliding": "with w as (select unnest([time_bucket(interval '1 day', ts, timestamp '1970-01-01'), time_bucket(interval '1 day', ts, timestamp '1970-01-01') - interval 1 day]) as start, user_id from events) select start, count(*) as n, count(distinct user_id) as n_users from w group by 1",
    "event_session": "with n as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '4 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from n) select user_id, min(ts) as start, max(ts) + interval '4 hours' as stop, count(*) as n from s group by user_id, s.s",
    "event_json": "select event_type, count(k) as n, sum(k)::bigint as total, max(k) as most from (select event_type, json_extract(props, '$.k')::int as k from events) group by 1",
    "meta_json": "select c_custkey, c_mktsegment as segment, c_nationkey as nation from customer",
    "timestamps": "select event_id, printf('%02d:%02d', event_id // 30 // 60, (event_id // 30) % 60) as mmss from events",
}
