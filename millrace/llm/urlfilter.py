"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: (list, kind, pattern, action, at), kind being
``domain`` (a host and all below it), ``prefix`` (host and first path segment)
or ``url`` (host and path with query). The entries of one pattern, in order of
time, become validity intervals: an ``add`` opens one, the next entry closes
it. Every capture is then evaluated against the intervals that hold its fetch
time, as of that time: later listings don't condemn earlier captures.

Patterns meet distinct hosts, not captures, so a host that has a third of all
captures is matched once. The intervals then join the captures by equality:
broadcast while they are at most ``BROADCAST_INTERVALS``, or else by a shuffle
join, which Spark can split where a host is hot. Entries of one list and
pattern at the same time: ``remove`` wins.

Hosts are compared without a final dot, in lower case; an IPv6 host keeps its
brackets. The intervals of one key travel with each of its captures as an
array: a key's log is meant to be short (100,000 entries take 4 MB).

Defined results: a null or unparsable url and a null fetch time match nothing
and stay with 0 active entries; entries with a null list, kind, pattern,
action or time are left out; repeated captures each get their row; urls are
read whole, however long; other columns are carried along, whatever their
names, but for those named as the results, which these replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Intervals (about 100 bytes each) up to which a side is broadcast.
BROADCAST_INTERVALS = 100_000

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^#]*)"
RESULTS = ["host", "n_active", "lists", "blocked"]


def url_keys(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, prefix_key and url_key; null where the url doesn't parse."""
    part = lambda i: F.regexp_extract(F.col(url_col), URL, i)
    host = F.nullif(F.rtrim(F.lower(part(1)), F.lit(".")), F.lit(""))
    path = F.when(part(2) == "", "/").otherwise(part(2))
    first = F.regexp_extract(path, "^/([^/?]*)", 1)
    return captures.withColumns({"host": host, "prefix_key": F.concat(host, F.lit("/"), first), "url_key": F.concat(host, path)})


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of the dated entries; valid_to is exclusive, null while open."""
    known = entries.dropna(subset=["list", "kind", "pattern", "action", "at"])
    one = known.groupBy("list", "kind", "pattern", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    line = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    held = one.withColumns({"valid_to": F.lead("at").over(line), "before": F.lag("gone").over(line)})
    # Entries that repeat an open listing extend it: number the runs and merge them.
    held = held.withColumn("run", F.sum(F.when((F.col("gone") == 1) | F.coalesce(F.col("before") == 1, F.lit(True)), 1).otherwise(0)).over(line))
    merged = held.where("gone = 0").groupBy("list", "kind", "pattern", "run").agg(F.min("at").alias("valid_from"), F.max(F.struct("at", "valid_to"))["valid_to"].alias("valid_to"))
    return merged.select("list", "kind", "pattern", "valid_from", "valid_to")


def _packed(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.collect_set(F.struct("list", "pattern", "valid_from", "valid_to")).alias("held"))


def _with(captures: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``captures`` with their rules by key, where there are any."""
    rules = materialize(rules, key)
    n = rules.agg(F.sum(F.size("held"))).first()[0] or 0
    rules = rules.withColumnRenamed("held", f"by_{key}")
    return captures.join(F.broadcast(rules) if n <= BROADCAST_INTERVALS else rules, key, "left")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_active (entries in force at the fetch), lists (their names, sorted, comma-joined) and blocked."""
    kept = [c for c in captures.columns if c not in RESULTS]
    listed = materialize(intervals(entries), "intervals")
    # The capture goes along as one column, so no name of its own meets those made here.
    rows = captures.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), F.col(at_col).alias("at"))
    keyed = url_keys(rows)
    hosts = keyed.where("host is not null").select("host").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("pattern"))
    joined = _with(keyed, _packed(above.join(listed.where("kind = 'domain'"), "pattern"), "host"), "host")
    for kind, key in (("prefix", "prefix_key"), ("url", "url_key")):
        joined = _with(joined, _packed(listed.where(F.col("kind") == kind).withColumn(key, F.col("pattern")), key), key)
    none = F.array().cast("array<struct<list:string,pattern:string,valid_from:timestamp,valid_to:timestamp>>")
    every = F.concat(*[F.coalesce(F.col(c), none) for c in ("by_host", "by_prefix_key", "by_url_key")])
    at = F.col("at")
    active = F.filter(every, lambda x: (x["valid_from"] <= at) & (x["valid_to"].isNull() | (at < x["valid_to"])))
    out = joined.withColumn("active", active)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", F.size("active").cast("long").alias("n_active"), F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda x: x["list"]))), ",").alias("lists"), (F.size("active") > 0).alias("blocked"))


def fetch_time():
    """One noon of 2024 from the page id, as ``pages`` has no fetch time."""
    return F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id, 366) as int), 12)")


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``."""
    return pages.select("page_id", "url", fetch_time().alias("fetched_at"))


def feed_from(pages: DataFrame) -> DataFrame:
    """A dated feed over what occurs in ``pages``, in place of published lists: see ``FEED_SQL``."""
    keyed = url_keys(pages.select("url"))
    code = F.conv(F.substring(F.sha2("pattern", 256), 1, 6), 16, 10).cast("long")
    kinds = [("domain", "regexp_extract(host, '^[^.]*[.](.*)$', 1)", 3), ("domain", "host", 5), ("prefix", "prefix_key", 7), ("url", "url_key", 11)]
    named = F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"), F.lit(share).alias("share")) for kind, pattern, share in kinds])
    each = keyed.select(F.explode(named).alias("x")).select("x.kind", "x.pattern", "x.share").where("pattern <> ''").distinct()
    found = each.withColumn("code", code).where("code % share = 0").select("kind", "pattern", "code").distinct()
    start = "timestamp'2024-01-01 00:00:00'"
    events = [("add", "code % 300", "true"), ("remove", "code % 300 + 20 + code % 41", "code % 2 = 0"), ("add", "code % 300 + 90", "code % 4 = 0"), ("add", "code % 300 + 100", "code % 8 = 0")]
    list_of = F.element_at(F.array(F.lit("spam"), F.lit("malware"), F.lit("adult")), (F.col("code") % 3 + 1).cast("int"))
    dated = F.array(*[F.struct(F.lit(action).alias("action"), F.expr(f"cast({day} as int)").alias("day"), F.expr(where).alias("holds")) for action, day, where in events])
    each = found.select(list_of.alias("list"), "kind", "pattern", F.explode(F.filter(dated, lambda x: x["holds"])).alias("e"))
    out = each.select("list", "kind", "pattern", "e.action", F.expr(f"{start} + make_dt_interval(e.day)").alias("at"))
    fixed = pages.sparkSession.sql("select 'spam' as list, 'domain' as kind, 'spam-farm.example.org' as pattern, 'add' as action, timestamp'2024-03-01 00:00:00' as at")
    return out.unionByName(fixed)


FEED_SQL = r"""
with parsed as (
  select page_id, url, timestamp '2024-01-01 12:00:00' + ((page_id % 366 + 366) % 366)::int * interval 1 day as fetched_at,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^#]*)', 1)), '.'), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^#]*)', 2) as rest
  from pages),
keyed as (
  select *, case when rest = '' then '/' else rest end as path from parsed),
named as (
  select *, host || '/' || regexp_extract(path, '^/([^/?]*)', 1) as prefix_key, host || path as url_key from keyed),
patterns as (
  select distinct kind, pattern, code from (
    select kind, pattern, share, ('0x' || substr(sha256(pattern), 1, 6))::bigint as code from (
      select 'domain' as kind, regexp_extract(host, '^[^.]*[.](.*)$', 1) as pattern, 3 as share from named
      union select 'domain', host, 5 from named
      union select 'prefix', prefix_key, 7 from named
      union select 'url', url_key, 11 from named) where pattern is not null and pattern <> '') where code % share = 0),
events as (
  select case code % 3 when 0 then 'spam' when 1 then 'malware' else 'adult' end as list, kind, pattern, action, timestamp '2024-01-01' + day::int * interval 1 day as since
  from (select *, 'add' as action, code % 300 as day from patterns
        union all select *, 'remove', code % 300 + 20 + code % 41 from patterns where code % 2 = 0
        union all select *, 'add', code % 300 + 90 from patterns where code % 4 = 0
        union all select *, 'add', code % 300 + 100 from patterns where code % 8 = 0)
  union all select 'spam', 'domain', 'spam-farm.example.org', 'add', timestamp '2024-03-01'),
single as (
  select list, kind, pattern, since, max((action = 'remove')::int) as gone from events group by all),
held as (
  select *, lead(since) over (partition by list, kind, pattern order by since) as valid_to, lag(gone) over (partition by list, kind, pattern order by since) as before from single),
runs as (
  select *, sum(case when gone = 1 or coalesce(before = 1, true) then 1 else 0 end) over (partition by list, kind, pattern order by since) as run from held),
listed as (
  select list, kind, pattern, min(since) as valid_from, case when count(valid_to) = count(*) then max(valid_to) end as valid_to
  from runs where gone = 0 group by list, kind, pattern, run),
matched as (
  select n.page_id, n.url, l.list, l.kind, l.pattern from named n join listed l
    on l.kind = 'domain' and (n.host = l.pattern or n.host like '%.' || l.pattern) and l.valid_from <= n.fetched_at and (l.valid_to is null or n.fetched_at < l.valid_to)
  union all
  select n.page_id, n.url, l.list, l.kind, l.pattern from named n join listed l
    on l.kind = 'prefix' and n.prefix_key = l.pattern and l.valid_from <= n.fetched_at and (l.valid_to is null or n.fetched_at < l.valid_to)
  union all
  select n.page_id, n.url, l.list, l.kind, l.pattern from named n join listed l
    on l.kind = 'url' and n.url_key = l.pattern and l.valid_from <= n.fetched_at and (l.valid_to is null or n.fetched_at < l.valid_to))
select n.page_id, n.url, n.host, count(m.list)::bigint as n_active,
       coalesce(string_agg(distinct m.list, ',' order by m.list), '') as lists, count(m.list) > 0 as blocked
from named n left join matched m on n.page_id = m.page_id
group by n.page_id, n.url, n.host
"""
