"""URL filters over time: what a list said when a page was fetched decides.

A list is a log of dated entries (rule, action, at), rule being a domain and action
"add" or "remove".  The entries of a rule become validity intervals [from, until).
A capture is judged by the rules for its host and each parent domain whose interval
holds its fetch time: an as-of join of captures and entries.

Hosts and times are judged once each, before they meet the captures again, so a host
with a third of all captures costs the rule join one row per time.  Of a host's parent
domains only those that are rules are joined, and hot rules ("com") and hot hosts are
dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.llm.common import joined, written

#: What a host is behind the scheme and the user: an address in brackets, or a name.
HOST = r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]\s]+)"


def host_of(url: Column) -> Column:
    """The lower-case host without port, user and final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, from, until) from (rule, action, at); until is null while a rule holds.

    Of entries at the same time, "remove" is last.  Entries that repeat a state, those
    with a null and unknown actions change nothing.
    """
    e = entries.select(F.lower("rule").alias("rule"), F.lower("action").alias("action"), "at")
    e = e.where("rule is not null and at is not null and action in ('add', 'remove')")
    e = e.groupBy("rule", "at").agg(F.max("action").alias("action"))
    e = e.withColumn("was", F.expr("lag(action) over (partition by rule order by at)"))
    e = e.where("action <> coalesce(was, 'remove')")
    e = e.withColumn("until", F.expr("lead(at) over (partition by rule order by at)"))
    return e.where("action = 'add'").select("rule", F.col("at").alias("from"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched and any others) with host, n_active, rules and blocked.

    rules: those that held at the fetch time, sorted, comma-joined.  A null url, one
    without a host and a null fetch time match no rule.  Each row stands for itself.
    Empty tables block nothing.  Columns of these four names are replaced.
    """
    own = [c for c in captures.columns if c.lower() not in ("host", "n_active", "rules", "blocked")]
    shown = [F.col(f"`{c}`") for c in own]
    c = captures.select(*shown, host_of(F.col("url")).alias("host"))
    known = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    asked = written(c.where(known).groupBy("host", "fetched").agg(F.count("*").alias("captures")), "asked")
    spans = intervals(entries).groupBy("rule").agg(F.collect_list(F.struct("from", "until")).alias("spans"))
    spans = written(spans, "spans")
    # No parent domain of more labels than the longest rule has can be a rule.
    longest = spans.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 0
    labels = F.slice(F.split("host", r"\."), F.greatest(-F.size(F.split("host", r"\.")), F.lit(-max(1, longest))), F.lit(max(1, longest)))
    suffixes = F.transform(F.array(labels), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))[0]
    keyed = asked.select("host", "fetched", F.explode(suffixes).alias("rule"))
    often = written(keyed.groupBy("rule").agg(F.count("*").alias("n")).join(spans, "rule"), "rules")
    held = joined(keyed, often, ["rule"], "n", often.agg(F.sum("n")).first()[0] or 0)
    held = held.where(F.exists("spans", lambda x: (F.col("fetched") >= x["from"]) & (x["until"].isNull() | (F.col("fetched") < x["until"]))))
    verdicts = held.groupBy("host", "fetched").agg(F.array_sort(F.collect_set("rule")).alias("found"))
    verdicts = written(verdicts.join(asked, ["host", "fetched"]), "verdicts")
    (found,) = unused(c, "found")
    out = joined(c.where(known), verdicts.withColumnRenamed("found", found), ["host", "fetched"], "captures", asked.agg(F.sum("captures")).first()[0] or 0, "left")
    none = F.array().cast("array<string>")
    out = out.unionByName(c.where(~known).withColumn(found, none)).withColumn(found, F.coalesce(found, none))
    return out.select(*shown, "host", F.size(found).cast("long").alias("n_active"), F.array_join(found, ",").alias("rules"), (F.size(found) > 0).alias("blocked"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """The table has no fetch times: page n counts as fetched on day n modulo 365 of 2024."""
    return pages.select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id % 365 as int))").alias("fetched"))


def example_entries(pages: DataFrame) -> DataFrame:
    """A list log for the hosts of a table and their parent domains, from digests of their names."""
    hosts = pages.select(host_of(F.col("url")).alias("rule")).where("rule is not null").distinct()
    parents = hosts.select(F.regexp_extract("rule", r"([^.]+\.[^.]+)$", 1).alias("rule")).where("rule <> ''")
    m = hosts.unionByName(parents).distinct().withColumn("m", F.md5("rule"))
    day = "cast(conv(substring(m, 1, 4), 16, 10) as int) % 365"
    e = m.selectExpr("rule", f"""filter(array(
        if(substring(m, 5, 1) < '8', named_struct('action', 'add', 'at', date_add(date '2024-01-01', {day})), null),
        if(substring(m, 6, 1) < '8', named_struct('action', 'remove', 'at', date_add(date '2024-01-01', {day} + 60)), null),
        if(substring(m, 7, 1) < '4', named_struct('action', 'add', 'at', date_add(date '2024-01-01', {day} + 120)), null)), x -> x is not null) as e""")
    return e.select("rule", F.explode("e").alias("e")).select("rule", "e.action", "e.at")


def report(pages: DataFrame) -> DataFrame:
    return judged(dated_pages(pages), example_entries(pages))


#: DuckDB SQL of report() over the table pages.
SQL = r"""
with c as (select page_id, url, date '2024-01-01' + cast(page_id % 365 as int) as fetched, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]\s]+)', 1)), '\.$', ''), '') as host from pages),
names as (select host as rule from c where host is not null union select regexp_extract(host, '([^.]+\.[^.]+)$', 1) from c where host like '%.%'),
d as (select rule, md5(rule) as m, cast(('0x' || substring(md5(rule), 1, 4)) as int) % 365 as day from names where rule <> ''),
e as (select rule, 'add' as action, date '2024-01-01' + day as at from d where substring(m, 5, 1) < '8'
  union all select rule, 'remove', date '2024-01-01' + (day + 60) from d where substring(m, 6, 1) < '8'
  union all select rule, 'add', date '2024-01-01' + (day + 120) from d where substring(m, 7, 1) < '4'),
latest as (select page_id, url, rule, arg_max(action, e.at) as state
  from c join e on (c.host = e.rule or ends_with(c.host, '.' || e.rule)) and e.at <= c.fetched group by all),
held as (select page_id, url, count(*) as n, string_agg(rule, ',' order by rule) as rules from latest where state = 'add' group by all)
select c.page_id, c.url, c.fetched, c.host, coalesce(n, 0) as n_active, coalesce(rules, '') as rules, n is not null as blocked
from c left join held on c.page_id = held.page_id and c.url is not distinct from held.url
"""
