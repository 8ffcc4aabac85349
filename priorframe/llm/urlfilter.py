"""URL filters by a temporal list join.

A list is a log of dated entries (kind, value, action, at): a host with its
subdomains, or a host with a path prefix (whole segments of that very host), is added to the list or removed from
it. Consecutive entries of one value become validity intervals, and an as-of
join evaluates each capture against what was active when it was fetched. The
capture's host is spread over its parent domains, and its path over its prefixes
by segment, so the join is an equality with an interval as a residual condition.

The rule that covers the longest value decides. Of entries of one value at one
moment, a removal is applied last.

Defined cases: a null or unparsable URL, or a null fetch time, is never
listed; repeated captures give repeated rows; an empty list lists nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace


START = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot; an address in brackets is a host; the scheme may be missing, not the slashes."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, START + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1)), r"\.$", "")


def segment(url: Column) -> Column:
    """The first path segment, without its slashes."""
    return F.regexp_extract(url, START + r"[^/?#]+/([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, without its first slash."""
    return F.regexp_extract(url, START + r"[^/?#]+/([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Entries to kind, value, since, until (exclusive, null: still active) of the times a value was listed."""
    order = Window.partitionBy("kind", "value").orderBy("at", "action")
    log = entries.filter("kind is not null and value is not null and at is not null and action in ('add', 'remove')").distinct()
    last = F.lead("at").over(order)
    return log.withColumn("until", last).filter("action = 'add' and (until is null or until > at)").select("kind", "value", F.col("at").alias("since"), "until")


def candidates(url: Column) -> Column:
    """(kind, value) of every rule that could cover the URL."""
    h = host(url)
    labels = F.split(h, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.split(path(url), "/", -1)
    prefix = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("path").alias("kind"), F.concat(h, F.lit("/"), prefix(i)).alias("value")))
    # an entry names a segment: neither a bare host nor a trailing slash makes a prefix
    prefixes = F.filter(prefixes, lambda c: ~c["value"].endswith("/"))
    return F.when(h != "", F.when(segment(url) != "", F.concat(parents, prefixes)).otherwise(parents)).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def evaluate(spark: SparkSession, captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with listed, rule and since of the rule that decides."""
    ws = Workspace(spark, "urlfilter")
    active = ws.sized(ws.keep(intervals(entries), "intervals"))
    seen = ws.keep(captures.select("page_id", "url", "fetched_at"), "captures")
    asked = seen.filter("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    asked = asked.withColumn("c", F.explode(candidates(F.col("url")))).select("url", "fetched_at", "c.kind", "c.value")
    when = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    hits = asked.alias("a").join(active.alias("i"), (F.col("a.kind") == F.col("i.kind")) & (F.col("a.value") == F.col("i.value")) & when)
    best = hits.groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("a.value"), F.col("a.value").alias("rule"), F.col("since"))).alias("best"))
    best = best.select("url", "fetched_at", "best.rule", "best.since")
    return seen.join(best, ["url", "fetched_at"], "left").select("page_id", "url", "fetched_at", F.col("rule").isNotNull().alias("listed"), "rule", "since")
