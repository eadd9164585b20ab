"""A crawl's control: which hosts are off limits, what a frontier visits, how fast it goes.

Fetching is an input: pages and links are relations, so a plan can be made,
replayed and tested without a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, urls
from ..sources.steps import written

# Waves: shares and steps.
BLOCKED_SHARE, STOP_SHARE, SLOWER, FASTER, SLOWEST = 0.3, 0.9, 1.0, 0.25, 6.0
MOST_PAGES, MOST_DEPTH = 300, 3


def host_is_blocked(host: Column, allow_private: bool = False) -> Column:
    """Whether a host is empty or a literal address, in any spelling, that isn't public; names are left to ``hosts_blocked``."""
    h = F.lower(F.trim(F.coalesce(host, F.lit("")), F.lit("[]")))
    return (h == "") | (F.lit(not allow_private) & (F.coalesce(addresses.is_special(addresses.address(host)), F.lit(False)) | (h == "localhost")))


def hosts_blocked(hosts: DataFrame, resolved: DataFrame, allow_private: bool = False) -> DataFrame:
    """hosts (host) with blocked: as ``host_is_blocked``, or one of the addresses it resolves to (host, address) isn't public; a name without any isn't blocked."""
    bad = resolved.filter(addresses.is_special(addresses.address(F.col("address")))).select(F.lower("host").alias("_name")).distinct()
    rows = hosts.join(bad, F.lower(F.col("host")) == F.col("_name"), "left")
    return rows.withColumn("blocked", host_is_blocked(F.col("host"), allow_private) | (F.lit(not allow_private) & F.col("_name").isNotNull())).drop("_name")


def disallowed_simply(robots: Column, path: Column) -> Column:
    """The plainer rule: only groups for "*", only Disallow, by the beginning of the path."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r\n|[\n\r]"), F.trim)
    start = F.struct(F.lit(False).alias("mine"), F.expr("cast(array() as array<string>)").alias("rules"))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))

    def step(s: Column, x: Column) -> Column:
        agent, rule = F.lower(x).startswith("user-agent:"), F.lower(x).startswith("disallow:") & (value(x) != "")
        return F.struct(F.when(agent, value(x) == "*").otherwise(s["mine"]).alias("mine"), F.when(~agent & s["mine"] & rule, F.concat(s["rules"], F.array(value(x)))).otherwise(s["rules"]).alias("rules"))

    return F.exists(F.aggregate(lines, start, step, lambda s: s["rules"]), lambda r: path.startswith(r))


def throttle(waves: Column, delay: float = 0.0) -> Column:
    """The delay after waves, in order, of a host: array of struct<blocked, total> -> struct<delay, stopped>.

    A wave with 30 % or more refused slows down by a second, up to SLOWEST; a clean
    one speeds up by a quarter, not below delay; a wave nearly all refused at the
    slowest pace stops the crawl, and later waves change nothing.
    """
    start = F.struct(F.lit(float(delay)).alias("delay"), F.lit(False).alias("stopped"))

    def step(s: Column, w: Column) -> Column:
        share = F.try_divide(w["blocked"].cast("double"), w["total"])
        now = F.when(share >= BLOCKED_SHARE, F.least(s["delay"] + SLOWER, F.lit(SLOWEST))).when((w["blocked"] == 0) & (s["delay"] > delay), F.greatest(F.lit(float(delay)), s["delay"] - FASTER)).otherwise(s["delay"])
        stop = (now >= SLOWEST) & F.coalesce(share >= STOP_SHARE, F.lit(False))
        return F.when(s["stopped"], s).otherwise(F.struct(now.alias("delay"), stop.alias("stopped")))

    return F.aggregate(waves, start, step)


def frontier(links: DataFrame, start: str, seeds: DataFrame | None = None, most_depth: int = MOST_DEPTH, most_pages: int = MOST_PAGES, subdomains: bool = True) -> DataFrame:
    """url, depth of what a crawl from start visits: links (source, target) in scope, level by level, and seeds (url) at depth 0 (a sitemap's).

    At most most_pages urls are seen: those of least depth, then of least url.
    """
    spark = links.sparkSession
    host = F.lit(start)
    scope = lambda url: urls.in_scope(url, start.split("://", 1)[-1].split("/", 1)[0], subdomains)
    edges = written(links.select(F.col("source"), urls.crawl_key(F.col("target")).alias("url")).filter(F.col("url").isNotNull()).filter(scope(F.col("url"))).distinct(), "frontier-edges")
    level = spark.range(1).select(urls.crawl_key(host).alias("url"))
    if seeds is not None:
        level = level.union(seeds.select(urls.crawl_key(F.col("url"))).filter("url is not null"))
    level = written(level.distinct().filter(scope(F.col("url"))).orderBy("url").limit(most_pages).select("url", F.lit(0).alias("depth")), "frontier")
    seen, count = level, level.count()
    for d in range(1, most_depth + 1):
        ahead = level.select(F.col("url").alias("source")).join(edges, "source").select("url").distinct().join(seen.select("url"), "url", "left_anti")
        level = written(ahead.orderBy("url").limit(max(0, most_pages - count)).select("url", F.lit(d).alias("depth")), "frontier")
        new = level.count()
        if not new:
            break
        seen, count = seen.unionByName(level), count + new
    return seen
