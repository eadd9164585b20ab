"""Queries over robots files, one for each customer, made by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import robots
from ..sources.driver_views import table


def files(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.concat(
        F.when(key % 3 == 0, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\n").otherwise("# nothing special\n"),
        F.when(key % 4 == 1, "User-agent: PerplexityBot\nDisallow: /private\nAllow: /private/open$\n").otherwise(""),
        F.when(key % 5 == 2, "User-agent: *\nDisallow: /*\nAllow: /\n").otherwise("User-agent: *\nDisallow: /tmp*/x # old\nDisallow:\n"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", robots.groups(text).alias("groups"))


_WILD = "CASE WHEN c_custkey % 5 = 2 THEN 'allowed' ELSE 'partial' END"


@query("robots_postures", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'blocked' ELSE {_WILD} END AS gptbot, CASE WHEN c_custkey % 4 = 1 THEN 'partial' ELSE {_WILD} END AS perplexitybot, {_WILD} AS others FROM customer")
def postures(spark, sf_dir):
    g = F.col("groups")
    return files(spark, sf_dir).select("c_custkey", robots.posture(g, "gptbot").alias("gptbot"), robots.posture(g, "perplexitybot").alias("perplexitybot"), robots.posture(g, "googlebot").alias("others"))


@query(
    "robots_paths",
    """SELECT c_custkey, path, CASE WHEN c_custkey % 4 = 1 THEN path IN ('/private', '/private/open/more') WHEN c_custkey % 5 = 2 THEN path <> '/' AND false OR length('/*') > length('/') ELSE path = '/tmp9/x' END AS disallowed
FROM customer, (SELECT unnest(['/private', '/private/open', '/private/open/more', '/tmp9/x', '/tmp9']) AS path)""",
)
def paths(spark, sf_dir):
    own = files(spark, sf_dir).select("c_custkey", robots.rules_for(F.col("groups"), "perplexitybot").alias("rules"))
    rows = own.select("c_custkey", "rules", F.explode(F.array(*map(F.lit, ("/private", "/private/open", "/private/open/more", "/tmp9/x", "/tmp9")))).alias("path"))
    return rows.select("c_custkey", "path", robots.disallowed(F.col("rules"), F.col("path")).alias("disallowed"))
