"""Queries over search-performance and landing-page rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scores
from ..operators import roadmap, searchlog
from ..sources.driver_views import table, view

RATE = "CASE WHEN impressions = 0 THEN 0.0 ELSE CAST(clicks AS DOUBLE) / impressions END"
_BENCH = "CASE WHEN position IS NULL THEN 0.0 WHEN round_even(position, 0) <= 1 THEN 0.27 " + " ".join(f"WHEN round_even(position, 0) = {k} THEN {v}" for k, v in scores.CLICK_RATES.items()) + " WHEN round_even(position, 0) <= 20 THEN 0.015 ELSE 0.008 END"
ROWS = ("search_rows",)
BRAND = ["red", "blue"]
_BRANDED = " OR ".join(f"contains(lower(query), '{b}')" for b in BRAND)


def rows(spark, sf_dir):
    return view(spark, sf_dir, "search_rows")


@query(
    "gsc_summary",
    f"""SELECT CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(impressions) AS BIGINT) AS total_impressions, round_even(CAST(sum(clicks) AS DOUBLE) / sum(impressions), 4) AS avg_ctr,
round_even(sum(position * impressions) / sum(impressions), 1) AS avg_position, round_even(CAST(sum(CASE WHEN {_BRANDED} THEN clicks ELSE 0 END) AS DOUBLE) / sum(clicks), 3) AS branded_share, count(*) AS query_count FROM search_rows WHERE query <> ''""",
    ROWS,
)
def summary(spark, sf_dir):
    return searchlog.summary(rows(spark, sf_dir), BRAND)


_TOP = "SELECT query, page, clicks, impressions, position FROM (SELECT *, {rate} AS ctr FROM search_rows) WHERE {where} ORDER BY impressions DESC, ordinal LIMIT 25"


def _slim(df):
    return searchlog.best(df).select("query", "page", "clicks", "impressions", "position")


@query("gsc_striking", _TOP.format(rate=RATE, where="position > 4.5 AND position <= 20 AND impressions >= 10"), ROWS)
def striking(spark, sf_dir):
    return _slim(searchlog.striking(rows(spark, sf_dir)))


@query("gsc_low_ctr", _TOP.format(rate=RATE, where=f"position <= 10 AND impressions >= 20 AND ctr < 0.5 * {_BENCH}"), ROWS)
def low_ctr(spark, sf_dir):
    return _slim(searchlog.low_rate(rows(spark, sf_dir)))


@query("gsc_no_clicks", _TOP.format(rate=RATE, where="clicks = 0 AND impressions >= 20"), ROWS)
def no_clicks(spark, sf_dir):
    return _slim(searchlog.no_clicks(rows(spark, sf_dir)))


@query("gsc_opportunities", "SELECT query AS keyword, impressions AS volume, round_even(position, 1) AS position, page AS url, CASE WHEN position <= 10 THEN 'high' ELSE 'medium' END AS priority FROM search_rows WHERE position > 4.5 AND position <= 20 AND impressions >= 10 ORDER BY impressions DESC, ordinal LIMIT 20", ROWS)
def opportunities(spark, sf_dir):
    return searchlog.opportunities(rows(spark, sf_dir))


@query(
    "gsc_position_buckets",
    "SELECT bucket, count(*) AS \"rows\" FROM (SELECT CASE WHEN position <= 3 THEN 'top3' WHEN position <= 10 THEN '4-10' WHEN position <= 20 THEN '11-20' WHEN position <= 50 THEN '21-50' WHEN position <= 100 THEN '51-100' END AS bucket FROM search_rows) WHERE bucket IS NOT NULL GROUP BY bucket",
    ROWS,
)
def buckets(spark, sf_dir):
    return searchlog.position_buckets(rows(spark, sf_dir))


@query("gsc_ctr_benchmark", f"SELECT DISTINCT position, CAST({_BENCH} AS DOUBLE) AS benchmark FROM search_rows", ROWS)
def benchmark(spark, sf_dir):
    return rows(spark, sf_dir).select("position").distinct().withColumn("benchmark", scores.expected_click_rate(F.col("position")).cast("double"))


@query("gsc_cannibalised", "SELECT query, count(DISTINCT page) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions FROM search_rows GROUP BY query HAVING count(DISTINCT page) > 1", ROWS)
def cannibalised(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("query").agg(F.count_distinct("page").alias("pages"), F.sum("impressions").alias("impressions")).filter("pages > 1")


LANDING = ("landing_rows",)


@query("ga4_engagement_gaps", "SELECT page, sessions, engagement_rate FROM landing_rows WHERE sessions >= 10 AND engagement_rate > 0 AND engagement_rate < 0.35", LANDING)
def engagement(spark, sf_dir):
    return searchlog.engagement_gaps(view(spark, sf_dir, "landing_rows"), 10).select("page", "sessions", "engagement_rate")


@query("ga4_no_conversions", r"SELECT page, sessions FROM landing_rows WHERE regexp_matches(page, '^[a-z]+://[^/]*/(en)(/|\?|#|$)') AND sessions >= 20 AND conversions = 0", LANDING)
def no_conversions(spark, sf_dir):
    return searchlog.money_without_conversions(view(spark, sf_dir, "landing_rows"), 10, r"/(en)(/|$)").select("page", "sessions")


@query("ga4_totals", "SELECT count(*) AS pages, CAST(sum(sessions) AS BIGINT) AS sessions FROM landing_rows", LANDING)
def totals(spark, sf_dir):
    return searchlog.landing_totals(view(spark, sf_dir, "landing_rows"))


@query("query_clusters")
def query_clusters(spark, sf_dir):
    return roadmap.clusters(rows(spark, sf_dir), ["blue"])


@query("content_roadmap")
def content_roadmap(spark, sf_dir):
    now = roadmap.clusters(rows(spark, sf_dir), ["blue"])
    earlier = roadmap.clusters(rows(spark, sf_dir).withColumn("clicks", F.col("clicks") * (1 + F.col("ordinal") % 3)), ["blue"])
    before = earlier.groupBy("topic").agg(F.min_by("query", "place").alias("label"), F.sum("clicks").alias("clicks")).groupBy("label").agg(F.max_by("clicks", "topic").alias("clicks"))
    return roadmap.roadmap(now, before)


@query("top_keywords", "SELECT p_name AS keyword, CAST(p_size AS INT) AS position, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey * 1000 AS INT) ELSE 0 END AS volume, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey % 7 || '.5%' END AS traffic_pct FROM part WHERE p_partkey % 5 > 0")
def top_keywords(spark, sf_dir):
    k = F.col("p_partkey")
    long = F.create_map(F.lit("Keyword"), F.when(k % 5 > 0, F.col("p_name")).otherwise(""), F.lit("Position"), F.col("p_size").cast("string"), F.lit("Search Volume"), F.concat(k.cast("string"), F.lit(",000")), F.lit("Traffic (%)"), F.when(k % 3 > 0, F.concat((k % 7).cast("string"), F.lit(".5"))))
    short = F.create_map(F.lit("Ph"), F.when(k % 5 > 0, F.col("p_name")), F.lit("Pos"), F.col("p_size").cast("string"), F.lit("Nq"), F.lit("n/a"), F.lit("Tr"), F.when(k % 3 > 0, F.concat((k % 7).cast("string"), F.lit(".5"))))
    return searchlog.top_keywords(table(spark, sf_dir, "part").select(F.when(k % 2 == 0, long).otherwise(short).alias("fields")))
