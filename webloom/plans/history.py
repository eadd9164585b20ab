"""Queries over the audit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import history as h
from ..sources.driver_views import view

RUNS = ("audit_history",)


@query("history_delta", "SELECT site, day, issues_found, CAST(greatest(0, coalesce(lag(issues_found) OVER (PARTITION BY site ORDER BY day) - issues_found, 0)) AS INT) AS issues_resolved FROM audit_history", RUNS)
def delta(spark, sf_dir):
    return h.deltas(view(spark, sf_dir, "audit_history")).select("site", "day", "issues_found", "issues_resolved")


@query(
    "history_latest_change",
    """SELECT site, previous, seo AS current, seo - previous AS change, CASE WHEN seo > previous THEN 'up' WHEN seo < previous THEN 'down' ELSE 'same' END AS direction FROM
(SELECT *, lag(seo) OVER (PARTITION BY site ORDER BY day) AS previous, row_number() OVER (PARTITION BY site ORDER BY day DESC) AS newest FROM audit_history) WHERE newest = 1 AND previous IS NOT NULL""",
    RUNS,
)
def latest(spark, sf_dir):
    return h.latest_change(view(spark, sf_dir, "audit_history"), "seo")


@query(
    "history_trend",
    """SELECT site, count(*) AS runs, arg_min(security, day) AS first, arg_max(security, day) AS last, arg_max(security, day) - arg_min(security, day) AS change,
string_agg(CASE WHEN x >= 0.75 THEN '#' WHEN x >= 0.5 THEN '=' WHEN x >= 0.25 THEN '-' ELSE '_' END, '' ORDER BY day) FILTER (WHERE place <= 10) AS sparkline FROM
(SELECT *, (security - low) / CAST(high - low AS DOUBLE) AS x FROM (SELECT *, CASE WHEN min(security) OVER w = max(security) OVER w THEN min(security) OVER w - 1 ELSE min(security) OVER w END AS low, max(security) OVER w AS high,
row_number() OVER (PARTITION BY site ORDER BY day DESC) AS place FROM audit_history WINDOW w AS (PARTITION BY site))) GROUP BY site HAVING count(*) >= 2""",
    RUNS,
)
def trend(spark, sf_dir):
    return h.trend(view(spark, sf_dir, "audit_history"), "security")


@query("trend_pct_change", "SELECT site, CAST(arg_min(issues_found, day) AS DOUBLE) AS first, CAST(arg_max(issues_found, day) AS DOUBLE) AS last FROM audit_history GROUP BY site", RUNS)
def percent(spark, sf_dir):
    return h.percent_change(view(spark, sf_dir, "audit_history"), "issues_found").select("site", "first", "last")


@query("trend_by_month", "SELECT strftime(day, '%b %y') AS month, CAST(sum(issues_found) AS BIGINT) AS issues FROM audit_history GROUP BY 1", RUNS)
def by_month(spark, sf_dir):
    return view(spark, sf_dir, "audit_history").groupBy(F.date_format("day", "MMM yy").alias("month")).agg(F.sum("issues_found").alias("issues"))
