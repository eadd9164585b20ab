"""Queries over category scores: composite, grades, gate, portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scores
from ..sources.driver_views import view

RUNS = ("audit_history",)
_EFFECTIVE = "CASE WHEN assessed THEN security ELSE CAST(round_even((seo + accessibility + coalesce(perf, 0)) / CASE WHEN perf IS NULL THEN 2.0 ELSE 3.0 END, 0) AS INT) END"
SCORED = f"""SELECT *, least(uncapped, CASE WHEN p0 > 0 THEN 59 ELSE 100 END) AS overall FROM (SELECT *, CAST(round_even(CASE WHEN perf IS NULL THEN seo * 0.45::DOUBLE + effective * 0.30::DOUBLE + accessibility * 0.25::DOUBLE
 ELSE seo * 0.40::DOUBLE + effective * 0.25::DOUBLE + accessibility * 0.15::DOUBLE + perf * 0.20::DOUBLE END, 0) AS INT) AS uncapped FROM (SELECT *, {_EFFECTIVE} AS effective FROM
 (SELECT site, day, seo, security, accessibility, CASE WHEN issues_found % 4 = 1 THEN NULL ELSE performance END AS perf, issues_found % 5 <> 2 AS assessed, CASE WHEN issues_found % 3 = 0 THEN 1 ELSE 0 END AS p0, CASE WHEN issues_found % 7 = 0 THEN 2 ELSE 0 END AS p1 FROM audit_history)))"""
_GRADE = "CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END"


def scored(spark, sf_dir):
    n = F.col("issues_found")
    rows = view(spark, sf_dir, "audit_history").select(
        "site", "day", "seo", "security", "accessibility", F.when(n % 4 != 1, F.col("performance")).alias("perf"), (n % 5 != 2).alias("assessed"), F.when(n % 3 == 0, 1).otherwise(0).alias("p0"), F.when(n % 7 == 0, 2).otherwise(0).alias("p1")
    )
    return rows.withColumns(scores.composite(F.col("seo"), F.col("security"), F.col("accessibility"), F.col("perf"), F.col("p0"), F.col("assessed")))


@query("score_composite", f"SELECT site, day, uncapped, overall, {_GRADE} AS grade, overall < uncapped AS cap_applied FROM ({SCORED})", RUNS)
def composite(spark, sf_dir):
    return scored(spark, sf_dir).select("site", "day", "uncapped", "overall", "grade", "cap_applied")


@query("grade_bands", f"SELECT grade, count(*) AS audits FROM (SELECT {_GRADE} AS grade FROM ({SCORED})) GROUP BY grade", RUNS)
def bands(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("audits"))


@query("gate_exit_code", f"SELECT site, day, CAST(CASE WHEN p0 + p1 > 0 THEN 2 WHEN overall < 50 THEN 1 ELSE 0 END AS INT) AS exit_code FROM ({SCORED})", RUNS)
def gate(spark, sf_dir):
    return scored(spark, sf_dir).select("site", "day", scores.gate_exit_code(F.col("overall"), 50, F.col("p0"), F.col("p1"), "P1").alias("exit_code"))


@query("portfolio_summary", f"SELECT day, CAST(round_even(avg(overall), 0) AS INT) AS average_overall, arg_max(site, overall * 1000 - ascii(site)) AS best, arg_min(site, overall * 1000 + ascii(site)) AS worst FROM ({SCORED}) GROUP BY day", RUNS)
def portfolio(spark, sf_dir):
    place = F.ascii("site")
    return scored(spark, sf_dir).groupBy("day").agg(F.bround(F.avg("overall")).cast("int").alias("average_overall"), F.max_by("site", F.col("overall") * 1000 - place).alias("best"), F.min_by("site", F.col("overall") * 1000 + place).alias("worst"))
