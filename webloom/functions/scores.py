"""Scores, grades and rates on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Click rate expected at each position, category weights with and without performance, grade floors.
CLICK_RATES = {1: 0.27, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.045, 7: 0.035, 8: 0.03, 9: 0.025, 10: 0.022}
WEIGHTS = {"seo": 0.40, "security": 0.25, "accessibility": 0.15, "performance": 0.20}
WEIGHTS_OF_THREE = {"seo": 0.45, "security": 0.30, "accessibility": 0.25}
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))
CAP = 59


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def expected_click_rate(position: Column) -> Column:
    p = F.bround(position).cast("int")
    out = F.when(position.isNull(), 0.0).when(p <= 1, CLICK_RATES[1])
    for k, v in CLICK_RATES.items():
        out = out.when(p == k, v)
    return out.when(p <= 20, 0.015).otherwise(0.008)


def percent_change(old: Column, new: Column) -> Column:
    """Signed text such as +5.3% or -12%; empty if there is nothing to compare with."""
    r = F.bround((new - old) / old * 100, 1)
    number = F.when(r == F.floor(r), F.floor(r).cast("long").cast("string")).otherwise(F.format_string("%.1f", r))
    return F.when(old.isNull() | (old == 0), F.lit("")).otherwise(F.concat(F.when(r >= 0, F.lit("+")).otherwise(F.lit("")), number, F.lit("%")))


def composite(seo: Column, security: Column, accessibility: Column, performance: Column, p0: Column, security_assessed: Column) -> dict[str, Column]:
    """Overall score of the four categories: an unassessed security score counts as the mean of the others, a P0 finding caps."""
    three = performance.isNull()
    others = seo + accessibility + F.coalesce(performance, F.lit(0))
    mean = others / F.when(three, 2).otherwise(3)
    effective = F.when(security_assessed, security).otherwise(F.bround(mean).cast("int"))
    four_sum = seo * WEIGHTS["seo"] + effective * WEIGHTS["security"] + accessibility * WEIGHTS["accessibility"] + performance * WEIGHTS["performance"]
    three_sum = seo * WEIGHTS_OF_THREE["seo"] + effective * WEIGHTS_OF_THREE["security"] + accessibility * WEIGHTS_OF_THREE["accessibility"]
    uncapped = F.bround(F.when(three, three_sum).otherwise(four_sum)).cast("int")
    overall = F.least(uncapped, F.when(p0 > 0, CAP).otherwise(100))
    return {"overall": overall, "uncapped": uncapped, "grade": grade(overall), "cap_applied": overall < uncapped}


def gate_exit_code(score: Column, threshold: int, p0: Column, p1: Column, fail_on: str | None) -> Column:
    """0 passes, 1 misses the threshold, 2 has blocking findings (which wins)."""
    blocking = p0 if fail_on == "P0" else p0 + p1 if fail_on == "P1" else F.lit(0)
    return F.when(blocking > 0, 2).when(F.coalesce(score, F.lit(0)) < threshold, 1).otherwise(0)
