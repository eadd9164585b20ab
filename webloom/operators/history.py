"""Score history: change against the run before, trends, sparklines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

LAST = 10


def _runs(key: str, when: str) -> Window:
    return Window.partitionBy(key).orderBy(when)


def deltas(history: DataFrame, key: str = "site", when: str = "day") -> DataFrame:
    """Each run with issues_resolved: how many fewer issues than the run before, 0 for the first."""
    before = F.lag("issues_found").over(_runs(key, when))
    return history.withColumn("issues_resolved", F.greatest(F.lit(0), F.coalesce(before - F.col("issues_found"), F.lit(0))))


def latest_change(history: DataFrame, score: str, key: str = "site", when: str = "day") -> DataFrame:
    """The newest run of each key against the one before."""
    before, newest = F.lag(score).over(_runs(key, when)), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when)))
    rows = history.withColumn("previous", before).withColumn("newest", newest).filter("newest = 1 and previous is not null")
    change = F.col(score) - F.col("previous")
    return rows.select(key, F.col("previous"), F.col(score).alias("current"), change.alias("change"), F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("direction"))


def _mark(x: Column) -> Column:
    return F.when(x >= 0.75, "#").when(x >= 0.5, "=").when(x >= 0.25, "-").otherwise("_")


def trend(history: DataFrame, score: str, key: str = "site", when: str = "day", last: int = LAST) -> DataFrame:
    """First, last, change and a sparkline of the last runs, scaled by the least and largest score of all runs."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when)))
    rows = history.withColumn("place", place)
    ends = rows.groupBy(key).agg(F.count("*").alias("runs"), F.min_by(score, when).alias("first"), F.max_by(score, when).alias("last"), F.min(score).alias("low"), F.max(score).alias("high")).filter("runs >= 2")
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 1).otherwise(F.col("low"))
    marked = rows.filter(F.col("place") <= last).join(ends, key).withColumn("mark", _mark((F.col(score) - low) / (F.col("high") - low).cast("double")))
    line = marked.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(when).alias("t"), "mark"))), lambda s: s["mark"]), "").alias("sparkline"))
    return ends.join(line, key).select(key, "runs", "first", "last", (F.col("last") - F.col("first")).alias("change"), "sparkline")


def percent_change(history: DataFrame, value: str, key: str = "site", when: str = "day") -> DataFrame:
    rows = history.groupBy(key).agg(F.min_by(value, when).cast("double").alias("first"), F.max_by(value, when).cast("double").alias("last"))
    return rows.withColumn("change", scores.percent_change(F.col("first"), F.col("last")))
