"""Search-performance and landing-page logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, urls
from .graph import MONEY


def with_rate(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("query") != "").withColumn("ctr", F.coalesce(F.try_divide(F.col("clicks").cast("double"), F.col("impressions")), F.lit(0.0)))


def is_branded(query: Column, terms: list[str]) -> Column:
    known = [t.lower().strip() for t in terms if t.strip()]
    return F.exists(F.array(*map(F.lit, known)), lambda t: F.contains(F.lower(query), t)) if known else F.lit(False)


def summary(rows: DataFrame, brand: list[str]) -> DataFrame:
    rows = with_rate(rows)
    clicks, shown = F.sum("clicks"), F.sum("impressions")
    positioned = F.when(F.col("position").isNotNull(), F.col("impressions"))
    return rows.agg(
        clicks.alias("total_clicks"), shown.alias("total_impressions"), F.bround(F.try_divide(clicks.cast("double"), shown), 4).alias("avg_ctr"),
        F.bround(F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum(positioned)), 1).alias("avg_position"),
        F.bround(F.try_divide(F.sum(F.when(is_branded(F.col("query"), brand), F.col("clicks")).otherwise(0)).cast("double"), clicks), 3).alias("branded_share"), F.count("*").alias("query_count"),
    )


def striking(rows: DataFrame, least: int = 10) -> DataFrame:
    return with_rate(rows).filter((F.col("position") > 4.5) & (F.col("position") <= 20) & (F.col("impressions") >= least))


def low_rate(rows: DataFrame, least: int = 10) -> DataFrame:
    expected = scores.expected_click_rate(F.col("position"))
    return with_rate(rows).withColumn("benchmark", expected).filter((F.col("position") <= 10) & (F.col("impressions") >= max(least, 20)) & (F.col("ctr") < 0.5 * F.col("benchmark")))


def no_clicks(rows: DataFrame, least: int = 10) -> DataFrame:
    return with_rate(rows).filter((F.col("clicks") == 0) & (F.col("impressions") >= max(least, 20)))


def best(rows: DataFrame, most: int = 25) -> DataFrame:
    """The rows of most impressions; ties by the rows' own order."""
    return rows.orderBy(F.desc("impressions"), "ordinal").limit(most)


def position_buckets(rows: DataFrame) -> DataFrame:
    p = F.col("position")
    bucket = F.when(p <= 3, "top3").when(p <= 10, "4-10").when(p <= 20, "11-20").when(p <= 50, "21-50").when(p <= 100, "51-100")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")).filter("bucket is not null")


def opportunities(rows: DataFrame, most: int = 20) -> DataFrame:
    return best(striking(rows), most).select(F.col("query").alias("keyword"), F.col("impressions").alias("volume"), F.bround("position", 1).alias("position"), F.col("page").alias("url"), F.when(F.col("position") <= 10, "high").otherwise("medium").alias("priority"))


def engagement_gaps(rows: DataFrame, least: int = 50) -> DataFrame:
    return rows.filter((F.col("sessions") >= least) & (F.col("engagement_rate") > 0) & (F.col("engagement_rate") < 0.35))


def money_without_conversions(rows: DataFrame, least: int = 50, money: str = MONEY) -> DataFrame:
    return rows.filter(urls.path(F.col("page")).rlike(f"(?i){money}") & (F.col("sessions") >= max(20, least // 2)) & (F.col("conversions") == 0))


def landing_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("pages"), F.sum("sessions").alias("sessions"))


def top_keywords(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """keyword, position, volume, traffic_pct of export rows (map<string,string>, under their long or short names); rows without a keyword are left out."""
    held = F.col(fields)
    value = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(held, F.lit(n)), F.lit("")) for n in names])
    number = lambda *names: F.coalesce(F.regexp_replace(value(*names), r"[,\s]", "").try_cast("double").cast("int"), F.lit(0))
    share = value("Traffic (%)", "Tr")
    out = rows.select(value("Keyword", "Ph").alias("keyword"), number("Position", "Pos").alias("position"), number("Search Volume", "Nq").alias("volume"), F.coalesce(F.concat(share, F.lit("%")), F.lit("")).alias("traffic_pct"))
    return out.filter("keyword is not null")
