"""Summaries over findings and module totals, and sets of modules to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITIES = ("P0", "P1", "P2", "P3")
# Module sets by name; an unknown name means the full one. Titles that admit a page isn't there.
PROFILES = {
    "quick": "seo security links", "seo": "seo content_quality sitemap schema_validator", "security": "security dns_infra cookie_gdpr", "accessibility": "accessibility performance", "content": "seo content_quality links sitemap",
    "local": "seo security accessibility performance local_seo email_deliverability links content_quality schema_validator", "ecommerce": "seo security accessibility performance ecommerce links schema_validator",
    "full": "seo security accessibility performance links ecommerce email_deliverability i18n local_seo dns_infra js_bundle content_quality cookie_gdpr pwa schema_validator sitemap",
}
NOT_FOUND = r"(?i)page not found|not be found|doesn'?t exist|404 error|error 404|no longer (?:exists|available)|page you (?:requested|are looking)"


def profile(name: str) -> list[str]:
    return PROFILES.get(name, PROFILES["full"]).split()


def by_priority(findings: DataFrame, key: str) -> DataFrame:
    """key and the number of findings of each priority, p0 to p3; one aggregation, no pivot pass."""
    return findings.groupBy(key).agg(*[F.count_if(F.col("priority") == p).alias(p.lower()) for p in PRIORITIES])


def merged(findings: list[DataFrame]) -> DataFrame:
    """All findings, missing columns as null, by priority; unknown priorities last."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(9))
    return out.orderBy(place)


def percents(evaluated: DataFrame) -> DataFrame:
    """module, mean percent of 100 over its pages, rounded half to even."""
    return evaluated.groupBy("module").agg(F.bround(F.avg("total")).cast("int").alias("percent"))


def top_with_remainder(rows: DataFrame, order: list[Column], label: str, amount: str, most: int) -> DataFrame:
    """The first ``most`` rows (label, amount), and one row "others" that sums up the rest if there is any."""
    first = rows.orderBy(*order).limit(most).select(label, amount).withColumn("rows", F.lit(1).cast("long"))
    total = rows.agg(F.count("*").alias("n"), F.sum(amount).alias("s")).crossJoin(first.agg(F.count("*").alias("fn"), F.sum(amount).alias("fs")))  # one row by one row
    rest = total.filter("n > fn").select(F.lit("others").alias(label), (F.col("s") - F.col("fs")).alias(amount), (F.col("n") - F.col("fn")).alias("rows"))
    return first.unionByName(rest)


def soft_missing(status: Column, title: Column) -> Column:
    """A page that answers 200 with a short title saying that it isn't there."""
    words = F.size(F.filter(F.split(F.regexp_replace(title, "<[^>]+>", " "), r"\s+"), lambda w: w != ""))
    return (status == 200) & title.rlike(NOT_FOUND) & (words <= 8)
