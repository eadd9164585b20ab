"""Comparisons of two states of a page or site: served and rendered, now and before, one site and others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stores

# Body words up to which a served page is a shell, and from which a rendered one is a page; what may be missing, in order.
SHELL_WORDS, PAGE_WORDS = 50, 100
MISSING = {"content_client_only": "body content", "title_client_only": "title", "meta_description_client_only": "meta description", "canonical_client_only": "canonical", "h1_client_only": "H1", "structured_data_client_only": "structured data"}
NEW = -1.0


def render_gap(served: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """key, the six client-only flags, severity and what is missing, from two page reports joined on key."""
    s, r = served.alias("s"), rendered.alias("r")
    some = lambda side, c: F.coalesce(F.col(f"{side}.{c}") != "", F.lit(False))
    h1 = lambda side: F.size(F.filter(f"{side}.headings", lambda h: h == 1))
    flags = {
        "content_client_only": (F.col("s.words") <= SHELL_WORDS) & (F.col("r.words") >= PAGE_WORDS), "title_client_only": ~some("s", "title") & some("r", "title"), "meta_description_client_only": ~some("s", "description") & some("r", "description"),
        "canonical_client_only": (F.col("s.canonicals") == 0) & (F.col("r.canonicals") > 0), "h1_client_only": (h1("s") == 0) & (h1("r") > 0), "structured_data_client_only": (F.col("s.json_ld") == 0) & (F.col("r.json_ld") > 0),
    }
    rows = s.join(r, key).select(key, *[c.alias(k) for k, c in flags.items()])
    c = F.col
    severity = F.when(c("content_client_only") | c("h1_client_only"), "critical").when(c("title_client_only") | c("meta_description_client_only") | c("canonical_client_only"), "high").otherwise("none")
    missing = F.array_compact(F.array(*[F.when(c(k), F.lit(name)) for k, name in MISSING.items()]))
    return rows.select("*", severity.alias("severity"), F.array_join(missing, ", ").alias("missing"))


def pixel_difference(before: Column, now: Column) -> Column:
    """Percent of pixels (arrays of packed colours) that differ; 100 where the sizes do."""
    pairs = F.zip_with(before, now, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1))
    return F.when(F.size(before) != F.size(now), 100.0).when(F.size(now) == 0, 0.0).otherwise(F.aggregate(pairs, F.lit(0), lambda n, x: n + x) / F.size(now) * 100)


def against_baseline(now: DataFrame, before: DataFrame, key: str = "name", pixels: str = "pixels") -> DataFrame:
    """key, difference of each current picture with the baseline's of that name; NEW where there is none."""
    old = before.select(key, F.col(pixels).alias("_before"))
    return now.join(old, key, "left").select(key, F.when(F.col("_before").isNull(), F.lit(NEW)).otherwise(pixel_difference(F.col("_before"), F.col(pixels))).alias("difference"))


def rotated(current: DataFrame, folder: str) -> DataFrame:
    """Saves current pictures (name, pixels) as the next baseline and compares them with the one before: name, difference.

    What was the baseline stays as the version before; the first run is all new.
    """
    spark = current.sparkSession
    version = stores.replace(current, folder)
    now = stores.read(spark, folder, version)
    before = stores.read(spark, folder, version - 1) if version > 1 else now.limit(0)
    return against_baseline(now, before)


def side_by_side(rows: DataFrame, site: str, measure: str, value: str, sites: list[str]) -> DataFrame:
    """measure, a column for each site, and the site that leads (ties to the first named)."""
    wide = rows.groupBy(measure).agg(*[F.max(F.when(F.col(site) == s, F.col(value))).alias(s) for s in sites])
    best = F.greatest(*map(F.col, sites)) if len(sites) > 1 else F.col(sites[0])
    leads = F.coalesce(*[F.when(F.col(s) == best, F.lit(s)) for s in sites])
    return wide.withColumn("leader", leads)
