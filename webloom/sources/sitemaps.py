"""Sitemap documents as rows: entries of url sets, children of indexes, counters and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .steps import written

# Fixed value: entries that one sitemap may hold.
MOST_ENTRIES = 50_000
_LOC = r"(?is)<(?:[a-z0-9]+:)?loc[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</(?:[a-z0-9]+:)?loc>"


def _unescaped(text: Column) -> Column:
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?is)<(?:[a-z0-9]+:)?sitemapindex[\s>]")


def is_well_formed(xml: Column) -> Column:
    """Whether the root element opens and closes; a broken document has no entries."""
    root = F.regexp_extract(xml, r"(?is)<((?:[a-z0-9]+:)?(?:urlset|sitemapindex))[\s>]", 1)
    return (root != "") & xml.rlike(r"(?is)</(?:[a-z0-9]+:)?(?:urlset|sitemapindex)\s*>\s*$")


def locations(xml: Column) -> Column:
    """array<string> of the locations, whatever the namespace."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(_LOC), F.lit(1))
    return F.transform(F.filter(found, lambda x: x != ""), _unescaped)


def entries(documents: DataFrame) -> DataFrame:
    """sitemap, url, child of every location; child tells entries of an index."""
    return documents.select("sitemap", is_index(F.col("xml")).alias("child"), F.explode(locations(F.col("xml"))).alias("url"))


def expanded(fetched: DataFrame, roots: DataFrame, most_files: int | None = 20, most_urls: int | None = 5000) -> DataFrame:
    """url, sitemap of the pages that the roots (sitemap) lead to, through indexes of indexes.

    fetched (sitemap, xml) holds the documents by address, as fetching is an input;
    a document is read once, so indexes that name each other end.  At most
    most_files documents, in order of address level by level, and most_urls pages,
    in order of url, are kept; None sets no limit.
    """

    def least(rows: DataFrame, column: str, most: int | None) -> DataFrame:
        return rows if most is None else rows.orderBy(column).limit(max(0, most))

    known = written(fetched.select("sitemap", "xml").dropDuplicates(["sitemap"]), "sitemap-documents")
    level = written(least(roots.select("sitemap").distinct(), "sitemap", most_files), "sitemap-level")
    seen, count, pages = level, level.count(), None
    while True:
        found = written(entries(known.join(level, "sitemap", "left_semi")), "sitemap-entries")
        own = found.filter("not child").select("url", "sitemap")
        pages = own if pages is None else pages.unionByName(own)
        ahead = found.filter("child").select(F.col("url").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti")
        level = written(least(ahead, "sitemap", None if most_files is None else most_files - count), "sitemap-level")
        new = level.count()
        if not new:
            break
        seen, count = seen.unionByName(level), count + new
    return least(pages.groupBy("url").agg(F.min("sitemap").alias("sitemap")), "url", most_urls)


def from_robots(robots: Column) -> Column:
    """The sitemap addresses that a robots text names, in order."""
    return F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


def audit(documents: DataFrame) -> DataFrame:
    """sitemap, urls, unique_urls, lastmods, foreign, total (of 100) of documents (sitemap, site, xml, in_robots); a null xml is no sitemap."""
    xml = F.coalesce("xml", F.lit(""))
    loc = F.when(is_well_formed(xml) & ~is_index(xml), locations(xml)).otherwise(F.array().cast("array<string>"))
    host = urls.netloc(F.col("site"))
    rows = documents.select("sitemap", "in_robots", F.col("xml").isNotNull().alias("there"), is_well_formed(xml).alias("valid"), loc.alias("loc"), F.regexp_count(xml, F.lit("(?i)<(?:[a-z0-9]+:)?lastmod[ >]")).alias("lastmods"), host.alias("host"))
    rows = rows.withColumns({"urls": F.size("loc"), "unique_urls": F.size(F.array_distinct("loc")), "foreign": F.size(F.filter("loc", lambda u: urls.netloc(u) != F.col("host")))})
    each = (
        ("there", 25), ("valid", 15), ("urls > 0", 15), ("there and foreign = 0", 10), ("lastmods > 0", 10), ("in_robots", 10), ("there and urls = unique_urls", 10), (f"there and urls <= {MOST_ENTRIES}", 5),
    )
    total = sum((F.when(F.expr(c), p).otherwise(0) for c, p in each), F.lit(0))
    return rows.select("sitemap", "urls", "unique_urls", "lastmods", "foreign", total.cast("int").alias("total"))
