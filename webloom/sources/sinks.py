"""What runs leave: crawl stores, scores documents, per-site folders, manifests, text tables, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_file_name
from . import stores


def crawl_store(pages: DataFrame, links: DataFrame, sitemap: DataFrame, meta: dict[str, str], folder: str) -> int:
    """A crawl put into a store of tables that grow: pages, links, meta; the number of the crawl.

    pages replace those of their url (within the crawl the last by ``ordinal``, where
    there is one), with in_sitemap; links are appended with their crawl; of a meta key
    the last crawl's value holds.  Only buckets of urls that the crawl saw are rewritten.
    """
    order = F.desc("ordinal") if "ordinal" in pages.columns else None
    crawl = stores.upsert(with_sitemap(pages, sitemap), f"{folder}/pages", ["url"], order)
    stores.append(links.withColumn("crawl", F.lit(crawl)), f"{folder}/links")
    stores.upsert(pages.sparkSession.createDataFrame(sorted(meta.items()), "key string, value string"), f"{folder}/meta", ["key"], buckets=1)
    return crawl


def with_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """pages with in_sitemap (0 or 1): whether their url is among the sitemap's (url)."""
    listed = sitemap.select(F.col("url").alias("_listed")).filter("_listed is not null").distinct()
    rows = pages.drop("in_sitemap").join(listed, F.col("url") == F.col("_listed"), "left")
    return rows.withColumn("in_sitemap", F.col("_listed").isNotNull().cast("int")).drop("_listed")


def scores_document(findings: DataFrame, module: str, most: int | None = None) -> DataFrame:
    """One row, document: JSON of findings (by priority, then title), module_scores and summary counts; at most ``most`` findings are listed, all are counted."""
    listed = F.array_sort(F.collect_list(F.struct("priority", "title", *[c for c in ("description", "fix", "effort", "id") if c in findings.columns])))
    parts = findings.agg(listed.alias("findings"), *[F.count_if(F.col("priority") == p).alias(p) for p in ("P0", "P1", "P2", "P3")])
    shown = F.col("findings") if most is None else F.slice("findings", 1, most)
    counts = F.struct(*[F.col(p) for p in ("P0", "P1", "P2", "P3")])
    return parts.select(F.to_json(F.struct(shown.alias("findings"), F.struct(F.struct(F.size("findings").alias("findings")).alias(module)).alias("module_scores"), counts.alias("summary"))).alias("document"))


def by_site(documents: DataFrame, folder: str, name: str = "name") -> None:
    """A JSON folder for each site, named by its file-safe name (documents has name and document), and summary rows beside them."""
    rows = documents.withColumn("site", safe_file_name(F.col(name)))
    rows.select("site", "document").write.mode("overwrite").partitionBy("site").json(f"{folder}/sites")
    rows.select(name, "site").write.mode("overwrite").json(f"{folder}/portfolio_summary")


def saved(state: DataFrame, folder: str) -> int:
    """A state or history table as the next version of the one that the next run reads, which may be the one it was made from."""
    return stores.replace(state, folder)


def loaded(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The state that was saved last, or as of a version; empty before the first."""
    return stores.read(spark, folder, version) if stores.versions(spark, folder) else spark.createDataFrame([], schema)


def html_manifest(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the html of pages (url, status, depth, html) and gives the manifest: url, status, depth, file, links_found; a page without html has no file."""
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    safe = F.regexp_replace(F.regexp_replace(F.when(path == "", "index").otherwise(path), r"[^\w\-.]", "_"), "^_", "")
    file = F.concat(F.when(safe == "", "index").otherwise(safe), F.lit(".html"))
    rows = pages.withColumn("file", F.when(F.coalesce("html", F.lit("")) != "", file))
    rows.filter("file is not null").select("file", "url", "html").write.mode("overwrite").parquet(f"{folder}/html")
    links = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), F.lit(1))))
    return rows.select("url", "status", "depth", "file", links.alias("links_found"))


def audit_text(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """line, text of a site-wide audit: a heading with counts, then three lines a finding in its order, or that there is none."""
    head = stats.select(F.lit(0).alias("line"), F.format_string("Site-wide audit: %d pages crawled, %d indexable, %d internal links", F.col("pages"), F.col("indexable"), F.col("internal_links")).alias("text"))
    place = F.row_number().over(Window.orderBy("priority", "ordinal"))  # a row for each check
    lines = F.array(F.concat("priority", F.lit(": "), "title", F.lit(" ("), "count", F.lit(" affected)")), F.concat(F.lit("  "), "description"), F.concat(F.lit("  Fix: "), "fix"))
    body = findings.select((place * 3 - 2).alias("first"), F.posexplode(lines).alias("k", "text")).select((F.col("first") + F.col("k")).cast("int").alias("line"), "text")
    none = findings.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("line"), F.lit("No site-level issues found.").alias("text"))
    return head.unionByName(body).unionByName(none)


def snippet(json: Column) -> Column:
    """A ready-to-paste JSON-LD script element."""
    return F.concat(F.lit('<script type="application/ld+json">\n'), json, F.lit("\n</script>"))
