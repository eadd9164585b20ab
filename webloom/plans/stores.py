"""Stores that grow by crawls, and what changed between two versions of a state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import sinks, stores
from ..sources.driver_views import table, view
from ..sources.steps import shared_folder
from .crawl import BOTH, MERGED, STATE, merged

#: The second crawl sees the pages of one language, in which every redirect is followed by a page of the same title.
_AGAIN = r"regexp_matches(url, '^[a-z]+://[^/]*/de(/|\?|#|$)')"
_COLUMNS = ("url", "title", "status", "in_sitemap")


def grown(spark, sf_dir) -> str:
    """The folder of a store after two crawls."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    pages, links = view(spark, sf_dir, "crawl_pages").select("url", "title", "status", "in_sitemap", F.col("page_id").alias("ordinal")), view(spark, sf_dir, "crawl_links")
    listed = pages.filter("in_sitemap = 1").select("url")
    sinks.crawl_store(pages, links, listed, {"start": "first"}, folder)
    again = pages.filter(F.col("url").rlike(r"^[a-z]+://[^/]*/de(/|\?|#|$)"))
    sinks.crawl_store(again.withColumn("status", F.when(F.col("status") == 301, 200).otherwise(F.col("status"))), links.join(again.select(F.col("url").alias("source")), "source", "left_semi"), listed.limit(0), {"start": "second"}, folder)
    return folder


@query("crawl_store_grown", f"SELECT url, title, CASE WHEN {_AGAIN} AND status = 301 THEN 200 ELSE status END AS status, CAST(CASE WHEN {_AGAIN} THEN 0 ELSE in_sitemap END AS INT) AS in_sitemap FROM crawl_pages", ("crawl_pages",))
def crawl_store_grown(spark, sf_dir):
    return stores.read(spark, f"{grown(spark, sf_dir)}/pages").select(*_COLUMNS)


@query("crawl_store_links", f"SELECT CAST(crawl AS INT) AS crawl, count(*) AS links FROM (SELECT 1 AS crawl FROM crawl_links UNION ALL SELECT 2 FROM crawl_links WHERE {_AGAIN.replace('url', 'source')}) GROUP BY crawl", BOTH)
def crawl_store_links(spark, sf_dir):
    return stores.read(spark, f"{grown(spark, sf_dir)}/links").groupBy(F.col("crawl").cast("int").alias("crawl")).agg(F.count("*").alias("links"))


@query(
    "snapshot_changes",
    f"""SELECT m.id, CASE WHEN s.id IS NULL THEN 'added' ELSE 'changed' END AS change, CASE WHEN s.id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN m.priority IS DISTINCT FROM s.priority THEN 'priority' END, CASE WHEN m.status IS DISTINCT FROM s.status THEN 'status' END, CASE WHEN m.last_seen IS DISTINCT FROM s.last_seen THEN 'last_seen' END], lambda x: x IS NOT NULL), ',') END AS columns
FROM ({MERGED}) m LEFT JOIN ({STATE}) s ON s.id = m.id WHERE s.id IS NULL OR m.priority IS DISTINCT FROM s.priority OR m.status IS DISTINCT FROM s.status OR m.last_seen IS DISTINCT FROM s.last_seen""",
)
def snapshot_changes(spark, sf_dir):
    """A state that was read, merged and saved again, against the version before."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    first = spark.sql(STATE.replace("FROM pages", "FROM {t}").replace("VARCHAR(200)", "STRING"), t=table(spark, sf_dir, "pages"))
    sinks.saved(first, folder)
    sinks.saved(merged(spark, sf_dir, sinks.loaded(spark, folder, "")).drop("event"), folder)
    changes = stores.compared(spark, folder, ["id"], 1, 2, ["priority", "status", "last_seen"])
    return changes.select("id", "change", F.array_join("columns", ",").alias("columns"))
