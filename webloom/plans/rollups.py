"""Queries that sum up findings, and link resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, urls
from ..operators import checks, modules, roadmap, rollups
from ..sources.driver_views import table, view
from .crawl import _ALL, BOTH


@query("findings_by_priority", f"SELECT 'sitewide' AS module, " + ", ".join(f"count(*) FILTER (WHERE priority = '{p}') AS {p.lower()}" for p in rollups.PRIORITIES) + f" FROM ({_ALL}) WHERE affected > 0", BOTH)
def priorities(spark, sf_dir):
    return rollups.by_priority(checks.findings(view(spark, sf_dir, "crawl_pages"), view(spark, sf_dir, "crawl_links")), "module")


@query("findings_merged")
def findings_merged(spark, sf_dir):
    page = modules.findings(modules.evaluate(view(spark, sf_dir, "rich_pages"), rollups.profile("quick")))
    return rollups.merged([page, checks.findings(view(spark, sf_dir, "crawl_pages"), view(spark, sf_dir, "crawl_links"))])


@query(
    "top_with_remainder",
    """SELECT query, impressions, 1 AS "rows" FROM (SELECT * FROM search_rows ORDER BY impressions DESC, ordinal LIMIT 15)
UNION ALL SELECT 'others', CAST(sum(impressions) AS BIGINT), count(*) FROM (SELECT *, row_number() OVER (ORDER BY impressions DESC, ordinal) AS place FROM search_rows) WHERE place > 15 HAVING count(*) > 0""",
    ("search_rows",),
)
def remainder(spark, sf_dir):
    return rollups.top_with_remainder(view(spark, sf_dir, "search_rows"), [F.desc("impressions"), F.col("ordinal")], "query", "impressions", 15)


@query("soft_missing", r"SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 6 = 1 THEN '404 Page Not Found' WHEN page_id % 6 = 2 THEN 'Why a page not found error is not the end of the world for us' ELSE 'Fine' END AS title FROM pages) WHERE title = '404 Page Not Found'")
def soft_missing(spark, sf_dir):
    title = F.when(F.col("page_id") % 6 == 1, "404 Page Not Found").when(F.col("page_id") % 6 == 2, "Why a page not found error is not the end of the world for us").otherwise("Fine")
    return table(spark, sf_dir, "pages").filter(rollups.soft_missing(F.lit(200), title)).select("page_id")


@query("links_resolved", """SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || split_part(href, '#', 1) AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)""")
def links_resolved(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return rows.select("page_id", urls.resolve(F.col("url"), F.col("href")).alias("target"))


@query(
    "canonical_states",
    """SELECT page_id, rtrim(c, '/') = rtrim(url, '/') AS is_self, CASE WHEN ends_with(c, '/') = ends_with(url, '/') THEN false WHEN rtrim(c, '/') = rtrim(url, '/') THEN regexp_extract(rtrim(url, '/'), '^[a-z]+://[^/?#]*([^?#]*)', 1) <> '' ELSE true END AS slash_mismatch
FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN rtrim(url, '/') || '/' ELSE 'https://www.example.com/' END AS c FROM pages)""",
)
def canonicals(spark, sf_dir):
    c = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.rtrim(F.col("url"), F.lit("/")), F.lit("/"))).otherwise("https://www.example.com/")
    state = urls.canonical_state(c, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", state["self"].alias("is_self"), state["slash_mismatch"].alias("slash_mismatch"))


_TERMS = lambda x: f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in text.LINK_STOP_WORDS)})), lambda t: CASE WHEN ends_with(t, 's') AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END))"


@query(
    "queries_with_inferred_pages",
    f"""WITH asked AS (SELECT query, CASE WHEN ordinal % 2 = 0 THEN page ELSE '' END AS page, clicks, impressions, position, ordinal FROM search_rows), offered AS (SELECT url, unnest({_TERMS("replace(regexp_extract(url, '^https://[^/]*(.*)$', 1), '-', ' ') || ' ' || title")}) AS term FROM (SELECT DISTINCT 'https://shop.example/' || replace(p_name, ' ', '-') AS url, p_brand AS title FROM part)),
wanted AS (SELECT ordinal, unnest({_TERMS('query')}) AS term, len({_TERMS('query')}) AS terms FROM asked WHERE page = ''), shared AS (SELECT ordinal, url, any_value(terms) AS terms, count(*) AS n FROM wanted JOIN offered USING (term) GROUP BY ordinal, url),
best AS (SELECT ordinal, url, n, terms FROM shared QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, url) = 1), good AS (SELECT ordinal, url FROM best WHERE n >= 2 OR n = terms)
SELECT a.query, coalesce(g.url, a.page) AS page, a.clicks, a.impressions, a.position, a.ordinal, g.url IS NOT NULL AS inferred FROM asked a LEFT JOIN good g ON g.ordinal = a.ordinal""",
    ("search_rows",),
)
def inferred(spark, sf_dir):
    search = view(spark, sf_dir, "search_rows").withColumn("page", F.when(F.col("ordinal") % 2 == 0, F.col("page")).otherwise(""))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("https://shop.example/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"), F.col("p_brand").alias("title")).distinct()
    return roadmap.infer_pages(search, pages)
