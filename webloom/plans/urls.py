"""Queries over URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import urls
from ..sources.driver_views import table

_PARTS = r"SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages"
_TRACKED = "regexp_matches(lower(x), '^(" + "|".join(urls.TRACKING_PARAMS) + ")(=|$)|^(" + "|".join(urls.TRACKING_PREFIXES) + ")')"
_CLEAN = f"array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT {_TRACKED})), '&')"


def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query("url_normalise", f"SELECT page_id, CASE WHEN s IN ('http', 'https') THEN s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN c = '' THEN '' ELSE '?' || c END END AS crawl_key FROM (SELECT *, {_CLEAN} AS c FROM ({_PARTS}))")
def normalise(spark, sf_dir):
    return page_urls(spark, sf_dir).select("page_id", urls.crawl_key(F.col("url")).alias("crawl_key"))


@query("url_tracking_strip", f"SELECT page_id, {_CLEAN} AS query FROM ({_PARTS}) WHERE q <> ''")
def tracking(spark, sf_dir):
    q = urls.query(F.col("url"))
    return page_urls(spark, sf_dir).filter(q != "").select("page_id", urls.clean_query(q).alias("query"))


@query("url_plain_key", f"SELECT page_id, s || '://' || h || CASE WHEN p <> '/' AND ends_with(p, '/') THEN rtrim(p, '/') ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS plain_key FROM ({_PARTS})")
def plain(spark, sf_dir):
    return page_urls(spark, sf_dir).select("page_id", urls.plain_key(F.col("url")).alias("plain_key"))


@query("url_host_regdomain", f"SELECT h AS host, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS domain, count(*) AS pages FROM ({_PARTS}) GROUP BY h")
def domains(spark, sf_dir):
    host = urls.netloc(F.col("url"))
    return page_urls(spark, sf_dir).groupBy(host.alias("host")).agg(F.count("*").alias("pages")).select("host", urls.registered_domain(F.col("host")).alias("domain"), "pages")


@query("url_in_scope", f"SELECT count(*) FILTER (WHERE array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') = 'example.com') AS in_scope, count(*) AS pages FROM ({_PARTS})")
def scope(spark, sf_dir):
    return page_urls(spark, sf_dir).agg(F.count_if(urls.in_scope(F.col("url"), "www.example.com")).alias("in_scope"), F.count("*").alias("pages"))


@query(
    "url_issues",
    f"""SELECT issue, count(*) AS pages FROM (SELECT unnest(list_filter([CASE WHEN contains(p, '_') THEN 'underscores_in_url' END, CASE WHEN p <> lower(p) THEN 'uppercase_in_url' END, CASE WHEN contains(p, '//') THEN 'double_slashes_in_url' END,
CASE WHEN q <> '' AND NOT regexp_matches(p, '/api/|/search|/filter|/callback') THEN 'query_params_on_content_page' END], lambda x: x IS NOT NULL)) AS issue FROM ({_PARTS})) GROUP BY issue""",
)
def issues(spark, sf_dir):
    return page_urls(spark, sf_dir).select(F.explode(urls.structure_issues(F.col("url"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("pages"))
