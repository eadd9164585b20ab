"""Queries that read signals from page HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, urls
from ..sources.driver_views import table

_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query("page_title_len", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS INT) AS title_len FROM pages")
def titles(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(title).alias("title_len"))


@query("page_html_kb", "SELECT page_id, round_even(strlen(html) / 1024.0::DOUBLE, 1) AS html_kb FROM pages")
def html_kb(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.bround(F.octet_length("html") / F.lit(1024.0), 1).alias("html_kb"))


_HEADINGS = ", ".join(f"CAST(len(regexp_extract_all(html, '(?i)<h{k}[\\s>]')) AS INT) AS h{k}" for k in range(1, 4))


@query("page_heading_counts", f"SELECT page_id, {_HEADINGS} FROM pages")
def headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(rf"(?i)<h{k}[\s>]")).alias(f"h{k}") for k in range(1, 4)])


@query("page_visible_words", f"SELECT page_id, CAST(len(list_filter(regexp_split_to_array({_VISIBLE}, '\\s+'), lambda w: w <> '')) AS INT) AS words FROM pages")
def visible_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.word_count(text.visible_text(F.col("html"))).alias("words"))


_LINKS = "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages"


def links(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", urls.netloc(F.col("url")).alias("host"), found.alias("href"))


@query("links_extract", f"SELECT page_id, href, count(*) AS times FROM ({_LINKS}) GROUP BY page_id, href")
def extract(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("times"))


@query("links_class_counts", f"SELECT page_id, CASE WHEN NOT regexp_matches(href, '^([a-zA-Z]+:)?//') OR lower(regexp_extract(href, '^[a-zA-Z]*:?//([^/?#]*)', 1)) = host THEN 'internal' ELSE 'external' END AS kind, count(*) AS links FROM ({_LINKS}) GROUP BY 1, 2")
def classes(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", urls.link_class(F.col("href"), F.col("host")).alias("kind")).agg(F.count("*").alias("links"))


@query("links_top_targets", f"SELECT href, count(DISTINCT page_id) AS pages FROM ({_LINKS}) GROUP BY href ORDER BY pages DESC, href LIMIT 25")
def top_targets(spark, sf_dir):
    return links(spark, sf_dir).groupBy("href").agg(F.count_distinct("page_id").alias("pages")).orderBy(F.desc("pages"), "href").limit(25)


@query("page_title_h1_overlap", "SELECT page_id, len(list_intersect(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: length(w) > 3), list_filter(regexp_split_to_array(lower(h), '\\s+'), lambda w: length(w) > 3))) > 0 AS shares_words FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)")
def title_h1(spark, sf_dir):
    long = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)
    t, h = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.arrays_overlap(long(t), long(h)).alias("shares_words"))
