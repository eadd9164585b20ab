"""Queries that join pages laterally with what table functions read in them."""

from __future__ import annotations

from ..catalog import query
from ..functions import tables
from ..sources.driver_views import view


def _sql(spark, sf_dir, pages: str, sql: str):
    tables.register(spark)
    return spark.sql(sql, pages=view(spark, sf_dir, pages))


@query("lateral_links", """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS place, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || split_part(href, '#', 1) AS target FROM (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS k FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS hrefs FROM pages))""")
def lateral_links(spark, sf_dir):
    return _sql(spark, sf_dir, "pages", "SELECT p.page_id, l.place, l.target FROM {pages} p, LATERAL page_links(p.html, p.url, 'target,place') l")


@query("lateral_json_ld", """SELECT page_id, unnest(regexp_extract_all(html, '"@type": "([A-Za-z]+)"', 1)) AS type FROM rich_pages""", ("rich_pages",))
def lateral_json_ld(spark, sf_dir):
    return _sql(spark, sf_dir, "rich_pages", "SELECT p.page_id, n.type FROM {pages} p, LATERAL page_json_ld(p.html, 'type') n")


@query(
    "lateral_questions",
    r"""SELECT page_id, CAST(k AS INT) AS place, regexp_replace(regexp_extract(d, '<summary>(.*?)</summary>', 1), '<[^>]+>', '', 'g') AS question, trim(regexp_replace(regexp_extract(d, '</summary>(.*?)</details>', 1), '\s+', ' ', 'g')) AS answer
FROM (SELECT page_id, unnest(ds) AS d, generate_subscripts(ds, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<details>.*?</details>') AS ds FROM shop_pages))""",
    ("shop_pages",),
)
def lateral_questions(spark, sf_dir):
    return _sql(spark, sf_dir, "shop_pages", "SELECT p.page_id, q.* FROM {pages} p, LATERAL page_questions(p.html) q")
