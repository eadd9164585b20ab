"""Queries over the crawl relations: checks, graph, link gaps, findings state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, urls
from ..operators import checks, graph, state
from ..sources.driver_views import table, view

BOTH = ("crawl_pages", "crawl_links")
INBOUND = "EXISTS (SELECT 1 FROM crawl_links l WHERE l.type = 'internal' AND l.target = p.url)"
OK = "status NOT IN (403, 429)"
FAILED = "(error IS NOT NULL AND error NOT ILIKE 'blocked%')"
#: Patterns that fit the driver's pages, whose paths begin with a language.
MONEY, CONTENT = r"/(en)(/|$)", r"/(es|fr|de)(/|$)"

COUNTS = {
    "server_5xx": "SELECT count(*) AS n FROM crawl_pages WHERE status >= 500",
    "broken_internal_links": f"SELECT count(*) AS n FROM crawl_links l JOIN crawl_pages p ON p.url = l.target WHERE l.type = 'internal' AND p.status >= 400 AND p.{OK}",
    "broken_4xx": f"SELECT count(*) AS n FROM crawl_pages WHERE status >= 400 AND status < 500 AND {OK}",
    "fetch_errors": f"SELECT count(*) AS n FROM crawl_pages WHERE {FAILED}",
    "duplicate_title": "SELECT coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM crawl_pages WHERE indexable = 1 AND title <> '' GROUP BY title HAVING count(*) > 1)",
    "duplicate_content": "SELECT coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM crawl_pages WHERE indexable = 1 AND content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1)",
    "duplicate_meta_desc": "SELECT coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM crawl_pages WHERE indexable = 1 AND meta_desc <> '' GROUP BY meta_desc HAVING count(*) > 1)",
    "orphan_pages": f"SELECT count(*) AS n FROM crawl_pages p WHERE p.status = 200 AND p.content_type = 'text/html' AND NOT {INBOUND}",
    "thin_content": "SELECT count(*) AS n FROM crawl_pages WHERE indexable = 1 AND word_count > 0 AND word_count < 200",
    "slow_pages": "SELECT count(*) AS n FROM crawl_pages WHERE response_ms > 2000",
    "internal_redirects": f"SELECT count(*) AS n FROM crawl_pages p WHERE p.status >= 300 AND p.status < 400 AND {INBOUND}",
    "sitemap_redirects": "SELECT count(*) AS n FROM crawl_pages WHERE in_sitemap = 1 AND status >= 300 AND status < 400",
    "sitemap_broken": f"SELECT count(*) AS n FROM crawl_pages WHERE in_sitemap = 1 AND ((status >= 400 AND {OK}) OR {FAILED})",
}
SLASH = {
    "internal_redirects": f"SELECT count(*) AS n FROM crawl_pages p WHERE p.status >= 300 AND p.status < 400 AND p.redirect_to = p.url || '/' AND {INBOUND}",
    "sitemap_redirects": "SELECT count(*) AS n FROM crawl_pages WHERE in_sitemap = 1 AND status >= 300 AND status < 400 AND redirect_to = url || '/'",
}


def crawl(spark, sf_dir):
    return view(spark, sf_dir, "crawl_pages"), view(spark, sf_dir, "crawl_links")


def _check(place: int, key: str) -> None:
    @query(f"chk_{place:02d}_{key}", f"SELECT '{key}' AS check_key, CAST(n AS BIGINT) AS affected FROM ({COUNTS[key]})", BOTH)
    def run(spark, sf_dir):
        rows = checks.affected(*crawl(spark, sf_dir), only=(key,))
        return rows.select(F.col("key").alias("check_key"), F.col("count").cast("long").alias("affected"))


for _place, _one in enumerate(checks.CHECKS, 1):
    _check(_place, _one.key)

_ALL = " UNION ALL ".join(f"SELECT '{c.key}' AS check_key, '{c.priority}' AS priority, '{c.title}' AS title, CAST(n AS BIGINT) AS affected FROM ({COUNTS[c.key]})" for c in checks.CHECKS)


@query("chk_14_slash_hops", " UNION ALL ".join(f"SELECT '{k}' AS check_key, CAST(n AS BIGINT) AS slash_hops FROM ({s})" for k, s in SLASH.items()), BOTH)
def slash_hops(spark, sf_dir):
    rows = checks.affected(*crawl(spark, sf_dir), only=tuple(SLASH))
    return rows.select(F.col("key").alias("check_key"), F.col("slash_hops").cast("long").alias("slash_hops"))


@query("chk_all_findings", f"SELECT check_key, priority, title, affected, substr(sha1('sitewide|' || title), 1, 10) AS id FROM ({_ALL}) WHERE affected > 0", BOTH)
def all_findings(spark, sf_dir):
    rows = checks.findings(*crawl(spark, sf_dir))
    return rows.select(F.col("key").alias("check_key"), "priority", "title", F.col("count").cast("long").alias("affected"), "id")


@query("chk_findings_text")
def findings_text(spark, sf_dir):
    return checks.findings(*crawl(spark, sf_dir))


@query(
    "chk_samples_slow",
    "SELECT CAST(place AS INT) AS place, sample FROM (SELECT url || '  (' || response_ms || 'ms)' AS sample, row_number() OVER (ORDER BY response_ms DESC, url || '  (' || response_ms || 'ms)') AS place FROM crawl_pages WHERE response_ms > 2000) WHERE place <= 8",
    ("crawl_pages",),
)
def slow_samples(spark, sf_dir):
    return checks.samples(*crawl(spark, sf_dir)).filter("key = 'slow_pages'").select("place", "sample")


@query(
    "dup_title_samples",
    """SELECT CAST(place AS INT) AS place, sample FROM (SELECT sample, row_number() OVER (ORDER BY copies DESC, sample) AS place FROM (
SELECT title || '  (' || count(*) || ' pages)' AS sample, count(*) AS copies FROM crawl_pages WHERE indexable = 1 AND title <> '' GROUP BY title HAVING count(*) > 1)) WHERE place <= 8""",
    ("crawl_pages",),
)
def duplicate_title_samples(spark, sf_dir):
    return checks.samples(*crawl(spark, sf_dir)).filter("key = 'duplicate_title'").select("place", "sample")


@query("dup_content_groups", "SELECT content_hash, string_agg(url, '  =  ' ORDER BY url) AS urls, count(*) AS copies FROM crawl_pages WHERE indexable = 1 AND content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1", ("crawl_pages",))
def duplicate_content(spark, sf_dir):
    pages = view(spark, sf_dir, "crawl_pages").filter("indexable = 1 and content_hash is not null")
    rows = pages.groupBy("content_hash").agg(F.expr("listagg(url, '  =  ') within group (order by url)").alias("urls"), F.count("*").alias("copies"))
    return rows.filter("copies > 1")


@query(
    "chk_stats",
    "SELECT (SELECT count(*) FROM crawl_pages) AS pages, (SELECT count(*) FROM crawl_pages WHERE indexable = 1) AS indexable, (SELECT count(*) FROM crawl_links WHERE type = 'internal') AS internal_links, (SELECT count(*) FROM crawl_pages WHERE in_sitemap = 1) AS in_sitemap",
    BOTH,
)
def stats(spark, sf_dir):
    return checks.stats(*crawl(spark, sf_dir))


@query("crawl_summary", "SELECT coalesce(CAST(status AS VARCHAR), 'error') AS status, count(*) AS pages, CAST(trunc(coalesce(avg(response_ms), 0)) AS INT) AS avg_response_ms FROM crawl_pages GROUP BY 1", ("crawl_pages",))
def crawl_summary(spark, sf_dir):
    return checks.summary(view(spark, sf_dir, "crawl_pages"))


@query("drill_origin_split", "SELECT in_sitemap, status, count(*) AS pages FROM crawl_pages WHERE status >= 300 GROUP BY in_sitemap, status", ("crawl_pages",))
def origin_split(spark, sf_dir):
    view(spark, sf_dir, "crawl_pages").createOrReplaceTempView("webloom_pages")
    return checks.drill_down(spark, "SELECT in_sitemap, status, count(*) AS pages FROM webloom_pages WHERE status >= 300 GROUP BY in_sitemap, status")


@query("drill_sitemap_only_redirects", f"SELECT url, status FROM crawl_pages p WHERE status BETWEEN 300 AND 399 AND NOT {INBOUND}", BOTH)
def sitemap_only(spark, sf_dir):
    pages, links = crawl(spark, sf_dir)
    return pages.filter("status between 300 and 399").join(checks.internal(links), F.col("url") == F.col("target"), "left_anti").select("url", "status")


@query("drill_long_titles", "SELECT url, CAST(length(title) AS INT) AS title_len FROM crawl_pages WHERE length(title) > 40", ("crawl_pages",))
def long_titles(spark, sf_dir):
    return view(spark, sf_dir, "crawl_pages").select("url", F.length("title").alias("title_len")).filter("title_len > 40")


@query("broken_link_pairs", f"SELECT DISTINCT l.source, l.target FROM crawl_links l JOIN crawl_pages p ON p.url = l.target WHERE l.type = 'internal' AND p.status >= 400 AND p.{OK}", BOTH)
def broken_pairs(spark, sf_dir):
    return checks.broken_links(*crawl(spark, sf_dir)).distinct()


@query("orphans", f"SELECT url FROM crawl_pages p WHERE p.status = 200 AND p.content_type = 'text/html' AND NOT {INBOUND}", BOTH)
def orphan_urls(spark, sf_dir):
    return checks.orphans(*crawl(spark, sf_dir)).select("url")


@query("linked_redirects", f"SELECT url, coalesce(redirect_to, '?') AS redirect_to FROM crawl_pages p WHERE p.status >= 300 AND p.status < 400 AND {INBOUND}", BOTH)
def redirects(spark, sf_dir):
    return checks.linked_redirects(*crawl(spark, sf_dir)).select("url", F.coalesce("redirect_to", F.lit("?")).alias("redirect_to"))


@query(
    "degree_in_out",
    "SELECT url, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links FROM (SELECT source AS url, 1 AS o, 0 AS i FROM crawl_links WHERE type = 'internal' UNION ALL SELECT target, 0, 1 FROM crawl_links WHERE type = 'internal') GROUP BY url",
    BOTH,
)
def degree(spark, sf_dir):
    return graph.degrees(view(spark, sf_dir, "crawl_links"))


@query("distinct_targets", "SELECT source, count(DISTINCT target) AS targets FROM crawl_links WHERE type = 'internal' GROUP BY source", BOTH)
def distinct_targets(spark, sf_dir):
    return checks.internal(view(spark, sf_dir, "crawl_links")).groupBy("source").agg(F.count_distinct("target").alias("targets"))


@query(
    "bfs_depth",
    """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM crawl_links WHERE type = 'internal'),
walk(url, depth) AS (SELECT url, 0 FROM crawl_pages WHERE page_id = 1 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.url WHERE w.depth < 5)
SELECT url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY url""",
    BOTH,
)
def bfs(spark, sf_dir):
    pages, links = crawl(spark, sf_dir)
    return graph.depths(links, pages.filter("page_id = 1").select("url"), 5)


#: Redirect hops made from pages: some lead on, some end, some turn back, some pages refresh to another or say that they aren't there.
HOPS = """SELECT 'u' || page_id AS url, CASE WHEN page_id % 4 = 3 THEN 200 WHEN page_id % 10 = 6 THEN 404 WHEN page_id % 3 = 0 THEN 302 ELSE 301 END AS status,
CASE WHEN page_id % 4 = 3 OR page_id % 10 = 6 THEN NULL WHEN page_id % 8 = 5 THEN 'u' || (page_id - 1) ELSE 'u' || (page_id + 1) END AS redirect_to,
CASE WHEN page_id % 12 = 7 THEN 'u' || (page_id + 2) END AS refresh_to, CASE WHEN page_id % 8 = 3 THEN 'Page not found' ELSE 'A page' END AS title FROM pages"""
CHAIN = f"""WITH RECURSIVE hops AS (SELECT url, status, coalesce(redirect_to, CASE WHEN status = 200 THEN refresh_to END) AS ahead, redirect_to IS NULL AND status = 200 AND refresh_to IS NOT NULL AS r, status = 200 AND title = 'Page not found' AS m FROM ({HOPS})),
c(start, path, statuses, ahead, looped, meta, soft) AS (
  SELECT url, [url], [status], ahead, false, r, m FROM hops WHERE ahead IS NOT NULL
  UNION ALL
  SELECT c.start, CASE WHEN list_contains(c.path, c.ahead) THEN c.path ELSE list_append(c.path, c.ahead) END, CASE WHEN list_contains(c.path, c.ahead) THEN c.statuses ELSE list_append(c.statuses, h.status) END,
    CASE WHEN list_contains(c.path, c.ahead) THEN NULL ELSE h.ahead END, list_contains(c.path, c.ahead), c.meta OR (NOT list_contains(c.path, c.ahead) AND coalesce(h.r, false)), CASE WHEN list_contains(c.path, c.ahead) THEN c.soft ELSE coalesce(h.m, false) END
  FROM c LEFT JOIN hops h ON h.url = c.ahead WHERE c.ahead IS NOT NULL AND len(c.path) <= 10),
chains AS (SELECT start, CAST(max(len(path)) - 1 AS INT) AS hops, arg_max(path, len(path)) AS path, arg_max(statuses, len(path)) AS statuses, bool_or(looped) AS looped, bool_or(meta) AS meta, arg_max(soft, len(path)) AS soft FROM c GROUP BY start)
"""


def hop_table(spark, sf_dir):
    return spark.sql(HOPS.replace("FROM pages", "FROM {t}"), t=table(spark, sf_dir, "pages"))


@query("redirect_chain", CHAIN + "SELECT start, hops, array_to_string(path, ' ') AS path, array_to_string(list_transform(statuses, lambda s: coalesce(CAST(s AS VARCHAR), '?')), ' ') AS statuses, looped, meta AS meta_refresh, soft AS soft_404 FROM chains")
def redirect_chain(spark, sf_dir):
    rows = graph.redirect_chains(hop_table(spark, sf_dir))
    return rows.select("start", "hops", F.array_join("path", " ").alias("path"), F.array_join(F.col("statuses").cast("array<string>"), " ", "?").alias("statuses"), F.col("loop").alias("looped"), "meta_refresh", "soft_404")


@query("redirect_chain_ends", CHAIN + "SELECT start, hops, path[-1] AS final_url, CAST(statuses[-1] AS INT) AS final_status, looped FROM chains")
def redirect_chain_ends(spark, sf_dir):
    return graph.redirect_chains(hop_table(spark, sf_dir)).select("start", "hops", "final_url", "final_status", F.col("loop").alias("looped"))


ISSUES = """SELECT start, 'P0' AS priority, 'Redirect loop' AS issue FROM chains WHERE looped UNION ALL SELECT start, 'P2', 'Redirect chain (' || hops || ' hops)' FROM chains WHERE hops >= 2
UNION ALL SELECT start, 'P2', 'Temporary redirect' FROM chains WHERE list_has_any(statuses[1:len(statuses) - 1], [302, 303, 307]) UNION ALL SELECT start, 'P2', 'Meta-refresh redirect' FROM chains WHERE meta
UNION ALL SELECT start, 'P1', 'Soft 404' FROM chains WHERE soft UNION ALL SELECT start, 'P1', 'Chain ends in HTTP ' || statuses[-1] FROM chains WHERE statuses[-1] >= 400"""


@query("redirect_issues", CHAIN + ISSUES)
def redirect_issues(spark, sf_dir):
    return graph.chain_issues(graph.redirect_chains(hop_table(spark, sf_dir)))


@query(
    "link_gaps",
    r"""SELECT g.url, CAST(coalesce(sum(s.impressions), 0) AS BIGINT) AS impressions FROM
(SELECT DISTINCT url FROM crawl_pages p WHERE status = 200 AND content_type = 'text/html' AND NOT regexp_matches(url, '^[a-z]+://[^/]*/(en)(/|\?|#|$)') AND regexp_matches(url, '^[a-z]+://[^/]*/(es|fr|de)(/|\?|#|$)')
  AND NOT EXISTS (SELECT 1 FROM crawl_links l JOIN crawl_pages m ON m.url = l.target WHERE l.source = p.url AND l.type = 'internal' AND m.status = 200 AND m.content_type = 'text/html' AND regexp_matches(m.url, '^[a-z]+://[^/]*/(en)(/|\?|#|$)'))) g
LEFT JOIN search_rows s ON s.page = g.url GROUP BY g.url""",
    (*BOTH, "search_rows"),
)
def link_gaps(spark, sf_dir):
    return graph.link_gaps(*crawl(spark, sf_dir), view(spark, sf_dir, "search_rows"), MONEY, CONTENT).select("url", "impressions")


_LINK_TERMS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in text.LINK_STOP_WORDS)})))"
_HTML = "status = 200 AND content_type = 'text/html'"
_MONEY_URL = r"regexp_matches(url, '^[a-z]+://[^/]*/(en)(/|\?|#|$)')"


@query(
    "link_gap_targets",
    rf"""WITH html AS (SELECT url, {_MONEY_URL} AS sells, regexp_matches(url, '^[a-z]+://[^/]*/(es|fr|de)(/|\?|#|$)') AS informs FROM crawl_pages WHERE {_HTML}),
gaps AS (SELECT DISTINCT url FROM html g WHERE informs AND NOT sells AND NOT EXISTS (SELECT 1 FROM crawl_links l JOIN html m ON m.url = l.target WHERE l.source = g.url AND l.type = 'internal' AND m.sells)),
ranked AS (SELECT page AS url, query, impressions, row_number() OVER (PARTITION BY page ORDER BY impressions DESC, ordinal) AS place FROM search_rows WHERE page <> '' AND query <> '' AND page IN (SELECT url FROM gaps)),
top AS (SELECT url, CAST(sum(impressions) AS BIGINT) AS impressions, string_agg(query, '; ' ORDER BY place) FILTER (WHERE place <= 3) AS queries FROM ranked GROUP BY url),
terms AS (SELECT DISTINCT url, unnest({_LINK_TERMS('query')}) AS term FROM ranked WHERE place <= 5), offers AS (SELECT url AS target, unnest({_LINK_TERMS("regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)")}) AS term FROM html WHERE sells),
best AS (SELECT url, target FROM (SELECT url, target, count(*) AS n FROM terms JOIN offers USING (term) GROUP BY url, target) QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, target) = 1)
SELECT g.url, CAST(coalesce(t.impressions, 0) AS BIGINT) AS impressions, coalesce(t.queries, '') AS top_queries, CASE WHEN t.impressions IS NULL THEN (SELECT min(url) FROM html WHERE sells) ELSE b.target END AS suggested_target FROM gaps g LEFT JOIN top t ON t.url = g.url LEFT JOIN best b ON b.url = g.url""",
    (*BOTH, "search_rows"),
)
def link_gap_targets(spark, sf_dir):
    return graph.link_gaps(*crawl(spark, sf_dir), view(spark, sf_dir, "search_rows"), MONEY, CONTENT)


@query("page_kinds", r"SELECT kind, count(*) AS pages FROM (SELECT CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*/(en)(/|\?|#|$)') THEN 'money' WHEN regexp_matches(url, '^[a-z]+://[^/]*/(es|fr|de)(/|\?|#|$)') THEN 'content' END AS kind FROM pages) GROUP BY kind")
def page_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(graph.page_kind(F.col("url"), MONEY, CONTENT).alias("kind")).agg(F.count("*").alias("pages"))


#: Two snapshots of per-page findings: what an earlier run left, and what the current run sees.
STATE = """SELECT substr(sha1('m' || (page_id % 5) || '|' || url), 1, 10) AS id, 'm' || (page_id % 5) AS module, url AS title, 'P' || (page_id % 4) AS priority,
CASE WHEN page_id % 6 = 0 THEN 'resolved' WHEN page_id % 11 = 1 THEN 'wontfix' ELSE 'open' END AS status, '2024-01-01' AS first_seen, '2024-01-02' AS last_seen,
CASE WHEN page_id % 6 = 0 THEN '2024-01-02' END AS resolved_at, CAST(NULL AS VARCHAR(200)) AS note FROM pages WHERE page_id % 3 <> 2"""
CURRENT = "SELECT substr(sha1('m' || (page_id % 5) || '|' || url), 1, 10) AS id, 'm' || (page_id % 5) AS module, url AS title, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'P' || (page_id % 3) END AS priority FROM pages WHERE page_id % 4 <> 1"
MERGED = f"""SELECT coalesce(s.id, c.id) AS id, coalesce(s.module, c.module) AS module, coalesce(nullif(c.priority, ''), s.priority) AS priority,
CASE WHEN s.id IS NULL OR (c.id IS NOT NULL AND s.status = 'resolved') THEN 'open' WHEN c.id IS NULL AND s.status = 'open' AND s.module <> 'm4' THEN 'resolved' ELSE s.status END AS status,
CASE WHEN s.id IS NULL THEN '2024-02-01' ELSE s.first_seen END AS first_seen, CASE WHEN c.id IS NOT NULL THEN '2024-02-01' ELSE s.last_seen END AS last_seen,
CASE WHEN s.id IS NULL THEN 'new' WHEN c.id IS NOT NULL AND s.status = 'resolved' THEN 'reopened' WHEN c.id IS NOT NULL AND s.status = 'open' THEN 'still_open'
  WHEN c.id IS NULL AND s.status = 'open' THEN CASE WHEN s.module <> 'm4' THEN 'resolved' ELSE 'skipped' END ELSE 'kept' END AS event
FROM ({STATE}) s FULL JOIN ({CURRENT}) c ON c.id = s.id"""


def merged(spark, sf_dir, before=None):
    """The current findings merged into a state, the snapshot by default."""
    pages = table(spark, sf_dir, "pages")
    read = lambda sql: spark.sql(sql.replace("FROM pages", "FROM {t}").replace("VARCHAR(200)", "STRING"), t=pages)
    scanned = spark.createDataFrame([("m0",), ("m1",), ("m2",), ("m3",)], "module string")
    return state.merge(read(STATE) if before is None else before, read(CURRENT), scanned, "2024-02-01")


@query("punch_merge", MERGED)
def punch_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("id", "module", "priority", "status", "first_seen", "last_seen", "event")


@query("punch_status_counts", f"SELECT event, status, count(*) AS findings FROM ({MERGED}) GROUP BY event, status")
def punch_counts(spark, sf_dir):
    return merged(spark, sf_dir).groupBy("event", "status").agg(F.count("*").alias("findings"))


@query("sitemap_counters", r"SELECT count(*) AS listed, count(DISTINCT lower(split_part(split_part(url, '#', 1), '?', 1))) AS unique_urls, count(*) FILTER (WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT LIKE '%.com') AS foreign_hosts FROM crawl_pages WHERE in_sitemap = 1", ("crawl_pages",))
def sitemap_counters(spark, sf_dir):
    listed = view(spark, sf_dir, "crawl_pages").filter("in_sitemap = 1")
    bare = F.lower(F.substring_index(F.substring_index("url", "#", 1), "?", 1))
    return listed.agg(F.count("*").alias("listed"), F.count_distinct(bare).alias("unique_urls"), F.count_if(~urls.netloc(F.col("url")).endswith(".com")).alias("foreign_hosts"))
