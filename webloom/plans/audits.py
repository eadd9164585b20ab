"""Queries over module detection, capped scores, crawl parsing, comparisons, styles, documents and crawl control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import pictures, urls
from ..operators import checks, compare, crawler, crawlpage, detection, modules, report, scored, style, usermodules
from ..sources import documents, sinks, sitemaps
from ..sources.driver_views import table, view
from .modules import _WEIGHTS, SEO, _has, _weighted
from .reports import ALL, BODY, HEAD, PARTS, SCORES
from .signals import served

RICH = ("rich_pages",)
Q, NQ = "[\"'']", "[^\"'']"

# --- detection and scores --------------------------------------------------------

_SEEN = ", ".join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN '{name}' END" for name, p in detection.SIGNS.items())
_GIVEN = ", ".join(f"'{m}'" for m in (*detection.ALWAYS, "local_seo", "pwa"))


@query("module_detection", f"SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(list_concat([{_GIVEN}], list_filter([{_SEEN}], lambda m: m IS NOT NULL))), lambda m: m <> 'links')), ',') AS modules FROM rich_pages", RICH)
def module_detection(spark, sf_dir):
    found = detection.modules_for(F.col("html"), "landing_page", ["pwa"], ["links"])
    return view(spark, sf_dir, "rich_pages").select("page_id", F.array_join(found, ",").alias("modules"))


# --- scored documents ------------------------------------------------------------


def _paragraphs(html: str, url: str) -> dict:
    """A module as a user writes one: it can't read pages whose length is divisible by three."""
    if len(html) % 3 == 0:
        raise ValueError("unreadable")
    n = html.count("<p")
    return {"points": {"paragraphs": min(10, n)}, "findings": [("P2", "Few paragraphs")] if n < 4 else [], "details": {"paragraphs": n, "where": [url]}}


usermodules.register(usermodules.UserModule("paragraphs", _paragraphs))
SCORED_MODULES = ["seo", "security", "pwa", "paragraphs"]
_PWA_ON = f"({_has(next(iter(_WEIGHTS['pwa'])))} OR {_has(modules.WORKER)})"
_PARAGRAPHS, _FAILS = "CAST((length(html) - length(replace(html, '<p', ''))) / 2 AS INT)", "length(html) % 3 = 0"


def scored_documents(spark, sf_dir, ids=SCORED_MODULES):
    return scored.documents(view(spark, sf_dir, "rich_pages"), ids)


def _twin_of_scored() -> str:
    pwa = _weighted("pwa").replace(" FROM rich_pages", ", page_id AS k FROM rich_pages")
    return f"""WITH parts AS ({PARTS}), scored AS ({SCORES}), r AS (SELECT page_id, html, {_PARAGRAPHS} AS n, {_FAILS} AS fails, {_PWA_ON} AS pwa FROM rich_pages), capped AS (SELECT s.page_id, CAST({_P0.replace('page_id', 's.page_id')} AS BIGINT) AS p0,
 CAST(round_even(seo * 0.40::DOUBLE + round_even((seo + accessibility + performance) / 3::DOUBLE, 0) * 0.25::DOUBLE + accessibility * 0.15::DOUBLE + performance * 0.20::DOUBLE, 0) AS INT) AS uncapped, s.seo FROM scored s JOIN rich_pages r ON r.page_id = s.page_id)
SELECT c.page_id, c.seo, CAST(least(uncapped, CASE WHEN p0 > 0 THEN 59 ELSE 100 END) AS INT) AS overall, p0 > 0 AND uncapped > 59 AS cap_applied, m.total AS seo_total, CASE WHEN r.pwa THEN w.total END AS pwa_total, CASE WHEN NOT fails THEN least(10, n) END AS paragraphs_total,
 CASE WHEN NOT fails THEN n END AS paragraphs, CASE WHEN fails THEN 'ValueError: unreadable' END AS paragraphs_error, c.p0 AS p0 FROM capped c JOIN r ON r.page_id = c.page_id JOIN ({SEO}) m ON m.page_id = c.page_id JOIN ({pwa}) w ON w.k = c.page_id"""


@query("scanned_modules", f"SELECT page_id, array_to_string(list_sort(list_filter(['accessibility', 'core', 'performance', 'security', 'seo', CASE WHEN {_PWA_ON} THEN 'pwa' END, CASE WHEN NOT {_FAILS} THEN 'paragraphs' END], lambda m: m IS NOT NULL)), ',') AS modules FROM rich_pages", RICH)
def scanned(spark, sf_dir):
    """What each page's document assessed: a module that failed there isn't among it."""
    found = scored_documents(spark, sf_dir).select("page_id", F.to_json("document").alias("document"))
    return found.select("page_id", F.array_join(detection.scanned_modules(F.col("document")), ",").alias("modules"))


_PWA = (("No web app manifest", "P3"), ("No theme colour", "P2"), ("No touch icon", "P2"), ("No service worker", "P1"), ("No viewport", "P1"))
_PWA_FOUND = " UNION ALL ".join(f"SELECT page_id, 'pwa' AS module, '{p}' AS priority, '{t}' AS title FROM rich_pages WHERE {_PWA_ON} AND NOT {_has(x)}" for (t, p), x in zip(_PWA, _WEIGHTS["pwa"], strict=True))
_FOUND = f"{_PWA_FOUND} UNION ALL SELECT page_id, 'paragraphs', 'P2', 'Few paragraphs' FROM rich_pages WHERE NOT {_FAILS} AND {_PARAGRAPHS} < 4"


@query("scores_findings", f"SELECT page_id, module, priority, title, '' AS description, '' AS fix, '' AS effort FROM ({_FOUND})", RICH)
def scores_findings(spark, sf_dir):
    """The findings read back from documents, every other one under "report"."""
    found = scored_documents(spark, sf_dir, ["pwa", "paragraphs"]).select("page_id", F.to_json("document").alias("d"))
    wrapped = found.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"report":'), "d", F.lit("}"))).otherwise(F.col("d")).alias("document"))
    return documents.findings(wrapped, "page_id")


@query("scored_findings", f"SELECT page_id, module, priority, title, substr(sha1(module || '|' || title), 1, 10) AS id FROM ({_FOUND})", RICH)
def scored_findings(spark, sf_dir):
    return scored.findings(scored_documents(spark, sf_dir, ["pwa", "paragraphs"]))


def capped(spark, sf_dir):
    pages = view(spark, sf_dir, "rich_pages")
    categories = report.category_scores(report.analyse(pages)).select("page_id", "seo", "security", "security_assessed", "accessibility", "performance")
    found = modules.findings(modules.evaluate(pages, [m for m in detection.CAPPING if m in modules.MODULES]))
    return detection.capped_scores(categories, found)


_P0 = f"CASE WHEN page_id % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(html, '(?is)(?:src|action)={Q}http://{NQ}+{Q}') THEN 1 ELSE 0 END + CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) = '' THEN 1 ELSE 0 END"


@query(
    "capped_scores",
    f"""WITH parts AS ({PARTS}), scored AS ({SCORES}) SELECT page_id, p0, CAST(least(uncapped, CASE WHEN p0 > 0 THEN 59 ELSE 100 END) AS INT) AS overall, p0 > 0 AND uncapped > 59 AS cap_applied FROM (SELECT s.page_id, CAST({_P0.replace('page_id', 's.page_id')} AS BIGINT) AS p0,
 CAST(round_even(seo * 0.40::DOUBLE + round_even((seo + accessibility + performance) / 3::DOUBLE, 0) * 0.25::DOUBLE + accessibility * 0.15::DOUBLE + performance * 0.20::DOUBLE, 0) AS INT) AS uncapped FROM scored s JOIN rich_pages r ON r.page_id = s.page_id)""",
    RICH,
)
def capped_scores(spark, sf_dir):
    return capped(spark, sf_dir).select("page_id", "p0", "overall", "cap_applied")


@query("scored_documents", _twin_of_scored(), RICH)
def scored_document_parts(spark, sf_dir):
    """Parts of the documents: categories, the capped grade, modules of any shape, the error of one that failed."""
    p = scored.part
    return scored_documents(spark, sf_dir).select(
        "page_id", p("$.seo.score", "int").alias("seo"), p("$.overall.score", "int").alias("overall"), p("$.overall.cap_applied", "boolean").alias("cap_applied"), p("$.module_scores.seo.total", "int").alias("seo_total"), p("$.module_scores.pwa.total", "int").alias("pwa_total"),
        p("$.module_scores.paragraphs.points.paragraphs", "int").alias("paragraphs_total"), p("$.module_scores.paragraphs.details.paragraphs", "int").alias("paragraphs"), p("$.module_scores.paragraphs.error", "string").alias("paragraphs_error"), p("$.summary.P0", "bigint").alias("p0"),
    )


@query("category_list", f"WITH parts AS ({PARTS}), scored AS ({SCORES}) SELECT page_id, 'SEO' AS label, seo AS score, '' AS note FROM scored UNION ALL SELECT page_id, 'Security', NULL, 'not assessed' FROM scored UNION ALL SELECT page_id, 'Performance', performance, 'heuristic' FROM scored UNION ALL SELECT page_id, 'Accessibility', accessibility, '' FROM scored", RICH)
def category_list(spark, sf_dir):
    return detection.category_list(report.category_scores(report.analyse(view(spark, sf_dir, "rich_pages"))))


# --- pages as a crawl and as content checks read them ----------------------------------

_ATTR = lambda name: f"regexp_extract(t, '\\b{name}=\"([^\"]*)\"', 1)"
_CRAWL_TEXT = "regexp_replace(regexp_replace(html, '(?s)<(?:script|style|noscript|template|svg)[ >].*?</(?:script|style|noscript|template|svg)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@query(
    "crawl_parse",
    f"""WITH parts AS ({PARTS}) SELECT p.page_id, h.title, coalesce(h.description, '?') AS meta_desc, coalesce(CASE h.robots WHEN 'noindex, follow' THEN 'NOINDEX, follow' ELSE h.robots END, '?') AS robots, h.canonicals > 0 AS has_canonical, CAST(len(list_filter(hs, lambda x: x = 1)) AS INT) AS h1s, CAST(len(list_filter(hs, lambda x: x = 2)) AS INT) AS h2_count,
 b.images, CAST(len(list_filter(imgs, lambda t: {_ATTR('alt')} = '')) AS INT) AS images_no_alt, CAST(len(list_filter(anchors, lambda t: {_ATTR('href')} <> '')) AS INT) AS links, h.json_ld AS jsonld_count, CAST(CASE WHEN h.og_keys <> '' THEN 1 ELSE 0 END AS INT) AS og_present, b.blank_unsafe AS blank_no_noopener,
 CAST(len(list_filter(string_split_regex(replace({_CRAWL_TEXT}, '&nbsp;', ' '), '\\s+'), lambda w: w <> '')) AS INT) AS word_count FROM parts p JOIN ({HEAD}) h USING (page_id) JOIN ({BODY}) b USING (page_id)""",
    RICH,
)
def crawl_parse(spark, sf_dir):
    rows = crawlpage.crawl_rows(view(spark, sf_dir, "rich_pages"))
    same = ["images", "images_no_alt", "jsonld_count", "og_present", "blank_no_noopener", "word_count", "h2_count"]
    return rows.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("meta_desc", F.lit("?")).alias("meta_desc"), F.coalesce("robots", F.lit("?")).alias("robots"), F.col("canonical").isNotNull().alias("has_canonical"), F.size("h1").alias("h1s"), F.size("links").alias("links"), *same)


@query(
    "body_parts",
    f"""WITH parts AS ({PARTS}) SELECT page_id, h.title, b.words, CAST(len(hs) AS INT) AS headings, CAST(len(list_filter(hs, lambda x: x = 1)) AS INT) AS h1s, coalesce(h.description, '') AS meta_description FROM parts JOIN ({HEAD}) h USING (page_id) JOIN ({BODY}) b USING (page_id)""",
    RICH,
)
def body_parts(spark, sf_dir):
    rows = crawlpage.text_parts(view(spark, sf_dir, "rich_pages").withColumn("html", F.regexp_replace("html", "<", " <")))
    words = F.size(F.filter(F.split("body_text", r"(?U)\s+"), lambda w: w != ""))
    return rows.select("page_id", F.trim("title").alias("title"), words.alias("words"), F.size("headings").alias("headings"), F.size("h1_texts").alias("h1s"), "meta_description")


SHELL = "'<html><head></head><body><div id=\"root\"></div></body></html>'"


@query(
    "render_gap",
    f"""WITH parts AS ({PARTS}) SELECT page_id, words >= 100 AND page_id % 3 = 0 AS content_client_only, title <> '' AND page_id % 3 = 0 AS title_client_only, coalesce(description, '') <> '' AND page_id % 3 = 0 AS meta_description_client_only, canonicals > 0 AND page_id % 3 = 0 AS canonical_client_only, len(list_filter(hs, lambda x: x = 1)) > 0 AND page_id % 3 = 0 AS h1_client_only,
 json_ld > 0 AND page_id % 3 = 0 AS structured_data_client_only, CASE WHEN page_id % 3 > 0 THEN 'none' WHEN words >= 100 OR len(list_filter(hs, lambda x: x = 1)) > 0 THEN 'critical' WHEN title <> '' OR coalesce(description, '') <> '' OR canonicals > 0 THEN 'high' ELSE 'none' END AS severity,
 CASE WHEN page_id % 3 > 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN words >= 100 THEN 'body content' END, CASE WHEN title <> '' THEN 'title' END, CASE WHEN coalesce(description, '') <> '' THEN 'meta description' END, CASE WHEN canonicals > 0 THEN 'canonical' END, CASE WHEN len(list_filter(hs, lambda x: x = 1)) > 0 THEN 'H1' END, CASE WHEN json_ld > 0 THEN 'structured data' END], lambda x: x IS NOT NULL), ', ') END AS missing FROM ({ALL})""",
    RICH,
)
def render_gap(spark, sf_dir):
    pages = view(spark, sf_dir, "rich_pages")
    shell = pages.withColumn("html", F.expr(f"CASE WHEN page_id % 3 = 0 THEN {SHELL} ELSE html END"))
    return compare.render_gap(report.analyse(shell), report.analyse(pages))


@query("link_class_variants", """SELECT kind, prefix_rule, module_rule, count(*) AS links FROM (SELECT CASE WHEN h = '' OR h = host THEN 'internal' ELSE 'external' END AS kind,
 CASE WHEN href = '' OR starts_with(href, '#') OR starts_with(href, 'javascript:') THEN 'none' WHEN regexp_matches(href, '^(https?:)?//') AND h <> host THEN 'external' ELSE 'internal' END AS prefix_rule, CASE WHEN h = '' OR rtrim(lower(h), '/') = rtrim(lower(host), '/') THEN 'internal' ELSE 'external' END AS module_rule
 FROM (SELECT href, regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM rich_pages))) GROUP BY ALL""", RICH)
def link_class_variants(spark, sf_dir):
    links = view(spark, sf_dir, "rich_pages").select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    host = urls.netloc(F.col("url"))
    kinds = urls.link_class(F.col("href"), host).alias("kind"), urls.link_class_by_prefix(F.col("href"), host).alias("prefix_rule"), urls.link_class_by_netloc(F.col("href"), host).alias("module_rule")
    return links.select(*kinds).groupBy("kind", "prefix_rule", "module_rule").agg(F.count("*").alias("links"))


# --- crawl control -----------------------------------------------------------------

#: Addresses that the documents name, in several spellings each: as it is, mapped, mapped with all digits, translated, tunnelled, and as the end of a public and of a local address.
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SPELLINGS = ("v4", "mapped", "long", "translated", "tunnelled", "public", "local")
_V4_SPECIAL = "(a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))"
_HEXES = "printf('%02x%02x:%02x%02x', a, b, c, d)"
_HOSTS = f"""SELECT ip, spelling, CASE spelling WHEN 'v4' THEN ip WHEN 'mapped' THEN '[::FFFF:' || ip || ']' WHEN 'long' THEN '0:0:0:0:0:ffff:' || {_HEXES} WHEN 'translated' THEN '64:ff9b::' || ip WHEN 'tunnelled' THEN '2002:' || {_HEXES} || '::1' WHEN 'public' THEN '2a00:1450:4001::' || {_HEXES} ELSE 'fe80::' || ip || '%eth0' END AS host, a, b, c, d
FROM (SELECT ip, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c, CAST(split_part(ip, '.', 4) AS INT) AS d FROM (SELECT DISTINCT ip FROM (SELECT unnest(regexp_extract_all(text, '{_IP}')) AS ip FROM documents) WHERE regexp_full_match(ip, '{crawler.addresses.V4}')))
CROSS JOIN (SELECT unnest([{', '.join(map(repr, _SPELLINGS))}]) AS spelling)"""


def spelt_hosts(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ip")).distinct().filter(F.col("ip").rlike(f"^{crawler.addresses.V4}$"))
    parts = [F.split_part("ip", F.lit("."), F.lit(k)).cast("int") for k in range(1, 5)]
    hexes = F.format_string("%02x%02x:%02x%02x", *parts)
    ways = [F.col("ip"), F.concat(F.lit("[::FFFF:"), "ip", F.lit("]")), F.concat(F.lit("0:0:0:0:0:ffff:"), hexes), F.concat(F.lit("64:ff9b::"), "ip"), F.concat(F.lit("2002:"), hexes, F.lit("::1")), F.concat(F.lit("2a00:1450:4001::"), hexes), F.concat(F.lit("fe80::"), "ip", F.lit("%eth0"))]
    return found.select("ip", F.explode(F.array(*[F.struct(F.lit(n).alias("spelling"), w.alias("host")) for n, w in zip(_SPELLINGS, ways, strict=True)])).alias("s")).select("ip", "s.*")


@query("host_blocked", f"SELECT host, CASE spelling WHEN 'public' THEN false WHEN 'translated' THEN true WHEN 'tunnelled' THEN true WHEN 'local' THEN true ELSE {_V4_SPECIAL} END AS blocked FROM ({_HOSTS})")
def host_blocked(spark, sf_dir):
    return spelt_hosts(spark, sf_dir).select("host", crawler.host_is_blocked(F.col("host")).alias("blocked"))


@query("names_blocked", f"SELECT host, bool_or(special) AS blocked FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN ip IS NULL THEN false ELSE {_V4_SPECIAL} END AS special FROM pages LEFT JOIN (SELECT * FROM ({_HOSTS}) WHERE spelling = 'v4') ON a % 7 = length(url) % 7) GROUP BY host")
def names_blocked(spark, sf_dir):
    """The hosts of the pages, each resolved to those addresses of the documents that a rule gives it."""
    hosts = table(spark, sf_dir, "pages").select("url", urls.netloc(F.col("url")).alias("host"))
    found = spelt_hosts(spark, sf_dir).filter("spelling = 'v4'").select("ip", (F.split_part("ip", F.lit("."), F.lit(1)).cast("int") % 7).alias("rest"))
    resolved = hosts.select("host", (F.length("url") % 7).alias("rest")).distinct().join(found, "rest").select("host", F.col("ip").alias("address")).distinct()
    return crawler.hosts_blocked(hosts.select("host").distinct(), resolved).select("host", "blocked")


@query("networks_matched", f"""WITH nets AS (SELECT DISTINCT CAST(a AS VARCHAR) || '.0.0.0/8' AS network, a, -1 AS b, 8 AS size FROM ({_HOSTS}) WHERE b % 2 = 0 UNION SELECT DISTINCT a || '.' || b || '.0.0/16', a, b, 16 FROM ({_HOSTS}) WHERE c % 2 = 0)
SELECT ip, first(network ORDER BY size DESC) AS network FROM (SELECT DISTINCT ip, a AS x, b AS y FROM ({_HOSTS})) LEFT JOIN nets ON nets.a = x AND (nets.b = y OR nets.b = -1) GROUP BY ip""")
def networks_matched(spark, sf_dir):
    """The documents' addresses and the longest network around each, of networks made from some of them."""
    found = spelt_hosts(spark, sf_dir).filter("spelling = 'v4'").select("ip")
    part = lambda k: F.split_part("ip", F.lit("."), F.lit(k))
    wide = found.filter(part(2).cast("int") % 2 == 0).select(F.concat(part(1), F.lit(".0.0.0/8")).alias("network"))
    narrow = found.filter(part(3).cast("int") % 2 == 0).select(F.concat(part(1), F.lit("."), part(2), F.lit(".0.0/16")).alias("network"))
    return crawler.addresses.longest_match(found, wide.union(narrow).distinct(), "ip").select("ip", "network")


@query("robots_simple", "SELECT page_id, page_id % 4 = 0 AS assets_blocked, page_id % 4 = 2 AS min_blocked FROM pages")
def robots_simple(spark, sf_dir):
    rows = served(spark, sf_dir)
    return rows.select("page_id", F.coalesce(crawler.disallowed_simply(F.col("robots"), F.lit("/assets/x.js")), F.lit(False)).alias("assets_blocked"), F.coalesce(crawler.disallowed_simply(F.col("robots"), F.lit("/*.min.js$/x")), F.lit(False)).alias("min_blocked"))


WAVES = "SELECT l_orderkey % 40 AS host, l_linenumber AS wave, count(*) AS total, sum(CASE WHEN l_partkey % 3 < l_orderkey % 4 THEN 1 ELSE 0 END) AS blocked FROM lineitem GROUP BY 1, 2"


@query(
    "throttle_delays",
    f"""WITH RECURSIVE waves AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY wave) AS place, total, blocked FROM ({WAVES})),
t(host, place, delay, stopped) AS (SELECT DISTINCT host, CAST(0 AS BIGINT), 0.5::DOUBLE, false FROM waves UNION ALL
 SELECT host, place, CASE WHEN stopped THEN before ELSE now END, stopped OR (now >= 6 AND share >= 0.9) FROM (SELECT t.host, w.place, t.delay AS before, t.stopped, w.blocked / w.total::DOUBLE AS share,
  CASE WHEN w.blocked / w.total::DOUBLE >= 0.3 THEN least(t.delay + 1, 6) WHEN w.blocked = 0 AND t.delay > 0.5 THEN greatest(0.5, t.delay - 0.25) ELSE t.delay END AS now FROM t JOIN waves w ON w.host = t.host AND w.place = t.place + 1))
SELECT host, arg_max(delay, place) AS delay, bool_or(stopped) AS stopped FROM t GROUP BY host""",
)
def throttle_delays(spark, sf_dir):
    waves = spark.sql(WAVES.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    ordered = waves.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("wave", "blocked", "total"))).alias("waves"))  # a host's waves: few rows
    return ordered.select("host", crawler.throttle(F.col("waves"), 0.5).alias("t")).select("host", "t.delay", "t.stopped")


@query(
    "crawl_frontier",
    """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM crawl_links), walk(url, depth) AS (SELECT url, 0 FROM crawl_pages WHERE page_id < 3 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.url WHERE w.depth < 2)
SELECT depth, count(*) AS pages FROM (SELECT url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY url) GROUP BY depth""",
    ("crawl_pages", "crawl_links"),
)
def crawl_frontier(spark, sf_dir):
    pages, links = view(spark, sf_dir, "crawl_pages"), view(spark, sf_dir, "crawl_links")
    names = pages.select("url", F.concat(F.lit("https://one.example/"), F.md5("url")).alias("as_url")).distinct()
    edges = links.select("source", "target").join(names.withColumnsRenamed({"url": "source", "as_url": "s"}), "source").join(names.withColumnsRenamed({"url": "target", "as_url": "t"}), "target").select(F.col("s").alias("source"), F.col("t").alias("target"))
    seeds = pages.filter("page_id < 3").join(names, "url").select(F.col("as_url").alias("url"))
    first = seeds.orderBy("url").first()["url"]
    return crawler.frontier(edges, first, seeds, 2, 100_000).groupBy("depth").agg(F.count("*").alias("pages"))


# --- styles, documents, sinks --------------------------------------------------------

CSS = "SELECT p_brand AS brand, p_partkey, 'a {color: #' || substr(md5(p_name), 1, 6) || '} b {background: #' || substr(md5(p_type), 1, 3) || '; font-family: ' || CASE p_partkey % 3 WHEN 0 THEN 'Arial, x' WHEN 1 THEN '\"Inter\", sans-serif' ELSE 'Lora' END || '}' AS css FROM part"


def css(spark, sf_dir):
    return spark.sql(CSS.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {t}"), t=table(spark, sf_dir, "part"))


_HEX = lambda k: f"CAST(('0x' || substr(long, {k}, 2)) AS INT) / 255::DOUBLE"


@query(
    "colour_palette",
    f"""SELECT p_partkey, coalesce(list_filter(ranked, lambda x: x.usable)[1].colour, '#1c211e') AS accent, array_to_string(list_transform(ranked[1:12], lambda x: x.colour), ',') AS palette FROM (SELECT p_partkey, list({{'colour': colour, 'usable': usable}} ORDER BY n DESC, pos) AS ranked FROM (
 SELECT *, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 <= 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END > 0.25 AND 1 - abs((hi + lo) / 2 - 0.45) > 0.35 AS usable FROM (SELECT *, greatest({_HEX(1)}, {_HEX(3)}, {_HEX(5)}) AS hi, least({_HEX(1)}, {_HEX(3)}, {_HEX(5)}) AS lo FROM (
 SELECT p_partkey, colour, count(*) AS n, min(ix) AS pos, CASE WHEN length(colour) = 4 THEN colour[2] || colour[2] || colour[3] || colour[3] || colour[4] || colour[4] ELSE substr(colour, 2) END AS long FROM (SELECT p_partkey, unnest(found) AS colour, unnest(range(len(found))) AS ix FROM (SELECT p_partkey, regexp_extract_all(css, '#(?:[0-9a-fA-F]{{6}}|[0-9a-fA-F]{{3}})\\b') AS found FROM ({CSS}))) GROUP BY p_partkey, colour))) GROUP BY p_partkey)""",
)
def colour_palette(spark, sf_dir):
    rows = style.palette(css(spark, sf_dir), "p_partkey")
    return rows.select("p_partkey", "accent", F.array_join("palette", ",").alias("palette"))


@query("font_families", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Inter' ELSE 'Lora' END AS families, CASE p_partkey % 3 WHEN 0 THEN 'Plus Jakarta Sans' WHEN 1 THEN 'Inter' ELSE 'Lora' END AS family FROM ({CSS})")
def font_families(spark, sf_dir):
    listed, first = style.fonts(F.col("css"))
    return css(spark, sf_dir).select("p_partkey", F.array_join(listed, ",").alias("families"), first.alias("family"))


_WIDTH = lambda x: f"round_even(list_sum(list_transform(string_split({x}, ''), lambda c: CASE WHEN c = ' ' THEN 3.3::DOUBLE WHEN contains('{style.NARROW.replace(chr(39), chr(39) * 2)}', c) THEN 4.5::DOUBLE WHEN contains('{style.WIDE}', c) THEN 9.0::DOUBLE WHEN regexp_matches(c, '^\\pL$') AND c <> lower(c) THEN 7.5::DOUBLE WHEN regexp_matches(c, '^[0-9]$') THEN 6.5::DOUBLE ELSE 6.3::DOUBLE END)) + 10, 1)"


@query("badges", f"SELECT p_partkey, CASE WHEN s >= 90 THEN '#4c1' WHEN s >= 75 THEN '#97ca00' WHEN s >= 60 THEN '#dfb317' WHEN s >= 40 THEN '#fe7d37' ELSE '#e05d44' END AS colour, {_WIDTH('p_name')} AS label_width, {_WIDTH('CAST(s AS VARCHAR)')} AS score_width FROM (SELECT p_partkey, p_name, p_partkey % 101 AS s FROM part)")
def badges(spark, sf_dir):
    parts = style.badge(F.col("p_name"), F.col("p_partkey") % 101)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in parts.items()])


#: Lab reports of pages as a tool writes them: what it measures is taken from the page itself; pages kept out of the index have no answer, those that load a library are refused.
_REFUSED, _SILENT = "contains(html, 'jquery')", "contains(lower(html), 'noindex')"
_IMAGES, _ANCHORS = "len(regexp_extract_all(html, '<img'))", "len(regexp_extract_all(html, '<a '))"


def speed(spark, sf_dir):
    """page_id, document."""
    n, html = F.length("html"), F.col("html")
    times = lambda p: F.regexp_count(html, F.lit(p))
    share = lambda x: (x % 1000).cast("double") / 1000
    lcp = F.struct(F.struct((n + F.lit(0.5)).alias("numericValue"), F.concat(n, F.lit(" s")).alias("displayValue"), F.lit("ms").alias("numericUnit")).alias("largest-contentful-paint"))
    form = F.when(F.contains(html, F.lit("viewport")), "mobile").otherwise("desktop")
    settings = F.struct(F.when(n % 2 == 0, form).alias("formFactor"), F.when(n % 2 == 1, form).alias("emulatedFormFactor"))
    inner = F.struct(settings.alias("configSettings"), F.struct(F.struct(share(n).alias("score")).alias("performance")).alias("categories"), lcp.alias("audits"))
    field = F.struct(F.struct(F.struct(times("<img").alias("percentile"), F.lit("FAST").alias("category")).alias("LCP")).alias("metrics"))
    own = F.struct(F.struct(share(n).alias("score")).alias("performance"), F.struct(share(times("<a ") * 5).alias("score")).alias("best-practices"), F.when(F.contains(html, F.lit('name="description"')), F.struct(F.lit(1).alias("score"))).alias("seo"))
    whole = F.to_json(F.struct(F.col("url").alias("id"), F.col("url").alias("requestedUrl"), F.lit("12").alias("lighthouseVersion"), own.alias("categories"), lcp.alias("audits"), inner.alias("lighthouseResult"), field.alias("loadingExperience")))
    return view(spark, sf_dir, "rich_pages").select("page_id", F.when(F.contains(F.lower(html), F.lit("noindex")), "").when(F.contains(html, F.lit("jquery")), '{"error": "quota"}').otherwise(whole).alias("document"))


def _measured(value: str) -> str:
    return f"CASE WHEN NOT {_SILENT} AND NOT {_REFUSED} THEN {value} END"


_SHARE = "CAST(round_even(({} % 1000) / 1000::DOUBLE * 100, 0) AS INT)"


@query(
    "lab_page_speed",
    f"""SELECT page_id, {_measured("url")} AS url, {_measured("CASE WHEN contains(html, 'viewport') THEN 'mobile' ELSE 'desktop' END")} AS strategy, {_measured(_SHARE.format("length(html)"))} AS performance, {_measured("length(html) + 0.5::DOUBLE")} AS lcp, {_measured("'ms'")} AS unit, {_measured(f"CAST({_IMAGES} AS DOUBLE)")} AS field_lcp,
 CASE WHEN {_SILENT} THEN 'Empty or invalid response' WHEN {_REFUSED} THEN 'quota' END AS error FROM rich_pages""",
    RICH,
)
def lab_page_speed(spark, sf_dir):
    rows = documents.page_speed(speed(spark, sf_dir), "page_id")
    return rows.select("page_id", "url", "strategy", "performance", F.col("metrics")["LCP"]["value"].alias("lcp"), F.col("metrics")["LCP"]["unit"].alias("unit"), F.col("field")["LCP"]["percentile"].alias("field_lcp"), "error")


@query("lab_reports", f"""SELECT page_id, {_measured(_SHARE.format("length(html)"))} AS performance, {_measured(_SHARE.format(f"({_ANCHORS} * 5)"))} AS best_practices, {_measured("CASE WHEN contains(html, 'name=\"description\"') THEN 100 END")} AS seo, {_measured("length(html) + 0.5::DOUBLE")} AS lcp FROM rich_pages""", RICH)
def lab_reports(spark, sf_dir):
    return documents.lab_report(speed(spark, sf_dir), "page_id").select("page_id", "performance", "best_practices", "seo", F.col("LCP").alias("lcp"))


_LISTED = r'<a [^>]*href="([^"]+)"[^>]*>([^<]*)</a>'


@query("site_lists", f"SELECT page_id, regexp_extract(t, '{_LISTED}', 1) AS url, CASE WHEN regexp_extract(t, '{_LISTED}', 2) = '' THEN regexp_extract(t, '{_LISTED}', 1) ELSE regexp_extract(t, '{_LISTED}', 2) END AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LISTED}')) AS t FROM pages)")
def site_lists(spark, sf_dir):
    """Each page's links as a list of sites, written as JSON and read back; a link without text has no name, and one entry has no url."""
    found = F.regexp_extract_all("html", F.lit(_LISTED), F.lit(0))
    entry = lambda t: F.struct(F.regexp_extract(t, _LISTED, 1).alias("url"), F.nullif(F.regexp_extract(t, _LISTED, 2), F.lit("")).alias("name"))
    nameless = F.array(F.struct(F.lit(None).cast("string").alias("url"), F.lit("no url").alias("name")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.concat(F.transform(found, entry), nameless)).alias("document"))
    return rows.select("page_id", F.explode(documents.sites(F.col("document"))).alias("s")).select("page_id", "s.url", "s.name")


def site_sitemaps(spark, sf_dir):
    """sitemap, xml: an index for each host of the pages, and its sitemaps of a hundred page numbers each, which name the index again."""
    pages = table(spark, sf_dir, "pages").select("url", urls.netloc(F.col("url")).alias("host"), F.floor(F.col("page_id") / 100).alias("part"))
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    parts = pages.groupBy("host", "part").agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>"))), "").alias("locs"))
    own = parts.select(F.concat("host", F.lit("-"), "part").alias("sitemap"), F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("xml"))
    listed = parts.groupBy("host").agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "host", F.lit("-"), "part", F.lit("</loc></sitemap>"))), "").alias("locs"))
    return own.unionByName(listed.select(F.col("host").alias("sitemap"), F.concat(F.lit("<sitemapindex>"), "locs", F.lit("<sitemap><loc>"), "host", F.lit("</loc></sitemap></sitemapindex>")).alias("xml")))


@query("sitemap_expanded", "SELECT url, min(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || '-' || CAST(page_id // 100 AS VARCHAR)) AS sitemap FROM pages GROUP BY url")
def sitemap_expanded(spark, sf_dir):
    starts = table(spark, sf_dir, "pages").select(urls.netloc(F.col("url")).alias("sitemap")).distinct()
    return sitemaps.expanded(site_sitemaps(spark, sf_dir), starts, None, None)


@query("sitemap_membership", "SELECT p.page_id, CAST(CASE WHEN p.url IN (SELECT url FROM pages WHERE page_id % 3 = 0) THEN 1 ELSE 0 END AS INT) AS in_sitemap FROM pages p")
def sitemap_membership(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return sinks.with_sitemap(pages, pages.filter("page_id % 3 = 0").select("url")).select("page_id", "in_sitemap")


def _pictures(texts):
    """name, png of texts' bytes as rows of 16 pixels."""

    def draw(batches):
        for batch in batches:
            pngs = []
            for text in batch["text"]:
                data = (text or "").encode()
                data += bytes(-len(data) % 48)
                pngs.append(pictures.encode_png(np.frombuffer(data, np.uint8).reshape(-1, 16, 3), (0, 1, 2, 3, 4)))
            yield pd.DataFrame({"name": batch["name"], "png": pngs})

    return texts.mapInPandas(draw, "name long, png binary")


_HEX = lambda text: f"regexp_extract_all(hex({text}), '.{{1,6}}')"  # noqa: E731  pixels of three bytes
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("picture_differences", f"""SELECT doc_id AS name, CASE WHEN lang = 'fr' THEN -1::DOUBLE WHEN len(a) = 0 THEN 0::DOUBLE ELSE len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) / ((len(a) + 15) // 16 * 16)::DOUBLE * 100 END AS difference
FROM (SELECT doc_id, lang, {_HEX("coalesce(text, '')")} AS a, {_HEX(_LOWER)} AS b FROM documents)""")
def picture_differences(spark, sf_dir):
    """Each document's text as a picture, against one of the text in lower case where there was one: all but the French."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "lang", "text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    before = docs.filter("lang <> 'fr'").select("name", F.translate("text", upper, upper.lower()).alias("text"))
    return pictures.png_differences(_pictures(docs.select("name", "text")), _pictures(before))


@query("side_by_side", "SELECT o_orderpriority AS measure, CAST(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS BIGINT) AS f, CAST(max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS BIGINT) AS o, CASE WHEN max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) >= max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) THEN 'F' ELSE 'O' END AS leader FROM orders GROUP BY 1")
def side_by_side(spark, sf_dir):
    rows = compare.side_by_side(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", ["F", "O"])
    return rows.select(F.col("o_orderpriority").alias("measure"), F.col("F").cast("long").alias("f"), F.col("O").cast("long").alias("o"), "leader")


@query("audit_text_lines", """SELECT CAST(0 AS INT) AS line, 'Site-wide audit: ' || (SELECT count(*) FROM crawl_pages) || ' pages crawled, ' || (SELECT count(*) FROM crawl_pages WHERE indexable = 1) || ' indexable, ' || (SELECT count(*) FROM crawl_links WHERE type = 'internal') || ' internal links' AS text""", ("crawl_pages", "crawl_links"))
def audit_text_lines(spark, sf_dir):
    pages, links = view(spark, sf_dir, "crawl_pages"), view(spark, sf_dir, "crawl_links")
    return sinks.audit_text(checks.findings(pages, links), checks.stats(pages, links)).filter("line = 0")
