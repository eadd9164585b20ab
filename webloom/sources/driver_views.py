"""Crawl, search and landing relations made from the driver's tables by fixed rules.

The driver tables carry no HTTP status, page-to-page links or search logs.  Each
view here is one SELECT that Spark and DuckDB read alike; ``view`` gives it as a
DataFrame, ``with_views`` as common table expressions for the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "crawl_pages": (
        ("pages",),
        """
SELECT page_id, url, title, meta_desc, status, error, response_ms, in_sitemap, word_count,
  CASE WHEN status = 200 AND page_id % 13 = 1 THEN 'application/pdf' WHEN status IS NULL THEN NULL ELSE 'text/html' END AS content_type,
  CASE WHEN status = 301 THEN CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE 'https://www.example.com/' END END AS redirect_to,
  CASE WHEN status = 200 AND page_id % 13 <> 1 AND page_id % 17 <> 6 THEN 1 ELSE 0 END AS indexable,
  CASE WHEN status = 200 THEN md5(lower(title)) END AS content_hash
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    CASE WHEN page_id % 5 = 2 THEN '' WHEN page_id % 5 = 4 THEN NULL ELSE 'About ' || substr(url, 1, 18) END AS meta_desc,
    CASE WHEN page_id % 23 = 7 THEN NULL WHEN page_id % 19 = 3 THEN 500 WHEN page_id % 11 = 5 THEN 404
         WHEN page_id % 29 = 2 THEN 403 WHEN page_id % 7 = 4 THEN 301 ELSE 200 END AS status,
    CASE WHEN page_id % 23 = 7 THEN CASE WHEN page_id % 2 = 0 THEN 'timed out' ELSE 'Blocked by robots.txt' END END AS error,
    CAST(page_id * 37 % 3000 AS INT) AS response_ms,
    CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS in_sitemap,
    CAST((length(html) - length(html) % 8) / 8 AS INT) AS word_count
  FROM pages) b""",
    ),
    "crawl_links": (
        ("crawl_pages",),
        """
SELECT s.url AS source, t.url AS target, t.title AS anchor, '' AS rel,
  CASE WHEN s.page_id % 9 = 8 THEN 'external' ELSE 'internal' END AS type
FROM (SELECT page_id, url, page_id + 1 AS to_id FROM crawl_pages WHERE status = 200
  UNION ALL SELECT page_id, url, page_id * 2 AS to_id FROM crawl_pages WHERE status = 200
  UNION ALL SELECT page_id, url, page_id + 6 AS to_id FROM crawl_pages WHERE status = 200) s
  JOIN crawl_pages t ON t.page_id = s.to_id WHERE t.page_id % 5 <> 0""",
    ),
    "search_rows": (
        ("lineitem", "part", "pages"),
        """
SELECT p.p_name AS query, g.url AS page, l.clicks, l.impressions, CAST(p.p_size AS DOUBLE) AS position, p.p_partkey AS ordinal
FROM (SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions FROM lineitem GROUP BY l_partkey) l
JOIN part p ON p.p_partkey = l.l_partkey JOIN (SELECT count(*) AS n FROM pages) c ON c.n > 0 JOIN pages g ON g.page_id = p.p_partkey % c.n""",
    ),
    "landing_rows": (
        ("events", "pages"),
        """
SELECT g.url AS page, CAST(count(*) AS BIGINT) AS sessions,
  CAST(sum(CASE WHEN e.event_type = 'click' OR (e.event_type = 'view' AND g.page_id % 3 = 0) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS engagement_rate,
  CAST(sum(CASE WHEN e.event_type IN ('purchase', 'signup') AND g.page_id % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS conversions
FROM events e JOIN (SELECT count(*) AS n FROM pages) c ON c.n > 0 JOIN pages g ON g.page_id = e.user_id % c.n
GROUP BY g.url""",
    ),
    "rich_pages": (
        ("pages",),
        """
SELECT page_id, url, html || CASE page_id % 4 WHEN 0 THEN '<meta name="description" content="All about it"><meta property="og:title" content="T"><meta property="og:image" content="i">' WHEN 1 THEN '<meta content="The other way round, and rather longer than the first one was, so that it reads well where it is shown to those who search for it: here." name="description">' WHEN 2 THEN '<meta name="robots" content="NOINDEX, follow"><h1>Again</h1>' ELSE '' END
 || CASE page_id % 5 WHEN 0 THEN '<link rel="canonical" href="/c"><link rel="preload" href="f"><link rel="manifest" href="m">' WHEN 1 THEN '<script type="application/ld+json">{"@type": "VideoObject", "name": "v", "uploadDate": "x"}</script><video src="v"></video>' WHEN 2 THEN '<script src="/jquery.min.js"></script><script src="/a/b.chunk.js" defer></script>' WHEN 3 THEN '<script type="module" src="/assets/main-abcdef12.js"></script><meta name="viewport" content="width=device-width">' ELSE '<img src="http://x.example/a.png"><img loading="lazy" src="b.webp"><img srcset="c 2x" src="c.png">' END
 || CASE page_id % 7 WHEN 0 THEN '<a href="#">x</a><a href="https://other.example/" target="_blank">o</a>' WHEN 1 THEN '<a href="mailto:a@b.org?subject=x">m</a><a href="#here">h</a><p id="here">' WHEN 2 THEN '<a href="mailto:nobody">m</a><a href="#gone">g</a><a href="https://other.example/y" rel="noopener" target="_blank">o</a>' WHEN 3 THEN '<a href="/privacy">p</a><a href="/cookie-policy">c</a><script>gtag(1)</script>' WHEN 4 THEN '<button onclick="go()">go</button><script src="https://cdn.cookiebot.example/uc.js"></script>' ELSE '<a href="tel:1">t</a>' END AS html
FROM pages""",
    ),
    "served_pages": (
        ("rich_pages",),
        """
SELECT page_id, url, html || CASE page_id % 3 WHEN 0 THEN '<script src="https://www.googletagmanager.com/gtag/js"></script><script>fbq(1); heap.load(2)</script>' WHEN 1 THEN '<script src="https://cdn.cookielaw.org/x.js"></script><script src="/_next/static/a.js"></script><style>p {font-display: swap}</style>' ELSE '<div id="root"></div><script>ttq = 1 // TikTok and prefers-reduced-motion</script>' END AS html,
  CASE WHEN page_id % 13 <> 12 AND page_id % 4 = 0 THEN 'default-src self; frame-ancestors none' END AS csp, CASE WHEN page_id % 13 <> 12 AND page_id % 4 < 2 THEN 'x' END AS csp_report,
  CASE WHEN page_id % 13 = 12 THEN NULL WHEN page_id % 5 = 0 THEN 'max-age=1' WHEN page_id % 5 = 1 THEN 'max-age=1; includeSubDomains' WHEN page_id % 5 = 2 THEN 'max-age=1; includeSubDomains; preload' END AS hsts,
  CASE WHEN page_id % 13 = 12 THEN NULL WHEN page_id % 3 = 0 THEN 'NoSniff' WHEN page_id % 3 = 1 THEN 'other' END AS nosniff,
  CASE WHEN page_id % 13 = 12 THEN NULL WHEN page_id % 6 = 0 THEN 'deny' WHEN page_id % 6 = 1 THEN 'SAMEORIGIN' WHEN page_id % 6 = 2 THEN 'ALLOW' END AS frames,
  CASE WHEN page_id % 13 = 12 THEN NULL WHEN page_id % 2 = 0 THEN 'no-referrer' WHEN page_id % 7 = 1 THEN '' END AS referrer,
  CASE WHEN page_id % 13 <> 12 AND page_id % 5 = 3 THEN 'camera=()' END AS permissions, CASE WHEN page_id % 13 <> 12 AND page_id % 11 = 2 THEN 'NOINDEX, nofollow' END AS robots_tag,
  CASE page_id % 4 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /assets/' WHEN 1 THEN 'User-agent: PerplexityBot' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'Disallow: /' WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /*.min.js$' END AS robots,
  CASE WHEN page_id % 2 = 0 THEN '# site' WHEN page_id % 5 = 0 THEN '' END AS llms
FROM rich_pages""",
    ),
    "shop_pages": (
        ("pages",),
        """
SELECT page_id, url, page_id % 6 AS k, html || CASE page_id % 6 WHEN 0 THEN '<meta content="Joe''s" property="og:site_name"><meta property="og:type" content="product"><meta property="product:price:amount" content="12.50"><a href="tel:+1 555">c</a><a href="https://www.facebook.com/joe?ref=1">f</a><a href="https://x.com/intent/x">s</a><a href="https://netflix.com/">n</a>'
 WHEN 1 THEN '<a href="tel:5">t</a><iframe src="https://maps.google.com/x"></iframe>' WHEN 2 THEN '<div class="product-card">a</div><div class="product-card">b</div> GBP 5'
 WHEN 3 THEN '<details><summary>Why <b>so</b>?</summary>Because  it is</details><details><summary>How?</summary></details>'
 WHEN 4 THEN '<script type="application/ld+json">{"@type": "Product", "name": "Thing", "offers": {"priceCurrency": "EUR"}, "aggregateRating": {"ratingValue": "4", "ratingCount": "9"}}</script>12 reviews, sold out'
 ELSE '<script type="application/ld+json">{"@graph": [{"@type": ["Organization", "WebSite"], "name": "Graph", "telephone": "123", "address": {"postalCode": "77"}}]}</script><nav class="breadcrumb">b</nav> in stock' END AS html
FROM pages""",
    ),
    "audit_history": (
        ("events",),
        """
SELECT event_type AS site, CAST(ts AS DATE) AS day,
  CAST(count(*) AS INT) AS issues_found,
  CAST(count(DISTINCT user_id) % 101 AS INT) AS seo, CAST(sum(event_id % 7) % 101 AS INT) AS security,
  CAST(sum(event_id % 11) % 101 AS INT) AS accessibility, CAST(sum(event_id % 13) % 101 AS INT) AS performance
FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation by name: a view over the driver's tables, or a table itself."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    inputs, sql = VIEWS[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for i in inputs:
        sql = _renamed(sql, i)
    return spark.sql(sql, **{f"t_{i}": view(spark, sf_dir, i) for i in inputs})


def _renamed(sql: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        for end in (" ", ")", "\n", "\x00"):
            sql = (sql + "\x00").replace(f"{word} {name}{end}", f"{word} {{t_{name}}}{end}").rstrip("\x00")
    return sql


def with_views(sql: str, *names: str) -> str:
    """SQL with the views it needs as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for i in VIEWS[name][0]:
                need(i)
            order.append(name)

    for n in names:
        need(n)
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    if not ctes:
        return sql
    head, rest = ("WITH RECURSIVE ", sql.lstrip()[len("WITH RECURSIVE ") :]) if sql.lstrip().startswith("WITH RECURSIVE ") else ("WITH ", sql.lstrip()[5:]) if sql.lstrip().startswith("WITH ") else ("", sql)
    return f"{head}{ctes}, {rest}" if head else f"WITH {ctes} {sql}"
