"""Queries over response headers, providers and the structured-data advisor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import advisor, headers, modules, nodegraph, providers
from ..sources.driver_views import view

#: The header columns of the view by header name.
HEADER_COLUMNS = {
    "Content-Security-Policy": "csp", "Content-Security-Policy-Report-Only": "csp_report", "Strict-Transport-Security": "hsts", "x-content-type-options": "nosniff", "X-Frame-Options": "frames", "Referrer-Policy": "referrer",
    "permissions-policy": "permissions", "X-Robots-Tag": "robots_tag",
}
Q, NQ = "[\"'']", "[^\"'']"


def served(spark, sf_dir):
    rows = view(spark, sf_dir, "served_pages")
    given = F.map_filter(F.create_map(*[x for name, c in HEADER_COLUMNS.items() for x in (F.lit(name), F.col(c))]), lambda _, v: v.isNotNull())
    return rows.select("page_id", "url", "html", given.alias("headers"), "robots", "llms")


_CSP = "CASE WHEN csp IS NOT NULL THEN 30 WHEN csp_report IS NOT NULL THEN 13 ELSE 0 END"
_HSTS = "CASE WHEN hsts <> '' THEN 8 + CASE WHEN contains(lower(hsts), 'includesubdomains') THEN 5 ELSE 0 END + CASE WHEN contains(lower(hsts), 'preload') THEN 5 ELSE 0 END ELSE 0 END"
_FRAMES = "CASE WHEN upper(frames) IN ('DENY', 'SAMEORIGIN') OR contains(csp, 'frame-ancestors') THEN 8 ELSE 0 END"
_SEEN = "coalesce(csp, csp_report, hsts, nosniff, frames, referrer, permissions, robots_tag) IS NOT NULL"
_NOSNIFF, _REFERRER, _PERMISSIONS = "CASE WHEN lower(nosniff) = 'nosniff' THEN 8 ELSE 0 END", "CASE WHEN referrer <> '' THEN 8 ELSE 0 END", "CASE WHEN permissions IS NOT NULL THEN 13 ELSE 0 END"


@query(
    "security_headers",
    f"""SELECT page_id, CAST({_CSP} AS INT) AS csp, CAST({_HSTS} AS INT) AS hsts, CAST({_NOSNIFF} AS INT) AS x_content_type_options, CAST({_FRAMES} AS INT) AS x_frame_options, CAST({_REFERRER} AS INT) AS referrer_policy, CAST({_PERMISSIONS} AS INT) AS permissions_policy,
 {_SEEN} AS security_assessed, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE 10 END + CASE WHEN page_id % 4 > 0 THEN round_even((page_id % 4 - page_id % 2) / (page_id % 4)::DOUBLE * 5, 0) ELSE 5 END + {_CSP} + {_HSTS} + {_NOSNIFF} + {_FRAMES} + {_REFERRER} + {_PERMISSIONS} AS INT) AS security FROM served_pages""",
    ("served_pages",),
)
def security_headers(spark, sf_dir):
    given = F.col("headers")
    score = headers.security_score((F.col("page_id") % 5 == 0).cast("int"), F.col("page_id") % 4, F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 2).otherwise(0), given)
    return served(spark, sf_dir).select("page_id", *[p.cast("int").alias(k) for k, p in headers.security_points(given).items()], *[c.alias(k) for k, c in score.items()])


_MISSING = " UNION ALL ".join(f"SELECT page_id, '{p}' AS priority, '{t}' AS title FROM served_pages WHERE {_SEEN} AND {c} IS NULL" for c, (_, p, t) in zip(("csp", "hsts", "frames", "referrer", "permissions"), headers.MISSING))


@query("security_header_findings", f"{_MISSING} UNION ALL SELECT page_id, 'P0', 'Header-level noindex (X-Robots-Tag)' FROM served_pages WHERE contains(lower(robots_tag), 'noindex')", ("served_pages",))
def security_header_findings(spark, sf_dir):
    rows = modules.findings(modules.evaluate(served(spark, sf_dir), ["security", "technical_seo"]))
    return rows.filter(F.col("title").isin(*[t for _, _, t in headers.MISSING], "Header-level noindex (X-Robots-Tag)")).select("page_id", "priority", "title")


@query(
    "robots_aware_points",
    """SELECT page_id, CAST(CASE WHEN page_id % 4 = 1 THEN 34 ELSE 45 END AS INT) AS ai_crawler_access, CAST(CASE WHEN page_id % 2 = 0 THEN 10 ELSE 0 END AS INT) AS llms_txt,
 CAST(CASE WHEN page_id % 4 = 0 AND page_id % 5 = 3 THEN 0 WHEN page_id % 4 = 2 AND page_id % 5 = 2 THEN 0 ELSE 40 END AS INT) AS render_resources FROM pages""",
)
def robots_aware_points(spark, sf_dir):
    rows = modules.evaluate(served(spark, sf_dir), ["ai_search", "crawlability"])
    point = lambda name: F.max(F.col("points")[name]).alias(name)
    return rows.groupBy("page_id").agg(point("ai_crawler_access"), point("llms_txt"), point("render_resources"))


def _names(marks, texts: str) -> str:
    def holds(part: str) -> str:
        text = part.lstrip("~").replace("'", "''")
        return f"contains({'lower(t)' if part[0] == '~' else 't'}, '{text}')"

    one = lambda alternatives: " OR ".join(" AND ".join(map(holds, parts)) for parts in alternatives)
    return "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({texts}, lambda t: {one(a)})) > 0 THEN '{name}' END" for name, a in marks.items()) + "], lambda n: n IS NOT NULL)"


_FRAMEWORK = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, p in providers.FRAMEWORKS.items()) + "], lambda n: n IS NOT NULL)"


@query(
    "page_providers",
    f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({_names(providers.ANALYTICS_SOURCES, 'src')}, {_names(providers.ANALYTICS_INLINE, 'code')}))), ',') AS analytics, array_to_string({_names(providers.CONSENT_SOURCES, 'src')}, ',') AS consent,
 CASE WHEN len(known) = 0 AND page_id % 40 < 25 AND (regexp_matches(html, '{providers.MOUNT.replace(chr(39), chr(39) * 2)}') OR regexp_matches(html, '{providers.MODULE_SCRIPT.replace(chr(39), chr(39) * 2)}')) AND (len(src) > 0 OR regexp_matches(html, '{providers.MODULE_SCRIPT.replace(chr(39), chr(39) * 2)}')) THEN '{providers.SHELL}' ELSE array_to_string(known, ',') END AS frameworks,
 CAST(coalesce(list_sum(list_transform(styles, lambda t: strlen(t))), 0) AS INT) AS style_bytes, len(list_filter(list_concat(styles, code), lambda t: contains(t, 'font-display') AND contains(t, 'swap'))) > 0 AS font_display_swap,
 len(list_filter(list_concat(styles, code), lambda t: contains(t, 'prefers-reduced-motion'))) > 0 AS reduced_motion
FROM (SELECT page_id, html, list_transform(regexp_extract_all(html, '(?is)<script[^>]*\\ssrc={Q}({NQ}*){Q}', 1), lambda t: lower(t)) AS src, list_transform(list_filter(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>'), lambda t: NOT regexp_matches(t, '(?is)^<script[^>]*\\ssrc=')), lambda t: regexp_extract(t, '(?is)^<script[^>]*>(.*?)</script>', 1)) AS code,
 regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1) AS styles, {_FRAMEWORK} AS known FROM served_pages)""",
    ("served_pages",),
)
def page_providers(spark, sf_dir):
    rows = providers.analyse(view(spark, sf_dir, "served_pages"), F.col("page_id") % 40)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("analytics", "consent", "frameworks")})


# --- structured-data advisor -------------------------------------------------------

SHOP = ("shop_pages",)
_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
_BRAND = f"CASE WHEN regexp_matches(trim(string_split_regex({_TITLE}, '\\s+[|–—-]\\s+')[1]), '[\\pL\\pN_]') THEN trim(string_split_regex({_TITLE}, '\\s+[|–—-]\\s+')[1]) END"
_H1 = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '')"
_PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_PDP = f"(k IN (0, 4) OR regexp_matches({_PATH}, '{advisor.PRODUCT_PATH}'))"
_PLP = f"(NOT {_PDP} AND (k = 2 OR regexp_matches({_PATH}, '{advisor.LISTING_PATH}')))"
SIGNALS = f"""SELECT page_id, url, k, CASE k WHEN 0 THEN 'Joe''s' WHEN 4 THEN 'Thing' WHEN 5 THEN 'Graph' ELSE {_BRAND} END AS name, {_H1} AS h1, CASE k WHEN 0 THEN '+1 555' WHEN 1 THEN '5' WHEN 5 THEN '123' END AS phone, CASE k WHEN 0 THEN 'https://www.facebook.com/joe' ELSE '' END AS socials,
 CASE WHEN k = 0 THEN '12.50' ELSE nullif(regexp_extract(html, '[$£€]\\s?(\\d[\\d.,]*)', 1), '') END AS price, CASE k WHEN 2 THEN 'GBP' WHEN 4 THEN 'EUR' END AS currency, CASE k WHEN 4 THEN 'https://schema.org/OutOfStock' WHEN 5 THEN 'https://schema.org/InStock' END AS availability,
 k = 4 AS rated, CASE k WHEN 4 THEN '9' END AS review_count, CASE k WHEN 3 THEN 'Why so?|Because it is;How?|REPLACE_answer' ELSE '' END AS faq, k = 1 AS has_map, k = 5 AS breadcrumb, CASE k WHEN 4 THEN 'product' WHEN 5 THEN 'organization,website' ELSE '' END AS types,
 array_to_string(list_filter(['article', CASE WHEN k = 1 OR contains({_PATH}, 'contact') THEN 'contact' END, CASE WHEN k = 3 THEN 'faq' END, CASE WHEN {_PATH} IN ('', '/', '/index.html', '/home') THEN 'home' END, CASE WHEN k IN (1, 5) THEN 'local' END, CASE WHEN {_PDP} THEN 'pdp' END, CASE WHEN {_PLP} THEN 'plp' END], lambda x: x IS NOT NULL), ',') AS labels
FROM shop_pages"""


def advice(spark, sf_dir):
    return advisor.advise(view(spark, sf_dir, "shop_pages").select("page_id", "url", "html"))


@query("schema_signals", f"SELECT page_id, name, h1, phone, socials, price, currency, availability, rated, review_count, faq, has_map, breadcrumb, types, labels FROM ({SIGNALS})", SHOP)
def schema_signals(spark, sf_dir):
    s = F.col("signals")
    texts = ("name", "h1", "phone", "price", "currency", "availability", "rated", "review_count", "has_map", "breadcrumb")
    faq = F.array_join(F.transform(s["faq"], lambda p: F.concat(p["question"], F.lit("|"), p["answer"])), ";")
    return advice(spark, sf_dir).select("page_id", *[s[t].alias(t) for t in texts], F.array_join(s["socials"], ",").alias("socials"), faq.alias("faq"), F.array_join(s["types"], ",").alias("types"), F.array_join("labels", ",").alias("labels"))


_ADVICE = [
    ("CASE WHEN contains(labels, 'local') THEN 'LocalBusiness' ELSE 'Organization' END", "'P1'", "true", "CASE WHEN k = 5 AND NOT contains(labels, 'local') THEN 'incomplete' ELSE 'missing' END", "array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN contains(labels, 'local') THEN 'priceRange' END], lambda x: x IS NOT NULL), ',')"),
    ("'WebSite'", "'P2'", "k <> 5", "'missing'", "CASE WHEN name IS NULL THEN 'name' ELSE '' END"),
    ("'BreadcrumbList'", "'P2'", "NOT contains(labels, 'home')", "'missing'", "''"),
    ("'Article'", "'P1'", "true", "'missing'", "'datePublished,dateModified'"),
    ("'Product'", "CASE WHEN k = 4 THEN 'P1' ELSE 'P0' END", "contains(labels, 'pdp')", "CASE WHEN k = 4 THEN 'incomplete' ELSE 'missing' END", "'description,sku'"),
    ("'ItemList'", "'P2'", "contains(labels, 'plp')", "'missing'", "''"),
    ("'FAQPage'", "'P2'", "contains(labels, 'faq')", "'missing'", "''"),
]


@query("schema_recommendations", " UNION ALL ".join(f"SELECT page_id, {t} AS type, {p} AS priority, {st} AS status, {n} AS needs_input FROM ({SIGNALS}) WHERE {c}" for t, p, c, st, n in _ADVICE), SHOP)
def schema_recommendations(spark, sf_dir):
    # An outer explode: for the other Spark adds a filter on the array, which works everything out once more.
    rows = advice(spark, sf_dir).select("page_id", F.explode_outer("recommendations").alias("r")).filter("r is not null")
    return rows.select("page_id", "r.type", "r.priority", "r.status", F.array_join("r.needs_input", ",").alias("needs_input"))


@query("schema_merchant_gaps", f"SELECT page_id, array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN currency IS NULL THEN 'currency' END, CASE WHEN availability IS NULL THEN 'availability' END, CASE WHEN k <> 4 THEN 'product_schema' END, CASE WHEN NOT rated THEN 'rating_or_reviews' END, 'image'], lambda x: x IS NOT NULL), ',') AS missing FROM ({SIGNALS}) WHERE contains(labels, 'pdp')", SHOP)
def schema_merchant_gaps(spark, sf_dir):
    return advice(spark, sf_dir).filter("merchant_missing is not null").select("page_id", F.array_join("merchant_missing", ",").alias("missing"))


_BLOCKS = "list_filter(regexp_extract_all(html, '(?s)<script type=\"application/ld\\+json\">(.*?)</script>', 1), lambda b: contains(b, '\"Product\"'))"


@query("json_ld_products", f"""SELECT page_id, regexp_extract(b, '\"name\": \"([^\"]*)\"', 1) AS name, regexp_extract(b, '\"priceCurrency\": \"([^\"]*)\"', 1) AS currencies, contains(b, '\"offers\"') AS valid, CAST(0 AS BIGINT) AS missing FROM (SELECT page_id, unnest({_BLOCKS}) AS b FROM shop_pages)""", SHOP)
def json_ld_products(spark, sf_dir):
    """Products by the graph of a page's JSON-LD nodes."""
    rows = nodegraph.products(view(spark, sf_dir, "shop_pages").select("page_id", "html"))
    return rows.select("page_id", "name", F.array_join("currencies", ",").alias("currencies"), "valid", "missing")
