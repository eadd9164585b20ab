"""Queries that run the page modules over pages with a few more elements than the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import jsonld, modules
from ..sources import sitemaps
from ..sources.driver_views import table, view
from .texts import _STOP, _SYLLABLES

RICH = ("rich_pages",)
Q, NQ = "[\"'']", "[^\"'']"


def _has(p: str, html: str = "html") -> str:
    return f"regexp_matches({html}, '(?is){p}')"


def _n(p: str) -> str:
    return f"len(regexp_extract_all(html, '(?is){p}'))"


def _kept(p: str, test: str) -> str:
    return f"len(list_filter(regexp_extract_all(html, '(?is){p}'), lambda t: {test}))"


_DESCRIPTION = f"trim(CASE WHEN {_has(f'<meta\\s[^>]*name={Q}description{Q}[^>]*content={Q}{NQ}*{Q}')} THEN regexp_extract(html, '(?is)<meta\\s[^>]*name={Q}description{Q}[^>]*content={Q}({NQ}*){Q}', 1) ELSE regexp_extract(html, '(?is)<meta\\s[^>]*content={Q}({NQ}*){Q}[^>]*name={Q}description{Q}', 1) END)"
_OG = f"list_distinct(list_filter(regexp_extract_all(html, '(?is)<meta\\s[^>]*property={Q}({NQ}+){Q}[^>]*content={Q}{NQ}*{Q}', 1), lambda p: starts_with(p, 'og:')))"
SEO = f"""SELECT page_id, CAST(CASE WHEN length(title) = 0 THEN 0 WHEN length(title) BETWEEN 50 AND 60 THEN 10 WHEN length(title) BETWEEN 30 AND 70 THEN 8 ELSE 6 END
 + CASE WHEN length(descr) = 0 THEN 0 WHEN length(descr) BETWEEN 150 AND 160 THEN 8 WHEN length(descr) BETWEEN 120 AND 170 THEN 7 ELSE 5 END + CASE WHEN h1 = 1 THEN 8 WHEN h1 > 1 THEN 3 ELSE 0 END + CASE WHEN canonical THEN 5 ELSE 0 END
 + CASE WHEN ld >= 2 THEN 10 WHEN ld = 1 THEN 7 ELSE 0 END + least(10, least(8, 2 * len(list_filter(og, lambda p: p IN ('og:title', 'og:description', 'og:image', 'og:url')))) + CASE WHEN len(og) > 0 THEN 2 ELSE 0 END)
 + CASE WHEN contains(robots, 'noindex') THEN 0 ELSE 5 END AS INT) AS total FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_DESCRIPTION} AS descr, {_n('<h1[\\s>]')} AS h1, {_has(f'<link[^>]*rel={Q}canonical{Q}')} AS canonical,
 {_n(f'<script[^>]*type={Q}application/ld\\+json{Q}')} AS ld, {_OG} AS og, lower(regexp_extract(html, '(?is)<meta\\s[^>]*name={Q}robots{Q}[^>]*content={Q}({NQ}*){Q}', 1)) AS robots FROM rich_pages)"""
_UNSAFE = f"NOT contains(lower(regexp_extract(t, '(?is)rel={Q}({NQ}*){Q}', 1)), 'noopener')"
SECURITY = f"""SELECT page_id, CAST(CASE WHEN {_has(f'(?:src|action)={Q}http://{NQ}+{Q}')} THEN 0 ELSE 10 END + CASE WHEN unsafe > 0 THEN round_even((total_blank - unsafe) / total_blank::DOUBLE * 5, 0) ELSE 5 END AS INT) AS total
FROM (SELECT *, {_n(f'<a\\s[^>]*target={Q}_blank{Q}[^>]*>')} AS total_blank, {_kept(f'<a\\s[^>]*target={Q}_blank{Q}[^>]*>', _UNSAFE)} AS unsafe FROM rich_pages)"""
_WEIGHTS = {
    "pwa": {f"<link[^>]*rel={Q}manifest{Q}[^>]*>": 30, f"<meta[^>]*name={Q}theme-color{Q}[^>]*>": 15, f"<link[^>]*rel={Q}apple-touch-icon{Q}[^>]*>": 15, modules.WORKER: 25, f"<meta[^>]*name={Q}viewport{Q}[^>]*>": 15},
    "cookie_gdpr": {
        modules.BANNERS: 30, f"href={Q}{NQ}*privacy{NQ}*{Q}": 25, f"href={Q}{NQ}*cookie[- _]?policy{NQ}*{Q}": 20, "data-cookie-consent|data-consent|cookie_consent|cookieConsent|consent[^\\n]*required|__consent|data-requires-consent": 15,
        "data\\s+controller|data\\s+processor|data\\s+protection\\s+officer|DPO": 10,
    },
}


def _weighted(name: str) -> str:
    return "SELECT page_id, CAST(" + " + ".join(f"CASE WHEN {_has(p)} THEN {w} ELSE 0 END" for p, w in _WEIGHTS[name].items()) + " AS INT) AS total FROM rich_pages"


_BLOCKING = "<script\\s[^>]*>"
PERFORMANCE = f"""SELECT page_id, CAST(CASE WHEN kb <= 50 THEN 15 WHEN kb <= 100 THEN 12 WHEN kb <= 200 THEN 7 ELSE 2 END + CASE WHEN b = 0 THEN 15 WHEN b <= 1 THEN 10 WHEN b <= 2 THEN 6 WHEN b <= 4 THEN 3 ELSE 0 END
 + CASE WHEN n = 0 THEN 20 ELSE least(20, 5 + CASE WHEN modern >= n OR resp >= n THEN 8 WHEN resp > 0 THEN round_even(resp / n::DOUBLE * 8, 0) ELSE 0 END + CASE WHEN modern >= n THEN 7 WHEN modern > 0 THEN round_even(modern / n::DOUBLE * 7, 0) ELSE 0 END) END
 + CASE WHEN {_has(f'<link[^>]*rel={Q}preconnect{Q}')} THEN 8 ELSE 0 END + CASE WHEN {_has(f'<link[^>]*rel={Q}preload{Q}')} THEN 7 ELSE 0 END
 + CASE WHEN js <= 10 THEN 6 WHEN js <= 30 THEN 4 WHEN js <= 60 THEN 2 ELSE 0 END + CASE WHEN css <= 60 THEN 4 WHEN css <= 120 THEN 2 ELSE 0 END + CASE WHEN n <= 1 THEN 10 WHEN lazy > 0 THEN greatest(5, round_even(lazy / n::DOUBLE * 10, 0)) ELSE 3 END AS INT) AS total
FROM (SELECT *, round_even(strlen(html) / 1024.0::DOUBLE, 1) AS kb, {_kept(_BLOCKING, f"{_has(f'src={Q}', 't')} AND NOT {_has('\\basync\\b', 't')} AND NOT {_has('\\bdefer\\b', 't')} AND NOT {_has(f'type={Q}module{Q}', 't')}")} AS b, {_n('<img\\s[^>]*>')} AS n,
 {_kept('<img\\s[^>]*>', _has('srcset=', 't'))} + {_n('<picture[\\s>]')} AS resp, {_kept('<img\\s[^>]*>', _has('\\.(webp|avif|svg)', 't'))} AS modern, {_kept('<img\\s[^>]*>', _has(f'loading={Q}lazy{Q}', 't'))} AS lazy,
 round_even(coalesce(list_sum(list_transform(list_filter(regexp_extract_all(html, '(?is)<script(?:\\s[^>]*)?>(.+?)</script>', 1), lambda t: NOT regexp_matches(t, '^\\s*\\{{')), lambda t: strlen(t))), 0) / 1024.0::DOUBLE, 1) AS js,
 round_even(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<style[^>]*>(.+?)</style>', 1), lambda t: strlen(t))), 0) / 1024.0::DOUBLE, 1) AS css FROM rich_pages)"""


def _total(name: str, sql: str) -> None:
    @query(f"mod_{name}", sql, RICH)
    def run(spark, sf_dir):
        return modules.evaluate(view(spark, sf_dir, "rich_pages"), [name]).select("page_id", "total")


_total("seo", SEO)
_total("security", SECURITY)
_total("performance", PERFORMANCE)
_total("pwa", _weighted("pwa"))
_total("cookie_gdpr", _weighted("cookie_gdpr"))

_ANCHORS = f"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract_all(html, '(?is)\\bid\\s*=\\s*{Q}({NQ}+){Q}', 1) AS ids, list_transform(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*>'), lambda t: {_has(f'href\\s*=\\s*{Q}{NQ}*{Q}', 't')}), lambda t: {{'to': trim(regexp_extract(t, '(?is)href\\s*=\\s*{Q}({NQ}*){Q}', 1)), 'rel': lower(regexp_extract(t, '(?is)\\brel\\s*=\\s*{Q}({NQ}*){Q}', 1))}}) AS links FROM rich_pages"
_EMPTY, _MAIL, _TEL = "x['to'] IN ('', '#')", "starts_with(lower(x['to']), 'mailto:')", "starts_with(lower(x['to']), 'tel:')"
_FRAGMENT = f"(starts_with(x['to'], '#') AND NOT {_EMPTY})"
_HOST = "lower(regexp_extract(x['to'], '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"
_OTHER = f"(NOT {_EMPTY} AND NOT {_MAIL} AND NOT {_TEL} AND NOT {_FRAGMENT})"
_EXTERNAL = f"({_OTHER} AND {_HOST} <> '' AND {_HOST} <> host)"


def _links(test: str) -> str:
    return f"len(list_filter(links, lambda x: {test}))"


_total(
    "links",
    f"""SELECT page_id, CAST(CASE WHEN {_links(_EMPTY)} = 0 THEN 20 ELSE 0 END + CASE WHEN {_links(f"{_FRAGMENT} AND NOT list_contains(ids, substr(x['to'], 2))")} = 0 THEN 20 ELSE 0 END
 + CASE WHEN {_links(f"{_EXTERNAL} AND NOT contains(x['rel'], 'noopener')")} = 0 THEN 15 ELSE 0 END + CASE WHEN {_links(f'{_FRAGMENT} OR ({_OTHER} AND NOT {_EXTERNAL})')} > 0 THEN 15 ELSE 0 END + CASE WHEN {_links(_EXTERNAL)} > 0 THEN 10 ELSE 0 END
 + CASE WHEN {_links(f"{_MAIL} AND NOT regexp_matches(x['to'], '(?i)^mailto:[^@\\s?]+@[^@\\s?]+\\.[^@\\s?]+(\\?|$)')")} = 0 THEN 10 ELSE 0 END + CASE WHEN len(links) BETWEEN 1 AND 200 THEN 10 ELSE 0 END AS INT) AS total FROM ({_ANCHORS})""",
)
_SRC = f"\\bsrc\\s*=\\s*{Q}({NQ}+){Q}"
_total(
    "js_bundle",
    f"""SELECT page_id, CAST(CASE WHEN len(ext) <= 15 THEN 20 ELSE 0 END + CASE WHEN len(list_filter(ext, lambda a: {_has(modules.HEAVY, f"regexp_extract(a, '(?is){_SRC}', 1)")})) = 0 THEN 20 ELSE 0 END
 + CASE WHEN len(list_filter(ext, lambda a: NOT {_has('\\basync\\b', 'a')} AND NOT {_has('\\bdefer\\b', 'a')})) = 0 THEN 20 ELSE 0 END + CASE WHEN len(list_filter(ext, lambda a: {_has(f'\\btype\\s*=\\s*{Q}module{Q}', 'a')})) > 0 THEN 15 ELSE 0 END
 + CASE WHEN chars < 10000 THEN 15 ELSE 0 END + CASE WHEN len(list_filter(ext, lambda a: {_has(modules.BUNDLED, f"regexp_extract(a, '(?is){_SRC}', 1)")})) > 0 THEN 10 ELSE 0 END AS INT) AS total
FROM (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<script\\b([^>]*)>', 1), lambda a: {_has(_SRC, 'a')}) AS ext, coalesce(list_sum(list_transform(list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script>'), lambda t: NOT {_has(_SRC, "regexp_extract(t, '(?is)^<script\\b([^>]*)>', 1)")}),
 lambda t: length(trim(regexp_extract(t, '(?is)^<script\\b[^>]*>(.*?)</script>$', 1))))), 0) AS chars FROM rich_pages)""",
)


_FOREIGN = "(regexp_matches(c, '^https?://') AND ch <> '' AND h <> '' AND NOT (ch = h OR ends_with(ch, '.' || h) OR ends_with(h, '.' || ch)))"
_CANONICAL = f"CASE WHEN regexp_extract(html, '(?is)<link[^>]*rel={Q}canonical{Q}[^>]*href={Q}({NQ}+){Q}', 1) <> '' THEN regexp_extract(html, '(?is)<link[^>]*rel={Q}canonical{Q}[^>]*href={Q}({NQ}+){Q}', 1) ELSE regexp_extract(html, '(?is)<link[^>]*href={Q}({NQ}+){Q}[^>]*rel={Q}canonical{Q}', 1) END"
_IMAGE = "<img\\b[^>]*>"
_SOURCE = f"lower(regexp_extract(t, '(?is)src={Q}({NQ}+){Q}', 1))"
_BARE = "regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
_total(
    "technical_seo",
    f"""SELECT page_id, CAST(30 + CASE WHEN {_FOREIGN} THEN 0 ELSE 20 END + CASE WHEN {_has(f'<meta[^>]+http-equiv={Q}refresh{Q}')} THEN 0 ELSE 15 END + CASE WHEN ({_has(modules.IN_THE_WAY.replace("'", "''"))} OR {_has(modules.SHOWN_AT_ONCE.replace("'", "''"))}) AND NOT {_has('cookie|consent|gdpr')} THEN 7 ELSE 15 END
 + 20 - CASE WHEN {_kept(_IMAGE, f"regexp_matches({_SOURCE}, '\\.(?:jpg|jpeg|png)(?:\\?|$)')")} > 0 AND NOT ({_kept(_IMAGE, f"regexp_matches({_SOURCE}, '\\.(?:webp|avif)(?:\\?|$)')")} > 0 OR {_has(f'<source[^>]+type={Q}image/(?:webp|avif)')}) THEN 10 ELSE 0 END
 - CASE WHEN {_kept(_IMAGE, f"NOT ({_has('\\bwidth=', 't')} AND {_has('\\bheight=', 't')})")} > 0 THEN 10 ELSE 0 END AS INT) AS total
FROM (SELECT *, {_BARE.format(u='c')} AS ch, {_BARE.format(u='url')} AS h FROM (SELECT *, trim({_CANONICAL}) AS c FROM rich_pages))""",
)


_LOW = "lower(html)"


def _word(p: str, value: int) -> str:
    return f"CASE WHEN {_has(p)} THEN {value} ELSE 0 END"


_total(
    "ai_search",
    f"""SELECT page_id, CAST(45 + CASE WHEN {_has('<details|frequently asked')} OR regexp_matches({_LOW}, '"@type"\\s*:\\s*"(?:faqpage)"') THEN 5 ELSE 0 END + CASE WHEN {_n('<li')} >= 3 THEN 5 ELSE 0 END + {_word('<table', 5)} + CASE WHEN {_n('<h[2-3][\\s>]')} >= 2 THEN 5 ELSE 0 END
 + {_word(f'<dl[\\s>]|<summary|class={Q}{NQ}*(?:summary|tl;dr|key-takeaway)', 5)} + CASE WHEN regexp_matches({_LOW}, '"@type"\\s*:\\s*"(?:organization|localbusiness)"') THEN 8 ELSE 0 END + CASE WHEN contains({_LOW}, '"sameas"') THEN 6 ELSE 0 END + {_word('wikipedia\\.org|wikidata\\.org', 6)} AS INT) AS total FROM rich_pages""",
)


_VISIBLE_OF = lambda h: f"regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_SPLIT = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[\\s\\x1c-\\x1f\\x85\\xa0\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> ''))"
_IF = lambda test, value, other=0: f"CASE WHEN {test} THEN {value} ELSE {other} END"
_Q2 = lambda p: p.replace("'", "''")
_OPENED = _n("<article")
_ARTICLE = f"(regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/blog/|/news/|/article/|/post/|/guides?/') OR regexp_matches({_LOW}, '\"@type\"\\s*:\\s*\"(?:article|blogposting|newsarticle)\"') OR {_OPENED} BETWEEN 1 AND 2)"
_LD = f"lower(array_to_string(regexp_extract_all(html, '(?is)<script[^>]*type={Q}application/ld\\+json{Q}[^>]*>(.*?)</script>', 1), chr(10)))"
_TRUST = " + ".join(_IF(f"{_has(f'href={Q}{NQ}*(?:{p})')} OR {_has(f'>[^<]*(?:{p})[^<]*</a>')}", 5) for k, p in modules.TRUST_PAGES.items() if k != "terms")
_CITED = f"len(list_filter(list_transform(regexp_extract_all(html, '(?is)href={Q}(https?://{NQ}+){Q}', 1), lambda h: lower(h)), lambda h: NOT (host <> '' AND contains(h, host)) AND NOT regexp_matches(h, '{modules.SOCIAL}')))"
_BYLINE = f"{_has(f'rel={Q}author{Q}|class={Q}{NQ}*(?:author|byline)|itemprop={Q}author{Q}')} OR regexp_matches(html, '>\\s*(?i:by)\\s+[A-Z][a-z]+\\s+[A-Z][a-z]+')"
_ORG = "regexp_matches(ld, '\"@type\"\\s*:\\s*\"(?:organization|localbusiness)\"')"
_total(
    "eeat",
    f"""SELECT page_id, CAST({_IF(_BYLINE, 10)} + {_IF("contains(ld, '\"author\"') OR (contains(ld, '\"@type\"') AND contains(ld, '\"person\"'))", 8)} + {_IF(_has(f'href={Q}{NQ}*/authors?/'), 2)} + {_TRUST} + {_IF(_ORG, 8)} + {_IF("contains(ld, '\"sameas\"')", 6)} + {_IF("contains(ld, '\"logo\"')", 3)}
 + {_IF("contains(ld, '\"contactpoint\"')", 3)} + {_IF(_has(f'href={Q}tel:'), 6)} + {_IF(_has(f'href={Q}mailto:'), 6)} + {_IF(f"{_has('<address[\\s>]')} OR regexp_matches({_LOW}, '\"@type\"\\s*:\\s*\"(?:postaladdress)\"')", 8)} + {_IF(f'{_CITED} >= 1', 10)} + {_IF(_has(modules.DISCLOSED), 5)} + {_IF(_has(modules.REVIEWED), 5)} AS INT) AS total
 FROM (SELECT *, {_LD} AS ld, lower(regexp_extract(url, '^(?:https?://)?([^/]*)', 1)) AS host FROM rich_pages)""",
)
_BODY_TEXT = "regexp_replace(" + _VISIBLE_OF("regexp_replace(html, '(?is)<head\\b.*?</head>', ' ', 'g')") + ", '&nbsp;|&#160;', ' ', 'g')"
_KEYWORDS = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z]{{3,}}')), lambda w: w NOT IN ({_STOP}))"
_PARAGRAPHS = "regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)"
_GRADE = f"CASE WHEN len(ws) >= 30 AND sentences >= 1 THEN round_even(0.39::DOUBLE * (len(ws) / sentences::DOUBLE) + 11.8::DOUBLE * (coalesce(list_sum(list_transform(ws, lambda w: {_SYLLABLES})), 0) / len(ws)::DOUBLE) - 15.59::DOUBLE, 1) END"
_total(
    "content_quality",
    f"""SELECT page_id, CAST({_IF('words >= 300', 25)} + {_IF(_has(modules.PLACEHOLDER), 0, 20)} + {_IF("len(list_intersect(" + _KEYWORDS("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", " + _KEYWORDS("array_to_string(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' ')") + ")) > 0", 15)}
 + {_IF(f'{_GRADE} BETWEEN 6 AND 14', 15)} + {_IF(f"len(list_filter({_PARAGRAPHS}, lambda p: trim(regexp_replace(p, '<[^>]+>|&nbsp;|&#160;|\\xa0', '', 'g')) = '')) = 0", 10)} + {_IF(f"TRY_CAST(regexp_extract(html, '(?is)(?:©|&copy;|\\bcopyright\\b)\\s*(\\d{{4}})', 1) AS INT) >= {modules.AS_OF_YEAR - 1}", 10)}
 + {_IF('headings > 0 AND words < 40 * headings', 0, 5)} AS INT) AS total FROM (SELECT *, {_SPLIT('body')} AS words, regexp_extract_all(body, '[a-zA-Z'']+') AS ws, len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')) AS sentences, {_n('<h[1-6][\\s>]')} AS headings
 FROM (SELECT *, {_BODY_TEXT} AS body FROM rich_pages))""",
)


@query("jsonld_nodes", "SELECT page_id, CAST(CASE WHEN page_id % 5 = 1 THEN 1 ELSE 0 END AS INT) AS blocks, CAST(0 AS INT) AS invalid, false AS has_context, CASE WHEN page_id % 5 = 1 THEN 'VideoObject' ELSE '' END AS types, CASE WHEN page_id % 5 = 1 THEN 'true' ELSE '' END AS known, '' AS missing, CAST(0 AS INT) AS products, false AS self_review FROM pages")
def jsonld_nodes(spark, sf_dir):
    joined = lambda f: F.array_join(F.transform("nodes", f), ",")
    parts = joined(lambda n: n["type"]).alias("types"), joined(lambda n: n["known"].cast("string")).alias("known"), joined(lambda n: F.array_join(n["missing"], " ")).alias("missing")
    return jsonld.nodes(view(spark, sf_dir, "rich_pages")).select("page_id", "blocks", "invalid", "has_context", *parts, "products", "self_review")


@query("mod_schema_validator", "SELECT page_id, CAST(CASE WHEN page_id % 5 = 1 THEN 20 + 20 + 15 + 20 + 10 ELSE 20 + 20 + 10 END AS INT) AS total FROM pages")
def schema_validator(spark, sf_dir):
    return jsonld.validate(jsonld.nodes(view(spark, sf_dir, "rich_pages"))).select("page_id", "total")


@query("mod_i18n", f"SELECT page_id, CAST({_word(f'<html[^>]+lang={Q}{NQ}+{Q}', 20)} AS INT) AS total FROM rich_pages", RICH)
def i18n(spark, sf_dir):
    return modules.evaluate(view(spark, sf_dir, "rich_pages"), ["i18n"]).select("page_id", "total")


#: A sitemap for each nation that lists the pages of its number; some are missing, some broken.
SITEMAP_TOTAL = "CASE WHEN k % 6 = 5 THEN 0 ELSE 25 + CASE WHEN k % 6 = 4 THEN 0 ELSE 30 END + 10 + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 6 = 4 OR k % 3 <> 1 THEN 10 ELSE 0 END + 5 END + CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END"


@query("mod_sitemap", f"SELECT CAST(k AS INT) AS sitemap, CAST({SITEMAP_TOTAL} AS INT) AS total, CAST(CASE WHEN k % 6 >= 4 THEN 0 WHEN k % 3 = 1 THEN 3 ELSE 2 END AS INT) AS urls FROM (SELECT n_nationkey AS k FROM nation)")
def sitemap(spark, sf_dir):
    k = F.col("n_nationkey")
    entry = lambda n: F.concat(F.lit("<url><loc>https://site.example/"), F.lit(n), F.lit("?a=1&amp;b=2</loc>"), F.when(k % 2 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.lit("</url>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entry("a"), entry("b"), F.when(k % 3 == 1, entry("a")).otherwise(""), F.when(k % 6 == 4, "<url>").otherwise("</urlset>"))
    docs = table(spark, sf_dir, "nation").select(k.alias("sitemap"), F.lit("https://site.example/").alias("site"), F.when(k % 6 != 5, xml).alias("xml"), (k % 4 == 0).alias("in_robots"))
    return sitemaps.audit(docs).select("sitemap", "total", "urls")


_HEADING = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
_AFTER = f"CASE WHEN {_has('</h1>')} THEN regexp_extract(html, '(?is)</h1>(.*?)(?:<h2|</article>|$)', 1) ELSE html END"
_LEAD = f"len(list_filter(regexp_extract_all({_AFTER}, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {_SPLIT("regexp_replace(p, '<[^>]+>', ' ', 'g')")} BETWEEN 20 AND 70)) > 0"
_ORIGINAL = " + ".join((_IF(_has("<table"), 1), _IF(_has("<figure|<img"), 1), _IF(f"{_has(f'<blockquote|<cite|rel={Q}nofollow')} OR contains(shown, 'http')", 1), _IF("regexp_matches(shown, '\\d+\\s?%|\\b\\d{2,}\\b')", 1)))
_total(
    "content_depth",
    f"""SELECT page_id, CAST({_IF(f"{_n(_Q2(modules.ADVERTS))} >= 4 AND {_SPLIT('shown')} < 1200", 5, 20)} + least(6 * ({_ORIGINAL}), 24) + {_IF(f'{_has(modules.DATED)} OR NOT {_ARTICLE}', 18)} + {_IF(_LEAD, 18, 8)} + {_IF(f'{_has(modules.GRAVE, _HEADING)} OR {_has(modules.GRAVE, "url")}', 10, 20)} AS INT) AS total
 FROM (SELECT *, {_VISIBLE_OF('html')} AS shown FROM rich_pages)""",
)
_BLIND = f"CASE WHEN {_has(f'href={Q}{NQ}*{Q}', 't')} THEN regexp_matches(lower(trim(regexp_extract(t, '(?is)href={Q}({NQ}*){Q}', 1))), '^(?:javascript:|#)') AND {_has('onclick', 't')} AND NOT {_has(f'role={Q}button{Q}|\\baria-\\w', 't')} ELSE NOT {_has(f'role={Q}button{Q}|\\baria-\\w|\\b(?:name|id)=', 't')} END"
_FACETS = f"len(list_distinct(list_filter(regexp_extract_all(html, '(?is)href={Q}({NQ}+){Q}', 1), lambda h: regexp_matches(h, '(?i){modules.FACETS}'))))"
_total("crawlability", f"SELECT page_id, CAST(40 + greatest(0, 30 - 5 * {_kept('<a\\b[^>]*>', _BLIND)}) + CASE WHEN {_FACETS} < 10 THEN 30 WHEN {_FACETS} < 30 THEN 15 ELSE 0 END AS INT) AS total FROM rich_pages")


_total("ecommerce", "SELECT page_id, CAST(10 + " + " + ".join((_word(modules.CART, 15), _word(f"product.price|price.display|class={Q}{NQ}*price", 10), _word(modules.PAYMENTS, 10), _word(modules.SECURE, 5))) + " AS INT) AS total FROM rich_pages")
_total("local_seo", "SELECT page_id, CAST(" + " + ".join((_word(modules.MAPS, 10), _word('href="tel:', 10), _word(modules.CALLS, 10), _word("service.area|areas?.served|areas?.we.cover", 7), _word(modules.SEALS, 5))) + " AS INT) AS total FROM rich_pages")


_EMPTY_HEADINGS = " + ".join(f"len(list_filter(regexp_extract_all(html, '(?is)<h{k}[^>]*>(.*?)</h{k}>', 1), lambda t: trim(regexp_replace(t, '<[^>]+>', '', 'g')) = ''))" for k in range(1, 7))
_MARKS = " + ".join(_IF(f"{_has(f'<{tag}[\\s>]')} OR {_has(f'role={Q}(?:{tag}|{role}){Q}')}", 1) for tag, role in modules.LANDMARKS.items())
_SHARE = lambda total, missing, most: _IF(f"{total} = 0 OR {missing} = 0", most, f"round_even(({total} - {missing}) / {total}::DOUBLE * {most}, 0)")
_INPUT = "<(?:input|select|textarea)\\s[^>]*>"
_NO_NAME = f"NOT {_has(f'type={Q}hidden{Q}', 't')} AND NOT ({_has('aria-label\\b|aria-labelledby|\\btitle=', 't')} OR list_contains(labels, regexp_extract(t, '(?is)\\bid={Q}({NQ}+)', 1)))"
_total(
    "accessibility",
    f"""SELECT page_id, CAST({_SHARE('images', 'no_alt', 18)} + {_IF(_has('<html\\s[^>]*lang='), 5)} + {_SHARE('inputs', 'unlabelled', 13)} + greatest(10 - 3 * ({_EMPTY_HEADINGS}), 0) + {_IF(_has(f'<a\\s[^>]*href={Q}#(?:main|content|main-content){Q}'), 5)} + least(3 * ({_MARKS}), 10) AS INT) AS total
 FROM (SELECT *, {_n('<img\\s[^>]*>')} AS images, {_kept('<img\\s[^>]*>', f"NOT {_has(f'alt={Q}', 't')}")} AS no_alt, {_kept(_INPUT, f"NOT {_has(f'type={Q}hidden{Q}', 't')}")} AS inputs, {_kept(_INPUT, _NO_NAME)} AS unlabelled FROM (SELECT *, regexp_extract_all(html, '(?is)<label[^>]+for={Q}({NQ}+)', 1) AS labels FROM rich_pages))""",
)


@query("mod_video", "SELECT page_id, page_id % 5 = 1 AS detected, CAST(CASE WHEN page_id % 5 = 1 THEN 50 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 15 ELSE 0 END AS INT) AS total FROM pages")
def video(spark, sf_dir):
    return modules.evaluate(view(spark, sf_dir, "rich_pages"), ["video"]).select("page_id", "detected", "total")


@query("mod_all_findings")
def all_findings(spark, sf_dir):
    return modules.findings(modules.evaluate(view(spark, sf_dir, "rich_pages")))


@query("mod_totals")
def totals(spark, sf_dir):
    rows = modules.evaluate(view(spark, sf_dir, "rich_pages")).filter("detected")
    return rows.groupBy("module").agg(F.count("*").alias("pages"), F.bround(F.avg("total"), 2).alias("mean_total"), F.sum(F.size("findings")).alias("findings"))
