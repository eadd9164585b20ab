"""Queries over the streaming parse of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import report
from ..sources.driver_views import view

RICH = ("rich_pages",)


def reports(spark, sf_dir):
    return report.analyse(view(spark, sf_dir, "rich_pages"))


@query("html_report")
def html_report(spark, sf_dir):
    return reports(spark, sf_dir)


@query(
    "html_report_counts",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[\\s>]')) AS INT) AS h1s, CAST(len(regexp_extract_all(html, '<img\\s')) AS INT) AS images, CAST(len(regexp_extract_all(html, '<script[^>]*src=')) AS INT) AS external_scripts, strlen(html) AS size FROM rich_pages""",
    RICH,
)
def counts(spark, sf_dir):
    rows = reports(spark, sf_dir)
    return rows.select("page_id", F.size(F.filter("headings", lambda h: h == 1)).alias("h1s"), "images", "external_scripts", F.col("bytes").cast("long").alias("size"))


# --- SQL twins of the parse: tags as lists, attributes by pattern (the driver's pages quote with ") ----------


def _tags(pattern: str, html: str = "html") -> str:
    return f"regexp_extract_all({html}, '<{pattern}')"


def _attr(name: str, tag: str = "t") -> str:
    return f"regexp_extract({tag}, '\\b{name}=\"([^\"]*)\"', 1)"


def _count(array: str, test: str) -> str:
    return f"CAST(len(list_filter({array}, lambda t: {test})) AS INT)"


def _plain(x: str) -> str:
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


_NAMED = lambda name: f"list_filter(metas, lambda t: lower({_attr('name')}) = '{name}')"
_OG = f"list_filter(list_transform(metas, lambda t: lower({_attr('property')})), lambda p: starts_with(p, 'og:'))"
_LD = "list_transform(list_filter(scripts, lambda t: contains(t, 'application/ld+json')), lambda t: regexp_extract(t, '(?s)^<script[^>]*>(.*)</script>$', 1))"
_CODE = "list_transform(list_filter(scripts, lambda t: NOT contains(t, 'application/ld+json') AND NOT regexp_matches(t, '^<script[^>]*\\bsrc=')), lambda t: regexp_extract(t, '(?s)^<script[^>]*>(.*)</script>$', 1))"
_BYTES = lambda texts: f"CAST(coalesce(list_sum(list_transform({texts}, lambda t: strlen(t))), 0) AS INT)"
PARTS = f"""SELECT *, {_tags('meta [^>]*>')} AS metas, {_tags('link [^>]*>')} AS links, regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>') AS scripts, regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1) AS styles,
 {_tags('a [^>]*>')} AS anchors, {_tags('img [^>]*>')} AS imgs, list_transform(regexp_extract_all(html, '<h[1-6][ >]'), lambda t: CAST(t[3] AS INT)) AS hs FROM rich_pages"""
_REL = lambda rel: f"contains({_attr('rel')}, '{rel}')"
HEAD = f"""SELECT page_id, {_plain("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} AS title, CAST(len({_tags('title[ >]')}) AS INT) AS titles, CASE WHEN len({_NAMED('description')}) > 0 THEN {_attr('content', f"{_NAMED('description')}[-1]")} END AS description, CAST(len({_NAMED('description')}) AS INT) AS descriptions,
 CASE WHEN len({_NAMED('robots')}) > 0 THEN lower({_attr('content', f"{_NAMED('robots')}[-1]")}) END AS robots, array_to_string(list_sort(list_distinct({_OG})), ',') AS og_keys, 0 AS og_repeated, 0 AS twitter, {_count(_NAMED('viewport'), "contains(t, 'width=device-width')")} > 0 AS viewport_valid,
 {_count('metas', "contains(t, 'charset=')")} > 0 AS charset, regexp_matches(html, '<html lang="[^"]+"') AS lang, {_attr('href', f"list_filter(links, lambda t: {_REL('canonical')})[1]")} AS canonical, {_count('links', _REL('canonical'))} AS canonicals, {_count('links', _REL('icon'))} > 0 AS favicon,
 {_count('links', _REL('manifest'))} > 0 AS manifest, {_count('links', _REL('preconnect'))} > 0 AS preconnect, {_count('links', _REL('preload'))} > 0 AS preload, {_count('scripts', "regexp_matches(t, '^<script[^>]*src=')")} AS external_scripts, 0 AS blocking_scripts, {_count('scripts', "regexp_matches(t, '^<script[^>]*type=.module')")} AS module_scripts,
 {_BYTES(_CODE)} AS inline_script_bytes, {_BYTES('styles')} AS inline_style_bytes, CAST(len({_LD}) AS INT) AS json_ld, array_to_string(list_transform({_LD}, lambda t: regexp_extract(t, '"@type": "([^"]*)"', 1)), ',') AS json_ld_types, 0 AS json_ld_invalid FROM parts"""
_BODY = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*?)(?:</body>|$)', 1), '(?s)<(?:nav|footer|script|style)[ >].*?(?:</(?:nav|footer|script|style)>|$)', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_LINK = f"trim({_attr('href')})"
_OUT = f"(regexp_matches({_LINK}, '^(?:https?:)?//') AND regexp_extract({_LINK}, '^(?:https?:)?//([^/?#]*)', 1) <> {_HOST})"
_POOR = ", ".join(f"'{a}'" for a in sorted(report.POOR_ANCHORS))
BODY = f"""SELECT page_id, array_to_string(hs, ',') AS headings, {_count('regexp_extract_all(html, $$(?s)<h[1-6][^>]*>(.*?)</h[1-6]>$$, 1)', "trim(regexp_replace(t, '<[^>]*>', '', 'g')) = ''")} AS empty_headings, CAST(len(imgs) AS INT) AS images, {_count('imgs', "NOT contains(t, 'alt=')")} AS images_no_alt, {_count('imgs', "contains(t, 'loading=\"lazy\"')")} AS images_lazy,
 {_count('imgs', "regexp_matches(t, '\\bwidth=') AND regexp_matches(t, '\\bheight=')")} AS images_sized, {_count('imgs', "contains(t, 'srcset=')")} AS images_srcset, {_count('imgs', f"regexp_matches({_attr('src')}, '\\.(webp|avif|svg)')")} AS images_modern,
 CASE WHEN starts_with(url, 'https://') THEN {_count('imgs', f"starts_with({_attr('src')}, 'http://')")} + {_count('anchors', f"starts_with({_LINK}, 'http://')")} ELSE 0 END AS mixed_content, {_count('anchors', "contains(t, 'target=\"_blank\"')")} AS blank, {_count('anchors', "contains(t, 'target=\"_blank\"') AND NOT contains(t, 'noopener')")} AS blank_unsafe,
 {_count('anchors', f"{_LINK} <> '' AND NOT {_OUT} AND NOT regexp_matches({_LINK}, '^(#|mailto:|tel:|javascript:)')")} AS internal_links, {_count('anchors', _OUT)} AS external_links,
 array_to_string(list_filter(list_transform(list_filter(anchors, lambda t: regexp_matches({_LINK}, '^#.')), lambda t: {_LINK}), lambda f: NOT contains(html, ' id="' || substr(f, 2) || '"')), ',') AS broken_fragments,
 {_count("regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1)", f"lower(trim(regexp_replace(t, '<[^>]*>', '', 'g'))) IN ({_POOR})")} AS poor_anchors, array_to_string(list_filter([CASE WHEN contains(html, '<nav>') THEN 'nav' END, CASE WHEN contains(html, '<footer>') THEN 'footer' END], lambda x: x IS NOT NULL), ',') AS landmarks,
 CAST(len(list_filter(string_split_regex({_plain(_BODY)}, '\\s+'), lambda w: w <> '')) AS INT) AS words, CAST(strlen(html) AS INT) AS bytes FROM parts"""
HEAD_COLUMNS = "title titles description descriptions robots og_repeated twitter viewport_valid charset lang canonical canonicals favicon manifest preconnect preload external_scripts blocking_scripts module_scripts inline_script_bytes inline_style_bytes json_ld json_ld_invalid".split()
BODY_COLUMNS = "empty_headings images images_no_alt images_lazy images_sized images_srcset images_modern mixed_content blank blank_unsafe internal_links external_links poor_anchors words bytes".split()


@query("html_head", f"WITH parts AS ({PARTS}) {HEAD}", RICH)
def html_head(spark, sf_dir):
    keys = F.array_join(F.array_sort(F.map_keys("og")), ",").alias("og_keys")
    return reports(spark, sf_dir).select("page_id", *HEAD_COLUMNS, keys, F.array_join("json_ld_types", ",").alias("json_ld_types"))


@query("html_body", f"WITH parts AS ({PARTS}) {BODY}", RICH)
def html_body(spark, sf_dir):
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("headings", "broken_fragments", "landmarks")]
    return reports(spark, sf_dir).select("page_id", *BODY_COLUMNS, *lists)


_LEN = lambda c: f"length(coalesce({c}, ''))"
_PART = lambda total, missing, most: f"CASE WHEN {total} = 0 OR {missing} = 0 THEN {most} ELSE round_even(({total} - {missing}) / {total}::DOUBLE * {most}, 0) END"
_SKIP = "len(list_filter(range(1, len(hs)), lambda i: hs[i + 1] > hs[i] + 1)) > 0"
_H1 = "len(list_filter(hs, lambda x: x = 1))"
ALL = f"SELECT h.*, b.* EXCLUDE (page_id, landmarks), b.landmarks, p.hs, round_even(b.bytes / 1024.0::DOUBLE, 1) AS kb FROM ({HEAD}) h JOIN ({BODY}) b USING (page_id) JOIN parts p USING (page_id)"
SCORES = f"""SELECT page_id, CAST(least(100,
 greatest(0, CASE WHEN {_LEN('title')} = 0 THEN 0 WHEN {_LEN('title')} BETWEEN 50 AND 60 THEN 10 WHEN {_LEN('title')} BETWEEN 30 AND 70 THEN 8 ELSE 6 END + CASE WHEN {_LEN('description')} = 0 THEN 0 WHEN {_LEN('description')} BETWEEN 150 AND 160 THEN 8 WHEN {_LEN('description')} BETWEEN 120 AND 170 THEN 7 ELSE 5 END - CASE WHEN titles > 1 THEN 3 ELSE 0 END - CASE WHEN descriptions > 1 THEN 3 ELSE 0 END)
 + greatest(0, CASE WHEN {_H1} = 1 THEN 8 WHEN {_H1} > 1 THEN 3 ELSE 0 END + CASE WHEN len(hs) = 0 THEN 0 WHEN {_SKIP} THEN 2 ELSE 5 END - CASE WHEN words > 0 AND words < 300 THEN 3 ELSE 0 END) + {_PART('images', 'images_no_alt', 10)}
 + greatest(0, CASE WHEN canonicals > 0 THEN 5 ELSE 0 END - CASE WHEN canonicals > 1 THEN 3 ELSE 0 END) + CASE WHEN contains(coalesce(robots, ''), 'noindex') THEN 2 ELSE 5 END + CASE WHEN favicon THEN 5 ELSE 0 END + 5 + CASE WHEN json_ld >= 1 THEN 7 ELSE 0 END + CASE WHEN json_ld >= 2 THEN 3 ELSE 0 END
 + greatest(0, least(2 * len(list_filter(string_split(og_keys, ','), lambda k: k IN ('og:title', 'og:description', 'og:image', 'og:url'))), 6)) + CASE WHEN preconnect THEN 2 ELSE 0 END + CASE WHEN preload THEN 2 ELSE 0 END + CASE WHEN blocking_scripts = 0 THEN 3 WHEN blocking_scripts <= 2 THEN 1 ELSE 0 END
 + CASE WHEN kb <= 100 THEN 4 WHEN kb <= 200 THEN 2 ELSE 1 END + CASE WHEN viewport_valid THEN 2 ELSE 0 END + CASE WHEN charset THEN 3 ELSE 0 END + 1) AS INT) AS seo,
 CAST(CASE WHEN mixed_content = 0 THEN 10 ELSE 0 END + CASE WHEN blank > 0 AND blank_unsafe > 0 THEN round_even((blank - blank_unsafe) / blank::DOUBLE * 5, 0) ELSE 5 END AS INT) AS security,
 CAST(least(100, {_PART('images', 'images_no_alt', 18)} + CASE WHEN lang THEN 5 ELSE 0 END + 13 + greatest(10 - 3 * empty_headings, 0) + least(3 * len(list_filter(string_split(landmarks, ','), lambda k: k <> '')), 10) + {_PART('images', '(images - images_sized)', 4)} + greatest(5 - 2 * empty_headings, 0) + 17) AS INT) AS accessibility,
 CAST(least(100, CASE WHEN kb <= 50 THEN 15 WHEN kb <= 100 THEN 12 WHEN kb <= 200 THEN 7 ELSE 2 END + CASE WHEN blocking_scripts = 0 THEN 15 ELSE 10 END
  + CASE WHEN images = 0 OR images_modern >= images THEN 20 ELSE least(round_even(images_srcset / images::DOUBLE * 10, 0), 10) + CASE WHEN images_modern = 0 THEN 3 ELSE round_even(images_modern / images::DOUBLE * 10, 0) END END
  + CASE WHEN preconnect THEN 8 ELSE 0 END + CASE WHEN preload THEN 7 ELSE 0 END + 5 + CASE WHEN (inline_script_bytes + inline_style_bytes) / 1024.0::DOUBLE <= 10 THEN 10 WHEN (inline_script_bytes + inline_style_bytes) / 1024.0::DOUBLE <= 30 THEN 7 ELSE 4 END
  + CASE WHEN images <= 1 THEN 10 WHEN images_lazy = 0 THEN 3 ELSE greatest(5, round_even(images_lazy / images::DOUBLE * 10, 0)) END) AS INT) AS performance, CASE WHEN coalesce(title, '') = '' OR {_H1} = 0 THEN 1 ELSE 0 END AS p0 FROM ({ALL})"""
_GRADE = "CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END"


@query(
    "html_scores",
    f"""WITH parts AS ({PARTS}) SELECT page_id, seo, security, accessibility, performance, overall, {_GRADE} AS grade, overall < uncapped AS cap_applied FROM (SELECT *, CAST(least(uncapped, CASE WHEN p0 > 0 THEN 59 ELSE 100 END) AS INT) AS overall FROM (
 SELECT *, CAST(round_even(seo * 0.40::DOUBLE + round_even((seo + accessibility + performance) / 3::DOUBLE, 0) * 0.25::DOUBLE + accessibility * 0.15::DOUBLE + performance * 0.20::DOUBLE, 0) AS INT) AS uncapped FROM ({SCORES})))""",
    RICH,
)
def html_scores(spark, sf_dir):
    return report.category_scores(reports(spark, sf_dir)).select("page_id", "seo", "security", "accessibility", "performance", "overall", "grade", "cap_applied")


_RULES = (
    ("critical", f"{_LEN('title')} = 0", "no title"), ("critical", f"{_H1} = 0", "no h1"), ("critical", "NOT lang", "no language"), ("critical", "mixed_content > 0", "mixed content"), ("high", f"{_LEN('description')} = 0", "no description"), ("high", f"{_H1} > 1", "several h1"),
    ("high", "images_no_alt > 0", "images without alt"), ("high", "canonicals = 0", "no canonical"), ("high", "og_keys = ''", "no Open Graph tags"), ("high", "titles > 1", "several titles"), ("high", "descriptions > 1", "several descriptions"), ("high", "canonicals > 1", "several canonicals"),
    ("high", "NOT viewport_valid", "invalid viewport"), ("medium", "bytes > 102400", "large html"), ("medium", "NOT favicon", "no favicon"), ("medium", "true", "no skip link"), ("medium", "NOT charset", "no charset"), ("medium", "empty_headings > 0", "empty headings"), ("medium", "broken_fragments <> ''", "broken fragments"),
    ("medium", "inline_script_bytes > 51200", "large inline scripts"), ("medium", _SKIP, "heading level skipped"), ("medium", f"{_LEN('title')} > 60 OR {_LEN('title')} BETWEEN 1 AND 29", "title length"), ("medium", f"{_LEN('description')} > 160 OR {_LEN('description')} BETWEEN 1 AND 69", "description length"),
    ("medium", "words > 0 AND words < 300", "thin content"), ("low", "true", "no twitter tags"), ("low", "NOT preconnect", "no preconnect"), ("low", "blank_unsafe > 0", "links without noopener"), ("low", "images > 0 AND images_sized = 0", "images without size"), ("low", "images > 3 AND images_srcset = 0", "no responsive images"),
    ("low", "poor_anchors > 0", "poor anchor texts"), ("low", "internal_links = 0 AND words > 0", "no internal links"),
)


@query("html_issues", f"WITH parts AS ({PARTS}), a AS ({ALL}) " + " UNION ALL ".join(f"SELECT page_id, '{s}' AS severity, '{t}' AS issue FROM a WHERE {c}" for s, c, t in _RULES), RICH)
def html_issues(spark, sf_dir):
    return report.issues(reports(spark, sf_dir))


@query(
    "html_budget",
    f"""WITH parts AS ({PARTS}) SELECT page_id, array_to_string(list_filter([CASE WHEN bytes / 1024.0::DOUBLE > 4 THEN 'html_kb' END, CASE WHEN (inline_script_bytes + inline_style_bytes) / 1024.0::DOUBLE > 50 THEN 'inline_total_kb' END, CASE WHEN images - images_lazy > 3 THEN 'images_without_lazy' END,
 CASE WHEN external_scripts > 15 THEN 'external_scripts' END], lambda x: x IS NOT NULL), ',') AS over_budget FROM ({ALL})""",
    RICH,
)
def html_budget(spark, sf_dir):
    rows = report.budget_violations(reports(spark, sf_dir), {"html_kb": 4})
    return rows.select("page_id", F.array_join("over_budget", ",").alias("over_budget"))
