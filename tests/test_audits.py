"""Advisor, headers, providers, crawl parsing, readers and sinks on hand-written input."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from webloom.operators import advisor, checks, compare, crawler, crawlpage, detection, graph, headers, modules, providers, report, rollups, style
from webloom.sources import documents, sinks, stores

SHOP = (
    "<html><head><title>Blue  lamp | Lights&Co</title><meta property='og:type' content='product'><meta property='og:image' content='/lamp.png'><meta name='description' content=\"Joe's lamp\"></head><body><h1>Blue <b>lamp</b></h1>"
    "<p>$ 19.90 or EUR12.50, in stock</p><a href='tel:+44 1'>call</a><a href='mailto:a@b.example?subject=x'>mail</a><a href='https://m.facebook.com/joe?x=1'>f</a><a href='https://facebook.com/share/joe'>s</a><a href='https://netflix.com/'>n</a>"
    "<script type='application/ld+json'>{\"@type\": [\"Organization\", \"Thing\"], \"name\": \"Lights\"}</script><script type='application/ld+json'>{broken</script></body></html>"
)


def frame(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def advice(spark):
    rows = [(1, "https://shop.example/product/lamp", SHOP), (2, None, None), (3, "https://site.example/", "<title>-</title>"), (4, "https://site.example/contact", "<details><summary>Q?</summary></details>" * 2)]
    return {r["page_id"]: r for r in advisor.advise(frame(spark, rows)).collect()}


def test_signals_of_a_product_page(advice):
    s = advice[1]["signals"]
    assert (s["name"], s["title"], s["h1"], s["description"]) == ("Lights", "Blue lamp | Lights&Co", "Blue lamp", "Joe's lamp")
    assert (s["phone"], s["email"], s["logo"], s["socials"]) == ("+44 1", "a@b.example", "https://shop.example/lamp.png", ["https://m.facebook.com/joe"])
    assert (s["price"], s["currency"], s["availability"], s["types"]) == ("19.90", "EUR", "https://schema.org/InStock", ["organization", "thing"])
    assert advice[1]["labels"] == ["pdp"] and advice[1]["merchant_missing"] == ["product_schema", "rating_or_reviews"]


def test_recommended_markup(advice):
    found = {r["type"]: r for r in advice[1]["recommendations"]}
    assert list(found) == ["Organization", "WebSite", "BreadcrumbList", "Product"] and found["Organization"]["status"] == "incomplete" and found["Product"]["priority"] == "P0"
    product = json.loads(found["Product"]["jsonld"])
    assert product["offers"] == {"@type": "Offer", "url": "https://shop.example/product/lamp", "priceCurrency": "EUR", "price": "19.90", "availability": "https://schema.org/InStock", "itemCondition": "https://schema.org/NewCondition"}
    assert product["name"] == "Blue lamp" and product["image"] == ["https://shop.example/lamp.png"] and "aggregateRating" not in product and found["Product"]["needs_input"] == ["sku"]
    organization = json.loads(found["Organization"]["jsonld"])
    assert list(organization) == ["@context", "@type", "name", "url", "logo", "image", "telephone", "email", "sameAs"] and organization["sameAs"] == ["https://m.facebook.com/joe"]
    trail = json.loads(found["BreadcrumbList"]["jsonld"])["itemListElement"]
    assert [x["position"] for x in trail] == [1, 2, 3] and trail[2] == {"@type": "ListItem", "position": 3, "name": "Blue lamp"}


def test_kinds_of_pages(advice):
    assert advice[2]["labels"] == ["home"] and advice[3]["labels"] == ["home"] and advice[3]["signals"]["name"] is None and advice[4]["labels"] == ["contact", "faq"]
    questions = json.loads({r["type"]: r for r in advice[4]["recommendations"]}["FAQPage"]["jsonld"])["mainEntity"]
    assert questions[0] == {"@type": "Question", "name": "Q?", "acceptedAnswer": {"@type": "Answer", "text": "REPLACE_answer"}}
    assert {r["type"] for r in advice[2]["recommendations"]} == {"Organization", "WebSite"}


@pytest.mark.parametrize(("given", "points", "assessed"), [
    ({}, 15, False), (None, 15, False), ({"Content-Security-Policy": "frame-ancestors x", "STRICT-TRANSPORT-SECURITY": "preload"}, 15 + 30 + 8 + 13, True), ({"content-security-policy-report-only": "x", "X-Content-Type-Options": "NOSNIFF"}, 15 + 13 + 8, True),
    ({"strict-transport-security": "max-age=1; includeSubDomains; preload", "x-frame-options": "SameOrigin", "referrer-policy": "x", "permissions-policy": ""}, 15 + 18 + 8 + 8 + 13, True),
])
def test_header_points(spark, given, points, assessed):
    row = spark.createDataFrame([(given,)], "h map<string,string>").select(*[c.alias(k) for k, c in headers.security_score(F.lit(0), F.lit(0), F.lit(0), F.col("h")).items()]).first()
    assert (row["security"], row["security_assessed"]) == (points, assessed)


def test_headers_reach_the_report(spark):
    rows = spark.createDataFrame([(1, "https://a/", "<html></html>", {"X-Frame-Options": "DENY"}), (2, "https://a/", "<html></html>", None)], "page_id long, url string, html string, headers map<string,string>")
    got = {r["page_id"]: r for r in report.category_scores(report.analyse(rows)).collect()}
    assert got[1]["security"] == 23 and got[1]["security_assessed"] and got[2]["security"] == 15 and not got[2]["security_assessed"]
    module = {r["page_id"]: r for r in modules.evaluate(rows, ["security"]).collect()}
    assert module[1]["total"] == 23 and {f["title"] for f in module[1]["findings"]} >= {"Missing Content-Security-Policy header"} and not module[2]["findings"]


def test_long_pages_are_read_in_linear_time():
    html = "<body>" + "<p>word " * 20000 + "<ul>" + "<li>item" * 20000 + "<a>x<a>here</a></a>"
    s = report.signals_of(html, "https://a/")
    assert s["error"] is None and s["words"] == 40002 and s["poor_anchors"] == 1


def test_providers(spark):
    html = "<script src='https://analytics.TikTok.com/i18n'></script><script>pintrk('x'); fbq(1)</script><script src=\"//cdn.cookie-yes.com/a\"></script><div id=\"root\"></div>"
    row = providers.analyse(frame(spark, [(1, "u", html), (2, "u", None)]).withColumn("words", F.lit(3)), F.col("words")).orderBy("page_id").collect()
    assert row[0]["analytics"] == ["Facebook Pixel", "Pinterest Tag", "TikTok Pixel"] and row[0]["consent"] == ["CookieYes"] and row[0]["frameworks"] == ["Client-rendered SPA"]


def test_crawl_rows_and_text_parts(spark):
    html = "<html lang=' en '><head><title>A <b>t</b></title><meta name=description content=' d '><meta name=description content=e><link rel='x canonical' href='/c'></head><body><nav>menu</nav><h1> One  two </h1><h2>s</h2><p>para <i>graph</i></p><img alt=' '><img alt=x><a href='p#f' target=_blank>li nk</a><script>no words</script></body></html>"
    row = crawlpage.crawl_rows(frame(spark, [(1, "https://s.example/d/", html), (2, None, None)])).orderBy("page_id").collect()
    assert (row[0]["title"], row[0]["meta_desc"], row[0]["canonical"], row[0]["h1"], row[0]["html_lang"]) == ("A t", "d", "https://s.example/c", ["One two"], "en")
    assert (row[0]["images_no_alt"], row[0]["blank_no_noopener"], row[0]["word_count"]) == (1, 1, 2 + 1 + 2 + 1 + 2 + 2) and [tuple(x) for x in row[0]["links"]] == [("https://s.example/d/p", "li nk", "")]
    assert row[1]["title"] is None and row[1]["word_count"] == 0 and row[1]["content_hash"] is None
    parts = crawlpage.text_parts(frame(spark, [(1, "u", html)])).first()
    assert parts["body_text"].split() == ["One", "two", "spara", "graphli", "nk"] and parts["h1_texts"] == ["One  two"] and parts["paragraphs"] == ["para  graph"] and parts["meta_description"] == "e"


@pytest.mark.parametrize(("host", "blocked"), [("127.0.0.1", True), ("172.32.0.1", False), ("100.64.1.1", False), ("::ffff:127.0.0.1", True), ("::ffff:10.0.0.1", True), ("0:0:0:0:0:0:0:1", True), ("2001:db8::1", True), ("64:ff9b::1", True), ("::ffff:8.8.8.8", False), ("2606:4700::1111", False), ("fe80::1%eth0", True), ("8.8.8.8", False), ("[fe80::1]", True), ("site.example", False), (None, True), ("256.1.1.1", False), ("224.0.0.1", True)])
def test_hosts_off_limits(spark, host, blocked):
    assert spark.createDataFrame([(host,)], "h string").select(crawler.host_is_blocked(F.col("h"))).first()[0] == blocked


def test_a_stopped_throttle_stays(spark):
    waves = [(9, 10)] * 7 + [(0, 10)] * 3
    got = spark.createDataFrame([([{"blocked": b, "total": t} for b, t in waves],)], "w array<struct<blocked:int,total:int>>").select(crawler.throttle(F.col("w")).alias("t")).first()["t"]
    assert (got["delay"], got["stopped"]) == (6.0, True)


def test_frontier_caps_what_is_seen(spark):
    links = spark.createDataFrame([("http://a.example/", f"http://a.example/{i}") for i in range(9)] + [("http://a.example/0", "http://b.example/"), ("http://a.example/0", "http://a.example/deep")], "source string, target string")
    rows = crawler.frontier(links, "http://a.example/", None, 2, 5).collect()
    assert len(rows) == 5 and {r["url"] for r in rows if r["depth"]} == {f"http://a.example/{i}" for i in range(4)}
    assert {r["url"] for r in crawler.frontier(links, "http://a.example/", None, 2, 50).filter("depth = 2").collect()} == {"http://a.example/deep"}


def test_meta_refresh_and_soft_404(spark):
    hops = spark.createDataFrame([("a", 301, "b", None, None), ("b", 200, None, "c", "x"), ("c", 200, None, None, "Page not found"), ("d", 200, None, "d", "x")], "url string, status int, redirect_to string, refresh_to string, title string")
    rows = {r["start"]: r for r in graph.redirect_chains(hops).collect()}
    assert (rows["a"]["path"], rows["a"]["meta_refresh"], rows["a"]["soft_404"]) == (["a", "b", "c"], True, True) and rows["d"]["loop"]
    named = {r["issue"] for r in graph.chain_issues(graph.redirect_chains(hops)).filter("start = 'a'").collect()}
    assert named == {"Redirect chain (2 hops)", "Meta-refresh redirect", "Soft 404"}


def test_capped_scores_and_modules(spark):
    categories = spark.createDataFrame([(1, 90, 90, True, 90, 90), (2, 90, 10, False, 90, 90)], "page_id long, seo int, security int, security_assessed boolean, accessibility int, performance int")
    findings = spark.createDataFrame([(1, "seo", "P0"), (2, "pwa", "P0"), (2, "security", "P1")], "page_id long, module string, priority string")
    rows = {r["page_id"]: r for r in detection.capped_scores(categories, findings).collect()}
    assert (rows[1]["overall"], rows[1]["p0"], rows[2]["overall"], rows[2]["p1"]) == (59, 1, 90, 1)
    page = spark.createDataFrame([("<form>",)], "html string").select(detection.modules_for(F.col("html"), "ecommerce", disable=["links"]).alias("m")).first()["m"]
    assert {"email_deliverability", "ecommerce"} <= set(page) and "links" not in page and page == sorted(page)


def test_module_totals_and_findings_agree(spark):
    rows = modules.evaluate(frame(spark, [(1, "https://a/", SHOP), (2, "https://b/", None)]))
    totals = {r["module"]: r for r in rows.filter("page_id = 1").collect()}
    for r in totals.values():
        assert r["total"] == sum(r["points"].values())
    listed = modules.findings(rows).filter("page_id = 1 and module = 'seo'").collect()
    assert {(r["priority"], r["title"]) for r in listed} == {("P2", "Missing canonical URL")}
    merged = rollups.merged([modules.findings(rows), spark.createDataFrame([(9, "x", "P9", "late")], "page_id long, module string, priority string, title string")]).collect()
    assert [r["priority"] for r in merged] == sorted(r["priority"] for r in merged) and merged[-1]["title"] == "late" and merged[-1]["id"] is None


def test_text_of_a_site_audit(spark):
    pages = spark.createDataFrame([("http://a/1", "T", "", 500, None, 10, 0, 900, "text/html", None, 1, "h")], "url string, title string, meta_desc string, status int, error string, response_ms int, in_sitemap int, word_count int, content_type string, redirect_to string, indexable int, content_hash string")
    links = spark.createDataFrame([("http://a/2", "http://a/1", "x", "", "internal")], "source string, target string, anchor string, rel string, type string")
    found = checks.findings(pages, links)
    first = found.first()
    assert first["title"] == "Server errors (5xx) during crawl" or first["priority"] == "P0"
    assert first["description"].startswith("1 affected. ") and "Examples: http://a/1" in first["description"]
    lines = [r["text"] for r in sinks.audit_text(found, checks.stats(pages, links)).orderBy("line").collect()]
    assert lines[0] == "Site-wide audit: 1 pages crawled, 1 indexable, 1 internal links" and lines[1].startswith("P0: ") and len(lines) == 1 + 3 * found.count()
    assert [r["text"] for r in sinks.audit_text(found.limit(0), checks.stats(pages, links)).orderBy("line").collect()][1:] == ["No site-level issues found."]


def test_readers(spark, tmp_path):
    assert documents.budget('{"html_kb": 7, "other": 1, "css": true}', {"html_kb": 100}) == ({"html_kb": 7}, None)
    assert documents.budget(str(tmp_path / "none.json"), {"a": 1}) == ({"a": 1}, "the budget can't be read: FileNotFoundError")
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as archive:
        archive.writestr("queries.csv", "﻿query,clicks\na,1\n")
        archive.writestr("readme.txt", "no")
    got = documents.zipped_csv(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["member"], r["text"]) for r in got] == [("queries.csv", "query,clicks\na,1\n")]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("u", 200, 0, "<a href='x'>", 1), ("u", 404, 1, "", 2), ("v/../w", 200, 1, "<p>", 3)], "url string, status int, depth int, html string, ordinal int")
    links = spark.createDataFrame([("u", "v")], "source string, target string")
    sinks.crawl_store(pages, links, spark.createDataFrame([("u",), ("u",), (None,)], "url string"), {"start": "u"}, str(tmp_path / "store"))
    rows = {r["url"]: (r["status"], r["in_sitemap"]) for r in stores.read(spark, str(tmp_path / "store/pages")).collect()}
    assert rows == {"u": (404, 1), "v/../w": (200, 0)}
    document = json.loads(sinks.scores_document(spark.createDataFrame([("P1", "b"), ("P0", "a"), ("P1", "c")], "priority string, title string"), "ga", 2).first()["document"])
    assert [f["title"] for f in document["findings"]] == ["a", "b"] and document["summary"]["P1"] == 2 and document["module_scores"] == {"ga": {"findings": 3}}
    manifest = sinks.html_manifest(pages.filter("ordinal < 3").withColumn("url", F.concat(F.lit("http://s.example/a/"), "url")), str(tmp_path / "html")).collect()
    assert [(r["file"], r["links_found"]) for r in manifest] == [("a_u.html", 1), (None, 0)]
    sinks.by_site(spark.createDataFrame([("My Site!", "{}")], "name string, document string"), str(tmp_path / "sites"))
    assert [r["site"] for r in spark.read.json(str(tmp_path / "sites/sites")).select("site").collect()] == ["my-site-"]


def test_palettes_and_pictures(spark):
    css = spark.createDataFrame([(1, "a{color:#FFF} b{color:#c00} c{color:#fff;x:#c00000}"), (2, "none")], "k long, css string")
    rows = {r["k"]: r for r in style.palette(css, "k").collect()}
    assert rows[1]["palette"] == ["#fff", "#c00", "#c00000"] and rows[1]["accent"] == "#c00" and (rows[2]["accent"], rows[2]["palette"]) == (style.ACCENT, [])
    now = spark.createDataFrame([("a", [1, 2]), ("b", [1]), ("c", [])], "name string, pixels array<int>")
    before = spark.createDataFrame([("a", [1, 3]), ("c", [])], "name string, pixels array<int>")
    assert {r["name"]: r["difference"] for r in compare.against_baseline(now, before).collect()} == {"a": 50.0, "b": -1.0, "c": 0.0}
