"""JSON-LD, languages and sitemaps on hand-written input."""

from webloom.operators import jsonld, modules
from webloom.sources import sitemaps

GRAPH = """<script type='application/ld+json'>{"@context": ["x", {"v": "https://schema.org"}], "@graph": [{"@type": ["Organization", "Store"], "name": "n", "url": "u", "review": 1},
{"@type": "Thingy", "inner": {"offers": [{"@type": "Product"}]}}, {"@type": "Person"}, {"@type": "Person", "name": "p"}]}</script><script type="application/ld+json">{broken</script>"""


def test_nodes():
    got = jsonld.page_nodes(GRAPH)
    assert (got["blocks"], got["invalid"], got["has_context"], got["products"], got["self_review"]) == (2, 1, True, 1, True)
    assert [(n["type"], n["known"], n["missing"]) for n in got["nodes"]] == [("Organization", True, []), ("Store", True, []), ("Thingy", False, []), ("Person", True, ["name"]), ("Person", True, [])]
    assert jsonld.page_nodes(None)["blocks"] == 0 and jsonld.duplicates(["A", "a", "Person", "person"]) == ["a"]


def test_validation(spark):
    pages = spark.createDataFrame([(1, GRAPH), (2, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in jsonld.validate(jsonld.nodes(pages)).collect()}
    assert got[1]["total"] == 20 + 0 + 15 + 0 + 0 + 10  # persons may repeat
    assert {f["title"] for f in got[2]["findings"]} == {"No structured data found"}


def test_languages(spark):
    html = "<html lang='ar-EG' dir='rtl'><link rel='alternate' hreflang='x-default' href='/'><link rel='alternate' href='https://s.example/a/' hreflang='ar'><link rel='alternate' hreflang='qq' href='/q'>"
    row = modules.evaluate(spark.createDataFrame([(1, "https://s.example/a", html)], "page_id long, url string, html string"), ["i18n"]).first()
    assert row["points"] == {"has_lang_attribute": 20, "hreflang_tags_present": 20, "has_x_default": 15, "self_referencing_hreflang": 15, "valid_language_codes": 0, "rtl_support": 10}


def test_sitemaps(spark):
    index = "<s:sitemapindex xmlns:s='x'><s:sitemap><s:loc> https://a.example/1.xml </s:loc></s:sitemap></s:sitemapindex>"
    urlset = "<urlset><url><loc><![CDATA[https://a.example/?x=1&y]]></loc><lastmod>1</lastmod></url><url><loc>https://b.example/&amp;</loc></url></urlset>\n"
    docs = spark.createDataFrame([("i", "https://a.example", index, True), ("u", "https://a.example", urlset, False), ("n", "https://a.example", None, False)], "sitemap string, site string, xml string, in_robots boolean")
    assert {(r["sitemap"], r["child"], r["url"]) for r in sitemaps.entries(docs).collect()} == {("i", True, "https://a.example/1.xml"), ("u", False, "https://a.example/?x=1&y"), ("u", False, "https://b.example/&")}
    got = {r["sitemap"]: r for r in sitemaps.audit(docs).collect()}
    assert (got["u"]["urls"], got["u"]["foreign"], got["u"]["total"]) == (2, 1, 25 + 15 + 15 + 0 + 10 + 0 + 10 + 5) and got["n"]["total"] == 0


def test_shop_and_local_business(spark):
    html = "<script type='application/ld+json'>{\"@graph\": [{\"@type\": [\"Product\"], \"name\": \"n\", \"offers\": {\"price\": 1}}, {\"@type\": \"Dentist\", \"name\": \"d\", \"telephone\": \"1\", \"address\": \"\"}]}</script><button class='add-to-cart'>Sold out</button><a href=\"tel:1\">Call now</a>"
    rows = {r["module"]: r for r in modules.evaluate(spark.createDataFrame([(1, "https://s.example/a", html)], "page_id long, url string, html string"), ["ecommerce", "local_seo"]).collect()}
    assert rows["ecommerce"]["total"] == 10 + 25 + 15 + 15 and "Stock differs from markup" in {f["title"] for f in rows["ecommerce"]["findings"]}
    assert rows["local_seo"]["total"] == 20 + 0 + 10 + 10 and rows["local_seo"]["detected"]
