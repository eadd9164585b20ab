"""Page modules, robots rules and topics on hand-written input."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import robots, urls
from webloom.operators import modules, roadmap


def run(spark, html, url="https://www.site.example/a", ids=None):
    rows = modules.evaluate(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"), ids).collect()
    return {r["module"]: r for r in rows}


def titles(row):
    return {f["title"] for f in row["findings"]}


def test_null_page_gets_every_module(spark):
    rows = run(spark, None, None)
    assert set(rows) == set(modules.MODULES) and all(r["total"] >= 0 for r in rows.values())


def test_seo_points(spark):
    html = f"<title>{'t' * 55}</title><meta content='{'d' * 155}' name='description'><h1>x</h1><link rel='canonical' href='/'><meta property='og:title' content='a'><script type='application/ld+json'>{{}}</script>"
    row = run(spark, html, ids=["seo"])["seo"]
    assert row["points"] == {"title_meta": 18, "headings": 8, "canonical": 5, "structured_data": 7, "social": 4, "robots": 5} and not titles(row)
    assert "Page is set to noindex" in titles(run(spark, "<meta name='robots' content='NoIndex'>", ids=["seo"])["seo"])


def test_links(spark):
    html = "<a href='#'>e</a><a href='#x'>f</a><p id='x'><a href='#y'>g</a><a href='mailto:a@b.c?subject=s'>m</a><a href='//other.example/'>o</a><a href='https://www.site.example/b'>i</a>"
    row = run(spark, html, ids=["links"])["links"]
    assert row["points"] == {"no_empty_links": 0, "no_broken_anchors": 0, "external_links_have_noopener": 0, "has_internal_links": 15, "has_external_links": 10, "valid_mailto_format": 10, "reasonable_link_count": 10}


def test_hidden_inputs_need_no_label(spark):
    html = "<html lang='en'><form hidden><input name='a'></form><label for='b'>B</label><input id='b'><input id='c'><h2> <b></b></h2>"
    row = run(spark, html, ids=["accessibility"])["accessibility"]
    assert row["points"]["form_accessibility"] == 6 and row["points"]["heading_structure"] == 7  # half of 13 rounds to even
    assert {"Inputs without labels", "Empty headings"} <= titles(row)


@pytest.mark.parametrize(("canonical", "foreign"), [("https://site.example/a", False), ("http://m.site.example/", False), ("https://west.example/", True), ("/a", False)])
def test_canonical_host(spark, canonical, foreign):
    row = run(spark, f"<link rel='canonical' href='{canonical}'>", ids=["technical_seo"])["technical_seo"]
    assert ("Canonical on another host" in titles(row)) == foreign


def test_own_module(spark):
    modules.weighted("own", {"has_x": ("xyzzy", 40)}, {"has_x": ("P3", "No magic")})
    try:
        assert run(spark, "say XYZZY", ids=["own"])["own"]["total"] == 40
    finally:
        del modules.MODULES["own"]


ROBOTS = "User-agent: A # one\nUser-agent: b\nDisallow: /x\nAllow: /x/y$\nnonsense\nUser-agent: *\nDisallow:\nDisallow: /*.pdf$\n"


def test_robots(spark):
    df = spark.createDataFrame([(ROBOTS,)], "t string")
    df = df.select(robots.groups(df["t"]).alias("g"))
    g = df.first()["g"]
    assert [x["agents"] for x in g] == [["a", "b"], ["*"]] and len(g[0]["rules"]) == 2
    got = df.select(*[robots.posture(df["g"], a).alias(a) for a in ("a", "z")]).first()
    assert got.asDict() == {"a": "partial", "z": "partial"}
    paths = spark.createDataFrame([("/x",), ("/x/y",), ("/x/yz",), ("/f.pdf",)], "p string").crossJoin(df)
    rows = {r["p"]: (r["a"], r["z"]) for r in paths.select("p", robots.disallowed(robots.rules_for(paths["g"], "a"), paths["p"]).alias("a"), robots.disallowed(robots.rules_for(paths["g"], "z"), paths["p"]).alias("z")).collect()}
    assert rows == {"/x": (True, False), "/x/y": (False, False), "/x/yz": (True, False), "/f.pdf": (False, True)}


def test_topics_grow_in_order():
    assert roadmap.group_by_terms([{"red", "shoe"}, {"red", "shoe", "sale"}, {"sale", "shoe"}, set(), {"hat"}]) == [0, 0, 0, -1, 1]


def test_roadmap_actions(spark):
    rows = [("red shoes", "/a", 50.0, 100, 3.0, 0), ("red shoe", "/b", 5.0, 40, 6.0, 1), ("green hat", "", 0.0, 30, 9.0, 2), ("old boots", "/c", 5.0, 20, 12.0, 3), ("tall socks", "/d", 1.0, 10, 40.0, 4)]
    df = spark.createDataFrame(rows, "query string, page string, clicks double, impressions long, position double, ordinal long")
    before = spark.createDataFrame([("old boots", 50.0)], "label string, clicks double")
    got = {r["label"]: r for r in roadmap.roadmap(roadmap.clusters(df), before).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"red shoes": "consolidate", "green hat": "create", "old boots": "refresh", "tall socks": "rework"}
    assert got["red shoes"]["queries"] == ["red shoes", "red shoe"] and got["red shoes"]["pages"] == ["/a", "/b"]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://Ex.com:80?b=2&a=1&UTM_x=9#f", "http://ex.com/?a=1&b=2"), ("https://ex.com:443/p/", "https://ex.com/p/"), ("ftp://ex.com/", None), ("not a url", None),
        ("https://ex.com/?q=a+b%20c&e=&x", "https://ex.com/?e=&q=a+b+c&x="), ("https://ex.com/?gclid=1", "https://ex.com/"), (None, None),
    ],
)
def test_crawl_keys(spark, url, key):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.crawl_key(df["u"])).first()[0] == key


def test_signals_are_evaluated_before_modules_are_listed(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<title>T</title><a href='#'>x</a>")], "page_id long, url string, html string")
    plan = modules.evaluate(pages)._jdf.queryExecution().optimizedPlan().toString()
    listing = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(listing) == 1 and "regexp" not in listing[0] and "RLIKE" not in listing[0]


def test_inferred_pages_go_by_query_not_by_ordinal(spark):
    rows = [("red ring", "", 7), ("blue bolt", "", 7), ("red ring", "", 8), ("old nut", "/kept", 9), ("ring", "", 10)]
    pages = [("https://s.example/red-bolt", "B"), ("https://s.example/ring", "R"), ("https://s.example/a-ring", "A")]
    out = roadmap.infer_pages(spark.createDataFrame(rows, "query string, page string, ordinal int"), spark.createDataFrame(pages, "url string, title string"))
    assert sorted(map(tuple, out.select("query", "page", "ordinal", "inferred").collect())) == [
        ("blue bolt", "", 7, False), ("old nut", "/kept", 9, False), ("red ring", "", 7, False), ("red ring", "", 8, False), ("ring", "https://s.example/a-ring", 10, True),
    ]


def test_robots_rules_are_tried_once_and_by_their_beginning(spark):
    rules = [("disallow", "/a*b$"), ("allow", "/a"), ("disallow", ""), ("disallow", "/x.y"), ("allow", "/x$y"), ("disallow", "/x")]
    rows = spark.createDataFrame([(p, rules) for p in ("/acb", "/acbd", "/x.yz", "/xzy", "/x$yz", "/", None)], f"path string, rules {robots.RULES}")
    blocked = robots.disallowed(F.col("rules"), F.col("path"))
    assert [r[0] for r in rows.select(blocked).collect()] == [True, False, True, True, False, False, False]
