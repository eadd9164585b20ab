"""Site checks and findings state on small crawls."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import checks, graph, state
from webloom.sources.driver_views import VIEWS, with_views

PAGES = "url string, status int, redirect_to string, content_type string, response_ms int, title string, meta_desc string, word_count int, content_hash string, indexable int, in_sitemap int, error string"
LINKS = "source string, target string, anchor string, rel string, type string"


def page(url, status=200, **over):
    row = {"url": url, "status": status, "redirect_to": None, "content_type": "text/html", "response_ms": 100, "title": f"Title {url}", "meta_desc": f"About {url}", "word_count": 500, "content_hash": f"h{url}", "indexable": 1, "in_sitemap": 0, "error": None}
    return tuple((row | over).values())


def crawl(spark, pages, links=()):
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame([(s, t, "a", "", "internal") for s, t in links], LINKS)


def counts(spark, pages, links=()):
    return {r["key"]: r["count"] for r in checks.affected(*crawl(spark, pages, links)).collect()}


def test_refusals_by_bots_and_limits_are_not_broken(spark):
    n = counts(spark, [page("/a", 403), page("/b", 429), page("/c", 404), page("/d", 500)], [("/x", "/a"), ("/x", "/c"), ("/y", "/c"), ("/x", "/d")])
    assert n["broken_4xx"] == 1 and n["server_5xx"] == 1
    assert n["broken_internal_links"] == 3  # links, not pages


def test_duplicates_count_the_surplus(spark):
    n = counts(spark, [page("/a", title="T"), page("/b", title="T"), page("/c", title="T"), page("/d", title=""), page("/e", title=""), page("/f", title="T", indexable=0)])
    assert n["duplicate_title"] == 2 and n["duplicate_content"] == 0


def test_blocked_is_no_fetch_error_in_any_case(spark):
    n = counts(spark, [page("/a", None, error="BLOCKED by robots"), page("/b", None, error="timed out", in_sitemap=1)])
    assert n["fetch_errors"] == 1 and n["sitemap_broken"] == 1


def test_orphans_and_redirects_need_internal_links(spark):
    pages = [page("/a"), page("/b"), page("/c", 301, redirect_to="/c/"), page("/d", 302, redirect_to="/x", in_sitemap=1)]
    rows = {r["key"]: r for r in checks.affected(*crawl(spark, pages, [("/a", "/b"), ("/a", "/a"), ("/b", "/c")])).collect()}
    assert rows["orphan_pages"]["count"] == 0  # a link to itself counts
    assert rows["internal_redirects"]["count"] == 1 and rows["internal_redirects"]["slash_hops"] == 1
    assert rows["sitemap_redirects"]["count"] == 1 and rows["sitemap_redirects"]["slash_hops"] == 0


def test_findings_are_ordered_and_say_what_is_left_out(spark):
    pages = [page(f"/s{i:02d}", response_ms=3000 + i) for i in range(11)] + [page("/e", 503)]
    found = checks.findings(*crawl(spark, pages)).collect()
    assert [f["priority"] for f in found] == sorted(f["priority"] for f in found)
    slow = next(f for f in found if f["key"] == "slow_pages")
    assert slow["count"] == 11 and "(+3 more)" in slow["description"] and "/s10  (3010ms)" in slow["description"]


def test_drill_down_takes_one_select_only(spark):
    spark.range(80).createOrReplaceTempView("drill")
    assert checks.drill_down(spark, " SELECT id FROM drill").count() == 50
    for bad in ("DROP TABLE drill", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) SELECT * FROM a"):
        with pytest.raises(ValueError, match="one SELECT"):
            checks.drill_down(spark, bad)


STATE = "id string, module string, title string, priority string, status string, first_seen string, last_seen string, resolved_at string, note string"


def test_state_machine(spark):
    kept = [("a", "seo", "A", "P1", "open"), ("b", "seo", "B", "P1", "open"), ("c", "links", "C", "P1", "open"), ("d", "seo", "D", "P1", "resolved"), ("e", "seo", "E", "P1", "wontfix")]
    before = spark.createDataFrame([(*k, "t0", "t0", None, None) for k in kept], STATE)
    now = spark.createDataFrame([("a", "seo", "A", "P0"), ("d", "seo", "D", ""), ("e", "seo", "E", "P2"), ("f", "seo", "F", "P3")], "id string, module string, title string, priority string")
    out = {r["id"]: r for r in state.merge(before, now, spark.createDataFrame([("seo",)], "module string"), "t1").collect()}
    assert {k: (r["status"], r["event"]) for k, r in out.items()} == {
        "a": ("open", "still_open"), "b": ("resolved", "resolved"), "c": ("open", "skipped"), "d": ("open", "reopened"), "e": ("wontfix", "kept"), "f": ("open", "new"),
    }
    assert out["a"]["priority"] == "P0" and out["d"]["priority"] == "P1"  # an empty priority doesn't overwrite
    assert out["b"]["resolved_at"] == "t1" and out["d"]["notes"][-1]["text"].startswith("Regression") and out["f"]["first_seen"] == "t1"


def test_samples_of_large_groups_stay_short(spark):
    pages, links = crawl(spark, [page(f"/{i:03}", content_hash="same") for i in range(30)] + [page("/x", content_hash="two"), page("/y", content_hash="two")], [])
    got = [r["sample"] for r in checks.samples(pages, links).filter("key = 'duplicate_content'").orderBy("place").collect()]
    assert got == ["  =  ".join(f"/{i:03}" for i in range(8)) + "  (+22 more)", "/x  =  /y"]


def test_a_hub_of_redirects_and_long_chains(spark, monkeypatch):
    hops = [("/hub", 200, None)] + [(f"/{i}", 301, "/hub") for i in range(50)] + [(f"/c{i}", 302, f"/c{i + 1}") for i in range(14)] + [("/out", 301, "http://elsewhere/")]
    for most in (200_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_TARGETS", most)
        chains = {r["start"]: r for r in graph.redirect_chains(spark.createDataFrame(hops, "url string, status int, redirect_to string")).collect()}
        assert len(chains) == 65 and {chains[f"/{i}"]["final_status"] for i in range(50)} == {200} and chains["/c0"]["hops"] == 10 and chains["/c9"]["final_url"] == "/c14"
        assert chains["/out"]["final_status"] is None and chains["/out"]["statuses"] == [301, None]
    plan = graph.redirect_chains(spark.createDataFrame(hops, "url string, status int, redirect_to string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # each hop is written, none is worked out again


def test_redirect_loops_end(spark):
    hops = spark.createDataFrame([("/a", 301, "/b"), ("/b", 302, "/a"), ("/c", 301, "/d"), ("/d", 404, None)], "url string, status int, redirect_to string")
    chains = {r["start"]: r for r in graph.redirect_chains(hops).collect()}
    assert chains["/a"]["loop"] and chains["/a"]["path"] == ["/a", "/b"]
    assert not chains["/c"]["loop"] and chains["/c"]["final_status"] == 404 and chains["/c"]["hops"] == 1
    issues = {(r["start"], r["priority"]) for r in graph.chain_issues(graph.redirect_chains(hops)).collect()}
    assert ("/a", "P0") in issues and ("/c", "P1") in issues


def test_breadth_first_depths(spark):
    _, links = crawl(spark, [page("/")], [("/", "/a"), ("/a", "/b"), ("/b", "/"), ("/b", "/c"), ("/a", "/a")])
    got = {r["url"]: r["depth"] for r in graph.depths(links, spark.createDataFrame([("/",)], "url string"), 2).collect()}
    assert got == {"/": 0, "/a": 1, "/b": 2}


def test_reading_grade_needs_thirty_words(spark):
    rows = spark.createDataFrame([("one two.",), ("The cat sat on the mat. " * 6,)], "t string")
    short, long = [r[0] for r in rows.select(text.reading_grade(rows["t"])).collect()]
    assert short is None and long == pytest.approx(-1.4, abs=0.3)


def test_views_nest():
    sql = with_views("SELECT 1 FROM crawl_links", "crawl_links")
    assert sql.index("crawl_pages AS") < sql.index("crawl_links AS") and set(VIEWS) >= {"crawl_pages", "crawl_links"}


def test_reading_grade_rounds_as_doubles_do(spark):
    words = ". ".join(" ".join(["cat"] * n) for n in (10, 10, 10, 10, 10, 10, 8)) + "."
    grade = spark.createDataFrame([(words,)], "t string").select(text.reading_grade(F.col("t"))).first()[0]
    assert str(grade) == "-0.0"  # 0.39 * 68 / 7 + 11.8 - 15.59 = -0.0014
