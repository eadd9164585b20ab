"""The streaming parse and its scores."""

from pyspark.sql import functions as F

from webloom.operators import report

PAGE = (
    "<html lang='en'><head><title>A title of a fair length for a page</title><meta name='description' content='Short'><meta property='og:title' content='a'><meta property='og:title' content='b'><meta charset='utf-8'>"
    "<meta name='viewport' content='width=device-width, maximum-scale=1'><link rel='canonical' href='/'><script src='http://x.example/a.js'></script><script>var a = 1;</script><script type='application/ld+json'>{\"@type\": \"Thing\"}</script></head>"
    "<body><a href='#main'>Skip</a><nav>menu words</nav><main id='main'><h1>Head</h1><h3></h3><p>Five words are in here</p><img src='photo1.jpg'><a href='#gone'>here</a><a href='https://other.example' target='_blank'>x</a><table><tr><td>1</table><input><form hidden><input></form></main></body></html>"
)


def test_signals():
    s = report.signals_of(PAGE, "https://site.example/")
    assert (s["title"], s["titles"], s["description"], s["og_repeated"], s["zoom_disabled"], s["canonicals"]) == ("A title of a fair length for a page", 1, "Short", 1, True, 1)
    assert (s["headings"], s["h1_texts"], s["empty_headings"], s["images_no_alt"], s["images_generic"]) == ([1, 3], ["Head"], 1, 1, 1)
    assert (s["mixed_content"], s["blocking_scripts"], s["inline_script_bytes"], s["json_ld_types"]) == (1, 1, 10, ["Thing"])
    assert (s["skip_link"], s["broken_fragments"], s["blank_unsafe"], s["external_links"], s["poor_anchors"], s["tables_no_th"]) == (True, ["#gone"], 1, 1, 1, 1)
    assert (s["inputs"], s["inputs_unlabelled"], s["landmarks"], s["lang"], s["error"]) == (1, 1, ["nav", "main"], True, None)


def test_rows_scores_and_issues(spark):
    pages = spark.createDataFrame([(1, "https://site.example/", PAGE), (2, None, None), (3, "http://x/", "<<<not <b html")], "page_id long, url string, html string")
    rows = report.analyse(pages)
    got = {r["page_id"]: r for r in report.category_scores(rows).collect()}
    assert set(got) == {1, 2, 3} and got[2]["overall"] <= 59 and all(0 <= r[k] <= 100 for r in got.values() for k in ("seo", "security", "accessibility", "performance"))
    assert got[1]["security"] == 0 + 0 and got[1]["seo"] == 5 + 3 + 4 + 1 + 8 + 2 - 3 + 0 + 5 + 5 + 0 + 5 + 7 + 0 + 1 + 4 + 2 + 3 + 1
    named = {(r["severity"], r["issue"]) for r in report.issues(rows).filter("page_id = 1").collect()}
    assert {("critical", "mixed content"), ("medium", "heading level skipped"), ("low", "poor anchor texts")} <= named
    assert [r["over_budget"] for r in report.budget_violations(rows, {"html_kb": 0}).orderBy("page_id").collect()][0] == ["html_kb"]


def test_semantics():
    html = (
        "<div class='card btn-x'>a</div><span style='cursor: pointer' onclick=x>b</span><span class=link role=button>c</span><a role=button href=/>d</a><p role=Directory><p role='nope'><p role=nope>Lorem ipsum dolor</p><p>A placeholder</p>"
        "<svg><title>n</title></svg><svg aria-hidden=true></svg><svg><path></svg>"
    )
    s = report.signals_of(html, "https://a/")
    assert (s["fake_affordances"], s["links_as_buttons"], s["aria_invalid"], s["aria_deprecated"], s["placeholders"], s["svgs"], s["svgs_unnamed"]) == (1, 1, ["nope"], ["directory"], 2, 3, 1)


def test_issues_soften_for_client_side_pages(spark):
    rows = report.analyse(spark.createDataFrame([(1, "https://a/", "<svg></svg>", ["React"], []), (2, "https://a/", "<svg></svg>", [], ["Heap"])], "page_id long, url string, html string, frameworks array<string>, analytics array<string>"))
    found = {k: {(r["severity"], r["issue"]) for r in report.issues(rows).filter(f"page_id = {k}").collect()} for k in (1, 2)}
    assert {("high", "no h1 in served html"), ("low", "drawings without a name in served html"), ("low", "no skip link in served html"), ("low", "no analytics")} <= found[1]
    assert {("critical", "no h1"), ("medium", "drawings without a name"), ("medium", "no skip link")} <= found[2] and ("low", "no analytics") not in found[2]


def test_render_gap_costs_points(spark):
    rows = report.analyse(spark.createDataFrame([(1, "https://a/", PAGE)], "page_id long, url string, html string"))
    usual = report.category_scores(rows).first()["seo"]
    gap = rows.withColumns({k: F.lit(k in ("content_client_only", "structured_data_client_only")) for k in report.GAP_COSTS})
    assert report.category_scores(gap).first()["seo"] == max(0, usual - report.GAP_COSTS["content_client_only"] - report.GAP_COSTS["structured_data_client_only"])
