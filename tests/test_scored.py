"""Scored documents and user modules on hand-written pages."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import modules, scored, usermodules

PAGES = "page_id long, url string, html string"


@pytest.fixture
def user(monkeypatch):
    monkeypatch.setattr(usermodules, "USER_MODULES", {})

    def third(html, url):
        if html.endswith("3"):
            raise KeyError("third")
        if html.endswith("4"):
            return {"points": {"a": "much"}}
        return {"points": {"a": 2, "b": 3}, "findings": [("P0", "Broken \"quote\""), ("P9", "Odd")], "details": {"url": url, "deep": [{"x": None}]}}

    usermodules.register(usermodules.UserModule("third", third))
    usermodules.register(usermodules.UserModule("quiet", lambda html, url: {}, lambda html: "<q" in html))


def pages(spark):
    return spark.createDataFrame([(i, f"http://a.example/{i}", f"<title>A page</title><p>{i}") for i in (1, 3, 4)] + [(7, None, None)], PAGES)


def test_a_failing_module_fails_alone(spark, user):
    got = {(r["page_id"], r["module"]): r for r in usermodules.evaluate(pages(spark), ["third", "quiet"]).withColumn("details", F.to_json("details")).collect()}
    assert got[1, "third"]["total"] == 5 and got[1, "third"]["points"] == {"a": 2, "b": 3} and json.loads(got[1, "third"]["details"]) == {"url": "http://a.example/1", "deep": [{"x": None}]}
    assert got[3, "third"]["error"] == "KeyError: 'third'" and got[3, "third"]["total"] is None and got[3, "third"]["findings"] == []
    assert got[4, "third"]["error"].startswith("ValueError") and got[7, "third"]["total"] == 5 and not got[1, "quiet"]["detected"]
    assert usermodules.evaluate(pages(spark).limit(0), ["third"]).count() == 0


def test_findings_of_both_kinds_merge(spark, user):
    found = modules.findings(scored.evaluated(pages(spark), ["seo", "third"]))
    rows = {(r["page_id"], r["module"], r["title"]) for r in found.collect()}
    assert (1, "third", 'Broken "quote"') in rows and (3, "seo", "Missing canonical URL") in rows and not any(p == 3 and m == "third" for p, m, _ in rows)


def test_the_document_of_a_page(spark, user):
    got = {r["page_id"]: json.loads(r["d"]) for r in scored.documents(pages(spark), ["seo", "third", "quiet"]).select("page_id", F.to_json("document").alias("d")).collect()}
    one, three = got[1], got[3]
    assert one["module_scores"]["third"] == {"total": 5, "points": {"a": 2, "b": 3}, "details": {"url": "http://a.example/1", "deep": [{"x": None}]}} and "quiet" not in one["module_scores"]
    assert three["module_scores"]["third"] == {"error": "KeyError: 'third'"} and three["module_scores"]["seo"]["total"] == one["module_scores"]["seo"]["total"]
    assert one["findings"][0]["title"] == 'Broken "quote"' and one["findings"][-1]["priority"] == "P9" and one["summary"]["P0"] == 1 and three["summary"]["P0"] == 0
    assert one["overall"]["modules_scored"] and one["overall"]["score"] == three["overall"]["score"]  # a user's module never caps the grade
    assert one["seo"]["score"] > 0 and one["security"]["assessed"] is False and set(got) == {1, 3, 4, 7}
    found = scored.findings(scored.documents(pages(spark), ["third"]))
    assert {(r["page_id"], r["title"]) for r in found.collect()} == {(p, t) for p in (1, 7) for t in ('Broken "quote"', "Odd")}
    only = scored.documents(pages(spark), ["quiet"]).select(scored.part("$.overall.modules_scored", "boolean"), scored.part("$.module_scores", "string")).distinct().collect()
    assert [tuple(r) for r in only] == [(False, "{}")]
