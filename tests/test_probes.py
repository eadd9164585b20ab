"""Probe columns, and articles' trust signals."""

from pyspark.sql import functions as F

from webloom.operators import modules, probes


def test_dmarc_takes_the_first_policy(spark):
    df = spark.createDataFrame([(["x", '"v=DMARC1; sp=none; p=reject"'],), (["v=dmarc1"],), (["v=spf1"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(probes.dmarc_policy(F.col("t"))).collect()] == ["none", "none", None, None]


def test_cdn_precedence_and_days(spark):
    df = spark.createDataFrame([({"cf-ray": "1", "x-cdn": "z"}, "Jun  1 12:00:00 2025 GMT"), ({"x-cdn": "z"}, "rubbish"), ({}, None)], "h map<string,string>, e string")
    rows = df.select(probes.cdn(F.col("h")), probes.days_left(F.col("e"), F.lit("2025-05-02").cast("date"))).collect()
    assert [tuple(r) for r in rows] == [("Cloudflare", 30), ("z", None), (None, None)]


def test_trust_signals(spark):
    html = "<article><p>By Jane Doe</p><a href='https://ref.example/'>r</a><a href='https://x.com/me'>s</a></article><a href='/about'>About</a><a href='tel:1'>t</a><script type='application/ld+json'>{\"@type\": \"Organization\", \"sameAs\": []}</script>"
    row = modules.evaluate(spark.createDataFrame([(1, "https://site.example/p", html)], "page_id long, url string, html string"), ["eeat"]).first()
    assert row["points"] == {"authorship": 10, "trust_pages": 5, "entity": 14, "contactable": 6, "transparency": 10}


def test_content_quality_needs_overlap_and_words(spark):
    html = "<head><title>Garden tools</title></head><body><h1>Best garden tools</h1><p>" + "We test many garden tools here every year. " * 60 + "</p><p>&nbsp;</p><footer>&copy; 2019</footer></body>"
    row = modules.evaluate(spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string"), ["content_quality"]).first()
    assert row["points"]["adequate_word_count"] == 25 and row["points"]["title_h1_overlap"] == 15 and row["points"]["no_empty_paragraphs"] == 0 and row["points"]["current_copyright"] == 0
    assert "Old copyright year 2019" in {f["title"] for f in row["findings"]}
