"""Table functions: schemas by call, lateral joins equal the column versions."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import tables
from webloom.operators import crawlpage

HTML = "<link rel=alternate hreflang=de href='/de'><link rel=alternate hreflang=fr href='x'><a href='/a#t' rel=nofollow>one <b>two</b></a><a href='b'>three</a><details><summary>Q?</summary>A <b>b</b></details><script type='application/ld+json'>[{\"@type\": [\"Article\", \"Thing\"]}]</script>"


@pytest.fixture
def pages(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "http://a.example/d/", HTML), (2, "http://b.example/", None), (3, None, "<a href='http://c.example/'>c")], "page_id long, url string, html string")
    df.createOrReplaceTempView("some_pages")
    return df


def test_links_equal_the_column_version(spark, pages):
    lateral = spark.sql("SELECT page_id, l.target, l.anchor, l.rel FROM some_pages, LATERAL page_links(html, url) l")
    columns = crawlpage.crawl_rows(pages).select("page_id", F.explode("links").alias("l")).select("page_id", "l.*")
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, columns.collect())) == [(1, "http://a.example/d/a".replace("/d/a", "/a"), "one two", "nofollow"), (1, "http://a.example/d/b", "three", "")]


def test_the_call_chooses_the_schema(spark, pages):
    got = spark.sql("SELECT * FROM page_alternates('<link rel=alternate hreflang=en href=/e>', 'http://a.example/', 'target, language')")
    assert got.columns == ["target", "language"] and [tuple(r) for r in got.collect()] == [("http://a.example/e", "en")]
    assert spark.sql("SELECT place, question, answer FROM some_pages, LATERAL page_questions(html)").collect() == [(1, "Q?", "A b")]
    assert [tuple(r) for r in spark.sql("SELECT place, type, missing FROM some_pages, LATERAL page_json_ld(html)").collect()] == [(1, "Article", "headline author"), (2, "Thing", "")]
    for bad in ("page_links(html, url, 'nowhere')", "page_links(html, url, url)"):
        with pytest.raises(Exception, match="no column nowhere|constant"):
            spark.sql(f"SELECT * FROM some_pages, LATERAL {bad}").collect()
