"""Exports of several shapes."""

import json

from pyspark.sql import functions as F

from webloom.sources import logs


def test_search_json_shapes(spark):
    docs = [json.dumps(d) for d in ([{"query": "a", "page": "/p", "clicks": 1, "impressions": 4, "ctr": "25%", "position": 2.5}], {"rows": [{"keys": ["b", "/q"], "clicks": 2, "impressions": 8}]}, {"data": [{"keys": ["c"], "ctr": 12}, {"clicks": None}]}, {})]
    rows = {r["query"]: r for r in logs.search_json(spark.createDataFrame([(d,) for d in docs], "json string")).collect()}
    assert (rows["a"]["ctr"], rows["a"]["position"]) == (0.25, 2.5)
    assert (rows["b"]["page"], rows["b"]["ctr"], rows["b"]["position"]) == ("/q", 0.25, None)
    assert (rows["c"]["ctr"], rows["c"]["page"], rows[""]["clicks"]) == (0.12, "", 0.0)


def test_search_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Top queries,Clicks,Impressions,CTR,Position\nred,"1,234","9,000",13.7%,3.4\nblue,1,10000,0.01%,8\n,1,1,1%,1\n')
    got = [tuple(r) for r in logs.search_csv(spark, str(tmp_path / "q.csv")).collect()]
    assert got == [("blue", "", 1.0, 10000.0, 8.0), ("red", "", 1234.0, 9000.0, 3.4)]


def test_landing_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("# report\n# 2024\nLanding page,Sessions,Engagement rate,Key events\n/a?x=1,\"1,200\",45.5,3\n/b,10,0.25,0\nGrand total,1210,1,3\n")
    got = [tuple(r) for r in logs.landing_csv(spark, str(tmp_path / "l.csv")).orderBy("page").collect()]
    assert got == [("/a", 1200, 0.455, 3), ("/b", 10, 0.25, 0)]


def test_semicolons_and_charset(spark):
    rows = logs.semicolon_rows(spark.createDataFrame([("A;B\n1;2;3\n4\n\n",)], "text string")).collect()
    assert [r["row"] for r in rows] == [{"A": "1", "B": "2"}, {"A": "4"}]
    pages = [(b"\xef\xbb\xbfx", "latin-1"), (b"\xff\xfex", None), (b"x", "koi8-r"), (b"<meta charset='Windows-1252'>", None), (b"<meta http-equiv=x content='text/html; charset=EUC-JP'>", ""), (b"", None)]
    df = spark.createDataFrame([(bytearray(b), h) for b, h in pages], "b binary, h string")
    assert [r[0] for r in df.select(logs.charset(F.col("b"), F.col("h"))).collect()] == ["utf-8", "utf-16", "koi8-r", "windows-1252", "euc-jp", "utf-8"]
