"""A crawl store in SQLite reads in parallel, with filters pushed down, and gives the checks that parquet gives."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from webloom.operators import checks
from webloom.sources import sqlite
from webloom.sources.driver_views import view

DIR = os.environ.get("WEBLOOM_TEST_DIR", "/root/testdata/sf0.001")
SQL_TYPES = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "crawl 1.db")
    con = sqlite3.connect(path)
    frames = {n: view(spark, DIR, f"crawl_{n}") for n in ("pages", "links")}
    for name, df in frames.items():
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {SQL_TYPES[t]}' for c, t in df.dtypes)})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()])
    con.execute("CREATE TABLE odd (n INTEGER, t TEXT, r REAL, b BLOB, \"a b\" NUMERIC)")
    con.executemany("INSERT INTO odd VALUES (?, ?, ?, ?, ?)", [(1, "x", 1.5, b"\x00", 2), ("no", 5, "2.5", "y", None), (None, None, None, None, 7.5), (3, b"z", 1, b"", "q")])
    con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    con.execute("INSERT INTO keyed VALUES ('a', 1)")
    con.execute("CREATE TABLE bare (k TEXT)")
    con.commit()
    con.close()
    return path, frames


def test_all_checks_over_sqlite_are_those_over_parquet(spark, store):
    path, frames = store
    pages, links = (sqlite.table(spark, path, n, 3) for n in ("pages", "links"))
    assert pages.rdd.getNumPartitions() == 3 and pages.count() == frames["pages"].count()
    # examples are taken in the order of the rows, so both sides get one order
    told = lambda p, k: [tuple(r) for r in checks.findings(p, k).drop("description").orderBy("ordinal").collect()]
    assert told(pages, links) == told(frames["pages"], frames["links"]) != []
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, frames["links"].collect())) and checks.stats(pages, links).collect() == checks.stats(frames["pages"], frames["links"]).collect()


@pytest.mark.parametrize("condition", ["status = 200", "status > 300", "status IN (404, 500)", "error IS NULL", "status <> 200", "url LIKE 'https%'", "status = 200 AND title IS NOT NULL AND length(title) > 3", "status <=> 200", "NOT status IN (200)", "title >= 'M'", "page_id < 10.5"])
def test_filters_mean_what_spark_means(spark, store, condition):
    path, frames = store
    got = sqlite.table(spark, path, "pages", push=True).filter(condition)
    assert sorted(r["url"] for r in got.collect()) == sorted(r["url"] for r in frames["pages"].filter(condition).collect())


def test_a_filter_is_pushed(spark, store):
    read = sqlite.PushedReader(store[0], "pages", sqlite.SqliteSource({"path": store[0], "table": "pages"}).schema(), 2)
    left = list(read.pushFilters([sqlite.EqualTo(("status",), 404), sqlite.EqualTo(("status",), "404"), sqlite.IsNotNull(("nowhere",))]))
    assert len(left) == 2 and read.where == [('"status" = ?', [404])]
    rows = sum(b.num_rows for p in read.partitions() for b in read.read(p))
    assert rows == store[1]["pages"].filter("status = 404").count()


def test_values_of_other_kinds_and_other_tables(spark, store):
    path, _ = store
    got = [tuple(r) for r in sqlite.table(spark, path, "odd", 1).orderBy(F.col("a b").asc_nulls_last()).collect()]
    assert got[0] == (1, "x", 1.5, bytearray(b"\x00"), 2.0) and got[1] == (None, None, None, None, 7.5)
    assert {(r[0], r[1]) for r in got[2:]} == {(None, "5"), (3, "z")}
    assert [tuple(r) for r in sqlite.table(spark, path, "keyed").collect()] == [("a", 1)] and sqlite.table(spark, path, "bare").count() == 0
    with pytest.raises(Exception, match="no table gone"):
        sqlite.table(spark, path, "gone").count()
