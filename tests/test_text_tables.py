"""Text tables line by line."""

from webloom.operators import state
from webloom.sources import texts


def lines(df, *order):
    return [r["text"] for r in df.orderBy(*order).collect()]


def test_punch_list(spark):
    rows = [("a1", "seo", "Title", "P1", None, None, "S", "open", "t0", "t0", None, [("t0", "x")]), ("b2", "pwa", "Icon", "P0", None, None, "", "open", "t1", "t1", None, []), ("c3", "pwa", "Old", "P2", None, None, None, "resolved", "t0", "t0", "t1", None), ("d4", "x", "Odd", "P7", None, None, "L", "open", "t0", "t0", None, None), ("a0", "seo", "Later", "P1", None, None, None, "open", "t1", "t1", None, [("t", "y"), ("t", "z")])]
    got = lines(texts.punch_text(spark.createDataFrame(rows, state.STATE), "http://a.example/", "t2"), "section", "first_seen", "id")
    assert got == ["Punch list — http://a.example/ (updated t2)", "P0 — 1 open", "  b2  Icon (pwa)", "P1 — 2 open", "  a1  Title (seo) [S] (1 note)", "  a0  Later (seo) (2 notes)", "  d4  Odd (x)", "4 open · 1 resolved · 0 wontfix"]
    assert lines(texts.punch_text(spark.createDataFrame([], state.STATE)), "section") == ["Punch list", "No open items.", "0 open · 0 resolved · 0 wontfix"]


def test_portfolio(spark):
    rows = [("long site name", 50, 60, 70, None, 61, "B"), ("x", None, None, None, None, None, None)]
    got = lines(texts.portfolio_text(spark.createDataFrame(rows, "name string, seo int, security int, accessibility int, performance int, overall int, grade string")), "line", "name")
    widths = (14, 5, 10, 6, 6, 9, 7)
    row = lambda *cells: " | ".join(str(c).ljust(w) for c, w in zip(cells, widths))
    assert got == [row("Name", "SEO", "Security", "A11y", "Perf", "Overall", "Grade"), "-+-".join("-" * w for w in widths), row("long site name", 50, 60, 70, "-", 61, "B"), row("x", "-", "-", "-", "-", "-", "ERR")]


def test_history(spark):
    rows = [("s", "2024-02-01T10:05:00Z", "B", 61, 50, 60, 70, 80, 12), ("s", "2024-01-01", None, None, 1, 2, 3, 4, 1234567)]
    got = lines(texts.history_text(spark.createDataFrame(rows, "site string, day string, grade string, overall int, seo int, security int, accessibility int, performance int, issues_found int")), "line")
    row = lambda d, *v: f"{d:<22} {v[0]:>5} {v[1]:>7} {v[2]:>5} {v[3]:>5} {v[4]:>5} {v[5]:>5} {v[6]:>6}"
    assert got == ["Audit history: s", "=" * 80, row("Date", "Grade", "Overall", "SEO", "Sec", "A11y", "Perf", "Issues"), "-" * 80, row("2024-01-01 00:00", "?", 0, 1, 2, 3, 4, 1234567), row("2024-02-01 10:05", "B", 61, 50, 60, 70, 80, 12), "=" * 80, "Total audits: 2"]
