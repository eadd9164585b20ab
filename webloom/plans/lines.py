"""Text tables of the punch list, the portfolio and the history, with SQL that prints the same lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import texts
from .crawl import MERGED, merged
from .scoring import _GRADE, RUNS, SCORED, scored

_TITLED = f"SELECT m.*, u.url AS title, CASE WHEN m.event IN ('reopened', 'resolved') THEN 1 ELSE 0 END AS notes, CASE m.priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 WHEN 'P3' THEN 4 ELSE 5 END AS place FROM ({MERGED}) m JOIN (SELECT substr(sha1('m' || (page_id % 5) || '|' || url), 1, 10) AS k, url FROM pages) u ON u.k = m.id"


@query(
    "punch_text_lines",
    f"""WITH t AS ({_TITLED}), n AS (SELECT count(*) FILTER (WHERE status = 'open') AS o, count(*) FILTER (WHERE status = 'resolved') AS r, count(*) FILTER (WHERE status = 'wontfix') AS w FROM t)
SELECT CAST(0 AS INT) AS section, '' AS first_seen, '' AS id, 'Punch list (updated 2024-02-01)' AS text UNION ALL SELECT 1, '', '', 'No open items.' FROM n WHERE o = 0 UNION ALL SELECT 99, '', '', o || ' open · ' || r || ' resolved · ' || w || ' wontfix' FROM n
UNION ALL SELECT CAST(2 * place AS INT), '', '', min(priority) || ' — ' || count(*) || ' open' FROM t WHERE status = 'open' AND place < 5 GROUP BY place
UNION ALL SELECT CAST(2 * place + 1 AS INT), first_seen, id, '  ' || id || '  ' || title || ' (' || module || ')' || CASE WHEN place < 5 AND notes = 1 THEN ' (1 note)' ELSE '' END FROM t WHERE status = 'open'""",
)
def punch_text_lines(spark, sf_dir):
    return texts.punch_text(merged(spark, sf_dir).drop("event"), updated="2024-02-01")


@query("history_text_lines", f"""WITH r AS (SELECT *, {_GRADE} AS grade, row_number() OVER (PARTITION BY site ORDER BY day) AS k FROM ({SCORED})), n AS (SELECT site, count(*) AS n FROM r GROUP BY site)
SELECT site, CAST(k + 3 AS INT) AS line, printf('%-22s %5s %7s %5s %5s %5s %5s %6s', CAST(day AS VARCHAR) || ' 00:00', grade, CAST(overall AS VARCHAR), CAST(seo AS VARCHAR), CAST(security AS VARCHAR), CAST(accessibility AS VARCHAR), coalesce(CAST(perf AS VARCHAR), '0'), CAST(p0 + p1 AS VARCHAR)) AS text FROM r
UNION ALL SELECT site, 0, 'Audit history: ' || site FROM n UNION ALL SELECT site, 1, repeat('=', 80) FROM n UNION ALL SELECT site, 2, printf('%-22s %5s %7s %5s %5s %5s %5s %6s', 'Date', 'Grade', 'Overall', 'SEO', 'Sec', 'A11y', 'Perf', 'Issues') FROM n
UNION ALL SELECT site, 3, repeat('-', 80) FROM n UNION ALL SELECT site, CAST(n + 4 AS INT), repeat('=', 80) FROM n UNION ALL SELECT site, CAST(n + 5 AS INT), 'Total audits: ' || n FROM n""", RUNS)
def history_text_lines(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("performance", F.col("perf")).withColumn("issues_found", F.col("p0") + F.col("p1"))
    return texts.history_text(rows)


_NAMED = f"SELECT site || ' ' || CAST(day AS VARCHAR) AS name, seo, security, accessibility, perf, overall, {_GRADE} AS grade FROM ({SCORED})"


@query("portfolio_text_lines", f"""WITH r AS ({_NAMED}), w AS (SELECT greatest(4, max(length(name))) AS w FROM r)
SELECT CAST(2 AS INT) AS line, name, rpad(name, CAST(w AS INT), ' ') || printf(' | %-5s | %-10s | %-6s | %-6s | %-9s | %-7s', CAST(seo AS VARCHAR), CAST(security AS VARCHAR), CAST(accessibility AS VARCHAR), coalesce(CAST(perf AS VARCHAR), '-'), CAST(overall AS VARCHAR), grade) AS text FROM r, w
UNION ALL SELECT 0, '', rpad('Name', CAST(w AS INT), ' ') || printf(' | %-5s | %-10s | %-6s | %-6s | %-9s | %-7s', 'SEO', 'Security', 'A11y', 'Perf', 'Overall', 'Grade') FROM w
UNION ALL SELECT 1, '', repeat('-', w) || '-+-' || repeat('-', 5) || '-+-' || repeat('-', 10) || '-+-' || repeat('-', 6) || '-+-' || repeat('-', 6) || '-+-' || repeat('-', 9) || '-+-' || repeat('-', 7) FROM w""", RUNS)
def portfolio_text_lines(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.concat("site", F.lit(" "), F.col("day").cast("string")).alias("name"), "seo", "security", "accessibility", F.col("perf").alias("performance"), "overall", "grade")
    return texts.portfolio_text(rows)
