"""Text tables of the punch list, the portfolio and the audit history: a row a line, with what orders the lines.

Columns are padded as plain text is; nothing is cut, so a long value widens its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.state import OPEN, RESOLVED, WONTFIX

PRIORITIES = ("P0", "P1", "P2", "P3")


def _right(value: Column | str, width: int) -> Column:
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def _left(value: Column | str, width: Column | int) -> Column:
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), (F.lit(width) if isinstance(width, int) else width) - F.length(text))))


def punch_text(state: DataFrame, url: str = "", updated: str = "") -> DataFrame:
    """section, first_seen, id, text: a heading, the open findings under their priority (unknown ones last), and a closing line; ordered by the first three."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(len(PRIORITIES) + 1)).cast("int")
    rows = state.withColumn("place", place)
    left = rows.filter(F.col("status") == OPEN)
    notes = F.size(F.coalesce("notes", F.array().cast(state.schema["notes"].dataType))) if "notes" in state.columns else F.lit(0)
    effort = F.when(F.coalesce("effort", F.lit("")) != "", F.concat(F.lit(" ["), "effort", F.lit("]"))).otherwise("") if "effort" in state.columns else F.lit("")
    said = F.when(notes > 0, F.concat(F.lit(" ("), notes, F.when(notes == 1, " note)").otherwise(" notes)"))).otherwise("")
    known = F.col("place") <= len(PRIORITIES)
    item = F.concat(F.lit("  "), "id", F.lit("  "), "title", F.lit(" ("), "module", F.lit(")"), F.when(known, F.concat(effort, said)).otherwise(""))
    items = left.select((2 * F.col("place") + 1).alias("section"), "first_seen", "id", item.alias("text"))
    none = F.lit("")
    heads = left.filter(known).groupBy("place").agg(F.count("*").alias("n"), F.min("priority").alias("p")).select((2 * F.col("place")).alias("section"), none.alias("first_seen"), none.alias("id"), F.concat("p", F.lit(" — "), "n", F.lit(" open")).alias("text"))
    counts = state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (OPEN, RESOLVED, WONTFIX)])  # one row
    title = F.lit("Punch list" + (f" — {url}" if url else "") + (f" (updated {updated})" if updated else ""))
    ends = F.array(
        F.struct(F.lit(0).alias("section"), title.alias("text")), F.struct(F.lit(1).alias("section"), F.when(F.col(OPEN) == 0, "No open items.").alias("text")),
        F.struct(F.lit(99).alias("section"), F.concat(F.col(OPEN), F.lit(" open · "), F.col(RESOLVED), F.lit(" resolved · "), F.col(WONTFIX), F.lit(" wontfix")).alias("text")),
    )
    frame = counts.select(F.explode(ends).alias("e")).select("e.section", none.alias("first_seen"), none.alias("id"), "e.text").filter("text is not null")
    return frame.unionByName(heads).unionByName(items)


def portfolio_text(rows: DataFrame, name: str = "name") -> DataFrame:
    """line, name, text: a heading, a rule, and a line a site (name, seo, security, accessibility, performance, overall, grade; null scores as "-", a null grade as "ERR")."""
    columns = (("seo", 5), ("security", 10), ("accessibility", 6), ("performance", 6), ("overall", 9), ("grade", 7))
    widest = rows.agg(F.greatest(F.lit(4), F.coalesce(F.max(F.length(name)), F.lit(4))).alias("_widest"))  # one row
    joined = lambda cells: F.concat_ws(" | ", *cells)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("ERR" if c == "grade" else "-"))
    body = rows.crossJoin(F.broadcast(widest)).select(F.lit(2).alias("line"), F.col(name).alias("name"), joined([_left(name, F.col("_widest")), *[_left(value(c), w) for c, w in columns]]).alias("text"))
    titles = ("SEO", "Security", "A11y", "Perf", "Overall", "Grade")
    head = joined([_left(F.lit("Name"), F.col("_widest")), *[_left(F.lit(t), w) for t, (_, w) in zip(titles, columns, strict=True)]])
    rule = F.concat_ws("-+-", F.repeat(F.lit("-"), F.col("_widest")), *[F.lit("-" * w) for _, w in columns])
    top = widest.select(F.explode(F.array(F.struct(F.lit(0).alias("line"), head.alias("text")), F.struct(F.lit(1).alias("line"), rule.alias("text")))).alias("e")).select("e.line", F.lit("").alias("name"), "e.text")
    return top.unionByName(body)


def history_text(history: DataFrame, key: str = "site", when: str = "day") -> DataFrame:
    """key, line, text of each site's history (key, when, grade, overall, seo, security, accessibility, performance, issues_found): heading, a line an audit, their number."""
    scores = (("grade", 5), ("overall", 7), ("seo", 5), ("security", 5), ("accessibility", 5), ("performance", 5), ("issues_found", 6))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?" if c == "grade" else "0"))
    date = F.coalesce(F.date_format(F.try_to_timestamp(F.col(when).cast("string")), "yyyy-MM-dd HH:mm"), F.substring(F.col(when).cast("string"), 1, 16), F.lit("Unknown"))
    row = F.concat_ws(" ", _left(date, 22), *[_right(value(c), w) for c, w in scores])
    place = F.row_number().over(Window.partitionBy(key).orderBy(when))
    body = history.select(key, (place + 3).alias("line"), row.alias("text"))
    titles = F.concat_ws(" ", _left(F.lit("Date"), 22), *[_right(F.lit(t), w) for t, (_, w) in zip(("Grade", "Overall", "SEO", "Sec", "A11y", "Perf", "Issues"), scores, strict=True)])
    counts = history.groupBy(key).agg(F.count("*").alias("n"))
    ends = [(0, F.concat(F.lit("Audit history: "), F.col(key))), (1, F.lit("=" * 80)), (2, titles), (3, F.lit("-" * 80)), (F.col("n") + 4, F.lit("=" * 80)), (F.col("n") + 5, F.concat(F.lit("Total audits: "), "n"))]
    frame = counts.select(key, F.explode(F.array(*[F.struct((F.lit(k) if isinstance(k, int) else k).cast("int").alias("line"), t.alias("text")) for k, t in ends])).alias("e")).select(key, "e.line", "e.text")
    return frame.unionByName(body)
