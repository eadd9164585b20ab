"""Findings kept across runs: merge, automatic resolution, regressions, decisions and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, RESOLVED, WONTFIX = "open", "resolved", "wontfix"
REAPPEARED, ABSENT = "Regression: finding reappeared after being resolved.", "Auto-resolved: absent from a rescan of its module."
#: What a run may say anew about a finding that is known; empty values leave what was said.
REFRESHED = ("priority", "description", "fix", "effort")
NOTES = "array<struct<at:string,text:string>>"
STATE = f"id string, module string, title string, priority string, description string, fix string, effort string, status string, first_seen string, last_seen string, resolved_at string, notes {NOTES}"


def completed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with these columns, empty where they were missing."""
    missing = [c for c in columns if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast(NOTES if c == "notes" else "string") for c in missing}) if missing else rows


def first_by_id(findings: DataFrame, order: str) -> DataFrame:
    """Of findings with one id the first."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return findings.withColumn("_place", place).filter("_place = 1").drop("_place")


def _with_note(notes: Column, at: Column | str, text: str) -> Column:
    note = F.struct((F.lit(at) if isinstance(at, str) else at).alias("at"), F.lit(text).alias("text"))
    return F.concat(F.coalesce(notes, F.expr(f"cast(array() as {NOTES})")), F.array(note))


def merge(state: DataFrame, current: DataFrame, scanned: DataFrame, now: str) -> DataFrame:
    """The state after a run.

    state: columns of ``STATE``, of which description, fix, effort and notes may be
    missing; current: id, module, title, priority and, if it has them, description,
    fix, effort; scanned: module of everything this run looked at.  What a finding
    says anew replaces what it said, unless it is empty; notes are a list to which
    regressions and automatic resolutions add.  The last column, event, says what
    became of a finding: new, still_open, reopened, resolved, skipped, kept.
    """
    s = completed(state, *REFRESHED, "notes").alias("s")
    c = completed(current, *REFRESHED).withColumn("here", F.lit(True)).alias("c")
    looked = F.broadcast(scanned.select(F.col("module").alias("looked_at")).distinct())
    both = s.join(c, "id", "full_outer").join(looked, F.coalesce(F.col("s.module"), F.lit("core")) == F.col("looked_at"), "left")
    known, seen, status = F.col("s.status").isNotNull(), F.col("here").isNotNull(), F.col("s.status")
    gone = known & ~seen & (status == OPEN)
    event = (F.when(~known, "new").when(seen & (status == RESOLVED), "reopened").when(seen & (status == OPEN), "still_open")
        .when(gone & F.col("looked_at").isNotNull(), "resolved").when(gone, "skipped").otherwise("kept"))
    both = both.withColumn("event", event)
    notes = F.col("s.notes")
    told = F.when(F.col("event") == "reopened", _with_note(notes, now, REAPPEARED)).when(F.col("event") == "resolved", _with_note(notes, now, ABSENT))
    anew = [F.coalesce(F.when(F.col(f"c.{x}") != "", F.col(f"c.{x}")), F.col(f"s.{x}")).alias(x) for x in REFRESHED]
    return both.select(
        "id", F.coalesce("s.module", "c.module").alias("module"), F.coalesce("s.title", "c.title").alias("title"), *anew,
        F.when(F.col("event").isin("new", "reopened"), OPEN).when(F.col("event") == "resolved", RESOLVED).otherwise(status).alias("status"),
        F.when(F.col("event") == "new", now).otherwise(F.col("s.first_seen")).alias("first_seen"), F.when(seen, now).otherwise(F.col("s.last_seen")).alias("last_seen"),
        F.when(F.col("event") == "resolved", now).when(F.col("event") == "reopened", None).otherwise(F.col("s.resolved_at")).alias("resolved_at"),
        told.otherwise(F.coalesce(notes, F.expr(f"cast(array() as {NOTES})"))).alias("notes"), "event",
    )


def _of_prefix(state: DataFrame, id_prefix: str) -> DataFrame:
    """state with _hit: whether a finding is the one meant: of those whose id begins so the least."""
    found = state.filter(F.startswith("id", F.lit(id_prefix))).agg(F.min("id").alias("_id"))
    return completed(state, "notes").crossJoin(F.broadcast(found)).withColumn("_hit", F.coalesce(F.col("id") == F.col("_id"), F.lit(False))).drop("_id")  # found is one row


def set_status(state: DataFrame, id_prefix: str, status: str, now: str, note: str = "") -> DataFrame:
    """Decides on the first finding whose id begins so: resolved or wontfix, at this time, with a note why."""
    rows = _of_prefix(state, id_prefix)
    hit = F.col("_hit")
    rows = rows.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at"))})
    return (rows.withColumn("notes", F.when(hit, _with_note(F.col("notes"), now, note)).otherwise(F.col("notes"))) if note else rows).drop("_hit")


def add_note(state: DataFrame, id_prefix: str, text: str, now: str) -> DataFrame:
    """Attaches a note to the first finding whose id begins so."""
    rows = _of_prefix(state, id_prefix)
    return rows.withColumn("notes", F.when(F.col("_hit"), _with_note(F.col("notes"), now, text)).otherwise(F.col("notes"))).drop("_hit")
