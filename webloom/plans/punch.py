"""Three audits of the pages kept as a punch list: by the stream's keyed state, with SQL that merges run by run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import state
from ..sources.driver_views import view
from ..sources.steps import shared_folder
from ..streaming import findings as stream

#: What a page should or shouldn't hold: module, title, priority, pattern, whether it is wanted.
RULES = (
    ("seo", "No description: ", "P1", 'name="description"', True),
    ("seo", "No canonical: ", "P2", 'rel="canonical"', True),
    ("pwa", "No manifest: ", "P3", 'rel="manifest"', True),
    ("links", "Opens unsafely: ", "P1", 'target="_blank"', False),
    ("privacy", "Tracks: ", "P0", "gtag", False),
)
#: Each run's pages, its time and what it looked at.
RUNS = (("pages", "2024-01-01", ("seo", "pwa", "links", "privacy")), ("rich_pages", "2024-02-01", ("seo", "links", "privacy")), ("served_pages", "2024-03-01", ("seo", "pwa", "privacy")))
_LENGTH = "CASE WHEN page_id % 2 = 0 THEN '' ELSE 'of ' || CAST(length(html) AS VARCHAR(20)) || ' characters' END"


def page_findings(spark, sf_dir, pages: str):
    """The findings of a run over a view of pages; the description tells the page's length where it is odd."""
    rows = view(spark, sf_dir, pages).select("page_id", "url", "html")
    hit = lambda p, wanted: F.contains("html", F.lit(p)) != F.lit(wanted)
    found = F.array_compact(F.array(*[F.when(hit(p, wanted), F.struct(F.lit(m).alias("module"), F.concat(F.lit(t), F.col("url")).alias("title"), F.lit(x).alias("priority"))) for m, t, x, p, wanted in RULES]))
    rows = rows.select(F.explode(found).alias("f"), F.expr(_LENGTH.replace("VARCHAR(20)", "STRING")).alias("description"), F.col("page_id").alias("ordinal")).select("f.*", "description", "ordinal")
    return rows.withColumn("id", text.finding_id(F.col("module"), F.col("title")))


def _found(pages: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS module, '{t}' || url AS title, '{x}' AS priority, {_LENGTH} AS description FROM {pages} WHERE {'NOT ' if wanted else ''}contains(html, '{p}')" for m, t, x, p, wanted in RULES)
    return f"SELECT substr(sha1(module || '|' || trim(title)), 1, 10) AS id, module, title, priority, description FROM ({each})"


def _merged(before: str, run: str, at: str, scanned: tuple[str, ...]) -> str:
    looked = f"s.module IN ({', '.join(map(repr, scanned))})"
    note = lambda t: f"list_append(s.notes, '{at} ' || '{t}')"
    gone, back = f"c.id IS NULL AND s.status = 'open' AND {looked}", "c.id IS NOT NULL AND s.status = 'resolved'"
    return f"""SELECT coalesce(s.id, c.id) AS id, coalesce(s.module, c.module) AS module, coalesce(s.title, c.title) AS title, coalesce(c.priority, s.priority) AS priority, coalesce(nullif(c.description, ''), s.description) AS description,
CASE WHEN s.id IS NULL OR {back} THEN 'open' WHEN {gone} THEN 'resolved' ELSE s.status END AS status, coalesce(s.first_seen, '{at}') AS first_seen, CASE WHEN c.id IS NOT NULL THEN '{at}' ELSE s.last_seen END AS last_seen,
CASE WHEN {gone} THEN '{at}' WHEN {back} THEN NULL ELSE s.resolved_at END AS resolved_at, CASE WHEN s.id IS NULL THEN CAST([] AS VARCHAR[]) WHEN {gone} THEN {note(state.ABSENT)} WHEN {back} THEN {note(state.REAPPEARED)} ELSE s.notes END AS notes
FROM {before} s FULL JOIN {run} c ON c.id = s.id"""


_EMPTY = "SELECT CAST(NULL AS VARCHAR) AS id, '' AS module, '' AS title, '' AS priority, '' AS description, '' AS status, '' AS first_seen, '' AS last_seen, '' AS resolved_at, CAST([] AS VARCHAR[]) AS notes WHERE FALSE"
_STEPS = ", ".join(f"f{k} AS ({_found(pages)}), s{k + 1} AS ({_merged(f's{k}', f'f{k}', at, scanned)})" for k, (pages, at, scanned) in enumerate(RUNS))
_LIST = f"WITH s0 AS ({_EMPTY}), {_STEPS} SELECT id, module, title, priority, description, status, first_seen, last_seen, resolved_at, array_to_string(notes, '|') AS notes FROM s{len(RUNS)}"


def _streamed(spark, sf_dir) -> str:
    """The folder of a stream that took the three runs, one file set each."""
    folder = f"{shared_folder(spark)}/punch-{uuid.uuid4().hex}"
    for k, (pages, at, scanned) in enumerate(RUNS):
        stream.events(page_findings(spark, sf_dir, pages), scanned, k, at).write.mode("append").parquet(f"{folder}/events")
    running = stream.merge_stream(spark.readStream.schema(stream.EVENTS).parquet(f"{folder}/events"), folder)
    running.awaitTermination()
    return folder


@query("punch_stream", _LIST, ("pages", "rich_pages", "served_pages"))
def punch_stream(spark, sf_dir):
    """The list that the stream's state holds after the runs."""
    rows = stream.stored_state(spark, _streamed(spark, sf_dir))
    notes = F.array_join(F.transform("notes", lambda n: F.concat(n["at"], F.lit(" "), n["text"])), "|")
    return rows.select("id", "module", "title", "priority", "description", "status", "first_seen", "last_seen", "resolved_at", notes.alias("notes"))


_EVENTS = f"""WITH s0 AS ({_EMPTY}), {_STEPS} SELECT run, event, count(*) AS findings FROM ({' UNION ALL '.join(f"SELECT {k} AS run, CASE WHEN s.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'resolved' WHEN s.status = 'resolved' THEN 'reopened' ELSE 'still_open' END AS event FROM s{k} s FULL JOIN f{k} c ON c.id = s.id WHERE c.id IS NOT NULL OR (s.status = 'open' AND s.module IN ({', '.join(map(repr, scanned))}))" for k, (_, _, scanned) in enumerate(RUNS))}) GROUP BY run, event"""


@query("punch_stream_events", _EVENTS, ("pages", "rich_pages", "served_pages"))
def punch_stream_events(spark, sf_dir):
    """How many findings each run brought, kept, brought back or settled, from the stream's changes."""
    changes = spark.read.schema(stream.CHANGE).parquet(f"{_streamed(spark, sf_dir)}/changes")
    return changes.groupBy(F.col("run").cast("int").alias("run"), "event").agg(F.count("*").alias("findings"))
