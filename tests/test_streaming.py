"""Runs that arrive as events are kept as keyed state, read back by the state data source, and equal the batch merge."""

import random

from webloom.operators import state
from webloom.streaming import findings as stream

FINDING = "id string, module string, title string, priority string, description string, fix string, effort string"


def arrive(spark, tmp_path, runs, apart=True):
    """Runs (findings, scanned) as files, taken one batch each or all in one."""
    for k, (rows, scanned) in enumerate(runs):
        stream.events(spark.createDataFrame(rows, FINDING), scanned, k, f"t{k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if apart or k == len(runs) - 1:
            query = stream.merge_stream(spark.readStream.schema(stream.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "punch"))
            query.awaitTermination()
            assert query.exception() is None
    return sorted(map(tuple, stream.stored_state(spark, str(tmp_path / "punch")).collect()))


def in_batch(spark, runs):
    now = spark.createDataFrame([], state.STATE)
    for k, (rows, scanned) in enumerate(runs):
        looked = spark.createDataFrame([(m,) for m in scanned], "module string")
        now = state.merge(now, state.first_by_id(spark.createDataFrame(rows, FINDING), "title"), looked, f"t{k}").drop("event")
        now = spark.createDataFrame(now.collect(), state.STATE)
    return sorted(map(tuple, now.collect()))


RUNS = [
    ([("a", "seo", "A", "P1", "first", "do", "S"), ("b", "links", "B", "P2", "", "", ""), ("c", "pwa", "C", "P3", None, None, None)], ["seo", "links", "pwa"]),
    ([("b", "links", "B", "P0", "more", "", "M"), ("b", "links", "B again", "P3", "", "", "")], ["seo", "links"]),
    ([("a", "seo", "A", "", "later", "", "")], ["seo"]),
]


def test_runs_give_the_batch_merge(spark, tmp_path):
    got = arrive(spark, tmp_path, RUNS)
    assert got == in_batch(spark, RUNS)
    items = {r[0]: r for r in got}
    assert items["a"][3:8] == ("P1", "later", "do", "S", "open") and [n["text"] for n in items["a"][11]] == [state.ABSENT, state.REAPPEARED] and [n["at"] for n in items["a"][11]] == ["t1", "t2"]
    assert items["b"][3:9] == ("P0", "more", None, "M", "open", "t0") and items["c"][7] == "open"
    told = {(r["run"], r["id"]): r["event"] for r in spark.read.parquet(str(tmp_path / "punch" / "changes")).collect()}
    assert told == {(0, "a"): "new", (0, "b"): "new", (0, "c"): "new", (1, "a"): "resolved", (1, "b"): "still_open", (2, "a"): "reopened"}
    before = {r["id"]: r["status"] for r in stream.stored_state(spark, str(tmp_path / "punch"), 2).collect()}
    assert before == {"a": "resolved", "b": "open", "c": "open"}


def test_runs_of_one_batch_are_taken_in_order(spark, tmp_path):
    draw = random.Random(3)
    runs = []
    for _ in range(6):
        rows = [(f"{m}{i}", m, f"T{i}", draw.choice(["P0", "P1", ""]), draw.choice(["", "x", "y"]), "", "") for m in ("seo", "pwa") for i in range(12) if draw.random() < 0.6]
        runs.append((rows, draw.sample(["seo", "pwa", "links"], 2)))
    assert arrive(spark, tmp_path, runs, apart=False) == in_batch(spark, runs)


def test_state_grows_by_keys_not_by_batches(spark, tmp_path):
    runs = [RUNS[0]] * 5
    arrive(spark, tmp_path, runs)
    rows = spark.read.format("statestore").option("stateVarName", "items").load(str(tmp_path / "punch" / "checkpoint"))
    assert rows.count() == 3


def test_of_findings_of_one_id_the_first_counts(spark, tmp_path):
    rows = [("a", "seo", "A", "P1", "later", 9), ("a", "seo", "A", "P2", "first", 3), ("b", "seo", "B", "P3", "", None), ("b", "seo", "B", "P2", "", None)]
    stream.events(spark.createDataFrame(rows, "id string, module string, title string, priority string, description string, ordinal long"), ["seo"], 0, "t0").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.merge_stream(spark.readStream.schema(stream.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "punch")).awaitTermination()
    assert {r["id"]: (r["priority"], r["description"]) for r in stream.stored_state(spark, str(tmp_path / "punch")).collect()} == {"a": ("P2", "first"), "b": ("P2", None)}
