"""Tables that grow by versions: snapshots of what they were read from, appends, upserts of touched buckets only."""

import os

import pytest
from pyspark.sql import functions as F

from webloom import catalog
from webloom.operators import compare, state
from webloom.sources import sinks, steps, stores


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_state_is_saved_over_the_one_it_was_read_from(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert sinks.loaded(spark, folder, state.STATE).count() == 0
    looked = spark.createDataFrame([("seo",)], "module string")
    for k, ids in enumerate((["a", "b"], ["b", "c"], [])):
        current = spark.createDataFrame([(i, "seo", i.upper(), "P1") for i in ids], "id string, module string, title string, priority string")
        assert sinks.saved(state.merge(sinks.loaded(spark, folder, state.STATE), current, looked, f"t{k}").drop("event"), folder) == k + 1
    found = lambda v: {r["id"]: r["status"] for r in sinks.loaded(spark, folder, "", v).collect()}
    assert found(1) == {"a": "open", "b": "open"} and found(2) == {"a": "resolved", "b": "open", "c": "open"} and set(found(None).values()) == {"resolved"}
    changes = {r["id"]: (r["change"], set(r["columns"])) for r in stores.compared(spark, folder, ["id"], 1, 2).collect()}
    assert changes == {"a": ("changed", {"status", "resolved_at", "notes"}), "b": ("changed", {"last_seen"}), "c": ("added", set())}
    assert {r["change"] for r in stores.compared(spark, folder, ["id"], 2, 1).collect()} == {"changed", "removed"}
    with pytest.raises(ValueError, match="no version 9"):
        stores.read(spark, folder, 9)
    assert stores.vacuum(spark, folder, 1) == ["data/v=1", "data/v=2"] and stores.versions(spark, folder) == [3] and stores.read(spark, folder).count() == 3


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(200).alias("status"))
    assert stores.upsert(rows, folder, ["url"]) == 1
    before = files(folder)
    some = spark.createDataFrame([("u3", 404, "x"), ("u3", 500, "y"), ("new", 200, "z")], "url string, status int, note string")
    assert stores.upsert(some, folder, ["url"], F.desc("status")) == 2
    written = {f for f in files(folder) - before if "/data/" in f}
    assert 1 <= len(written) <= 2 and before <= files(folder)
    got = {r["url"]: (r["status"], r["note"]) for r in stores.read(spark, folder).collect()}
    assert len(got) == 1001 and got["u3"] == (500, "y") and got["new"] == (200, "z") and got["u4"] == (200, None)
    assert stores.read(spark, folder, 1).count() == 1000
    carried = {p for p in stores.parts(spark, folder) if p.startswith("data/v=1/")}
    assert len(carried) == len(stores.parts(spark, folder, 1)) - len({p for p in stores.parts(spark, folder) if p.startswith("data/v=2/")} & {p.replace("v=1", "v=2") for p in stores.parts(spark, folder, 1)})
    stores.vacuum(spark, folder, 1)
    assert stores.read(spark, folder).count() == 1001


def test_a_version_without_manifest_does_not_exist(spark, tmp_path):
    folder = str(tmp_path / "t")
    stores.append(spark.range(2), folder)
    spark.range(5).write.parquet(f"{folder}/data/v=2")  # a writer that failed
    assert stores.read(spark, folder).count() == 2
    stores.append(spark.range(3), folder)
    assert stores.read(spark, folder).count() == 5 and stores.versions(spark, folder) == [1, 2]
    with pytest.raises(ValueError, match="upserts"):
        stores.upsert(spark.range(1), folder, ["id"])


def test_steps_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(steps, "shared_folder", lambda spark: f"file://{tmp_path}/run")
    assert steps.written(spark.range(3), "some").count() == 3 and files(tmp_path)
    steps.clear(spark)
    assert not files(tmp_path)


def test_baselines_rotate(spark, tmp_path):
    shots = lambda *rows: spark.createDataFrame(rows, "name string, pixels array<int>")
    got = [{r["name"]: r["difference"] for r in compare.rotated(s, str(tmp_path / "base")).collect()} for s in (shots(("a", [1, 2])), shots(("a", [1, 3]), ("b", [1])), shots(("a", [1, 3])))]
    assert got == [{"a": -1.0}, {"a": 50.0, "b": -1.0}, {"a": 0.0}]


def test_of_pages_of_one_address_the_last_stays(spark, tmp_path):
    rows = [(k, f"https://a.example/en/{k % 3}", f"<title>T{k}</title>") for k in range(9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()["crawl_store_grown"](spark, str(tmp_path)).collect()
    assert sorted((r["url"][-1], r["title"]) for r in got) == [("0", "T6"), ("1", "T7"), ("2", "T8")]
