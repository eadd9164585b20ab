"""The punch list as keyed state: runs arrive as events, a store of findings is kept, changes go out.

An event is a finding of a run, or that the run looked at a module (a row without an
id).  State is held by module and bucket of finding ids: a run that looked at a module
reaches each bucket of it, and a module of very many findings is dealt over
``BUCKETS`` keys.  A batch reads the findings that it names and those of the modules it
looked at, however many batches there were before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import ABSENT, NOTES, OPEN, REAPPEARED, REFRESHED, RESOLVED, completed

BUCKETS = 64
_TEXTS = ("title", *REFRESHED)
EVENTS = "run long, at string, module string, id string, " + ", ".join(f"{c} string" for c in _TEXTS) + ", ordinal long"
_ITEM = "title string, priority string, description string, fix string, effort string, status string, first_seen string, last_seen string, resolved_at string"
ITEM = f"{_ITEM}, notes {NOTES}"
CHANGE = f"run long, id string, module string, {ITEM}, event string"
_FIELDS = [f.split(" ")[0] for f in _ITEM.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(findings: DataFrame, scanned: Iterable[str], run: int, at: str) -> DataFrame:
    """The events of a run: its findings (id, module, title, priority and more) and the modules it looked at.

    Of findings of one id the first by ``ordinal`` counts, where there is one, else the
    least by its texts.
    """
    spark = findings.sparkSession
    ordinal = F.col("ordinal") if "ordinal" in findings.columns else F.lit(None)
    rows = completed(findings, *_TEXTS).select(F.lit(run).cast("long").alias("run"), F.lit(at).alias("at"), F.coalesce("module", F.lit("core")).alias("module"), "id", *_TEXTS, ordinal.cast("long").alias("ordinal")).filter("id is not null")
    looked = spark.createDataFrame([(run, at, m) for m in sorted(set(scanned))], "run long, at string, module string")
    return rows.unionByName(looked, allowMissingColumns=True)


class _PunchList(StatefulProcessor):
    """The findings of one module's bucket, by id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._items = handle.getMapState("items", "id string", ITEM)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        module = key[0]
        arrived = pd.concat(list(rows)).sort_values(["run", "id", "ordinal", *_TEXTS], na_position="last")
        out: list[tuple] = []
        for run, of_run in arrived.groupby("run", sort=True):
            at = of_run["at"].iloc[0]
            named = of_run[of_run["id"].notna()].drop_duplicates("id")
            for row in named.itertuples(index=False):
                out.append((run, row.id, module, *self._seen(row, at)))
            if of_run["id"].isna().any():
                here = set(named["id"])
                for (name,), value in list(self._items.iterator()):
                    item = dict(zip([*_FIELDS, "notes"], value, strict=True))
                    if item["status"] == OPEN and name not in here:
                        item |= {"status": RESOLVED, "resolved_at": at, "notes": self._noted(item, at, ABSENT)}
                        out.append((run, name, module, *self._kept(name, item), "resolved"))
        if out:
            yield pd.DataFrame(out, columns=["run", "id", "module", *_FIELDS, "notes", "event"])

    def _seen(self, row: Any, at: str) -> tuple:
        said = {c: None if pd.isna(v := getattr(row, c)) or (c in REFRESHED and not v) else v for c in _TEXTS}
        if not self._items.containsKey((row.id,)):
            return *self._kept(row.id, said | {"status": OPEN, "first_seen": at, "last_seen": at, "resolved_at": None, "notes": []}), "new"
        item = dict(zip([*_FIELDS, "notes"], self._items.getValue((row.id,)), strict=True))
        item |= {"last_seen": at} | {c: said[c] for c in REFRESHED if said[c]}
        event = {OPEN: "still_open", RESOLVED: "reopened"}.get(item["status"], "kept")
        if event == "reopened":
            item |= {"status": OPEN, "resolved_at": None, "notes": self._noted(item, at, REAPPEARED)}
        return *self._kept(row.id, item), event

    @staticmethod
    def _noted(item: dict, at: str, text: str) -> list[tuple[str, str]]:
        return [*(tuple(n) for n in item["notes"] or []), (at, text)]

    def _kept(self, name: str, item: dict) -> tuple:
        """Stores the item; its values in the order of ``ITEM``."""
        notes = [tuple(n) for n in item["notes"] or []]
        value = tuple(item[c] for c in _FIELDS)
        self._items.updateValue((name,), (*value, notes))
        return *value, [{"at": a, "text": t} for a, t in notes]

    def close(self) -> None:
        pass


def changes(arriving: DataFrame) -> DataFrame:
    """What a stream of events changes: a row for each finding that a run named or resolved, as ``CHANGE``.

    Runs that arrive in one batch are taken in their order, so the batches make no difference.
    """
    conf = arriving.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    everywhere, own = F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.array(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    dealt = arriving.withColumn("bucket", F.explode(F.when(F.col("id").isNull(), everywhere).otherwise(own)))
    return dealt.groupBy("module", "bucket").transformWithStateInPandas(_PunchList(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def merge_stream(arriving: DataFrame, folder: str) -> StreamingQuery:
    """Starts a query over the events there are, which keeps its state in folder/checkpoint and appends changes to folder/changes."""
    return changes(arriving).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def stored_state(spark: SparkSession, folder: str, before_batch: int | None = None) -> DataFrame:
    """The punch list that the state store holds, in the columns of ``operators.state.STATE``; before_batch gives an earlier one."""
    reader = spark.read.format("statestore").option("stateVarName", "items")
    if before_batch is not None:
        reader = reader.option("batchId", before_batch - 1)
    rows = reader.load(f"{folder}/checkpoint")
    return rows.select(F.col("user_map_key.id").alias("id"), F.col("key.module").alias("module"), *[F.col(f"user_map_value.{c}").alias(c) for c in (*_FIELDS, "notes")])
