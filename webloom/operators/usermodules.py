"""Page modules that a user writes in Python: registered like the built-in ones, run in Arrow batches, each page by itself.

A module is a function of html and url that says its points by criterion and its
findings, and may add details of any shape, which come out as a VARIANT.  Where it
fails on a page, the page gets the module's error and everything else goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UserModule:
    id: str
    #: html, url -> {"points": {criterion: whole number}, "findings": [(priority, title)], "details": anything that is JSON}; parts may be missing.
    run: Callable[[str, str], dict]
    #: html -> whether the module has to do with the page
    detect: Callable[[str], bool] = lambda html: True


USER_MODULES: dict[str, UserModule] = {}
_RESULT = "module string, detected boolean, total int, points map<string,int>, findings array<struct<priority:string,title:string>>, details string, error string"
_FINDINGS = pa.list_(pa.struct([("priority", pa.string()), ("title", pa.string())]))


def register(module: UserModule) -> UserModule:
    USER_MODULES[module.id] = module
    return module


def _result(module: UserModule, html: str, url: str) -> tuple:
    try:
        if not module.detect(html):
            return False, 0, {}, [], None, None
        found = module.run(html, url)
        points = {str(k): int(v) for k, v in found.get("points", {}).items()}
        findings = [{"priority": str(p), "title": str(t)} for p, t in found.get("findings", ())]
        details = json.dumps(found["details"], allow_nan=False) if "details" in found else None
    except Exception as failed:  # a user's code may raise anything; it stays that page's
        return True, None, {}, [], None, f"{type(failed).__name__}: {failed}"
    return True, sum(points.values()), points, findings, details, None


def evaluate(pages: DataFrame, ids: list[str], key: str = "page_id") -> DataFrame:
    """key, module, detected, total, points, findings, details (VARIANT), error of each page and user module."""
    chosen = [USER_MODULES[i] for i in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, urls = ([v or "" for v in batch.column(c).to_pylist()] for c in ("html", "url"))
            for module in chosen:
                rows = [_result(module, h, u) for h, u in zip(htmls, urls, strict=True)]
                detected, total, points, findings, details, error = zip(*rows, strict=True) if rows else ((),) * 6
                arrays = [
                    batch.column(key), pa.array([module.id] * len(rows), pa.string()), pa.array(detected, pa.bool_()), pa.array(total, pa.int32()), pa.array([list(p.items()) for p in points], pa.map_(pa.string(), pa.int32())),
                    pa.array(findings, _FINDINGS), pa.array(details, pa.string()), pa.array(error, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [key, *(f.split(" ")[0] for f in _RESULT.split(", "))])

    rows = pages.select(key, "html", "url").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {_RESULT}")
    return rows.withColumn("details", F.parse_json("details"))
