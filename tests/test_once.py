"""What is costly is worked out once a row: repeated expressions and steps show in the optimized plan."""

import numpy as np
import pandas as pd

from webloom import catalog
from webloom.functions import batches, pictures

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", 1 << 24)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_read_once_a_host(spark):
    assert plan(catalog.queries()["host_blocked"](spark, SF)).count("%[^%/]+$") == 1


def test_a_recommendation_is_written_once_a_page(spark):
    text = plan(catalog.queries()["schema_recommendations"](spark, SF))
    assert text.count("REPLACE_section_url") == 1 and "Join" not in text


def test_rows_of_many_pictures_are_inverted_together(monkeypatch):
    rng, calls, inverted = np.random.default_rng(5), [], pictures._inverted
    monkeypatch.setattr(pictures, "_inverted", lambda kinds, *more: (calls.append(len(kinds)), inverted(kinds, *more))[1])
    shown = [rng.integers(0, 256, (height, 5, 3)).astype(np.uint8) for height in (7, 1, 40, 0, 30)]
    pngs = [pictures.encode_png(p, (4, 3, 1, 4, 2, 0)) for p in shown]
    got = pictures.decode_pngs([pngs[0], None, *pngs[1:], pngs[0][:-9]])
    assert got[1] is None and got[-1] is None
    assert all((a == b).all() and a.shape == b.shape for a, b in zip([got[0], *got[2:-1]], shown, strict=True))
    assert calls == [78]


def test_a_scored_document_runs_each_module_once(spark):
    assert plan(catalog.queries()["scanned_modules"](spark, SF)).count("MapInArrow") == 1


def test_workers_hold_a_piece_of_a_batch():
    rows = pd.DataFrame({"page_id": range(600)})
    got = list(batches.pieces(iter([rows, rows[:1], rows[:0]])))
    assert [len(p) for p in got] == [256, 256, 88, 1] and [p.index[0] for p in got] == [0, 0, 0, 0] and got[2]["page_id"].iloc[-1] == 599


def test_pages_are_looked_up_by_their_key_where_they_are_inferred(spark):
    joins = [line for line in plan(catalog.queries()["queries_with_inferred_pages"](spark, SF)).splitlines() if " Join Inner" in line and "url#" in line]
    assert not [line for line in joins if "page_id#" not in line]  # a filter on the page as a join's condition would pair every part with every page
