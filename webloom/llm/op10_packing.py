"""Best-fit packing planned on the histogram of piece lengths.

Only the number of pieces of each length (at most CAPACITY numbers) reaches the
driver.  Best-fit decreasing runs over those counts: equal sequences are kept as
one group with a count, so a step moves a whole group.  The plan is a list of
runs "pieces of this length with ranks r..r+c-1 take offset o of sequences
q..q+c-1"; its size is bounded by the number of lengths, not of documents.
Pieces get a rank within their length by a salted count and take their slots by
a join on it; a length's pieces are dealt over salts, a few at first and one for
every SALT_ROWS of them beyond that, so no sort grows with the table.  A full piece is a sequence of its own and needs no rank.

Edge cases: null or empty text is the end id alone; a document longer than the
capacity is cut so that its first piece takes the remainder and all others are
full; ties and repeated rows each get a place of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import id_text, stored, table
from .tokens import ids_bytes, library_encoder

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 2048
#: Pieces of one length that are ranked together, about; a small length has a salt for fewer, but not more than FEW_SALTS.
SALT_ROWS, LEAST_SALT_ROWS, FEW_SALTS = 50_000, 400, 64


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = library_encoder(vocabulary), ids_bytes([end_id])
        for batch in batches:
            rows = []
            for doc, row, ids in zip(batch["doc_id"].tolist(), batch["row"].tolist(), encoder.encode_many(batch["text"].tolist())):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                ends = range(first, n + 1, capacity)
                start = 0
                for k, stop in enumerate(ends):
                    rows.append((doc, row, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            yield pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit decreasing over counts.

    A group is a run of equal sequences (first sequence, count) with the same room
    left.  Pieces of one length fill the tightest groups that have room, as many a
    sequence as fit, and open new sequences for the rest.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, count)]
    rooms: list[int] = []  # sorted keys of groups
    opened = 0

    def add(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups or not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                per = min(capacity // length, left)
                count = max(1, left // per)
                first, room = opened, capacity
                opened += count
            else:
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    del rooms[k]
                per = min(room // length, left)
                use = min(count, max(1, left // per))
                add(room, first + use, count - use)
                count = use
            for j in range(per):
                runs.append((length, rank, count, first, capacity - room + j * length))
                rank, left = rank + count, left - count
            add(room - per * length, first, count)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """pieces (with length, and row and piece as a key) with sequence_id and offset."""
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") >= capacity)
    pieces = pieces.filter(F.col("length") < capacity)
    lengths = pieces.groupBy("length").count().collect()  # at most capacity numbers
    dealt = lambda n: max(-(-n // salt_rows), min(FEW_SALTS, -(-n // LEAST_SALT_ROWS)))
    salts = spark.createDataFrame([(r["length"], dealt(r["count"])) for r in lengths], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.col("salts"))).select(*pieces.columns, "salt")
    counted = salted.groupBy("length", "salt").count().collect()  # a number for each salt_rows pieces, and at most FEW_SALTS for a length
    totals: dict[int, int] = defaultdict(int)
    bases = []
    for r in sorted(counted, key=lambda r: (r["length"], r["salt"])):
        bases.append((r["length"], r["salt"], totals[r["length"]]))
        totals[r["length"]] += r["count"]
    plan = best_fit_plan(dict(totals), capacity)
    opened = max((first + count for _, _, count, first, _ in plan), default=0)
    alone = full.withColumn("sequence_id", F.lit(opened) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    if not bases:
        return alone
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, _, first, offset in plan:
        by_length[length].append((rank, first, offset))
    slots = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in by_length.items()})
    base = {(length, salt): b for length, salt, b in bases}
    base_of = spark.sparkContext.broadcast(base)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length").indices.items():
                part = batch.iloc[rows]
                rank = part["rank"].to_numpy() - 1 + np.array([base_of.value[length, s] for s in part["salt"].tolist()])
                runs = slots.value[length]
                at = np.searchsorted(runs[:, 0], rank, side="right") - 1
                seq[rows] = runs[at, 1] + rank - runs[at, 0]
                off[rows] = runs[at, 2]
            yield batch.drop(columns=["rank", "salt"]).assign(sequence_id=seq, offset=off)

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")).cast("long"))
    kept = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long").unionByName(alone)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
