"""What the two text classifiers share: held-out rows, a bounded sample of labelled rows, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every row whose crc32(doc_id as text) is divisible by this is held out of all training.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, most: int) -> dict[int, int]:
    """doc_id -> 0/1 of at most ``most`` labelled rows outside the held-out fold, those of least hash.

    Rows with a null id or label take no part; a doc_id labelled several times gets the majority, ties 1.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    rows = rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return {r["doc_id"]: r["y"] for r in rows.collect()}


def with_labels(docs: DataFrame, sample: dict[int, int]) -> DataFrame:
    """The sample's documents (doc_id, text) with their label y; of a repeated doc_id one row, that of least text hash.

    The sample is broadcast, its size is bounded by its parameter, and so is the result.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(sample.items()), "doc_id long, y int")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return docs.join(F.broadcast(known), "doc_id").withColumn("_place", place).filter("_place = 1").drop("_place")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and offset by Newton's method, with his smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margins + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins + 1e-3 * a, g.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b
