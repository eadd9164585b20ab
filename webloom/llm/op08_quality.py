"""Document quality by naive Bayes support vectors.

A document becomes a set of n-gram indicators over two alphabets: word shapes
(letter case, digits and marks) as 1-, 2- and 3-grams, and repetition marks (a
word equal to the one before, or seen before).  An n-gram has one indicator for
its presence and one for each power of a half that its share of the text
reaches.  Indicators are scaled by the log-count ratio of the classes (naive
Bayes); a linear hinge-loss model is fitted on them by dual coordinate descent,
and Platt's sigmoid on cross-fitted margins gives the score.

The model is fitted on at most SAMPLE labelled rows (those of least hash); every
document is scored by its whole text.

Edge cases: null and empty texts have the indicator "no words" only and get the
score the model gives it; without labelled rows, or with one class, the score is
the share of label 1 (0.5 if there are none); repeated and equal texts get equal
scores; very long texts are read whole; an empty table gives no rows; other
columns, lang and source included, are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import calibrate, held_out, sigmoid, training_sample, with_labels
from .shared import id_text, table

SAMPLE = 30_000
BUCKETS = 1 << 18
THRESHOLD = 0.3
SMOOTH, COST, EPOCHS, SEED = 1.0, 0.3, 12, 7
#: Shapes a worker remembers; a full memory is emptied.
SHAPES = 250_000
_RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}|[a-zß-öø-ÿ]+|\d+|(\W|_)\1*")


def shape(word: str) -> str:
    def run(m: re.Match) -> str:
        c = m[0]
        return "X" if c[0].isupper() else "x" if c[0].isalpha() else "9" if c[0].isdigit() else c[:3]

    return _RUNS.sub(run, word)


def _bucket(text: str) -> int:
    return crc32(text.encode("utf-8", "replace")) % BUCKETS


class Indicators:
    """Text -> sorted indicator numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}  # word -> hash of its shape
        self.levels: dict[tuple, int] = {}

    def _shapes(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.number) > SHAPES:
                self.number.clear()
            for w in dict.fromkeys(words):
                if w not in self.number:
                    self.number[w] = crc32(shape(w).encode("utf-8", "replace"))
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        n = len(words)
        if not n:
            return np.array([_bucket("no words")], np.int32)
        s = self._shapes(words)
        seen: dict[str, int] = {}
        put = seen.setdefault
        who = np.fromiter((put(w, len(seen)) for w in words), np.int64, n)
        length = n.bit_length()
        out = []
        for order in (1, 2, 3):
            if n < order:
                break
            g = s[: n - order + 1].copy()
            for k in range(1, order):
                g = (g * 1_000_003 + s[k : n - order + 1 + k]) & 0x7FFFFFFFFFFF
            grams, counts = np.unique(g, return_counts=True)
            share = np.floor(np.log2(counts / len(g))).astype(np.int64)  # 0 .. -inf
            for level in (99, 5, 4, 3, 2, 1):
                got = grams[share >= -level]
                out.append(((got * 2_654_435_761 + 977 * order + 31 * level) >> 7) % BUCKETS)
        same = {"=1": float(np.mean(who[1:] == who[:-1])) if n > 1 else 0.0, "=2": float(np.mean(who[2:] == who[:-2])) if n > 2 else 0.0, "seen": 1 - len(seen) / n}
        marks = [_bucket(f"{k} {i}" + f" {length}" * (k == "seen")) for k, v in same.items() for i in range(int(v * 16) + 1)]
        lines = [x for x in text.split("\n") if x]
        repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
        marks += [_bucket(f"line {i} {len(lines).bit_length()}") for i in range(int(repeated * 8) + 1)]
        marks.append(_bucket(f"words {length}"))
        return np.unique(np.concatenate([*out, np.array(marks)])).astype(np.int32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last is the offset) of the linear model of least squared norm and hinge loss; y is -1 or 1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


class Model:
    """weights over buckets, offset, and the sigmoid's slope and offset."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(self.slope * (self.weights[features].sum() + self.offset) + self.shift))


def _fit_margins(rows: list[np.ndarray], y: np.ndarray, smooth: float, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    counts = np.full((2, BUCKETS), smooth)
    for at, label in zip(rows, y.tolist()):
        counts[label, at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    norm = float(np.mean([np.sqrt((ratio[at] ** 2).sum()) for at in rows])) or 1.0
    ratio /= norm
    balance = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    w = dual_coordinate_descent(rows, [ratio[at] for at in rows], np.where(y == 1, 1.0, -1.0), BUCKETS, cost * balance, epochs, SEED)
    return w[:-1] * ratio, float(w[-1])


def fit(rows: list[np.ndarray], y: np.ndarray, smooth: float = SMOOTH, cost: float = COST, epochs: int = EPOCHS) -> Model:
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    margins = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    for k in (0, 1):
        use = [i for i in range(len(y)) if half[i] != k]
        if y[use].min() == y[use].max():
            use = list(range(len(y)))
        w, offset = _fit_margins([rows[i] for i in use], y[use], smooth, cost, epochs)
        for i in np.flatnonzero(half == k).tolist():
            margins[i] = w[rows[i]].sum() + offset
    slope, shift = calibrate(margins, y)
    w, offset = _fit_margins(rows, y, smooth, cost, epochs)
    return Model(w, offset, slope, shift)


_OWN: list[Indicators] = []


def indicators() -> Indicators:
    if not _OWN:
        _OWN.append(Indicators())
    return _OWN[0]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """Fits on at most ``most`` labelled rows outside the held-out fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = indicators()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "at": [make.of(t).tobytes() for t in batch["text"]]})

    sample = training_sample(labels, label, most)
    if not sample:
        return fit([], np.zeros(0, np.int64))
    got = with_labels(id_text(docs), sample).mapInPandas(run, "doc_id long, y int, at binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["at"])))
    return fit([np.frombuffer(r["at"], np.int32) for r in got], np.array([r["y"] for r in got], np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, model = indicators(), shared.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(make.of(t)) for t in batch["text"]]})

    scored = id_text(docs).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make, model = indicators(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(make.of(t or "")) >= threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
