"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the distinct vectors (SAMPLE, those of least hash) an
exact neighbour graph is built and cut into balanced parts by restreamed greedy
assignment with a capacity.  A small network learns, for a vector, the parts of
its neighbours.  Every vector is indexed under its most probable part; a query
goes to its most probable parts until they hold PROBED of its probability (at
least LEAST_PARTS) and is reranked there by exact inner products in double
precision.  Parts are searched in blocks of at most BLOCK vectors and queries.

Equal vectors are searched once: an index entry keeps the NEAREST + 1 least ids
of its vector, as no other can be among the nearest.

Vectors of different lengths have no inner product: each length is fitted, indexed
and searched by itself.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, as queries or candidates; ties go to the smaller vec_id; a repeated (vec_id, vector) counts once; a query
with fewer candidates gets them all; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

NEAREST, QUERY_EVERY = 20, 20
#: Rows of the fit's sample, neighbours in its graph, sample rows for each part.
SAMPLE, NEIGHBOURS, PER_PART, MOST_PARTS = 8192, 12, 128, 64
SLACK, PASSES = 1.1, 8
HIDDEN, EPOCHS, RATE, SEED = 96, 25, 3e-3, 11
PROBED, LEAST_PARTS = 0.97, 6
BLOCK = 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for first in range(0, len(x), 1024):
        s = x[first : first + 1024] @ x.T
        s[np.arange(len(s)), np.arange(first, first + len(s))] = -np.inf
        out[first : first + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = SLACK, passes: int = PASSES) -> np.ndarray:
    """Parts of at most slack x their fair share that keep neighbours together.

    Vertices come in breadth-first order at first, then again and again; each
    takes the part with most of its neighbours, discounted as the part fills up.
    """
    n = len(graph)
    both: list[list[int]] = [[] for _ in range(n)]
    for v, row in enumerate(graph.tolist()):
        both[v] += row
        for u in row:
            both[u].append(v)
    order, met = [], bytearray(n)
    for root in range(n):
        if not met[root]:
            met[root] = 1
            order.append(root)
            at = len(order) - 1
            while at < len(order):
                for u in both[order[at]]:
                    if not met[u]:
                        met[u] = 1
                        order.append(u)
                at += 1
    room = max(1.0, slack * n / parts)
    part, size = [-1] * n, [0] * parts
    for _ in range(passes):
        moved = 0
        for v in order:
            old = part[v]
            if old >= 0:
                size[old] -= 1
            tally: dict[int, int] = {}
            for u in both[v]:
                p = part[u]
                if p >= 0:
                    tally[p] = tally.get(p, 0) + 1
            best, gain = -1, 0.0
            for p, c in tally.items():
                g = c * (1 - size[p] / room)
                if g > gain:
                    best, gain = p, g
            if best < 0:
                best = min(range(parts), key=size.__getitem__)
            part[v] = best
            size[best] += 1
            moved += best != old
        if moved < n // 200:
            break
    return np.array(part, np.int32)


class Router:
    """A network of one hidden layer: directions of vectors -> probabilities of parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @staticmethod
    def inputs(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * np.sqrt(x.shape[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.weights
        z = np.maximum(self.inputs(x) @ w + b, 0) @ u + c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def route(self, x: np.ndarray, probed: float = PROBED, least: int = LEAST_PARTS) -> list[np.ndarray]:
        """The parts each query visits."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        count = np.maximum((reach < probed).sum(axis=1) + 1, least)
        return [order[i, : min(c, p.shape[1])] for i, c in enumerate(count.tolist())]


def fit_router(x: np.ndarray) -> Router:
    """Graph, balanced parts and network of a sample."""
    rng = np.random.default_rng(SEED)
    n, d = x.shape
    parts = int(np.clip(n // PER_PART, 1, MOST_PARTS))
    inputs = Router.inputs(x)
    graph = neighbour_graph(x.astype(np.float64) / np.abs(x).max(), NEIGHBOURS)  # one factor for all keeps the order and the range
    part = balanced_parts(graph, parts)
    target = np.zeros((n, parts))
    target[np.arange(n), part] += 1
    for k in range(graph.shape[1]):
        np.add.at(target, (np.arange(n), part[graph[:, k]]), 1)
    target /= target.sum(axis=1, keepdims=True)
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    one, two, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS if parts > 1 else 0):
        order = rng.permutation(n)
        for first in range(0, n, 256):
            at = order[first : first + 256]
            xi = inputs[at]
            h = np.maximum(xi @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            gap = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            back = (gap @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((xi.T @ back, back.sum(axis=0), h.T @ gap, gap.sum(axis=0))):
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                w[k] -= RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Router(w)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of float where it is one, else of double) of the rows that take part."""
    as_is = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    embedding = F.col("embedding") if as_is else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """vid, embedding, and the least ids (at most ``ids``) of each distinct vector; a hot vector is cut down before the shuffle."""
    place = F.row_number().over(Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).filter(F.col("place") <= ids)
    found = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(found.withColumn("vid", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _top(k: int):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "score", "ids"]
        if not len(queries) or not len(index):
            return pd.DataFrame([], columns=names)
        index = index.sort_values("vid")
        q, x = _matrix(queries["embedding"]), _matrix(index["embedding"])
        least, ids = np.array([v[0] for v in index["ids"]]), index["ids"].to_numpy()
        out, k_here = [], min(k, len(x))
        for qid, v in zip(queries["qid"].tolist(), q):
            near = x @ v
            floor = np.partition(near, len(near) - k_here)[len(near) - k_here]
            at = np.flatnonzero(near >= floor - 1e-9 * (1 + abs(floor)))
            exact = np.einsum("ij,j->i", x[at], v)  # the same sum for equal vectors, wherever they stand
            best = np.lexsort((least[at], -exact))[:k_here]
            out += [(qid, float(exact[b]), ids[at[b]]) for b in best]
        return pd.DataFrame(out, columns=names)

    return lambda key, queries, index: run(queries, index)


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, probed: float = PROBED, least: int = LEAST_PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``."""
    rows = valid_vectors(vectors)
    lengths = sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    found = [_nearest(rows.filter(F.size("embedding") == d) if len(lengths) > 1 else rows, every, k, probed, least) for d in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, every: int, k: int, probed: float, least: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    spark = rows.sparkSession
    index = distinct_vectors(rows, k + 1)
    sample = index.orderBy(F.xxhash64("embedding"), "vid").select("embedding").limit(SAMPLE).collect()
    router = fit_router(np.array([r["embedding"] for r in sample], np.float64)) if sample else Router([])
    shared = spark.sparkContext.broadcast(router)

    def assign(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(part=shared.value.probabilities(_matrix(batch["embedding"])).argmax(axis=1).astype(np.int32))

    def visit(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=shared.value.route(_matrix(batch["embedding"]), probed, least))

    kind = index.schema["embedding"].dataType.simpleString()
    indexed = stored(index.mapInPandas(assign, f"embedding {kind}, ids array<bigint>, vid bigint, part int"), "index")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct().join(index.select("embedding", F.col("vid").alias("qid")), "embedding")
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "qid"), "queries")
    visits = index.join(asked.select("qid").distinct(), F.col("vid") == F.col("qid")).select("qid", "embedding")
    visits = visits.mapInPandas(visit, f"qid bigint, embedding {kind}, parts array<int>").select("qid", "embedding", F.explode("parts").alias("part"))
    visits = stored(visits, "visits")

    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = visits.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
    plan = F.broadcast(blocks.join(asks, "part"))  # a row for each part: MOST_PARTS at most
    side_x = indexed.join(plan, "part").withColumn("block", F.pmod(F.xxhash64("vid"), "blocks").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    side_q = visits.join(plan, "part").withColumn("ask", F.pmod(F.xxhash64("qid"), "asks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ("part", "block", "ask")
    found = side_q.select(*cell, "qid", "embedding").groupBy(*cell).cogroup(side_x.select(*cell, "vid", "embedding", "ids").groupBy(*cell))
    found = found.applyInPandas(_top(k + 1), "qid bigint, score double, ids array<bigint>")

    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0]))
    kept = found.withColumn("place", best).filter(F.col("place") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
    lists = kept.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k + 1).alias("near"))
    own = asked.join(lists, "qid").select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "s")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def op6_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
