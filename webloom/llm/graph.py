"""Connected components by alternating stars, for edge tables of any size and skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

ROUNDS = 40
#: A node of more neighbours is a hub; at most so many hubs are broadcast (16-byte keys: 32 MB), beyond it they are joined.
HUB, BROADCAST_HUBS = 200, 1_000_000


def _to_least(pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """pairs (u, v) with the least neighbour m of u; a hub's pairs stay where they are and look it up."""
    least = stored(neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hubs = least.filter(F.col("n") > HUB).select("u", F.col("m").alias("of_hub"))
    if not 0 < hubs.count() <= BROADCAST_HUBS:
        return pairs.join(least.select("u", "m"), "u")
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("of_hub is null").select("u", "v").join(least.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(marked.filter("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b); self-loops give single nodes.

    Each round links a node's larger neighbours, then its smaller ones, to its
    least neighbour, and is written to the shared folder.  Neighbours are never
    gathered: a hub costs a partial minimum and a broadcast of one row.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("v", "u"))
        large = _to_least(both.filter("v > u"), both).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(large, large).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = stored(small.distinct(), "small-star")
    else:
        raise RuntimeError("components didn't settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stars.union(roots)
    return found.union(loops.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
