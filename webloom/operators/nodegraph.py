"""A page's JSON-LD as a graph: nodes, references between them by @id or nesting, and what products and businesses say through them.

One parse a page gives the node and the reference table; everything after it is
joins.  Nodes of one @id are one entity.  A reference may stand at either end
(``INVERSE``): an offer that names its item counts as that item's offer.  What an
entity reaches is found by joining references until nothing new is met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..sources.steps import written
from .jsonld import BLOCK, of_type
from .modules import LOCAL_TYPES

#: A key that says from the other end what the second says.
INVERSE = {"itemoffered": "offers", "itemreviewed": "review", "brandof": "brand"}
_NODE, _REFERENCE = "struct<node:int,id:string,types:array<string>,props:map<string,string>>", "struct<node:int,key:string,to_id:string,to_node:int>"


def graph_of(html: str | None) -> tuple[list[dict], list[dict]]:
    """The nodes of a page, nested ones too, and the references between them; keys and types in lower case."""
    nodes: list[dict] = []
    references: list[dict] = []
    todo: list[tuple[object, int | None, str]] = []
    for block in BLOCK.findall(html or ""):
        try:
            todo.append((json.loads(block), None, ""))
        except (ValueError, RecursionError):
            continue
    todo.reverse()
    while todo:
        value, owner, key = todo.pop()
        if isinstance(value, list):
            todo.extend((v, owner, key) for v in reversed(value))
        elif isinstance(value, dict):
            if set(value) == {"@id"} and owner is not None:
                references.append({"node": owner, "key": key, "to_id": str(value["@id"]), "to_node": None})
                continue
            if isinstance(value.get("@graph"), list) and not value.get("@type"):  # a wrapper is no node
                todo.extend((v, None, "") for v in reversed(value["@graph"]))
                continue
            number = len(nodes)
            nodes.append({"node": number, "id": str(value["@id"]) if value.get("@id") else None, "types": sorted({t.lower() for t in of_type(value)}), "props": {}})
            if owner is not None:
                references.append({"node": owner, "key": key, "to_id": None, "to_node": number})
            todo.extend((v, number, k.lower()) for k, v in reversed(list(value.items())) if not k.startswith("@"))
            if isinstance(value.get("@graph"), list):
                todo.extend((v, None, "") for v in reversed(value["@graph"]))
        elif owner is not None and value not in (None, "", False, 0):
            nodes[owner]["props"].setdefault(key, str(value))
    return nodes, references


def tables(pages: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (key, entity, types), their properties (key, entity, name, value) and references (key, entity, name, to)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            found = [graph_of(h) for h in batch["html"]]
            yield pd.DataFrame({key: batch[key], "nodes": [n for n, _ in found], "refs": [r for _, r in found]})

    parsed = written(pages.select(key, "html").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, nodes array<{_NODE}>, refs array<{_REFERENCE}>"), "json-ld")
    name = lambda node, id_: F.coalesce(id_, F.concat(F.lit("_:"), node))
    nodes = parsed.select(key, F.explode("nodes").alias("n")).select(key, "n.*").withColumn("entity", name(F.col("node"), F.col("id")))
    entities = nodes.groupBy(key, "entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))
    properties = nodes.select(key, "entity", "node", F.explode("props").alias("name", "value")).groupBy(key, "entity", "name").agg(F.min_by("value", "node").alias("value"))
    refs = parsed.select(key, "nodes", F.explode("refs").alias("r")).select(key, "r.*", F.get("nodes", F.col("r.node"))["id"].alias("own_id"), F.get("nodes", F.col("r.to_node"))["id"].alias("nested_id"))
    refs = refs.select(key, name(F.col("node"), F.col("own_id")).alias("entity"), F.col("key").alias("name"), F.coalesce("to_id", name(F.col("to_node"), F.col("nested_id"))).alias("to"))
    other = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    back = refs.filter(F.col("name").isin(*INVERSE)).select(key, F.col("to").alias("entity"), F.element_at(other, F.col("name")).alias("name"), F.col("entity").alias("to"))
    return entities, properties, refs.unionByName(back).distinct()


def reached(starts: DataFrame, references: DataFrame, names: list[str] | None = None, key: str = "page_id") -> DataFrame:
    """key, start, entity: what each start (key, start) reaches over references (of these names), itself included; joined until nothing is new."""
    edges = references if names is None else references.filter(F.col("name").isin(*names))
    edges = written(edges.select(key, "entity", "to").distinct(), "references")
    met = new = written(starts.select(key, "start", F.col("start").alias("entity")).distinct(), "reached")
    while True:
        step = new.join(edges, [key, "entity"]).select(key, "start", F.col("to").alias("entity")).distinct()
        new = written(step.join(met, [key, "start", "entity"], "left_anti"), "reached")
        if new.isEmpty():
            return met
        met = met.unionByName(new)


def products(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, product, name, brand, prices, currencies, valid, missing of every product: offers and brand may be nodes of their own, however deep."""
    entities, properties, references = (written(t, "json-ld-tables") for t in tables(pages, key))
    starts = entities.filter(F.array_contains("types", "product")).select(key, F.col("entity").alias("start"))
    value = lambda name: properties.filter(F.col("name") == name).select(key, "entity", F.col("value").alias(f"p_{name}"))
    offered = reached(starts, references, ["offers"], key).filter("entity <> start").join(value("price"), [key, "entity"], "left").join(value("pricecurrency"), [key, "entity"], "left")
    offers = offered.groupBy(key, "start").agg(F.array_sort(F.collect_set("p_price")).alias("prices"), F.array_sort(F.collect_set("p_pricecurrency")).alias("currencies"), F.count("*").alias("offers"))
    branded = references.filter("name = 'brand'").select(key, F.col("entity").alias("start"), F.col("to").alias("entity"))
    brands = starts.join(branded, [key, "start"]).join(value("name"), [key, "entity"]).groupBy(key, "start").agg(F.min("p_name").alias("brand_node"))
    known = entities.select(key, F.col("entity").alias("to"), F.lit(True).alias("described"))
    missing = reached(starts, references, None, key).join(references, [key, "entity"]).join(known, [key, "to"], "left").filter("described is null").groupBy(key, "start").agg(F.count_distinct("to").alias("missing"))
    own = lambda name: value(name).withColumnRenamed("entity", "start")
    rows = starts
    for part in (own("name"), own("brand"), own("offers"), offers, brands, missing):
        rows = rows.join(part, [key, "start"], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        key, F.col("start").alias("product"), F.col("p_name").alias("name"), F.coalesce("brand_node", "p_brand").alias("brand"), F.coalesce("prices", none).alias("prices"), F.coalesce("currencies", none).alias("currencies"),
        (F.col("p_name").isNotNull() & (F.col("offers").isNotNull() | F.col("p_offers").isNotNull())).alias("valid"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
    )


def businesses(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, business, complete: whether its name, telephone and address are said, by itself or through nodes of their own."""
    entities, properties, references = (written(t, "json-ld-tables") for t in tables(pages, key))
    starts = entities.filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in LOCAL_TYPES.lower().split("|")]))).select(key, "entity")
    said = properties.select(key, "entity", "name").unionByName(references.select(key, "entity", "name")).filter(F.col("name").isin("name", "telephone", "address")).groupBy(key, "entity").agg(F.count_distinct("name").alias("n"))
    return starts.join(said, [key, "entity"], "left").select(key, F.col("entity").alias("business"), (F.coalesce("n", F.lit(0)) == 3).alias("complete"))


def with_graph(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with ``graph``: what the modules ecommerce and local_seo read in place of patterns over the text."""
    p = products(pages, key).groupBy(key).agg(F.lit(True).alias("product"), F.bool_or("valid").alias("offer"))
    b = businesses(pages, key).groupBy(key).agg(F.lit(True).alias("business"), F.bool_or("complete").alias("complete"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return pages.join(p, key, "left").join(b, key, "left").withColumn("graph", F.struct(*map(no, ("product", "offer", "business", "complete")))).drop("product", "offer", "business", "complete")
