"""Structured data of pages: JSON-LD blocks parsed once per page in Arrow batches.

JSON of any shape is walked in Python; blocks that don't parse are counted, never raised.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces

BLOCK = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
VOCABULARY = re.compile(r"https?://schema\.org/?", re.I)

# Known types with the properties they need, types that may stand several times, types that must not review themselves.
NEEDED = {
    "organization": "name url", "localbusiness": "name url", "article": "headline author", "newsarticle": "headline author", "blogposting": "headline author", "faqpage": "mainEntity", "product": "name", "website": "name", "webpage": "name",
    "breadcrumblist": "itemListElement", "person": "name", "event": "name startDate", "recipe": "name", "review": "itemReviewed", "howto": "name step", "videoobject": "name uploadDate", "imageobject": "", "softwareapplication": "name", "restaurant": "name",
    "store": "name", "medicalbusiness": "name", "course": "name provider", "jobposting": "title datePosted", "collectionpage": "", "profilepage": "", "searchresultspage": "", "itemlist": "", "listitem": "", "offer": "", "aggregaterating": "", "rating": "",
    "brand": "", "postaladdress": "", "contactpoint": "", "openinghoursspecification": "", "propertyvalue": "", "question": "", "answer": "", "sitenavigationelement": "", "wpheader": "", "wpfooter": "", "service": "", "place": "", "geocoordinates": "",
}
REPEATABLE = frozenset("imageobject listitem offer person review comment question answer postaladdress contactpoint propertyvalue openinghoursspecification sitenavigationelement place".split())
OWN = frozenset("organization localbusiness store restaurant professionalservice medicalbusiness legalservice".split())
WEIGHTS = {"has_structured_data": 20, "valid_json": 20, "has_context": 15, "known_types": 15, "has_required_props": 20, "no_duplicate_types": 10}

NODE = "struct<type:string,known:boolean,missing:array<string>,json:string>"
SCHEMA = f"blocks int, invalid int, has_context boolean, nodes array<{NODE}>, products int, self_review boolean, objects array<string>"


def of_type(node: dict) -> list[str]:
    kind = node.get("@type")
    return [str(k) for k in (kind if isinstance(kind, list) else [kind]) if k]


def names_vocabulary(context) -> bool:
    todo = [context]
    while todo:
        c = todo.pop()
        if isinstance(c, str) and VOCABULARY.match(c):
            return True
        todo += c if isinstance(c, list) else map(str, c.values()) if isinstance(c, dict) else ()
    return False


def everywhere(tree, kind: str) -> int:
    """How many objects of a type are anywhere in a tree."""
    found, todo = 0, [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            found += kind in (k.lower() for k in of_type(x))
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return found


def page_nodes(html: str | None) -> dict:
    tops, invalid, blocks = [], 0, BLOCK.findall(html or "")
    for b in blocks:
        try:
            data = json.loads(b)
        except (ValueError, RecursionError):
            invalid += 1
            continue
        tops += [d for d in (data if isinstance(data, list) else [data]) if isinstance(d, dict)]
    nodes = [n for d in tops for n in ([x for x in d["@graph"] if isinstance(x, dict)] if isinstance(d.get("@graph"), list) else [d])]
    contexts = [d["@context"] for d in tops if d.get("@context") is not None]
    rows, own = [], False
    for n in nodes:
        kinds = of_type(n)
        own |= bool({k.lower() for k in kinds} & OWN) and bool(n.get("aggregateRating") or n.get("review"))
        for k in kinds:
            needs = NEEDED.get(k.lower())
            rows.append({"type": k, "known": needs is not None, "missing": [p for p in (needs or "").split() if not n.get(p)], "json": json.dumps(n, sort_keys=True, ensure_ascii=False)})
    return {"blocks": len(blocks), "invalid": invalid, "has_context": bool(contexts) and all(map(names_vocabulary, contexts)), "nodes": rows, "products": sum(everywhere(d, "product") for d in tops), "self_review": own, "objects": [json.dumps(n, ensure_ascii=False) for n in nodes]}


def nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, blocks, invalid, has_context, nodes, products (at any depth), self_review, objects (all of them, with or without a type) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            found = pd.DataFrame([page_nodes(h) for h in batch["html"]], columns=["blocks", "invalid", "has_context", "nodes", "products", "self_review", "objects"])
            yield pd.concat([batch[[key]], found], axis=1)

    return pages.select(key, "html").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {SCHEMA}")


def duplicates(types: list[str]) -> list[str]:
    return sorted(k for k, n in Counter(t.lower() for t in types).items() if n > 1 and k not in REPEATABLE)


def validate(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, points, total, findings over the rows of nodes()."""
    types = F.filter(F.transform("nodes", lambda n: F.lower(n["type"])), lambda t: ~t.isin(*sorted(REPEATABLE)))
    signals = {
        "has_structured_data": F.col("blocks") > 0, "valid_json": F.col("invalid") == 0, "has_context": F.col("has_context"), "known_types": (F.size("nodes") > 0) & F.forall("nodes", lambda n: n["known"]),
        "has_required_props": F.forall("nodes", lambda n: F.size(n["missing"]) == 0), "no_duplicate_types": F.size(types) == F.size(F.array_distinct(types)),
    }
    earned = {k: F.when(v, WEIGHTS[k]).otherwise(0) for k, v in signals.items()}
    some = F.col("blocks") > 0
    rules = (
        (~some, "P1", "No structured data found"), (some & ~signals["valid_json"], "P0", "Invalid JSON-LD"), (some & ~signals["has_context"], "P1", "Missing or wrong @context"), (some & ~signals["known_types"], "P2", "Unknown types"),
        (some & ~signals["has_required_props"], "P1", "Required properties missing"), (some & ~signals["no_duplicate_types"], "P3", "Types stand several times"), (F.col("self_review"), "P2", "Self-serving review"),
    )
    findings = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(t).alias("title"))) for c, p, t in rules]))
    return found.select(key, F.create_map(*[x for k, v in earned.items() for x in (F.lit(k), v)]).alias("points"), sum(earned.values(), F.lit(0)).cast("int").alias("total"), findings.alias("findings"))
