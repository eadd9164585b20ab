"""What the markup of a page states, as lists in page order: one parse a page, in Arrow batches.

Metas, links, icons, inputs, questions and the like, and the page's JSON-LD objects.
Rules about them are columns (``advisor``).  Values and texts keep their character
references as written.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.batches import pieces
from .jsonld import page_nodes

FACTS = {
    "metas": "array<struct<by:string,key:string,content:string>>", "title": "string", "h1": "string", "hrefs": "array<string>", "icons": "array<string>", "inputs": "array<struct<kind:string,name:string>>", "roles": "array<string>", "classes": "array<string>",
    "labels": "array<string>", "properties": "array<struct<name:string,content:string>>", "itemtypes": "array<string>", "details": "array<struct<question:string,answer:string>>", "asked": "int", "article": "boolean", "objects": "array<string>", "types": "array<string>",
}
#: Headings whose plain question counts.
ASKING = frozenset(("h2", "h3", "h4"))


class _Facts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.facts: dict = {k: [] if t.startswith("array") else None for k, t in FACTS.items()} | {"asked": 0, "article": False}
        #: Texts being gathered, by what they are for; details elements that are open, as [question, answer] pieces and whether the summary is.
        self.texts: dict[str, list[str]] = {}
        self.open_details: list[tuple[list[str] | None, list[str]]] = []
        self.in_summary = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, f = {k: v or "" for k, v in reversed(attrs)}, self.facts
        if tag == "meta" and "content" in a:
            f["metas"] += [{"by": by, "key": a[by].lower(), "content": a["content"].strip()} for by in ("property", "name") if by in a]
        if a.get("href"):
            f["hrefs"].append(a["href"])
            if tag == "link" and "icon" in a.get("rel", "").lower():
                f["icons"].append(a["href"])
        if tag == "input":
            f["inputs"].append({"kind": a.get("type", "").lower(), "name": a.get("name", "").lower()})
        if "itemprop" in a:
            f["properties"].append({"name": a["itemprop"].lower(), "content": a.get("content")})
        for name, into in (("role", "roles"), ("class", "classes"), ("aria-label", "labels"), ("itemtype", "itemtypes")):
            if a.get(name):
                f[into].append(a[name].lower())
        f["article"] |= tag == "article"
        if tag in ("title", "h1") and f[tag] is None:
            self.texts[tag] = []
        if tag in ASKING:
            self.texts["asked"] = []
        elif "asked" in self.texts:
            del self.texts["asked"]  # a question with markup in it doesn't count
        if tag == "details":
            self.open_details.append((None, []))
        elif tag == "summary" and self.open_details and self.open_details[-1][0] is None:
            self.open_details[-1] = ([], self.open_details[-1][1])
            self.in_summary = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("title", "h1") and tag in self.texts:
            self.facts[tag] = "".join(self.texts.pop(tag))
        elif tag in ASKING and "asked" in self.texts:
            self.facts["asked"] += "".join(self.texts.pop("asked")).rstrip().endswith("?")
        elif tag == "summary":
            self.in_summary = False
        elif tag == "details" and self.open_details:
            question, answer = self.open_details.pop()
            self.in_summary = False
            if question is not None and (asked := "".join(question).strip()):
                self.facts["details"].append({"question": asked, "answer": " ".join("".join(answer).split())})

    def handle_data(self, data: str) -> None:
        for pieces in self.texts.values():
            pieces.append(data)
        if self.open_details:
            question, answer = self.open_details[-1]
            (question if self.in_summary and question is not None else answer).append(data)


def facts_of(html: str | None) -> dict:
    """The facts of one page, as ``FACTS`` names them."""
    parser = _Facts()
    parser.feed((html or "").replace("&", "&amp;"))  # references come out as they were written
    parser.close()
    found = page_nodes(html)
    return parser.facts | {"objects": found["objects"], "types": sorted({n["type"].lower() for n in found["nodes"]})}


def facts(pages: DataFrame, key: str = "page_id", also: tuple[str, ...] = ()) -> DataFrame:
    """key and the facts of every page (key, html); columns named in also are passed on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.concat([batch[[key, *also]], pd.DataFrame([facts_of(h) for h in batch["html"]], columns=list(FACTS))], axis=1)

    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (key, *also))
    return pages.select(*dict.fromkeys((key, *also, "html"))).mapInPandas(run, f"{kept}, " + ", ".join(f"{k} {t}" for k, t in FACTS.items()))
