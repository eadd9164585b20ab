"""What a crawl keeps of a page, and the text parts that content checks read: one parse a page, in Arrow batches.

The crawl's rules differ from the page report's: an empty alt counts as missing,
words count wherever they aren't in scripts, styles, templates or drawings (the
title's too), the first description counts, and links are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.batches import pieces

# Elements without page text; Open Graph keys that count; elements outside the body text; longest anchor; text pieces that are hashed.
NO_WORDS = frozenset(("script", "style", "noscript", "template", "svg"))
GRAPH_KEYS = frozenset(("og:title", "og:image", "og:description", "og:url", "og:type"))
OUTSIDE = frozenset(("nav", "header", "footer", "script", "style", "noscript"))
ANCHOR, PIECES = 200, 4000
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))

LINK = "struct<target:string,anchor:string,rel:string>"
CRAWLED = {
    "title": "string", "meta_desc": "string", "robots": "string", "canonical": "string", "h1": "array<string>", "h2_count": "int", "hreflang": "int", "images": "int", "images_no_alt": "int", "links": f"array<{LINK}>", "word_count": "int", "content_hash": "string",
    "html_lang": "string", "viewport": "string", "og_present": "int", "jsonld_count": "int", "blank_no_noopener": "int",
}
PARTS = {"body_text": "string", "title": "string", "h1_texts": "array<string>", "headings": "array<string>", "paragraphs": "array<string>", "meta_description": "string"}


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class CrawlPage(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.silent = base, 0
        self.found = {k: [] if t.startswith("array") else 0 if t == "int" else None for k, t in CRAWLED.items()}
        self.gathering: dict[str, list[str] | None] = {"title": None, "h1": None, "a": None}
        self.title, self.pieces, self.link, self.in_ld = [], [], ("", ""), False

    def first(self, name: str, value: str) -> None:
        if self.found[name] is None:
            self.found[name] = value.strip()

    def handle_starttag(self, tag, attrs):
        a, f = {k.lower(): v or "" for k, v in attrs}, self.found
        if tag in NO_WORDS:
            self.silent += 1
            if tag == "script" and a.get("type", "").lower() == "application/ld+json":
                f["jsonld_count"] += 1
                self.in_ld = True
        elif tag == "html":
            f["html_lang"] = a.get("lang", "").strip() or None
        elif tag == "title":
            self.gathering["title"] = self.title
        elif tag == "meta":
            name = a.get("name", "").lower()
            if name in ("description", "robots", "viewport"):
                self.first({"description": "meta_desc"}.get(name, name), a.get("content", ""))
            f["og_present"] |= a.get("property", "").lower() in GRAPH_KEYS
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if "canonical" in rel and a.get("href"):
                f["canonical"] = urljoin(self.base, a["href"])
            f["hreflang"] += "alternate" in rel and bool(a.get("hreflang"))
        elif tag == "h1":
            self.gathering["h1"] = []
        elif tag == "h2":
            f["h2_count"] += 1
        elif tag == "img":
            f["images"] += 1
            f["images_no_alt"] += not a.get("alt", "").strip()
        elif tag == "a" and a.get("href"):
            self.gathering["a"], self.link = [], (urljoin(self.base, urldefrag(a["href"])[0]), a.get("rel", ""))
            rel = a.get("rel", "").lower()
            f["blank_no_noopener"] += a.get("target", "").lower() == "_blank" and "noopener" not in rel and "noreferrer" not in rel

    def handle_endtag(self, tag):
        if tag in NO_WORDS:
            self.silent = max(0, self.silent - 1)
            self.in_ld = self.in_ld and tag != "script"
        elif tag in self.gathering and self.gathering[tag] is not None:
            text, self.gathering[tag] = _joined(self.gathering[tag]), None
            if tag == "h1" and text:
                self.found["h1"].append(text)
            elif tag == "a":
                self.found["links"].append({"target": self.link[0], "anchor": text[:ANCHOR], "rel": self.link[1]})

    def handle_data(self, data):
        if self.in_ld:
            return
        for parts in self.gathering.values():
            if parts is not None:
                parts.append(data)
        if not self.silent and (words := data.split()):
            self.found["word_count"] += len(words)
            if len(self.pieces) < PIECES:
                self.pieces.append(data.strip().lower())

    def result(self) -> dict:
        text = " ".join(" ".join(self.pieces).split())
        return self.found | {"title": _joined(self.title) or None, "content_hash": md5(text.encode("utf-8", "replace")).hexdigest() if text else None}


class TextParts(HTMLParser):
    """Body text outside menus, headers, footers and scripts; texts of the title, headings and paragraphs that were closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {k: [] if t.startswith("array") else "" for k, t in PARTS.items()}
        self.body, self.inside, self.outside = [], False, 0
        self.now: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "body"
        self.outside += self.inside and tag in OUTSIDE
        if tag in HEADINGS or tag in ("title", "p"):
            self.now = (tag, [])
        elif tag == "meta":
            a = dict(attrs)
            if (a.get("name") or "").lower() == "description":
                self.found["meta_description"] = a.get("content") or ""

    def handle_endtag(self, tag):
        if self.inside and tag in OUTSIDE and self.outside:
            self.outside -= 1
        if tag == "body":
            self.inside = False
        if self.now and self.now[0] == tag:
            text, self.now = " ".join(self.now[1]).strip(), None
            if tag == "title":
                self.found["title"] = text
            else:
                self.found["paragraphs" if tag == "p" else "headings"].append(text)
                if tag == "h1":
                    self.found["h1_texts"].append(text)

    def handle_data(self, data):
        if self.inside and not self.outside:
            self.body.append(data)
        if self.now:
            self.now[1].append(data)

    def result(self) -> dict:
        return self.found | {"body_text": "".join(self.body)}


def _run(make, columns: dict[str, str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = []
            for html, url in zip(batch["html"], batch["url"]):
                parser = make(url or "")
                try:
                    parser.feed(html or "")
                    parser.close()
                except (ValueError, AssertionError):  # what was read so far stands
                    pass
                out.append(parser.result())
            yield pd.concat([batch[["key"]], pd.DataFrame(out, columns=[*columns])], axis=1)

    return rows


def _parsed(pages: DataFrame, key: str, make, columns: dict[str, str]) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{k} {t}" for k, t in columns.items())
    return pages.selectExpr(f"{key} as key", "url", "html").mapInPandas(_run(make, columns), schema).withColumnRenamed("key", key)


def crawl_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """What a crawl keeps of every page (key, url, html); a null page is an empty one."""
    return _parsed(pages, key, CrawlPage, CRAWLED)


def text_parts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The text parts of every page (key, url, html)."""
    return _parsed(pages, key, lambda _: TextParts(), PARTS)
