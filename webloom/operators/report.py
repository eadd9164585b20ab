"""Signals of a page by one streaming parse, and the four category scores from them.

The parse runs in Arrow batches, a row that can't be parsed gives the signals of
an empty page and its error; scores, overall grade and issues are columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.batches import pieces
from . import headers

# Fixed values of the rules.
POOR_ANCHORS = frozenset(("click here", "here", "read more", "learn more", "more", "link", "this", "this link", "go", "see more", "details", "info"))
LANDMARK_ROLES = {"main": "main", "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside"}
ARIA_ROLES = frozenset(
    "alert alertdialog application article banner button cell checkbox columnheader combobox complementary contentinfo definition dialog document feed figure form grid gridcell group heading img link list listbox listitem log main marquee math menu menubar menuitem menuitemcheckbox "
    "menuitemradio meter navigation none note option presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status switch tab table tablist tabpanel term textbox timer toolbar tooltip tree treegrid treeitem".split()
)
OLD_ROLES = frozenset(("directory",))
CLICKABLE = frozenset(("hover", "clickable", "pointer", "btn", "button", "link"))
PLACEHOLDERS = ("lorem ipsum", "placeholder")
LANDMARK_TAGS = frozenset(("main", "nav", "header", "footer", "aside"))
BUDGET = {"html_kb": 100, "inline_total_kb": 50, "blocking_scripts": 2, "images_without_lazy": 3, "external_scripts": 15, "external_stylesheets": 5}
#: SEO points that each client-only part costs.
GAP_COSTS = {"content_client_only": 25, "h1_client_only": 8, "title_client_only": 8, "meta_description_client_only": 6, "canonical_client_only": 4, "structured_data_client_only": 3}
GENERIC_IMAGE = re.compile(r"(^|/)(img[_-]?\d+|image\d*|screenshot\d*|photo\d*|picture\d*|untitled|DSC[_\d]+|Screen\s?Shot)[^/]*\.\w+$", re.I)
MODERN_IMAGE = (".webp", ".avif", ".svg")
SILENT = frozenset(("script", "style", "nav", "footer"))
#: Elements whose text is kept.
TEXT_TAGS = frozenset(("title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "script", "style"))
#: What ends an open paragraph or list item that wasn't closed.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

SIGNALS = {
    "title": "string", "titles": "int", "description": "string", "descriptions": "int", "robots": "string", "og": "map<string,string>", "og_repeated": "int", "twitter": "int", "viewport_valid": "boolean", "zoom_disabled": "boolean", "charset": "boolean", "lang": "boolean",
    "canonical": "string", "canonicals": "int", "favicon": "boolean", "stylesheets": "int", "hreflangs": "int", "manifest": "boolean", "preconnect": "boolean", "preload": "boolean", "external_scripts": "int", "blocking_scripts": "int", "module_scripts": "int",
    "inline_script_bytes": "int", "inline_style_bytes": "int", "headings": "array<int>", "h1_texts": "array<string>", "empty_headings": "int", "images": "int", "images_no_alt": "int", "images_lazy": "int", "images_sized": "int", "images_srcset": "int", "images_modern": "int",
    "images_generic": "int", "pictures": "int", "mixed_content": "int", "autoplay": "int", "tables": "int", "tables_no_th": "int", "iframes_untitled": "int", "inputs": "int", "inputs_unlabelled": "int", "skip_link": "boolean", "broken_fragments": "array<string>",
    "blank": "int", "blank_unsafe": "int", "internal_links": "int", "external_links": "int", "nofollow": "int", "poor_anchors": "int", "landmarks": "array<string>", "tabindex_positive": "int", "words": "int", "json_ld": "int", "json_ld_types": "array<string>", "json_ld_invalid": "int",
    "svgs": "int", "svgs_unnamed": "int", "aria_invalid": "array<string>", "aria_deprecated": "array<string>", "links_as_buttons": "int", "fake_affordances": "int", "placeholders": "int", "bytes": "int", "error": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in SIGNALS.items())


class Signals(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.https = url, url.startswith("https://")
        self.open: list[str] = []
        #: Text gathered by each open element that keeps its own, innermost last; how many silent elements and bodies are open.
        self.texts: list[list[str] | None] = []
        self.keepers: list[list[str]] = []
        self.silent = self.bodies = 0
        self.ids, self.fragments, self.og_counts = set(), [], {}
        zero = {"int": 0, "boolean": False, "string": None}
        self.s = {k: zero[t] if t in zero else {} if t[0] == "m" else [] for k, t in SIGNALS.items()}
        self.in_head, self.hidden, self.th, self.kind = False, [], [], ""
        #: Whether the open drawing has a name; None outside drawings.
        self.svg_named: bool | None = None

    def add(self, name: str, n: int = 1) -> None:
        self.s[name] += n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == tag:
            self.shut()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        s = self.s
        if self.open and (self.open[-1] == "p" and tag in ENDS_PARAGRAPH or self.open[-1] == tag == "li"):
            self.closed(*self.shut())
        if a.get("id"):
            self.ids.add(a["id"])
        if a.get("tabindex", "").lstrip("+").isdigit() and int(a["tabindex"]) > 0:
            self.add("tabindex_positive")
        role = LANDMARK_ROLES.get(a.get("role", "").lower(), tag if tag in LANDMARK_TAGS else None)
        if role and role not in s["landmarks"]:
            s["landmarks"].append(role)
        self.semantics(tag, a)
        f = getattr(self, f"on_{tag}", None)
        if f:
            f(a)
        elif re.fullmatch("h[1-6]", tag):
            s["headings"].append(int(tag[1]))
        if tag not in ("meta", "link", "img", "br", "hr", "input", "source", "base", "col", "area", "embed", "track", "wbr"):
            self.open.append(tag)
            parts = [] if tag in TEXT_TAGS else None
            self.texts.append(parts)
            if parts is not None:
                self.keepers.append(parts)
            self.silent += tag in SILENT
            self.bodies += tag == "body"
            if tag in ("form", "div") and ("hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))):
                self.hidden.append(len(self.open))

    def semantics(self, tag, a) -> None:
        """Roles that don't exist or are outdated, links that act as buttons, boxes that only look clickable."""
        role = a.get("role", "").lower().strip()
        known = "aria_deprecated" if role in OLD_ROLES else "aria_invalid" if role and role not in ARIA_ROLES else None
        if known and role not in self.s[known]:
            self.s[known].append(role)
        self.add("links_as_buttons", tag == "a" and role == "button")
        if tag in ("div", "span") and "onclick" not in a and role not in ("button", "link"):
            looks = CLICKABLE & {*re.split(r"[-_\s]+", a.get("class", "").lower())}
            self.add("fake_affordances", bool(looks) or "cursor:pointer" in a.get("style", "").lower().replace(" ", ""))

    def on_svg(self, a):
        self.add("svgs")
        self.svg_named = "aria-label" in a or "aria-labelledby" in a or a.get("aria-hidden", "").lower() == "true"

    def insecure(self, link: str) -> None:
        if self.https and link.startswith("http://"):
            self.add("mixed_content")

    def on_html(self, a):
        self.s["lang"] |= bool(a.get("lang"))

    def on_head(self, a):
        self.in_head = True

    def on_body(self, a):
        self.in_head = False

    def on_title(self, a):
        self.add("titles")
        if self.svg_named is not None:
            self.svg_named = True

    def on_meta(self, a):
        s, name, prop, content = self.s, a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
        if name == "description":
            self.add("descriptions")
            s["description"] = content
        elif name == "robots":
            s["robots"] = content.lower()
        elif name == "viewport":
            v = content.lower().replace(" ", "")
            s["viewport_valid"] = "width=device-width" in v
            s["zoom_disabled"] = "user-scalable=no" in v or "user-scalable=0" in v or "maximum-scale=1" in v
        for key in (prop, name):
            if key.startswith("og:"):
                s["og"][key] = content
                self.og_counts[key] = self.og_counts.get(key, 0) + 1
                break
            if key.startswith("twitter:"):
                self.add("twitter")
                break
        s["charset"] |= "charset" in a or a.get("http-equiv", "").lower() == "content-type"

    def on_link(self, a):
        s, rel, href = self.s, a.get("rel", "").lower(), a.get("href", "")
        if "canonical" in rel:
            self.add("canonicals")
            s["canonical"] = s["canonical"] or href
        s["favicon"] |= "icon" in rel
        s["manifest"] |= "manifest" in rel
        s["preconnect"] |= "preconnect" in rel
        s["preload"] |= "preload" in rel
        if rel == "stylesheet":
            self.add("stylesheets")
            self.insecure(href)
        if "alternate" in rel and a.get("hreflang"):
            self.add("hreflangs")

    def on_script(self, a):
        self.kind = "" if a.get("src") else a.get("type", "").lower() or "script"
        if a.get("src"):
            self.add("external_scripts")
            self.insecure(a["src"])
            if self.in_head and "async" not in a and "defer" not in a and a.get("type") != "module":
                self.add("blocking_scripts")
        if a.get("type") == "module":
            self.add("module_scripts")

    def on_img(self, a):
        src = a.get("src", "")
        self.add("images")
        self.add("images_no_alt", "alt" not in a)
        self.add("images_lazy", a.get("loading") == "lazy")
        self.add("images_sized", "width" in a and "height" in a)
        self.add("images_srcset", "srcset" in a)
        self.add("images_modern", any(x in src.lower() for x in MODERN_IMAGE))
        self.add("images_generic", bool(GENERIC_IMAGE.search(src)))
        self.insecure(src)

    def on_picture(self, a):
        self.add("pictures")

    def on_source(self, a):
        self.insecure(a.get("src", ""))

    def on_video(self, a):
        self.add("autoplay", "autoplay" in a and "muted" not in a)

    on_audio = on_video

    def on_table(self, a):
        self.add("tables")
        self.th.append(False)

    def on_th(self, a):
        if self.th:
            self.th[-1] = True

    def on_iframe(self, a):
        self.add("iframes_untitled", not a.get("title"))

    def on_input(self, a):
        if not self.hidden and a.get("type", "").lower() not in ("hidden", "submit", "button", "reset", "image"):
            self.add("inputs")
            self.add("inputs_unlabelled", not (a.get("aria-label") or a.get("aria-labelledby") or a.get("id")))

    def on_a(self, a):
        href, rel = a.get("href", "").strip(), a.get("rel", "").lower()
        if href.startswith("#"):
            if len(href) > 1:
                self.fragments.append(href[1:])
            self.s["skip_link"] |= len(self.open) < 5 and href.startswith(("#main", "#content"))
        self.insecure(href)
        if a.get("target") == "_blank":
            self.add("blank")
            self.add("blank_unsafe", "noopener" not in rel)
        host = re.match(r"(?:https?:)?//([^/?#]*)", href)
        own = re.match(r"https?://([^/?#]*)", self.url)
        if host and (not own or host[1].lower() != own[1].lower()):
            self.add("external_links")
        elif href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
            self.add("internal_links")
            self.add("nofollow", "nofollow" in rel)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            at, text = self.shut()
            self.closed(at, text)
            if self.hidden and len(self.open) < self.hidden[-1]:
                self.hidden.pop()
            if at == tag:
                break

    def shut(self) -> tuple[str, str]:
        """Takes the innermost element off; its text goes to the one around it that keeps text."""
        tag, parts = self.open.pop(), self.texts.pop()
        self.silent -= tag in SILENT
        self.bodies -= tag == "body"
        text = "".join(parts or ())
        if parts is not None:
            self.keepers.pop()
            if self.keepers and text:
                self.keepers[-1].append(text)
        return tag, text

    def closed(self, tag: str, text: str) -> None:
        s = self.s
        if tag == "title":
            s["title"] = text.strip()
        elif re.fullmatch("h[1-6]", tag):
            self.add("empty_headings", not text.strip())
            if tag == "h1":
                s["h1_texts"].append(" ".join(text.split()))
        elif tag == "a":
            self.add("poor_anchors", text.strip().lower() in POOR_ANCHORS)
        elif tag == "script" and self.kind == "application/ld+json":
            self.json_ld(text)
        elif tag == "script" and self.kind:
            self.add("inline_script_bytes", len(text.encode("utf-8", "replace")))
        elif tag == "style":
            self.add("inline_style_bytes", len(text.encode("utf-8", "replace")))
        elif tag == "table" and self.th:
            self.add("tables_no_th", not self.th.pop())
        elif tag == "svg" and self.svg_named is not None:
            self.add("svgs_unnamed", not self.svg_named)
            self.svg_named = None
        elif tag == "head":
            self.in_head = False

    def json_ld(self, text: str) -> None:
        self.add("json_ld")
        try:
            found = json.loads(text)
        except ValueError:
            self.add("json_ld_invalid")
            return
        for node in found if isinstance(found, list) else [found]:
            kind = node.get("@type") if isinstance(node, dict) else None
            self.s["json_ld_types"] += [str(k) for k in (kind if isinstance(kind, list) else [kind]) if k]

    def handle_data(self, data):
        if self.keepers:
            self.keepers[-1].append(data)
        if self.bodies and not self.silent:
            self.add("words", len(data.split()))
        told = data.strip().lower()
        self.add("placeholders", (PLACEHOLDERS[0] in told) + (PLACEHOLDERS[1] in told and len(told) < 50))

    def finish(self, size: int) -> dict:
        while self.open:
            self.closed(*self.shut())
        s = self.s
        s["broken_fragments"] = [f"#{f}" for f in self.fragments if f not in self.ids]
        s["og_repeated"], s["bytes"] = sum(n > 1 for n in self.og_counts.values()), size
        return s


def signals_of(html: str | None, url: str | None) -> dict:
    """All signals of one page; what fails is reported in ``error``."""
    parser = Signals(url or "")
    try:
        parser.feed(html or "")
        parser.close()
        return parser.finish(len((html or "").encode("utf-8", "replace")))
    except Exception as e:  # one broken page must not end the job
        return Signals("").finish(0) | {"error": f"{type(e).__name__}: {e}"}


def analyse(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url and the signals of every page (key, url, html); a column headers is passed on."""
    also = [n for n in ("headers", "frameworks", "analytics") if n in pages.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = [signals_of(h, u) for h, u in zip(batch["html"], batch["url"])]
            yield pd.concat([batch[[key, "url", *also]], pd.DataFrame(rows, columns=[*SIGNALS])], axis=1)

    kind = pages.schema[key].dataType.simpleString()
    passed = "".join(f"{n} {pages.schema[n].dataType.simpleString()}, " for n in also)
    return pages.select(key, "url", *also, "html").mapInPandas(run, f"{key} {kind}, url string, {passed}{SCHEMA}")


def _part(total: Column, missing: Column, most: int) -> Column:
    return F.when((total == 0) | (missing == 0), most).otherwise(F.bround((total - missing) / F.greatest(total, F.lit(1)) * most).cast("int"))


def _steps(value: Column, *steps: tuple[float, int], beyond: int) -> Column:
    out = F.lit(beyond)
    for most, p in reversed(steps):
        out = F.when(value <= most, p).otherwise(out)
    return out


def _if(condition: Column, p: int, q: int = 0) -> Column:
    return F.when(condition, p).otherwise(q)


def _length(text: Column, present: int, best: tuple[int, int], good: tuple[int, int], top: int) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(present + F.when(n.between(*best), top).when(n.between(*good), 3).otherwise(1))


def logical_headings(headings: Column) -> Column:
    """No heading is more than one level below the one before it."""
    pairs = F.zip_with(headings, F.slice(headings, 2, 1 << 20), lambda a, b: F.coalesce(b <= a + 1, F.lit(True)))
    return F.forall(pairs, lambda ok: ok)


def category_scores(report: DataFrame) -> DataFrame:
    """The report with seo, security, accessibility, performance, their overall score and grade.

    With a column headers (map<string,string>) they count towards security, and a
    page without any (or a report without the column) has its security imputed.
    Flags of a render gap (``compare.render_gap``), where the report has them, cost SEO points.
    """
    c, kb = F.col, F.bround(F.col("bytes") / 1024.0, 1)
    h1 = F.size(F.filter("headings", lambda h: h == 1))
    title = F.greatest(_length(c("title"), 5, (50, 60), (30, 70), 5) + _length(c("description"), 4, (150, 160), (120, 170), 4) - _if(c("titles") > 1, 3) - _if(c("descriptions") > 1, 3), F.lit(0))
    head = F.greatest(F.when(h1 == 1, 8).when(h1 > 1, 3).otherwise(0) + F.when(F.size("headings") == 0, 0).when(logical_headings(c("headings")), 5).otherwise(2) - _if((c("words") > 0) & (c("words") < 300), 3), F.lit(0))
    technical = F.greatest(_if(c("canonicals") > 0, 5) - _if(c("canonicals") > 1, 3), F.lit(0)) + F.when(F.contains(F.coalesce("robots", F.lit("")), F.lit("noindex")), 2).otherwise(5) + _if(c("favicon"), 5) + 5
    og = F.size(F.array_intersect(F.map_keys("og"), F.array(*map(F.lit, ("og:title", "og:description", "og:image", "og:url")))))
    social = F.greatest(F.least(og * 2, F.lit(6)) + _if(c("twitter") > 0, 4) - _if(c("og_repeated") > 0, 2), F.lit(0))
    mobile = _if(c("preconnect"), 2) + _if(c("preload"), 2) + _steps(c("blocking_scripts"), (0, 3), (2, 1), beyond=0) + _steps(kb, (100, 4), (200, 2), beyond=1) + _if(c("viewport_valid"), 2)
    seo = title + head + _part(c("images"), c("images_no_alt"), 10) + technical + _if(c("json_ld") >= 1, 7) + _if(c("json_ld") >= 2, 3) + social + mobile + _if(c("charset"), 3) + _if(c("hreflangs") > 0, 3, 1)
    gap = sum((_if(c(flag), points) for flag, points in GAP_COSTS.items() if flag in report.columns), F.lit(0))
    seen = F.col("headers") if "headers" in report.columns else F.lit(None).cast("map<string,string>")
    security = headers.security_score(c("mixed_content"), c("blank"), c("blank_unsafe"), seen)
    marks = F.size(F.array_intersect("landmarks", F.array(*map(F.lit, ("main", "nav", "header", "footer")))))
    accessibility = (
        _part(c("images"), c("images_no_alt"), 18) + _if(c("lang"), 5) + _part(c("inputs"), c("inputs_unlabelled"), 13) + F.greatest(10 - 3 * c("empty_headings"), F.lit(0)) + _if(c("skip_link"), 5) + F.least(marks * 3, F.lit(10))
        + _part(c("images"), c("images") - c("images_sized"), 4) + F.greatest(5 - 2 * c("empty_headings"), F.lit(0)) + 7 - F.least(2 * c("tabindex_positive"), F.lit(4)) + 5 + 5
    )
    n, inline = c("images"), (c("inline_script_bytes") + c("inline_style_bytes")) / 1024.0
    modern = F.when(c("images_modern") >= n, 10).when(c("images_modern") == 0, 3).otherwise(F.bround(c("images_modern") / F.greatest(n, F.lit(1)) * 10).cast("int"))
    responsive = F.least(F.bround((c("images_srcset") + c("pictures")) / F.greatest(n, F.lit(1)) * 10).cast("int"), F.lit(10))
    lazy = F.when(n <= 1, 10).when(c("images_lazy") == 0, 3).otherwise(F.greatest(F.lit(5), F.bround(c("images_lazy") / F.greatest(n, F.lit(1)) * 10).cast("int")))
    performance = (
        _steps(kb, (50, 15), (100, 12), (200, 7), beyond=2) + _steps(c("blocking_scripts"), (0, 15), (1, 10), (2, 6), (4, 3), beyond=0) + F.when((n == 0) | (c("images_modern") >= n), 20).otherwise(responsive + modern)
        + _if(c("preconnect"), 8) + _if(c("preload"), 7) + 5 + _steps(inline, (10, 10), (30, 7), (50, 4), beyond=1) + lazy
    )
    out = report.withColumns({"seo": F.greatest(F.least(seo, F.lit(100)) - gap, F.lit(0)).cast("int"), **security, "accessibility": F.least(accessibility, F.lit(100)).cast("int"), "performance": F.least(performance, F.lit(100)).cast("int")})
    p0 = _if((F.coalesce("title", F.lit("")) == "") | (F.size(F.filter("headings", lambda h: h == 1)) == 0), 1)
    return out.withColumns(scores.composite(c("seo"), c("security"), c("accessibility"), c("performance"), p0, c("security_assessed")))


def budget_violations(report: DataFrame, budget: dict[str, int] | None = None) -> DataFrame:
    """The report with the names of what exceeds the budget."""
    most = BUDGET | (budget or {})
    kb = lambda x: x / 1024.0
    value = {
        "html_kb": kb(F.col("bytes")), "inline_total_kb": kb(F.col("inline_script_bytes") + F.col("inline_style_bytes")), "blocking_scripts": F.col("blocking_scripts"), "images_without_lazy": F.col("images") - F.col("images_lazy"),
        "external_scripts": F.col("external_scripts"), "external_stylesheets": F.col("stylesheets"),
    }
    return report.withColumn("over_budget", F.array_compact(F.array(*[F.when(v > most[k], F.lit(k)) for k, v in value.items()])))


def issues(report: DataFrame, key: str = "page_id") -> DataFrame:
    """key, severity, issue: what the report says is wrong, critical first to low.

    With columns frameworks and analytics (arrays, of ``providers.analyse``) what a
    client-side framework may still render is softened, and missing analytics are an
    issue; with a column headers missing security headers are.
    """
    c = F.col
    shell = F.size("frameworks") > 0 if "frameworks" in report.columns else F.lit(False)
    untracked = F.size("analytics") == 0 if "analytics" in report.columns else F.lit(False)
    given = F.col("headers") if "headers" in report.columns else F.lit(None).cast("map<string,string>")
    missing = [("high", headers.seen(given) & ~headers.has(given, name), f"missing header {name}") for name in (*[m[0] for m in headers.MISSING], "x-content-type-options")]
    h1, n = F.size(F.filter("headings", lambda h: h == 1)), F.length(F.coalesce("title", F.lit("")))
    d = F.length(F.coalesce("description", F.lit("")))
    rules = (
        ("critical", n == 0, "no title"), ("critical", (h1 == 0) & ~shell, "no h1"), ("high", (h1 == 0) & shell, "no h1 in served html"), ("critical", ~c("lang"), "no language"), ("critical", c("mixed_content") > 0, "mixed content"), ("critical", c("zoom_disabled"), "zoom disabled"),
        ("high", d == 0, "no description"), ("high", h1 > 1, "several h1"), ("high", c("images_no_alt") > 0, "images without alt"), ("high", c("canonicals") == 0, "no canonical"), ("high", F.size("og") == 0, "no Open Graph tags"),
        ("high", c("titles") > 1, "several titles"), ("high", c("descriptions") > 1, "several descriptions"), ("high", c("canonicals") > 1, "several canonicals"), ("high", ~c("viewport_valid"), "invalid viewport"), ("high", c("autoplay") > 0, "autoplay with sound"),
        ("medium", c("blocking_scripts") > 2, "blocking scripts"), ("medium", c("bytes") > 102400, "large html"), ("medium", ~c("favicon"), "no favicon"), ("medium", ~c("skip_link") & ~shell, "no skip link"), ("low", ~c("skip_link") & shell, "no skip link in served html"), ("medium", ~c("charset"), "no charset"),
        ("medium", c("empty_headings") > 0, "empty headings"), ("medium", F.size("broken_fragments") > 0, "broken fragments"), ("medium", c("inline_script_bytes") > 51200, "large inline scripts"), ("medium", ~logical_headings(c("headings")), "heading level skipped"),
        ("medium", (n > 60) | ((n > 0) & (n < 30)), "title length"), ("medium", (d > 160) | ((d > 0) & (d < 70)), "description length"), ("medium", (c("words") > 0) & (c("words") < 300), "thin content"), ("medium", c("images_generic") > 0, "generic image names"),
        ("medium", c("og_repeated") > 0, "repeated Open Graph tags"), ("medium", c("tabindex_positive") > 0, "positive tabindex"), ("medium", c("tables_no_th") > 0, "tables without headers"), ("medium", c("iframes_untitled") > 0, "untitled frames"),
        ("low", c("twitter") == 0, "no twitter tags"), ("low", ~c("preconnect"), "no preconnect"), ("low", c("blank_unsafe") > 0, "links without noopener"), ("low", (c("images") > 0) & (c("images_sized") == 0), "images without size"),
        ("low", (c("images") > 3) & (c("images_srcset") + c("pictures") == 0), "no responsive images"), ("low", c("poor_anchors") > 0, "poor anchor texts"), ("low", untracked, "no analytics"), ("medium", c("placeholders") > 0, "placeholder text"), ("medium", (c("svgs_unnamed") > 0) & ~shell, "drawings without a name"), ("low", (c("svgs_unnamed") > 0) & shell, "drawings without a name in served html"),
        ("medium", c("fake_affordances") > 0, "fake affordances"), ("low", F.size("aria_invalid") > 0, "invalid ARIA roles"), ("low", F.size("aria_deprecated") > 0, "deprecated ARIA roles"), ("low", c("links_as_buttons") > 0, "links as buttons"), ("low", (c("internal_links") == 0) & (c("words") > 0), "no internal links"), ("low", c("nofollow") > 0, "internal nofollow"),
    )
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(s).alias("severity"), F.lit(t).alias("issue"))) for s, rule, t in (*rules, *missing)]))
    return report.select(key, F.explode(found).alias("i")).select(key, "i.*")
