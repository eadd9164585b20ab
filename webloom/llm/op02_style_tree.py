"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of element nodes (a node is the path
of tags and class names from the root).  For each node the tree holds, over the
pages that have it, which sequences of child elements occur (presentation), in
how many pages each of its contents occurs (text blocks, link targets), and how
much text stands in it, in and out of links.  A node's importance is the entropy,
in base "pages", of its presentations, or for nodes with own content one minus the
mean entropy of its contents: what stands alike on most pages scores near 0.  The
importance of a branch is the mean over its nodes, weighted by DECAY per level and
by pages.

The tree decides twice.  From the root down it follows the branch that weighs most
(unlinked text x importance) while that branch is a container, and the last one,
if it holds MAIN_SHARE of the host's weight, is where the text of the host's pages
stands.  And each page loses the branches of low importance, inside its main
branch too.  The kinds of elements are priors: 0 to the template tags and
roles listed below, 1 to the article and main elements themselves.  Names of classes
and ids are weights, the share of a name's words that are template words, which lower
a branch's importance; only the sum cuts, so an article's own paragraph may be called
what it likes.  Where the tree knows no main branch (or it lies around or beside an
article), the article, else the main element, else the body, gives the text.

Edge cases: null or empty html gives an empty text; a quote opens an attribute's value
only right after "=", and <!--> is a whole comment, as in the standard; text without tags is one
block; unclosed, misnested and truncated tags are repaired; broken character
references stay as they are; a host with fewer than LEAST_PAGES pages is pruned
by the priors alone; repeated pages count as pages; html of any length is read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

DECAY, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.3, 8
#: Importance of a branch that the tree doesn't know, in and outside of article and main elements.
ARTICLE_PRIOR, PAGE_PRIOR = 1.0, 0.75
#: Weight of a name of which half is a template word that means nothing else.
STRONG = 0.8
#: Share of a host's weight that its main branch holds, and of a branch's text that is its own where it is no container.
MAIN_SHARE, OWN_SHARE = 0.5, 0.5
#: Kinds of marked branches.
LOW, MAIN, SOUND = KINDS = range(3)
#: Deepest nesting told apart; what lies deeper belongs to the node at this depth.
DEPTH = 40
#: Statistics a task gathers before it passes them on.
GATHERED = 200_000
#: Low branches that are broadcast as 8-byte hashes (8 MB); beyond it they are joined to their pages.
BROADCAST_BRANCHES = 1_000_000

# Element and role names by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NO_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video select option button input textarea label fieldset legend title xmp noembed noframes dialog menu map".split())
TEMPLATE_TAGS = frozenset("nav header footer aside form".split())
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist directory note".split())
TEMPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promotion promos "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc toolbar topbar skip skiplink "
    "header masthead footer colophon legal copyright "
    "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular teaser teasers "
    "notice notices cookie cookies consent gdpr alert alerts popup modal overlay paywall newsletter subscribe subscription signup login disclaimer "
    "comment comments commentlist reply replies respond disqus discussion "
    "share sharing social follow form search searchbox".split()
)
#: Those of them that an article's own parts may well be called.
AMBIGUOUS_WORDS = frozenset("ad banner promotion header copyright legal aside widget trending popular notice notices cookie alert alerts overlay disclaimer comment reply replies discussion follow form search social skip".split())
MAIN_WORDS = frozenset("article articlebody story post entry content main maincontent".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table body html div article section".split())

#: Attributes as the standard reads them: a quote opens a value only right after "="; one that isn't closed is part of the value.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_TAG = re.compile(rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("attributes", "children", "parent", "path", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.path = tag, parent, [], ""
        self.attributes = {}
        for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
            quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
            self.attributes.setdefault(name.lower(), html_entities.unescape(value[1:-1] if quoted else value))


def parse(source: str) -> Node:
    """The element tree; children are nodes and strings (character references decoded)."""
    root = here = Node("html", None)
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            here.children.append(html_entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body") and here.tag in ("html", "head", "body"):
            here = root if tag == "html" or here.tag != "body" else here
            if tag == "html" or any(isinstance(c, Node) and c.tag == "body" for c in root.children):
                continue
        if tag in BLOCK:
            node = here
            while node is not None and node.tag not in SCOPE:
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        if tag in ("article", "main"):  # an unclosed menu doesn't hold the article
            node = here
            while node is not None and node.tag not in ("nav", "header", "footer"):
                node = node.parent
            if node is not None:
                here = node.parent
        if tag in CLOSED_BY:
            node, found = here, None
            while node is not None and node.tag not in ("ul", "ol", "dl", "table"):
                if node.tag in CLOSED_BY[tag]:
                    found = node
                node = node.parent
            if found is not None:
                here = found.parent
        child = Node(tag, here, m[3])
        here.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            child.children.append(source[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            here = child
    return root


def _names(node: Node) -> list[str]:
    return f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split() if node.attributes else []


def _label(node: Node) -> str:
    names = sorted({re.sub(r"\d+", "0", c) for c in node.attributes.get("class", "").split()}) if node.attributes else []
    return node.tag + "".join(f".{c.replace('/', '')}" for c in names)


def set_paths(root: Node) -> list[Node]:
    """Gives each node its path; all nodes, parents first."""
    root.path, out, depth = root.tag, [root], {id(root): 1}
    for node in out:
        d = depth[id(node)]
        for c in node.children:
            if isinstance(c, Node):
                c.path = f"{node.path}/{_label(c)}" if d < DEPTH else node.path
                depth[id(c)] = d + 1
                out.append(c)
    return out


def _has(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        for c in x.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    return True
                todo.append(c)
    return False


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        else:
            todo += x.children
    return False


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    node = node.parent
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def name_weight(names: list[str]) -> float:
    """How far names say that a branch belongs to the site, 0 to 1: the share of a name's words that do, STRONG at least if one of two words is unambiguous."""

    def weight(words: list[str]) -> float:
        share = sum(w in TEMPLATE_WORDS for w in words) / len(words)
        return max(share, STRONG) if len(words) <= 2 and any(w in TEMPLATE_WORDS - AMBIGUOUS_WORDS for w in words) else share

    return max((weight(words) for words in ([w.lower() for w in _WORDS.findall(n)] for n in names) if words), default=0.0)


def is_template(node: Node) -> bool:
    """Whether the kind of an element, its role, or that it isn't shown says that this branch belongs to the site, not to the article."""
    tag, attributes = node.tag, node.attributes
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in NO_TEXT:
        return True
    if attributes and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)):
        return True
    if tag == "header" and _inside(node, ("article", "main")) and _has(node, ("h1", "h2")):
        return False
    if tag in TEMPLATE_TAGS or attributes and attributes.get("role", "").lower() in TEMPLATE_ROLES:
        return not _has(node, ("article", "main"))
    return False


def is_low_by_name(node: Node, sound: bool) -> bool:
    """Whether its names put a branch below LEAST_IMPORTANCE, which the tree doesn't know, or (sound) found important enough in spite of its class names."""
    if node.tag in ("html", "body", "article", "main") or not node.attributes:
        return False
    weight = name_weight(node.attributes.get("id", "").split() if sound else _names(node))
    if weight == 0 or _has(node, ("article", "main")):
        return False
    if {w.lower() for name in _names(node) for w in _WORDS.findall(name)} & TEMPLATE_WORDS == {"header"} and _has(node, ("h1",)):
        return False
    unknown = ARTICLE_PRIOR if sound or _inside(node, ("article", "main")) else PAGE_PRIOR
    return unknown - weight < LEAST_IMPORTANCE


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def page_statistics(host: str, source: str) -> dict[tuple[str, str, int, int], int]:
    """What a page adds to its host's tree, by (host, path, kind, hash).

    Kinds: 0 it has the node, 1 a sequence of children, 2 a content (each once a
    page); 3 characters of the node's own text, 4 of those in links.  Text that no
    reader sees (scripts and the like) has no characters.
    """
    out: dict[tuple[str, str, int, int], int] = {}
    linked, unseen = set(), set()
    for node in set_paths(parse(source)):
        above = id(node.parent) if node.parent is not None else None
        if node.tag == "a" or above in linked:
            linked.add(id(node))
        if node.tag in NO_TEXT or above in unseen:
            unseen.add(id(node))
        out[host, node.path, 0, 0] = 1
        out[host, node.path, 1, _hash(*(c.tag for c in node.children if isinstance(c, Node)))] = 1
        if text := _own_text(node):
            out[host, node.path, 2, _hash(text)] = 1
            if id(node) not in unseen:
                key = (host, node.path, 4 if id(node) in linked else 3, 0)
                out[key] = out.get(key, 0) + len(text)
        for name in ("href", "src"):
            if name in node.attributes:
                out[host, node.path, 2, _hash(name, node.attributes[name])] = 1
    return out


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees: host, path, pages, node_importance, own (unlinked characters of the node), and of its branch importance, chars, linked; pages has url and html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "path", "kind", "feature", "n"]
        seen: Counter = Counter()
        for batch in batches:
            for url, source in zip(batch["url"], batch["html"]):
                seen.update(page_statistics(host_of(url), source))
                if len(seen) > GATHERED:
                    yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=names)
                    seen.clear()
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=names)

    found = pages.select("url", "html").mapInPandas(run, "host string, path string, kind int, feature long, n long")
    features = found.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    nodes = features.groupBy("host", "path").agg(
        F.max(of(0, F.col("n"))).alias("pages"),
        (F.log(F.sum(of(1, F.col("n")))) - F.sum(of(1, F.col("n") * F.log("n"))) / F.sum(of(1, F.col("n")))).alias("presentation"),
        F.avg(of(2, F.log("n"))).alias("content"),
        F.coalesce(F.sum(of(3, F.col("n"))), F.lit(0)).alias("own"),
        F.coalesce(F.sum(of(4, F.col("n"))), F.lit(0)).alias("own_linked"),
    )
    base = F.log("pages")
    importance = F.when(F.col("pages") < 2, 1.0).when(F.col("content").isNotNull(), 1 - F.col("content") / base).otherwise(F.col("presentation") / base)
    nodes = stored(nodes.withColumn("node_importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance))), "style-nodes")
    upward = nodes.select("host", "node_importance", "pages", "own", "own_linked", F.split("path", "/").alias("steps")).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth")
    )
    weight = F.pow(F.lit(DECAY), F.size("steps") - F.col("depth")) * F.col("pages")
    branch = upward.groupBy("host", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/").alias("path")).agg(
        (F.sum(weight * F.col("node_importance")) / F.sum(weight)).alias("importance"), F.sum("own").alias("chars"), F.sum("own_linked").alias("linked")
    )
    return nodes.join(branch, ["host", "path"]).select("host", "path", "pages", "node_importance", "own", "importance", "chars", "linked")


def main_branches(tree: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and path of each host's main branch, where it has one.

    A branch is followed if it weighs most among its siblings, as do all branches
    above it, and if most of its text stands in branches below it.
    """
    weighed = tree.withColumn("weight", F.col("chars") * F.col("importance")).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    heaviest = weighed.filter(F.col("path") != F.col("parent")).groupBy("host", "parent").agg(F.max(F.struct("weight", "path")).alias("best"))
    steps = heaviest.select("host", F.col("best.path").alias("path")).unionByName(weighed.filter(F.col("path") == F.col("parent")).select("host", "path"))
    containers = weighed.filter(F.col("own") < OWN_SHARE * F.col("chars")).select("host", "path", "pages", "weight")
    steps = steps.join(containers, ["host", "path"]).withColumn("depth", F.size(F.split("path", "/")))
    # All branches above a followed one are followed: as many of its beginnings are steps as it has levels.
    above = steps.select("host", "pages", "weight", F.col("path").alias("of"), "depth", F.expr("explode(transform(sequence(1, depth), d -> substring_index(path, '/', d)))").alias("path"))
    followed = above.join(steps.select("host", "path"), ["host", "path"]).groupBy("host", F.col("of").alias("path"), "depth", "pages", "weight").count().filter("count = depth")
    whole = weighed.filter(F.col("path") == F.col("parent")).groupBy("host").agg(F.sum("weight").alias("whole"))
    kept = followed.join(whole, "host").filter((F.col("weight") >= MAIN_SHARE * F.col("whole")) & (F.col("pages") >= least_pages) & (F.col("depth") > 1))
    return kept.groupBy("host").agg(F.max_by("path", "depth").alias("path"))


def low_branches(tree: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, priors: bool = True) -> DataFrame:
    """host, path and kind of the branches to cut (LOW) and of those that are important in spite of their names (SOUND).

    Class names lower a branch's importance by their weight, and only the sum cuts.
    Article and main elements (not what is in them) and the page's own elements have
    the prior 1 and stay.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(weight=[name_weight(p.rsplit("/", 1)[-1].split(".")[1:]) for p in batch["path"]])

    prior = F.col("path").rlike(r"(^|/)(article|main)(\.[^/]*)?$|^html(/(body|head)(\.[^/]*)?)?$")
    known = tree.filter((F.col("pages") >= least_pages) & ~prior).select("host", "path", "importance")
    weighed = known.mapInPandas(weigh, "host string, path string, importance double, weight double") if priors else known.withColumn("weight", F.lit(0.0))
    low = F.col("importance") - F.col("weight") < least
    return weighed.filter(low | (F.col("weight") > 0)).select("host", "path", F.when(low, LOW).otherwise(SOUND).alias("kind"))


def extract(source: str | None, low=lambda path: False, main=lambda path: False, sound=lambda path: False, priors: bool = True) -> str:
    """The main text of one page; low tells which paths the tree found unimportant, main which is the host's main branch, sound which are important in spite of their names.

    Without priors names of elements and classes tell nothing but what is no text at all.
    """
    if not source:
        return ""
    root = parse(source)
    nodes = set_paths(root)
    cut = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in cut or (is_template(node) or is_low_by_name(node, sound(node.path)) if priors else node.tag in NO_TEXT) or node.parent is not None and low(node.path) and _has_text(node) and not _has(node, ("article", "main", "h1")):
            cut.add(id(node))

    def outermost(accept) -> list[Node]:
        got: list[Node] = []
        inside = set()
        for node in nodes:
            if id(node) in cut:
                continue
            if node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
            elif accept(node):
                got.append(node)
                inside.add(id(node))
        return got

    def named(node: Node) -> bool:
        return node.tag in ("div", "section", "td") and any({w.lower() for w in _WORDS.findall(name)} & MAIN_WORDS for name in _names(node))

    def by_tree(node: Node) -> bool:
        """The main branch, unless names say that the article is a part of it or another branch."""
        return main(node.path) and not (priors and node.tag not in ("article", "main") and any(x.tag == "article" for x in nodes if id(x) not in cut))

    tops_found = (outermost(by_tree) or outermost(lambda x: x.tag == "article" or x.attributes.get("itemprop") == "articleBody" or x.attributes.get("role") == "article")
        or outermost(lambda x: x.tag == "main" or x.attributes.get("role") == "main") or outermost(named)) if priors else outermost(by_tree)
    tops = tops_found or [root]
    blocks: list[str] = []
    for top in tops:
        now: list[str] = []

        def end() -> None:
            if text := " ".join("".join(now).split()):
                blocks.append(text)
            now.clear()

        todo: list = [top]
        while todo:  # depth first without recursion; None ends a block
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif id(x) not in cut:
                if x.tag == "br":
                    now.append(" ")
                    continue
                if x.tag in BLOCK:
                    end()
                    todo.append(None)
                todo += reversed(x.children)
        end()
    return "\n".join(blocks)


def marked_branches(pages: DataFrame, priors: bool = True) -> DataFrame:
    """host, path, kind: LOW branches, which are cut, the MAIN branches of the hosts, SOUND ones."""
    tree = stored(style_tree(pages), "style-tree")
    marks = low_branches(tree, priors=priors).unionByName(main_branches(tree).withColumn("kind", F.lit(MAIN)))
    return stored(marks, "style-marks")


def main_texts(pages: DataFrame, priors: bool = True, tree: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html); without priors or tree for comparison."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marks = marked_branches(pages, priors) if tree else spark.createDataFrame([], "host string, path string, kind int")
    count = marks.count()

    def texts(batches: Iterator[pd.DataFrame], known: tuple[frozenset, ...] | None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            own = batch["marks"] if "marks" in batch else [None] * len(batch)
            for url, source, mine in zip(batch["url"], batch["html"], own):
                host = host_of(url)
                if known is None:
                    tests = [{m["path"] for m in (mine if mine is not None else ()) if m["kind"] == kind}.__contains__ for kind in KINDS]
                else:
                    tests = [(lambda p, of=of: _hash(host, p) in of) if of else (lambda p: False) for of in known]
                out.append(extract(source, *tests, priors))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": np.array([len(t) for t in out], np.int64)})

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if count <= BROADCAST_BRANCHES:

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"hash": np.array([_hash(h, p) for h, p in zip(batch["host"], batch["path"])], np.int64), "kind": batch["kind"]})

        numbers = marks.mapInPandas(hashed, "hash long, kind int").toPandas()  # 12 bytes a branch
        hashes = spark.sparkContext.broadcast(tuple(frozenset(numbers["hash"][numbers["kind"] == kind]) for kind in KINDS))
        return pages.mapInPandas(lambda batches: texts(batches, hashes.value), schema)

    def own_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, host_of(u), p) for i, u, s in zip(batch["row"], batch["url"], batch["html"]) for p in {n.path for n in set_paths(parse(s))}]
            yield pd.DataFrame(rows, columns=["row", "host", "path"])

    keyed = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))
    mine = keyed.mapInPandas(own_paths, "row long, host string, path string").distinct().join(marks, ["host", "path"]).groupBy("row").agg(F.collect_set(F.struct("path", "kind")).alias("marks"))
    return keyed.join(mine, "row", "left").drop("row").mapInPandas(lambda batches: texts(batches, None), schema)


def op2_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
