"""Link-graph operators: degrees, breadth-first plans, redirect chains, link gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.steps import written
from .rollups import soft_missing

# Paths of pages that sell and of pages that inform.
MONEY = r"/(services?|pricing|products?|shop|store|book|booking|quote|get-started|contact|packages?|plans?)(/|$)"
CONTENT = r"/(blog|guides?|resources?|news|articles?|learn|insights?)(/|$)"
MOST_HOPS = 10
#: Redirect targets that are broadcast (some 200 bytes each: 40 MB); salts of the join beyond it.
BROADCAST_TARGETS, TARGET_SALTS = 200_000, 16


def degrees(links: DataFrame) -> DataFrame:
    """url, out_links, in_links over internal links; a page with neither isn't listed."""
    inner = links.filter(F.col("type") == "internal")
    ends = F.explode(F.array(F.struct(F.col("source").alias("url"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("url"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    return inner.select(ends.alias("e")).groupBy("e.url").agg(F.sum("e.out").alias("out_links"), F.sum("e.into").alias("in_links"))


def depths(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """url, depth of what is reached from starts (url) in at most ``most`` steps; each level is one join against what is new, and is written before the next."""
    edges = written(links.filter(F.col("type") == "internal").select("source", "target").distinct(), "edges")
    reached = level = written(starts.select("url", F.lit(0).alias("depth")).distinct(), "level")
    for d in range(1, most + 1):
        ahead = level.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        level = written(ahead.join(reached.select("url"), "url", "left_anti").select("url", F.lit(d).alias("depth")), "level")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def redirect_chains(hops: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """Follows hops (url, status, redirect_to, and where there are such columns refresh_to and title) from every redirecting url.

    A page that answers 200 and names another in a meta refresh (refresh_to) is a
    hop as well.  start, hops, final_url, final_status (null if the chain leaves
    the table), path, statuses, loop, meta_refresh, soft_404 (a final 200 whose
    title says that the page isn't there).
    """
    optional = lambda name: F.col(name) if name in hops.columns else F.lit(None).cast("string")
    refresh = F.when(F.col("redirect_to").isNull() & (F.col("status") == 200), optional("refresh_to"))
    hops = hops.select("url", "status", F.coalesce("redirect_to", refresh).alias("redirect_to"), refresh.isNotNull().alias("refreshes"), F.coalesce(soft_missing(F.col("status"), optional("title")), F.lit(False)).alias("missing"))
    table = hops.select(F.col("url").alias("at"), F.col("status").alias("s"), F.col("redirect_to").alias("next"), F.col("refreshes").alias("r"), F.col("missing").alias("m"))
    leading = hops.filter(F.col("redirect_to").isNotNull())
    now = written(leading.select(
        F.col("url").alias("start"), F.array("url").alias("path"), F.array("status").alias("statuses"), F.col("redirect_to").alias("ahead"), F.lit(False).alias("loop"), F.col("refreshes").alias("meta_refresh"), F.col("missing").alias("soft_404")
    ), "chains")
    led_to = written(table.join(leading.select(F.col("redirect_to").alias("at")).distinct(), "at", "left_semi"), "redirect-targets")
    small = led_to.count() <= BROADCAST_TARGETS
    done = []
    for _ in range(most):  # only open chains go on; where they meet is looked up where they stand
        again = F.array_contains("path", F.col("ahead"))
        step = _at_targets(now, led_to, small).select(
            "start",
            F.when(again, F.col("path")).otherwise(F.concat("path", F.array("ahead"))).alias("path"),
            F.when(again, F.col("statuses")).otherwise(F.concat("statuses", F.array("s"))).alias("statuses"),
            F.when(~again, F.col("next")).alias("ahead"),
            again.alias("loop"),
            (F.col("meta_refresh") | (~again & F.coalesce("r", F.lit(False)))).alias("meta_refresh"),
            F.when(again, F.col("soft_404")).otherwise(F.coalesce("m", F.lit(False))).alias("soft_404"),
        )
        step = written(step, "chains")
        done.append(step.filter("ahead is null"))
        now = step.filter("ahead is not null")
        if now.isEmpty():
            break
    chains = union_all([*done, now])
    last = F.element_at("path", -1)
    return chains.select("start", (F.size("path") - 1).alias("hops"), last.alias("final_url"), F.element_at("statuses", -1).alias("final_status"), "path", "statuses", "loop", "meta_refresh", "soft_404")


def _at_targets(open_chains: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """open_chains with the hop at ``ahead``, null where it is outside the table; a page that many lead to is dealt over salts unless all fit into a broadcast."""
    if small:
        return open_chains.join(F.broadcast(targets), F.col("ahead") == F.col("at"), "left")
    salted = targets.withColumn("at_salt", F.explode(F.sequence(F.lit(0), F.lit(TARGET_SALTS - 1))))
    dealt = open_chains.withColumn("salt", F.pmod(F.xxhash64("start"), F.lit(TARGET_SALTS)).cast("int"))
    return dealt.join(salted, (F.col("ahead") == F.col("at")) & (F.col("salt") == F.col("at_salt")), "left")


def chain_issues(chains: DataFrame) -> DataFrame:
    """start, priority, issue of every chain worth a word."""
    early = F.slice("statuses", F.lit(1), F.greatest(F.size("statuses") - 1, F.lit(0)))
    rules = (
        (F.col("loop"), "P0", F.lit("Redirect loop")),
        (F.col("hops") >= 2, "P2", F.concat(F.lit("Redirect chain ("), "hops", F.lit(" hops)"))),
        (F.exists(early, lambda s: s.isin(302, 303, 307)), "P2", F.lit("Temporary redirect")),
        (F.col("meta_refresh"), "P2", F.lit("Meta-refresh redirect")),
        (F.col("soft_404"), "P1", F.lit("Soft 404")),
        (F.col("final_status") >= 400, "P1", F.concat(F.lit("Chain ends in HTTP "), "final_status")),
    )
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(p).alias("priority"), t.alias("issue"))) for rule, p, t in rules]))
    return chains.select("start", F.explode(found).alias("i")).select("start", "i.priority", "i.issue")


def page_kind(url: Column, money: str = MONEY, content: str = CONTENT) -> Column:
    p = urls.path(url)
    return F.when(p.rlike(f"(?i){money}"), "money").when(p.rlike(f"(?i){content}"), "content")


def link_gaps(pages: DataFrame, links: DataFrame, search: DataFrame, money: str = MONEY, content: str = CONTENT) -> DataFrame:
    """Content pages that link to no money page: url, impressions, top_queries, suggested_target.

    The suggested target shares most terms with the page's five best queries; terms
    are joined by equality, so nothing is compared pairwise.
    """
    html = pages.filter((F.col("status") == 200) & (F.col("content_type") == "text/html")).select("url", page_kind(F.col("url"), money, content).alias("kind"))
    target = html.filter("kind = 'money'").select(F.col("url").alias("target"))
    sells = links.filter(F.col("type") == "internal").join(target, "target").select(F.col("source").alias("url"))
    gaps = html.filter("kind = 'content'").select("url").distinct().join(sells, "url", "left_anti")
    rows = search.filter((F.col("page") != "") & (F.col("query") != "")).join(gaps, F.col("page") == F.col("url"), "left_semi")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("impressions"), "ordinal")))
    top = ranked.groupBy(F.col("page").alias("url")).agg(F.sum("impressions").alias("impressions"), F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "query")))), lambda s: s["query"]).alias("top_queries"))
    terms = ranked.filter("place <= 5").select(F.col("page").alias("url"), F.explode(text.link_terms(F.col("query"))).alias("term")).distinct()
    offers = target.select("target", F.explode(text.link_terms(urls.path(F.col("target")))).alias("term"))
    shared = terms.join(offers, "term").groupBy("url", "target").agg(F.count("*").alias("score"))
    best = shared.groupBy("url").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("best")).select("url", F.col("best.target").alias("best"))
    first = target.agg(F.min("target").alias("first"))
    out = gaps.join(top, "url", "left").join(best, "url", "left").crossJoin(first)  # first is one row
    return out.select(
        "url", F.coalesce("impressions", F.lit(0)).cast("long").alias("impressions"), F.array_join(F.coalesce("top_queries", F.array().cast("array<string>")), "; ").alias("top_queries"),
        F.when(F.col("impressions").isNull(), F.col("first")).otherwise(F.col("best")).alias("suggested_target"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
