"""Site-wide checks over a crawl: pages (one row a URL) and links (a bag of edges)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import finding_id

SAMPLES, ROW_CAP = 8, 50
MODULE = "sitewide"


def _client_error() -> Column:
    return ~F.col("status").isin(403, 429)


def _failed() -> Column:
    return F.col("error").isNotNull() & ~F.col("error").ilike("blocked%")


def _moved() -> Column:
    return (F.col("status") >= 300) & (F.col("status") < 400)


def _slash_hop() -> Column:
    return F.col("redirect_to") == F.concat(F.col("url"), F.lit("/"))


def _target() -> Column:
    return F.concat(F.col("url"), F.lit("  ->  "), F.coalesce("redirect_to", F.lit("?")))


def _with(value: Column, unit: str) -> Column:
    return F.concat(F.col("url"), F.lit("  ("), value, F.lit(unit + ")"))


@dataclass(frozen=True)
class Check:
    key: str
    priority: str
    title: str
    why: str
    fix: str
    effort: str


# Keys, priorities and titles identify a finding from one run to the next.
CHECKS = (
    Check("server_5xx", "P0", "Server errors (5xx) found in crawl", "Pages that fail on the server can't be indexed.", "Read the server's logs for these routes and repair them.", "high"),
    Check("broken_internal_links", "P0", "Internal links point at broken pages", "Links into dead pages strand visitors and crawlers.", "Point each link at a live page, or bring the target back.", "medium"),
    Check("broken_4xx", "P1", "Broken pages (4xx) found in crawl", "Dead pages that can still be reached waste crawls.", "Bring the page back, redirect it, or drop the links to it.", "medium"),
    Check("fetch_errors", "P1", "Pages failed to fetch during crawl", "Content that times out is missing for some visitors.", "Look into the hosting of the URLs concerned.", "medium"),
    Check("duplicate_title", "P1", "Duplicate titles across pages", "Pages of one title compete with each other.", "Give every indexable page a title of its own.", "medium"),
    Check("duplicate_content", "P1", "Duplicate page content across URLs", "The same body at several URLs splits its ranking.", "Merge by canonical or redirect, or tell the pages apart.", "medium"),
    Check("duplicate_meta_desc", "P2", "Duplicate meta descriptions across pages", "Own descriptions are clicked more.", "Describe every indexable page in its own words.", "medium"),
    Check("orphan_pages", "P2", "Orphan pages (no inbound internal links)", "Nobody finds a page to which nothing links.", "Link to each from pages near it in topic.", "medium"),
    Check("thin_content", "P2", "Thin content pages across the site", "Very short pages seldom rank.", "Extend, merge or exclude them.", "high"),
    Check("slow_pages", "P2", "Slow server responses (>2s) in crawl", "Slow answers slow crawling down.", "Profile the slow routes.", "high"),
    Check("internal_redirects", "P3", "Internal links resolve through redirects", "Each hop costs a request.", "Link to where the redirect ends.", "low"),
    Check("sitemap_redirects", "P1", "Sitemap lists redirecting URLs", "A sitemap should hold final URLs only.", "Have its generator emit final URLs.", "low"),
    Check("sitemap_broken", "P1", "Sitemap lists broken URLs", "The sitemap asks for pages that don't exist.", "Have its generator emit URLs that resolve only.", "medium"),
)


def single_table() -> dict[str, tuple[Column, Column, Column]]:
    """Checks that one look at pages answers: which rows, how a sample reads, sample order."""
    url = F.col("url")
    first = F.lit(0)
    return {
        "server_5xx": (F.col("status") >= 500, url, first),
        "broken_4xx": ((F.col("status") >= 400) & (F.col("status") < 500) & _client_error(), url, first),
        "fetch_errors": (_failed(), _with(F.col("error"), ""), first),
        "thin_content": ((F.col("indexable") == 1) & (F.col("word_count") > 0) & (F.col("word_count") < 200), _with(F.col("word_count"), " words"), F.col("word_count")),
        "slow_pages": (F.col("response_ms") > 2000, _with(F.col("response_ms"), "ms"), -F.col("response_ms")),
        "sitemap_redirects": ((F.col("in_sitemap") == 1) & _moved(), _target(), first),
        "sitemap_broken": ((F.col("in_sitemap") == 1) & (((F.col("status") >= 400) & _client_error()) | _failed()), _with(F.coalesce(F.col("status").cast("string"), "error"), ""), first),
    }


DUPLICATES = {"duplicate_title": "title", "duplicate_content": "content_hash", "duplicate_meta_desc": "meta_desc"}


def duplicate_groups(pages: DataFrame, column: str) -> DataFrame:
    """value, copies of the indexable pages' values that occur more than once."""
    rows = pages.filter((F.col("indexable") == 1) & F.col(column).isNotNull() & ((F.col(column) != "") | F.lit(column == "content_hash")))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("copies")).filter("copies > 1")


def internal(links: DataFrame) -> DataFrame:
    return links.filter(F.col("type") == "internal")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """source, target of internal links into broken pages, a row for each link."""
    broken = pages.filter((F.col("status") >= 400) & _client_error()).select(F.col("url").alias("target"))
    return internal(links).join(broken, "target").select("source", "target")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    html = pages.filter((F.col("status") == 200) & (F.col("content_type") == "text/html"))
    return html.join(internal(links), F.col("url") == F.col("target"), "left_anti")


def linked_redirects(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.filter(_moved()).join(internal(links), F.col("url") == F.col("target"), "left_semi")


def affected(pages: DataFrame, links: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """key, count, slash_hops of every check, or of those named.  Single-table checks share one pass over pages."""
    wanted = lambda key: only is None or key in only
    rules = {k: r for k, r in single_table().items() if wanted(k)}
    none = F.lit(0).cast("long").alias("slash_hops")
    parts = []
    if rules:
        parts.append(_in_one_pass(pages, rules))
    for key, column in DUPLICATES.items():
        if wanted(key):
            parts.append(duplicate_groups(pages, column).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("count")).select(F.lit(key).alias("key"), "count", none))
    if wanted("broken_internal_links"):
        parts.append(broken_links(pages, links).agg(F.count("*").alias("count")).select(F.lit("broken_internal_links").alias("key"), "count", none))
    if wanted("orphan_pages"):
        parts.append(orphans(pages, links).agg(F.count("*").alias("count")).select(F.lit("orphan_pages").alias("key"), "count", none))
    if wanted("internal_redirects"):
        moved = linked_redirects(pages, links).agg(F.count("*").alias("count"), F.count_if(_slash_hop()).alias("slash_hops"))
        parts.append(moved.select(F.lit("internal_redirects").alias("key"), "count", "slash_hops"))
    return reduce(DataFrame.unionByName, parts)


def _in_one_pass(pages: DataFrame, rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    hops = F.count_if((F.col("in_sitemap") == 1) & _moved() & _slash_hop())
    one = pages.agg(*[F.count_if(rule).alias(k) for k, (rule, _, _) in rules.items()], hops.alias("hops"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("count"), (F.col("hops") if k == "sitemap_redirects" else F.lit(0).cast("long")).alias("slash_hops")) for k in rules])
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def samples(pages: DataFrame, links: DataFrame, most: int = SAMPLES) -> DataFrame:
    """key, place, sample: the first few examples of each check, in a stated order."""
    # One scan for the checks on pages alone: each row gives a sample to every check that it fails.
    hits = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(key).alias("key"), shown.alias("sample"), order.cast("long").alias("order"))) for key, (rule, shown, order) in single_table().items()]))
    parts = [pages.select(F.explode(hits).alias("h")).select("h.*")]
    for key, column in DUPLICATES.items():
        if key == "duplicate_content":
            # of a group the first few pages, and how many more there are: an error page may stand under a million addresses
            alike = pages.filter((F.col("indexable") == 1) & F.col(column).isNotNull())
            first = alike.withColumn("_k", F.row_number().over(Window.partitionBy(column).orderBy("url"))).filter(F.col("_k") <= most)
            shown = first.groupBy(column).agg(F.array_join(F.array_sort(F.collect_list("url")), "  =  ").alias("shown"))
            sizes = alike.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
            rows = sizes.join(shown, column).withColumn("sample", F.concat("shown", F.when(F.col("n") > most, F.concat(F.lit("  (+"), F.col("n") - most, F.lit(" more)"))).otherwise("")))
            parts.append(rows.select(F.lit(key).alias("key"), "sample", F.lit(0).cast("long").alias("order")))
        else:
            rows = duplicate_groups(pages, column)
            parts.append(rows.select(F.lit(key).alias("key"), F.concat("value", F.lit("  ("), "copies", F.lit(" pages)")).alias("sample"), (-F.col("copies")).alias("order")))
    zero = F.lit(0).cast("long").alias("order")
    parts.append(broken_links(pages, links).distinct().select(F.lit("broken_internal_links").alias("key"), F.concat("source", F.lit("  ->  "), "target").alias("sample"), zero))
    parts.append(orphans(pages, links).select(F.lit("orphan_pages").alias("key"), F.col("url").alias("sample"), zero))
    parts.append(linked_redirects(pages, links).select(F.lit("internal_redirects").alias("key"), _target().alias("sample"), zero))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = F.row_number().over(Window.partitionBy("key").orderBy("order", "sample"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("key", "place", "sample")


def findings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The findings of all checks that found something, by priority and then check order."""
    spark = pages.sparkSession
    known = spark.createDataFrame([(i, c.key, c.priority, c.title, c.why, c.fix, c.effort) for i, c in enumerate(CHECKS)], "ordinal int, key string, priority string, title string, why string, fix string, effort string")
    shown = samples(pages, links).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "sample"))).alias("s")).select("key", F.col("s.sample").alias("samples"))
    rows = affected(pages, links).filter("count > 0").join(F.broadcast(known), "key").join(shown, "key", "left")
    n = F.size("samples")
    text = F.concat(
        F.col("count"), F.lit(" affected. "), F.col("why"),
        F.when(F.col("slash_hops") > 0, F.concat(F.lit(" SYSTEMIC: "), "slash_hops", F.lit(" of "), "count", F.lit(" are pure trailing-slash hops."))).otherwise(F.lit("")),
        F.lit(" Examples: "), F.array_join("samples", "; "),
        F.when(F.col("count") > n, F.concat(F.lit(" (+"), F.col("count") - n, F.lit(" more)"))).otherwise(F.lit("")),
    )
    return rows.select("ordinal", "key", "priority", "title", text.alias("description"), "fix", "effort", F.lit(MODULE).alias("module"), "count", finding_id(F.lit(MODULE), F.col("title")).alias("id")).orderBy("priority", "ordinal")


def stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    p = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("indexable") == 1).alias("indexable"), F.count_if(F.col("in_sitemap") == 1).alias("in_sitemap"))
    return p.crossJoin(internal(links).agg(F.count("*").alias("internal_links")))  # one row by one row


def summary(pages: DataFrame) -> DataFrame:
    """status (text, "error" where there is none) and its pages."""
    return pages.groupBy(F.coalesce(F.col("status").cast("string"), F.lit("error")).alias("status")).agg(F.count("*").alias("pages"), F.coalesce(F.avg("response_ms"), F.lit(0)).cast("int").alias("avg_response_ms"))


def drill_down(spark: SparkSession, sql: str, cap: int = ROW_CAP) -> DataFrame:
    """One SELECT over temporary views, its first rows only; anything else is refused."""
    text = sql.strip()
    if not text.lower().startswith("select") or ";" in text.rstrip(";"):
        raise ValueError("one SELECT only")
    return spark.sql(text.rstrip(";")).limit(cap)
