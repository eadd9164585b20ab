"""Content roadmap: queries grouped into topics in order of impressions, and what to do about each topic.

Grouping is sequential by definition (a topic's terms grow as queries join it), so
it runs in one task over at most MOST_QUERIES rows, the operator's own cap.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

MOST_QUERIES, JOIN_AT, DECAY, LISTED = 5000, 0.5, 0.4, 8


def group_by_terms(terms: Iterable[Iterable[str]], join_at: float = JOIN_AT) -> list[int]:
    """The topic of each query in order, -1 without terms: the first topic with enough Jaccard similarity, else a new one."""
    topics: list[set[str]] = []
    out = []
    for own in map(set, terms):
        if not own:
            out.append(-1)
            continue
        for k, topic in enumerate(topics):
            if len(topic & own) >= join_at * len(topic | own):
                topic |= own
                out.append(k)
                break
        else:
            topics.append(set(own))
            out.append(len(topics) - 1)
    return out


def clusters(rows: DataFrame, brand: list[str] | None = None, most: int = MOST_QUERIES) -> DataFrame:
    """The most shown queries (query, page, clicks, impressions, position, ordinal) with topic and place."""
    top = rows.orderBy(F.desc("impressions"), "ordinal").limit(most)
    own = F.array_except(text.stemmed_terms(F.col("query")), F.array(*map(F.lit, brand or [""])))
    top = top.select("query", "page", "clicks", "impressions", "position", "ordinal", own.alias("terms"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["impressions", "ordinal"], ascending=[False, True])
        return pdf.assign(topic=group_by_terms(pdf["terms"]), place=range(len(pdf))).drop(columns=["terms", "ordinal", "one"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in top.schema if f.name not in ("terms", "ordinal"))
    return top.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, f"{schema}, topic int, place int").filter("topic >= 0")


def roadmap(clustered: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """label, action, impressions, clicks, avg_position, queries, pages of each topic; previous has label and clicks."""
    by_page = clustered.filter(F.coalesce("page", F.lit("")) != "").groupBy("topic", "page").agg(F.sum("impressions").alias("shown"), F.min("place").alias("first"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("shown"), "first"))
    pages = by_page.withColumn("place", place).filter("place <= 3").groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("place", "page", "shown"))).alias("p"))
    named = clustered.groupBy("topic", "query").agg(F.min("place").alias("place")).withColumn("at", F.row_number().over(Window.partitionBy("topic").orderBy("place"))).filter(F.col("at") <= LISTED)
    queries = named.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "query"))), lambda s: s["query"]).alias("queries"))
    sums = clustered.groupBy("topic").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum(F.col("position") * F.col("impressions")).alias("weight"), F.min_by("query", "place").alias("label"))
    out = sums.join(queries, "topic").join(pages, "topic", "left")
    before = F.lit(None).cast("double")
    if previous is not None:
        out = out.join(previous.select("label", F.col("clicks").alias("before")), "label", "left")
        before = F.col("before")
    position = F.coalesce(F.try_divide(F.col("weight"), F.col("impressions")), F.lit(0.0))
    second = F.get("p", F.lit(1))["shown"]
    action = (
        F.when((before > 20) & (F.col("clicks") < before * (1 - DECAY)), "refresh")
        .when(F.coalesce(second >= F.col("impressions") * 0.2, F.lit(False)), "consolidate")
        .when(F.col("p").isNull(), "create")
        .when((position > 0) & (position <= 4.5), "defend")
        .when(position <= 20, "optimise")
        .otherwise("rework")
    )
    listed = F.coalesce(F.transform("p", lambda s: s["page"]), F.array().cast("array<string>"))
    return out.select("label", action.alias("action"), "impressions", "clicks", F.bround(position, 1).alias("avg_position"), "queries", listed.alias("pages"))


def infer_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Gives rows without a page the page (url, title) that shares most terms with the query, if it shares two or all of them.

    A term that several pages of one url offer counts once for each; ties go to the least
    url.  Texts repeat, so each set of terms is compared once, however many queries ask
    it, with the least url of those that offer the same.  Rows aren't filtered by their
    page: where they come from a join, such a filter would become its condition.
    """
    none = F.coalesce("page", F.lit("")) == ""
    own = rows.withColumn("_terms", text.stemmed_terms(F.col("query")))
    asked = own.groupBy("_terms").agg(F.bool_or(none).alias("_bare")).filter("_bare").select("_terms", F.explode("_terms").alias("term"))
    terms = text.stemmed_terms(F.concat_ws(" ", F.replace(urls.path(F.col("url")), F.lit("-"), F.lit(" ")), "title"))
    by_url = pages.select("url", F.explode(terms).alias("term")).groupBy("url", "term").agg(F.count("*").alias("times"))
    alike = by_url.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("offer")).groupBy("offer").agg(F.min("url").alias("url"))
    shared = asked.join(alike.select("url", F.explode("offer").alias("o")).select("url", "o.*"), "term").groupBy("_terms", "url").agg(F.sum("times").alias("n"))
    best = shared.groupBy("_terms").agg(F.min(F.struct((-F.col("n")).alias("minus"), "url")).alias("b")).select("_terms", F.col("b.url").alias("_found"), (-F.col("b.minus")).alias("_n"))
    good = best.filter((F.col("_n") >= 2) | (F.col("_n") == F.size("_terms"))).select("_terms", "_found")
    found = own.join(good, "_terms", "left").withColumn("inferred", none & F.col("_found").isNotNull()).withColumn("page", F.when(F.col("inferred"), F.col("_found")).otherwise(F.col("page")))
    return found.select(*rows.columns, "inferred")
