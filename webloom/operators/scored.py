"""The scored document of a page: categories, overall grade, every module's result, all findings, in one VARIANT.

Modules may be built in or the user's own; one that failed on a page stands with its
error.  A page's modules and findings are gathered, of which there are at most as many
as there are modules and rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from . import detection, modules, report, usermodules

COUNTED = ("P0", "P1", "P2", "P3")


def evaluated(pages: DataFrame, ids: list[str], key: str = "page_id") -> DataFrame:
    """``modules.evaluate`` over built-in and user modules alike, with details and error."""
    own = [i for i in ids if i in usermodules.USER_MODULES]
    built_in = [i for i in ids if i not in own]
    parts = []
    if built_in:
        parts.append(modules.evaluate(pages, built_in, key).withColumn("details", F.parse_json(F.lit("null"))).withColumn("error", F.lit(None).cast("string")))
    if own:
        parts.append(usermodules.evaluate(pages, own, key))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def documents(pages: DataFrame, ids: list[str], key: str = "page_id") -> DataFrame:
    """key, document (VARIANT) of every page (key, url, html; beside them what modules may read)."""
    results = evaluated(pages, ids, key).filter("detected")
    categories = report.category_scores(report.analyse(pages)).select(key, "seo", "security", "security_assessed", "accessibility", "performance")
    entry = F.struct(F.col("module").alias("id"), F.col("total"), F.map_entries("points").alias("points"), F.transform("findings", lambda f: f.withField("module", F.col("module"))).alias("findings"), F.to_json("details").alias("details"), F.col("error"))
    # The findings that may cap the grade are counted where the results are gathered, so no module runs twice.
    blocking = [F.sum(F.when(F.col("module").isin(*detection.CAPPING), _count(F.col("findings"), p)).otherwise(0)).alias(p.lower()) for p in ("P0", "P1")]
    per_page = results.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("results"), *blocking)
    rows = detection.capped(categories.join(per_page, key, "left")).withColumn("results", F.coalesce("results", F.expr("array()").cast(per_page.schema["results"].dataType)))
    return rows.select(key, F.parse_json(_json(rows)).alias("document"))


def _json(rows: DataFrame) -> Column:
    """The document as text: structs of one shape by ``to_json``, modules of many shapes joined as they are."""
    c = F.col
    value = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'^\{"x":|\}$', "")
    result = lambda r: F.when(r["error"].isNotNull(), F.to_json(F.struct(r["error"].alias("error")))).otherwise(
        F.concat(F.lit('{"total":'), r["total"], F.lit(',"points":'), F.to_json(F.map_from_entries(r["points"])), F.lit(',"details":'), F.coalesce(r["details"], F.lit("null")), F.lit("}"))
    )
    scores = F.concat(F.lit("{"), F.array_join(F.transform("results", lambda r: F.concat(value(r["id"]), F.lit(":"), result(r))), ","), F.lit("}"))
    findings = F.flatten(F.transform("results", lambda r: r["findings"]))
    with_id = F.transform(findings, lambda f: F.struct(f["module"].alias("module"), f["priority"].alias("priority"), f["title"].alias("title"), finding_id(f["module"], f["title"]).alias("id")))
    order = F.array(*map(F.lit, COUNTED))
    place = lambda f: F.coalesce(F.nullif(F.array_position(order, f["priority"]), F.lit(0)), F.lit(9))
    listed = F.transform(F.array_sort(F.transform(with_id, lambda f: F.struct(place(f).alias("p"), f["module"].alias("m"), f["title"].alias("t"), f.alias("f")))), lambda x: x["f"])
    counts = F.struct(*[_count(findings, p).alias(p) for p in COUNTED])
    head = F.struct(
        F.struct(c("seo").alias("score")).alias("seo"), F.struct(c("security").alias("score"), c("security_assessed").alias("assessed")).alias("security"), F.struct(c("accessibility").alias("score")).alias("accessibility"), F.struct(c("performance").alias("score")).alias("performance"),
        F.struct(c("overall").alias("score"), c("grade"), c("cap_applied"), (F.size("results") > 0).alias("modules_scored")).alias("overall"), counts.alias("summary"), listed.alias("findings"),
    )
    return F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"module_scores":'), scores, F.lit("}"))


def _count(findings: Column, priority: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["priority"] == priority))


def part(path: str, kind: str, document: str = "document") -> Column:
    """A value of a document by its path."""
    return F.variant_get(F.col(document), path, kind)


def findings(documents_: DataFrame, key: str = "page_id") -> DataFrame:
    """key, module, priority, title, id of every finding in the documents."""
    listed = F.variant_get("document", "$.findings", "array<struct<module:string,priority:string,title:string,id:string>>")
    # An outer explode: for the other Spark adds a filter on the list, which makes every document once more.
    return documents_.select(key, F.explode_outer(listed).alias("f")).filter("f is not null").select(key, "f.*")
