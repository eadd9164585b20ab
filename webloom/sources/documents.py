"""Readers of JSON documents and small settings: scores, lab-speed reports, site lists, budgets, zipped exports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric names by audit, categories of a lab report.
SPEED_METRICS = {
    "FCP": "first-contentful-paint", "LCP": "largest-contentful-paint", "CLS": "cumulative-layout-shift", "INP": "interaction-to-next-paint", "FID": "max-potential-fid", "TTFB": "server-response-time", "speed_index": "speed-index", "total_blocking_time": "total-blocking-time",
}
LAB_VITALS = {"LCP": "largest-contentful-paint", "CLS": "cumulative-layout-shift", "INP": "experimental-interaction-to-next-paint", "FCP": "first-contentful-paint", "TTFB": "server-response-time"}
LAB_CATEGORIES = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo"}
METRIC = "struct<numericValue:double,displayValue:string,numericUnit:string>"


def unwrapped(document: Column) -> Column:
    """A scores document's JSON, out of its "report" key where it stands in one."""
    return F.coalesce(F.get_json_object(document, "$.report"), document)


FINDING = "struct<module:string,priority:string,title:string,description:string,fix:string,effort:string>"


def findings(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """key, module ("core"), priority ("P3"), title, description, fix, effort of a document's findings with a title."""
    listed = F.from_json(F.get_json_object(unwrapped(F.col(text)), "$.findings"), f"array<{FINDING}>")
    # An outer explode: for the other Spark adds a filter on the list, which reads every document once more.
    rows = documents.select(key, F.explode_outer(listed).alias("f")).filter("f is not null").select(key, "f.*").filter(F.coalesce("title", F.lit("")) != "")
    return rows.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("module", "core"), ("priority", "P3"), ("description", ""), ("fix", ""), ("effort", ""))})


def _percent(score: Column) -> Column:
    return F.bround(score.cast("double") * 100).cast("int")


def page_speed(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """key, url, strategy, performance (0-100), metrics (name -> value, display, unit), field (percentile, category by name), error of API answers."""
    d = F.col(text)
    value = lambda path: F.get_json_object(d, path)
    audits = F.from_json(value("$.lighthouseResult.audits"), f"map<string,{METRIC}>")
    metric = lambda audit: F.try_element_at(audits, F.lit(audit))
    parts = [x for name, audit in SPEED_METRICS.items() for x in (F.lit(name), F.struct(metric(audit)["numericValue"].alias("value"), metric(audit)["displayValue"].alias("display"), metric(audit)["numericUnit"].alias("unit")))]
    refused = value("$.error").isNotNull() & value("$.lighthouseResult").isNull()
    error = F.when(F.coalesce(d, F.lit("")).isin("", "{}", "null"), F.lit("Empty or invalid response")).when(refused, value("$.error"))
    return documents.select(
        key, value("$.id").alias("url"), F.coalesce(value("$.lighthouseResult.configSettings.formFactor"), value("$.lighthouseResult.configSettings.emulatedFormFactor")).alias("strategy"), _percent(value("$.lighthouseResult.categories.performance.score")).alias("performance"),
        F.create_map(*parts).alias("metrics"), F.from_json(value("$.loadingExperience.metrics"), "map<string,struct<percentile:double,category:string>>").alias("field"), error.alias("error"),
    )


def lab_report(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """key, url, version, a score (0-100) for each category and a value for each vital of lab reports."""
    d = F.col(text)
    scores = [_percent(F.get_json_object(d, f"$.categories['{c}'].score")).alias(name) for name, c in LAB_CATEGORIES.items()]
    vitals = [F.get_json_object(d, f"$.audits['{a}'].numericValue").cast("double").alias(name) for name, a in LAB_VITALS.items()]
    return documents.select(key, F.get_json_object(d, "$.requestedUrl").alias("url"), F.get_json_object(d, "$.lighthouseVersion").alias("version"), *scores, *vitals)


def sites(document: Column) -> Column:
    """array<struct<url, name>> of a site list's JSON; a site without a name is named by its url, one without a url is left out."""
    listed = F.from_json(document, "array<struct<url:string,name:string>>")
    return F.transform(F.filter(listed, lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: F.struct(s["url"].alias("url"), F.coalesce(s["name"], s["url"]).alias("name")))


def budget(path_or_text: str | None, default: dict[str, int]) -> tuple[dict[str, int], str | None]:
    """The default budget with a file's (or JSON text's) numbers over it, and a warning where it can't be read."""
    if not path_or_text:
        return dict(default), None
    try:
        if path_or_text.lstrip().startswith("{"):
            given = json.loads(path_or_text)
        else:
            with open(path_or_text, encoding="utf-8") as file:
                given = json.load(file)
        return default | {k: v for k, v in given.items() if k in default and isinstance(v, int | float) and not isinstance(v, bool)}, None
    except (OSError, ValueError, AttributeError) as e:
        return dict(default), f"the budget can't be read: {type(e).__name__}"


def zipped_csv(spark: SparkSession, paths: str, most_bytes: int = 1 << 30) -> DataFrame:
    """file, member, text of the CSV members of zip archives; archives are read where they are, a member that unpacks to over most_bytes is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for m in archive.infolist():
                        if m.filename.lower().endswith(".csv"):
                            if m.file_size > most_bytes:
                                raise ValueError(f"{m.filename} is too large")
                            yield pd.DataFrame({"file": [path], "member": [m.filename], "text": [archive.read(m).decode("utf-8-sig", "replace")]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, member string, text string")
