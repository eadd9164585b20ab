"""Search and landing-page exports of several shapes, made into fixed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What exports call their columns, the first that is there counts.
QUERY_COLUMNS = ("top queries", "query", "queries")
PAGE_COLUMNS = ("landing page + query string", "landing page", "page path", "page")
RATE_COLUMNS = ("engagement rate", "engaged sessions rate")
CONVERSION_COLUMNS = ("key events", "conversions", "conversion events")
KEPT = 5000

_ROW = "struct<query:string,page:string,keys:array<string>,clicks:string,impressions:string,ctr:string,position:string>"


def number(text: Column) -> Column:
    """1,234 and 3.4% as numbers; 0 for anything else."""
    bare = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("0")), "[,%]", ""))
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def click_rate(ctr: Column, clicks: Column, impressions: Column) -> Column:
    """A rate written as fraction, as percent or not at all."""
    s = F.trim(ctr.cast("string"))
    v = F.rtrim(s, F.lit("%")).try_cast("double")
    return F.coalesce(F.when(s.endswith("%") | (v > 1), v / 100).otherwise(v), F.try_divide(clicks, impressions), F.lit(0.0))


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that a header has, whatever its case and blanks; null without one."""
    by_name = {c.strip().lower().lstrip("\ufeff"): c for c in reversed(df.columns)}
    return next((F.col(f"`{by_name[n]}`") for n in names if n in by_name), F.lit(None).cast("string"))


def search_json(documents: DataFrame) -> DataFrame:
    """query, page, clicks, impressions, ctr, position of JSON documents (column json): a list of rows, or rows or data in an object, with names or keys."""
    j = F.col("json")
    rows = F.coalesce(F.when(F.ltrim(j).startswith("["), F.from_json(j, f"array<{_ROW}>")), F.from_json(F.get_json_object(j, "$.rows"), f"array<{_ROW}>"), F.from_json(F.get_json_object(j, "$.data"), f"array<{_ROW}>"))
    r = documents.select(F.explode(rows).alias("r")).filter("r is not null").select("r.*")
    clicks, shown = number(F.col("clicks")), number(F.col("impressions"))
    by_key = F.col("query").isNull()
    return r.select(
        F.coalesce("query", F.get("keys", F.lit(0)), F.lit("")).alias("query"), F.coalesce(F.when(by_key, F.coalesce(F.get("keys", F.lit(1)), F.col("page"))).otherwise(F.col("page")), F.lit("")).alias("page"),
        clicks.alias("clicks"), shown.alias("impressions"), click_rate(F.col("ctr"), clicks, shown).alias("ctr"), F.col("position").try_cast("double").alias("position"),
    )


def search_csv(spark: SparkSession, path: str, most: int = KEPT) -> DataFrame:
    """The most shown queries of an export with a header row."""
    df = spark.read.csv(path, header=True)
    rows = df.select(F.trim(first_of(df, QUERY_COLUMNS)).alias("query"), F.coalesce(F.trim(first_of(df, ("page", "top pages"))), F.lit("")).alias("page"), *[number(first_of(df, (n,))).alias(n) for n in ("clicks", "impressions", "position")])
    return rows.filter(F.col("query") != "").orderBy(F.desc("impressions"), "query").limit(most)


def landing_csv(spark: SparkSession, path: str) -> DataFrame:
    """page, sessions, engagement_rate, conversions of an export whose header may follow lines that begin with #."""
    df = spark.read.csv(path, header=True, comment="#")
    page, rate = first_of(df, PAGE_COLUMNS), number(first_of(df, RATE_COLUMNS))
    rows = df.filter(page.isNotNull() & ~F.lower(page).isin("", "grand total"))
    return rows.select(
        F.substring_index(page, "?", 1).alias("page"), number(first_of(df, ("sessions",))).cast("long").alias("sessions"), F.bround(F.when(rate > 1, rate / 100).otherwise(rate), 3).alias("engagement_rate"),
        number(first_of(df, CONVERSION_COLUMNS)).cast("long").alias("conversions"),
    )


def semicolon_rows(lines: DataFrame) -> DataFrame:
    """Rows (as maps) of documents (column text) of semicolon-separated lines; a ragged row keeps what has a name."""
    split = F.transform(F.filter(F.split(F.trim("text"), r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, ";"))
    head = F.transform(F.get(split, F.lit(0)), F.trim)
    body = F.filter(F.transform(split, lambda r, i: F.when(i > 0, r)), lambda r: r.isNotNull())
    n = lambda r: F.least(F.size(head), F.size(r))
    return lines.select(F.explode(F.transform(body, lambda r: F.map_from_arrays(F.slice(head, F.lit(1), n(r)), F.transform(F.slice(r, F.lit(1), n(r)), F.trim)))).alias("row"))


def charset(raw: Column, header: Column) -> Column:
    """The character set of a page's bytes: mark, header, meta element of the first 4096 bytes, else utf-8."""
    start = F.decode(F.substring(raw, 1, 4096), "ISO-8859-1")
    meta = F.regexp_extract(start, r"""(?i)<meta[^>]+charset=["']?\s*([a-zA-Z0-9_-]+)""", 1)
    mark = F.hex(F.substring(raw, 1, 3))
    return F.when(mark == "EFBBBF", "utf-8").when(F.substring(mark, 1, 4).isin("FFFE", "FEFF"), "utf-16").when(F.coalesce(header, F.lit("")) != "", header).when(meta != "", F.lower(meta)).otherwise("utf-8")
