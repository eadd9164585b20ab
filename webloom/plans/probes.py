"""Queries over probe columns made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import probes
from ..sources.driver_views import table

STATES = ("Submitted and indexed", "Crawled - currently not indexed", "Soft 404", "Page with redirect", "Never heard of")


@query(
    "health_index_coverage",
    """SELECT lower(state) AS state, CASE lower(state) WHEN 'crawled - currently not indexed' THEN 'P1' WHEN 'soft 404' THEN 'P1' WHEN 'never heard of' THEN 'P3' END AS priority, count(*) AS urls
FROM (SELECT ['Submitted and indexed', 'Crawled - currently not indexed', 'Soft 404', 'Page with redirect', 'Never heard of'][page_id % 5 + 1] AS state FROM pages) GROUP BY 1, 2""",
)
def coverage(spark, sf_dir):
    states = F.array(*map(F.lit, STATES))
    return probes.index_coverage(table(spark, sf_dir, "pages").select(F.get(states, (F.col("page_id") % 5).cast("int")).alias("coverageState")))


@query("health_enhancements", "SELECT 'type' || (page_id % 3) AS type, CAST(sum(page_id % 4) AS BIGINT) AS errors FROM pages GROUP BY 1")
def enhancements(spark, sf_dir):
    one = F.create_map(F.concat(F.lit("type"), F.col("page_id") % 3), F.struct((F.col("page_id") % 4).alias("errors")))
    return probes.enhancement_errors(table(spark, sf_dir, "pages").select(one.alias("enhancements")))


@query(
    "mod_email_deliverability",
    """SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 30 ELSE 0 END + CASE s_suppkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 7 = 0 THEN 10 ELSE 0 END AS INT) AS total,
CASE s_suppkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'none' END AS policy FROM supplier""",
)
def email(spark, sf_dir):
    k = F.col("s_suppkey")
    txt = F.array(F.lit('"google-site=1"'), F.when(k % 2 == 0, '"V=spf1 include:x ~all"').otherwise("other"))
    key = F.when(k % 3 == 0, F.array(F.lit("k=rsa; p=MIG")))
    rule = F.array(F.when(k % 5 == 0, '"v=DMARC1; p = reject"').when(k % 5 == 1, "v=DMARC1; p=Quarantine; sp=none").when(k % 5 == 2, "v=DMARC1").otherwise("nothing"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", probes.email_score(txt, key, rule, k % 7 == 0).alias("total"), probes.dmarc_policy(rule).alias("policy"))


@query(
    "mod_dns_infra",
    """SELECT s_suppkey, CAST(CASE WHEN valid THEN 25 ELSE 0 END + CASE WHEN valid AND days > 30 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 4 <> 3 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 7 = 0 THEN 15 ELSE 0 END AS INT) AS total,
CASE s_suppkey % 4 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'CloudFront' WHEN 2 THEN 'acme' END AS cdn, CAST(days AS INT) AS days FROM (SELECT *, s_suppkey % 2 = 0 AS valid, date_diff('day', DATE '2024-06-01', DATE '2024-06-01' + CAST(s_suppkey % 28 + 10 AS INT)) AS days FROM supplier)""",
)
def dns(spark, sf_dir):
    k = F.col("s_suppkey")
    end = F.date_add(F.lit("2024-06-01").cast("date"), (k % 28 + 10).cast("int"))
    expires = F.concat(F.date_format(end, "MMM"), F.lit("  "), F.dayofmonth(end), F.lit(" 12:00:00 2024 GMT"))
    headers = F.when(k % 4 == 0, F.create_map(F.lit("cf-ray"), F.lit("x"))).when(k % 4 == 1, F.create_map(F.lit("via"), F.lit("1.1 CloudFront"))).when(k % 4 == 2, F.create_map(F.lit("x-cdn"), F.lit("acme"))).otherwise(F.create_map(F.lit("server"), F.lit("own")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", probes.cdn(headers).alias("cdn"), probes.days_left(expires, F.lit("2024-06-01").cast("date")).alias("days"))
    return rows.withColumn("total", probes.infrastructure_score(k % 2 == 0, F.col("days"), k % 3 == 0, k % 5 == 0, F.col("cdn").isNotNull(), k % 7 == 0))
