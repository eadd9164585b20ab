"""Scores over probe results that a crawl brings as columns: certificates, DNS records, headers, index states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Index states as the search console names them, their priority (none: fine) and what they mean.
INDEX_STATES = {
    "submitted and indexed": None, "indexed, not submitted in sitemap": None, "page with redirect": None, "discovered - currently not indexed": "P1", "crawled - currently not indexed": "P1", "duplicate without user-selected canonical": "P2",
    "duplicate, google chose different canonical than user": "P2", "excluded by 'noindex' tag": "P2", "blocked by robots.txt": "P1", "soft 404": "P1", "not found (404)": "P2", "blocked due to unauthorized request (401)": "P2", "crawl anomaly": "P2",
}


def _record(records: Column, start: str) -> Column:
    """The first TXT record that begins so, without quotes."""
    bare = F.transform(F.coalesce(records, F.array().cast("array<string>")), lambda r: F.trim(r, F.lit('" ')))
    return F.get(F.filter(bare, lambda r: F.lower(r).startswith(start)), F.lit(0))


def spf(records: Column) -> Column:
    return _record(records, "v=spf1")


def dmarc_policy(records: Column) -> Column:
    """none, quarantine, reject as written; null without a record.  The first p= counts, sp= included."""
    found = _record(records, "v=dmarc1")
    policy = F.lower(F.regexp_extract(found, r"(?i)p\s*=\s*(\w+)", 1))
    return F.when(found.isNotNull(), F.when(policy == "", "none").otherwise(policy))


def dkim(records: Column) -> Column:
    return F.exists(F.coalesce(records, F.array().cast("array<string>")), lambda r: F.lower(r).rlike("dkim|k=|p="))


def email_score(spf_records: Column, dkim_records: Column, dmarc_records: Column, has_form: Column) -> Column:
    policy = dmarc_policy(dmarc_records)
    return F.when(spf(spf_records).isNotNull(), 30).otherwise(0) + F.when(dkim(dkim_records), 30).otherwise(0) + F.when(policy == "reject", 30).when(policy == "quarantine", 20).when(policy.isNotNull(), 10).otherwise(0) + F.when(has_form, 10).otherwise(0)


def cdn(headers: Column) -> Column:
    """The network that serves a page, by its response headers (a map with lower-case keys), in order of precedence."""
    h = lambda k: F.coalesce(F.lower(F.element_at(headers, k)), F.lit(""))
    return (
        F.when((h("cf-ray") != "") | F.contains(h("server"), F.lit("cloudflare")), "Cloudflare").when((h("x-amz-cf-id") != "") | F.contains(h("via"), F.lit("cloudfront")), "CloudFront")
        .when((h("x-fastly-request-id") != "") | F.contains(h("x-served-by"), F.lit("cache-")), "Fastly").when((h("x-akamai-transformed") != "") | F.contains(h("server"), F.lit("akamai")), "Akamai").when(h("x-cdn") != "", h("x-cdn"))
    )


def days_left(expires: Column, as_of: Column) -> Column:
    """Whole days from as_of to a certificate's end, written like "Jun  1 12:00:00 2025 GMT"."""
    end = F.try_to_timestamp(F.regexp_replace(expires, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy z"))
    return F.datediff(end, as_of)


def infrastructure_score(valid: Column, days: Column, dnssec: Column, caa: Column, has_cdn: Column, http2: Column) -> Column:
    each = [(valid, 25), (valid & (days > 30), 15), (dnssec, 15), (caa, 15), (has_cdn, 15), (http2, 15)]
    return sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in each[1:]), F.when(F.coalesce(each[0][0], F.lit(False)), each[0][1]).otherwise(0))


def index_coverage(inspections: DataFrame) -> DataFrame:
    """state, priority, urls of url inspections (coverageState); fine states have no priority, unknown ones P3."""
    state = F.lower(F.trim("coverageState"))
    known = F.create_map(*[F.lit(x) for k, v in INDEX_STATES.items() for x in (k, v or "")])
    priority = F.coalesce(F.try_element_at(known, F.col("state")), F.lit("P3"))
    counted = inspections.groupBy(state.alias("state")).agg(F.count("*").alias("urls"))
    return counted.select("state", F.when(priority != "", priority).alias("priority"), "urls")


def enhancement_errors(bundles: DataFrame) -> DataFrame:
    """type, errors over all bundles (enhancements: map of type to struct with errors)."""
    return bundles.select(F.explode("enhancements").alias("type", "e")).groupBy("type").agg(F.sum("e.errors").alias("errors"))
