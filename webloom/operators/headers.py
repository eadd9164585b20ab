"""Response headers (map<string,string>): the security score, findings on them, header-level noindex.

Header names are compared in lower case; of a name that stands twice the last
value counts.  A null or empty map means that no headers were seen: the security
category is then not assessed, rather than failed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of each header, and titles of what is missing.
POINTS = {"csp": 30, "hsts": 18, "x_content_type_options": 8, "x_frame_options": 8, "referrer_policy": 8, "permissions_policy": 13}
REPORT_ONLY, HSTS_BASE, HSTS_EACH = 13, 8, 5
MISSING = (
    ("content-security-policy", "P1", "Missing Content-Security-Policy header"),
    ("strict-transport-security", "P1", "Missing Strict-Transport-Security header"),
    ("x-frame-options", "P2", "Missing X-Frame-Options header"),
    ("referrer-policy", "P3", "Missing Referrer-Policy header"),
    ("permissions-policy", "P3", "Missing Permissions-Policy header"),
)


def seen(headers: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(headers)) > 0, F.lit(False))


def value(headers: Column, name: str) -> Column:
    """The header's value; null if it isn't there."""
    held = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(held, F.lit(-1))["value"]


def has(headers: Column, name: str) -> Column:
    return F.coalesce(F.exists(F.map_keys(headers), lambda k: F.lower(k) == name), F.lit(False))


def _text(headers: Column, name: str) -> Column:
    return F.lower(F.coalesce(value(headers, name), F.lit("")))


def security_points(headers: Column) -> dict[str, Column]:
    """Points for each header, 0 where it is missing."""
    hsts, csp = _text(headers, "strict-transport-security"), _text(headers, "content-security-policy")
    given = lambda condition, points: F.when(condition, points).otherwise(0)
    return {
        "csp": F.when(has(headers, "content-security-policy"), POINTS["csp"]).when(has(headers, "content-security-policy-report-only"), REPORT_ONLY).otherwise(0),
        "hsts": F.when(hsts != "", F.lit(HSTS_BASE) + given(F.contains(hsts, F.lit("includesubdomains")), HSTS_EACH) + given(F.contains(hsts, F.lit("preload")), HSTS_EACH)).otherwise(0),
        "x_content_type_options": given(_text(headers, "x-content-type-options") == "nosniff", POINTS["x_content_type_options"]),
        "x_frame_options": given(_text(headers, "x-frame-options").isin("deny", "sameorigin") | F.contains(csp, F.lit("frame-ancestors")), POINTS["x_frame_options"]),
        "referrer_policy": given(_text(headers, "referrer-policy") != "", POINTS["referrer_policy"]),
        "permissions_policy": given(has(headers, "permissions-policy"), POINTS["permissions_policy"]),
    }


def security_score(mixed_content: Column, blank: Column, blank_unsafe: Column, headers: Column) -> dict[str, Column]:
    """security (0-100) and security_assessed, from the page's signals and its headers."""
    safety = F.when((blank > 0) & (blank_unsafe > 0), F.bround((blank - blank_unsafe) / blank * 5).cast("int")).otherwise(5)
    page = F.when(mixed_content == 0, 10).otherwise(0) + safety
    parts = sum(security_points(headers).values(), F.lit(0))
    return {"security": F.least(F.when(seen(headers), page + parts).otherwise(page), F.lit(100)).cast("int"), "security_assessed": seen(headers)}


def for_module(headers: Column) -> tuple[dict[str, tuple[Column, int]], list[tuple[Column, str, str]]]:
    """Criteria and findings of the security module: presence of a header gives all its points."""
    flags = {
        "csp": has(headers, "content-security-policy"), "hsts": has(headers, "strict-transport-security"), "x_content_type_options": _text(headers, "x-content-type-options") == "nosniff",
        "x_frame_options": has(headers, "x-frame-options"), "referrer_policy": has(headers, "referrer-policy"), "permissions_policy": has(headers, "permissions-policy"),
    }
    return {k: (F.when(c, POINTS[k]).otherwise(0), POINTS[k]) for k, c in flags.items()}, [(seen(headers) & ~has(headers, name), priority, title) for name, priority, title in MISSING]


def noindex(headers: Column) -> tuple[dict[str, tuple[Column, int]], list[tuple[Column, str, str]]]:
    """Criterion and finding of the technical module on the X-Robots-Tag header."""
    said = F.contains(_text(headers, "x-robots-tag"), F.lit("noindex"))
    return {"indexability": (F.when(said, 0).otherwise(30), 30)}, [(said, "P0", "Header-level noindex (X-Robots-Tag)")]
