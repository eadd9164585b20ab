"""URL functions on columns; none of them raises on malformed input."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track, by name and by beginning.
TRACKING_PARAMS = ("gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "twclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "igshid", "vero_id", "vero_conv", "ref", "ref_src", "mkt_tok", "s_kwcid", "gbraid", "wbraid")
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "matomo_")

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _plus_encoded(text: Column) -> Column:
    return F.regexp_replace(F.url_encode(text), r"\*", "%2A")


def clean_query(q: Column) -> Column:
    """Drops tracking parameters, sorts the others by name and value and encodes them anew."""
    pairs = F.filter(F.split(q, "&"), lambda p: F.contains(p, F.lit("=")) | (p != ""))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )
    low = lambda p: F.lower(p["k"])
    tracked = lambda p: low(p).isin(*TRACKING_PARAMS) | low(p).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.array_sort(F.filter(decoded, lambda p: ~tracked(p)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_plus_encoded(p["k"]), F.lit("="), _plus_encoded(p["v"]))), "&")


def crawl_key(url: Column) -> Column:
    """The crawler's key: no fragment, tracking parameters or default port; null unless http or https."""
    s, host = scheme(url), netloc(url)
    host = F.when(s == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    q = clean_query(query(url))
    return F.when(s.isin("http", "https"), F.concat(s, F.lit("://"), host, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def plain_key(url: Column) -> Column:
    """The second normaliser: lower scheme and host, no trailing slash but at the root, query kept, no fragment."""
    p = path(url)
    p = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), netloc(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def registered_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def in_scope(url: Column, start_host: str, subdomains: bool = True) -> Column:
    host = netloc(url)
    same = host == F.lit(start_host)
    return same | (registered_domain(host) == registered_domain(F.lit(start_host))) if subdomains else same


def coerce(url: Column) -> Column:
    """https:// before what has no scheme."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when((u != "") & ~u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(F.lit("https://"), u)).otherwise(u)


def structure_issues(url: Column) -> Column:
    """array<string> of what is unfortunate about a URL's form."""
    p = path(url)
    served = p.rlike(r"/api/|/search|/filter|/callback")
    return F.array_compact(
        F.array(
            F.when(F.contains(p, F.lit("_")), F.lit("underscores_in_url")),
            F.when(p != F.lower(p), F.lit("uppercase_in_url")),
            F.when(F.contains(p, F.lit("//")), F.lit("double_slashes_in_url")),
            F.when((query(url) != "") & ~served, F.lit("query_params_on_content_page")),
        )
    )


def link_class(href: Column, host: Column) -> Column:
    """internal or external by host; without one a link is internal."""
    h = netloc(href)
    return F.when((h == "") | (h == host), F.lit("internal")).otherwise(F.lit("external"))


def link_class_by_prefix(href: Column, host: Column) -> Column:
    """The page report's rule: none for empty links, fragments and scripts; what begins with a slash is internal, which makes "//other" both."""
    h = F.coalesce(href, F.lit(""))
    skipped = (h == "") | h.startswith("#") | h.startswith("javascript:")
    absolute, there = h.rlike(r"^(?:https?:)?//"), netloc(h)
    external = absolute & (there != "") & (there != host)
    internal = h.startswith("/") | (there == "") | (there == host) | ~absolute
    return F.when(skipped, "none").when(internal & external, "both").when(external, "external").when(internal, "internal").otherwise("none")


def link_class_by_netloc(href: Column, host: Column) -> Column:
    """The link module's rule: hosts are compared without a final slash, and a link without one is internal."""
    bare = lambda x: F.rtrim(F.lower(x), F.lit("/"))
    there = netloc(href)
    return F.when((there == "") | (bare(there) == bare(host)), "internal").otherwise("external")


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """Where a link leads from a page, without its fragment; null where it can't be told."""

    def one(b, h):
        try:
            return urldefrag(urljoin(b or "", (h or "").strip()))[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype="object")


def resolve(base: Column, href: Column) -> Column:
    """resolved(), natively for absolute links and those from the root without dots."""
    h = F.trim(F.coalesce(href, F.lit("")))
    plain = ~h.rlike(r"/\.{1,2}(?:/|$)") & ~F.contains(h, F.lit("\\"))
    bare = F.substring_index(h, "#", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    return F.when(plain & h.rlike(r"^https?://[^/?#]+/"), bare).when(plain & h.rlike(r"^/(?:[^/]|$)") & (origin != ""), F.concat(origin, bare)).otherwise(resolved(base, href))


def canonical_state(canonical: Column, url: Column) -> Column:
    """struct<self, slash_mismatch>: whether a canonical names its own page, and whether only their final slashes tell them apart where that matters."""
    bare = lambda u: F.rtrim(u, F.lit("/"))
    same, alike = bare(canonical) == bare(url), canonical.endswith("/") == url.endswith("/")
    return F.struct(same.alias("self"), F.when(alike, False).when(same, path(bare(url)) != "").otherwise(True).alias("slash_mismatch"))
