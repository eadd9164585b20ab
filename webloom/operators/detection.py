"""Which modules a page calls for, which ones a run has assessed, which findings may cap a grade."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.columns import bound

# Modules that always run, modules by kind of site, signs of the others, modules whose P0 findings cap the grade.
CORE = ("seo", "security", "accessibility", "performance")
ALWAYS = (*CORE, "links", "eeat", "ai_search", "technical_seo", "content_depth", "crawlability")
BY_SITE = {"ecommerce": ("ecommerce",), "local_business": ("local_seo",), "landing_page": ("local_seo",), "marketing": ("local_seo",)}
SIGNS = {
    "ecommerce": r'add-to-cart|shopping-cart|"@type"\s*:\s*"Product"|product-price|data-product-id|shopify|woocommerce',
    "i18n": r"hreflang=|lang-selector|language-switcher",
    "local_seo": r'"@type"\s*:\s*"(?:LocalBusiness|Restaurant|Store|AutoRepair|Plumber|Dentist|Electrician|LegalService|MedicalBusiness|RealEstateAgent|FinancialService|AutomotiveBusiness|HomeAndConstructionBusiness|ProfessionalService)"|google\.com/maps/embed|maps\.googleapis\.com|href="tel:|service-area',
    "email_deliverability": r'<form|contact-form|type="email"',
    "video": r"<video[\s>]|youtube\.com/embed|youtu\.be/|player\.vimeo\.com",
}
CAPPING = ("seo", "technical_seo", "security", "crawlability", "sitemap")


def modules_for(html: Column, site: str | None = None, enable: Iterable[str] = (), disable: Iterable[str] = ()) -> Column:
    """Sorted names of the modules to run on a page."""
    given = F.array(*map(F.lit, sorted({*ALWAYS, *BY_SITE.get(site or "", ()), *enable})))
    seen = F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(name)) for name, p in SIGNS.items()]))
    off = F.array(*map(F.lit, disable)) if disable else F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_except(F.array_union(given, seen), off))


SCORES = "struct<seo:struct<score:double>,security:struct<assessed:boolean>,module_scores:map<string,struct<error:string,total:double>>,report:string>"


def scanned_modules(document: Column) -> Column:
    """Sorted modules that a scores document (JSON text, also under "report") assessed.

    The core ones only if there is a score for seo; security not if it says that it
    wasn't assessed; modules with an error not.
    """
    inner = bound(document, lambda text: F.coalesce(F.get_json_object(text, "$.report"), text))
    return bound(F.from_json(inner, SCORES), _scanned)


def _scanned(d: Column) -> Column:
    core = F.when(d["seo"]["score"].isNotNull(), F.array_except(F.array(*map(F.lit, (*CORE, "core"))), F.when(d["security"]["assessed"] == F.lit(False), F.array(F.lit("security"))).otherwise(F.expr("cast(array() as array<string>)"))))
    ran = F.transform(F.filter(F.map_entries(d["module_scores"]), lambda e: e["value"].isNotNull() & e["value"]["error"].isNull()), lambda e: e["key"])
    none = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_union(F.coalesce(core, none), F.coalesce(ran, none)))


def capped_scores(categories: DataFrame, findings: DataFrame, key: str = "page_id") -> DataFrame:
    """The categories (seo, security, security_assessed, accessibility, performance) with the overall score that module findings may cap.

    Only findings of the CAPPING modules count; p0 and p1 are their numbers.
    """
    blocking = findings.filter(F.col("module").isin(*CAPPING)).groupBy(key).agg(F.count_if(F.col("priority") == "P0").alias("p0"), F.count_if(F.col("priority") == "P1").alias("p1"))
    return capped(categories.join(blocking, key, "left"))


def capped(rows: DataFrame) -> DataFrame:
    """``capped_scores`` of categories that have p0 and p1 beside them, null for none."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("p0", "p1")})
    c = F.col
    return rows.withColumns(scores.composite(c("seo"), c("security"), c("accessibility"), c("performance"), c("p0"), c("security_assessed")))


def category_list(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """key, label, score (null where not assessed), note of the four categories."""
    part = lambda label, score, note: F.struct(F.lit(label).alias("label"), score.cast("int").alias("score"), note.alias("note"))
    none, c = F.lit(""), F.col
    security = part("Security", F.when(c("security_assessed"), c("security")), F.when(c("security_assessed"), "").otherwise("not assessed"))
    listed = F.array(part("SEO", c("seo"), none), security, part("Performance", c("performance"), F.lit("heuristic")), part("Accessibility", c("accessibility"), none))
    return rows.select(key, F.explode(listed).alias("r")).select(key, "r.*")
