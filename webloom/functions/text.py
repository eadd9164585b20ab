"""Text measures on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing of a topic, and words that link targets share anyway.
STOP_WORDS = tuple(
    "the and for are but not you all can had her was one our out has his how its may new now old see way who did get let say she too use with this that from they been have your will each make like than them then what when more some very about which their there would other".split()
)
LINK_STOP_WORDS = ("the", "a", "an", "in", "for", "and", "of", "to", "au", "com", "www")
# Trade terms and what a client reads instead, replaced in this order.
PLAIN_TERMS = {
    "P0": "Urgent", "P1": "Important", "P2": "Recommended", "P3": "Nice to Have", "HSTS": "Browser security header", "CSP": "Content security policy", "meta description": "search result snippet text",
    "JSON-LD": "structured data for search engines", "alt text": "image description for accessibility", "CLS": "layout shift (things jumping around)", "LCP": "page load speed", "ARIA": "accessibility markup",
    "hreflang": "language/region targeting tags", "canonical": "preferred page URL for search engines", "robots.txt": "search engine crawling rules", "sitemap": "page index for search engines",
    "DNSSEC": "domain security verification", "CAA": "certificate authority restrictions", "SPF": "email sender verification", "DKIM": "email signature verification", "DMARC": "email authentication policy",
}


def words(text: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    return F.array_join(words(text), " ")


def fingerprint(text: Column) -> Column:
    return F.md5(F.lower(collapse(text)).cast("binary"))


def syllables(word: Column) -> Column:
    """Vowel groups, less a final e, at least one; none in an empty word."""
    w = F.lower(F.trim(word))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)))


VOWEL, OTHER, WORD_START, WORD_END = "[aeiouyAEIOUY]", "[a-zA-Z'&&[^aeiouyAEIOUY]]", "(?<![a-zA-Z'])", "(?![a-zA-Z'])"


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade to one decimal; null under 30 words or without a sentence."""
    times = lambda pattern: F.regexp_count(text, F.lit(pattern))
    sentences, n = times(r"(?U)[^.!?\s][^.!?]*"), times("[a-zA-Z']+")
    # Syllables of all words at once: vowel groups, less a final e after another group, and one for a word without any; possessive, so a run of letters is gone through once.
    total = times(f"{VOWEL}+") - times(f"{VOWEL}{OTHER}++{VOWEL}++(?<=[eE]){WORD_END}") + times(f"{WORD_START}{OTHER}++{WORD_END}")
    grade = F.lit(0.39) * (n / sentences) + F.lit(11.8) * (total / n) - F.lit(15.59)
    return F.when((n >= 30) & (sentences >= 1), F.rint(grade * 10) / 10)  # bround goes by the shortest decimal of a double and has no -0.0


def keywords(text: Column) -> Column:
    """The distinct words of three letters or more that aren't stop words, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS))))


def link_terms(text: Column) -> Column:
    """The distinct terms by which queries and link targets are matched."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, LINK_STOP_WORDS))))


def stemmed_terms(text: Column) -> Column:
    """link_terms without one trailing s of longer terms."""
    return F.array_sort(F.array_distinct(F.transform(link_terms(text), lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.regexp_replace(t, "s$", "")).otherwise(t))))


# Fixed values of the next three: elements and patterns that are taken out.
def visible_text(html: Column) -> Column:
    """Page text without scripts, styles, menus, headers and footers; tags become spaces."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?is)<(nav|header|footer)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(t, r"<[^>]+>", " ")


def plain_language(text: Column, terms: dict[str, str] | None = None) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), (terms or PLAIN_TERMS).items(), text)


def without_code(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?s)```[^\n]*\n.*?```", "")
    return F.regexp_replace(t, r"`[^`]+`", "")


def finding_id(module: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.coalesce(module, F.lit("core")), F.lit("|"), F.trim(title)).cast("binary")), 1, 10)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-")
