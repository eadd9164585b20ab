"""What runs on a page beside its content: analytics, consent tools, client-side frameworks, style signals.

Script sources and inline texts are taken from the html once, as arrays; every
provider is a test on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A provider is known by a script source (lower case) that holds all parts of one of its marks.
ANALYTICS_SOURCES: dict[str, tuple[tuple[str, ...], ...]] = {
    "Google Analytics / GTM": (("gtag",), ("google-analytics",), ("googletagmanager",)),
    "Facebook Pixel": (("fbq",), ("facebook",)),
    "Hotjar": (("hotjar",),),
    "Plausible": (("plausible",),),
    "Fathom Analytics": (("usefathom.com",),),
    "Umami": (("umami.is",), ("analytics.umami",)),
    "Mixpanel": (("mixpanel.com",), ("mxpnl.com",)),
    "Heap": (("heap-analytics",), ("heap.load",)),
    "Segment": (("segment.com/analytics.js",), ("cdn.segment.com",)),
    "Amplitude": (("amplitude.com",),),
    "PostHog": (("posthog",),),
    "Microsoft Clarity": (("clarity.ms",),),
    "Matomo": (("matomo",), ("piwik",)),
    "Vercel Analytics": (("vercel-analytics",), ("va.vercel-scripts",)),
    "Cloudflare Web Analytics": (("cloudflareinsights",),),
    "Adobe Analytics": (("omniture",), ("s_code",), ("appmeasurement",)),
    "Snapchat Pixel": (("snaptr",), ("sc-static.net",)),
    "TikTok Pixel": (("tiktok", "analytics"),),
    "LinkedIn Insight Tag": (("linkedin.com/px",), ("snap.licdn.com",)),
    "Pinterest Tag": (("pintrk",), ("s.pinimg.com",)),
}
# The same by inline scripts; a part in upper case marks ("~part") is looked for in lower case.
ANALYTICS_INLINE: dict[str, tuple[tuple[str, ...], ...]] = {
    "Google Analytics / GTM": (("gtag(",), ("google-analytics",)),
    "Facebook Pixel": (("fbq(",),),
    "Mixpanel": (("mixpanel.init",),),
    "Heap": (("heap.load",),),
    "Segment": (("analytics.load", "~segment"),),
    "Amplitude": (("amplitude.init",),),
    "PostHog": (("posthog.init",),),
    "LinkedIn Insight Tag": (("_linkedin_partner_id",),),
    "Pinterest Tag": (("pintrk",),),
    "Reddit Pixel": (("rdt('init'",), ("rdt( 'init'",)),
    "TikTok Pixel": (("ttq", "~tiktok"),),
    "Snapchat Pixel": (("snaptr",),),
}
# Consent tools by script source.
CONSENT_SOURCES: dict[str, tuple[tuple[str, ...], ...]] = {
    "Cookiebot": (("cookiebot",),),
    "OneTrust": (("onetrust",), ("optanon",), ("cookielaw",)),
    "CookieYes": (("cookieyes",), ("cookie-yes",)),
    "Termly": (("termly",),),
    "CookieConsent": (("cookieconsent",),),
    "Quantcast Choice": (("quantcast", "choice"),),
    "iubenda": (("iubenda",),),
    "TrustArc": (("trustarc",), ("truste",)),
    "Osano": (("osano.com",),),
    "CookieFirst": (("cookiefirst.com",),),
    "Complianz": (("complianz",),),
}
# Frameworks by a pattern over tags; mount points of those that leave no other mark.
FRAMEWORKS = {
    "Next.js": r"""\bid=["'](?:__next|__NEXT_DATA__)["']|<script[^>]*src=["'][^"']*(?i:/_next/)""",
    "Nuxt": r"""\bid=["']__nuxt["']|<script[^>]*src=["'][^"']*(?i:/_nuxt/)|__NUXT__""",
    "React": r"""<[^>]*\sdata-reactroot\b""",
    "Angular": r"""<[^>]*\sng-version\b""",
    "Svelte": r"""<[^>]*\sdata-svelte""",
    "Astro": r"""<[^>]*\sdata-astro""",
    "Vite": r"""<script[^>]*src=["'][^"']*(?i:/assets/index-[^"']*\.js)["']""",
}
MOUNT = r"""\bid=["'](?:root|app|application|q-app)["']"""
MODULE_SCRIPT = r"""(?i)<script[^>]*type=["']module["']"""
SHELL_WORDS = 25
SHELL = "Client-rendered SPA"

SOURCES = r"""(?is)<script[^>]*\ssrc=["']([^"']*)["']"""
INLINE = r"""(?is)<script(?![^>]*\ssrc=)[^>]*>(.*?)</script>"""
STYLES = r"(?is)<style[^>]*>(.*?)</style>"


def _named(marks: dict[str, tuple[tuple[str, ...], ...]], texts: Column) -> Column:
    """The names with a mark of which some text holds all parts, in the table's order."""

    def holds(text: Column, part: str) -> Column:
        return F.contains(F.lower(text), F.lit(part[1:])) if part[0] == "~" else F.contains(text, F.lit(part))

    def known(alternatives: tuple[tuple[str, ...], ...]) -> Column:
        one = lambda t: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [holds(t, p) for p in parts]) for parts in alternatives])
        return F.exists(texts, one)

    return F.array_compact(F.array(*[F.when(known(a), F.lit(name)) for name, a in marks.items()]))


def signals(html: Column, words: Column) -> dict[str, Column]:
    """analytics, consent, frameworks (arrays of names), style_bytes, font_display_swap, reduced_motion.

    ``words`` counts the words of the served body: a near-empty one with a mount
    point or a module script, and no known framework, is rendered by the client.
    """
    sources = F.transform(F.regexp_extract_all(html, F.lit(SOURCES), F.lit(1)), F.lower)
    inline, styles = F.regexp_extract_all(html, F.lit(INLINE), F.lit(1)), F.regexp_extract_all(html, F.lit(STYLES), F.lit(1))
    known = F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(name)) for name, p in FRAMEWORKS.items()]))
    modules = html.rlike(MODULE_SCRIPT)
    shell = (words < SHELL_WORDS) & (html.rlike(MOUNT) | modules) & ((F.size(sources) > 0) | modules) & (F.size(known) == 0)
    style = F.exists(styles, lambda t: F.contains(t, F.lit("font-display")) & F.contains(t, F.lit("swap"))) | F.exists(inline, lambda t: F.contains(t, F.lit("font-display")) & F.contains(t, F.lit("swap")))
    motion = F.exists(styles, lambda t: F.contains(t, F.lit("prefers-reduced-motion"))) | F.exists(inline, lambda t: F.contains(t, F.lit("prefers-reduced-motion")))
    return {
        "analytics": F.array_sort(F.array_union(_named(ANALYTICS_SOURCES, sources), _named(ANALYTICS_INLINE, inline))),
        "consent": _named(CONSENT_SOURCES, sources),
        "frameworks": F.when(shell, F.array(F.lit(SHELL))).otherwise(known),
        "style_bytes": F.aggregate(styles, F.lit(0), lambda n, t: n + F.octet_length(t)),
        "font_display_swap": style,
        "reduced_motion": motion,
    }


def analyse(pages: DataFrame, words: Column, key: str = "page_id") -> DataFrame:
    """key and the signals of every page (html)."""
    return pages.select(key, *[c.alias(name) for name, c in signals(F.col("html"), words).items()])
