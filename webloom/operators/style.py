"""Colours, fonts and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

# A hex colour, font declarations, families that say nothing, defaults; badge colours by grade and widths of letters.
HEX = r"#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"
FONT = r"font-family\s*:\s*([^;}{]+)"
GENERIC = ("sans-serif", "serif", "monospace", "system-ui", "-apple-system", "inherit", "initial", "var", "arial", "helvetica")
ACCENT, FAMILY, SHOWN, RANKED = "#1c211e", "Plus Jakarta Sans", 12, 80
BADGE = {"A": "#4c1", "B": "#97ca00", "C": "#dfb317", "D": "#fe7d37", "F": "#e05d44"}
NARROW, WIDE = "1Iijl!|:;.,'\"`", "MWmw@%"


def channels(colour: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1 of "#rgb" or "#rrggbb"."""
    h = F.substring(colour, 2, 6)
    long = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda k: F.conv(F.substring(long, k, 2), 16, 10).cast("double") / 255
    return part(1), part(3), part(5)


def saturation(high: Column, low: Column) -> tuple[Column, Column]:
    """Of the highest and lowest channel: saturation in the HLS model, and how near the lightness is to the middle (1 at 0.45)."""
    light = (high + low) / 2
    spread = F.when(light <= 0.5, F.try_divide(high - low, high + low)).otherwise(F.try_divide(high - low, 2 - high - low))
    return F.when(high == low, 0.0).otherwise(spread), 1 - F.abs(light - 0.45)


def colours(css: DataFrame, key: str, text: str = "css") -> DataFrame:
    """key, colour, n, first: how often each colour stands in a stylesheet, and where it stands first."""
    found = css.select(key, F.posexplode(F.transform(F.regexp_extract_all(F.col(text), F.lit(HEX), F.lit(0)), F.lower)).alias("at", "colour"))
    return found.groupBy(key, "colour").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def palette(css: DataFrame, key: str, text: str = "css") -> DataFrame:
    """key, accent, palette: the commonest colours (ties by first place), and the commonest of them that is saturated and of middle lightness."""
    counted = colours(css, key, text).withColumns(dict(zip("rgb", channels(F.col("colour")))))
    counted = counted.withColumns({"high": F.greatest("r", "g", "b"), "low": F.least("r", "g", "b")})
    saturated, middle = saturation(F.col("high"), F.col("low"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "colour", ((saturated > 0.25) & (middle > 0.35)).alias("usable"))))
    rows = counted.groupBy(key).agg(ranked.alias("r"))
    accent = F.get(F.filter(F.slice("r", 1, RANKED), lambda x: x["usable"]), F.lit(0))["colour"]
    rows = rows.select(key, F.coalesce(accent, F.lit(ACCENT)).alias("accent"), F.transform(F.slice("r", 1, SHOWN), lambda x: x["colour"]).alias("palette"))
    empty = css.select(key).distinct().join(rows, key, "left_anti").select(key, F.lit(ACCENT).alias("accent"), F.expr("cast(array() as array<string>)").alias("palette"))
    return rows.unionByName(empty)


def fonts(text: Column) -> tuple[Column, Column]:
    """The first four families named (generic ones and variables left out) and the primary one."""
    named = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){FONT}"), F.lit(1)), lambda f: F.trim(F.trim(F.split(f, ",")[0]), F.lit("'\" ")))
    known = F.array_distinct(F.filter(named, lambda f: (f != "") & ~F.lower(f).isin(*GENERIC) & ~f.startswith("--") & ~f.startswith("var(")))
    return F.slice(known, 1, 4), F.coalesce(F.get(known, F.lit(0)), F.lit(FAMILY))


def badge_colour(score: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BADGE.items() for x in kv]), scores.grade(score))


def text_width(text: Column) -> Column:
    """About how many pixels wide a text is at 11 px."""
    width = lambda ch: (
        F.when(ch == " ", 3.3).when(F.contains(F.lit(NARROW), ch), 4.5).when(F.contains(F.lit(WIDE), ch), 9.0).when(ch.rlike(r"^\p{Lu}$"), 7.5).when(ch.rlike(r"^\p{Nd}$"), 6.5).otherwise(6.3)
    )
    return F.aggregate(F.filter(F.split(text, ""), lambda ch: ch != ""), F.lit(0.0), lambda n, ch: n + width(ch))


def badge(label: Column, score: Column) -> dict[str, Column]:
    """colour, and widths of the label's and the score's halves."""
    return {"colour": badge_colour(score), "label_width": F.bround(text_width(label) + 10, 1), "score_width": F.bround(text_width(score.cast("string")) + 10, 1)}
