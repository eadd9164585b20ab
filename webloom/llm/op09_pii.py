"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four kinds (email, ip,
card, phone) that pass their checks.  They are seeds, and so are values that look
like keys (long runs of mixed letters and digits, kind secret), which are no spans
of their own.  What stands around a seed gives lexical patterns: the two words
before; one that ends in a mark such as ":" or "="; the name of a key ("token" in
token = "..."); the word before with the word after; the word before with the
value's shape.  Candidate instances are other tokens with three digits or more,
runs of digit groups with single spaces or marks between them, and address-like
tokens ("@", "(at)", "[at]" and the like between letters or digits).  Patterns and
instances form a graph that is scored in rounds until one finds nothing new: a
pattern's confidence is the score of its instances of one kind over their number,
an instance's score is that of at least one good pattern being right.  A pattern
is good from LEAST_SEEDS distinct known values and LEAST_CONFIDENCE on; a candidate
that suits the pattern's kind and whose score reaches LEAST_SCORE is an identifier
and counts in the next round.  Its spans, everywhere, get the kind "ctx_" + the
pattern's kind; a seed of the kind secret is one as soon as a good pattern holds it.

Regular expressions are written so that they can't run long: possessive, and
anchored at the start of a run of their characters (or the end of the match
before), where a leftmost match must begin.

Edge cases: null and empty texts have no spans (base_sha256 is that of the empty
string); spans count code points; overlapping spans of different kinds all
count; repeated rows each get their row; a line repeated in many documents counts
its values once; very long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

KINDS = ("email", "ip", "card", "phone")
#: What the method finds beside them.
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE = 3, 0.7, 0.75
#: Characters before a span in which its context is looked for.
CONTEXT = 80

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: A whole run of digits with single separators, of 14 to 19 digits: shorter and longer runs would match and then be dropped.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
CANDIDATE = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){3})\S++"
#: Digit groups with at least one single space among them, as "(555) 123-4567" or "4111 1111 1111 1112", from the first group of a run on.
GROUPS = r"(?<![\p{L}0-9_+.@/(-])(?<![0-9]\x20)\+?\(?D(?:\)?[./-]?\(?D)*+(?:\)?\x20\(?D(?:\)?[./-]?\(?D)*+)++".replace("D", r"[0-9]++(?![\p{L}0-9_@])")
#: A token with an "@", or a written-out one, before a letter or digit.
ADDRESS = r"(?i)(?<!\S)(?=\S+?(?:@|[\[(_-]at[\])_-])[\p{L}0-9])\S++"
#: A value that looks like a key: letters and digits in one run.
KEY_LIKE = r"^[A-Za-z0-9_+/=-]{20,}$"
#: A key's name and mark before a value, and at the start of a token that holds both.
KEY_NAME = r"([\p{L}_][\p{L}0-9_.-]*)[\"']?\s*(?:=>|:=|=|:)\s*[\"'(\[{<]*$"
KEY_PREFIX = r"^[\p{L}_][\p{L}0-9_.-]*[\"']?(?:=>|:=|=|:)(?!//)[\"'(\[{<]*"
MARKED = r"(?i)[0-9@]|[\[(_-]at[\])_-]"
#: What may stand around a token without belonging to it.
TRIM = "\"'`()[]{}<>,;:.!?*&%$#|"

SPAN = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points: what lies between them gives the places."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["piece"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    return F.aggregate(pairs, first, step, lambda done: done["spans"])


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def luhn(value: Column) -> Column:
    from_right = F.transform(F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def base_spans(text: Column) -> dict[str, Column]:
    """The checked matches of each kind."""
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda s: s["value"].rlike(IP_PARTS))).otherwise(_none()),
        "card": F.when(text.rlike(CARD), F.filter(matches(text, CARD), lambda s: luhn(s["value"]))).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda s: digits(s["value"]).between(10, 15))).otherwise(_none()),
    }


def _shape(value: Column) -> Column:
    """Runs of digits, of Latin and of other letters as one sign each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a"), r"\p{L}{2,}", "a")


def _contexts(text: Column, start: Column, end: Column, value: Column) -> Column:
    """The lexical patterns around a place."""
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
    n = F.size(words)
    last, previous = F.when(n >= 1, F.get(words, n - 1)), F.when(n >= 2, F.get(words, n - 2))
    after = F.lower(F.regexp_extract(F.substring(text, end + 1, F.lit(CONTEXT)), r"^[^\s\p{L}0-9]*\s+(\S*\p{L}\S*)", 1))
    two = F.when(previous.isNotNull(), F.concat(F.lit("2 "), previous, F.lit(" "), last))
    cue = F.when(last.rlike(r"[:=#]$"), F.concat(F.lit("1 "), last))
    key = F.regexp_extract(before, KEY_NAME, 1)
    named = F.when(key != "", F.concat(F.lit("key "), key))
    around = F.when(last.rlike(r"\p{L}") & (after != ""), F.concat(F.lit("around "), last, F.lit(" "), after))
    shaped = F.when(last.rlike(r"\p{L}"), F.concat(F.lit("shape "), last, F.lit(" "), _shape(value)))
    return F.array_compact(F.array(two, cue, named, around, shaped))


def find_base(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key (of the text), base spans in order, and candidates; seeds and candidates with their contexts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("marked", F.col("text").rlike(MARKED))
    t = F.col("text")
    found = base_spans(t)

    def tag(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    tagged = [tag(spans, k) for k, spans in enumerate(found.values())]
    rows = rows.withColumn("base", F.when(F.col("marked"), F.array_sort(F.concat(*tagged))))
    shape = lambda s, alike: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), alike.alias("alike"))

    def trimmed(spans: Column) -> Column:
        def cut(spans: Column, left: Callable[[Column], Column]) -> Column:
            """Without what ``left`` takes off the beginning, and marks at the end."""
            return F.transform(spans, lambda s: F.struct((s["start"] + F.length(s["value"]) - F.length(left(s["value"]))).alias("start"), F.rtrim(left(s["value"]), F.lit(TRIM)).alias("value")))

        at = cut(cut(spans, lambda v: F.ltrim(v, F.lit(TRIM))), lambda v: F.regexp_replace(v, KEY_PREFIX, ""))
        return F.transform(at, lambda s: shape(s, F.lit(False)))

    free = lambda spans: F.filter(spans, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    tokens = F.concat(F.filter(trimmed(matches(t, CANDIDATE)), lambda s: digits(s["value"]) >= 3), trimmed(matches(t, ADDRESS)))
    rows = rows.withColumn("tokens", F.when(F.col("marked"), F.array_distinct(free(tokens))))
    # A run of groups whose first group is a token too is another reading of that token.
    runs = F.filter(matches(t, GROUPS), lambda s: digits(s["value"]).between(7, 19))
    runs = F.transform(runs, lambda s: shape(s, F.exists(F.col("tokens"), lambda x: x["start"].between(s["start"], s["start"] + 2))))
    rows = rows.withColumn("free", F.when(F.col("marked"), F.concat(F.col("tokens"), free(runs))))
    with_context = lambda spans: F.transform(spans, lambda s: s.withField("contexts", _contexts(t, s["start"], s["end"], s["value"])))
    none = F.array()
    return rows.select(
        "doc_id",
        F.struct("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("n")).alias("key"),
        F.coalesce(with_context(F.col("base")), none).alias("base"),
        F.coalesce(with_context(F.col("free")), none).alias("free"),
    )


def _letters(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^A-Za-z]", ""))


def _key_like(value: Column) -> Column:
    return value.rlike(KEY_LIKE) & (digits(value) >= 4) & (_letters(value) >= 4)


def _suits(kind: Column, value: Column) -> Column:
    n = digits(value)
    return (
        F.when(kind == 0, F.contains(value, F.lit("@")) | F.lower(value).rlike(r"(\[|\(|_|-)at(\]|\)|_|-)"))
        .when(kind == 1, value.rlike(r"^[0-9]+(?:[.:-][0-9]+){2,}$"))
        .when(kind == 2, value.rlike("^[0-9 -]+$") & n.between(12, 19))
        .when(kind == 3, value.rlike(r"^[0-9()./+\x20-]+$") & n.between(7, 15))
        .otherwise((F.length(value) >= 8) & (_letters(value) >= 1))
    )


def discover(found: DataFrame) -> DataFrame | None:
    """value, kind and score of the identifiers that good patterns show; None if there are none.

    Values are compared in lower case.
    """
    free = found.filter(F.size("free") > 0).select(F.explode("free").alias("s")).select(F.lower("s.value").alias("value"), F.explode("s.contexts").alias("pattern"), "s.alike")
    free = free.groupBy("pattern", "value").agg(F.min("alike").alias("alike"))
    seeds = found.filter(F.size("base") > 0).select(F.explode("base").alias("s")).select("s.kind", F.lower("s.value").alias("value"), F.explode("s.contexts").alias("pattern")).distinct()
    seeds = seeds.join(free.select("pattern").distinct(), "pattern", "left_semi").withColumn("alike", F.lit(False))
    keys = free.filter(_key_like(F.col("value"))).select("pattern", "value", F.lit(SECRET).alias("kind"), "alike")
    seeds = seeds.select("pattern", "value", "kind", "alike").unionByName(keys)
    edges = stored(seeds.select("pattern", "value", "kind", "alike").unionByName(free.withColumn("kind", F.lit(None).cast("int"))), "pattern-edges")
    known = edges.filter("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score")).withColumn("shown", F.lit(False))
    pairs = edges.groupBy("pattern", "value").agg(F.min("alike").alias("alike"))

    def good_patterns() -> DataFrame:
        """pattern, of_kind and confidence; of a value known in two kinds, or a pattern of two, the stronger counts."""
        best = known.groupBy("value").agg(F.max("score").alias("score"), F.max_by("kind", F.struct("score", -F.col("kind"))).alias("as_kind"))
        sums = pairs.join(best, "value", "left")
        # another reading of a token counts once it is known
        values = sums.groupBy("pattern").agg(F.count_distinct(F.when(~F.col("alike") | F.col("score").isNotNull(), F.col("value"))).alias("values"))
        kinds = sums.filter("as_kind is not null").groupBy("pattern", "as_kind").agg(F.sum("score").alias("mass"), F.count("score").alias("positive"))
        of_kind = kinds.groupBy("pattern").agg(F.max(F.struct("mass", -F.col("as_kind"), "positive", "as_kind")).alias("k"))
        found = values.join(of_kind, "pattern").select("pattern", F.col("k.as_kind").alias("of_kind"), F.col("k.positive").alias("positive"), (F.col("k.mass") / F.greatest("values", "k.positive")).alias("confidence"))
        found = found.withColumn("confidence", F.least(F.lit(0.999), "confidence"))
        return found.filter((F.col("positive") >= LEAST_SEEDS) & (F.col("confidence") >= LEAST_CONFIDENCE))

    while True:  # every round but the last finds values, of which there are finitely many
        good = stored(good_patterns(), "good-patterns")
        new = edges.filter("kind is null").join(good, "pattern").filter(_suits(F.col("of_kind"), F.col("value")))
        new = new.groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"), F.max_by("of_kind", F.struct("confidence", -F.col("of_kind"))).alias("kind"))
        new = stored(new.filter(F.col("score") >= LEAST_SCORE).join(known.select("value"), "value", "left_anti").select("value", "kind", "score", F.lit(True).alias("shown")), "identifiers")
        if new.isEmpty():
            break
        known = stored(known.unionByName(new), "known-identifiers")
    held = edges.filter(F.col("kind") == SECRET).join(good.filter(F.col("of_kind") == SECRET), "pattern").groupBy("value").agg(F.max("confidence").alias("score"))
    shown = known.filter("shown").select("value", "kind", "score").unionByName(held.select("value", F.lit(SECRET).alias("kind"), "score"))
    shown = stored(shown, "shown-identifiers")
    return None if shown.isEmpty() else shown


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (start, kind, end), found (start, kind, end) of every row; kinds are places in ALL_KINDS."""
    base = stored(find_base(docs), "pii")
    identifiers = discover(base)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = base.select("doc_id", "key", plain(F.col("base")).alias("base"))
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    if identifiers is None:
        return rows.withColumn("found", nothing)
    spans = base.filter(F.size("free") > 0).select("key", F.explode("free").alias("s")).withColumn("value", F.lower("s.value")).join(identifiers, "value")
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), "kind", F.col("s.end").alias("end")))).alias("found"))
    return rows.join(spans, rows["key"].eqNullSafe(spans["key"]), "left").select(rows["doc_id"], rows["key"], "base", F.coalesce("found", nothing).alias("found"))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ALL_KINDS)), kind + 1)


def _digest(spans: Column, prefix: str = "") -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(prefix), _name(s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"]))


def report(found: DataFrame) -> DataFrame:
    """The counts and digests of find()'s rows."""
    base = F.array_join(_digest(F.col("base")), ",")
    both = F.array_sort(F.concat(F.col("base"), F.transform("found", lambda s: s.withField("kind", s["kind"] + len(KINDS)))))
    spans = F.transform(both, lambda s: F.concat(F.when(s["kind"] < len(KINDS), _name(s["kind"])).otherwise(F.concat(F.lit("ctx_"), _name(s["kind"] - len(KINDS)))), F.lit(":"), s["start"], F.lit(":"), s["end"]))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.size(both).cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets, n_chars renewed where there is one."""
    found = find(docs).filter((F.size("base") > 0) | (F.size("found") > 0))
    spans = found.groupBy("key").agg(F.max(F.concat("base", "found")).alias("spans"))
    # The input's columns stand in a struct of their own, whatever their names.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.length(text).alias("n")).alias("of"))
    joined = keyed.join(spans, keyed["of"].eqNullSafe(spans["key"]), "left").select("row", "spans")
    old = F.col("row")["text"].cast("string")

    def step(done: Column, s: Column) -> Column:
        piece = F.concat(done["out"], F.substring(old, done["at"] + 1, s["start"] - done["at"]), F.lit("<"), F.upper(_name(s["kind"])), F.lit(">"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] < done["at"], done["out"]).otherwise(piece).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.array_sort("spans"), first, step, lambda d: F.concat(d["out"], F.substring(old, d["at"] + 1, F.length(old))))
    joined = joined.select("row", F.when(F.col("spans").isNull(), old).otherwise(clean).alias("clean"), F.col("spans").isNull().alias("kept"))

    def column(name: str) -> Column:
        value = F.col("row")[name]
        if name == "text":
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(F.col("kept"), value).otherwise(F.length("clean").cast(docs.schema[name].dataType)).alias(name)
        return value.alias(name)

    return joined.select(*map(column, docs.columns))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents")))
