"""robots.txt on columns: groups, postures towards crawlers, path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Crawlers that answer questions, and crawlers that gather training data, as robots files name them.
ANSWER_BOTS = ("oai-searchbot", "chatgpt-user", "perplexitybot", "google-extended")
TRAINING_BOTS = ("gptbot", "claudebot", "anthropic-ai", "ccbot", "bytespider", "amazonbot", "applebot-extended", "meta-externalagent")

RULES = "array<struct<kind:string,path:string>>"
GROUP = f"struct<agents:array<string>,rules:{RULES}>"


def groups(text: Column) -> Column:
    """array<struct<agents, rules>> in file order: agent lines in a row share the rules after them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    fields = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("field"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    start = F.struct(none(f"array<{GROUP}>").alias("done"), none("array<string>").alias("agents"), none(RULES).alias("rules"), F.lit(False).alias("begun"))

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["agents"].alias("agents"), s["rules"].alias("rules"))))

    def step(s: Column, f: Column) -> Column:
        agent, rule = f["field"] == "user-agent", f["field"].isin("allow", "disallow")
        new = agent & s["begun"] & (F.size(s["agents"]) > 0)
        mine = F.array(F.lower(f["value"]))
        return F.struct(
            F.when(new, closed(s)).otherwise(s["done"]).alias("done"),
            F.when(new, mine).when(agent, F.concat(s["agents"], mine)).otherwise(s["agents"]).alias("agents"),
            F.when(new, none(RULES)).when(rule, F.concat(s["rules"], F.array(F.struct(f["field"].alias("kind"), f["value"].alias("path"))))).otherwise(s["rules"]).alias("rules"),
            F.when(new, F.lit(False)).otherwise(s["begun"] | rule).alias("begun"),
        )

    return F.aggregate(fields, start, step, lambda s: F.when(F.size(s["agents"]) > 0, closed(s)).otherwise(s["done"]))


def rules_for(parsed: Column, agent: str) -> Column:
    """The rules of the first group that names the agent, else of the first for all; null if there is none."""
    of = lambda name: F.get(F.filter(parsed, lambda g: F.array_contains(g["agents"], F.lit(name))), F.lit(0))["rules"]
    return F.coalesce(of(agent), of("*"))


def posture(parsed: Column, agent: str) -> Column:
    """allowed, partial or blocked."""
    rules = F.coalesce(rules_for(parsed, agent), F.expr(f"cast(array() as {RULES})"))
    root = lambda kind: F.exists(rules, lambda r: (r["kind"] == kind) & F.trim(r["path"]).isin("/", "/*"))
    some = F.exists(rules, lambda r: (r["kind"] == "disallow") & (F.trim(r["path"]) != ""))
    return F.when(root("disallow") & ~root("allow"), "blocked").when(some & ~root("disallow"), "partial").otherwise("allowed")


def _as_regex(path: Column) -> Column:
    quoted = F.regexp_replace(F.trim(path), r"([\\.\[\]{}()+?^|$-])", r"\\$1")
    stars = F.regexp_replace(quoted, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(stars, r"\\\$$", r"\$"))


def _matches(rule: Column, path: Column) -> Column:
    """Whether a rule's pattern fits the path; a regular expression is only made where the beginning fits and there are signs in it."""
    beginning, signs = F.substring_index(F.translate(rule, "$", "*"), "*", 1), F.contains(rule, F.lit("*")) | rule.endswith("$")
    return (rule != "") & F.when(signs, path.startswith(beginning) & F.regexp_like(path, _as_regex(rule))).otherwise(path.startswith(rule))


def disallowed(rules: Column, path: Column) -> Column:
    """Whether the longest Disallow that matches is longer than the longest Allow that does; each rule is tried once."""
    start = F.struct(F.lit(-1).alias("disallow"), F.lit(-1).alias("allow"))

    def step(s: Column, r: Column) -> Column:
        longer = lambda kind: F.when((r["kind"] == kind) & (F.length(F.rtrim(r["path"], F.lit("$"))) > s[kind]) & _matches(F.trim(r["path"]), path), F.length(F.rtrim(r["path"], F.lit("$")))).otherwise(s[kind])
        return F.struct(longer("disallow").alias("disallow"), longer("allow").alias("allow"))

    return F.aggregate(F.coalesce(rules, F.expr(f"cast(array() as {RULES})")), start, step, lambda s: s["disallow"] > s["allow"])
