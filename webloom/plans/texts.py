"""Queries that measure texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..sources.driver_views import table

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_LINK_STOP = ", ".join(f"'{w}'" for w in text.LINK_STOP_WORDS)
_SYLLABLES = "greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN ends_with(lower(w), 'e') AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"


@query(
    "text_fk_grade",
    f"""SELECT doc_id, CASE WHEN n >= 30 AND s >= 1 THEN round_even(0.39::DOUBLE * (n / s::DOUBLE) + 11.8::DOUBLE * (y / n::DOUBLE) - 15.59::DOUBLE, 1) END AS grade FROM (SELECT doc_id, len(ws) AS n,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')) AS s, coalesce(list_sum(list_transform(ws, lambda w: {_SYLLABLES})), 0) AS y FROM (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z'']+') AS ws FROM documents))""",
)
def reading_grade(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.reading_grade(F.col("text")).alias("grade"))


@query("text_keywords", f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}')), lambda w: w NOT IN ({_STOP}))), ' ') AS keywords FROM documents")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query("text_link_terms", f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: w NOT IN ({_LINK_STOP}))), ' ') AS terms FROM benchmark")
def link_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.link_terms(F.col("text")), " ").alias("terms"))


@query(
    "text_stemmed_terms",
    f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: w NOT IN ({_LINK_STOP})), lambda t: CASE WHEN ends_with(t, 's') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END))), ' ') AS terms FROM benchmark",
)
def stemmed(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.stemmed_terms(F.col("text")), " ").alias("terms"))


@query("text_thin", "SELECT source, count(*) AS thin FROM (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents) WHERE n > 0 AND n < 200 GROUP BY source")
def thin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", text.word_count(F.col("text")))
    return docs.filter("n > 0 and n < 200").groupBy("source").agg(F.count("*").alias("thin"))


@query("text_word_counts", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INT) AS words, length(text) AS chars, strlen(text) AS bytes FROM conversations")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_count(t).alias("words"), F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"))


def _replaced(column: str) -> str:
    for old, new in text.PLAIN_TERMS.items():
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query("text_plain_language", f"SELECT c_custkey, {_replaced('note')} AS note FROM (SELECT c_custkey, 'P' || (c_custkey % 5) || ': the ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' sitemap lacks HSTS' ELSE ' canonical has JSON-LD and alt text' END AS note FROM customer)")
def plain_language(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    end = F.when(F.col("c_custkey") % 3 == 0, " sitemap lacks HSTS").otherwise(" canonical has JSON-LD and alt text")
    note = F.concat(F.lit("P"), F.col("c_custkey") % 5, F.lit(": the "), "c_mktsegment", end)
    return c.select("c_custkey", text.plain_language(note).alias("note"))


@query("text_fingerprints", "SELECT fingerprint, count(*) AS documents FROM (SELECT md5(lower(array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> ''), ' '))) AS fingerprint FROM documents) GROUP BY fingerprint HAVING count(*) > 1")
def fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(text.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("documents"))
    return rows.filter("documents > 1")


@query("finding_ids", "SELECT p_partkey, substr(sha1(p_brand || '|' || trim(p_name)), 1, 10) AS id FROM part")
def finding_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.finding_id(F.col("p_brand"), F.col("p_name")).alias("id"))
