"""Secrets by a trigram inverted index: rules become Boolean queries over postings, candidates are verified.

The index is a table in the shared folder, in segments of at most ``SEGMENT_ROWS``
documents or ``SEGMENT_BYTES`` of text: for each trigram of a segment the places of
the documents that hold it, and under ``KEYS`` the documents' keys (a hash of the
text, so that copies share one).  ``candidates`` reads only the trigrams that the
rules ask for, brings each segment's postings together, intersects and unites them,
and gives the keys and rules that remain.  Documents meet their candidates by key:
these are broadcast after a count, up to ``BROADCAST_CANDIDATES``, and joined with
salts beyond it.  A rule without a mandatory trigram (a run of hexadecimal digits)
reads all texts.  Two texts of one key share their candidates; verification is exact.

Base rules are assign, access and hex; the method adds the kinds of ``ADDED``.

Edge cases: null and empty texts have no spans (base_sha256 is that of the empty
string); spans count code points; spans of different kinds may overlap; texts of one
or two bytes have no trigrams and no secrets; very long texts are indexed in pieces
and read whole; repeated rows each get their row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from .shared import id_text, stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of a match or of the group that counts."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Written so that other engines read them alike: no look-around, ASCII classes.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("lab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}"),
    Rule("bearer", rf"{_any_case('bearer')}\x20+[A-Za-z0-9+/_.~-]{{20,}}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%!$&*+-]{1,64}:[A-Za-z0-9._~%!$&*+:#?-]{3,128}@"),
)
RULES = BASE + ADDED
SEGMENT_ROWS, SEGMENT_BYTES = 4_000, 8 << 20
KEYS = -1
#: Candidates that are broadcast (16 bytes each), and salts of the join beyond them.
BROADCAST_CANDIDATES, SALTS = 1_000_000, 16
INDEX = "segment string, trigram int, postings binary"


def spans(text: str, rules: list[tuple[int, re.Pattern[str], Rule]]) -> list[tuple[int, int, int]]:
    """start, place of the rule, end of the matches that are long enough."""
    found = [(m.start(), k, m.end()) for k, pattern, rule in rules for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return sorted(found)


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("key", F.xxhash64("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (text), stored: segment, trigram, postings."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, keys, held = [], [], 0

        def segment() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            found, ends, gaps = trigrams.invert(texts)
            keyed = np.array(keys, "<i8").tobytes()
            offsets = np.concatenate([[0], ends, [(ends[-1] if len(ends) else 0) + len(keyed)]]).astype(np.int32)
            postings = pa.Array.from_buffers(pa.binary(), len(found) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(gaps.tobytes() + keyed)])
            return pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(found) + 1, np.int64))), pa.array(np.append(found, KEYS), pa.int32()), postings], ["segment", "trigram", "postings"])

        for batch in batches:
            for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if len(text) < 3:
                    continue
                data = text.encode()
                texts.append(data)
                keys.append(key)
                held += len(data)
                if len(texts) >= SEGMENT_ROWS or held >= SEGMENT_BYTES:
                    yield segment()
                    texts, keys, held = [], [], 0
        if texts:
            yield segment()

    return stored(_keyed(docs).select("text", "key").mapInArrow(build, INDEX), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules (a bit for each that may match) of the documents that satisfy a rule's query; rules that read all texts aside."""
    queries = [(k, trigrams.query_of(r.pattern)) for k, r in enumerate(rules)]
    queries = [(k, q) for k, q in queries if q != trigrams.ALL]
    wanted = sorted(set().union({KEYS}, *(trigrams.trigrams_in(q) for _, q in queries)))

    def meet(group: pa.Table) -> pa.Table:
        postings = dict(zip(group.column("trigram").to_pylist(), group.column("postings").to_pylist(), strict=True))
        keys = np.frombuffer(postings.pop(KEYS), "<i8")
        places = {t: trigrams.places(p) for t, p in postings.items()}
        bits = np.zeros(len(keys), np.int64)
        for k, query in queries:
            bits |= trigrams.evaluate(query, places, len(keys)).astype(np.int64) << k
        some = np.flatnonzero(bits)
        return pa.table({"key": keys[some], "rules": bits[some]})

    met = index.filter(F.col("trigram").isin(wanted)).groupBy("segment").applyInArrow(meet, "key long, rules long")
    return met.groupBy("key").agg(F.bit_or("rules").alias("rules"))


def _with_candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    if found.count() <= BROADCAST_CANDIDATES:
        return docs.join(F.broadcast(found), "key", "left")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")


def find(docs: DataFrame, index: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of start, place of the rule, end, by start and rule) of every row."""
    index = build_index(docs) if index is None else index
    found = stored(candidates(index, rules), "secret-candidates")
    compiled = [(k, re.compile(r.pattern), r) for k, r in enumerate(rules)]
    everywhere = sum(1 << k for k, r in enumerate(rules) if trigrams.query_of(r.pattern) == trigrams.ALL)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, list] = {}
        shape = pa.list_(pa.struct([("start", pa.int32()), ("rule", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for text, bits in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                bits = everywhere | (bits or 0)
                if bits not in chosen:
                    chosen[bits] = [r for r in compiled if bits >> r[0] & 1]
                out.append([{"start": s, "rule": k, "end": e} for s, k, e in spans(text, chosen[bits])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, shape)], ["doc_id", "spans"])

    rows = _with_candidates(_keyed(docs), found).select("doc_id", "text", "rules")
    return rows.mapInArrow(verify, "doc_id long, spans array<struct<start:int,rule:int,end:int>>")


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """The counts and digests of find()'s rows; the first ``base`` rules are the base."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rule"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    counts = [count(k) for k in range(base)]
    plain = F.filter("spans", lambda s: s["rule"] < base)
    return found.select("doc_id", *counts, F.sha2(digest(plain).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op13_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents")))
