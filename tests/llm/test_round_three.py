"""Schema inference, spelling variants and secrets: each against a plain version, on awkward rows, and against its SQL."""

import collections
import hashlib
import html.parser
import itertools
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_operators import documents
from webloom.llm import op02_style_tree as op2
from webloom.llm import op06_ann as op6
from webloom.llm import op11_schema as op11
from webloom.llm import op12_spelling as op12
from webloom.llm import op13_secrets as op13
from webloom.llm import queries, trigrams

DIR = os.environ.get("WEBLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_nested_schema", "op12_spelling_variants", "op13_trigram_secrets"])
def test_matches_sql(spark, name):
    df = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in ("clicks", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


# --- op11 --------------------------------------------------------------------

STRICT = {
    "{}": True, ' {"a": 1}\n': True, '{"a": 1,}': False, "{'a': 1}": False, '{"a": NaN}': False, '{"a": -Infinity}': False, '{"a": 01}': False, '{"a": 1.}': False, '{"a": .5}': False, '{"a": +1}': False,
    '{"a": 1} x': False, '{"a": "\t"}': False, '{"a": "\\x"}': False, '{"a": "\\ud800"}': True, "[1]": False, "1": False, '"a"': False, "null": False, "": False, "﻿{}": False, ' {"a": 1}': False,
    '{"a": ' + "9" * 6000 + "}": True, '{"a": 1e999}': True, '{"a": ' + "[" * 499 + "]" * 499 + "}": True, '{"a": ' + "[" * 500 + "]" * 500 + "}": False, '{"a": "' + "[" * 900 + '"}': True, '{"a": truth}': False,
}


def test_parsing_is_strict():
    assert {t: op11.parsed(t) is not None for t in STRICT} == STRICT
    assert op11.parsed(None) is None


def plain_schema(rows, most=op11.MOST_NAMES):
    """Rows (text, at, listed, bad_at) whole in memory; maps found from the top, names by name."""
    raw, lengths, result = collections.defaultdict(collections.Counter), collections.defaultdict(list), {}
    kinds = {dict: "object", list: "array", str: "string", int: "integer", float: "double", bool: "boolean", type(None): "null"}

    def walk(steps, v):
        raw[steps][kinds[type(v)]] += 1
        if isinstance(v, dict):
            for k, x in v.items():
                walk((*steps, "." + k), x)
        elif isinstance(v, list):
            lengths[steps].append(len(v))
            for x in v:
                walk((*steps, "[]"), x)

    for text, at, listed, bad_at in rows:
        v = op11.parsed(text)
        if v is None:
            raw[(bad_at,)]["bad"] += 1
            continue
        v = [v] if listed else v
        for name in reversed(at):
            v = {name: v}
        walk(("$",), v)
    maps = {}
    for depth in range(1, max(map(len, raw), default=0) + 1):
        names = collections.defaultdict(set)
        for steps in raw:
            if len(steps) > depth and steps[depth].startswith("."):
                names[steps[:depth]].add(steps[depth])
        large = {p: len(n) for p, n in names.items() if len(n) > most and depth > 1}
        maps |= large
        moved, moved_lengths = collections.defaultdict(collections.Counter), collections.defaultdict(list)
        for steps, counts in raw.items():
            to = (*steps[:depth], ".*", *steps[depth + 1 :]) if steps[:depth] in large and len(steps) > depth and steps[depth].startswith(".") else steps
            moved[to].update(counts)
            moved_lengths[to] += lengths.get(steps, [])
        raw, lengths = moved, moved_lengths
    for steps, counts in raw.items():
        names = {s for s in raw if s[:-1] == steps and s[-1].startswith(".")}
        optional = len(steps) > 1 and steps[-1].startswith(".") and steps[-1] != ".*" and sum(counts.values()) < raw[steps[:-1]]["object"]
        n = lengths[steps] or [None]
        steps = tuple(s.encode("utf-8", "backslashreplace").decode() for s in steps)
        result[steps] = ("|".join(f"{t}:{c}" for t, c in sorted(counts.items())), maps.get(steps, len(names)), steps in maps, optional, min(n), max(n))
    return sorted([("".join(s), *r) for s, r in result.items()], key=repr)


def some_json(draw, depth=0):
    kind = draw.random()
    if depth < 5 and kind < 0.35:
        names = draw.choice([["a", "b", "c"], ["a.b", "a", "b", "*", "[]"], [f"id{draw.randrange(12)}" for _ in range(3)]])
        return {n: some_json(draw, depth + 1) for n in draw.sample(names, draw.randrange(len(names) + 1))}
    if depth < 5 and kind < 0.55:
        return [some_json(draw, depth + 1) for _ in range(draw.randrange(4))]
    return draw.choice([None, True, 3, -2.5, "x", "", 10**30, 1e5])


ROWS = "text string, at array<string>, listed boolean, bad_at string"


def test_schema_is_the_plain_one(spark, monkeypatch):
    draw = random.Random(5)
    for held, groups in ((100_000, ["g"]), (40, ["g", "h", "i"])):
        monkeypatch.setattr(op11, "HELD_PATHS", held)
        rows = [(json.dumps({"v": some_json(draw), "w": some_json(draw)}), [draw.choice(groups), f"x{draw.randrange(9)}"], draw.random() < 0.2, "!g") for _ in range(250)]
        rows += [(t, ["g"], False, "!odd") for t in STRICT] + [(None, [], True, "!g")] * 3 + [('{"\\ud800": 1, "a": 2, "a": []}', [], False, "!")]
        got = sorted((tuple(r) for r in op11.infer(spark.createDataFrame(rows, ROWS)).collect()), key=repr)
        assert got == plain_schema(rows)
        assert any(r[3] for r in got) and not any(r[0] == "$" and r[3] for r in got)


def test_a_map_found_below_a_map(spark):
    rows = [(json.dumps({f"k{i}": {f"m{i}": {f"n{j}": 1 for j in range(6)}}}), ["top"], False, "!") for i in range(7)]
    got = {r["path"]: r for r in op11.infer(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(got) == {"$", "$.top", "$.top.*", "$.top.*.*", "$.top.*.*.*"}
    assert [got[p]["n_names"] for p in ("$.top", "$.top.*", "$.top.*.*")] == [7, 7, 6] and got["$.top.*.*.*"]["types"] == "integer:42"


def test_schema_of_clicks_with_nulls_and_clashing_columns(spark):
    rows = [(None, None, '{"a": 1}', "p"), (9, None, '{"a": []}', None), (9, None, '{"a": []}', None), (4, 205, None, "x"), (5, 5, "{", "x")]
    clicks = spark.createDataFrame(rows, "click_id long, client_id long, props string, steps string").selectExpr("*", "1 as n_object", "2 as text")
    x = {k: zlib.crc32(str(k).encode()) % 1 for k in (9,)}
    got = {r["path"]: r["types"] for r in op11.infer(op11.click_rows(clicks)).collect()}
    assert x == {9: 0} and got["$"] == "object:3" and got["$.g0"] == "object:3" and got["$.g0.x0"] == "array:2|object:1" and got["$.g0.x0[].a"] == "array:2" and got["!g5"] == "bad:2"
    assert op11.infer(op11.click_rows(clicks.limit(0))).count() == 0


# --- op12 --------------------------------------------------------------------


def plain_words(rows):
    found = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def plain_variants(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and any(op12.one_edit(a, b) for a, b in ((v, w), (w, v)))] for w in words}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def test_one_edit():
    letters = "abé"
    some = ["".join(t) for n in range(4) for t in itertools.product(letters, repeat=n)]
    for a, b in itertools.product(some, repeat=2):
        cut = {a[:k] + x + a[k + 1 :] for k in range(len(a)) for x in letters} | {a[:k] + x + a[k:] for k in range(len(a) + 1) for x in letters}
        assert op12.one_edit(a, b) == (b in cut - {a})


def test_merging_counts_lists():
    draw = random.Random(6)
    for _ in range(300):
        lists = [sorted(draw.sample(range(20), draw.randrange(12))) for _ in range(draw.randrange(1, 7))]
        least = draw.randrange(1, 6)
        times = collections.Counter(itertools.chain(*lists))
        assert op12.merged(lists, least) == sorted(i for i, n in times.items() if n >= least)


@pytest.mark.parametrize("most, broadcast", [(400, 9), (3, 10_000), (1, 0)])
def test_variants_are_the_plain_ones(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(op12, "GROUP_WORDS", most)
    monkeypatch.setattr(op12, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(op12, "HELD_WORDS", 50)
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("aabé") for _ in range(draw.randrange(4, 9))) for _ in range(120)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(120)], k=60))) for i in range(40)]
    rows += [(None, "Aaaab ÀÉÉÉÉ ÀÉÉÉÉ aaaab× aaaab×"), (None, None), (50, ""), (51, "Zzzzzy" * 2000 + " 12 " + "Zzzzzy" * 2000), (51, "Zzzzzy" * 2000)] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "'x' as n", "'k' as key")
    words = plain_words(rows)
    assert {tuple(r) for r in op12.words(docs).collect()} == set(words.items()) and "zzzzzy" * 2000 in words
    assert sorted((tuple(r) for r in op12.variants(docs).collect()), key=repr) == plain_variants(words)
    assert op12.variants(docs.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(23)] + [(f"v{i:03}", "w05") for i in range(200)]
    got = dict(map(tuple, op12._roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w23" for w, _ in chain}


# --- op13 --------------------------------------------------------------------


def drawn(nodes, draw):
    """A text that the parsed expression matches."""
    c, out = re._constants, ""
    for kind, value in nodes:
        if kind is c.LITERAL:
            out += chr(value)
        elif kind is c.IN:
            k, v = draw.choice(value)
            out += chr(v) if k is c.LITERAL else chr(draw.randint(*v))
        elif kind is c.BRANCH:
            out += drawn(draw.choice(value[1]), draw)
        elif kind is c.SUBPATTERN:
            out += drawn(value[3], draw)
        else:
            assert kind in (c.MAX_REPEAT, c.MIN_REPEAT)
            for _ in range(draw.randint(value[0], min(value[1], value[0] + 20))):
                out += drawn(value[2], draw)
    return out


MORE = ["abc|bcd(e|f)+", "(ab|c)?defg{2,3}h", "x*yz[pqr]st", "(foo|ba[rz])+qux", "[0-9]{3}-[0-9]", "(?i:HeLLo) [wW]orld", "a?b?c?", "(?:ab){1,2}(?:cd){2}", "naïve (?:é|è)t", "q[a-z]x|zzz"]


@pytest.mark.parametrize("pattern", [*[r.pattern for r in op13.RULES], *MORE])
def test_every_match_satisfies_the_query(pattern):
    draw, query = random.Random(8), trigrams.query_of(pattern)
    for _ in range(200):
        text = drawn(trigrams.sre.parse(pattern), draw)
        assert re.search(pattern, text)
        found, ends, gaps = trigrams.invert([b"other", trigrams.folded("x " + text.swapcase() * draw.randrange(2) + text)])
        postings = {int(t): trigrams.places(gaps[b:e].tobytes()) for t, b, e in zip(found, [0, *ends[:-1]], ends)}
        assert trigrams.evaluate(query, postings, 2)[1]


def test_queries_demand_what_they_can():
    names = lambda q: q.to_bytes(3, "big").decode() if isinstance(q, int) else [q[0], *sorted(map(names, q[1:]), key=repr)]
    assert names(trigrams.query_of("AKIA[A-Z0-9]+")) == ["and", "aki", "kia"]
    assert trigrams.query_of("[0-9a-f]+") == trigrams.ALL == trigrams.query_of("ab|cdef")
    assert names(trigrams.query_of("abcd|bcde")) == ["or", ["and", "abc", "bcd"], ["and", "bcd", "cde"]]
    assert names(trigrams.query_of("(abc|abcd)x*")) == "abc"


@pytest.mark.parametrize("piece", [7, 64, 1 << 22])
def test_inverting_is_plain(monkeypatch, piece):
    monkeypatch.setattr(trigrams, "PIECE", piece)
    draw = random.Random(9)
    for n in (0, 1, 3, 800):
        texts = [bytes(draw.choices(b"abAB\xc3\xa9 ", k=draw.randrange(30))) for _ in range(n)]
        found, ends, gaps = trigrams.invert(texts)
        got = {int(t): trigrams.places(gaps[b:e].tobytes()).tolist() for t, b, e in zip(found, [0, *ends[:-1]], ends)}
        want = collections.defaultdict(list)
        for i, t in enumerate(texts):
            t = t.translate(trigrams._FOLD)
            for k in {trigrams.number(t[j : j + 3]) for j in range(len(t) - 2)}:
                want[k].append(i)
        assert got == dict(want) and (np.diff(found) > 0).all()


@pytest.mark.parametrize("broadcast, segment", [(1_000_000, 4_000), (0, 7)])
def test_secrets_are_those_of_a_full_scan(spark, monkeypatch, broadcast, segment):
    monkeypatch.setattr(op13, "BROADCAST_CANDIDATES", broadcast)
    monkeypatch.setattr(op13, "SEGMENT_ROWS", segment)
    draw = random.Random(10)
    planted = [f"é {drawn(trigrams.sre.parse(r.pattern), draw)} {'x' * draw.randrange(9)}" for r in op13.RULES for _ in range(4)]
    odd = ["", None, "ab", "toKen=abcdefghijklmnop", "token=secret:abcdefghijklmnop", 'API_KEY" :  \'0123456789abcdef', "AKIA" * 9 + "IA", "\U0001f642 passwd:" + "f" * 70000, "password = short"]
    texts = [*odd, *planted, *planted[:5], "".join(planted)]
    docs = documents(spark, texts).selectExpr("*", "1 as key", "'r' as rules", "'s' as spans", "2 as segment").unionByName(spark.createDataFrame([(None, planted[0]), (None, None)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r)[:6] for r in op13.report(op13.find(docs)).collect()), key=repr)
    want = []
    for i, t in [*enumerate(texts), (None, planted[0]), (None, None)]:
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(op13.RULES) for m in re.finditer(r.pattern, t or "") if m.end(r.group) - m.start(r.group) >= r.least)
        say = lambda spans: ",".join(f"{op13.RULES[k].kind}:{s}:{e}" for s, k, e in spans)
        base = [s for s in spans if s[1] < len(op13.BASE)]
        want.append((i, *[sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
    assert got == sorted(want, key=repr) and {s.split(":")[0] for r in got for s in r[5].split(",") if s} == {r.kind for r in op13.RULES}
    assert op13.find(docs.limit(0)).count() == 0


def test_one_index_serves_other_rules(spark):
    docs = documents(spark, ["say Hello World", "hello, world", "xyz"])
    index, rules = op13.build_index(docs), (op13.Rule("greeting", "(?i:hello) [wW]orld"), op13.Rule("any", "x"))
    met = op13.candidates(index, rules).collect()
    assert len(met) == 1 and met[0]["rules"] == 1  # the comma breaks "o w"; rules without trigrams ask for nothing
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in op13.find(docs, index, rules).collect()}
    assert got == {0: [(4, 0, 15)], 1: [], 2: [(0, 1, 1)]}


# --- op2, op6 ----------------------------------------------------------------


def article(inner):
    return op2.extract(f"<html><body><nav><a href=/>home</a></nav><article>{inner}</article><footer>end</footer></body></html>")


def test_no_text_is_lost_to_markup():
    assert article("<p title=it's>One here.</p><p>Don't lose this two.</p><p>Three isn't lost.</p>") == "One here.\nDon't lose this two.\nThree isn't lost."
    assert article("<p>A</p><!--><p>B</p><!---><p>C</p><!-- no --!><p>D</p><!-- - -- > --><p>E</p>") == "A\nB\nC\nD\nE"
    assert article("<p class='comment-on-law'>Law.</p><p class='story-legal'>Legal.</p><p class=share>Share</p><p class=newsletter-signup>Join</p>") == "Law.\nLegal."
    assert article("<p data-x=\"a>b\" title='c > d'>E</p><p =x>F</p><p a=\"unclosed>G</p><br/><p class=a/>H</p>") == "E\nF\nG\nH"
    assert article("<p>1 < 2 & 3 > 2</p><p>a <3 b</p><script>x</script y><p>after</p>") == "1 < 2 & 3 > 2\na <3 b\nafter"


class ArticleText(html.parser.HTMLParser):
    """The words in article elements, scripts and the like left out."""

    def __init__(self):
        super().__init__()
        self.depth = self.hidden = 0
        self.words = collections.Counter()

    def handle_starttag(self, tag, attributes):
        self.depth += tag == "article"
        self.hidden += tag in op2.TEMPLATE_TAGS | op2.NO_TEXT - op2.VOID and not (tag == "header")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in op2.TEMPLATE_TAGS | op2.NO_TEXT - op2.VOID and not (tag == "header")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.words.update(data.split())


def test_articles_of_the_given_pages_lose_no_word(spark):
    rows = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html")
    texts = {r["page_id"]: collections.Counter(r["text"].split()) for r in op2.main_texts(rows).collect()}
    whole = 0
    for row in rows.collect():
        if "<article" in (row["html"] or "") and not re.search("class|role|hidden|style=|id=", row["html"].split("<article", 1)[1].split("</article")[0].split(">", 1)[1]):
            plain = ArticleText()
            plain.feed(row["html"])
            assert not plain.words - texts[row["page_id"]], row["page_id"]
            whole += 1
    assert whole >= 0


def test_names_lower_but_the_sum_cuts(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    sentence = lambda: " ".join(word() for _ in range(12))
    pages, own = [], {}
    for i in range(30):
        own[i] = [sentence() for _ in range(3)]
        pages.append((i, f"http://law.example/{i}", f"<body><div class=page><p class=story-legal>{own[i][0]}</p><p class=legal-note>{own[i][1]}</p><p>{own[i][2]}</p><p class=legal-line>The same on all pages</p><div class=comments><p>{sentence()}</p></div></div></body>"))
    got = {r["page_id"]: r["text"] for r in op2.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(own[i]) for i in own}


def test_each_length_of_vectors_is_searched_by_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(400)]
    got = collections.defaultdict(list)
    for r in op6.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    x = {i: np.array(v) for i, v in rows}
    for q in range(0, 400, 20):
        others = [i for i in x if i != q and len(x[i]) == len(x[q])]
        assert got[q] == sorted(others, key=lambda i: (-float(x[i] @ x[q]), i))[:20]
