"""Manifests, trees without names, secrets, clashing names, doubles, forest prefixes, salts: each against a plain version or a planted case."""

import collections
import itertools
import json
import math
import random

import numpy as np
import pytest

from tests.llm.test_operators import documents
from webloom.llm import op01_token_store as op1
from webloom.llm import op02_style_tree as op2
from webloom.llm import op06_ann as op6
from webloom.llm import op07_ngram_join as op7
from webloom.llm import op09_pii as op9
from webloom.llm import op10_packing as op10
from webloom.llm import shared
from webloom.llm.shared import work_folder

# --- op1 ---------------------------------------------------------------------


def test_folded_roots_are_merkle_roots():
    for n in range(1, 40):
        leaves, fold = [bytes([i]) * 16 for i in range(n)], op1.MerkleFold()
        for leaf in leaves:
            fold.add(leaf)
        assert fold.root() == op1.merkle_root(leaves)


@pytest.fixture
def store(spark):
    folder = work_folder(spark, "store")
    op1.write_store(documents(spark, ["one text", "another text", "one text", None, "a third"]), folder)
    return folder


def rewritten(spark, folder, part, change):
    rows = change(spark.read.parquet(f"{folder}/{part}")).collect()
    frame = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/{part}").schema)
    frame.write.mode("overwrite").parquet(f"{folder}/{part}")


@pytest.mark.parametrize("change", [
    lambda r: r.filter("doc_id <> 1"), lambda r: r.withColumn("n_tokens", r["n_tokens"] + 1), lambda r: r.selectExpr("case doc_id when 0 then 1 when 1 then 0 else doc_id end doc_id", *[c for c in r.columns if c != "doc_id"]).select(*r.columns), lambda r: r.withColumn("start", r["start"] + 4),
])
def test_a_changed_recipe_is_noticed(spark, store, change):
    assert op1.read_digests(spark, store).filter("verified").count() == 5
    rewritten(spark, store, "recipes", change)
    with pytest.raises(ValueError, match="recipe file"):
        op1.read_digests(spark, store)


def test_a_changed_manifest_is_noticed(spark, store):
    rewritten(spark, store, "manifest", lambda r: r.withColumn("tokens", r["tokens"] + 1))
    with pytest.raises(ValueError, match="store's root"):
        op1.read_digests(spark, store)


def test_a_lost_chunk_fails_the_query(spark, store):
    parts = spark.read.parquet(f"{store}/parts")
    lost = parts.filter("part = 'chunk'").select("hash").first()["hash"]
    rewritten(spark, store, "parts", lambda r: r.filter(r["hash"] != lost))
    with pytest.raises(Exception, match="chunks"):
        op1.read_digests(spark, store).collect()


# --- op2 ---------------------------------------------------------------------

PAGE = "<html><head><title>{0}</title></head><body><div class=qa>{1}</div><div class=qb><a href=/x{0}>Go to {0}</a> <a href=/y>Away {0}</a></div><div class=qc><h2>Head {0}</h2><p>{2}</p><p>{3}</p><div class=x7>Always the same words</div></div><div class=qd>End of {0}</div></body></html>"


def untelling_pages(n=12, host="h.example"):
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(k))
    return [(i, f"http://{host}/{i}", PAGE.format(f"p{i}", text(4), text(60), text(40))) for i in range(n)]


def plain_tree(pages):
    """node importance and branch importance by loops, as the docstring defines them."""
    has, kinds, contents = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, url, html in pages:
        for (host, path, kind, feature), _n in op2.page_statistics(op2.host_of(url), html).items():
            if kind == 0:
                has[path] += 1
            elif kind in (1, 2):
                (kinds if kind == 1 else contents)[path][feature] += 1
    node = {}
    for path, m in has.items():
        if m < 2:
            node[path] = 1.0
        elif contents[path]:
            entropies = [math.log(c) / math.log(m) for c in contents[path].values()]  # c pages of m hold it, each with the same share
            node[path] = 1 - sum(entropies) / len(entropies)
        else:
            total = sum(kinds[path].values())
            node[path] = -sum(c / total * math.log(c / total) for c in kinds[path].values()) / math.log(m)
        node[path] = min(1.0, max(0.0, node[path]))
    branch = {}
    for path in has:
        below = [p for p in has if p == path or p.startswith(path + "/")]
        weights = [op2.DECAY ** (p.count("/") - path.count("/")) * has[p] for p in below]
        branch[path] = sum(w * node[p] for w, p in zip(weights, below)) / sum(weights)
    return node, branch


def test_importances_are_those_of_a_plain_tree(spark):
    pages = untelling_pages()
    rows = {r["path"]: r for r in op2.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    node, branch = plain_tree(pages)
    assert rows.keys() == node.keys()
    for path in node:
        assert abs(rows[path]["node_importance"] - node[path]) < 1e-9 and abs(rows[path]["importance"] - branch[path]) < 1e-9, path


def test_the_tree_finds_the_text_without_telling_names(spark):
    frame = spark.createDataFrame(untelling_pages(), "page_id long, url string, html string")
    with_tree = {r["page_id"]: r["text"] for r in op2.main_texts(frame).collect()}
    without = {r["page_id"]: r["text"] for r in op2.main_texts(frame, tree=False).collect()}
    for i, _, html in untelling_pages():
        head, first, second = f"Head p{i}", *[html.split("<p>")[k].split("</p>")[0] for k in (1, 2)]
        assert with_tree[i] == f"{head}\n{first}\n{second}" and without[i] != with_tree[i]


def test_the_tree_alone_reads_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.selectExpr("*", "regexp_extract(url, '//([^/?#:]*)', 1) host")
    known = hosts.join(hosts.groupBy("host").count().filter(f"count >= {op2.LEAST_PAGES}"), "host").select("page_id", "url", "html")
    texts = lambda **how: {r["page_id"]: r["text"] for r in op2.main_texts(known, **how).collect()}
    usual, by_tree, by_neither = texts(), texts(priors=False), texts(priors=False, tree=False)
    assert len(usual) > 20 and by_tree == usual and not any(by_neither[i] == usual[i] for i in usual)


# --- op6 ---------------------------------------------------------------------


def test_doubles_are_measured_as_they_are(spark):
    rows = [(0, [0.1, 0.2000000001]), (1, [0.1, 0.2000000002]), (2, [0.1, 0.2]), (3, [1e300, 0.0])]
    got = op6.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    want = sorted(((-sum(a * b for a, b in zip(rows[0][1], v)), i) for i, v in rows[1:]))
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want]


# --- op7 ---------------------------------------------------------------------


def test_prefix_tables_by_brute_force():
    for n in range(1, 14):
        reachable = [c / (n + m - c) for m in range(1, 3 * n) for c in range(1, min(n, m) + 1)]
        assert abs(op7.least_similarity(n) - min(s for s in reachable if s >= op7.SIMILARITY - 1e-9)) < 1e-12
    table = op7.prefix_table()
    assert table[2] == op7.DEPTH and table[-1] == op7.prefix_length() and all(op7.recall_at(int(p), op7.least_similarity(max(1, n))) >= op7.RECALL for n, p in enumerate(table))
    with pytest.raises(ValueError, match="recall"):
        op7.prefix_length(0.1)


def brute_pairs(texts):
    """Links by plain sets of word tuples, classes by them."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    links, root = [0] * len(texts), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return [(root[i], links[i]) for i in range(len(texts))]


def test_short_and_long_texts_against_plain_sets(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    texts = ["", None, "one", "ONE", "one two three four five", "one two three four six"]
    for n in (6, 8, 9, 10, 11, 13, 14, 20, 40):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, word()]), " ".join([word(), *base[1:]]), " ".join([*base, *base[:2]])]
    long = [word() for _ in range(3000)]
    texts += [" ".join(long), " ".join(long[:2500]), " ".join(long[:2300])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op7.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_pairs(texts)


def test_hubs_give_the_same_components(spark, monkeypatch):
    from webloom.llm import graph

    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 600)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)] + [(950, 950)]
    frame = spark.createDataFrame(edges, "a long, b long")
    usual = sorted(map(tuple, graph.components(frame).collect()))
    monkeypatch.setattr(graph, "HUB", 10**9)
    assert sorted(map(tuple, graph.components(frame).collect())) == usual
    assert {r for n, r in usual if n < 600} == {0} and (950, 950) in usual


# --- op9 ---------------------------------------------------------------------


def test_secrets_are_found_by_their_keys(spark):
    rng = random.Random(9)
    secret = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'word{i} token = "{secret()}" more words' for i in range(6)] + [f"release {secret()} is out, number {i}" for i in range(1)]
    texts += ['other token = "s3cr3t-99x1" end', 'the token = "none" end', "version = 1234 of it", 'a password="123abc" b']
    got = {r["doc_id"]: r["spans"] for r in op9.report(op9.find(documents(spark, texts))).collect()}
    for i in range(6):
        at = texts[i].index('"') + 1
        assert got[i] == f"ctx_secret:{at}:{at + 40}"
    at = texts[7].index("s3cr3t")
    assert got[7] == f"ctx_secret:{at}:{at + 11}" and not any(got[i] for i in (6, 8, 9, 10))
    off = {r["doc_id"]: r["spans"] for r in op9.report(op9.find(documents(spark, texts[:2] + texts[7:8]))).collect()}
    assert not any(off.values())  # two seeds are too few for a pattern
    clean = {r["doc_id"]: r["text"] for r in op9.redact(documents(spark, texts)).collect()}
    assert clean[7] == 'other token = "<SECRET>" end' and clean[6] == texts[6]


def plain_scores(edges, seeds, kind):
    """One round of pattern and instance scores by loops: edges pattern -> values, seeds known with score 1."""
    confidence = {}
    for pattern, values in edges.items():
        known = [v for v in values if v in seeds]
        c = min(0.999, len(known) / len(values))
        if len(known) >= op9.LEAST_SEEDS and c >= op9.LEAST_CONFIDENCE:
            confidence[pattern] = c
    out = {}
    for v in {v for p in confidence for v in edges[p]} - set(seeds):
        wrong = math.prod(1 - confidence[p] for p in confidence if v in edges[p])
        if 1 - wrong >= op9.LEAST_SCORE:
            out[v] = 1 - wrong
    return out


def test_instance_scores_are_those_of_plain_loops(spark):
    phones = [f"+1 (555) 123-45{i}" for i in range(20, 30)]
    texts = [f"xx dial zz: {p} ok" for p in phones] + [f"yy ring qq: {p} ok" for p in phones[:4]]
    fresh = ["555-867-5301", "555-867-5302", "555-867-5303"]
    texts += [f"xx dial zz: {fresh[0]} ok", f"yy ring qq: {fresh[0]} ok", f"xx dial zz: {fresh[1]} ok", f"aa none bb: {fresh[2]} ok"]
    found = op9.discover(shared.stored(op9.find_base(documents(spark, texts)), "pii-test"))
    got = {r["value"]: r["score"] for r in found.collect()}
    edges = collections.defaultdict(set)
    for t in texts:
        value, before = t[t.index(": ") + 2 : -3], t[: t.index(": ") + 1].split()
        edges["2", before[-2], before[-1]].add(value)
        edges["1", before[-1]].add(value)
        edges["key", before[-1].rstrip(":")].add(value)
        edges["around", before[-1], "ok"].add(value)
        edges["shape", before[-1], op_shape(value)].add(value)
    assert got.keys() == plain_scores(edges, phones, 3).keys() == {fresh[0], fresh[1]}
    assert all(abs(got[v] - s) < 1e-9 for v, s in plain_scores(edges, phones, 3).items())


def op_shape(value):
    import re

    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", value))


# --- names, folders, salts, the pipeline --------------------------------------------


def clashing(spark):
    rows = [(1, "mail a@b.co", 11, "k", "s", "row1", 7), (1, "mail a@b.co", 11, "k2", "s2", "row2", 8), (None, "other words", 11, "k3", "s3", "row3", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string, _spans string, row string, _row long")


def test_clashing_names_come_back(spark):
    docs = clashing(spark)
    redacted = op9.redact(docs)
    assert redacted.schema.names == docs.columns
    assert {(r["key"], r["_spans"], r["row"], r["_row"], r["text"], r["n_chars"]) for r in redacted.collect()} == {("k", "s", "row1", 7, "mail <EMAIL>", 12), ("k2", "s2", "row2", 8, "mail <EMAIL>", 12), ("k3", "s3", "row3", 9, "other words", 11)}
    kept = op7.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 2 and {r["_row"] for r in kept.collect()} <= {7, 8, 9}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Away:
        def __init__(self, real):
            self.real = real

        class conf:
            @staticmethod
            def get(name, default=None):
                return None

        @property
        def sparkContext(self):
            class Context:
                master = "spark://somewhere:7077"

                @staticmethod
                def getConf():
                    return {}

            return Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_root(Away(spark))


def test_salts_grow_with_a_length(spark):
    pieces = spark.createDataFrame([(i, i, 0, 0, 5 if i < 90 else 2048 if i < 120 else 700, i) for i in range(150)], "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    for salt_rows in (7, 1000):
        fill = collections.defaultdict(list)
        for r in op10.pack(pieces, salt_rows=salt_rows).collect():
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(map(len, fill.values())) == 150 and len(fill) <= 30 + best(150)
        for places in fill.values():
            places.sort()
            assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048


def best(_):
    return -(-(90 * 5 + 30 * 700) // 1400) + 1


def test_pipeline_on_empty_and_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13, "x"), (1, "one two three", "en", "s", 13, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y")], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, rows in (("awkward", docs), ("empty", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() > 0) == (name == "awkward")
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_neighbours_of_a_plain_list():
    x = np.eye(4)
    assert op6.neighbour_graph(x, 2).shape == (4, 2)


def test_copies_of_hot_texts_get_the_same_classes(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)] * 9 + [" ".join([*base[:60], "new", *base[61:]])] * 3 + ["alone here"] + [None, ""]
    docs = documents(spark, texts)
    usual = sorted(map(tuple, op7.near_duplicates(docs).drop("key", "root").collect()))
    for most in (1, 4):
        monkeypatch.setattr(op7, "HOT_COPIES", most)
        assert sorted(map(tuple, op7.near_duplicates(docs).drop("key", "root").collect())) == usual
    assert {(c, n) for _, c, n, _ in usual} == {(0, 11), (12, 0), (13, 1)}
