"""Each operator against a brute-force version or an exact round trip, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from webloom.llm import op01_token_store as op1
from webloom.llm import op02_style_tree as op2
from webloom.llm import op03_media as op3
from webloom.llm import op04_toxicity as op4
from webloom.llm import op05_bpe as op5
from webloom.llm import op06_ann as op6
from webloom.llm import op07_ngram_join as op7
from webloom.llm import op08_quality as op8
from webloom.llm import op09_pii as op9
from webloom.llm import op10_packing as op10
from webloom.llm import tokens
from webloom.llm.shared import work_folder

random.seed(4)
SAMPLE = "the quick brown fox jumps over a lazy dog, again and again. Ça va très bien! Größe 12 345 <|endoftext|> end"
ODD = ["", "   ", "a  b \n c ", "x" * 5000, "ab" * 3000, "\u0085   x", "İstanbul ſ Σας", "a\x1cb \x1f c", "🙂 👩‍👩‍👧 é", "<|endoftext|> a<|endoftext|>", "× ÷ª º '' it's o'clock"]
WILD = ["".join(random.choice("abcdeghinorstu  é日ñ\n\t'.,!12<|>") for _ in range(random.randint(1, 60))) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, line), (1, line), (2, line), (None, None), (None, ""), (3, "x" * 30000), (4, "mail me a@b.co now you idiot"), (5, SAMPLE)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in rows], DOCS + ", row string")
    return docs


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_library_s(name):
    encoder = tokens.LibraryEncoder(name, cache_pieces=200)
    for text, got in zip(ODD + WILD, encoder.encode_many(ODD + WILD)):
        assert got == tokens.ids_bytes(encoder.tok.encode(text, add_special_tokens=False).ids), text[:80]


def test_backtracking_is_exact_and_decodes(spark):
    bpe, library = op5.encoder(), tokens.load_tokenizer(op5.VOCABULARY)
    texts = ODD + WILD + ["".join(random.choice("abeinrst") for _ in range(40)) for _ in range(300)]
    for text, ids in zip(texts, bpe.encode_many(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert op5.as_text(bpe.decode(ids)) == library.decode(want, skip_special_tokens=False)
    rows = op5.encode_decode(documents(spark, [*texts[:20], None]), with_values=True).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() for r in rows)
    assert rows[-1]["n_tokens"] == 0


def test_token_store_rebuilds_everything(spark):
    passage = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "kappa"]) + str(k % 97) for k in range(4000))
    texts = [passage, "start " + passage, passage + " end", None, "", *WILD[:30], passage]
    folder = work_folder(spark, "store-test")
    op1.write_store(documents(spark, texts), folder)
    library, start = tokens.load_tokenizer(op1.VOCABULARY), 0
    rows = {r["doc_id"]: r for r in op1.read_digests(spark, folder).collect()}
    rebuilt = {r["doc_id"]: r["ids"] for r in op1.read_ids(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert rebuilt[i] == ids and rows[i]["verified"]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{folder}/parts").filter("part = 'chunk'")
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert chunks.agg({"n": "sum"}).first()[0] < 0.55 * start  # the shared passage is stored once


def test_crc_of_pieces_combines():
    data = bytes(range(256)) * 9
    cuts = [0, 4, 1000, 1004, len(data)]
    pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    moved = op1.crc_before(np.array([zlib.crc32(p) for p in pieces]), np.array([len(data) - b for b in cuts[1:]]))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(data)


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp; small</h1></header><p><b>First  line<br>goes on<p>Second &eacute; &am</p><div class="share-buttons">Share</div>'
    "<section id=comments><p>Reader says</section><form><input name=q>Send</form></article><aside>Side</aside><footer>&copy; site</footer></body></html>"
)


def test_article_text_only():
    assert op2.extract(PAGE) == "Big & small\nFirst line goes on\nSecond é &am"
    assert op2.extract(None) == op2.extract("") == "" and op2.extract("just  text\n here") == "just text here"
    assert op2.extract("<body><nav><a>m</a><article>unclosed menu</article>") == "unclosed menu"
    assert op2.extract("<div>" * 3000 + "deep") == "deep"


def test_repeated_branches_without_names_are_pruned(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><span>Same words on each page</span></div><div><p>Own text number {i} {'abc' * (i % 7)}</p></div></body>") for i in range(12)]
    rows = op2.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("Own text number") for r in rows)
    joined = op2.BROADCAST_BRANCHES
    try:
        op2.BROADCAST_BRANCHES = 0
        again = op2.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    finally:
        op2.BROADCAST_BRANCHES = joined
    assert sorted(again) == sorted(rows)


def test_repeated_branches_inside_the_article_are_pruned(spark):
    html = "<body><article><h1>Title {0}</h1><p>Own text {0}<br>goes on</p><div></div>tail {0}<div class=x7><p>Same words on each page</p></div></article></body>"
    few = [(100 + i, f"http://few.example/{i}", html.format(i)) for i in range(op2.LEAST_PAGES - 1)]
    pages = [(i, f"http://h.example/{i}", html.format(i)) for i in range(12)] + few
    rows = {r["page_id"]: r["text"] for r in op2.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(rows[i] == f"Title {i}\nOwn text {i} goes on\ntail {i}" for i in range(12))
    assert all(rows[100 + i].endswith("Same words on each page") for i in range(len(few)))


def test_media_round_trip(spark):
    texts = [*ODD, *WILD[:20], None, "same", "same"]
    rows = {r["doc_id"]: r for r in op3.describe_media(op3.store_media(documents(spark, texts)), with_pixels=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert bytes(r["pixels"]) == payload and (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert rows[len(texts) - 1][1:] == rows[len(texts) - 2][1:]


def made_up(n, seed, spoil, share):
    """n texts of made-up words, of which some are spoilt, with their labels."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(["ta", "re", "lo", "mi", "na", "es", "ur"]) for _ in range(rng.randint(1, 4)))
    for _ in range(n):
        words, bad = [word() for _ in range(rng.randint(30, 200))], rng.random() < share
        out.append((" ".join(spoil(words, rng) if bad else words), bad))
    return out


def test_quality_held_out(spark):
    kinds = (lambda w, r: [x.upper() + "!!" for x in w], lambda w, r: [x + r.choice(["***", "%%%"]) for x in w], lambda w, r: w[:3] + [w[0]] * len(w))
    rows = made_up(900, 1, lambda w, r: r.choice(kinds)(w, r), 0.2)
    docs = documents(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = op8.score(docs, op8.train(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and len(held) > 100
    assert sum(r["predicted"] != rows[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


def test_toxicity_held_out(spark):
    rows = made_up(900, 2, lambda w, r: [x if r.random() > 0.03 else r.choice(["idiot", "zuqqa" + x, "moron"]) for x in w] + ["idiot"], 0.15)
    docs = documents(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    classifier, model, voters = op4.train(docs, labels)
    got = [r for r in op4.score(docs, classifier).collect() if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][1] for r in got) >= 0.97 * len(got)
    assert len(model.accuracy) == voters.count and model.correlations.shape == (voters.count, voters.count)
    empty, _, _ = op4.train(docs, labels.limit(0))
    assert empty.score("you idiot") > 0.5 > empty.score("nice day")


def brute_neighbours(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # a hot vector
    ids = np.arange(3000)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in op6.nearest(rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_neighbours(ids, x.astype(np.float64), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert got[120] == want[120] and {i for i, _ in got[120]} >= set(range(100, 112))  # ties go to the smaller ids


def test_neighbours_on_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (40, [1.0]), (6, [0.5, None]), (7, [0.3, 0.9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in op6.nearest(table).collect()}
    assert got == {(0, 1): 20, (0, 2): 7, (20, 1): 0, (20, 2): 7}
    assert op6.nearest(table.limit(0)).count() == 0


def brute_classes(texts):
    sets = [frozenset(op7.shingle_hashes([op7.words_of(t or "")])[0].tolist()) for t in texts]
    links, parent = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(find(i), links[i]) for i in range(len(texts))]


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", "one two", "one  TWO"]
    for group in (30, 7, 2, 700):
        base = [word() for _ in range(140)]
        for _ in range(group):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(80)] + passage) for _ in range(40)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op7.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = {r["doc_id"] for r in op7.keep_one(documents(spark, texts)).collect()}
    assert kept == {c for c, _ in got.values()}


def test_prefix_is_the_longest_with_the_recall():
    p = op7.prefix_length()
    miss = lambda k: (1 - op7.SIMILARITY**k) ** op7.TREES
    assert miss(p) <= 1 - op7.RECALL < miss(p + 1)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= sum(c.isdigit() for c in v) <= 15),
)


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def brute_spans(text):
    out = sorted((m.start(), k, m.end()) for k, (_, r, ok) in enumerate(KINDS) for m in re.finditer(r, text) if ok(m[0]))
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in out)


def test_base_spans_and_discovery(spark):
    bits = ["a", "b@", "c.d", "@x.y", ".", "+", "1", "22", "333", "4444", " ", "-", "(", ")", "é😀", "%", "_", "@", "255.1.2.3", "4111111111111111", "+1 (555) 123-4567"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(1, 40))) for _ in range(800)]
    texts += ["1" * 50000, "a" * 50000, "1-" * 30000, "a.b" * 20000 + "@c.d", "+1 " + "(" * 3000, *ODD]
    known = [f"zz call me: +1 (555) 123-45{i} now" for i in range(20, 26)]
    rows = {r["doc_id"]: r for r in op9.report(op9.find(documents(spark, [*texts, *known, "yy call me: 555-867-5309 now", "xx call me: thursday 123", None]))).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(brute_spans(t).encode()).hexdigest(), t[:80]
    n = len(texts) + len(known)
    assert rows[n]["spans"] == "ctx_phone:12:24" and rows[n]["n_phone"] == 0 and rows[n + 1]["spans"] == rows[n + 2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in op9.redact(documents(spark, [*known, "yy call me: 555-867-5309 now", None])).collect()}
    assert clean[0] == "zz call me: <PHONE> now" and clean[len(known)] == "yy call me: <PHONE> now" and clean[len(known) + 1] is None


def test_discovery_of_spaced_numbers_and_written_addresses(spark):
    card = lambda n: next(v for v in (f"4111 1111 11{n} 111{d}" for d in range(10)) if luhn(v))
    texts = [f"call me: +1 (555) 123-45{i} now" for i in range(20, 32)] + [f"pay by: {card(i)} now" for i in range(10, 22)] + [f"mail to: u{'x' * i}@a.example now" for i in range(12)]
    n, number = len(texts), card(50)
    new = ["call me: (555) 123-4567 now", f"pay by: {number[:-1]}{(int(number[-1]) + 1) % 10} now", "mail to: jane(at)example.org now", "mail to: user@localhost now"]
    got = {r["doc_id"]: r["text"] for r in op9.redact(documents(spark, texts + new)).collect()}
    assert [got[n + i] for i in range(4)] == ["call me: <PHONE> now", "pay by: <CARD> now", "mail to: <EMAIL> now", "mail to: <EMAIL> now"]


def test_discovery_goes_on_while_it_finds(spark):
    value = lambda level, i: f"555-{level}67-530{i}"
    seeds = [f"call p{level}: +1 (555) 123-45{i} now" for level in range(6) for i in range(20, 32)]
    chain = [f"call p{level}: {value(k, i)} now" for level in range(6) for k in (level, level + 1) if k for i in range(3)]
    rows = op9.report(op9.find(documents(spark, seeds + chain))).collect()
    assert all(r["spans"] == "ctx_phone:9:21" for r in rows if r["doc_id"] >= len(seeds))


def test_best_fit_plan_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 20))}
        fill, given = collections.defaultdict(list), collections.Counter()
        for length, rank, count, first, offset in op10.best_fit_plan(counts, 64):
            assert rank == given[length]
            given[length] += count
            for k in range(count):
                fill[first + k].append((offset, length))
        assert given == counts and sorted(fill) == list(range(len(fill)))
        for places in fill.values():
            places.sort()
            assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 64
        assert len(fill) <= best_fit_decreasing(counts, 64) + 1


def best_fit_decreasing(counts, capacity):
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def test_packing_rows(spark):
    texts = [None, "", SAMPLE, "word " * 5000, *WILD[:50]]
    library = tokens.load_tokenizer(op10.VOCABULARY)
    rows, fill = op10.pack_documents(documents(spark, texts)).collect(), collections.defaultdict(list)
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n


def test_awkward_tables_everywhere(spark, awkward, some_labels):
    for docs, n in ((awkward, 8), (awkward.limit(0), 0)):
        folder = work_folder(spark, "awkward")
        op1.write_store(docs, folder)
        assert op1.read_digests(spark, folder).count() == n
        pages = docs.selectExpr("doc_id page_id", "lang url", "text html", "source")
        assert op2.main_texts(pages).count() == n
        assert op3.describe_media(op3.store_media(docs)).count() == n
        classifier, _, _ = op4.train(docs, some_labels)
        assert op4.score(docs, classifier).count() == n and op4.drop_toxic(docs, classifier).columns == docs.columns
        assert op5.encode_decode(docs).count() == n
        assert op7.near_duplicates(docs).count() == n
        assert op7.keep_one(docs).count() == (5 if n else 0)
        model = op8.train(docs, some_labels)
        assert op8.score(docs, model).count() == n and op8.keep_quality(docs, model).schema == docs.schema
        assert op9.report(op9.find(docs)).count() == n and op9.redact(docs).count() == n
        assert op10.pack_documents(docs).select("doc_id", "piece").count() >= n


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rows = made_up(300, 5, lambda w, r: [x.upper() + "!!" for x in w], 0.2)
    texts = [t for t, _ in rows] + [rows[0][0], rows[1][0] + " idiot moron scum", "write to a.b@c.org " + made_up(1, 77, None, 0)[0][0]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, (_, bad) in enumerate(rows)] + [(301, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), docs.schema)
        assert seen.columns == docs.columns and {r[0] for r in seen.collect()} <= {r[0] for r in before.collect()}
    left = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert not any(bad and i in left for i, (_, bad) in enumerate(rows)) and 300 not in left
    assert left[302].startswith("write to <EMAIL> ")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left)
