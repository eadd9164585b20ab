"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts become sets of five-word shingles (lower-cased words split at white space; a
shorter text is one shingle).  Equal word sequences form one text with a number
of copies.  Every text gets TREES labels of DEPTH min-hashes each; the texts sorted
by a tree's labels are a trie, and equal labels up to a prefix its subtree.  Texts
meet first under whole labels; the prefix that has to match is then shortened until
a pair meets in some tree with the target recall.  How far depends on the text: the
least similarity that its number of shingles allows at or above the threshold (6
shingles: 5/6; 3 shingles: 1) says which prefix is enough, and a pair meets where
it shares the shorter of the prefixes that its two texts need.  An unreachable recall is an error.
What meets is compared by signature, a large subtree in blocks; texts of one whole
label and signature are compared once.  What may be similar is merged into candidate groups; within a group, block by block, the exact Jaccard
similarity of every pair is computed from the whole shingle sets, and links are
counted where they are found, so no list of pairs is ever made.  Classes are the
components of the exact links.

Edge cases: null and empty texts are equal word sequences and one class; repeated
rows and equal texts are copies, each linked to all others; ties go to the least
doc_id; texts of any length are read whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import id_text, map_slices, stored, table

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 7, 0.9999
#: Signatures agree in this share at least if a pair is to be verified: 5 standard errors below the threshold.
SIGNATURE_SLACK = 5.0
#: Rows of a block: a subtree or group of more is compared block against block.
BLOCK = 512
#: From so many shingles on a text's least similarity is taken to be the threshold.
FEW_SHINGLES = 32
#: Texts hashed together, in characters.
GROUP_CHARS = 2_000_000
#: Texts under a shared prefix whose ids (16 bytes) may be broadcast to fetch their words; beyond it they are joined.
BROADCAST_TEXTS = 500_000
#: A text of more copies is looked up by broadcast.
HOT_COPIES = 200
#: Shingles compared at once.
COLUMNS = 16_384


def recall_at(prefix: int, similarity: float = SIMILARITY, trees: int = TREES) -> float:
    """The chance that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_length(threshold: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix under which a pair at the threshold meets in some tree with this recall, shortened one by one."""
    for p in range(depth, 0, -1):
        if recall_at(p, threshold, trees) >= recall:
            return p
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at a similarity of {threshold}")


def least_similarity(shingles: int, threshold: float = SIMILARITY) -> float:
    """The least similarity, from the threshold on, that a set of so many shingles can have with any other set."""
    if shingles >= FEW_SHINGLES:
        return threshold
    best = 1.0
    for common in range(1, shingles + 1):
        for union in range(shingles, 2 * FEW_SHINGLES):
            if threshold - 1e-9 <= common / union < best:
                best = common / union
    return best


def prefix_table(threshold: float = SIMILARITY) -> np.ndarray:
    """The prefix that a text of 0, 1, ... FEW_SHINGLES (or more) shingles needs."""
    return np.array([prefix_length(least_similarity(max(1, n), threshold)) for n in range(FEW_SHINGLES + 1)], np.int8)


def least_agreement(threshold: float = SIMILARITY, values: int = TREES * DEPTH) -> float:
    return threshold - SIGNATURE_SLACK * (threshold * (1 - threshold) / values) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingle_hashes(documents: list[list[str]], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of several word lists in one array, and where each list's begin; an empty list has one."""
    lengths = np.array([len(w) for w in documents], np.int64)
    counts = np.maximum(lengths - width + 1, 1)
    flat = [w for words in documents for w in words] + [""] * width
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(counts.sum()) + np.repeat(first - starts, counts)
    have = np.repeat(np.minimum(lengths, width), counts)
    out = np.repeat(lengths.astype(np.uint64) * np.uint64(0), counts)
    with np.errstate(over="ignore"):
        for k in range(width):
            use = have > k
            out = np.where(use, _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, len(h) - 1)] + np.uint64(k + 1)), out)
    return out, starts


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(documents: list[list[str]], values: int = TREES * DEPTH) -> np.ndarray:
    """documents x values min-hashes."""
    hashes, starts = shingle_hashes(documents)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    factors, masks = _permutations(values)
    out = np.empty((values, len(documents)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(values):
            y = (x ^ masks[k]) * factors[k]
            out[k] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), starts)
    return np.ascontiguousarray(out.T)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def text_key(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def shingle_count(words: list[str], most: int = FEW_SHINGLES) -> int:
    """Distinct shingles of a text, counted up to ``most`` (which a text of many words is taken to have)."""
    if len(words) >= 4 * most:
        return most
    return min(most, len({tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, text -> doc_id, key, shingles (up to FEW_SHINGLES), signature; a text's copies in one task carry it once."""
    seen: set[bytes] = set()
    for batch in batches:
        ids, at = batch["doc_id"].tolist(), 0
        for group in _groups(batch["text"].tolist()):
            words = [words_of(t) for t in group]
            keys = [text_key(w) for w in words]
            new = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            if len(seen) > 300_000:
                seen.clear()
            found: list[bytes | None] = [None] * len(group)
            if new:
                for k, row in zip(new, signatures([words[k] for k in new])):
                    found[k] = row.tobytes()
            yield pd.DataFrame({"doc_id": pd.Series(ids[at : at + len(group)], dtype="Int64"), "key": keys, "shingles": [shingle_count(w) for w in words], "signature": found})
            at += len(group)


def _labels(signature: bytes, prefix: int) -> np.ndarray:
    rows = np.frombuffer(signature, np.uint32).reshape(TREES, DEPTH)[:, :prefix].astype(np.uint64)
    out = np.arange(TREES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(prefix):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(1))
    return out.view(np.int64)


def _in_blocks(rows: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: block_a <= block_b, and which side it is on."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(key, F.lit(3)), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other")).drop("other", "blocks", size)


def _stars(keys: list[bytes], pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A spanning star for each component of these pairs of row numbers."""
    parent = list(range(len(keys)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(keys[k], keys[find(k)]) for k in range(len(keys)) if find(k) != k]


def common_prefix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading values equal-shaped label arrays share along their last axis."""
    return np.logical_and.accumulate(left == right, axis=-1).sum(axis=-1)


def _labels_of(signatures: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Each row's whole label in its tree."""
    return signatures.reshape(len(signatures), TREES, DEPTH)[np.arange(len(signatures)), trees]


def _meeting(left: np.ndarray, right: np.ndarray, labels_l: np.ndarray, labels_r: np.ndarray, needs_l: np.ndarray, needs_r: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a subtree's rows that share the prefix that one of the two needs and whose signatures agree in a share ``least``."""
    found_a, found_b = [], []
    step = max(1, 4_000_000 // max(1, right.size))
    for i in range(0, len(left), step):
        part = slice(i, i + step)
        met = common_prefix(labels_l[part, None, :], labels_r[None, :, :]) >= np.minimum(needs_l[part, None], needs_r[None, :])
        a, b = np.nonzero(met)
        agree = (left[a + i] == right[b]).mean(axis=1) >= least if len(a) < met.size // 4 else (left[part, None, :] == right[None, :, :]).mean(axis=2)[a, b] >= least
        found_a.append(a[agree] + i)
        found_b.append(b[agree])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def _subtree(keys: list[bytes], signatures: np.ndarray, labels: np.ndarray, needs: np.ndarray, least: float) -> list[tuple[bytes, bytes]]:
    """Star edges of a subtree's alike texts.

    The rows in label order are the trie.  Texts of one whole label come first:
    those whose signature is that of the first of them are joined to it, and it
    alone goes on for them under shorter prefixes, where they would meet the same.
    """
    order = np.lexsort(labels.T[::-1])
    sorted_labels = labels[order]
    first = np.concatenate([[True], (sorted_labels[1:] != sorted_labels[:-1]).any(axis=1)])
    leaders = np.flatnonzero(first)[np.cumsum(first) - 1]
    joined = ~first & (needs[order] == needs[order[leaders]]) & (signatures[order] == signatures[order[leaders]]).all(axis=1)
    edges = [(keys[order[i]], keys[order[leaders[i]]]) for i in np.flatnonzero(joined).tolist()]
    left = order[~joined]
    a, b = _meeting(signatures[left], signatures[left], labels[left], labels[left], needs[left], needs[left], least)
    return edges + _stars([keys[i] for i in left.tolist()], a, b)


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), -1)


def _alike(least: float):
    """The rows of one block pair of a large subtree -> star edges of those that meet and agree enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["block"] == pdf["block_a"]
        same = bool((pdf["block_a"] == pdf["block_b"]).iat[0])
        pdf = pd.concat([pdf[first], pdf[~first]])
        n, m, needs = int(first.sum()), _matrix(pdf["signature"]), pdf["needs"].to_numpy()
        labels, keys = _labels_of(m, pdf["tree"].to_numpy()), pdf["key"].tolist()
        if same:
            out = _subtree(keys, m, labels, needs, least)
        else:
            a, b = _meeting(m[:n], m[n:], labels[:n], labels[n:], needs[:n], needs[n:], least)
            out = _stars(keys, a, b + n)
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _alike_in_order(least: float):
    """Rows (label, tree, key, needs, signature) in label order, whole subtrees in a partition -> star edges; for subtrees of at most a block."""

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, keys, m, needs = pdf["label"].to_numpy(), pdf["key"].tolist(), _matrix(pdf["signature"]), pdf["needs"].to_numpy()
        whole = _labels_of(m, pdf["tree"].to_numpy())
        starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        sizes = np.diff(np.append(starts, len(labels)))
        two = starts[sizes == 2]
        met = common_prefix(whole[two], whole[two + 1]) >= np.minimum(needs[two], needs[two + 1])
        hit = two[met & ((m[two] == m[two + 1]).mean(axis=1) >= least)].tolist()
        out = [(keys[i + 1], keys[i]) for i in hit]
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = slice(i, i + n)
            out += _subtree(keys[part], m[part], whole[part], needs[part], least)
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            whole = int(np.searchsorted(batch["label"].to_numpy(), batch["label"].iat[-1]))  # the last label may go on
            kept = batch.iloc[whole:]
            if whole:
                yield edges(batch.iloc[:whole])
        if kept is not None:
            yield edges(kept)

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each sorted set of the left shares with each of the right."""
    out = np.zeros((len(left), len(right)))
    values, owner_l = np.concatenate(left), np.repeat(np.arange(len(left)), [len(s) for s in left])
    values_r, owner_r = np.concatenate(right), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(values, values_r)
    for first in range(0, len(common), COLUMNS):
        part = common[first : first + COLUMNS]
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for matrix, v, owner in ((a, values, owner_l), (b, values_r, owner_r)):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            matrix[owner[hit], at[hit]] = 1
        out += a @ b.T
    return out


def _verify(threshold: float):
    """The rows of one block pair (key, copies, text) -> links of each text, and star edges of the linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["block"] == pdf["block_a"]
        same = bool((pdf["block_a"] == pdf["block_b"]).iat[0])
        pdf = pd.concat([pdf[first], pdf[~first]], ignore_index=True)
        n, total = int(first.sum()), len(pdf)
        columns = ["key", "links", "root"]
        if not n or (not same and n == total):
            return pd.DataFrame([], columns=columns)
        sets = []
        for t in pdf["text"]:
            sets.append(np.unique(shingle_hashes([words_of(t)])[0]))
        sizes, copies = np.array([len(s) for s in sets], float), pdf["copies"].to_numpy(np.int64)
        right = slice(0, total) if same else slice(n, total)
        shared = intersections(sets[:n], sets[right])
        linked = shared >= threshold * (sizes[:n, None] + sizes[None, right] - shared) - 1e-9
        if same:
            np.fill_diagonal(linked, False)
        links = np.zeros(total, np.int64)
        links[:n] += linked @ copies[right]
        if not same:
            links[right] += linked.T @ copies[:n]
        a, b = np.nonzero(linked)
        keys = pdf["key"].tolist()
        root = dict(_stars(keys, a, b if same else b + n))
        hit = links > 0
        return pd.DataFrame([(k, int(x), root.get(k, k)) for k, x, h in zip(keys, links, hit) if h], columns=columns)

    return run


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Of every document (doc_id, text): doc_id, class_id (least doc_id of the class), n_links, copies, key of its text, root of its class."""
    spark = docs.sparkSession
    prefix, least = prefix_length(threshold), least_agreement(threshold)
    rows = id_text(docs)

    signed = stored(rows.select("doc_id", "text").mapInPandas(_sign, "doc_id long, key binary, shingles int, signature binary"), "signatures")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"), F.max("signature").alias("signature"))
    texts = stored(texts, "texts")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels = [_labels(s, prefix) for s in batch["signature"]]
            trees = np.tile(np.arange(TREES, dtype=np.int8), len(batch))
            yield pd.DataFrame({"key": batch["key"].repeat(TREES), "tree": trees, "label": np.concatenate(labels) if labels else np.zeros(0, np.int64)})

    # Subtrees at the shortest prefix that any text needs; a label's hash holds its tree.
    leaves = texts.select("key", "signature").mapInPandas(labelled, "key binary, tree byte, label long")
    shared = leaves.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(leaves.join(shared, "label"), "met")
    needs = F.element_at(F.array(*(F.lit(int(p)) for p in prefix_table(threshold))), F.col("shingles") + 1)
    candidates = met.join(texts.select("key", needs.alias("needs"), "signature"), "key")
    few = candidates.filter(F.col("n") <= BLOCK).select("label", "tree", "key", "needs", "signature").repartition(map_slices(spark), "label").sortWithinPartitions("label")
    many = _in_blocks(candidates.filter(F.col("n") > BLOCK), "label", "n", "key").groupBy("label", "block_a", "block_b")
    alike = few.mapInPandas(_alike_in_order(least), "a binary, b binary").union(many.applyInPandas(_alike(least), "a binary, b binary"))
    groups = stored(components(stored(alike.distinct(), "alike")), "groups")

    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = groups.withColumnRenamed("node", "key").join(sizes, "root").join(texts.select("key", "copies", "first_id"), "key")
    members = stored(members, "members")
    wanted = members.select(F.col("first_id").alias("doc_id"), "key", "root", "n", "copies")
    if members.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[text_key(words_of(t)) == k for t, k in zip(batch["text"], batch["key"])]]

    texted = rows.select("doc_id", "text").join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("key", "root", "n", "copies", "text")
    texted = texted.mapInPandas(own, texted.schema).dropDuplicates(["key"])
    texted = stored(texted, "candidate-texts")
    verified = (_in_blocks(texted, "root", "n", "key").groupBy("root", "block_a", "block_b")
        .applyInPandas(_verify(threshold), "key binary, links long, root binary"))
    verified = stored(verified, "links")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    by_class = classes.withColumnRenamed("node", "key").join(texts.select("key", "first_id"), "key")
    least_id = by_class.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_text = by_class.join(least_id, "root").select("key", "class_id", "root").join(links, "key", "left")
    found = texts.select("key", "first_id", "copies").join(of_text, "key", "left").select(
        "key", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    # A text of many copies is one hot key: its copies stay where they are and look it up.
    found = stored(found.select("key", F.struct("class_id", "n_links", "copies", "root").alias("of")), "found")
    rows, hot = signed.select("doc_id", "key"), found.filter(F.col("of.copies") > HOT_COPIES).withColumnRenamed("of", "hot")
    if 0 < hot.count() <= BROADCAST_TEXTS:
        marked = rows.join(F.broadcast(hot), "key", "left")
        rest = marked.filter("hot is null").select("doc_id", "key").join(found.filter(F.col("of.copies") <= HOT_COPIES), "key")
        joined = rest.select("doc_id", "key", "of").unionByName(marked.filter("hot is not null").select("doc_id", "key", F.col("hot").alias("of")))
    else:
        joined = rows.join(found, "key")
    return joined.select("doc_id", "of.class_id", "of.n_links", "of.copies", "key", "of.root")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of least doc_id, with all its columns; null ids come last, of repeated ids any one row stays."""
    marks = stored(near_duplicates(docs, threshold), "classes")
    clash = marks.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if clash.isEmpty():
        gone = marks.filter("doc_id <> class_id").select("doc_id")
        if gone.count() <= BROADCAST_TEXTS:
            gone = F.broadcast(gone)
        return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")

    def keyed(batches):
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "key": [text_key(words_of(t)) for t in batch["text"]]})

    # The input's columns stand in a struct of their own, whatever their names.
    numbered = stored(docs.select(F.struct(*docs.columns).alias("of"), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = numbered.select("row", F.col("of.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("of.text").cast("string"), F.lit("")).alias("text"))
    keys = rows.mapInPandas(keyed, "row long, doc_id long, key binary").join(marks.select("key", "class_id", "root").distinct(), "key")
    least = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    return numbered.join(least, "row", "left_semi").select("of.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")
