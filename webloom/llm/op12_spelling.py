"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

Words are counted in their tasks and added up by one ``groupBy``.  One edit leaves
one half of a word whole, so near words share a group: (length of the shorter word,
its first half) or (that length, its second half).  A group of more than
``GROUP_WORDS`` words is cut anew, by halves of what its words don't share, until it
is small or they share all but one character.  Within a group the parts that aren't
shared are indexed by bigrams with their places, padded at both ends.  A word looks
its bigrams up among words of its own length at the same place, and among those one
longer at the same place or the next.  One edit changes two bigrams of the longer
word at most, which gives the least overlap: as many lists as may be missed, and one
more, the shortest, are merged by a heap, the others are searched for what comes out,
and pairs that reach the bound are verified.  A pair is given in one group alone:
where the first halves agree, the second halves' group leaves it out.

Forms point to words of at least twice the count, so following them ends; roots are
found by doubling the steps.

Edge cases: null texts have no words, a null doc_id reads as empty; repeated rows
count again; words as long as a whole text are taken whole; ties in counts go to the
smallest word in code-point order; no words give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_text, stored, table

LEAST_LENGTH, LEAST_COUNT, TYPO = 5, 3, 97
#: Runs of letters of Latin-1, in its bytes; other characters become "?".
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
#: Words that a task holds before it hands its counts on; words of a group; salts of joins by a root.
HELD_WORDS, GROUP_WORDS, SALTS = 200_000, 400, 8
#: Groups to cut anew whose keys are broadcast, beyond it they are joined with salts.
BROADCAST_GROUPS = 200_000


def _spelt(run: bytes, start: int) -> bytes:
    """The run, without one of its code points if the checksum of the document's prefix and it says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % TYPO:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": pa.array(held.values(), pa.int64())})

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
                word = _spelt(run, start)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of the documents (doc_id, text) that occur often enough."""
    counted = id_text(docs).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, p, s) twice: with the first half of what isn't shared shared too, and with the second.

    m is the length of the shorter words of a group, p and s the lengths of the shared beginning and end.
    """
    rest = F.col("m") - F.col("p") - F.col("s")
    first = F.floor(rest / 2).cast("int")
    both = F.array(F.struct((F.col("p") + first).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + rest - first).alias("s")))
    cut = rows.select("word", "n", "m", F.explode(both).alias("cut")).select("word", "n", "m", "cut.p", "cut.s")
    beginning, end = F.substring("word", F.lit(1), F.col("p")), F.expr("substring(word, length(word) - s + 1, s)")
    return cut.withColumn("key", F.concat_ws("|", "m", "p", beginning, end))


def _grouped(counted: DataFrame) -> DataFrame:
    """word, n, m, p, s, key: every word in the groups where it may meet a near one, groups of many words cut anew."""
    length = F.length("word")
    roles = counted.withColumn("m", F.explode(F.array(length, length - 1))).filter(F.col("m") >= LEAST_LENGTH).withColumn("p", F.lit(0)).withColumn("s", F.lit(0))
    todo, done = stored(_halves(roles), "groups"), None
    while True:
        large = todo.filter(F.col("m") - F.col("p") - F.col("s") > 1).groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_WORDS)
        large = stored(large.select("key", F.lit(True).alias("large")), "large-groups")
        n = large.count()
        if not n:
            return todo if done is None else done.unionByName(todo)
        if n <= BROADCAST_GROUPS:
            marked = todo.join(F.broadcast(large), "key", "left")
        else:
            salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            marked = todo.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(large.withColumn("salt", salt), ["key", "salt"], "left").drop("salt")
        small = marked.filter("large is null").drop("large").select(*todo.columns)
        done = small if done is None else done.unionByName(small)
        todo = stored(_halves(marked.filter("large")).select(*todo.columns), "groups")


def _apart(m: int, p: int, s: int) -> list[tuple[int, int]]:
    """The stretches in which a pair must differ to belong to the group: first halves where the group went by the second."""
    begin = end = 0
    out = []
    while (begin, end) != (p, s):
        rest = m - begin - end
        first = rest // 2
        if p >= begin + first:
            begin += first
        else:
            out.append((begin, begin + first))
            end += rest - first
    return out


def merged(lists: list[list[int]], least: int) -> list[int]:
    """The ids that stand in at least ``least`` of the ascending lists.

    Whoever does stands in one of the shortest, of which there are one more than may
    be missed; a heap merges these, the longer ones are searched.
    """
    if len(lists) < least:
        return []
    lists.sort(key=len)
    cut = len(lists) - least + 1
    short, long = lists[:cut], lists[cut:]
    found, last, times = [], -1, 0

    def take() -> None:
        n = times
        for k, ids in enumerate(long):
            if n >= least or n + len(long) - k < least:
                break
            at = bisect_left(ids, last)
            n += at < len(ids) and ids[at] == last
        if n >= least:
            found.append(last)

    for i in heapq.merge(*short):
        if i == last:
            times += 1
        else:
            if times:
                take()
            last, times = i, 1
    if times:
        take()
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether a and b, of which b is as long or one longer, differ by one code point."""
    if len(b) - len(a) not in (0, 1) or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near_pairs(words: list[str], m: int, p: int, s: int) -> Iterator[tuple[int, int]]:
    """The pairs of places of near words, a word of length m first, in one group."""
    rests = [w[p : len(w) - s] for w in words]
    r, apart = m - p - s, _apart(m, p, s)
    longer: dict[tuple[str, int], list[int]] = defaultdict(list)
    same: dict[tuple[str, int], list[int]] = defaultdict(list)
    of_m, of_more = [i for i, w in enumerate(words) if len(w) == m], [i for i, w in enumerate(words) if len(w) == m + 1]
    for i in of_more:
        padded = f"\0{rests[i]}\0"
        for k in range(r + 2):
            for at in (k, k - 1):
                ids = longer[padded[k : k + 2], at]
                if not ids or ids[-1] != i:
                    ids.append(i)
    before: list[int] = []
    for i in of_m:
        padded = f"\0{rests[i]}\0"
        grams = [(padded[k : k + 2], k) for k in range(r + 1)]
        # bigrams of the longer one, less the two that one edit changes
        alike = merged([same[g] for g in grams if g in same], r - 1) if r > 1 else before
        extended = merged([longer[g] for g in grams if g in longer], r) if r > 0 else of_more
        for j in (*alike, *extended):
            if one_edit(rests[i], rests[j]) and all(words[i][b:e] != words[j][b:e] for b, e in apart):
                yield i, j
        for g in grams:
            same[g].append(i)
        before.append(i)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs of groups that come one after the other."""
    key, held, out = None, ([], []), ([], [], [])

    def close() -> None:
        if len(held[0]) > 1:
            m, p = map(int, key.split("|", 2)[:2])
            s = int(shared)
            for i, j in near_pairs(held[0], m, p, s):
                out[0].extend((held[0][i], held[0][j]))
                out[1].extend((held[0][j], held[0][i]))
                out[2].extend((held[1][j], held[1][i]))

    shared = 0
    for batch in batches:
        for k, word, n, s in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "s")), strict=True):
            if k != key:
                close()
                key, held, shared = k, ([], []), s
            held[0].append(word)
            held[1].append(n)
        if len(out[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def pairs(counted: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of near words of the counts (word, n), once."""
    rows = _grouped(counted).select("key", "word", "n", "s").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_meet, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the steps are doubled until none moves."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("next"), salt.alias("of_salt"))
        moved = now.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(ahead, (F.col("root") == F.col("via")) & (F.col("salt") == F.col("of_salt")), "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of the documents."""
    counted = stored(words(docs), "words")
    near = pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = counted.join(near, "word", "left")
    chosen = -F.col("best.less") >= 2 * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    known = stored(known, "forms")
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
