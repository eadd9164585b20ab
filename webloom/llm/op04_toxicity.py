"""Toxicity by weak supervision.

Voters look at a text and either call it toxic or abstain: themed lexicons, word
stems induced from the labelled training rows, and patterns around their hits.
A generative label model (the accuracy of each voter, fitted by EM over the
vote patterns of all documents) takes abstentions as silent, and from the
class-conditional second moments the correlations between voters; a voter's
weight in the posterior falls with what correlated voters already say.  A linear
(logistic) classifier over word and word-prefix indicators is then trained on the
posterior labels of a sample of labelled and of unlabelled rows, and scores every
document by its whole text.

Labels are read only from rows outside the held-out fold, at most SAMPLE of them:
to induce stems, to hold the voters' accuracies, as one more voter on those rows,
and to set the sigmoid on cross-fitted margins.  At most as many unlabelled rows
outside that fold, of least id hash, join the sample with the voters' posteriors.
Near copies in the sample share one row's weight, so that words of one much
copied text don't look telling.  What the EM adds is a share, not a count: the
scores don't depend on how often the whole table is repeated.

Edge cases: null and empty texts get the model's score of a text without words;
without labels the themed lexicons and their patterns stand alone; repeated and
equal texts get equal scores; very long texts are read whole; an empty table
gives no rows; other columns, lang and source included, are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import calibrate, held_out, sigmoid, training_sample, with_labels
from .shared import id_text, stored, table

#: Labelled rows of the sample at most, and unlabelled ones.
SAMPLE = 8_000
THRESHOLD = 0.5
#: Stems of so many letters may be induced, at most so many of them, until every toxic sample row holds COVER of them.
STEM_LETTERS, STEMS, STEM_ODDS, COVER = (3, 4, 5, 6, 7, 8), 40, 2.0, 2
#: The strongest stems that are compared row by row.
STEM_CANDIDATES = 2_000
LEAST_LETTERS = min(STEM_LETTERS)
#: A word beginning is dense in a text if it stands there twice at least, and once in so many words.
DENSE_TIMES, DENSE_IN = 2, 300
PRIOR, EM_ROUNDS = 0.1, 8
#: The annotator is one more voter on the sample's rows, who errs so often in either class.
ANNOTATOR_ERROR = 0.002
#: Accuracies before any label is seen, P(toxic) of a silent text then; so many labelled votes weigh as much as the EM's estimate.
ACCURACY, SILENT, ANCHOR = 0.7, 0.02, 20.0
#: All voters together stay below the annotator, so a labelled row keeps its label's side.
MOST_SAID = 5.0
BUCKETS = 1 << 20
#: Indicators enter the classifier if their likelihood ratio passes 2 ln(candidates) + MARGIN and their log odds are so far from 0; they are scaled by them.
MARGIN, ODDS = 2.0, 1.0
STEPS, BATCH, PENALTY, FOLDS = 600, 256, 1e-4, 3
#: Vote patterns up to so many are summed on the driver, more of them by tasks; the sums are the same.
PATTERNS_HERE = 100_000
#: Words of a shingle and signatures by which near copies in the sample are found.
SHINGLE, SIGNATURES = 5, 3
#: Words a worker remembers; a full memory is emptied.
WORDS = 350_000

# Themed lexicons of insults and abuse, in lower case.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles dimwit halfwit fool foolish brainless retard retarded cretin simpleton",
    "worth": "worthless pathetic loser losers useless failure nobody pitiful hopeless",
    "dirt": "trash garbage scum filth filthy vermin parasite parasites rat rats pig pigs disgusting vile repulsive gross sickening",
    "mockery": "clown clowns joke laughable ridiculous crybaby coward cowards",
    "profanity": "shit shitty bullshit fuck fucking fucked fucker bitch bitches bastard bastards asshole assholes damn crap dick piss whore slut",
    "threat": "kill die hang shoot beat burn rot hate hateful despise",
    "german": "idioten trottel dumm dummkopf arschloch scheisse scheiße abschaum versager schwachkopf blödmann dreckig drecksau hurensohn",
    "french": "idiote imbécile crétin connard connasse salaud salope merde abruti débile minable ordure",
    "spanish": "idiota imbécil estúpido estúpida tonto tonta pendejo cabrón mierda basura asqueroso inútil gilipollas puta puto",
}
ADDRESS = frozenset("you your youre u ur du dein ihr tu ton vous votre tú eres usted".split())
PATTERNS = ("several", "addressed", "neighbours")
#: Latin and other letters; digits and marks end a word.
_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(token: str) -> list[str]:
    return [token] if token.isalpha() else _LETTERS.findall(token)


def beginnings(token: str) -> list[str]:
    return [w[:k] for w in words_in(token) for k in STEM_LETTERS if len(w) >= k]


def dense(count: int, words: int) -> bool:
    return count >= DENSE_TIMES and count * DENSE_IN >= words


class Voters:
    """Bits of a vote mask: lexicons, stems (beginning, whether it must be dense), then patterns."""

    def __init__(self, stems: list[tuple[str, bool]]):
        self.stems: dict[str, list[tuple[bool, int]]] = {}
        for k, (s, must) in enumerate(stems):
            self.stems.setdefault(s, []).append((must, 1 << len(LEXICONS) + k))
        self.first_letters = {s[:LEAST_LETTERS] for s in self.stems}
        self.of_word: dict[str, int] = {}
        for k, words in enumerate(LEXICONS.values()):
            for w in words.split():
                self.of_word[w] = self.of_word.get(w, 0) | 1 << k
        self.first = len(LEXICONS) + len(stems)
        self.count = self.first + len(PATTERNS)
        self.known: dict[str, tuple[int, tuple[int, ...]] | None] = {}

    def _bits(self, token: str) -> tuple[int, tuple[int, ...]] | None:
        now, counted = 0, []
        for w in words_in(token):
            now |= self.of_word.get(w, 0)
            if w[:LEAST_LETTERS] in self.first_letters:
                for k in STEM_LETTERS:
                    for must, bit in self.stems.get(w[:k], ()) if len(w) >= k else ():
                        if must:
                            counted.append(bit)
                        else:
                            now |= bit
        return (now, tuple(counted)) if now or counted else None

    def mask(self, text: str) -> int:
        tokens = text.lower().split()
        known, mask, hits, counts = self.known, 0, set(), {}
        if len(known) > WORDS:
            known.clear()
        for t, n in Counter(tokens).items():
            if t in known:
                b = known[t]
            else:
                b = self._bits(t)
                if len(t) <= 48:
                    known[t] = b
            if b is not None:
                if b[0]:
                    mask |= b[0]
                    hits.add(t)
                for bit in b[1]:
                    counts[bit] = counts.get(bit, 0) + n
        for bit, n in counts.items():
            if dense(n, len(tokens)):
                mask |= bit
        if hits:
            at = [i for i, t in enumerate(tokens) if t in hits]
            if len(hits) > 1:
                mask |= 1 << self.first
            if any(ADDRESS & set(_LETTERS.findall(" ".join(tokens[max(0, i - 4) : i]))) for i in at):
                mask |= 1 << (self.first + 1)
            if any(b - a <= 8 for a, b in zip(at, at[1:])):
                mask |= 1 << (self.first + 2)
        return mask


def bits_of(masks: np.ndarray, count: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(count, dtype=np.int64)) & 1).astype(np.float64)


class LabelModel:
    """accuracy: P(toxic | this voter speaks); prior; silent: P(toxic | no voter speaks); weights: what a voter adds beside its correlated ones.

    An abstention says nothing of its own, as a lexicon is silent in other languages.
    """

    def __init__(self, accuracy: np.ndarray, prior: float, silent: float):
        self.accuracy, self.prior, self.silent = accuracy, prior, silent
        self.weights, self.correlations = np.ones(len(accuracy)), None

    def posterior(self, votes: np.ndarray, annotated: np.ndarray | float = 0.5) -> np.ndarray:
        """P(toxic) given the votes, and the annotator's label where there is one."""
        logit = lambda p: np.log(p / (1 - p))
        said = (2 * np.asarray(annotated) - 1) * logit(1 - ANNOTATOR_ERROR)
        base = np.where(votes.any(axis=1), logit(self.prior), logit(self.silent))
        voted = base + votes @ ((logit(self.accuracy) - logit(self.prior)) * self.weights)
        return sigmoid(said + np.clip(voted, -MOST_SAID, MOST_SAID))


def likelihood_ratio(toxic, clean, toxic_rows: float, clean_rows: float):
    """Twice the log likelihood ratio of "depends on the class" against "doesn't", for columns or arrays of (weighted) row counts."""
    column = isinstance(toxic, Column)
    log, least, most = (F.log, F.least, F.greatest) if column else (np.log, np.minimum, np.maximum)
    lit = F.lit if column else float
    share = (toxic + clean) / (toxic_rows + clean_rows)

    def term(seen, expected):
        return seen * log(most(seen, lit(1e-9)) / most(expected, lit(1e-9)))

    parts = 0.0
    for seen, rows in ((toxic, toxic_rows), (clean, clean_rows)):
        parts = parts + term(seen, rows * share) + term(most(rows - seen, lit(0.0)), rows * (1 - least(share, lit(1.0))))
    return 2 * parts


def log_odds(toxic, clean, toxic_rows: float, clean_rows: float):
    log = F.log if isinstance(toxic, Column) else np.log
    return log((toxic + 0.5) / (toxic_rows + 1)) - log((clean + 0.5) / (clean_rows + 1))


def signatures(text: str) -> tuple[int, ...]:
    """MinHash values of the text's word shingles; short texts are one shingle."""
    words = np.array([crc32(t.encode()) for t in text.lower().split()], np.uint64)
    with np.errstate(over="ignore"):
        if len(words) > SHINGLE:
            total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - SHINGLE + 1 + k]
        else:
            total = np.array([crc32(text.lower().encode())], np.uint64)
        mixed = [(total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * 0x1D8E4E27C47D124F * k & (1 << 64) - 1 | 1) for k in range(SIGNATURES)]
    return tuple(int(m.min() >> np.uint64(1)) for m in mixed)


def copy_weights(keys: list[tuple[int, ...]]) -> np.ndarray:
    """1 / size of the largest group of rows that share a signature."""
    sizes = [Counter(k) for k in zip(*keys)]
    return np.array([1.0 / max(size[v] for size, v in zip(sizes, key)) for key in keys])


def induce_stems(sample: DataFrame) -> list[tuple[str, bool]]:
    """Word beginnings, as such or dense, that tell label 1 in the sample (doc_id, text, y, weight).

    Chosen greedily by what they say of the toxic rows that hold fewer than COVER
    chosen ones, so that a word which only stands beside a better one isn't taken;
    of nested beginnings one is taken, of equal ones the longest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass: dict[tuple[str, bool], list[float]] = {}
        for batch in batches:
            for text, y, w in zip(batch["text"], batch["y"].tolist(), batch["weight"].tolist()):
                for k in stems_of(text):
                    mass.setdefault(k, [0.0, 0.0])[y] += w
        yield pd.DataFrame([(*k, *m) for k, m in mass.items()], columns=["stem", "must", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in sample.filter("y >= 0").groupBy("y").agg(F.sum("weight").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return []
    known = sample.filter("y >= 0")
    counts = known.select("text", "y", "weight").mapInPandas(run, "stem string, must boolean, clean double, toxic double")
    counts = stored(counts.groupBy("stem", "must").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-stems")
    bar = 2 * float(np.log(max(1, counts.count())))
    toxic, clean = F.col("toxic"), F.col("clean")
    ratio = F.round(likelihood_ratio(toxic, clean, n[1], n[0]), 6)
    best = counts.filter((log_odds(toxic, clean, n[1], n[0]) >= STEM_ODDS) & (ratio >= bar)).orderBy(F.desc(ratio), "must", F.desc(F.length("stem")), "stem")
    found = [(r["stem"], r["must"], r["clean"]) for r in best.limit(STEM_CANDIDATES).collect()]
    if not found:
        return []
    place = sample.sparkSession.sparkContext.broadcast({(stem, must): k for k, (stem, must, _) in enumerate(found)})

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [sorted(place.value[k] for k in stems_of(t) if k in place.value) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "weight": batch["weight"], "held": held})

    rows = known.filter("y = 1").select("doc_id", "text", "weight").mapInPandas(holders, "doc_id long, weight double, held array<int>").orderBy("doc_id").collect()
    holds = np.zeros((len(rows), len(found)), bool)
    for k, r in enumerate(rows):
        holds[k, r["held"]] = True
    weight, clean_mass = np.array([r["weight"] for r in rows]), np.array([c for _, _, c in found])
    covered, free, chosen = np.zeros(len(rows), int), np.ones(len(found), bool), []
    length = np.array([len(stem) for stem, _, _ in found])
    while free.any() and len(chosen) < STEMS:
        gain = (weight * (covered < COVER)) @ holds
        tells = np.round(likelihood_ratio(gain, clean_mass, n[1], n[0]), 6)
        tells[~free | (log_odds(gain, clean_mass, n[1], n[0]) < STEM_ODDS) | (tells < bar)] = -1.0
        at = int(np.lexsort((-length, -tells))[0])
        if tells[at] < 0:
            break
        stem, must, _ = found[at]
        chosen.append((stem, must))
        covered += holds[:, at]
        free &= np.array([not (stem.startswith(other) or other.startswith(stem)) for other, _, _ in found])
    return chosen


def stems_of(text: str) -> set[tuple[str, bool]]:
    """The text's word beginnings, each also as a dense one where it is."""
    tokens = text.lower().split()
    times: Counter = Counter()
    for t, n in Counter(tokens).items():
        for b in set(beginnings(t)):
            times[b] += n
    return {(b, False) for b in times} | {(b, True) for b, n in times.items() if dense(n, len(tokens))}


def vote(docs: DataFrame, voters: Voters) -> DataFrame:
    """The vote patterns of all documents: mask, n."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(map(shared.value.mask, batch["text"]))
            if len(seen) > 100_000:
                yield pd.DataFrame(list(seen.items()), columns=["mask", "n"])
                seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["mask", "n"])

    found = id_text(docs).select("text").mapInPandas(run, "mask long, n long")
    return stored(found.groupBy("mask").agg(F.sum("n").alias("n")), "votes")


def _sums(masks: np.ndarray, n: np.ndarray, model: LabelModel) -> np.ndarray:
    """By class: documents, votes of each voter, votes of each pair, one after another in one array."""
    votes = bits_of(masks, len(model.weights))
    toxic = model.posterior(votes) * n
    by_class = (n - toxic, toxic)
    parts = [[w.sum() for w in by_class], *(w @ votes for w in by_class), *((votes.T @ (w[:, None] * votes)).ravel() for w in by_class)]
    return np.concatenate(parts)


def _moments(patterns: DataFrame | tuple[np.ndarray, np.ndarray], model: LabelModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums over all documents; of many patterns a sum per task, which the driver adds."""
    count = len(model.weights)
    if isinstance(patterns, tuple):
        flat = _sums(*patterns, model)
    else:
        shared = patterns.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + 2 * count + 2 * count * count)
            for batch in batches:
                total += _sums(batch["mask"].to_numpy(), batch["n"].to_numpy(np.float64), shared.value)
            yield pd.DataFrame({"at": np.arange(total.size), "x": total})

        flat = np.zeros(2 + 2 * count + 2 * count * count)
        for r in patterns.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[r["at"]] = r["x"]
    return flat[:2], flat[2 : 2 + 2 * count].reshape(2, count), flat[2 + 2 * count :].reshape(2, count, count)


def fit_label_model(patterns: DataFrame, labelled: np.ndarray, spoken: np.ndarray, prior: float, silent: float, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over the vote patterns of all documents.

    labelled are the voters' accuracies on the labelled rows, from spoken votes
    each.  A voter's accuracy is the mean of that and of the EM's estimate, which
    counts as ANCHOR votes however large the table is.  Every round also gives,
    from the pair moments within the toxic class, correlations and weights.
    """
    start = np.clip(labelled, 0.001, 0.999)
    model, trust = LabelModel(start, prior, silent), spoken / (spoken + ANCHOR)
    if patterns.limit(PATTERNS_HERE + 1).count() <= PATTERNS_HERE:
        rows = patterns.orderBy("mask").collect()
        patterns = np.array([r["mask"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    for _ in range(rounds):
        total, one, two = _moments(patterns, model)
        votes = one.sum(axis=0)
        estimate = np.where(votes > 0, one[1] / np.where(votes > 0, votes, 1.0), start)
        accuracy = np.clip(trust * start + (1 - trust) * estimate, 0.001, 0.999)
        documents = total[1] if total[1] > 0 else 1.0
        share, pairs = one[1] / documents, two[1] / documents
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
        model.correlations = np.clip((pairs - np.outer(share, share)) / np.outer(spread, spread), -1, 1)
        tied = np.where(model.correlations > 0.1, model.correlations, 0.0)
        np.fill_diagonal(tied, 0)
        moved = np.abs(accuracy - model.accuracy).max()
        model.accuracy, model.weights = accuracy, 1 / (1 + tied.sum(axis=1))
        if moved < 0.002:
            break
    return model


class Classifier:
    """Logistic weights over indicators: of a word ("=word"), of a word beginning, and of a dense one ("+beginning")."""

    def __init__(self, weights: dict[str, float], offset: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift
        self.words = {n[1:]: n for n in weights if n[0] == "="}
        self.dense = {n[1:]: n for n in weights if n[0] == "+"}
        self.starts = {n: n for n in weights if n[0] not in "=+"}
        self.first_letters = {n[:LEAST_LETTERS] for n in [*self.starts, *self.dense]}
        self.known: dict[str, tuple | None] = {}

    def _of(self, token: str) -> tuple[list[str], list[str]] | None:
        now, counted = [], []
        for w in words_in(token):
            if w in self.words:
                now.append(self.words[w])
            if w[:LEAST_LETTERS] in self.first_letters:
                for k in STEM_LETTERS:
                    b = w[:k]
                    if len(b) == k:
                        if b in self.starts:
                            now.append(b)
                        if b in self.dense:
                            counted.append(self.dense[b])
        return (now, counted) if now or counted else None

    def features(self, text: str) -> list[str]:
        """The text's indicators among the weights."""
        known, out, counts = self.known, set(), {}
        if len(known) > WORDS:
            known.clear()
        tokens = text.lower().split()
        for t, n in Counter(tokens).items():
            if t in known:
                f = known[t]
            else:
                f = self._of(t)
                if len(t) <= 48:
                    known[t] = f
            if f is not None:
                out.update(f[0])
                for i in f[1]:
                    counts[i] = counts.get(i, 0) + n
        out.update(i for i, n in counts.items() if dense(n, len(tokens)))
        return sorted(out)

    def margin(self, features: list[str]) -> float:
        return self.offset + sum(self.weights[i] for i in features)

    def score(self, text: str) -> float:
        return float(sigmoid(self.slope * self.margin(self.features(text)) + self.shift))


def all_indicators(text: str) -> set[str]:
    tokens = text.lower().split()
    out, times = set(), {}
    for t, n in Counter(tokens).items():
        for w in words_in(t):
            out.add("=" + w)
            for k in STEM_LETTERS:
                if len(w) < k:
                    break
                b = w[:k]
                out.add(b)
                times[b] = times.get(b, 0) + n
    out.update("+" + b for b, n in times.items() if dense(n, len(tokens)))
    return out


def annotations(y: np.ndarray) -> np.ndarray:
    return np.where(y < 0, 0.5, y).astype(np.float64)


def significant(sample: DataFrame, model: LabelModel, voters: Voters) -> dict[str, float]:
    """The indicators that tell the posterior labels of the sample (text, mask, y, weight), with their log odds.

    Masses are counted by hash bucket; the names in the buckets that stand out come
    in a second look.  Words and stems of the voters are few, so their bar is lower.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)
    count = len(model.weights)
    own = {f"={w}" for w in voters.of_word} | {("+" if must else "") + stem for stem, kinds in voters.stems.items() for must, _ in kinds}

    def targets(batch: pd.DataFrame) -> np.ndarray:
        return shared.value.posterior(bits_of(batch["mask"].to_numpy(), count), annotations(batch["y"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, total = np.zeros((2, BUCKETS)), np.zeros(2)
        for batch in batches:
            target, weight = targets(batch), batch["weight"].to_numpy()
            for text, t, w in zip(batch["text"], target.tolist(), weight.tolist()):
                at = list({crc32(n.encode()) % BUCKETS for n in all_indicators(text)})
                mass[1, at] += t * w
                mass[0, at] += (1 - t) * w
            total += ((1 - target) * weight).sum(), (target * weight).sum()
        used = np.flatnonzero(mass.sum(axis=0))
        yield pd.DataFrame({"at": np.append(used, -1), "clean": np.append(mass[0, used], total[0]), "toxic": np.append(mass[1, used], total[1])})

    rows = sample.select("text", "mask", "y", "weight")
    sums = stored(rows.mapInPandas(run, "at int, clean double, toxic double").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "indicators")
    total = sums.filter("at = -1").first()
    if total is None or not (total["toxic"] and total["clean"]):
        return {}
    of_all = F.col("toxic"), F.col("clean"), total["toxic"], total["clean"]
    ratio, odds = likelihood_ratio(*of_all), log_odds(*of_all)
    bar, low_bar = (2 * float(np.log(max(2, k))) + MARGIN for k in (sums.count(), len(own)))
    tells = (ratio > bar) & (F.abs(odds) >= ODDS)
    wanted = {r["at"] for r in sums.filter((F.col("at") >= 0) & tells).select("at").collect()} | {crc32(n.encode()) % BUCKETS for n in own}
    buckets = sample.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass: dict[str, list[float]] = {}
        for batch in batches:
            for text, t, w in zip(batch["text"], targets(batch).tolist(), batch["weight"].tolist()):
                for n in all_indicators(text):
                    m = mass.get(n)
                    if m is None and crc32(n.encode()) % BUCKETS in buckets.value:
                        m = mass[n] = [0.0, 0.0]
                    if m is not None:
                        m[0] += (1 - t) * w
                        m[1] += t * w
        yield pd.DataFrame([(n, *m) for n, m in mass.items()], columns=["name", "clean", "toxic"])

    found = rows.mapInPandas(names, "name string, clean double, toxic double").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    tells |= F.col("name").isin(sorted(own)) & (ratio > low_bar) & (F.abs(odds) >= ODDS)
    return {r["name"]: r["odds"] for r in found.filter(tells).select("name", odds.alias("odds")).orderBy("name").collect()}


def train_classifier(odds: dict[str, float], rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> Classifier:
    """Weighted logistic regression on soft targets by Adagrad over indicators scaled by their odds; rows hold places in odds."""
    scale = np.array([*odds.values()] or [0.0]) / max([1.0, *map(abs, odds.values())])
    prior = float(np.clip(np.average(target, weights=weight), 1e-3, 1 - 1e-3))
    w, offset = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    size, step, rng, order = np.full(len(scale), 1e-8), 0.5, np.random.default_rng(5), np.arange(len(rows))
    lengths = np.array([len(r) for r in rows])
    for _ in range(-(-STEPS * BATCH // len(rows))):
        rng.shuffle(order)
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            at = np.concatenate([rows[i] for i in batch])
            who = np.repeat(np.arange(len(batch)), lengths[batch])
            gap = weight[batch] * (sigmoid(np.bincount(who, w[at] * scale[at], len(batch)) + offset) - target[batch])
            g = np.bincount(at, gap[who] * scale[at], len(scale)) / len(batch) + PENALTY * w
            size += g * g
            w -= step * g / np.sqrt(size)
            offset -= 0.05 * float(gap.mean())
    return Classifier({n: float(x) for n, x in zip(odds, w * scale) if x}, offset)


def margins(classifier: Classifier, names: list[str], rows: list[np.ndarray]) -> np.ndarray:
    weight = np.array([classifier.weights.get(n, 0.0) for n in names] or [0.0])
    return np.array([classifier.offset + weight[a].sum() for a in rows])


def toxicity_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame | None:
    """doc_id, text, y (-1: unlabelled) of at most ``most`` labelled rows and as many unlabelled ones, none held out; None without labels."""
    known = training_sample(labels, label, most)
    if not known:
        return None
    texts = id_text(docs)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = texts.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(named, "doc_id", "left_anti").distinct()
    others = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return with_labels(texts, known | {r["doc_id"]: -1 for r in others})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[Classifier, LabelModel, Voters]:
    """The classifier, and the label model and voters behind it."""
    sample = toxicity_sample(docs, labels, label, most)
    if sample is not None:

        def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(keys=[list(signatures(t)) for t in batch["text"]])

        sample = stored(sample.mapInPandas(signed, "doc_id long, text string, y int, keys array<long>"), "toxicity-sample")
        keys = {r["doc_id"]: tuple(r["keys"]) for r in sample.select("doc_id", "keys").collect()}
        weights = dict(zip(keys, copy_weights(list(keys.values())).tolist()))
        weighed = docs.sparkSession.createDataFrame(sorted(weights.items()), "doc_id long, weight double")
        sample = sample.drop("keys").join(F.broadcast(weighed), "doc_id")
    voters = Voters(induce_stems(sample) if sample is not None else [])
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    start, spoken, prior, silent, rows = np.full(voters.count, ACCURACY), np.zeros(voters.count), PRIOR, SILENT, []
    if sample is not None:

        def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(mask=[shared.value.mask(t) for t in batch["text"]])

        sample = stored(sample.mapInPandas(voted, "doc_id long, text string, y int, weight double, mask long"), "toxicity-votes")
        rows = [r for r in sample.select("y", "mask", "weight").collect() if r["y"] >= 0]
    masks, y, w = (np.array([r[k] for r in rows], t) for k, t in (("mask", np.int64), ("y", np.float64), ("weight", np.float64)))
    both = 0 < y.sum() < len(y)
    if both:
        votes, prior = bits_of(masks, voters.count), float(np.clip(np.average(y, weights=w), 1e-3, 0.5))
        spoken = w @ votes
        start = ((w * y) @ votes + 2 * ACCURACY) / (spoken + 2)
        quiet = ~votes.any(axis=1)
        silent = float(((w * y)[quiet].sum() + SILENT) / (w[quiet].sum() + 1))
    model = fit_label_model(vote(docs, voters), start, spoken, prior, float(np.clip(silent, 1e-4, 0.5)))
    if not rows:  # nothing to train on: the lexicons' own indicators stand for the classifier
        return Classifier({f"={w}": 4.0 for w in voters.of_word}, float(np.log(PRIOR / (1 - PRIOR)))), model, voters
    odds = significant(sample, model, voters)
    place = {n: k for k, n in enumerate(odds)}
    finder = docs.sparkSession.sparkContext.broadcast(Classifier(dict.fromkeys(odds, 0.0), 0.0))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [np.array([place[n] for n in finder.value.features(t)], np.int32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "weight": batch["weight"], "mask": batch["mask"], "at": at})

    got = sample.mapInPandas(featured, "doc_id long, y int, weight double, mask long, at binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["mask"], bytes(r["at"])))
    at, y, w = [np.frombuffer(r["at"], np.int32) for r in got], np.array([r["y"] for r in got]), np.array([r["weight"] for r in got])
    target = model.posterior(bits_of(np.array([r["mask"] for r in got], np.int64), voters.count), annotations(y))
    classifier = train_classifier(odds, at, target, w)
    if both:
        fold, out = np.arange(len(at)) % FOLDS, np.zeros(len(at))
        for k in range(FOLDS):
            learnt, left = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(learnt) and len(left):
                part = train_classifier(odds, [at[i] for i in learnt], target[learnt], w[learnt])
                out[left] = margins(part, list(odds), [at[i] for i in left])
        classifier.slope, classifier.shift = calibrate(out[y >= 0], y[y >= 0].astype(np.float64))
    return classifier, model, voters


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [shared.value.score(t) for t in batch["text"]]})

    scored = id_text(docs).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier, _, _ = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, classifier)
