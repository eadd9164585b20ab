"""The parts of the toxicity operator against plain reference computations."""

import math
import random

import numpy as np
import pytest

from tests.llm.test_operators import documents, made_up
from webloom.llm import op04_toxicity as op4

PATTERNS = [(0, 900), (1, 40), (3, 25), (4, 30), (5, 6), (7, 9), (8, 12)]


def as_table(spark, times=1):
    return spark.createDataFrame([(m, n * times) for m, n in PATTERNS], "mask long, n long")


def plain_em(labelled, spoken, prior, silent, rounds):
    """The label model by loops over patterns and voters."""
    logit = lambda p: math.log(p / (1 - p))
    start = [min(max(a, 0.001), 0.999) for a in labelled]
    accuracy, weights, k = list(start), [1.0] * len(start), len(start)
    for _ in range(rounds):
        toxic = {}
        for mask, n in PATTERNS:
            said = sum((logit(accuracy[v]) - logit(prior)) * weights[v] for v in range(k) if mask >> v & 1) + logit(prior if mask else silent)
            toxic[mask] = n / (1 + math.exp(-min(max(said, -op4.MOST_SAID), op4.MOST_SAID)))
        documents_toxic = sum(toxic.values())
        speaks = [sum(n for m, n in PATTERNS if m >> v & 1) for v in range(k)]
        share = [sum(t for m, t in toxic.items() if m >> v & 1) / documents_toxic for v in range(k)]
        new = []
        for v in range(k):
            estimate = share[v] * documents_toxic / speaks[v] if speaks[v] else start[v]
            trust = spoken[v] / (spoken[v] + op4.ANCHOR)
            new.append(min(max(trust * start[v] + (1 - trust) * estimate, 0.001), 0.999))
        for v in range(k):
            tied = 0.0
            for u in range(k):
                if u != v:
                    both = sum(t for m, t in toxic.items() if m >> v & 1 and m >> u & 1) / documents_toxic
                    spread = math.sqrt(max(share[v] * (1 - share[v]), 1e-9) * max(share[u] * (1 - share[u]), 1e-9))
                    c = min(1.0, max(-1.0, (both - share[v] * share[u]) / spread))
                    tied += c if c > 0.1 else 0.0
            weights[v] = 1 / (1 + tied)
        moved = max(abs(a - b) for a, b in zip(new, accuracy))
        accuracy = new
        if moved < 0.002:
            break
    return accuracy, weights


LABELLED, SPOKEN = np.array([0.9, 0.8, 0.6, 0.7]), np.array([50.0, 10.0, 4.0, 0.0])


@pytest.mark.parametrize("here", [0, op4.PATTERNS_HERE])
def test_label_model_is_the_plain_em(spark, monkeypatch, here):
    monkeypatch.setattr(op4, "PATTERNS_HERE", here)
    got = op4.fit_label_model(as_table(spark), LABELLED, SPOKEN, 0.1, 0.02)
    accuracy, weights = plain_em(LABELLED, SPOKEN, 0.1, 0.02, op4.EM_ROUNDS)
    assert np.allclose(got.accuracy, accuracy, atol=1e-9) and np.allclose(got.weights, weights, atol=1e-9)


def test_label_model_does_not_depend_on_the_size_of_the_table(spark):
    models = [op4.fit_label_model(as_table(spark, k), LABELLED, SPOKEN, 0.1, 0.02) for k in (1, 25, 625)]
    votes = op4.bits_of(np.arange(16), 4)
    for m in models[1:]:
        assert np.allclose(m.accuracy, models[0].accuracy) and np.allclose(m.posterior(votes), models[0].posterior(votes))


def test_posterior_of_a_labelled_row_keeps_its_side():
    model = op4.LabelModel(np.full(40, 0.999), 0.1, 0.02)
    votes = np.array([np.ones(40), np.zeros(40)])
    assert (model.posterior(votes, np.array([0.0, 0.0])) < 0.5).all() and (model.posterior(votes, np.array([1.0, 1.0])) > 0.5).all()


def test_copies_share_one_weight():
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    texts = [" ".join(base)] * 5 + [" ".join([*base[:100], f"new{i}", *base[101:]]) for i in range(5)] + [" ".join(f"o{i}x{k}" for k in range(30)) for i in range(10)]
    weights = op4.copy_weights([op4.signatures(t) for t in texts])
    assert 0.9 <= weights[:10].sum() <= 2.5 and (weights[10:] == 1).all()
    assert op4.signatures("") == op4.signatures("")


def test_likelihood_ratio_and_odds_by_hand():
    toxic, clean, t, c = 18.0, 3.0, 35.0, 245.0
    cells = [(18, 35, 21), (17, 35, 259), (3, 245, 21), (242, 245, 259)]
    want = 2 * sum(seen * math.log(seen / (rows * column / 280)) for seen, rows, column in cells)
    assert abs(op4.likelihood_ratio(np.array([toxic]), np.array([clean]), t, c)[0] - want) < 1e-9
    assert abs(op4.log_odds(np.array([toxic]), np.array([clean]), t, c)[0] - (math.log(18.5 / 36) - math.log(3.5 / 246))) < 1e-12


def test_stems_are_found_and_words_of_copies_are_not(spark):
    rows = made_up(700, 3, lambda w, r: [x if r.random() > 0.05 else "zuqq" + x for x in w] + ["zuqqta"], 0.2)
    copied = next(t for t, bad in rows if bad) + " rarissimo"
    texts = [t for t, _ in rows] + [copied] * 60
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i >= len(rows) or rows[i][1])) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    classifier, _, voters = op4.train(docs, labels)
    assert any(stem.startswith("zuqq") for stem in voters.stems) and not any(stem.startswith("rar") for stem in voters.stems)
    got = [r for r in op4.score(docs, classifier).collect() if r["held_out"] and r["doc_id"] < len(rows)]
    assert sum(r["predicted"] == rows[r["doc_id"]][1] for r in got) >= 0.97 * len(got)
