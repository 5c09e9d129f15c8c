"""The two classifiers against their definitions: noisy-or and its optimum, normal equations and the isotonic fit."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality, toxicity


def brute_score(model, text):
    """One minus the chance that no sentence is toxic."""
    clean = 1.0
    for a, b in toxicity.sentences(text):
        words = set(toxicity.LETTERS.findall(text[a:b].lower()))
        if words:
            z = model.offset + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.word_features(w))
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_noisy_or_from_the_weights(spark):
    rnd = random.Random(1)
    words = ["vile", "viler", "nice", "Grüße", "ok", "wordy", "İstanbul"]
    weights = {f: rnd.uniform(-1, 3) for w in words for f in toxicity.word_features(w.lower()) if rnd.random() < 0.7}
    model = toxicity.ToxicityModel(weights, -2.0)
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ".", "!\n", ","]) for _ in range(rnd.randint(0, 25))) for _ in range(200)] + [None, "", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in toxicity.score_documents(df, model).collect():
        assert r["score"] == pytest.approx(brute_score(model, r["text"] or ""), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_training_ends_where_the_likelihood_is_flat():
    rnd = np.random.default_rng(3)
    n, k = 60, 5
    sizes = [rnd.integers(0, 4, rnd.integers(1, 5)).astype("<i4") for _ in range(n)]
    col = rnd.integers(0, k, sum(int(s.sum()) for s in sizes)).astype("<i4")
    y = (rnd.random(n) < 0.4).astype(float)
    ridge = 0.5

    def loss(w, offset):
        total, at = ridge / 2 * float(w @ w), 0
        for s, label in zip(sizes, y):
            clean = 0.0  # log of the chance that no sentence is toxic
            for size in s:
                clean -= np.logaddexp(0.0, offset + w[col[at : at + size]].sum())
                at += size
            total -= math.log(-math.expm1(clean)) if label else clean
        return total

    w, offset = toxicity.fit_arrays(sizes, col, y, k, 4000, 0.02, ridge, 0.0)
    h = 1e-5
    for i in range(k):
        step = np.eye(k)[i] * h
        assert abs(loss(w + step, offset) - loss(w - step, offset)) / (2 * h) < 0.02
    assert abs(loss(w, offset + h) - loss(w, offset - h)) / (2 * h) < 0.02
    assert loss(w, offset) < loss(np.zeros(k), -5.0)


def naive_isotonic(x, y, w):
    """Level of each point by the max-min formula of isotonic regression."""
    n = len(x)
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_against_max_min():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 30):
        x, y, w = np.sort(rnd.random(n)), rnd.random(n), rnd.integers(1, 9, n).astype(float)
        knots, values = quality.isotonic(x, y, w)
        want = naive_isotonic(x, y, w)
        assert np.all(np.diff(values) > 0) and sorted(set(np.round(want, 9))) == sorted(np.round(values, 9))
        for level, knot in zip(values, knots):
            own = np.abs(want - level) < 1e-9
            assert knot == pytest.approx(np.average(x[own], weights=w[own]))


def test_ridge_against_collected_rows(spark):
    rnd = random.Random(6)
    words = ["word", "other", "thing", "xx", "a", "!!!", "<b>", "1234"]
    rows = [(i, " ".join(rnd.choice(words[: 3 + 5 * (i % 2)]) for _ in range(rnd.randint(1, 60))), int(i % 2 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    stats = quality.labelled_statistics(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), "quality", 1000, "doc_id", "text")
    model = quality.fit(stats, n_features=40)
    got = stats.collect()
    x = np.array([r["stats"] for r in got])
    y, held = np.array([r["y"] for r in got]), np.array([r["calibrate"] for r in got])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    f = model.features(x)
    penalty = np.diag([1e-6, *[1.0] * (f.shape[1] - 1)])
    a, b = f[~held], y[~held]
    want = np.linalg.lstsq(np.vstack([a, np.sqrt(penalty)]), np.concatenate([b, np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.abs(f @ want - model.raw(x)).max() < 1e-6
    # calibration: sums over ranges of raw score, then the naive isotonic fit
    raw = model.raw(x)[held]
    place = np.floor(np.clip(raw, -0.5, 1.5) * 256)
    bins = np.unique(place)
    cx, cy, cw = (np.array([g(place == k) for k in bins]) for g in (lambda m: raw[m].mean(), lambda m: y[held][m].mean(), lambda m: float(m.sum())))
    assert np.allclose(np.unique(np.round(naive_isotonic(cx, cy, cw), 9)), np.unique(np.round(model.values, 9)))
    scored = quality.score_documents(docs, model).select("text", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    one = scored[0]
    assert one["score"] == pytest.approx(float(np.clip(model.score(np.array([quality.statistics(one["text"])]))[0], 0, 1)))
    assert docs.select(F.count("*")).first()[0] == len(scored)
