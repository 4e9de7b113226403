"""The ordinal model against a dense likelihood, and its scores against sums word by word."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pagelens.llm import toxicity
from pagelens.llm.toxicity import GRADES, PENALTY, Sample


def objective(x, grades, share, w, cuts):
    """Penalised negative log-likelihood of the cumulative-link model, written out."""
    total = 0.0
    for row, grade, weight in zip(x, grades, share, strict=True):
        at_least = [1.0, *[1 / (1 + math.exp(min(40, max(-40, c - float(row @ w))))) for c in cuts], 0.0]
        total -= weight * math.log(max(at_least[grade] - at_least[grade + 1], 1e-12))
    return total / share.sum() + PENALTY / share.sum() * np.abs(w).sum()


def dense_fit(x, grades, share, rounds=4000):
    """Proximal gradient descent with halved steps; gradients by differences of the objective's smooth part."""
    w, cuts, step = np.zeros(x.shape[1]), np.linspace(3, 6, GRADES - 1), 1.0

    def smooth(w, cuts):
        s = np.ones((len(x), GRADES + 1))
        s[:, GRADES] = 0
        s[:, 1:GRADES] = 1 / (1 + np.exp(np.clip(cuts - (x @ w)[:, None], -40, 40)))
        rows = np.arange(len(x))
        return -(share * np.log(np.maximum(s[rows, grades] - s[rows, grades + 1], 1e-12))).sum() / share.sum()

    def gradient(w, cuts):
        both, eps = np.concatenate([w, cuts]), 1e-6
        split = len(w)
        out = []
        for i in range(len(both)):
            up, down = both.copy(), both.copy()
            up[i], down[i] = up[i] + eps, down[i] - eps
            out.append((smooth(up[:split], up[split:]) - smooth(down[:split], down[split:])) / (2 * eps))
        return np.array(out[:split]), np.array(out[split:])

    value = objective(x, grades, share, w, cuts)
    for _ in range(rounds):
        g_w, g_c = gradient(w, cuts)
        step *= 2
        while True:
            new_w = w - step * g_w
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY / share.sum(), 0)
            new_c = np.sort(cuts - step * g_c)
            new = objective(x, grades, share, new_w, new_c)
            if new <= value or step < 1e-9:
                break
            step /= 2
        if value - new < 1e-9:
            break
        w, cuts, value = new_w, new_c, new
    return value


def test_fit_reaches_the_dense_optimum():
    rng = np.random.default_rng(4)
    n, k = 120, 6
    counts = rng.poisson(0.7, (n, k))
    x = np.log1p(counts)
    truth = np.array([2.5, 2.0, 1.5, 0.8, 0.0, 0.0])
    score = x @ truth + rng.logistic(size=n)
    grades = np.digitize(score, [3.0, 4.2, 5.5])
    share = rng.uniform(0.3, 1.0, n)
    of, at = np.nonzero(counts)
    sample = Sample((grades > 0).astype(int), share, of, at, x[of, at], np.arange(k) * 7)
    model = toxicity.fit(sample, grades)
    w = np.zeros(k)
    w[model.cells // 7] = model.weights
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == GRADES - 1
    best = dense_fit(x, grades, share)
    assert objective(x, grades, share, w, model.cuts) <= best * 1.002 + 1e-4


def test_scores_equal_sums_word_by_word(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels)
    model = toxicity.fit(sample, toxicity.severity_grades(sample))
    assert len(model.cells)
    weight = dict(zip(model.cells.tolist(), model.weights.tolist(), strict=True))
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (None, "x")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id): r for r in toxicity.score_toxicity(rows, labels).collect()}
    for doc_id, text in rows.collect():
        _, cells = toxicity._features(pa.RecordBatch.from_arrays([pa.array([text or ""])], ["text"]))
        counts = {}
        for cell in cells.tolist():
            counts[cell] = counts.get(cell, 0) + 1
        margin = sum(weight[c] * math.log1p(n) for c, n in counts.items() if c in weight)
        p = [1 / (1 + math.exp(cut - margin)) for cut in model.cuts]
        r = got[doc_id]
        assert r.severity == pytest.approx(sum(p), abs=1e-5) and r.p_toxic == pytest.approx(p[0], abs=1e-5) and r.grade == sum(x >= 0.5 for x in p)
        assert r.toxic == (p[0] > model.limit) or abs(p[0] - model.limit) < 1e-6
