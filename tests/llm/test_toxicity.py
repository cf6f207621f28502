"""Toxicity: held-out accuracy, found sentences, the noisy-or against plain loops, and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from diffspark.llm import toxicity

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(400)]


def sentence(more=()):
    w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 12))] + list(more)
    rng.shuffle(w)
    return " ".join(w).capitalize() + "."


def document(bad):
    parts = [sentence() for _ in range(rng.randrange(1, 25))]
    at = set()
    if bad:
        at = {rng.randrange(len(parts))}
        for k in at:
            parts[k] = sentence([rng.choice(["qqfool", "zzrat"]) if rng.random() < 0.5 else "xxstem" + rng.choice(VOCABULARY)])
    return " ".join(parts), [parts[k] for k in sorted(at)]


@pytest.fixture(scope="module")
def planted(spark):
    rows = {k: (*document(k % 7 == 0), int(k % 7 == 0)) for k in range(900)}
    docs = spark.createDataFrame([(k, t, "u", 3) for k, (t, _, _) in rows.items()], "doc_id long, text string, score string, held int").repartition(4)
    labels = spark.createDataFrame([(k, y) for k, (_, _, y) in rows.items()], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_documents_and_offending_sentences(planted):
    rows, docs, labels = planted
    out = toxicity.toxicity(docs, labels).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "held", "held_out", "score", "predicted", "offending"}
    right = Counter()
    for r in out:
        text, bad, y = rows[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        if r.held_out:
            right[y, r.predicted] += 1
            found = [text[s.start : s.end] for s in r.offending]
            right["found", y] += found == bad
    assert right[0, 1] <= 2 and right[1, 1] >= 0.95 * (right[1, 0] + right[1, 1])
    assert right["found", 1] >= 0.9 * (right[1, 0] + right[1, 1])


def test_labels_of_held_out_rows_change_nothing(planted):
    _, docs, labels = planted
    held = toxicity._is_held_out("doc_id")
    other = labels.selectExpr("doc_id", "toxic").where(~held).unionByName(labels.where(held).selectExpr("doc_id", "1 - toxic as toxic"))
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(docs, x, keep=["doc_id"]).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]


def test_score_is_the_noisy_or_of_sentences():
    terms = {"bad": 0, "wor-": 1, "worst": 2}
    model = toxicity.Model(terms, np.array([3.0, 1.0, 0.5]), -4.0)
    text = "A bad, bad thing! Worst of all\nplain words here. 12 34. Words, bad worse?"
    p = [1 / (1 + math.exp(4 - x)) for x in (3.0, 1.5, 1.0, 4.0)]  # words: a stem; bad worse: both
    assert [w for _, _, w in toxicity.sentences(text)] == [["a", "bad", "bad", "thing"], ["worst", "of", "all"], ["plain", "words", "here"], ["words", "bad", "worse"]]
    assert model.score(*model.patterns([text])[0]) == pytest.approx(1 - math.prod(1 - x for x in p))
    assert [text[a:b] for a, b, _ in model.offending(text, 0.4)] == ["Words, bad worse?"]
    assert model.score(*model.patterns([""])[0]) == 0 and model.patterns(["... 1 2 !"])[0] == (0, Counter())


def test_gradient_finds_the_least_loss():
    rows = [(1, 2, {(0,): 1}), (1, 0, {(0, 1): 2}), (0, 5, {(1,): 1}), (0, 9, {}), (0, 3, {})] * 4
    terms = [("a", 0.1), ("b", 0.1)]
    decay = 2e-3

    def loss(x):
        total = 0
        for y, plain, sets in rows:
            big = plain * np.logaddexp(0, x[0]) + sum(c * np.logaddexp(0, x[0] + sum(x[1 + t] for t in s)) for s, c in sets.items())
            total += big if not y else -math.log(-math.expm1(-big))
        return total / len(rows) + decay / 2 * sum(v * v for v in x[1:]) / 2

    m = toxicity.learn(rows, terms, steps=4000, rate=0.02)
    x = np.array([m.bias, *m.weights])
    for k in range(3):
        for d in (-0.05, 0.05):
            y = x.copy()
            y[k] += d
            assert loss(x) <= loss(y) + 1e-6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "you qqfool " * 20000, "k"), (None, "text", "k")], "doc_id long, text string, offending string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out if r.doc_id in (1, 2))
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
