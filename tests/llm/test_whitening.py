"""Whitening against exact arithmetic and numpy's own solver."""

import math

import numpy as np
import pytest

from diffspark.llm import whitening


def vectors_of(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n string, x int").repartition(3)


def brute(rows, components=16):
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in rows.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), [int(v) for v in fit.sum(0)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1], p[:, ::-1]
    out = {}
    for k, v in x.items():
        z = np.array([(n * a - b) / n for a, b in zip(v, s, strict=True)])
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for c in range(min(components, len(s))):
            out[k, c + 1] = (n, deviation, z @ p[:, c] / math.sqrt(e[c]), e[c] / np.trace(cov))
    return out


def test_results_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 24)) * np.linspace(3, 0.2, 24) + 5
    rows = {k: v.tolist() for k, v in enumerate(base)}
    rows |= {1000 + k: rows[0] for k in range(300)}  # one vector with much of the table
    bad = [(5000, None, "a", 1), (5001, [], "a", 1), (5002, [None] + [0.0] * 23, "a", 1), (5003, [float("nan")] * 24, "a", 1), (5004, [float("inf")] * 24, "a", 1)]
    got = whitening.whiten(vectors_of(spark, [(k, v, "a", 1) for k, v in rows.items()] + bad)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
        s = sign.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert r.whitened == pytest.approx(s * w, abs=1e-7)


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    q = q + q @ (np.eye(len(values)) - q.T @ q) / 2
    q = q + q @ (np.eye(len(values)) - q.T @ q) / 2
    return (q * np.asarray(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [[5, 3, 2, 1, 0.5], [1 + 1e-9 * k for k in range(6)] + [3.0], [2, 2, 2, 1], [1e6, 1, 1 + 1e-7, 1e-6], [1.0, 1.0, 1 + 1e-12, 1 - 1e-12], np.linspace(1, 1.001, 40).tolist()])
def test_refinement_reaches_double_precision(values):
    a, q = spectrum(values)
    e, x = whitening.refined_eigh(a)
    want = sorted(values, reverse=True)
    top = max(values)
    assert np.abs(e - np.array(want)).max() < 1e-17 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 1e-17 * top
    order = np.argsort(-np.asarray(values), kind="stable")
    for k in range(len(values)):  # simple eigenvalues: the vector itself
        gap = min((abs(want[k] - v) for j, v in enumerate(want) if j != k), default=1)
        if gap > 1e-10 * top:
            assert abs(abs(x[:, k] @ q[:, order[k]]) - 1) < 1e-15
            assert np.abs(np.abs(x[:, k]) - np.abs(q[:, order[k]])).max() < 1e-15 * max(1, 1e-3 * top / gap)


def test_refinement_beats_its_float32_start():
    a, q = spectrum([1 + 1e-5 * k for k in range(20)])
    start = np.linalg.eigh(a.astype(np.float32))[1]
    x = whitening.refined_eigh(a)[1]
    off = [np.abs(np.abs(v.T @ q) - np.eye(20)[::s]).max() for v, s in ((start.astype(np.longdouble), 1), (x, -1))]
    assert off[0] > 1e-3 and off[1] < 1e-12


def test_degenerate_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0
    same = whitening.whiten(vectors_of(spark, [(k, [1.0, 2.0], "a", 1) for k in range(5)])).collect()
    assert len(same) == 10 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)
    flat = whitening.whiten(vectors_of(spark, [(k, [float(k), 2.0 * k], "a", 1) for k in range(5)] + [(None, [9.0, 18.0], "a", 1)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and len(flat) == 12
    two = whitening.whiten(vectors_of(spark, [(k, [float(k), float(k * k)][: 1 + k % 2], "a", 1) for k in range(8)])).collect()
    assert {(r.vec_id % 2, r.n) for r in two} == {(0, 4), (1, 4)} and len(two) == 4 + 8


def test_huge_entries_are_held_and_long_overflow_is_null(spark):
    got = whitening.whiten(vectors_of(spark, [(k, [1e301 * (-1) ** k, float(k)], "a", 1) for k in range(6)])).collect()
    assert len(got) == 12 and all(r.deviation is None and (r.whitened is not None) == (r.component == 1) for r in got)
