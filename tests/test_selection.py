"""Exact percentiles by selection, distinct draws, and batched placing."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.operators import synth, training

rng = np.random.default_rng(3)


def exact(values, p):
    v = sorted(values)
    x = p * (len(v) - 1)
    low, high = v[math.floor(x)], v[math.ceil(x)]
    return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high


@pytest.mark.parametrize(("bins", "at_once"), [(64, 1), (64, 40), (4096, 1), (4096, 10**5)])
def test_percentiles_equal_sorted_values(spark, monkeypatch, bins, at_once):
    monkeypatch.setattr(training, "SORTED", at_once)
    groups = {
        "even": rng.uniform(0, 1, 4001).tolist(),
        "ties": rng.integers(0, 4, 3000).astype(float).tolist(),
        "wide": (10.0 ** rng.uniform(-200, 200, 1500)).tolist(),
        "close": (1 + rng.integers(0, 900, 2000) * 2.0**-52).tolist(),
        "zeros": [0.0] * 500 + [5e-324, 1e-300, 3.0],
        "one": [7.5],
        "two": [1.0, 2.0],
        "endless": [1.0, 2.0, float("inf"), float("inf")],
        None: [3.0, 1.0, 2.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rows = spark.createDataFrame(data, "g string, d double").repartition(6)
    shares = [0.0, 0.5, 0.75, 0.95, 0.995, 1.0]
    got = {r.g: r.q for r in training.exact_percentiles(rows, ["g"], "d", shares, bins).collect()}
    assert set(got) == set(groups) - {None} or set(got) == set(groups)
    for g in got:
        for p, q in zip(shares, got[g], strict=True):
            assert q == pytest.approx(exact(groups[g], p), rel=1e-15), (g, p)
    every = [v for g, vs in groups.items() for v in vs]
    assert training.exact_percentiles(rows, [], "d", [0.5, 0.9], bins).first().q == pytest.approx([exact(every, 0.5), exact(every, 0.9)], rel=1e-15)


def test_groups_that_are_joined_give_the_same(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id % 7 as g", "cast((id * id) % 1013 as double) as d")
    told = sorted(map(str, training.exact_percentiles(rows, ["g"], "d", [0.1, 0.9]).collect()))
    monkeypatch.setattr(training, "GROUPS_TOLD", 0)
    assert sorted(map(str, training.exact_percentiles(rows, ["g"], "d", [0.1, 0.9]).collect())) == told
    monkeypatch.setattr(training, "SORTED", 10)
    assert sorted(map(str, training.exact_percentiles(rows, ["g"], "d", [0.1, 0.9]).collect())) == told
    assert training.exact_percentiles(rows.limit(0), ["g"], "d", [0.5]).count() == 0


def test_error_statistics_of_null_groups_and_no_errors(spark):
    pairs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), (None, 0.0, 3.0), ("n", None, 1.0)], "g string, truth double, pred double")
    got = {r.g: r for r in training.error_stats(pairs, ["g"], accuracy=None).collect()}
    assert (got["a"].mean_error, got["a"].p50, got["a"].p75) == (2.0, 2.0, 2.5) and got[None].p99_5 == 3.0 and got["n"].mean_error is None and got["n"].p50 is None


def windows_of(spark, sizes):
    rows = [(no, k, n, 100 * no + k, float(k)) for no, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "ring_no int, rank long, ring_size long, peak_id long, imax double")


def test_draws_are_distinct_and_as_many_as_asked(spark):
    out = synth.sample_ring_peaks(spark, 6000, [1, 2, 3], windows_of(spark, (3, 2, 40)), 4, 5).toPandas()
    assert out["ok"].all()
    for (_, ring, n), own in out.groupby(["patch_id", "ring_no", "n_peaks"]):
        assert len(own) == n == own["peak_id"].nunique() and sorted(own["k"]) == list(range(1, n + 1))
        assert ring != 3 and n <= (3, 2, 40)[ring]
    full = out[(out["ring_no"] == 0) & (out["n_peaks"] == 3)]  # a ring of exactly n peaks always succeeds
    patches = spark.range(6000).select("id", (synth.draw(5, "id", F.lit("n")) % 3).alias("n"), (synth.draw(5, "id", F.lit("ring")) % 4).alias("ring"))
    assert full["patch_id"].nunique() == patches.where("n = 2 and ring = 0").count() > 300


def test_every_choice_of_peaks_is_as_likely(spark):
    out = synth.sample_ring_peaks(spark, 30000, [2], windows_of(spark, (5,)), 1, 11)
    seen = collections.Counter(tuple(sorted(r.p)) for r in out.groupBy("patch_id").agg(F.collect_list("peak_id").alias("p")).collect())
    assert len(seen) == 10 and sum((n - 3000) ** 2 / 3000 for n in seen.values()) < 28  # chi-square of 9: one in a thousand


def test_places_do_not_hang_on_batches(spark, monkeypatch):
    patches = spark.range(300).selectExpr("id as patch_id", "20.0D + id % 5 as ring_r", "cast(1 + id % 4 as int) as n_peaks")
    first = synth.place_peaks(patches.coalesce(1), 2.0, 2.0, 9.0, 48.25, 47.75, 7).toPandas().sort_values(["patch_id", "k"])
    monkeypatch.setattr(synth, "PLACE_CELLS", 100)
    again = synth.place_peaks(patches.repartition(9), 2.0, 2.0, 9.0, 48.25, 47.75, 7).toPandas().sort_values(["patch_id", "k"])
    assert (first.to_numpy() == again.to_numpy()).all() and first["ok"].all()
    none = synth.place_peaks(patches, 2.0, 9.0, 9.0, 48.25, 47.75, 7, attempts=20).toPandas()
    assert (none.groupby("patch_id")["ok"].first() == (none.groupby("patch_id").size() == 1)).all() and len(none) == len(first)


def test_first_draws_are_even():
    u = synth.uniforms(1, np.arange(2000), np.arange(4), 5)
    assert u.shape == (2000, 4, 5) and abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == u.size
    assert np.abs(np.corrcoef(u.reshape(2000, -1).T) - np.eye(20)).max() < 0.1
