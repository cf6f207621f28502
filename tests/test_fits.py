"""Bounded fits and spaced maxima against plain loops."""

import numpy as np
import pytest

from diffspark.functions.shapes import pseudo_voigt_np
from diffspark.operators import peaks
from diffspark.plans import workloads
from diffspark.sources import fixtures

rng = np.random.default_rng(11)


def grid(side, srfac, y00, z00, ybc, zbc):
    gy, gz = np.meshgrid(y00 + np.arange(side) / srfac, z00 + np.arange(side) / srfac)
    r = np.hypot(gy - ybc, gz - zbc)
    return r, np.degrees(np.arccos((gz - zbc) / r)) * np.where(gy < ybc, -1, 1)


def case(many, side=40, srfac=2):
    y00, z00 = rng.integers(300, 500, 2)
    r, e = grid(side, srfac, y00, z00, 100.0, 80.0)
    at = []
    while len(at) < many:
        p = tuple(rng.integers(6, side - 6, 2))
        if all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) > 9 for q in at):
            at.append(p)
    true = np.array([[r[p] + rng.uniform(-0.2, 0.2), e[p] + rng.uniform(-0.02, 0.02), *rng.uniform((0.4, 0.1, 0.4, 0.1), (1.5, 0.3, 1.5, 0.3)), rng.uniform(0.1, 0.9), rng.uniform(200, 900)] for p in at])
    x = pseudo_voigt_np(r, e, true).sum(0)
    return r, e, x, at, true


def together(cases, fit, srfac, cut, **more):
    most = max(len(c[3]) for c in cases)
    guess, real = np.ones((len(cases), most, 3)), np.zeros((len(cases), most), bool)
    for n, (r, e, x, at, _) in enumerate(cases):
        for k, p in enumerate(at):
            guess[n, k], real[n, k] = (r[p], e[p], x[p]), True
    return fit(*(np.stack([c[k] for c in cases]) for k in (2, 0, 1)), guess, real, srfac, cut, **more), guess, real


def test_bounded_fits_recover_rendered_peaks_and_beat_the_other_form():
    cases = [case(1 + k % 3) for k in range(24)]
    (p, cost, ended), guess, real = together(cases, peaks.fit_bounded, 2, 0.0)
    (_, other), *_ = together(cases, peaks.fit_batch, 2, 0.0)
    assert ended.all() and (cost <= other).all()
    exact = 0
    for n, (_, _, x, at, true) in enumerate(cases):
        one = p[n][: len(at)]
        assert (np.abs(one[:, 0] - true[:, 0]) < 0.1).all() and (np.abs(one[:, 1] - true[:, 1]) < 0.01).all()
        exact += np.allclose(one, true, rtol=1e-3, atol=1e-3)
        low = np.column_stack([guess[n, : len(at), :2] - (2, 0.1), np.tile(peaks.LOW, (len(at), 1)), np.zeros(len(at))])
        high = np.column_stack([guess[n, : len(at), :2] + (2, 0.1), np.tile(peaks.HIGH, (len(at), 1)), guess[n, : len(at), 2] + 200])
        assert (one >= low).all() and (one <= high).all()
        assert cost[n] < 1e-4 * (x**2).mean()
    assert exact >= 20


def test_slopes_are_those_of_the_model():
    r, e, _, _, true = case(2)
    f, j = peaks._slopes(true[None], r.reshape(1, -1), e.reshape(1, -1))
    assert np.allclose(f[0], pseudo_voigt_np(r, e, true).sum(0).ravel())
    for k in range(16):
        d = np.zeros(16)
        d[k] = 1e-5
        up, down = (pseudo_voigt_np(r, e, true + s * d.reshape(2, 8)).sum(0).ravel() for s in (1, -1))
        assert np.allclose(j[0, :, k], (up - down) / 2e-5, rtol=1e-4, atol=1e-3)


def test_patches_fitted_together_are_fitted_as_alone_and_no_step_raises_the_cost():
    cases = [case(1 + k % 4) for k in range(8)]
    noisy = [(r, e, np.round(x + rng.normal(0, 3, x.shape)), at, true) for r, e, x, at, true in cases]
    (p, cost, _), *_ = together(noisy, peaks.fit_bounded, 2, 5.0)
    for n, c in enumerate(noisy):
        (one, alone, _), *_ = together([c], peaks.fit_bounded, 2, 5.0)
        assert np.isclose(cost[n], alone[0], rtol=1e-6) and np.allclose(p[n][: len(c[3])], one[0], rtol=1e-3, atol=1e-3)
    costs = [together(noisy, peaks.fit_bounded, 2, 5.0, steps=k)[0][1] for k in (1, 2, 4, 8, 16, 64)]
    assert all((b <= a + 1e-12).all() for a, b in zip(costs, costs[1:], strict=False))


def test_cut_is_part_of_the_bounded_model():
    r, e, x, at, true = case(1)
    cut = 30.0
    flat = np.where(x < cut, 0, x)
    (p, cost, _), *_ = together([(r, e, flat, at, true)], peaks.fit_bounded, 2, cut)
    (q, _, _), *_ = together([(r, e, flat, at, true)], peaks.fit_bounded, 2, 0.0)
    off = [abs(v[0, 0, 7] - true[0, 7]) for v in (p, q)]
    assert cost[0] < 1.0 and off[0] < off[1]


def test_failed_patches_are_told_apart(spark):
    r, e, x, at, _ = case(1, 20, 1)
    schema = "patch_id long, z00 int, y00 int, px array<double>, native array<double>, peaks array<struct<peak_no:int,row:int,col:int>>"
    rows = [(1, 80, 100, x.ravel().tolist(), x.ravel().tolist(), [(1, *map(int, at[0]))]), (2, 80, 100, [float("nan")] * 400, [0.0] * 400, [(1, 3, 3)]), (3, 80, 100, x.ravel().tolist(), x.ravel().tolist(), [])]
    out = {r.patch_id: r for r in peaks.fit_pseudo_voigt(spark.createDataFrame(rows, schema).coalesce(1), 1, 50.0, 40.0, 0.0, form="bounded").collect()}
    assert {k: r.failed for k, r in out.items()} == {1: False, 2: True, 3: True}
    with pytest.raises(ValueError, match="other"):
        peaks.fit_pseudo_voigt(spark.createDataFrame(rows, schema), 1, 50.0, 40.0, form="other")


def spaced_by_loops(x, d, rel):
    n, m = x.shape
    best = [(r, c) for r in range(n) for c in range(m) if x[r, c] == max(x[i, j] for i in range(max(r - d, 0), min(r + d + 1, n)) for j in range(max(c - d, 0), min(c + d + 1, m)))]
    if len(best) == n * m:
        return []
    best = [(r, c) for r, c in best if x[r, c] > x.min() and x[r, c] > rel * x.max() and d <= r < n - d and d <= c < m - d]
    out = []
    for r, c in sorted(best, key=lambda p: (-x[p], p)):
        if all(max(abs(r - i), abs(c - j)) >= d for i, j in out):
            out.append((r, c))
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_spaced_maxima_by_loops(d):
    for k in range(60):
        x = rng.integers(0, 2 + k % 6, (18, 15)).astype(float)  # many plateaus, up to the border
        if k % 5 == 0:
            x += 7  # the least value counts
        for rel in (0.0, 0.2, 0.6):
            assert peaks.spaced_maxima(x, d, rel) == spaced_by_loops(x, d, rel)
    even = np.full((12, 12), 4.0)
    assert peaks.spaced_maxima(even, d, 0.1) == [] == peaks.spaced_maxima(even * 0, d, 0.1)


def test_spaced_maxima_take_one_of_a_wide_plateau(spark):
    x = np.zeros((20, 20))
    x[8:12, 6:13] = 5.0
    patch = spark.createDataFrame([(1, x.ravel().tolist())], "patch_id long, px array<double>")
    for d, many in ((1, 28), (2, 8), (3, 6), (5, 2)):
        got = [(r.row, r.col) for r in peaks.local_maxima(patch, d, 0.2, rule="spaced").collect()]
        assert got == spaced_by_loops(x, d, 0.2) and len(got) == many, (d, got)


def test_first_workload_by_bounded_fits(spark, data, tmp_path):
    labelled = workloads.frames_to_spots(fixtures.pixels(spark, data), fixtures.PARAMS, fixtures.RINGS, fixtures.THRESH)
    found = {f: workloads.frames_to_peaks(labelled, fixtures.PARAMS, method="pv", form=f, rule="spaced", failures=str(tmp_path / f)).toPandas() for f in ("adam", "bounded")}
    both = found["bounded"].merge(found["adam"], on=["patch_id", "peak_no"], suffixes=("", "_adam"))
    both = both[both["n_peaks"] == both["n_peaks_adam"]]
    assert len(both) > 20 and (both["fit_rmse"] <= both["fit_rmse_adam"] + 1e-9).mean() > 0.98
    assert spark.read.parquet(str(tmp_path / "bounded")).columns == ["scan_id", "frame_id", "patch_id"]
    auto = workloads.frames_to_peaks(labelled, fixtures.PARAMS, method="auto").toPandas()
    assert auto.groupby(["scan_id", "frame_id"])["spot_id"].apply(lambda v: sorted(v) == list(range(1, len(v) + 1))).all()
