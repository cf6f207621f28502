"""Array jobs against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.functions.shapes import pseudo_voigt_np
from diffspark.operators import peaks, superres, synth
from diffspark.sources import fixtures

rng = np.random.default_rng(5)
MODEL = "model string, layer int, in_ch int, out_ch int, ksize int, act string, w array<double>, b array<double>"


def correlate(x, w, b):
    out = np.zeros((len(w), *x.shape[1:]))
    k = w.shape[2] // 2
    for o in range(len(w)):
        for r in range(x.shape[1]):
            for c in range(x.shape[2]):
                for i in range(len(x)):
                    for dr in range(-k, k + 1):
                        for dc in range(-k, k + 1):
                            if 0 <= r + dr < x.shape[1] and 0 <= c + dc < x.shape[2]:
                                out[o, r, c] += w[o, i, dr + k, dc + k] * x[i, r + dr, c + dc]
        out[o] += b[o]
    return out


@pytest.mark.parametrize("stages,normalise,rescale", [([("m", 2), ("m", 2)], False, (4,)), ([("m", 2), ("m", 2)], True, ()), ([("m", 8)], False, (8,))])
def test_networks_by_loops(spark, stages, normalise, rescale):
    w0, b0, w1, b1 = rng.normal(size=(2, 1, 3, 3)), rng.normal(size=2), rng.normal(size=(1, 2, 3, 3)), rng.normal(size=1)
    model = spark.createDataFrame([("m", 0, 1, 2, 3, "lr", w0.ravel().tolist(), b0.tolist()), ("m", 1, 2, 1, 3, "s", w1.ravel().tolist(), b1.tolist())], MODEL)
    px = rng.uniform(0, 9, (3, 3))
    got = {r.srfac: np.array(r.px).reshape(r.side, -1) for r in superres.super_resolve(spark.createDataFrame([(1, px.ravel().tolist())], "patch_id long, px array<double>"), model, stages, normalise, rescale).collect()}
    x, factor = px, 1
    for _, f in stages:
        factor *= f
        x = np.kron(x / f**2, np.ones((f, f)))
        y = correlate((x / x.max())[None], w0, b0)
        x = 1 / (1 + np.exp(-correlate(np.where(y > 0, y, 0.01 * y), w1, b1)[0]))
        x = x / x.max() if normalise else x * px.sum() / x.sum() if factor in rescale else x
        assert np.allclose(got[factor], x, rtol=1e-4)


def test_flood_by_search():
    """Every pixel goes to the marker that reaches it first when the brightest waiting pixel is always taken next."""
    for _ in range(20):
        px = rng.integers(1, 10**6, (6, 6)).astype(float)  # no ties
        markers = np.zeros((6, 6), int)
        markers[1, 1], markers[4, 4], markers[1, 4] = 1, 2, 3
        mask = px > 2e5
        want, waiting = np.where(mask, markers, 0), [(r, c) for r, c in ((1, 1), (1, 4), (4, 4)) if mask[r, c]]
        while waiting:
            r, c = max(waiting, key=lambda x: px[x])
            waiting.remove((r, c))
            for i, j in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if 0 <= i < 6 and 0 <= j < 6 and mask[i, j] and not want[i, j]:
                    want[i, j] = want[r, c]
                    waiting.append((i, j))
        assert (peaks.flood(px, markers, mask) == want).all()


def test_region_statistics_of_real_regions(spark, data):
    found = peaks.top_peaks(peaks.local_maxima(fixtures.patches(spark, data), 1, 0.3), fixtures.cells(spark, data))
    rows = fixtures.patches(spark, data).join(peaks.listed(found), "patch_id").where("patch_id < 40")
    got = {(r.patch_id, r.peak_no): (r.isum, r.n_pixels) for r in peaks.watershed_stats(peaks.watershed(rows, 0.1)).collect()}
    want = {}
    for r in rows.collect():
        x, m = np.array(r.px).reshape(8, 8), np.zeros((8, 8), int)
        for p in r.peaks:
            m[p.row, p.col] = p.peak_no
        label = peaks.flood(x, m, x > 0.1 * x.max())
        want |= {(r.patch_id, k): (x[label == k].sum(), (label == k).sum()) for k in np.unique(label[label > 0]).tolist()}
    assert got == want


def numeric_fit(target, r, e, guess, srfac, steps=20, rate=0.15):
    """The same steps with numeric gradients."""
    n = len(guess)
    low = np.array([[g[0] - 2, g[1] - 0.1, 0.1, 0.05, 0.1, 0.05, 0, 0] for g in guess])
    high = np.array([[g[0] + 2, g[1] + 0.1, 3, 3, 3, 3, 1, g[2] + 400 / srfac] for g in guess])
    start = np.array([[g[0], g[1], 0.5, 0.3, 0.5, 0.3, 0.5, g[2]] for g in guess])
    t = np.clip((start - low) / (high - low), 1e-6, 1 - 1e-6)
    raw, m, v = np.log(t / (1 - t)), np.zeros((n, 8)), np.zeros((n, 8))
    value = lambda raw: low + (high - low) / (1 + np.exp(-raw))
    cost = lambda raw: ((pseudo_voigt_np(r, e, value(raw)).sum(0) - target) ** 2).sum()
    for step in range(1, steps + 1):
        grad = np.zeros((n, 8))
        for k in np.ndindex(n, 8):
            d = np.zeros((n, 8))
            d[k] = 1e-5
            grad[k] = (cost(raw + d) - cost(raw - d)) / 2e-5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        raw = raw - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return value(raw)


def test_twenty_steps_of_a_fit_and_its_rows(spark):
    side, srfac, ybc, zbc = 8, 2, 20.0, 18.0
    cases = []
    for pid, spots_ in ((1, [(3, 3)]), (2, [(2, 5), (5, 2)])):
        gy, gz = np.meshgrid(40 + np.arange(side) / srfac, 30 + np.arange(side) / srfac)
        r, e = np.hypot(gy - ybc, gz - zbc), np.degrees(np.arccos((gz - zbc) / np.hypot(gy - ybc, gz - zbc)))
        true = np.array([[r[s], e[s], 0.8, 0.6, 0.7, 0.5, 0.3, 50.0 + 9 * k] for k, s in enumerate(spots_)])
        px = np.round(pseudo_voigt_np(r, e, true).sum(0), 3)
        cases.append((pid, 30, 40, px, [(k + 1, *s) for k, s in enumerate(spots_)], r, e))
    schema = "patch_id long, z00 int, y00 int, px array<double>, native array<double>, peaks array<struct<peak_no:int,row:int,col:int>>"
    rows = spark.createDataFrame([(p, z, y, x.ravel().tolist(), synth.pool(x, srfac).ravel().tolist(), q) for p, z, y, x, q, *_ in cases] + [(3, 30, 40, [float("nan")] * 64, [0.0] * 16, [(1, 1, 1)])], schema).coalesce(1)
    fits = peaks.fit_pseudo_voigt(rows, srfac, ybc, zbc, 0.0)
    got = {(r.patch_id, r.peak_no): r for r in fits.collect()}
    assert got[3, None].failed
    for pid, _, _, px, q, r, e in cases:
        want = numeric_fit(px, r, e, [(r[a, b], e[a, b], px[a, b]) for _, a, b in q], srfac)
        for (k, *_), p in zip(q, want, strict=True):
            o = got[pid, k]
            assert np.allclose([o.r, o.eta, o.sigma_gr, o.sigma_geta, o.sigma_lr, o.sigma_leta, o.mu, o.imax_fit], p, rtol=1e-3, atol=1e-3)
            one = pseudo_voigt_np(r, e, p[None])[0]
            pooled = synth.pool(one, srfac)
            assert np.isclose(o.integrated_intensity, one.sum(), rtol=1e-3) and (o.max_row, o.max_col) == np.unravel_index(pooled.argmax(), pooled.shape)
    info = spark.createDataFrame([(k, "s", 0, 30, 40, 5, 60.0, 300.0) for k in (1, 2, 3)], "patch_id long, scan_id string, frame_id long, z00 int, y00 int, n_pixels long, raw_imax double, isum double")
    table = {(r.patch_id, r.peak_no): r for r in peaks.fit_peak_rows(fits, info, srfac, ybc, zbc).collect()}
    assert set(table) == {(1, 1), (2, 1), (2, 2)} and table[2, 1].n_peaks == 2
    o = table[1, 1]
    assert np.isclose(o.ycen, ybc + o.radius * np.sin(np.radians(o.eta)) - 0.25) and o.sigma_r == max(o.sigma_gr, o.sigma_lr) and o.max_y == 40 + got[1, 1].max_col


def test_smoothing_by_loops(spark):
    x, sigma = rng.uniform(0, 9, (6, 6)), 0.8
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    mirror = lambda i: i % 12 if i % 12 < 6 else 11 - i % 12
    soft = np.array([[sum(k[a + reach] * k[b + reach] * x[mirror(r + a), mirror(c + b)] for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)) for c in range(6)] for r in range(6)])
    want = np.array([[np.median([soft[mirror(r + a), mirror(c + b)] for a in (-1, 0, 1) for b in (-1, 0, 1)]) for c in range(6)] for r in range(6)])
    got = peaks.smooth(spark.createDataFrame([(1, x.ravel().tolist())], "patch_id long, px array<double>"), sigma, 3).first().px
    assert np.allclose(np.array(got).reshape(6, 6), want)


def test_rings_are_found(spark):
    radius = np.concatenate([rng.normal(20, 0.05, 300), rng.normal(35, 0.05, 200), [50.0, 50.1]])
    out = synth.find_ring_radii(spark.createDataFrame([(float(r),) for r in radius], "radius double"), 20)
    assert sorted((round(r.ring), r.n) for r in out.groupBy("ring").agg(F.count("*").alias("n")).collect()) == [(20, 300), (35, 200)]


def test_rendered_patches_by_loops(spark):
    ybc, zbc, lrsz, cvsz, src, cut, isum = 48.25, 47.75, 8, 16, 4, 1.0, 900.0
    peak = [(70.0, 60.0), (72.0, 61.0)]
    ps = [{"y": y, "z": z, "radius": float(np.hypot(y - ybc, z - zbc)), "eta": float(np.degrees(np.arccos((z - zbc) / np.hypot(y - ybc, z - zbc)))), "sigma_gr": 0.7, "sigma_geta": 0.9, "sigma_lr": 0.6, "sigma_leta": 1.1, "mu": 0.4, "imax": 80.0 - 9 * k, "bg": 0.5} for k, (y, z) in enumerate(peak)]
    fields = list(ps[0])
    rows = spark.createDataFrame([(1, isum, [tuple(p[f] for f in fields) for p in ps])], "patch_id long, isum double, peaks array<struct<" + ",".join(f"{f}:double" for f in fields) + ">>")
    got = {r.srfac: r for r in synth.render_patches(rows, lrsz=lrsz, cvsz=cvsz, src=src, factors=[1, 2, 4], ybc=ybc, zbc=zbc, cut=cut).collect()}
    n, x = cvsz * src, np.zeros((cvsz * src, cvsz * src))
    for i in range(n):
        for j in range(n):
            z, y = 60 - 8 + i / src, 70 - 8 + j / src
            r = np.hypot(y - ybc, z - zbc)
            e = np.degrees(np.arccos((z - zbc) / r))
            for p in ps:
                a, b, c, d = (r - p["radius"]) / p["sigma_gr"], (e - p["eta"]) / p["sigma_geta"], (r - p["radius"]) / p["sigma_lr"], (e - p["eta"]) / p["sigma_leta"]
                v = p["imax"] / 16 * (p["mu"] / ((1 + c * c) * (1 + d * d)) + (1 - p["mu"]) * np.exp(-0.5 * a * a - 0.5 * b * b))
                x[i, j] += v + p["bg"] / 16 if v > 0 else v
    x *= isum / x.sum()
    x[x < cut / 16] = 0
    x *= isum / x.sum()
    native = x.reshape(16, 4, 16, 4).sum((1, 3))
    row, col = np.unravel_index(native.argmax(), native.shape)
    crop = x[4 * row - 16 : 4 * row + 16, 4 * col - 16 : 4 * col + 16]
    for f in (1, 2, 4):
        small = crop.reshape(8 * f, 4 // f, 8 * f, 4 // f).sum((1, 3))
        small = np.where(small < cut / f**2, 0, small) if small.max() > cut / f**2 else small
        assert np.allclose(np.array(got[f].px).reshape(8 * f, -1), small / small.max(), atol=1e-5)
        assert (got[f].y00, got[f].z00) == (62 + col - 4, 52 + row - 4) and np.allclose(got[f].peak_y, [(y - got[f].y00) * f for y, _ in peak])
    # the relational form of the same pooling
    cells = spark.createDataFrame([(1, i, j, float(crop[i, j])) for i in range(32) for j in range(32)], "patch_id long, row int, col int, v double")
    for f in (1, 2, 4):
        back = np.zeros((8 * f, 8 * f))
        for r in synth.multires_cells(cells, src, [f], 32, cut).collect():
            back[r.row, r.col] = r.v
        assert np.allclose(back, np.array(got[f].px).reshape(8 * f, -1), atol=1e-5)


def test_places_keep_to_all_limits(spark):
    patches = spark.range(60).selectExpr("id as patch_id", "20.0D + id % 3 as ring_r", "cast(1 + id % 3 as int) as n_peaks")
    out = synth.place_peaks(patches, 2.0, 2.0, 12.0, 48.25, 47.75, 7).toPandas().merge(patches.toPandas(), on="patch_id")
    assert out["ok"].all() and (out.groupby("patch_id").size() == out.groupby("patch_id")["n_peaks"].first()).all()
    assert np.allclose(np.hypot(out["y"] - 48.25, out["z"] - 47.75), out["r"]) and (abs(out["r"] - out["ring_r"]) < 2).all()
    first = out[out["k"] == 1]
    assert first["eta"].abs().between(3, 177).all()
    for _, one in out.groupby("patch_id"):
        yz = one[["y", "z"]].to_numpy()
        d = [np.hypot(*(a - b)) for i, a in enumerate(yz) for b in yz[:i]]
        assert all(2 < x < 12 for x in d)
    again = synth.place_peaks(patches.repartition(7), 2.0, 2.0, 12.0, 48.25, 47.75, 7).toPandas()
    assert (again.sort_values(["patch_id", "k"])["y"].to_numpy() == out.sort_values(["patch_id", "k"])["y"].to_numpy()).all()


def test_flood_with_ties_as_by_a_queue_of_pixels():
    """First come, first served among equal pixels: the same steps over rows and columns."""
    for k in range(60):
        shape = (rng.integers(1, 12), rng.integers(1, 12))
        px, mask = rng.integers(0, 2 + k % 4, shape).astype(float), rng.uniform(size=shape) < 0.9
        markers = np.where(rng.uniform(size=shape) < 0.1, rng.integers(1, 5, shape), 0)
        want, waiting, age = np.where(mask, markers, 0), [], 0
        for r, c in zip(*np.nonzero(want), strict=True):
            waiting.append((-px[r, c], age, r, c))
            age += 1
        while waiting:
            waiting.sort()
            _, _, r, c = waiting.pop(0)
            for i, j in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if 0 <= i < shape[0] and 0 <= j < shape[1] and mask[i, j] and not want[i, j]:
                    want[i, j] = want[r, c]
                    waiting.append((-px[i, j], age, i, j))
                    age += 1
        assert (peaks.flood(px, markers, mask) == want).all()
