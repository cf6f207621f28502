"""Peaks within patches: local maxima, centres of mass, watershed regions, pseudo-Voigt fits and peak rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import patch_pixel_to_detector, reta_from_yz


def image(px) -> np.ndarray:
    """A row-major array as a square."""
    return np.asarray(px, float).reshape(int(len(px) ** 0.5), -1)


def shifted(x: np.ndarray, dr: int, dc: int, fill: float) -> np.ndarray:
    """x[r + dr, c + dc] at r, c; fill beyond the edges."""
    reach = max(abs(dr), abs(dc))
    wide = np.pad(x, reach, constant_values=fill)
    return wide[reach + dr : reach + dr + x.shape[0], reach + dc : reach + dc + x.shape[1]]


def maxima_of(x: np.ndarray, d: int, rel: float) -> np.ndarray:
    """Where an image has its local maxima, as local_maxima() defines them."""
    around = x
    for axis in ((0, 1), (1, 0)):  # the maximum of a square is that of its rows' maxima
        around = np.max([shifted(around, k * axis[0], k * axis[1], -np.inf) for k in range(-d, d + 1)], axis=0)
    peak = (x == around) & (x > 0) & (x > rel * x.max())
    level = np.where(peak, x, np.nan)
    for dr, dc in ((0, -1), (-1, 0), (-1, -1), (-1, 1)):
        peak = peak & (shifted(level, dr, dc, np.nan) != x)
    if d:
        peak[:d], peak[-d:], peak[:, :d], peak[:, -d:] = False, False, False, False
    return peak


def spaced_maxima(x: np.ndarray, d: int, rel: float) -> list[tuple[int, int]]:
    """The places of an image's local maxima by falling value (ties row-major), as local_maxima() defines the spaced ones.
    Maxima at less than d are equal ones; a map of what is taken, marked with each one's square, tells who is too near."""
    around = x
    for axis in ((0, 1), (1, 0)):
        around = np.max([shifted(around, k * axis[0], k * axis[1], -np.inf) for k in range(-d, d + 1)], axis=0)
    peak = x == around
    if d and peak.all():  # an even image has none
        return []
    peak &= x > max(x.min(), rel * x.max())
    if d:
        peak[:d], peak[-d:], peak[:, :d], peak[:, -d:] = False, False, False, False
    row, col = np.nonzero(peak)
    order = np.argsort(-x[row, col], kind="stable")
    taken, out, reach = np.zeros(x.shape, bool), [], max(d - 1, 0)
    for r, c in zip(row[order].tolist(), col[order].tolist(), strict=True):
        if not taken[r, c]:
            out.append((r, c))
            taken[max(r - reach, 0) : r + reach + 1, max(c - reach, 0) : c + reach + 1] = True
    return out


def local_maxima(patches: DataFrame, d: int, rel: float, px: str = "px", rule: str = "touching") -> DataFrame:
    """patches: patch_id, px. patch_id, row, col, v of pixels that equal the maximum of their (2d+1) square and lie at least d
    pixels off the edge. One patch is one row: nothing is shuffled.

    rule touching: they exceed rel * patch maximum and 0; of touching equal peaks those without an equal peak left, above,
    above left or above right stay. rule spaced: they exceed rel * maximum and the patch's minimum; taken by falling value
    (ties row-major), each rules out those nearer than d in rows and in columns; an even patch has none."""
    if rule not in ("touching", "spaced"):
        raise ValueError(rule)

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if rule == "touching":
            return np.nonzero(maxima_of(x, d, rel))
        return tuple(np.array(spaced_maxima(x, d, rel), int).reshape(-1, 2).T)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, values in zip(pdf["patch_id"], pdf["px"], strict=True):
                x = image(values)
                row, col = places(x)
                out.append((np.full(len(row), pid), row, col, x[row, col]))
            yield pd.DataFrame(dict(zip(("patch_id", "row", "col", "v"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {})

    return patches.select("patch_id", F.col(px).alias("px")).mapInPandas(run, "patch_id long, row int, col int, v double")


def top_peaks(maxima: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """Up to k brightest maxima of each patch with peak_no from 1; a patch without any gives its brightest pixel. Ties
    go in row-major order."""
    order = Window.partitionBy("patch_id").orderBy(F.desc("v"), "row", "col")
    best = maxima.withColumn("peak_no", F.row_number().over(order)).where(F.col("peak_no") <= k)
    first = F.max(F.struct("v", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b")
    bare = cells.join(maxima.select("patch_id").distinct(), "patch_id", "left_anti").groupBy("patch_id").agg(first)
    bare = bare.select("patch_id", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.v").alias("v"), F.lit(1).alias("peak_no"))
    return best.select("patch_id", "row", "col", "v", "peak_no").unionByName(bare)


def edge_filter(maxima: DataFrame, lrsz: int, srfac: int, c: float | None = None) -> DataFrame:
    """Drops maxima nearer than c fine pixels (2.5 native ones by default) to the patch's edge."""
    c = 2.5 * srfac if c is None else c
    return maxima.where(F.col("row").between(c, lrsz * srfac - c) & F.col("col").between(c, lrsz * srfac - c))


def com_peaks(patches: DataFrame, crop: int, threshold: float = 0.7) -> DataFrame:
    """patches: patch_id, px, peaks (array of (peak_no, row, col)). Centre of mass around each peak (patch_id, peak_no,
    row, col): of the pixels of the crop box, clipped to the patch, at least threshold * the box's maximum; given from the
    unclipped box's corner, as an offset within the clipped one. Without mass: the middle of the clipped box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, values, peaks in zip(pdf["patch_id"], pdf["px"], pdf["peaks"], strict=True):
                x = image(values)
                for p in peaks:
                    r0, c0 = p["row"] - crop // 2, p["col"] - crop // 2
                    box = x[max(r0, 0) : r0 + crop, max(c0, 0) : c0 + crop]
                    w = np.where(box < threshold * box.max(), 0, box)
                    mass = w.sum()
                    row, col = (w.sum(1) @ np.arange(len(w)) / mass, w.sum(0) @ np.arange(w.shape[1]) / mass) if mass else (len(w) / 2, w.shape[1] / 2)
                    out.append((pid, p["peak_no"], r0 + row, c0 + col))
            yield pd.DataFrame(out, columns=["patch_id", "peak_no", "row", "col"])

    return patches.select("patch_id", "px", "peaks").mapInPandas(run, "patch_id long, peak_no int, row double, col double")


def listed(peaks: DataFrame) -> DataFrame:
    """patch_id, peaks: each patch's peaks (peak_no, row, col), in order."""
    one = F.struct(*[F.col(c).cast("int").alias(c) for c in ("peak_no", "row", "col")])
    return peaks.groupBy("patch_id").agg(F.array_sort(F.collect_list(one)).alias("peaks"))


def flood(px: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed of -px from markers: the brightest waiting pixel is taken next, first come first served among equals;
    four neighbours. What waits is one whole number a pixel, of the value's rank, the turn and the place, in a frame of
    closed pixels, so that neither bounds nor values are looked at on the way. (Turns decide between equal neighbours,
    so no form that takes a level at once gives the same labels.)"""
    if not mask.any():
        return np.zeros(px.shape, markers.dtype)
    wide, bits = px.shape[1] + 2, (px.size + 4 * sum(px.shape)).bit_length()
    ranks = np.zeros(px.shape, np.int64)
    ranks[mask] = np.unique(-px[mask], return_inverse=True)[1]
    label = np.pad(np.where(mask, markers, 0), 1)
    key = (np.pad(ranks, 1).ravel() << 2 * bits).tolist()
    closed = (~np.pad(mask, 1) | (label > 0)).ravel().tolist()
    shape, label = label.shape, label.ravel().tolist()
    heap = [key[i] | age << bits | i for age, i in enumerate(np.flatnonzero(label).tolist())]
    age, last = len(heap), (1 << bits) - 1
    heapq.heapify(heap)
    while heap:
        i = heapq.heappop(heap) & last
        for j in (i - wide, i - 1, i + 1, i + wide):
            if not closed[j]:
                closed[j], label[j] = True, label[i]
                heapq.heappush(heap, key[j] | age << bits | j)
                age += 1
    return np.array(label, markers.dtype).reshape(shape)[1:-1, 1:-1]


def watershed(patches: DataFrame, rel: float) -> DataFrame:
    """patches: patch_id, px, peaks (array of (peak_no, row, col)). Pixel rows with their peak's number: patch_id, row,
    col, v, peak_no, for pixels above rel * maximum. One patch is one row; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, px, peaks in zip(pdf["patch_id"], pdf["px"], pdf["peaks"], strict=True):
                x = image(px)
                markers = np.zeros(x.shape, int)
                for p in peaks:
                    markers[p["row"], p["col"]] = p["peak_no"]
                label = flood(x, markers, x > rel * x.max())
                r, c = np.nonzero(label)
                out.append((np.full(len(r), pid), r, c, x[r, c], label[r, c]))
            yield pd.DataFrame(dict(zip(("patch_id", "row", "col", "v", "peak_no"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {})

    return patches.select("patch_id", "px", "peaks").mapInPandas(run, "patch_id long, row int, col int, v double, peak_no int")


def watershed_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("patch_id", "peak_no").agg(F.sum("v").alias("isum"), F.count(F.lit(1)).alias("n_pixels"))


def peak_summary(labelled: DataFrame, centres: DataFrame, info: DataFrame, srfac: int, ybc: float, zbc: float) -> DataFrame:
    """Centre-of-mass peak rows. labelled: patch_id, peak_no, row, col, v; centres: patch_id, peak_no, row, col; info:
    patch_id, z00, y00, n_pixels, raw_imax, isum, n_peaks. Regions are pooled to native pixels and joined to the centre
    of the same peak. Ties for the brightest pixel: row-major."""
    pooled = labelled.groupBy("patch_id", "peak_no", F.expr(f"cast(row div {srfac} as int)").alias("pr"), F.expr(f"cast(col div {srfac} as int)").alias("pc")).agg(F.sum("v").alias("v"))
    best = F.max(F.struct("v", (-F.col("pr")).alias("r"), (-F.col("pc")).alias("c"))).alias("b")
    sums = pooled.groupBy("patch_id", "peak_no").agg(F.sum("v").alias("integrated_intensity"), F.count_if(F.col("v") > 0.01).alias("nr_pixels"), best)
    rows = sums.join(centres.select("patch_id", "peak_no", "row", "col"), ["patch_id", "peak_no"]).join(info, "patch_id")
    ycen, zcen = patch_pixel_to_detector(F.col("y00"), F.col("col"), srfac), patch_pixel_to_detector(F.col("z00"), F.col("row"), srfac)
    rows = rows.withColumns({"ycen": ycen, "zcen": zcen, "imax": F.col("b.v"), "max_y": F.col("y00") - F.col("b.c"), "max_z": F.col("z00") - F.col("b.r")})
    radius, eta = reta_from_yz(F.col("ycen"), F.col("zcen"), ybc, zbc)
    fixed = {"sigma_r": 1.0, "sigma_eta": 1.0, "return_code": 0.0, "ret_val": 0.0, "bg": 0.0, "sigma_gr": 1.0, "sigma_lr": 0.0, "sigma_geta": 1.0, "sigma_leta": 0.0, "mu": 0.0, "mask_touched": 0.0, "fit_rmse": 0.0}
    rows = rows.withColumns({"radius": radius, "eta": eta, "diff_y": F.col("max_y") - F.col("ycen"), "diff_z": F.col("max_z") - F.col("zcen"), **{k: F.lit(v) for k, v in fixed.items()}})
    return rows.withColumnsRenamed({"n_pixels": "total_nr_pixels", "raw_imax": "raw_imax", "isum": "raw_sum_intensity"}).drop("b", "row", "col")


def spot_number(peaks: DataFrame, keys: tuple[str, ...] = ("frame_id",), order: tuple[str, ...] = ("patch_id", "peak_no")) -> DataFrame:
    """spot_id: 1, 2, ... within a frame by patch, then peak."""
    return peaks.withColumn("spot_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def smooth(patches: DataFrame, sigma: float = 0, size: int = 1) -> DataFrame:
    """Gaussian (cut at four sigmas), then median filter of each patch, edges reflected. The defaults change nothing."""
    if not sigma and size <= 1:
        return patches
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if sigma else np.ones(1)
    kernel /= kernel.sum()

    def one(px) -> list[float]:
        a = np.asarray(px, float).reshape(int(len(px) ** 0.5), -1)
        if sigma:
            for _ in range(2):
                wide = np.pad(a, ((reach, reach), (0, 0)), "symmetric")
                a = sum(w * wide[k : k + len(a)] for k, w in enumerate(kernel)).T
        if size > 1:
            before = size // 2
            wide = np.pad(a, (before, size - 1 - before), "symmetric")
            windows = np.sort(np.lib.stride_tricks.sliding_window_view(wide, (size, size)).reshape(*a.shape, -1), -1)
            a = windows[..., size * size // 2]
        return a.ravel().tolist()

    return patches.mapInPandas(lambda it: (pdf.assign(px=[one(x) for x in pdf["px"]]) for pdf in it), patches.schema)


#: Widths at the start, and fixed bounds of the widths and the mix (low, high).
START = (0.5, 0.3, 0.5, 0.3, 0.5)
LOW, HIGH = (0.1, 0.05, 0.1, 0.05, 0.0), (3.0, 3.0, 3.0, 3.0, 1.0)


def _sum_peaks(p: np.ndarray, r: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Every peak's shape, (patches, peaks, rows, columns)."""
    r0, e0, gr, ge, lr, le, mix, top = (p[:, :, k, None, None] for k in range(8))
    low = 1 / ((1 + ((r - r0) / lr) ** 2) * (1 + ((e - e0) / le) ** 2))
    return top * (mix * low + (1 - mix) * np.exp(-0.5 * ((r - r0) / gr) ** 2 - 0.5 * ((e - e0) / ge) ** 2))


def fit_batch(target: np.ndarray, r: np.ndarray, e: np.ndarray, guess: np.ndarray, real: np.ndarray, srfac: int, cut: float, steps: int = 20, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (patches x peaks x 8) and mean squared error of each patch after `steps` Adam steps on the squared error,
    bounds kept by a logistic map. target, r, e: (patches, rows, columns); guess: R, eta, intensity (patches x peaks x 3);
    real: which peaks there are, patches being padded to the same number. The cut applies to the final error alone."""
    shape = (*guess.shape[:2], 8)
    start, low, high = np.empty(shape), np.empty(shape), np.empty(shape)
    start[..., :2], start[..., 2:7], start[..., 7] = guess[..., :2], START, guess[..., 2]
    low[..., :2], low[..., 2:7], low[..., 7] = guess[..., :2] - (2.0, 0.1), LOW, 0
    high[..., :2], high[..., 2:7], high[..., 7] = guess[..., :2] + (2.0, 0.1), HIGH, guess[..., 2] + 400 / max(srfac, 1)
    t = np.clip((start - low) / (high - low + 1e-12), 1e-6, 1 - 1e-6)
    raw, m, v = np.log(t / (1 - t)), np.zeros(shape), np.zeros(shape)
    r, e, there = r[:, None], e[:, None], real[:, :, None, None]
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-raw))
        p = low + (high - low) * s
        r0, e0, gr, ge, lr, le, mix, top = (p[:, :, k, None, None] for k in range(8))
        a, b, c, d = (r - r0) / gr, (e - e0) / ge, (r - r0) / lr, (e - e0) / le
        g, ca, da = np.exp(-0.5 * a * a - 0.5 * b * b), 1 + c * c, 1 + d * d
        low_part = 1 / (ca * da)
        error = 2 * (np.where(there, top * (mix * low_part + (1 - mix) * g), 0).sum(1) - target)[:, None]
        gg, ll = top * (1 - mix) * g, top * mix * low_part
        slope = (gg * a / gr + ll * 2 * c / (lr * ca), gg * b / ge + ll * 2 * d / (le * da), gg * a * a / gr, gg * b * b / ge, ll * 2 * c * c / (lr * ca), ll * 2 * d * d / (le * da), top * (low_part - g), mix * low_part + (1 - mix) * g)
        grad = np.stack([(error * x).sum((2, 3)) for x in slope], 2) * (high - low) * s * (1 - s)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        raw = raw - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    p = low + (high - low) / (1 + np.exp(-raw))
    fit = np.where(there, _sum_peaks(p, r, e), 0).sum(1)
    fit = np.where(fit >= cut, fit, 0) if cut > 0 else fit
    return p, ((fit - target) ** 2).mean((1, 2))


def fit_patch(target: np.ndarray, r: np.ndarray, e: np.ndarray, guess: np.ndarray, srfac: int, cut: float, steps: int = 20, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """fit_batch() of one patch: parameters (peaks x 8) and mean squared error."""
    p, cost = fit_batch(target[None], r[None], e[None], guess[None], np.ones((1, len(guess)), bool), srfac, cut, steps, rate)
    return p[0], float(cost[0])


#: Widths at the start of bounded fits, and when they end: relative fall of the cost, relative size of a step.
BOUNDED_START, COST_TOL, STEP_TOL = (0.3, 0.3, 0.3, 0.3, 0.5), 1e-8, 1e-8


def _slopes(p: np.ndarray, r: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of a patch's peaks (patches, pixels) and its slope in every parameter (patches, pixels, peaks * 8)."""
    r0, e0, gr, ge, lr, le, mix, top = (p[:, :, k, None] for k in range(8))
    r, e = r[:, None], e[:, None]
    a, b, c, d = (r - r0) / gr, (e - e0) / ge, (r - r0) / lr, (e - e0) / le
    g, ca, da = np.exp(-0.5 * a * a - 0.5 * b * b), 1 + c * c, 1 + d * d
    low = 1 / (ca * da)
    one = mix * low + (1 - mix) * g
    gg, ll = top * (1 - mix) * g, top * mix * low
    each = (gg * a / gr + 2 * ll * c / (lr * ca), gg * b / ge + 2 * ll * d / (le * da), gg * a * a / gr, gg * b * b / ge, 2 * ll * c * c / (lr * ca), 2 * ll * d * d / (le * da), top * (low - g), one)
    slope = np.stack(each, -1)  # patches, peaks, pixels, 8
    return (top * one).sum(1), slope.transpose(0, 2, 1, 3).reshape(len(p), r.shape[2], -1)


def fit_bounded(target: np.ndarray, r: np.ndarray, e: np.ndarray, guess: np.ndarray, real: np.ndarray, srfac: int, cut: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters (patches x peaks x 8), mean squared error and whether it came to an end, of bounded least-squares fits
    of all patches together; arguments as by fit_batch(). The model is 0 where its sum is below the cut.

    Damped Gauss-Newton steps with the model's own slopes, in parameters scaled by the root of their distance to the bound
    that the cost pushes them to, so that they near a bound without running into it; of a step that would cross bounds
    the shortened and the reflected form are tried. Each patch has its own damping, which falls when a step lowers its
    cost and grows when not; a step never raises the cost. Patches that have come to an end drop out of the batch.
    """
    n, many = real.shape
    x, low, high = (np.ones((n, many, 8)) for _ in range(3))
    x[..., :2], x[..., 2:7], x[..., 7] = guess[..., :2], BOUNDED_START, guess[..., 2]
    low[..., :2], low[..., 2:7], low[..., 7] = guess[..., :2] - (2.0, 0.1), LOW, 0
    high[..., :2], high[..., 2:7], high[..., 7] = guess[..., :2] + (2.0, 0.1), HIGH, guess[..., 2] + 400 / srfac
    x[..., 7] *= real  # peaks that only fill up a patch have no intensity, and stay so
    there = np.repeat(real, 8, 1)
    x, low, high = (v.reshape(n, -1) for v in (x, low, high))
    inside = np.where(there, 1e-10 * (high - low), 0)
    x = np.where(there, np.clip(x, low + inside, np.maximum(low, high) - inside), x)
    t, r, e = (v.reshape(n, -1) for v in (target, r, e))

    def modelled(at: np.ndarray, x: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
        f, j = _slopes(x.reshape(len(at), many, 8), r[at], e[at]) if slopes else (_sum_peaks(x.reshape(len(at), many, 8), r[at][:, None, None], e[at][:, None, None]).sum((1, 2)), None)
        below = f < cut
        return np.where(below, 0, f) - t[at], None if j is None else np.where(below[..., None], 0, j) * there[at][:, None]

    at = np.arange(n)
    off, j = modelled(at, x, True)
    cost, damp, ended = (off * off).sum(1), np.full(n, 1e-3), ~np.isfinite((off * off).sum(1))
    square, slope = j.transpose(0, 2, 1) @ j, np.einsum("npk,np->nk", j, off)
    for _ in range(steps):
        at = np.flatnonzero(~ended)
        if not len(at):
            break
        own, g = there[at], slope[at]
        scale = np.sqrt(np.where(own, np.where(g < 0, high[at] - x[at], x[at] - low[at]), 1))
        a = square[at] * scale[:, :, None] * scale[:, None, :]
        main = np.einsum("nkk->nk", a)
        main += np.where(own, np.abs(g) + damp[at][:, None] * np.maximum(main, 1e-12), 1)
        step = np.where(own, scale * np.linalg.solve(a, -(scale * g)[..., None])[..., 0], 0)
        room = np.where(step > 0, high[at] - x[at], np.where(step < 0, low[at] - x[at], 0))
        reach = np.where(step != 0, room / np.where(step != 0, step, 1), np.inf)  # the part of the step up to each bound
        first = reach.min(1)
        new = x[at] + step * np.minimum(1, 0.995 * first)[:, None]
        now = (modelled(at, new, False)[0] ** 2).sum(1)
        if len(over := np.flatnonzero(first < 1)):
            turned = np.where(reach[over] < 1, 2 * room[over] - step[over], step[over])
            other = np.clip(x[at[over]] + turned, low[at[over]] + inside[at[over]], np.maximum(low[at[over]], high[at[over]]) - inside[at[over]])
            cost_other = (modelled(at[over], other, False)[0] ** 2).sum(1)
            wins = cost_other < now[over]
            new[over[wins]], now[over[wins]] = other[wins], cost_other[wins]
        better = now < cost[at]
        moved = np.abs(new - x[at]).max(1) <= STEP_TOL * (STEP_TOL + np.abs(x[at]).max(1))
        settled = better & (cost[at] - now <= COST_TOL * cost[at]) | moved | (damp[at] > 1e12)
        good = at[better]
        x[good], cost[good] = new[better], now[better]
        damp[at] = np.where(better, np.maximum(damp[at] / 5, 1e-12), damp[at] * 4)
        ended[at[settled]] = True
        if len(go := good[~ended[good]]):
            off, j = modelled(go, x[go], True)
            square[go], slope[go] = j.transpose(0, 2, 1) @ j, np.einsum("npk,np->nk", j, off)
    return x.reshape(n, many, 8), cost / t.shape[1], ended & np.isfinite(cost)


#: Numbers in the arrays of patches that are fitted together (peaks x pixels), of which some forty are held at once: what
#: the processor's own memory holds is faster, and beside a full heap more had an executor near 3000 MB.
FIT_CELLS = 50_000
FIT = "patch_id long, peak_no int, r double, eta double, sigma_gr double, sigma_geta double, sigma_lr double, sigma_leta double, mu double, imax_fit double, integrated_intensity double, imax double, max_row int, max_col int, nr_pixels long, fit_rmse double, failed boolean"


def fit_pseudo_voigt(patches: DataFrame, srfac: int, ybc: float, zbc: float, int_thresh: float = 10.0, form: str = "adam") -> DataFrame:
    """patches: patch_id, z00, y00, px, native (native-resolution px), peaks (array of (peak_no, row, col)). One row per
    peak; patches whose fit fails give a single row with failed set, to be kept as an error table. Patches of a batch that
    have as many peaks are fitted together. No shuffle.

    form adam: a fixed number of gradient steps; bounded: least squares to the end, a fit that comes to none fails. The
    cut int_thresh / srfac**2 holds for the final error in the one, within the model in the other."""
    if form not in ("adam", "bounded"):
        raise ValueError(form)

    def some(pdf: pd.DataFrame) -> list[tuple]:
        most = max(1, max(map(len, pdf["peaks"])))
        x = np.stack([image(px) for px in pdf["px"]])
        side = x.shape[1]
        gy = pdf["y00"].to_numpy(float)[:, None, None] + np.arange(side) / srfac
        gz = pdf["z00"].to_numpy(float)[:, None, None] + np.arange(side)[:, None] / srfac
        r = np.hypot(gy - ybc, gz - zbc)
        e = np.degrees(np.arccos(np.clip((gz - zbc) / np.where(r == 0, 1, r), -1, 1))) * np.where(gy < ybc, -1, 1)
        guess, real = np.ones((len(pdf), most, 3)), np.zeros((len(pdf), most), bool)
        for n, peaks in enumerate(pdf["peaks"]):
            for k, q in enumerate(peaks):
                at = n, q["row"], q["col"]
                guess[n, k], real[n, k] = (r[at], e[at], x[at]), True
        with np.errstate(all="ignore"):
            if form == "adam":
                p, cost = fit_batch(x, r, e, guess, real, srfac, int_thresh / srfac**2)
            else:
                p, cost, ended = fit_bounded(x, r, e, guess, real, srfac, int_thresh / srfac**2)
                cost = np.where(ended, cost, np.nan)
            each = _sum_peaks(p, r[:, None], e[:, None])
        rows: list[tuple] = []
        for n, (pid, native, peaks) in enumerate(zip(pdf["patch_id"], pdf["native"], pdf["peaks"], strict=True)):
            if not (len(peaks) and np.isfinite(cost[n]) and np.isfinite(p[n][real[n]]).all()):
                rows.append((pid, None, *[None] * 13, None, True))
                continue
            own = image(native)
            for k, q in enumerate(peaks):
                pooled = each[n, k].reshape(side // srfac, srfac, side // srfac, srfac).sum((1, 3))
                row, col = np.unravel_index(pooled.argmax(), pooled.shape)
                rows.append((pid, q["peak_no"], *p[n, k].tolist(), each[n, k].sum(), pooled.max(), row, col, np.count_nonzero(pooled * own), cost[n] ** 0.5, False))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows: list[tuple] = []
            for many, own in pdf.groupby(pdf["peaks"].map(len)):
                step = max(1, (FIT_CELLS if form == "adam" else 2 * FIT_CELLS) // (len(pdf["px"].iloc[0]) * max(1, many)))
                rows += [row for lo in range(0, len(own), step) for row in some(own.iloc[lo : lo + step])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FIT.split(", ")])

    return patches.mapInPandas(run, FIT)


def fit_rmse(fit: DataFrame, cells: DataFrame) -> DataFrame:
    """Root mean squared difference of two sets of pixel rows, by patch."""
    pair = fit.withColumnRenamed("v", "f").join(cells, ["patch_id", "row", "col"])
    return pair.groupBy("patch_id").agg(F.sqrt(F.avg((F.col("f") - F.col("v")) * (F.col("f") - F.col("v")))).alias("fit_rmse"))


def fit_peak_rows(fits: DataFrame, info: DataFrame, srfac: int, ybc: float, zbc: float) -> DataFrame:
    """Fitted peaks as peak rows: the centre is shifted to the middle of fine pixels, R and eta are not. nPeaks counts
    the patch's fitted peaks. info: patch_id, z00, y00, n_pixels, raw_imax, isum."""
    shift = -(1 - 1 / srfac) / 2
    rows = fits.where("not failed").withColumn("n_peaks", F.count(F.lit(1)).over(Window.partitionBy("patch_id"))).join(info, "patch_id")
    rows = rows.withColumns({"ycen": ybc + F.col("r") * F.sin(F.radians("eta")) + shift, "zcen": zbc + F.col("r") * F.cos(F.radians("eta")) + shift, "max_y": F.col("y00") + F.col("max_col"), "max_z": F.col("z00") + F.col("max_row")})
    rows = rows.withColumns({"sigma_r": F.greatest("sigma_gr", "sigma_lr"), "sigma_eta": F.greatest("sigma_geta", "sigma_leta"), "diff_y": F.col("max_y") - F.col("ycen"), "diff_z": F.col("max_z") - F.col("zcen")})
    rows = rows.withColumns({"return_code": F.lit(0.0), "ret_val": F.col("fit_rmse"), "bg": F.lit(0.0), "mask_touched": F.lit(0.0)})
    return rows.withColumnsRenamed({"r": "radius", "n_pixels": "total_nr_pixels", "isum": "raw_sum_intensity"}).drop("failed", "max_row", "max_col")
