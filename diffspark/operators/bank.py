"""Peak banks: drawing frames from peaks, reconstruction errors and the selection of good peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_peak_filter(peaks: DataFrame) -> DataFrame:
    """Single peaks away from the poles of eta."""
    return peaks.where((F.col("n_peaks") <= 1) & (F.abs("eta") > 3) & (F.abs("eta") < 177))


def recon_error_filter(peaks: DataFrame, below: float | str | None) -> DataFrame:
    """Errors below the limit; none (or "None") keeps all. NaN and null errors fail."""
    if below is None or str(below).lower() == "none":
        return peaks
    return peaks.where((F.col("error_reconstruction") < float(below)) & ~F.isnan("error_reconstruction"))


def quality_filter(bank: DataFrame, error_below: float, intensity_above: float) -> DataFrame:
    """Small error, enough intensity, width ratios (R over eta) within (0.1, 10) and widths within (0.1, 2), all strict."""
    within = lambda c, a, b: (c > a) & (c < b) & ~F.isnan(c)
    ok = (F.col("error_reconstruction") < error_below) & (F.col("integrated_intensity") > intensity_above) & ~F.isnan("integrated_intensity")
    for s in "gl":
        ok = ok & within(F.try_divide(F.col(f"sigma_{s}r"), F.col(f"sigma_{s}eta")), 0.1, 10)
    for c in ("sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta"):
        ok = ok & within(F.col(c), 0.1, 2)
    return bank.where(ok)


DRAWN = ["ycen", "zcen", "radius", "eta", "sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta", "mu", "imax", "bg"]


def draw_frame(peaks: DataFrame, ybc: float, zbc: float, height: int, width: int, i_thresh: float = 0.0, size: int = 10) -> DataFrame:
    """scan_id, frame_id, z, y, intensity: every peak drawn into a window of size pixels, its background added where it
    exceeds 5 % of its maximum; windows add up and are clipped to the frame; sums below i_thresh become 0. Peaks with a
    null or NaN parameter are left out. A batch of peaks is drawn at once; the one shuffle adds windows up by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yc, zc, r0, e0, gr, ge, lr, le, mu, top, bg = (pdf[c].to_numpy(float)[:, None, None] for c in DRAWN)
            step = np.arange(size)
            y, z = np.broadcast_arrays(((yc.astype(int) - size / 2).astype(int) + step), ((zc.astype(int) - size / 2).astype(int) + step[:, None]))
            r = np.sqrt((y - ybc) ** 2 + (z - zbc) ** 2)
            e = np.degrees(np.arccos(np.clip((z - zbc) / np.where(r == 0, 1, r), -1, 1))) * np.where(y < ybc, -1, 1)
            v = mu * top / ((1 + ((r - r0) / lr) ** 2) * (1 + ((e - e0) / le) ** 2)) + (1 - mu) * top * np.exp(-0.5 * ((r - r0) / gr) ** 2 - 0.5 * ((e - e0) / ge) ** 2)
            v = np.where(v > 0.05 * v.max((1, 2), keepdims=True), v + bg, v)
            on = (z >= 0) & (z < height) & (y >= 0) & (y < width)
            of = np.broadcast_to(np.arange(len(pdf))[:, None, None], on.shape)[on]
            yield pd.DataFrame({"scan_id": pdf["scan_id"].to_numpy()[of], "frame_id": pdf["frame_id"].to_numpy()[of], "z": z[on], "y": y[on], "v": v[on]})

    whole = peaks.select("scan_id", F.col("frame_id").cast("long"), *[F.col(c).cast("double") for c in DRAWN]).dropna(subset=DRAWN)
    rows = whole.mapInPandas(run, "scan_id string, frame_id long, z int, y int, v double")
    sums = rows.groupBy("scan_id", "frame_id", "z", "y").agg(F.sum("v").alias("intensity"))
    return sums.withColumn("intensity", F.when(F.col("intensity") < i_thresh, 0.0).otherwise(F.col("intensity")))


def reconstruction_error(peaks: DataFrame, generated: DataFrame, measured: DataFrame, size: int) -> DataFrame:
    """scan_id, peak_id, error_reconstruction: sum of absolute differences over the sum measured, in each peak's window
    (clipped to what has pixels). A frame's peaks and pixels, both bounded by the detector, meet by one shuffle of each
    side; pixels given more than once add up. No measured intensity: null."""
    pixel = lambda df, g, e: df.select("scan_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("z").cast("long").alias("z"), F.col("y").cast("long").alias("y"), g.alias("g"), e.alias("e"))
    value = F.coalesce(F.col("intensity"), F.lit(0.0)).cast("double")
    both = pixel(generated, value, F.lit(0.0)).unionByName(pixel(measured, F.lit(0.0), value))
    first = lambda c: (F.col(c).cast("long") - size / 2).cast("long")
    windows = peaks.select("scan_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("peak_id").cast("long").alias("peak_id"), first("zcen").alias("z0"), first("ycen").alias("y0"))

    def run(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        step = np.arange(size)
        z = own["z0"].to_numpy()[:, None, None] + step[:, None]
        y = own["y0"].to_numpy()[:, None, None] + step
        key, inverse = np.unique(cells["z"].to_numpy() << 32 | cells["y"].to_numpy() & 0xFFFFFFFF, return_inverse=True)
        g, e = (np.append(np.bincount(inverse, cells[c].to_numpy(), len(key)), 0.0) for c in "ge")
        wanted = z << 32 | y & 0xFFFFFFFF
        at = np.searchsorted(key, wanted)
        at = np.where(np.append(key, -(1 << 62))[at] == wanted, at, len(key))
        difference, total = np.abs(g[at] - e[at]).sum((1, 2)), e[at].sum((1, 2))
        error = [None if t == 0 else d / t for d, t in zip(difference, total, strict=True)]
        return pd.DataFrame({"scan_id": own["scan_id"], "peak_id": own["peak_id"], "error_reconstruction": pd.Series(error, index=own.index, dtype=object)})

    keys = ["scan_id", "frame_id"]
    return windows.groupBy(*keys).cogroup(both.groupBy(*keys)).applyInPandas(run, "scan_id string, peak_id long, error_reconstruction double")
