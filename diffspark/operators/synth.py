"""Synthetic patches: ring windows, seeded sampling and placing of peaks, rendering at several resolutions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import pseudo_voigt_np


#: Numbers drawn together when peaks are placed.
PLACE_CELLS = 2_000_000


def draw(seed: int, *parts: Column | str) -> Column:
    """A whole number below 2**52 from a digest of seed and parts: the same in every engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column | str) -> Column:
    return draw(seed, *parts) / F.lit(float(1 << 52))


def clamp_imax(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def find_ring_radii(bank: DataFrame, least_members: int, bin_px: float = 0.05, quantile: float = 0.1) -> DataFrame:
    """Adds ring, the radius of the peak's cluster by mean shift, and drops clusters of fewer members. Radii are counted
    in narrow bins over the cluster; only the histogram, bounded by the detector's radius, is shifted."""
    bins = bank.groupBy(F.floor(F.col("radius") / bin_px).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("radius").alias("s")).toPandas()
    if bins.empty:
        return bank.withColumn("ring", F.lit(None).cast("double"))
    bins = bins.sort_values("b")
    centre, n = (bins["s"] / bins["n"]).to_numpy(), bins["n"].to_numpy(float)
    share = max(1.0, quantile * n.sum())
    # bandwidth: how far, on average, a peak looks to see that share of all peaks
    reach = []
    for x in centre:
        d = np.abs(centre - x)
        order = np.argsort(d)
        reach.append(d[order][np.searchsorted(np.cumsum(n[order]), share).clip(max=len(d) - 1)])
    width = max(float(np.average(reach, weights=n)), bin_px)
    seeds = np.unique(np.round(centre / width)) * width
    found: list[tuple[float, float]] = []
    for x in seeds:
        for _ in range(300):
            near = np.abs(centre - x) <= width
            if not near.any():
                break
            new = float(np.average(centre[near], weights=n[near]))
            if abs(new - x) < 1e-3 * width:
                break
            x = new
        if near.any():
            found.append((float(n[near].sum()), float(x)))
    rings: list[float] = []
    for _, x in sorted(found, reverse=True):
        if all(abs(x - r) >= width for r in rings):
            rings.append(x)
    nearest = F.array_min(F.transform(F.lit(sorted(rings)), lambda r: F.struct(F.abs(F.col("radius") - r).alias("d"), r.alias("r"))))["r"]
    labelled = bank.withColumn("ring", nearest)
    large = labelled.groupBy("ring").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_members).select("ring")
    return labelled.join(large, "ring")


def cluster_counts(labelled: DataFrame, label: str, least: int) -> DataFrame:
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ring_windows(bank: DataFrame, rings: list[float], var_r: float) -> DataFrame:
    """ring_no, ring_r, rank (from 0 by peak_id) and peak: each peak once for every ring window it lies in (strict).
    Ranking a window of many peaks takes no single task: peaks are ranked within buckets of their ids, whose sizes are
    summed up in order."""
    near = F.filter(F.transform(F.lit([float(r) for r in rings]), lambda r, k: F.struct(k.alias("no"), r.alias("r"))), lambda x: F.abs(F.col("radius") - x["r"]) < var_r)
    rows = bank.select("*", F.explode(near).alias("w")).withColumns({"ring_no": F.col("w.no"), "ring_r": F.col("w.r"), "bucket": F.floor(F.col("peak_id") / 65536)}).drop("w")
    sizes = rows.groupBy("ring_no", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ring_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("ring_no", "bucket", before.alias("before"), F.sum("n").over(Window.partitionBy("ring_no")).alias("ring_size"))
    rank = F.row_number().over(Window.partitionBy("ring_no", "bucket").orderBy("peak_id")) - 1
    return rows.withColumn("k", rank).join(starts, ["ring_no", "bucket"]).withColumn("rank", F.col("before") + F.col("k")).drop("k", "before", "bucket")


def sample_ring_peaks(spark, n_patches: int, n_peaks: list[int], windows: DataFrame, n_rings: int, seed: int) -> DataFrame:
    """patch_id, k (from 1) and the peak drawn: a number of peaks from the list and a ring, both uniform, then that many
    different peaks of the ring's window, every choice of them as likely. One draw a peak is enough: the i-th of n out of
    s ranks is drawn below s - n + i, and s - n + i itself takes the place of one that was drawn before. ok is false only
    for patches of a ring with fewer peaks, which have none. Patches meet peaks by an equi-join on (ring, rank)."""
    sizes = windows.groupBy("ring_no").agg(F.max("ring_size").alias("ring_size"))
    patch = spark.range(n_patches).select(F.col("id").alias("patch_id"))
    patch = patch.withColumns({"n_peaks": F.element_at(F.lit([int(x) for x in n_peaks]), (draw(seed, "patch_id", F.lit("n")) % len(n_peaks) + 1).cast("int")), "ring_no": (draw(seed, "patch_id", F.lit("ring")) % n_rings).cast("int")})
    patch = patch.join(F.broadcast(sizes), "ring_no", "left").withColumn("ok", F.coalesce(F.col("ring_size") >= F.col("n_peaks"), F.lit(False)))
    left = F.col("ring_size") - F.col("n_peaks")
    drawn = F.transform(F.sequence(F.lit(0), F.col("n_peaks") - 1), lambda i: F.struct((left + i).alias("last"), (draw(seed, F.col("patch_id"), i) % F.greatest(left + i + 1, F.lit(1))).alias("rank")))
    ranks = F.aggregate(drawn, F.array().cast("array<bigint>"), lambda had, x: F.array_append(had, F.when(F.array_contains(had, x["rank"]), x["last"]).otherwise(x["rank"])))
    patch = patch.where("ok").withColumn("ranks", ranks)
    rows = patch.select("patch_id", "n_peaks", "ring_no", "ok", F.posexplode("ranks").alias("k0", "rank"))
    return rows.join(windows.drop("n_peaks"), ["ring_no", "rank"]).withColumn("k", F.col("k0") + 1).drop("k0", "ring_size")


def order_by_imax(sampled: DataFrame) -> DataFrame:
    """k anew: peaks of a patch by falling IMax, ties by peak_id; the first is the patch's anchor."""
    return sampled.withColumn("k", F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("imax"), "peak_id")))


def sampled_isum(sampled: DataFrame) -> DataFrame:
    return sampled.groupBy("patch_id").agg(F.sum("integrated_intensity").alias("isum"))


def separations(placed: DataFrame, low: float, high: float) -> DataFrame:
    """patch_id, attempt and whether all pairwise distances lie between low and high (strict); single peaks always do."""
    a, b = placed.select("patch_id", "attempt", F.col("k").alias("k1"), F.col("y").alias("y1"), F.col("z").alias("z1")), placed.select("patch_id", "attempt", "k", "y", "z")
    d = F.hypot(F.col("y") - F.col("y1"), F.col("z") - F.col("z1"))
    pair = a.join(b, ["patch_id", "attempt"]).where("k1 < k").groupBy("patch_id", "attempt").agg(F.min(d).alias("least"), F.max(d).alias("most"))
    every = placed.select("patch_id", "attempt").distinct().join(pair, ["patch_id", "attempt"], "left")
    return every.withColumn("ok", F.coalesce((F.col("least") > low) & (F.col("most") < high), F.lit(True)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of whole numbers (the usual 64-bit finishing steps)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def uniforms(seed: int, ids: np.ndarray, attempts: np.ndarray, many: int) -> np.ndarray:
    """Numbers in [0, 1), (ids, attempts, many), that hang on seed, id, attempt and place alone."""
    step = np.uint64(0x9E3779B97F4A7C15)
    key = mixed(mixed(np.uint64(seed % 2**64) + step + np.zeros(1, np.uint64)) ^ ids.astype(np.uint64))
    key = mixed(key[:, None] + step * (attempts.astype(np.uint64) + np.uint64(1)))
    return (mixed(key[..., None] + step * np.arange(1, many + 1, dtype=np.uint64)) >> np.uint64(11)) * 2.0**-53


def place_peaks(patches: DataFrame, var_r: float, sep_min: float, sep_max: float, ybc: float, zbc: float, seed: int, attempts: int = 10_000) -> DataFrame:
    """patches: patch_id, ring_r, n_peaks. One row per peak: patch_id, k, y, z, r, eta, ok. The first peak lies on the
    ring (R within var_r, eta in +-[3, 177]), the others within a square of sep_max around it and within var_r of the
    ring; the whole set is drawn again until all distances lie between sep_min and sep_max. Attempts are bounded: a
    patch that finds no place keeps its last draw with ok = false. All patches of a batch that still seek a place draw
    together, a run of attempts at a time; the first good one counts, so batches and runs change nothing."""

    def drawn(ids: np.ndarray, ring: np.ndarray, n: int, tries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y, z of every peak (patches, attempts, peaks, 2), and which attempts keep to all limits."""
        u = uniforms(seed, ids, tries, 2 * n + 1)
        r = ring[:, None] + var_r * (2 * u[..., 0] - 1)
        eta = np.radians(3 + 174 * u[..., 1]) * np.where(u[..., 2] < 0.5, -1, 1)
        first = np.stack([ybc + r * np.sin(eta), zbc + r * np.cos(eta)], -1)[:, :, None]
        off = sep_max * (2 * u[..., 3:].reshape(len(ids), len(tries), n - 1, 2) - 1)
        yz = np.concatenate([first, first + off], 2)
        radius = np.hypot(yz[..., 0] - ybc, yz[..., 1] - zbc)
        ok = (np.abs(radius - ring[:, None, None]) < var_r).all(2)
        a, b = np.triu_indices(n, 1)
        d = np.hypot(yz[:, :, a, 0] - yz[:, :, b, 0], yz[:, :, a, 1] - yz[:, :, b, 1])
        return yz, ok & ((d > sep_min) & (d < sep_max)).all(2)

    def placed(ids: np.ndarray, ring: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out, good, run, begun = np.empty((len(ids), n, 2)), np.zeros(len(ids), bool), 4, 0
        while begun < attempts and not good.all():
            at = np.flatnonzero(~good)
            tries = np.arange(begun, min(attempts, begun + run))
            for lo in range(0, len(at), step := max(1, PLACE_CELLS // (len(tries) * n * n))):
                some = at[lo : lo + step]
                yz, ok = drawn(ids[some], ring[some], n, tries)
                pick = np.where(ok.any(1), ok.argmax(1), len(tries) - 1)
                out[some], good[some] = yz[np.arange(len(some)), pick], ok.any(1)
            begun, run = begun + run, min(2 * run, 1024)
        return out, good

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for n, own in pdf.groupby("n_peaks"):
                ids, ring, n = own["patch_id"].to_numpy(), own["ring_r"].to_numpy(float), int(n)
                yz, ok = placed(ids, ring, n)
                y, z = yz[..., 0].ravel(), yz[..., 1].ravel()
                radius = np.hypot(y - ybc, z - zbc)
                angle = np.degrees(np.arccos(np.clip((z - zbc) / np.where(radius == 0, 1, radius), -1, 1))) * np.where(y < ybc, -1, 1)
                parts.append(pd.DataFrame({"patch_id": np.repeat(ids, n), "k": np.tile(np.arange(1, n + 1, dtype=np.int32), len(ids)), "y": y, "z": z, "r": radius, "eta": angle, "ok": np.repeat(ok, n)}))
            yield pd.concat(parts) if parts else pd.DataFrame({})

    return patches.select("patch_id", "ring_r", "n_peaks").where("n_peaks > 0").mapInPandas(run, "patch_id long, k int, y double, z double, r double, eta double, ok boolean")


#: Numbers in the arrays of windows that are drawn together.
DRAW_CELLS = 100_000
SHAPE = ["radius", "eta", "sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta", "mu", "imax", "bg"]


def draw_peaks(windows: DataFrame, peaks: DataFrame, size: int, srfac: int, ybc: float, zbc: float, i_thresh: float = 0.0, two_widths: bool = True) -> DataFrame:
    """windows: patch_id, y, z, each patch once; peaks: patch_id and a peak's columns. patch_id, row, col, v of all points
    that geometry.patch_grid() has for the windows: the sum of the patch's peaks, each with its background where it is
    positive; if a patch's maximum exceeds i_thresh, values up to i_thresh become 0. A peak with a null adds nothing, a
    patch of no other has nulls; a patch without peaks has no row. Only peaks and windows are shuffled, by patch: a batch of
    windows is drawn at once, and its points are neither joined nor sorted."""
    side = size * srfac
    row, col = (x.ravel() for x in np.divmod(np.arange(side * side, dtype=np.int32), side))

    def drawn(y: np.ndarray, z: np.ndarray, p: dict[str, np.ndarray], many: np.ndarray) -> np.ndarray:
        """(windows, points); p holds the peaks of all windows in order, many their numbers."""
        dy, dz = (np.trunc(np.trunc(c) - size / 2)[:, None] + k / float(srfac) - centre for c, k, centre in ((y, col, ybc), (z, row, zbc)))
        r = np.sqrt(dy * dy + dz * dz)
        e = np.degrees(np.arccos(np.clip(np.divide(dz, r, out=np.ones_like(r), where=r != 0), -1, 1))) * np.where(dy < 0, -1.0, 1.0)
        if not (many == 1).all():
            r, e = (np.repeat(x, many, 0) for x in (r, e))
        r0, e0, gr, ge, lr, le, mu, top, bg = (p[c][:, None] for c in SHAPE)
        if not two_widths:
            lr, le = gr, ge
        a, b, c, d = (r - r0) / gr, (e - e0) / ge, (r - r0) / lr, (e - e0) / le
        v = mu * (top / ((1 + c * c) * (1 + d * d))) + (1 - mu) * (top * np.exp(-0.5 * a * a - 0.5 * b * b))
        v = np.where(v > 0, v + bg, v)
        if (many == 1).all():
            return v
        out, some = np.full((len(many), side * side), np.nan), many > 0
        if some.any():
            out[some] = np.add.reduceat(v, (np.cumsum(many) - many)[some])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DRAW_CELLS // side**2)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                listed = batch.column("peaks").flatten()
                many = pc.list_value_length(batch.column("peaks")).to_numpy()
                y, z = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "z"))
                with np.errstate(all="ignore"):
                    v = drawn(y, z, {c: listed.field(k).to_numpy(zero_copy_only=False) for k, c in enumerate(SHAPE)}, many)
                    v = np.where(~(v.max(1, keepdims=True) <= i_thresh) & (v <= i_thresh), 0.0, v)
                bare = np.repeat((many == 0) | np.isnan(y) | np.isnan(z), side * side)
                ids = batch.column("patch_id").take(pa.array(np.repeat(np.arange(len(many)), side * side)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(row, len(many))), pa.array(np.tile(col, len(many))), pa.array(v.ravel(), mask=bare if bare.any() else None)], names=["patch_id", "row", "col", "v"])

    whole = F.struct(*[F.col(c).cast("double").alias(c) for c in SHAPE])
    known = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in SHAPE]) == 0, whole)  # nulls aren't listed
    listed = peaks.groupBy("patch_id").agg(F.sort_array(F.collect_list(known)).alias("peaks"))
    rows = windows.select("patch_id", F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).hint("merge").join(listed, "patch_id")
    kind = rows.schema["patch_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"patch_id {kind}, row int, col int, v double")


def pool(x: np.ndarray, f: int) -> np.ndarray:
    """Sums of f*f blocks; incomplete blocks at the edges are dropped."""
    if f == 1:
        return x
    h, w = len(x) // f, x.shape[1] // f
    rows = x[: h * f].reshape(h, f, -1).sum(1)
    return sum(rows[:, k : w * f : f] for k in range(1, f)) + rows[:, : w * f : f]


def polar(y: np.ndarray, z: np.ndarray, ybc: float, zbc: float) -> tuple[np.ndarray, np.ndarray]:
    """Radius and eta (degrees) of all points of a grid."""
    gy, gz = np.meshgrid(y, z)
    r = np.hypot(gy - ybc, gz - zbc)
    return r, np.degrees(np.arccos(np.clip((gz - zbc) / np.where(r == 0, 1, r), -1, 1))) * np.where(gy < ybc, -1, 1)


def sector(r0: float, e0: float, dr: float, de: float) -> tuple[float, float, float, float]:
    """The box around the points whose radius and eta (degrees) lie within dr and de of r0 and e0: least and greatest y, then
    z, from the beam's centre."""
    low, high = max(r0 - dr, 0.0), max(r0 + dr, 0.0)
    if de >= 180:
        return -high, high, -high, high
    turns = [math.radians(a) for a in (e0 - de, e0 + de, *range(90 * math.ceil((e0 - de) / 90), math.floor(e0 + de) + 1, 90))]
    s, c = [math.sin(t) for t in turns], [math.cos(t) for t in turns]
    return tuple(f(low * f(v), high * f(v)) for v in (s, c) for f in (min, max))


#: Gaussians beside a Lorentzian are drawn to e**-45 of their top, which a sum of patches' points can't hold; those by
#: themselves to the least number, since they have a background as far as that.
REACH, REACH_ALONE = 45.0, 746.0
#: Points of a canvas that Lorentzians are added to together: the processor's own memory holds them.
BAND_CELLS = 30_000


def kinds(p: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Of peaks (as by pseudo_voigt_np()): which are well above 0 up to radius far, for their Lorentzian, and which are odd,
    neither this nor a Gaussian alone."""
    r0, e0, gr, ge, lr, le, mix, top = p.T
    with np.errstate(all="ignore"):
        least = mix / ((1 + ((far + np.abs(r0)) / lr) ** 2) * (1 + ((360 + np.abs(e0)) / le) ** 2))
        odd = ~np.isfinite(p).all(1) | (top <= 0) | (gr == 0) | (ge == 0) | ~((least > 1e-24) & (mix <= 1) | (mix == 0))
    return ~odd & (mix > 0), odd


def add_peaks(x: np.ndarray, r: np.ndarray, e: np.ndarray, p: np.ndarray, bg: np.ndarray, wide: np.ndarray, odd: np.ndarray, corner: tuple[float, float], src: int, room: tuple[np.ndarray, np.ndarray]) -> None:
    """Sets x to the sum of peaks, each with its background where it is positive. p: as by pseudo_voigt_np(); wide, odd: by
    kinds(); corner: y, z of the first point, from the beam's centre; room: for some rows, twice.

    The backgrounds of wide peaks are added as one number, and Gaussians are drawn in boxes that hold what counts of them. Odd
    peaks go by the plain formula."""
    r0, e0, gr, ge, lr, le, mix, top = p.T
    low_r, low_e = lr * lr, le * le
    weight = mix * top * low_r * low_e
    x.fill(bg[wide].sum())
    for k in range(len(p)):
        if odd[k]:
            each = pseudo_voigt_np(r, e, p[k : k + 1])[0]
            x += np.where(each > 0, each + bg[k], each)
            continue
        if mix[k] < 1:
            reach = math.sqrt(2 * (REACH if wide[k] else REACH_ALONE))
            y_low, y_high, z_low, z_high = sector(r0[k], e0[k], reach * abs(gr[k]), reach * abs(ge[k]))
            cut = lambda low, high, first, size: slice(min(max(int((low - first) * src) - 1, 0), size), min(max(int((high - first) * src) + 2, 0), size))
            box = cut(z_low, z_high, corner[1], x.shape[0]), cut(y_low, y_high, corner[0], x.shape[1])
            a, b = r[box] - r0[k], e[box] - e0[k]
            a *= a
            b *= b
            a *= -0.5 / gr[k] ** 2
            b *= -0.5 / ge[k] ** 2
            a += b
            if wide[k]:
                g = np.exp(np.maximum(a, -REACH, out=a), out=a)  # numbers near the least ones take a hundred times as long
                g *= (1 - mix[k]) * top[k]
                x[box] += g
            else:
                at = a > -REACH_ALONE
                g = (1 - mix[k]) * top[k] * np.exp(a[at])
                x[box][at] += np.where(g > 0, g + bg[k], g)
    for lo in range(0, len(x), step := max(1, BAND_CELLS // x.shape[1])):
        band, r_band, e_band = (v[lo : lo + step] for v in (x, r, e))
        one, two = (v[: len(band)] for v in room)
        for k in np.flatnonzero(wide):
            np.subtract(r_band, r0[k], out=one)
            np.subtract(e_band, e0[k], out=two)
            np.multiply(one, one, out=one)
            np.multiply(two, two, out=two)
            one += low_r[k]
            two += low_e[k]
            np.multiply(one, two, out=one)
            np.divide(weight[k], one, out=one)
            band += one


#: Points of the grid around all patches of a batch whose places are worked out together; patches that lie farther apart have
#: theirs worked out by themselves.
LATTICE_CELLS = 4_000_000


def render_patches(patches: DataFrame, *, lrsz: int, cvsz: int, src: int, factors: list[int], ybc: float, zbc: float, cut: float, cut_factor: float = 1.0) -> DataFrame:
    """patches: patch_id, isum, peaks (array of y, z, radius, eta, sigma_gr, sigma_geta, sigma_lr, sigma_leta, mu, imax,
    bg; the anchor first). One row per patch and factor: patch_id, srfac, side, px (maximum 1), y00, z00, peak_y, peak_z
    (in fine pixels), drawn (false: nothing of the peak is seen around it; at the source factor only), blank, n_peaks, isum
    as given, and total, the sum of px.

    Drawn at the source factor around the anchor, scaled to isum, cut, scaled again; the brightest native pixel fixes
    the crop. A patch below the cut, or whose crop leaves the canvas, is blank: one row with blank set and no pixels.
    R and eta channels follow from y00, z00 and srfac and aren't stored.
    """
    own = cut_factor * cut / src**2
    fields = ("y", "z", "radius", "eta", "sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta", "mu", "imax", "bg")
    n, side = cvsz * src, lrsz * src

    def one(isum: float, p: np.ndarray, places, room: list[np.ndarray]) -> list[tuple]:
        """(factor, pixels, y00, z00, peak_y, peak_z, drawn) of each factor; none if the patch is blank."""
        x = room[0]
        first = [int(int(p[0, k]) - cvsz / 2) for k in (0, 1)]
        corner = first[0] - ybc, first[1] - zbc
        shape, bg = np.column_stack([p[:, 2:9], p[:, 9] / src**2]), p[:, 10] / src**2
        wide, odd = kinds(shape, math.hypot(*(max(abs(c), abs(c + cvsz)) for c in corner)))
        if not odd.any() and (bg >= 0).all() and isum >= 0:  # nothing is negative, so that backgrounds may tell a blank patch
            if 0 < isum * (shape[:, 7] + bg).sum() * (1 + 1e-6) <= own * bg[wide].sum() * n * n:
                return []
        r, e = places(*first)
        add_peaks(x, r, e, shape, bg, wide, odd, corner, src, room[1:])
        mass = x.sum()
        if not mass > 0 or not isum / mass * x.max() > own:
            return []
        np.multiply(x, x >= own / (isum / mass), out=x)
        scale = isum / x.sum()
        native = pool(x, src) * scale
        row, col = divmod(int(native.argmax()) if native.max() >= cut else 0, native.shape[1])
        r0, c0 = row * src - side // 2, col * src - side // 2
        crop = x[max(r0, 0) : r0 + side, max(c0, 0) : c0 + side] * scale
        if r0 < 0 or c0 < 0 or crop.shape != (side, side):
            return []
        y00, z00 = int(first[0] + c0 / src), int(first[1] + r0 / src)
        out = []
        for f in factors:
            small = pool(crop, src // f)
            if small.max() > cut / f**2:
                small = np.where(small < cut / f**2, 0, small)
            small = small / small.max()  # a scale to isum before drops out
            py, pz = (p[:, 0] - y00) * f, (p[:, 1] - z00) * f
            seen = None
            if f == src:
                box = lambda c: slice(max(int(c - 5), 0), max(int(c + 5), 0))
                seen = [bool(small[box(b), box(a)].sum() >= 0.1) for a, b in zip(py, pz, strict=True)]
            out.append((f, small.astype(np.float32), y00, z00, py, pz, seen))
        return out

    names = ["patch_id", "srfac", "side", "px", "y00", "z00", "peak_y", "peak_z", "drawn", "blank", "n_peaks", "isum", "total"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.bool_(), pa.int32(), pa.float64(), pa.float64()]
    schema = "patch_id long, srfac int, side int, px array<float>, y00 int, z00 int, peak_y array<double>, peak_z array<double>, drawn array<boolean>, blank boolean, n_peaks int, isum double, total double"

    def listed(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *(0 if x is None else x.size for x in rows)])
        values = np.concatenate([x.ravel() for x in rows if x is not None] or [np.empty(0)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind), mask=pa.array([x is None for x in rows]))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        """One column after another; pixels go as they lie."""
        columns = [listed(c, t.value_type) if k in (3, 6, 7) else pa.array(c, t) for k, (c, t) in enumerate(zip(zip(*rows, strict=True), types, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = [np.empty((n, n)) for _ in range(3)]
        lattice: tuple = ()
        for batch in batches:
            peaks = batch.column("peaks").flatten()
            p = np.column_stack([peaks.field(c).to_numpy(zero_copy_only=False).astype(float) for c in fields])
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("peaks")), 0).to_numpy(zero_copy_only=False))
            anchors = p[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]][:, :2]
            if len(anchors) and np.isfinite(anchors).all():
                lows, highs = (np.trunc(np.trunc(f(anchors, axis=0)) - cvsz / 2).astype(int) for f in (np.min, np.max))
                if lattice and (lattice[0] <= lows).all() and (highs <= lattice[1]).all():
                    pass  # an earlier batch's grid will do
                elif np.prod(highs - lows + cvsz, dtype=float) * src**2 <= LATTICE_CELLS:
                    if lattice and np.prod(np.maximum(highs, lattice[1]) - np.minimum(lows, lattice[0]) + cvsz, dtype=float) * src**2 <= LATTICE_CELLS:
                        lows, highs = np.minimum(lows, lattice[0]), np.maximum(highs, lattice[1])
                    y, z = (lows[k] + np.arange((highs[k] - lows[k] + cvsz) * src) / src for k in (0, 1))
                    lattice = (lows, highs, *polar(y, z, ybc, zbc))

            def places(y: int, z: int) -> tuple[np.ndarray, np.ndarray]:
                if lattice and (lattice[0] <= (y, z)).all() and ((y, z) <= lattice[1]).all():
                    at = slice((z - lattice[0][1]) * src, (z - lattice[0][1]) * src + n), slice((y - lattice[0][0]) * src, (y - lattice[0][0]) * src + n)
                    return lattice[2][at], lattice[3][at]
                return polar(y + np.arange(n) / src, z + np.arange(n) / src, ybc, zbc)

            rows: list[tuple] = []
            for k, (pid, isum) in enumerate(zip(batch.column("patch_id").to_pylist(), batch.column("isum").to_pylist(), strict=True)):
                of = p[ends[k - 1] if k else 0 : ends[k]]
                made = one(isum, of, places, room)
                rows += [(pid, f, len(px), px, y00, z00, py, pz, seen, False, len(of), isum, float(np.cumsum(px, dtype=float)[-1])) for f, px, y00, z00, py, pz, seen in made] or [(pid, *[None] * 8, True, len(of), isum, None)]
                if len(rows) > 200:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return patches.select("patch_id", "isum", "peaks").mapInArrow(run, schema)


def multires_cells(cells: DataFrame, src: int, factors: list[int], side: int, cut: float) -> DataFrame:
    """The same pooling, cut and scaling over pixel rows (patch_id, row, col, v): patch_id, srfac, row, col, v."""
    from .pixels import downscale

    out = None
    for f in factors:
        small = downscale(cells, src // f, side) if f != src else cells.select("patch_id", "row", "col", "v")
        patch = Window.partitionBy("patch_id")
        small = small.withColumn("v", F.when((F.max("v").over(patch) > cut / f**2) & (F.col("v") < cut / f**2), 0.0).otherwise(F.col("v")))
        small = small.withColumn("v", F.try_divide(F.col("v"), F.max("v").over(patch))).select("patch_id", F.lit(f).alias("srfac"), "row", "col", "v")
        out = small if out is None else out.unionByName(small)
    return out


def drop_blank_patches(tables: dict[str, DataFrame], cells: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """All tables without the patches whose source maximum doesn't exceed the threshold."""
    blank = cells.groupBy("patch_id").agg(F.max("v").alias("top")).where(F.col("top") <= threshold).select("patch_id")
    return {name: t.join(blank, "patch_id", "left_anti") for name, t in tables.items()}


def drawn_check(cells: DataFrame, peaks: DataFrame, reach: int = 5, least: float = 0.1) -> DataFrame:
    """Peaks (patch_id, k, row, col as positions) around which the sum within reach pixels is below least."""
    span = F.sequence(F.lit(0), F.lit(2 * reach - 1))
    asked = peaks.select("patch_id", "k", (F.col("row") - reach).cast("int").alias("r0"), (F.col("col") - reach).cast("int").alias("c0"), F.explode(span).alias("i")).select("*", F.explode(span).alias("j"))
    asked = asked.select("patch_id", "k", (F.col("r0") + F.col("i")).alias("row"), (F.col("c0") + F.col("j")).alias("col"))
    sums = asked.join(cells, ["patch_id", "row", "col"], "left").groupBy("patch_id", "k").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("around"))
    return sums.where(F.col("around") < least)
