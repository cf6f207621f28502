"""The three workloads, made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import omega
from ..operators import bank, frames, peaks, spots, superres, synth
from ..sources.staging import staged


def turned(params: dict, transform: tuple[int, ...]) -> dict:
    """params of frames after image_transform(): every transpose swaps height and width."""
    return {**params, "height": params["width"], "width": params["height"]} if list(transform).count(3) % 2 else params


def frames_to_spots(pixels: DataFrame, params: dict, rings: list[float], thresholds: list[float], correction: DataFrame | None = None, bc: float = 1.0, bad: float = 0.0, skip: int = 0, transform: tuple[int, ...] = (), tile_rows: int | None = None, residual: DataFrame | None = None) -> DataFrame:
    """Frames to labelled spots. params hold for frames as given; frames, dark and flood are turned alike, the mask is not.
    rings and thresholds: as by frames.ring_lists(). Pixels off the rings go before the correction is joined, on both
    sides; up to the one shuffle by frame nothing is shuffled as long as the correction can be told to all tasks, and pixels
    from frame buckets (io.write_frame_buckets()) aren't shuffled at all: frames are numbered anew behind labelling.
    tile_rows: for frames too large for a task, spots.label_spots(). residual: a map (z, y, residual) of what is added to
    the radii of places, as frames lie after turning."""
    rows = pixels.where(F.col("frame_id") >= skip) if skip else pixels
    own = turned(params, transform)
    if transform:
        rows = frames.image_transform(rows, list(transform), params["height"], params["width"])
    if correction is not None:
        if transform:
            correction = frames.turn_correction(correction, list(transform), params["height"], params["width"])
        rows = frames.correct_pixels(frames.on_rings(rows, own, rings, residual), frames.on_rings(correction, own, rings, residual), bc, bad)
    labelled = spots.label_spots(frames.good_pixels(rows, own, rings, thresholds, residual), tile_rows=tile_rows)
    return labelled.withColumn("frame_id", F.col("frame_id") - skip) if skip else labelled


#: By factor, the least distance of maxima, their least share of the patch's maximum, the box about a
#: maximum, and the cut of fits.
MIN_D, REL, CROP, FIT_CUT = {1: 2, 2: 2, 4: 4, 8: 5}, {1: 0.2, 2: 0.2, 4: 0.2, 8: 0.1}, {1: 2, 2: 8, 4: 10, 8: 20}, {1: 60.0, 2: 20.0, 4: 15.0, 8: 10.0}


def frames_to_peaks(
    labelled: DataFrame, params: dict, *, size: int = 20, srfac: int = 1, model_layers: DataFrame | None = None, stages: list[tuple[str, int]] | None = None, min_d: int | None = None, rel: float | None = None,
    crop: int | None = None, method: str = "com", form: str | None = None, rule: str | None = None, edge: float | None = None, least_pixels: int = 2, sigma: float = 0, median: int = 1, omega_start: float = 0.0, omega_step: float = 1.0, listed_omega: DataFrame | None = None,
    skip: int = 0, int_thresh: float | None = None, failures: str | None = None,
) -> DataFrame:
    """Labelled spots to peak rows. method com: maxima, regions and centres of mass; pv: shapes fitted to maxima; auto: com
    for patches of one maximum, pv for more. form of fits: adam (the usual one of pv) takes the five brightest maxima, or
    the brightest pixel, bounded (that of auto) all maxima, and a patch without any fails. rule of maxima: touching for
    adam, else spaced, unless one is given. Without a model patches are taken as they are
    (srfac 1). Maxima are sought in smoothed patches (sigma, median; the defaults change nothing), measured in the
    patches themselves. skip: frames left out before numbering; omega goes by the original number. edge: fine pixels
    (2.5 native ones by default). failures: a folder to which patches whose fit failed are written. The labelled spots, the
    patches, the model's results, the maxima and the fits are written once."""
    if method not in ("com", "pv", "auto"):
        raise ValueError(method)
    form = form or ("adam" if method == "pv" else "bounded")
    rule = rule or ("touching" if method == "pv" and form == "adam" else "spaced")
    ybc, zbc = params["ybc"], params["zbc"]
    min_d, rel, crop, cut = (given if given is not None else usual[srfac] for given, usual in ((min_d, MIN_D), (rel, REL), (crop, CROP), (int_thresh, FIT_CUT)))
    labelled = staged(labelled, "labelled-spots")
    origins = spots.patch_ids(spots.patch_origins(spots.spot_stats(labelled), size, params["height"], params["width"], least_pixels))
    native = spots.extract_patches(labelled, origins, size).join(origins.select(*spots.SPOT, "patch_id"), spots.SPOT)
    arrays = staged(spots.to_arrays(native, ["patch_id"], size), "patches")
    info = arrays.select("patch_id", spots.patch_sum(F.col("px")).alias("isum"), spots.patch_max(F.col("px")).alias("raw_imax"), F.col("px").alias("native"))
    info = info.join(origins.select("patch_id", "scan_id", "frame_id", "spot_id", "z00", "y00", "n_pixels"), "patch_id").withColumnRenamed("spot_id", "label")
    fine = arrays if model_layers is None else staged(superres.super_resolve(arrays, model_layers, stages or []).where(F.col("srfac") == srfac).select("patch_id", "px"), "fine-patches")
    maxima = staged(peaks.local_maxima(peaks.smooth(fine, sigma, median), min_d, rel, rule=rule), "maxima")  # read by several branches
    of_patch = maxima.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_peaks"))
    about = info.select("patch_id", "scan_id", "frame_id", "z00", "y00", "n_pixels", "raw_imax", "isum")
    out = []
    if method in ("com", "auto"):
        some = maxima if method == "com" else maxima.join(of_patch.where("n_peaks = 1").select("patch_id"), "patch_id")
        some = peaks.edge_filter(some, size, srfac, edge)
        some = some.withColumn("peak_no", F.expr("row_number() over (partition by patch_id order by v desc, row, col)"))
        marked = fine.join(peaks.listed(some), "patch_id")
        out.append(peaks.peak_summary(peaks.watershed(marked, rel), peaks.com_peaks(marked, crop), about.join(of_patch, "patch_id"), srfac, ybc, zbc))
    if method in ("pv", "auto"):
        several = maxima if method == "pv" else maxima.join(of_patch.where("n_peaks > 1").select("patch_id"), "patch_id")
        if form == "adam":
            cells = spots.to_pixels(fine, size * srfac).where("v > 0")  # blank patches have no peak
            marked = peaks.listed(peaks.top_peaks(several, cells if method == "pv" else cells.limit(0)))
        else:
            marked = peaks.listed(several.withColumn("peak_no", F.expr("row_number() over (partition by patch_id order by v desc, row, col)")))
        rows = fine.join(marked, "patch_id", "left" if method == "pv" and form == "bounded" else "inner").join(info.select("patch_id", "z00", "y00", "native"), "patch_id")
        rows = rows.withColumn("peaks", F.coalesce("peaks", F.array().cast(rows.schema["peaks"].dataType)))
        fits = staged(peaks.fit_pseudo_voigt(rows, srfac, ybc, zbc, cut, form), "fits")
        if failures is not None:
            fits.where("failed").join(about.select("patch_id", "scan_id", "frame_id"), "patch_id").select("scan_id", "frame_id", "patch_id").write.mode("append").parquet(failures)
        out.append(peaks.fit_peak_rows(fits, about, srfac, ybc, zbc))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    numbered = peaks.spot_number(rows, ("scan_id", "frame_id"), ("z00", "y00", "patch_id", "peak_no"))
    return omega(numbered.withColumn("frame_orig", F.col("frame_id") + skip), "frame_orig", omega_start, omega_step, listed_omega)


def peakbank(found: DataFrame, measured: DataFrame, params: dict, *, size: int, i_thresh: float, error_below: float | None) -> DataFrame:
    """Single peaks whose drawn frame agrees with the measured one, with error_reconstruction."""
    single = bank.single_peak_filter(found.drop("error_reconstruction"))
    drawn = bank.draw_frame(single, params["ybc"], params["zbc"], params["height"], params["width"], i_thresh)
    errors = bank.reconstruction_error(single, drawn, frames.threshold_frames(measured, i_thresh), size)
    return bank.recon_error_filter(single.join(errors, ["scan_id", "peak_id"]), error_below)


def patchstore(peak_bank: DataFrame, params: dict, *, n_patches: int, n_peaks: list[int], rings: list[float], var_r: float, sep: tuple[float, float], imax: tuple[float, float], lrsz: int, cvsz: int, src: int, factors: list[int], cut: float, seed: int) -> dict[str, DataFrame]:
    """A store of synthetic patches: patches, info, locations, parameters. Blank and unplaced patches are in no table. Each
    of the first three is drawn for itself; rendered has all that they have, for those who want several at once. What was
    sampled is written once, as two branches read it."""
    spark, ybc, zbc = peak_bank.sparkSession, params["ybc"], params["zbc"]
    windows = synth.ring_windows(peak_bank.drop("n_peaks"), rings, var_r)
    drawn = synth.order_by_imax(synth.sample_ring_peaks(spark, n_patches, n_peaks, windows, len(rings), seed).where("ok"))
    drawn = staged(drawn.withColumn("imax", synth.clamp_imax(F.col("imax"), *imax)), "sampled-peaks")
    placed = synth.place_peaks(drawn.groupBy("patch_id").agg(F.first("ring_r").alias("ring_r"), F.first("n_peaks").cast("int").alias("n_peaks")), var_r, *sep, ybc, zbc, seed).where("ok")
    parameters = drawn.drop("ycen", "zcen", "radius", "eta").join(placed.select("patch_id", "k", "y", "z", F.col("r").alias("radius"), "eta"), ["patch_id", "k"])
    fields = ["y", "z", "radius", "eta", "sigma_gr", "sigma_geta", "sigma_lr", "sigma_leta", "mu", "imax", "bg"]
    grouped = parameters.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("peaks"), F.sum("integrated_intensity").alias("isum"))
    rendered = synth.render_patches(grouped, lrsz=lrsz, cvsz=cvsz, src=src, factors=factors, ybc=ybc, zbc=zbc, cut=cut).where("not blank")
    one = rendered.where(F.col("srfac") == factors[0]).select("patch_id", F.col("n_peaks").cast("long").alias("n_peaks"), "isum", "y00", "z00")
    location = rendered.select("patch_id", "srfac", F.posexplode(F.arrays_zip(F.col("peak_y").alias("y"), F.col("peak_z").alias("z"))).alias("i", "p"))
    return {
        "rendered": rendered.withColumn("n_peaks", F.col("n_peaks").cast("long")),
        "patches": rendered.select("patch_id", "srfac", "side", F.lit("I").alias("ch"), "px"),
        "info": one,
        "locations": location.select("patch_id", "srfac", (F.col("i") + 1).alias("k"), F.col("p.y").alias("y"), F.col("p.z").alias("z")),
        "parameters": parameters.join(one.select("patch_id"), "patch_id"),
    }
