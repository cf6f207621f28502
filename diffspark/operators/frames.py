"""Frames as sparse pixel tables: selection, orientation, correction, rings and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corrected_radius_px, ring_index


def skip_frames(pixels: DataFrame, n: int) -> DataFrame:
    """Drops the first n frames and renumbers from 0; frame_orig keeps the number."""
    return pixels.where(F.col("frame_id") >= n).withColumn("frame_orig", F.col("frame_id")).withColumn("frame_id", F.col("frame_id") - n)


def image_transform(pixels: DataFrame, ops: list[int], height: int, width: int) -> DataFrame:
    """In sequence 1: mirror columns, 2: mirror rows, 3: transpose. Coordinates only; no pixel moves."""
    z, y = F.col("z"), F.col("y")
    for op in ops:
        if op == 1:
            y = width - 1 - y
        elif op == 2:
            z = height - 1 - z
        elif op == 3:
            z, y, height, width = y, z, width, height
    return pixels.withColumns({"z": z, "y": y})


def dark_mean(dark_frames: DataFrame) -> DataFrame:
    return dark_frames.groupBy("scan_id", "z", "y").agg(F.avg("value").alias("dark"))


def turn_correction(correction: DataFrame, ops: list[int], height: int, width: int) -> DataFrame:
    """correction with dark and flood turned as image_transform() turns frames; the mask is given as it lies afterwards."""
    turned = image_transform(correction.select("scan_id", "z", "y", "dark", "flood"), ops, height, width)
    return turned.join(correction.select("scan_id", "z", "y", "mask"), ["scan_id", "z", "y"], "full")


#: Rows of a correction table (some 50 bytes each) that are sent to every task; more are joined by position.
CORRECTION_ROWS = 2_000_000


def correct_pixels(pixels: DataFrame, correction: DataFrame, bc: float = 1.0, bad: float = 0.0, told_rows: int = CORRECTION_ROWS) -> DataFrame:
    """(I - dark) / flood * bc, then the bad value to 0, then masked pixels to 0. correction (scan_id, z, y, dark, flood,
    mask) is counted first and sent to all tasks if it has at most told_rows rows, else joined by position. A flood of 0
    gives an infinite value of the difference's sign, and null for a difference of 0. Pixels without a row are 0; after
    dark correction they can't reach a positive threshold."""
    told = F.broadcast(correction) if correction.count() <= told_rows else correction
    rows = pixels.join(told, ["scan_id", "z", "y"], "left")
    rows = rows.withColumns({"__i": F.col("intensity") - F.coalesce("dark", F.lit(0.0)), "flood": F.coalesce("flood", F.lit(1.0))})
    endless = F.when(F.col("__i") > 0, float("inf")).when(F.col("__i") < 0, float("-inf"))
    rows = rows.withColumn("intensity", F.when(F.col("flood") == 0, endless).otherwise(F.try_divide("__i", "flood")) * bc).drop("__i")
    if bad:
        rows = rows.withColumn("intensity", F.when(F.col("intensity") == bad, 0.0).otherwise(F.col("intensity")))
    masked = F.coalesce("mask", F.lit(0.0)) > 0
    return rows.withColumn("intensity", F.when(masked, 0.0).otherwise(F.col("intensity"))).drop("dark", "flood", "mask")


def ring_table(hkls: DataFrame, rings_to_use: list[int], thresholds: list[float], px: float) -> DataFrame:
    """ring_idx, ring_nr, radius_px, thresh for the rings in use, in their order; several rows of a ring: the first
    (smallest line, where lines are numbered, else smallest radius) wins."""
    wanted = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(rings_to_use) - 1)).alias("i"), F.lit(rings_to_use).alias("nr"), F.lit([float(t) for t in thresholds]).alias("t")))
    use = hkls.sparkSession.range(1).select(wanted.alias("w")).select(F.col("w.i").alias("ring_idx"), F.col("w.nr").alias("ring_nr"), F.col("w.t").alias("thresh"))
    order = F.col("line") if "line" in hkls.columns else F.col("Radius")
    radius = hkls.groupBy(F.col("RingNr").alias("ring_nr")).agg(F.min_by("Radius", order).alias("radius"))
    return use.join(radius, "ring_nr").select("ring_idx", "ring_nr", (F.col("radius") / px).alias("radius_px"), "thresh")


#: Rows of a residual map (some 20 bytes each) that are sent to every task; more are joined by place.
RESIDUAL_ROWS = 4_000_000


def with_residual(pixels: DataFrame, residual: DataFrame | None, name: str) -> tuple[DataFrame, Column | None]:
    """pixels with the residual map's value (z, y, residual in pixels) at their place under the given name, and that
    column; a place without a row has none. The map is counted first: it goes to all tasks or is joined by place."""
    if residual is None:
        return pixels, None
    told = residual.select("z", "y", F.col("residual").cast("double").alias(name))
    told = F.broadcast(told) if residual.count() <= RESIDUAL_ROWS else told
    return pixels.join(told, ["z", "y"], "left"), F.coalesce(name, F.lit(0.0))


def with_ring(pixels: DataFrame, params: dict, rings: list[float], residual: DataFrame | None = None) -> DataFrame:
    """Adds radius_px and ring_idx (-1: on no ring) by arithmetic on the pixel's place; no ring map is stored or joined.
    residual: a map (z, y, residual) of what is added to radii."""
    rows, more = with_residual(pixels, residual, "__residual")
    radius = corrected_radius_px(F.col("y"), F.col("z"), params, more)
    rows = rows.withColumn("radius_px", radius).drop("__residual")
    return rows.withColumn("ring_idx", ring_index(F.col("radius_px"), rings, params["ring_width"] / params["px"]))


def on_rings(pixels: DataFrame, params: dict, rings: list[float], residual: DataFrame | None = None) -> DataFrame:
    """The rows whose place lies on a ring, whatever their intensity; what is joined by place later gets small."""
    return with_ring(pixels, params, rings, residual).where("ring_idx >= 0").drop("radius_px", "ring_idx")


def ring_lists(table: DataFrame) -> tuple[list[float], list[float]]:
    """Radii and thresholds of a ring_table(), a row for each ring in use, as lists in their order."""
    rows = sorted(table.select("ring_idx", "radius_px", "thresh").collect())
    return [r.radius_px for r in rows], [r.thresh for r in rows]


def ring_map(spark, params: dict, rings: list[float], residual: DataFrame | None = None) -> DataFrame:
    """z, y, ring_idx of every detector pixel on a ring."""
    cells = spark.range(params["height"] * params["width"]).select(F.expr(f"cast(id div {params['width']} as int)").alias("z"), (F.col("id") % params["width"]).cast("int").alias("y"))
    return with_ring(cells, params, rings, residual).where("ring_idx >= 0").select("z", "y", "ring_idx")


def good_pixels(pixels: DataFrame, params: dict, rings: list[float], thresholds: list[float], residual: DataFrame | None = None) -> DataFrame:
    """Pixels on a ring at or above its threshold; all others count as 0 and have no row. Narrow: no shuffle, no join but
    that of a residual map."""
    if min(thresholds) <= 0:
        raise ValueError("thresholds must be positive: absent pixels count as below them")
    columns = pixels.columns
    pixels, more = with_residual(pixels, residual, "__residual")
    radius = corrected_radius_px(F.col("y"), F.col("z"), params, more)
    width = params["ring_width"] / params["px"]
    # the radius is worked out once a pixel; a filter on columns would repeat it for every ring
    place = F.transform(F.array(radius), lambda r: F.struct(r.alias("radius_px"), ring_index(r, rings, width).alias("ring_idx")))
    least = F.lit([float(t) for t in thresholds])
    hit = F.filter(place, lambda x: (x["ring_idx"] >= 0) & (F.col("intensity") >= F.get(least, x["ring_idx"])))
    rows = pixels.select("*", F.explode_outer(hit).alias("__hit")).where(F.col("__hit").isNotNull())
    return rows.select(*columns, "__hit.radius_px", "__hit.ring_idx")


def threshold_frames(pixels: DataFrame, least: float) -> DataFrame:
    """Values below an absolute threshold become 0."""
    return pixels.withColumn("intensity", F.when(F.col("intensity") < least, 0.0).otherwise(F.col("intensity")))


def ring_summary(good: DataFrame) -> DataFrame:
    """Per frame and ring: pixels, their sum, and the brightest pixel (ties: lowest row, then column)."""
    best = F.max(F.struct("intensity", (-F.col("z")).alias("mz"), (-F.col("y")).alias("my")))
    rows = good.groupBy("frame_id", "ring_idx").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("intensity").alias("isum"), best.alias("b"))
    return rows.select("frame_id", "ring_idx", "n_pixels", "isum", F.col("b.intensity").alias("imax"), (-F.col("b.mz")).alias("z_max"), (-F.col("b.my")).alias("y_max"))
