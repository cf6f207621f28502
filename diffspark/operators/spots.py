"""Connected spots of frames and the patches cut around their brightest pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def label_pixels(z: np.ndarray, y: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component numbers (from 1, in scan order of first pixels) of sparse pixels: each pixel takes the smallest label
    of its neighbours, then its label's label, until nothing changes."""
    key = z.astype(np.int64) * (int(y.max(initial=0)) + 3) + y + 1
    order = np.argsort(key, kind="stable")
    key, width = key[order], int(y.max(initial=0)) + 3
    links = []
    for step in (1, width) if connectivity == 4 else (1, width - 1, width, width + 1):
        at = np.searchsorted(key, key + step)
        hit = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step))
        links.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    label = np.arange(len(key))
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        low = low[low[label]]
        if (low == label).all():
            break
        label = low
    out = np.empty(len(key), np.int64)
    out[order] = np.unique(label, return_inverse=True)[1] + 1
    return out


def label_spots(good: DataFrame, connectivity: int = 8, tile_rows: int | None = None) -> DataFrame:
    """scan_id, frame_id, z, y, intensity, spot_id, numbered from 1 in the order of spots' first pixels. One shuffle, by
    frame: spots never cross frames and a frame's pixels are bounded by the detector. tile_rows: frames too large for a task
    are labelled in bands of so many rows, whose spots are then linked across the bands' borders (label_tiles())."""
    schema = "scan_id string, frame_id long, z int, y int, intensity double, spot_id long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(spot_id=label_pixels(pdf["z"].to_numpy(), pdf["y"].to_numpy(), connectivity))

    rows = good.where("intensity <> 0").select("scan_id", F.col("frame_id").cast("long"), F.col("z").cast("int"), F.col("y").cast("int"), F.col("intensity").cast("double"))
    return rows.groupBy("scan_id", "frame_id").applyInPandas(run, schema) if tile_rows is None else label_tiles(rows, connectivity, tile_rows)


#: Spots that touch a border, or are linked across one (some 60 bytes each), that are sent to every task; more are joined.
LINKS_TOLD = 1_000_000


def joined_spots(pdf: pd.DataFrame) -> pd.DataFrame:
    """links (a, b) of a frame to the least place that each linked spot reaches: each takes the least of its neighbours',
    then that one's, until nothing changes."""
    nodes, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "frame_id": pdf["frame_id"].iloc[0], "first": nodes, "root": nodes[root]})


def label_tiles(rows: DataFrame, connectivity: int, tile_rows: int) -> DataFrame:
    """label_spots() by bands of rows, so that one frame takes many tasks.

    A band's spots are known by their first pixel (row-major). Pixels on both sides of a border meet by place and give
    links between spots; only these links, at most a border's width for each band, are brought together by frame. A
    joined spot's first pixel is the least of its parts'. Numbers count the first pixels: within a band, and before it.
    """
    frame = ["scan_id", "frame_id"]
    schema = "scan_id string, frame_id long, z int, y int, intensity double, tile int, first long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf["z"].to_numpy().astype(np.int64) << 32 | pdf["y"].to_numpy()
        label = label_pixels(pdf["z"].to_numpy(), pdf["y"].to_numpy(), connectivity) - 1
        first = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, place)
        return pdf.assign(first=first[label])

    parts = staged(rows.withColumn("tile", F.expr(f"cast(z div {int(tile_rows)} as int)")).groupBy(*frame, "tile").applyInPandas(run, schema), "tile-spots")
    beside = F.array(*[F.col("y") + k for k in ((-1, 0, 1) if connectivity != 4 else (0,))])
    above = parts.where(F.col("z") % tile_rows == tile_rows - 1).select(*frame, (F.col("tile") + 1).alias("tile"), F.explode(beside).alias("y"), F.col("first").alias("a"))
    below = parts.where(F.col("z") % tile_rows == 0).select(*frame, "tile", "y", F.col("first").alias("b"))
    links = above.join(below, [*frame, "tile", "y"]).select(*frame, "a", "b").distinct()
    roots = staged(links.groupBy(*frame).applyInPandas(joined_spots, "scan_id string, frame_id long, first long, root long"), "tile-roots")
    told = F.broadcast(roots) if roots.count() <= LINKS_TOLD else roots
    found = parts.join(told, [*frame, "first"], "left").withColumn("root", F.coalesce("root", "first")).drop("first")
    start = F.expr(f"cast(shiftright(root, 32) div {int(tile_rows)} as int)").alias("start")
    firsts = found.groupBy(*frame, "root").agg(F.first("tile").alias("__t")).select(*frame, "root", start)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*frame).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = firsts.groupBy(*frame, "start").agg(F.count(F.lit(1)).alias("n")).select(*frame, "start", before.alias("before"))
    within = firsts.withColumn("k", F.row_number().over(Window.partitionBy(*frame, "start").orderBy("root")))
    numbers = within.join(counts, [*frame, "start"]).select(*frame, "root", (F.col("before") + F.col("k")).alias("spot_id"))
    return found.join(numbers, [*frame, "root"]).select(*frame, "z", "y", "intensity", "spot_id")


SPOT = ["scan_id", "frame_id", "spot_id"]


def patch_ids(origins: DataFrame) -> DataFrame:
    """Adds patch_id, a number of its own for every spot: the scan's place in order (scans are few and told to all tasks),
    frame (below 2**20) and spot (below 2**24)."""
    scans = origins.select("scan_id").distinct().withColumn("__no", F.row_number().over(Window.orderBy("scan_id")))
    number = (F.col("__no").cast("long") * (1 << 44)) + F.col("frame_id") * (1 << 24) + F.col("spot_id")
    fits = (F.col("frame_id") < 1 << 20) & (F.col("spot_id") < 1 << 24)
    checked = F.when(fits, number).otherwise(F.raise_error(F.lit("frame or spot number too large")).cast("long"))
    return origins.join(F.broadcast(scans), "scan_id").withColumn("patch_id", checked).drop("__no")


def spot_stats(spots: DataFrame) -> DataFrame:
    """Per spot: n_pixels, bounding box, brightest pixel (ties: lowest row, then column) and intensity sum."""
    best = F.max(F.struct("intensity", (-F.col("z")).alias("mz"), (-F.col("y")).alias("my"))).alias("b")
    box = [f("z" if a == "z" else "y").alias(f"{n}_{a}") for a in "zy" for n, f in (("min", F.min), ("max", F.max))]
    rows = spots.groupBy(*SPOT).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("intensity").alias("isum"), *box, best)
    return rows.select(*SPOT, "n_pixels", "isum", F.col("b.intensity").alias("imax"), (-F.col("b.mz")).alias("z_peak"), (-F.col("b.my")).alias("y_peak"), "min_z", "max_z", "min_y", "max_y")


def patch_origins(stats: DataFrame, size: int, height: int, width: int, least_pixels: int = 1) -> DataFrame:
    """Spots of enough pixels whose patch lies on the detector, with the patch's origin z00, y00."""
    rows = stats.withColumns({"z00": F.col("z_peak") - size // 2, "y00": F.col("y_peak") - size // 2}).where(F.col("n_pixels") >= least_pixels)
    return rows.where((F.col("z00") >= 0) & (F.col("z00") < height - size) & (F.col("y00") >= 0) & (F.col("y00") < width - size))


def extract_patches(spots: DataFrame, origins: DataFrame, size: int) -> DataFrame:
    """Pixel rows (row, col, v) of each patch: the spot's own pixels inside the window around its brightest one."""
    rows = spots.join(origins.select(*SPOT, "z00", "y00"), SPOT)
    rows = rows.withColumns({"row": F.col("z") - F.col("z00"), "col": F.col("y") - F.col("y00")})
    inside = F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1)
    return rows.where(inside).select(*SPOT, "z00", "y00", "row", "col", F.col("intensity").alias("v"))


def to_arrays(cells: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Pixel rows to one row-major array per patch; absent pixels are 0."""
    k, v = (F.col("row") * side + F.col("col")).cast("int"), F.col("v").cast("double")
    listed = cells.groupBy(*keys).agg(F.collect_list(k).alias("__k"), F.collect_list(F.coalesce(v, F.lit(0.0))).alias("__v"))

    @F.pandas_udf("array<double>")
    def fill(places: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros((len(places), side * side))
        for px, at, x in zip(out, places, values, strict=True):
            px[at] = x
        return pd.Series(list(out))

    return listed.select(*keys, fill("__k", "__v").alias("px"))


def to_pixels(patches: DataFrame, side: int, px: str = "px") -> DataFrame:
    """One row-major array per patch to pixel rows row, col, v."""
    keys = [c for c in patches.columns if c != px]
    rows = patches.select(*keys, F.posexplode(px).alias("k", "v"))
    return rows.select(*keys, F.expr(f"cast(k div {side} as int)").alias("row"), (F.col("k") % side).alias("col"), F.col("v").cast("double").alias("v"))


def patch_sum(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x)


def patch_max(px: Column) -> Column:
    return F.array_max(px)
