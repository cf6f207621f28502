"""Resuming, and the index tables of consolidated peak and pixel files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .io import SNAKE

#: Numbers in a peak, bytes of a number.
COLUMNS, WIDTH = 29, 8


def pending_frames(frames: DataFrame, done: DataFrame) -> DataFrame:
    """Frames without output yet, by scan where both sides name it."""
    keys = [c for c in ("scan_id", "frame_id") if c in frames.columns and c in done.columns]
    return frames.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(new_peaks: DataFrame, done_peaks: DataFrame) -> DataFrame:
    """New peaks and those of earlier runs: scan_id and frame_id (where both have them) and the 29 columns. Earlier peaks
    that lack one of the 29 aren't kept, and a warning says so; columns besides are left out."""
    keys = [c for c in ("scan_id", "frame_id") if c in new_peaks.columns and c in done_peaks.columns]
    lacking = [c for c in SNAKE if c not in done_peaks.columns]
    if lacking:
        warnings.warn(f"peaks of earlier runs lack {', '.join(lacking)} and are not kept", stacklevel=2)
        return new_peaks.select(*keys, *SNAKE)
    both = [df.select(*keys, *[F.col(c).cast("double").alias(c) for c in SNAKE]) for df in (new_peaks, done_peaks)]
    return both[0].unionByName(both[1])


def all_frames(frames: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Every frame with its count, 0 where it has none."""
    return frames.select("frame_id").distinct().join(counts, "frame_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def _offsets(rows: DataFrame, head: int, bytes_: str) -> DataFrame:
    """Offsets by a running sum over frames: one row a frame, thousands at most, after all counting is done."""
    before = F.coalesce(F.sum(bytes_).over(Window.orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset", head + 12 * F.count(F.lit(1)).over(Window.partitionBy()) + before)


def consolidated_index(frames: DataFrame, peaks: DataFrame) -> DataFrame:
    """frame_id, n_peaks, offset, bytes of the frame's peak block behind the header."""
    rows = all_frames(frames, peaks.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_peaks")), "n_peaks")
    return _offsets(rows.withColumn("bytes", F.col("n_peaks") * COLUMNS * WIDTH), 4, "bytes")


def consolidated_pixel_index(frames: DataFrame, peak_pixels: DataFrame) -> DataFrame:
    """frame_id, n_peaks, offset, bytes of the frame's pixel lists; peak_pixels: frame_id, n_pixels, one row a peak."""
    counts = peak_pixels.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum(4 + 4 * F.col("n_pixels")).alias("bytes"))
    rows = all_frames(frames, counts, "n_peaks").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    return _offsets(rows, 8, "bytes")


def peak_pixel_lists(cells: DataFrame, peaks: DataFrame) -> DataFrame:
    """patch_id, peak_no, pixels: sorted (row, col) on the detector of the patch's non-zero pixels, the same list for
    each of its peaks. cells: patch_id, z00, y00, row, col, v."""
    on = cells.where("v <> 0").groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct((F.col("z00") + F.col("row")).alias("row"), (F.col("y00") + F.col("col")).alias("col")))).alias("pixels"))
    return peaks.select("patch_id", "peak_no").join(on, "patch_id")
