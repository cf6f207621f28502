"""Resampling and per-patch measures over pixel rows (patch_id, row, col, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_patch():
    return Window.partitionBy("patch_id")



def downscale(cells: DataFrame, f: int, side: int) -> DataFrame:
    """Sums of f*f blocks; incomplete blocks at the edges are dropped."""
    whole = side // f
    rows = cells.withColumns({"row": F.expr(f"cast(row div {f} as int)"), "col": F.expr(f"cast(col div {f} as int)")}).where((F.col("row") < whole) & (F.col("col") < whole))
    return rows.groupBy("patch_id", "row", "col").agg(F.sum("v").alias("v"))


def upscale(cells: DataFrame, f: int) -> DataFrame:
    """Each pixel as f*f pixels of an equal part of its value; sums are kept."""
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(f * f - 1))))
    return rows.select("patch_id", F.expr(f"cast(row * {f} + i div {f} as int)").alias("row"), F.expr(f"cast(col * {f} + i % {f} as int)").alias("col"), (F.col("v") / float(f * f)).alias("v"))


def normalize_by_max(cells: DataFrame, guard: bool = True) -> DataFrame:
    """Divides by the patch's maximum; a maximum of 0 counts as 1, or without the guard gives nulls."""
    top = F.max("v").over(by_patch())
    return cells.withColumn("v", F.col("v") / F.when(top == 0, 1.0).otherwise(top) if guard else F.try_divide(F.col("v"), top))


def rescale_to_sum(cells: DataFrame, to: str) -> DataFrame:
    """Multiplies so that a patch sums to the column named by to; a patch of sum 0 gets nulls."""
    return cells.withColumn("v", F.try_divide(F.col("v") * F.col(to), F.sum("v").over(by_patch())))


def centroid(cells: DataFrame, threshold: float, height: int, width: int) -> DataFrame:
    """Weighted mean row and column of pixels of at least threshold * maximum; without mass the middle of the patch."""
    rows = cells.withColumn("w", F.when(F.col("v") < threshold * F.max("v").over(by_patch()), 0.0).otherwise(F.col("v")))
    mass = rows.groupBy("patch_id").agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("row")).alias("mr"), F.sum(F.col("w") * F.col("col")).alias("mc"))
    mean = lambda c, middle: F.when(F.col("m") == 0, middle).otherwise(F.try_divide(F.col(c), F.col("m")))
    return mass.select("patch_id", mean("mr", height / 2).alias("row"), mean("mc", width / 2).alias("col"))


def max_px_loc(cells: DataFrame) -> DataFrame:
    """The first maximum of each patch in row-major order."""
    best = F.max(F.struct("v", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b")
    return cells.groupBy("patch_id").agg(best).select("patch_id", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.v").alias("v"))


def min_max_nonzero(cells: DataFrame, value: str, intensity: str = "v", absolute: bool = False) -> DataFrame:
    """(x - min) / (max - min) of a channel over its non-zero pixels; pixels without intensity stay 0."""
    x = F.abs(F.col(value)) if absolute else F.col(value)
    x = F.when(F.col(intensity) == 0, 0.0).otherwise(x)
    some = F.when(x != 0, x)
    low, high = F.min(some).over(by_patch()), F.max(some).over(by_patch())
    return cells.withColumn(value, F.when(x == 0, 0.0).otherwise(F.try_divide(x - low, high - low)))
