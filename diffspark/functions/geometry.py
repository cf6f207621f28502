"""Detector geometry as column expressions. Y is the column, Z the row of a pixel; eta is in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yz_from_reta(r: Column, eta: Column, ybc: float, zbc: float) -> tuple[Column, Column]:
    return ybc + r * F.sin(F.radians(eta)), zbc + r * F.cos(F.radians(eta))


def reta_from_yz(y: Column, z: Column, ybc: float, zbc: float, strict_nan: bool = False) -> tuple[Column, Column]:
    """Radius and eta, negative left of the beam centre. In the centre column eta counts as positive (strict_nan: NaN),
    and the cosine is held to [-1, 1]."""
    dy, dz = y - ybc, z - zbc
    r = F.sqrt(dy * dy + dz * dz)
    eta = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dz, r)))))
    eta = F.when(dy < 0, -eta).otherwise(eta)
    return r, F.when(dy == 0, F.lit(float("nan"))).otherwise(eta) if strict_nan else eta


def beamcenter_from(y: Column, z: Column, r: Column, eta: Column) -> tuple[Column, Column]:
    return y - r * F.sin(F.radians(eta)), z - r * F.cos(F.radians(eta))


def rotation(tx: float, ty: float, tz: float) -> list[list[float]]:
    """The product of the rotations about x, y and z (degrees), multiplied out once on the driver."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (tx, ty, tz))
    x = [[1, 0, 0], [0, cx, -sx], [0, sx, cx]]
    y = [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]
    z = [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    mul = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return mul(x, mul(y, z))


def rotate_detector(y: Column, z: Column, p: dict) -> tuple[Column, Column, Column]:
    """Laboratory x, y, z (in the unit of the pixel size) of a pixel on the tilted detector."""
    m = rotation(p["tx"], p["ty"], p["tz"])
    v, w = (p["ybc"] - y) * p["px"], (z - p["zbc"]) * p["px"]
    return tuple(m[i][1] * v + m[i][2] * w for i in range(3))  # type: ignore[return-value]


#: Fixed values: (coefficient, power of the radius, multiple of the angle, phase) of the distortion's terms, as
#: numbers of p0 .. p14; None: no angular part.
DISTORTION = ((0, 2, 2, 6), (1, 4, 4, 3), (2, 2, None, None), (4, 6, None, None), (5, 4, None, None), (7, 4, 1, 8), (9, 3, 3, 10), (11, 5, 5, 12), (13, 6, 6, 14))


def distortion_factor(r: Column, eta: Column, p: list[float], rho: float) -> Column:
    """One plus the radial and angular terms; r in the unit of rho."""
    n, t = r / rho, F.radians(90 - eta)
    out = F.lit(1.0)
    for a, power, k, phase in DISTORTION:
        term = p[a] * F.pow(n, power)
        out = out + (term if k is None else term * F.cos(k * t + math.radians(p[phase])))
    return out


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once however often use repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def corrected_radius_px(y: Column, z: Column, p: dict, residual: Column | None = None) -> Column:
    """Radius in pixels after tilt and distortion, plus a residual correction if given."""
    xl, yl, zl = rotate_detector(y, z, p)

    def polar(s: Column) -> Column:
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(s["z"], s["flat"])))))
        return F.struct((p["lsd"] / (p["lsd"] + s["x"]) * s["flat"]).alias("r"), F.when(s["y"] > 0, -angle).otherwise(angle).alias("eta"))

    place = bind(F.struct(xl.alias("x"), yl.alias("y"), zl.alias("z")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"), F.sqrt(s["y"] * s["y"] + s["z"] * s["z"]).alias("flat")))
    out = bind(bind(place, polar), lambda s: s["r"] * distortion_factor(s["r"], s["eta"], p["p"], p["rho"]) / p["px"])
    return out if residual is None else out + residual


def ring_index(radius: Column, rings: list[float], half_width: float) -> Column:
    """The last ring within half_width (inclusive) of the radius, else -1. Rings are literals, so no join is needed."""
    hit = [F.when(F.abs(radius - r) <= half_width, F.lit(k)) for k, r in enumerate(rings)]
    return F.coalesce(F.greatest(*hit) if len(hit) > 1 else hit[0], F.lit(-1))


def patch_grid(df: DataFrame, y: str, z: str, size: int, srfac: int, ybc: float, zbc: float, origin: bool = False) -> DataFrame:
    """Every grid point of the size*srfac square window of each row: gy, gz, grid_r, grid_eta and the indices row, col.
    y and z name the window's centre, or with origin=True its first pixel."""
    n = size * srfac
    first = (lambda c: F.col(c).cast("int")) if origin else (lambda c: (F.col(c).cast("int") - size / 2).cast("int"))
    cells = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = cells.withColumns({"gy": first(y) + F.col("col") / F.lit(float(srfac)), "gz": first(z) + F.col("row") / F.lit(float(srfac))})
    r, eta = reta_from_yz(F.col("gy"), F.col("gz"), ybc, zbc)
    return cells.withColumns({"grid_r": r, "grid_eta": eta})


def patch_pixel_to_detector(origin: Column, index: Column, srfac: int, shift: float | None = None) -> Column:
    """Detector coordinate of a position in a patch; by default shifted to the middle of the fine pixels."""
    shift = -(1 - 1 / srfac) / 2 if shift is None else shift
    return origin + index / F.lit(float(srfac)) + shift


def omega(df: DataFrame, frame: str, start: float, step: float, listed: DataFrame | None = None) -> DataFrame:
    """Adds omega: the listed value of the frame (frame_idx, omega) if there is one, else start + step * frame."""
    rule = start + step * F.col(frame)
    if listed is None:
        return df.withColumn("omega", rule)
    other = listed.select(F.col("frame_idx").alias("__f"), F.col("omega").alias("__o"))
    return df.join(other, df[frame] == F.col("__f"), "left").withColumn("omega", F.coalesce("__o", rule)).drop("__f", "__o")
