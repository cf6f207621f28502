"""Peak shapes as column expressions, and the same formula over arrays for the helpers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _turned(y: Column, z: Column, y0, z0, rot: float) -> tuple[Column, Column]:
    dy, dz = y - y0, z - z0
    if not rot:
        return dy, dz
    c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
    return dy * c - dz * s, dy * s + dz * c


def gaussian2d(y, z, y0, z0, sy, sz, imax, rot: float = 0) -> Column:
    u, v = _turned(y, z, y0, z0, rot)
    return imax * F.exp(-0.5 * (u / sy) * (u / sy) - 0.5 * (v / sz) * (v / sz))


def lorentzian2d(y, z, y0, z0, sy, sz, imax, rot: float = 0) -> Column:
    u, v = _turned(y, z, y0, z0, rot)
    return imax / ((1 + (u / sy) * (u / sy)) * (1 + (v / sz) * (v / sz)))


def pseudo_voigt(y, z, y0, z0, gauss: tuple, mix, imax, lorentz: tuple | None = None, rot: float = 0) -> Column:
    """mix * Lorentzian + (1 - mix) * Gaussian; one pair of widths for both, or a second one for the Lorentzian."""
    wide = gauss if lorentz is None else lorentz
    return mix * lorentzian2d(y, z, y0, z0, *wide, imax, rot) + (1 - mix) * gaussian2d(y, z, y0, z0, *gauss, imax, rot)


def pseudo_voigt_np(r: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p[..., 8]: R, eta, the Gaussian's and the Lorentzian's widths, mix, IMax; broadcast over the grid's last axes."""
    r0, e0, gr, ge, lr, le, mix, top = (p[..., k, None, None] for k in range(8))
    g = np.exp(-0.5 * ((r - r0) / gr) ** 2 - 0.5 * ((e - e0) / ge) ** 2)
    low = 1 / ((1 + ((r - r0) / lr) ** 2) * (1 + ((e - e0) / le) ** 2))
    return top * (mix * low + (1 - mix) * g)
