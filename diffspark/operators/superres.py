"""Super-resolution of patches by small convolutional models given as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The activations' letters.
ACTIVATIONS = {"r": lambda x: np.maximum(x, 0), "s": lambda x: 1 / (1 + np.exp(-x)), "lr": lambda x: np.where(x > 0, x, 0.01 * x), "t": np.tanh}


def arch_parse(models: DataFrame, arch: str = "arch", in_channels: int = 1) -> DataFrame:
    """model, layer (from 0), in_ch, out_ch, ksize, act of each layer of an architecture text such as 64-5-r_1-5-s."""
    rows = models.select("model", F.posexplode(F.split(arch, "_")).alias("layer", "part"), F.split(arch, "_").alias("parts"))
    field = lambda c, k: F.try_element_at(F.split(c, "-"), F.lit(k))
    channels: Column = field("part", 1).cast("int")
    prior = F.when(F.col("layer") == 0, F.lit(in_channels)).otherwise(field(F.try_element_at("parts", F.greatest(F.col("layer"), F.lit(1))), 1).cast("int"))
    return rows.select("model", "layer", prior.alias("in_ch"), channels.alias("out_ch"), field("part", 2).cast("int").alias("ksize"), field("part", 3).alias("act"))


def model_lookup(names: DataFrame, models: DataFrame) -> DataFrame:
    """Joins names to their models' rows (a table of a few models); an unknown name is an error."""
    rows = names.join(models, "model", "left")
    first = [c for c in models.columns if c != "model"][0]
    known = F.coalesce(F.col(first).cast("string"), F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce("model", F.lit("null")))).cast("string"))
    return rows.withColumn(first, known.cast(dict(models.dtypes)[first]))


#: Numbers in the matrix of windows that one product takes, and pixels of results that are worked out together: what the
#: processor's own memory holds is several times as fast as more.
CONV_CELLS, BLOCK_CELLS = 400_000, 50_000


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x: patches, in_ch, h, w; w: out_ch, in_ch, k, k. Same-size correlation with zero padding, as matrix products of bounded
    size: some patches together where they are small, bands of rows of one where it is large."""
    out_ch, in_ch, k, _ = w.shape
    n, _, high, wide = x.shape
    pad = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    windows = np.lib.stride_tricks.sliding_window_view(pad, (k, k), (2, 3))
    row = in_ch * k * k * wide
    some, band = max(1, CONV_CELLS // (row * high)), max(1, min(high, CONV_CELLS // row))
    out = np.empty((n, out_ch, high, wide), np.result_type(x, w))
    for lo in range(0, n, some):
        for top in range(0, high, band):
            part = windows[lo : lo + some, :, top : top + band]
            out[lo : lo + some, :, top : top + band] = np.tensordot(w, part, ((1, 2, 3), (1, 4, 5))).swapaxes(0, 1)
    return out + b[:, None, None]


Layers = list[tuple[np.ndarray, np.ndarray, str]]


def load_layers(model_layers: DataFrame, models: list[str]) -> dict[str, Layers]:
    """Weights of a few models, bounded by their architecture, to be sent with the tasks."""
    out: dict[str, Layers] = {m: [] for m in models}
    for r in model_layers.where(F.col("model").isin(models)).orderBy("model", "layer").collect():
        w = np.array(r.w, np.float32).reshape(r.out_ch, r.in_ch, r.ksize, r.ksize)
        out[r.model].append((w, np.array(r.b, np.float32), r.act))
    return out


def apply_layers(x: np.ndarray, layers: Layers) -> np.ndarray:
    """x: patches, h, w."""
    out = x[:, None].astype(np.float32)
    for w, b, act in layers:
        out = ACTIVATIONS[act](conv(out, w, b)) if act in ACTIVATIONS else conv(out, w, b)
    return out[:, 0]


def raise_resolution(x: np.ndarray, f: int) -> np.ndarray:
    return np.repeat(np.repeat(x, f, 1), f, 2) / (f * f)


def unit(x: np.ndarray) -> np.ndarray:
    """Each patch divided by its maximum, if that isn't 0."""
    top = x.max((1, 2), keepdims=True)
    return x / np.where(top == 0, 1, top)


#: Pixels of results that are handed back together.
OUT_CELLS = 1_000_000


def super_resolve(patches: DataFrame, model_layers: DataFrame, stages: list[tuple[str, int]], normalise: bool = False, rescale_at: tuple[int, ...] = (8,)) -> DataFrame:
    """patches: patch_id, px. One row per patch and stage: patch_id, srfac, side, px.

    stages: (model, factor to raise by) in turn; each raises the last result, divides it by its maximum and applies the
    model. A result is rescaled to the native sum at the factors in rescale_at; normalise divides every result by its
    maximum, as predictions do. One stage (model, 8) gives the direct form. Compute bound: rows are spread evenly, and patches
    of a batch go through a layer together; Spark gives a task's arithmetic as many threads as spark.task.cpus.
    """
    weights = load_layers(model_layers, [m for m, _ in stages])

    def raised(ids: np.ndarray, x: np.ndarray) -> list[tuple]:
        total, factor, out = x.sum((1, 2), keepdims=True), 1, []
        for model, f in stages:
            factor *= f
            x = apply_layers(unit(raise_resolution(x, f)), weights[model])
            if normalise:
                x = unit(x)
            elif factor in rescale_at:
                now = x.sum((1, 2), keepdims=True)
                x = x * (total / np.where(now == 0, 1, now))
            out += [(pid, factor, x.shape[1], one.ravel()) for pid, one in zip(ids.tolist(), x.astype(float), strict=True)]
        return out

    largest = int(np.prod([f for _, f in stages])) ** 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, held = ["patch_id", "srfac", "side", "px"], [], 0
        for pdf in batches:
            for cells, own in pdf.groupby(pdf["px"].map(len)):
                step = max(1, BLOCK_CELLS // (cells * largest))
                for lo in range(0, len(own), step):
                    some = own.iloc[lo : lo + step]
                    x = np.stack(some["px"].to_numpy()).astype(np.float32).reshape(len(some), int(cells**0.5), -1)
                    out += raised(some["patch_id"].to_numpy(), x)
                    held += len(some) * cells * largest
                    if held > OUT_CELLS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        yield pd.DataFrame(out, columns=names)

    return patches.select("patch_id", "px").repartition("patch_id").mapInPandas(run, "patch_id long, srfac int, side int, px array<double>")
