"""Neighbourhood operators on pixel tables and byte tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .chains import Chain, Scalar, Step
from .stats import attach_by
from .tiles import focal_pixels, focal_tiles

DEFAULT_TILE = 512


def box_features(px: DataFrame, bands: list[str], tile: int = DEFAULT_TILE, by: list[str] | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """3x3 mean of every band and 3x3 deviation of the gray level."""

    def run(a, present):
        out = {f"mean_{b}": K.box_mean(a[b]) for b in bands}
        gray = (a[bands[0]] + a[bands[1]] + a[bands[2]]) / 3.0 if len(bands) >= 3 else a[bands[0]]
        out["texture"] = K.texture_std(gray)
        return out

    cols = {f"mean_{b}": "double" for b in bands} | {"texture": "double"}
    return focal_pixels(px, bands, 1, tile, run, cols, by, keep=keep)


def local_entropy(px: DataFrame, gray: str, tile: int = DEFAULT_TILE, by: list[str] | None = None,
                  full_pixels: int | None = None) -> DataFrame:
    """Entropy over a radius-2 disk of the gray level stretched to bytes per raster.

    Where ``full_pixels`` is given, rasters above it are computed at half size and repeated.
    """
    by = by or ["raster_id"]
    span = px.groupBy(*by).agg(F.min(gray).alias("_lo"), F.max(gray).alias("_hi"), (F.count("*") > full_pixels if full_pixels is not None else F.lit(False)).alias("_big"),
                               F.max("row").alias("_mr"), F.max("col").alias("_mc"))
    src = attach_by(px.select(*by, "row", "col", gray), span, by)

    def run(a, present):
        lo, hi = float(a["_lo"]), float(a["_hi"])
        u8 = ((a[gray] - lo) / (hi - lo) * 255.0) if hi > lo else np.zeros_like(a[gray])
        # cells outside the raster are not on the canvas, so the disk is clipped there
        return {"entropy": K.disk_entropy(np.where(present, u8, 0).astype(np.uint8), 2)}

    half = lambda c: F.when(F.col("_big"), F.floor(F.col(c) / 2)).otherwise(F.col(c)).cast("int").alias(c)
    used = src.filter(~F.col("_big") | ((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)))
    used = used.select(*by, half("row"), half("col"), gray, "_lo", "_hi", "_big", "_mr", "_mc")
    out = focal_pixels(used, [gray], 2, tile, run, {"entropy": "double"}, by, carry=["_lo", "_hi"], keep=["_big", "_mr", "_mc"])
    copies = F.when(F.col("_big"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    size = F.when(F.col("_big"), 2).otherwise(1)
    out = out.withColumn("_dy", F.explode(copies)).withColumn("_dx", F.explode(copies))
    out = out.withColumn("row", F.col("row") * size + F.col("_dy")).withColumn("col", F.col("col") * size + F.col("_dx"))
    return out.filter("row <= _mr AND col <= _mc").select(*by, "row", "col", "entropy")


def gaussian_texture(px: DataFrame, gray: str, tile: int = DEFAULT_TILE, by: list[str] | None = None) -> DataFrame:
    """Deviation under an 11x11 Gaussian window."""
    return focal_pixels(px, [gray], 10, tile, lambda a, p: {"local_std": K.gaussian_std(a[gray])},
                        {"local_std": "double"}, by)


def median_labels(px: DataFrame, label: str, radius: int, tile: int = DEFAULT_TILE,
                  by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rank median of label ids over a disk."""

    def run(a, present):
        return {label: K.rank_median(a[label].astype(np.int32), radius)}

    return focal_pixels(px, [label], radius, tile, run, {label: "int"}, by, keep=keep)


def gradient(px: DataFrame, value: str, tile: int = DEFAULT_TILE, by: list[str] | None = None,
             keep: list[str] | None = None) -> DataFrame:
    return focal_pixels(px, [value], 1, tile, lambda a, p: {"grad": K.gradient_magnitude(a[value])},
                        {"grad": "double"}, by, keep=keep)


def element(shape: str, size: int) -> np.ndarray:
    return K.ellipse(size) if shape == "ellipse" else np.ones((size, size), dtype=bool)


def morphology(px: DataFrame, flag: str, steps: list[tuple[str, str, int]], tile: int = DEFAULT_TILE,
               by: list[str] | None = None, keep: list[str] | None = None, out: str | None = None) -> DataFrame:
    """A chain of ``(operation, shape, size)``: erode, dilate, open or close.

    The halo is the sum of the reaches, so the chain runs in one pass and seams
    do not show.
    """
    reach = sum((size // 2) * (2 if op in ("open", "close") else 1) for op, _, size in steps)
    out = out or flag

    def run(a, present):
        m = a[flag] > 0
        for op, shape, size in steps:
            k = element(shape, size)
            m = {"erode": K.erode, "dilate": K.dilate, "open": K.opening, "close": K.closing}[op](m, k)
        return {out: m.astype(np.int32)}

    return focal_pixels(px, [flag], reach, tile, run, {out: "int"}, by, keep=keep)


def extend_at_border(px: DataFrame, flag: str, dims: DataFrame, border: int = 60, kernel: int = 20,
                     tile: int = DEFAULT_TILE) -> DataFrame:
    """Dilate only inside the border zone of each raster, whose sizes are ``raster_h, raster_w`` of ``dims``."""
    by = ["raster_id"]
    both = morphology(px, flag, [("dilate", "ellipse", kernel)], tile, by, keep=[flag], out="_grown")
    both = attach_by(both, dims.select("raster_id", "raster_h", "raster_w"), by)
    h, w = F.col("raster_h"), F.col("raster_w")
    b = F.least(F.lit(border), F.floor(F.least(h, w) / 6))
    zone = (F.col("row") < b) | (F.col("row") >= h - b) | (F.col("col") < b) | (F.col("col") >= w - b)
    return both.select(*by, "row", "col",
                       F.when(zone, F.greatest(F.col(flag), F.col("_grown"))).otherwise(F.col(flag)).alias(flag))


def smooth_tiles(labels: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rank median on one-band byte tiles of label ids."""
    return focal_tiles(labels, radius, tile, lambda a, info: K.rank_median(a[0], radius)[None])


def close_tiles(masks: DataFrame, size: int, tile: int) -> DataFrame:
    """Closing with an elliptic element on one-band byte tiles."""
    k = K.ellipse(size)
    return focal_tiles(masks, 2 * (size // 2), tile,
                       lambda a, info: K.closing(a[0] > 0, k)[None].astype(np.uint8))


# --- the same operators as steps of a chain over tiles -------------------------

def _gray(r, g, b):
    return (r.astype(np.float64) + g + b) / 3.0


def _stretched(gray, lo, hi):
    return ((gray - lo) / (hi - lo) * 255.0 if hi > lo else np.zeros(gray.shape)).astype(np.uint8)


def _luma_byte(r, g, b):
    return (r.astype(np.int64) * 9798 + g.astype(np.int64) * 19235 + b.astype(np.int64) * 3735 + 16384) // 32768


#: Means, texture, entropy and local deviation of the three colour bands; entropy needs the raster's extremes of gray.
FEATURE_CHAIN = Chain(("r", "g", "b"), (
    *[Step(f"mean_{c}", (c,), K.box_mean, 1) for c in "rgb"],
    Step("gray", ("r", "g", "b"), _gray),
    Step("texture", ("gray",), K.texture_std, 1),
    Step("gray_byte", ("gray", "gray_lo", "gray_hi"), _stretched),
    Step("entropy", ("gray_byte",), K.disk_entropy, 2),
    Step("luma_byte", ("r", "g", "b"), _luma_byte),
    Step("local_std", ("luma_byte",), K.gaussian_std, 10),
), (Scalar("gray_lo", ("gray",), 0.0), Scalar("gray_hi", ("gray",), 1.0)))


def morphology_chain(flag: str, steps: list[tuple[str, str, int]], out: str) -> Chain:
    """``morphology`` as a chain: every operation is a step, their reaches add up."""
    ops = {"erode": K.erode, "dilate": K.dilate, "open": K.opening, "close": K.closing}
    made = [Step("_0", (flag,), lambda a: a > 0)]
    for i, (op, shape, size) in enumerate(steps, 1):
        act = lambda m, op=op, k=element(shape, size): ops[op](m, k)
        made.append(Step(f"_{i}" if i < len(steps) else out, (f"_{i - 1}",), act, size // 2 * (2 if op in ("open", "close") else 1)))
    return Chain((flag,), tuple(made))
