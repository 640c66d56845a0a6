"""Composite runs: labelling, fusion, cell mosaic, batch and index export."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_RGB, CLASSES, PRIOR_COST, SAMPLE_WINDOW
from ..functions import color
from ..functions.predicates import blank_near_black, is_covered
from ..operators import assign, cluster, focal, overlay, tile_kmeans
from ..operators import kernels as K
from ..operators.export import build_palette, fill_grid, histogram, merge_index, rgb_to_cmix
from ..operators.stats import attach_by
from ..operators.tiles import block_of, focal_tiles, tiles_to_pixels
from ..schema import PIXEL_KEYS, TILE_KEYS
from ..session import cut_lineage

BASE_FEATURES = ["mean_r", "mean_g", "mean_b", "texture", "vari", "sat"]


@dataclass(frozen=True)
class Options:
    """Run settings; the defaults are the usual run."""

    smoothing: str = "none"
    nir: bool = False
    tile: int = 512
    metres_per_px: float = 1.0
    use_prior: bool = True
    train_pixels: int | str | None = None  # all covered pixels; a number asks for a sample, "auto" for one of a size that suits the data
    anchors: dict | None = None
    names: tuple[str, ...] = field(default_factory=lambda: tuple(
        c["name"] for c in CLASSES if c["source"] == "kmeans"))

    @property
    def median(self) -> int:
        if not self.smoothing or self.smoothing == "none":
            return 0
        return int(self.smoothing.split("_")[1]) if "_" in self.smoothing else 2


@dataclass(frozen=True)
class Model:
    """Scaler and centres over named features, with the material of each cluster."""

    features: tuple[str, ...]
    scaler: dict
    centres: tuple
    materials: tuple[str, ...] = ()


def features(px: DataFrame, opts: Options) -> DataFrame:
    """Box means, texture, colour indices and NDVI per pixel, with the bands."""
    bands = ["r", "g", "b"] + (["nir"] if opts.nir else [])
    box = focal.box_features(px, bands, opts.tile, keep=bands)
    out = box.withColumns({"vari": color.vari("r", "g", "b"), "sat": color.saturation("r", "g", "b")})
    return out.withColumn("ndvi", color.ndvi("nir", "b")) if opts.nir else out


def feature_names(opts: Options) -> list[str]:
    return BASE_FEATURES + (["mean_nir", "ndvi"] if opts.nir else [])


def train(px: DataFrame, feats: DataFrame, opts: Options) -> Model:
    """One model over all covered pixels of all rasters, or over a seeded sample of exact size if asked for.

    A sample is chosen on the plain pixels, so features are computed once.
    """
    names = feature_names(opts)
    sample = feats.filter(is_covered())
    if opts.train_pixels is not None:
        sample = cluster.uniform_sample(sample, opts.train_pixels, keys=px.filter(is_covered()))
    scaler, centres = cluster.fit_kmeans(sample, names, len(opts.names))
    return Model(tuple(names), scaler, tuple(map(tuple, centres)))


def label(feats: DataFrame, model: Model, opts: Options) -> DataFrame:
    """Cluster of each pixel, smoothed when asked."""
    z = {f"_z_{f}": color.zscore(f, F.lit(m), F.lit(s)) for f, (m, s) in model.scaler.items()}
    out = cluster.nearest_centre(feats.withColumns(z), [f"_z_{f}" for f in model.features], model.centres)
    out = out.select(*PIXEL_KEYS, "r", "g", "b", *(["nir"] if opts.nir else []), "cluster")
    if not opts.median:
        return out
    keep = [c for c in out.columns if c not in (*PIXEL_KEYS, "cluster")]
    return focal.median_labels(out, "cluster", opts.median, opts.tile, keep=keep)


def name_clusters(labels: DataFrame, dims: DataFrame, opts: Options) -> DataFrame:
    """Material of every cluster of every raster, one-to-one by colour cost."""
    k = len(opts.names)
    means = assign.cluster_mean_rgb(labels, k, ["raster_id"])
    cost = assign.naming_cost(means, assign.active_anchors(opts.anchors, list(opts.names)))
    if opts.use_prior:
        prior = assign.scene_prior(assign.scene_fractions(labels), list(opts.names))
        held = cost.join(prior.select("raster_id", "material", "prior"), ["raster_id", "material"], "left")
        cost = held.withColumn("cost", F.col("cost") + F.lit(PRIOR_COST) * (1 - F.coalesce("prior", F.lit(0.0))))
    return assign.with_material_colour(assign.assign_materials(cost.select(
        "raster_id", "cluster", "pos", "material", "cost"), ["raster_id"]))


def paint(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Painted raster with near-black pixels left black."""
    ids = mapping.select("raster_id", "cluster", "paint_r", "paint_g", "paint_b", "material")
    held = attach_by(labels, ids, ["raster_id", "cluster"])
    ok = is_covered()
    return held.select(*PIXEL_KEYS, "cluster", F.when(ok, F.col("material")).alias("material"),
                       *[F.when(ok, F.col(f"paint_{c}")).otherwise(F.lit(0)).alias(c) for c in "rgb"])


def classify(px: DataFrame, dims: DataFrame, opts: Options = Options(), model: Model | None = None) -> DataFrame:
    """Bands to painted materials: features, model, clusters, names, paint."""
    feats = features(px, opts)
    model = model or train(px, feats, opts)
    # naming and painting read the labels several times; compute them once
    labels = cut_lineage(label(feats, model, opts))
    return paint(labels, name_clusters(labels, dims, opts))


def name_centres(model: Model, opts: Options, spark) -> Model:
    """Materials of a shared model from its centres alone, so every raster agrees."""
    rows = spark.createDataFrame([(i, *map(float, c[:3])) for i, c in enumerate(model.centres, 1)],
                                 "cluster int, mean_r double, mean_g double, mean_b double")
    rgb = assign.centres_to_rgb(rows, model.scaler, ["mean_r", "mean_g", "mean_b"]).withColumn("raster_id", F.lit("shared"))
    cost = assign.naming_cost(rgb, assign.active_anchors(opts.anchors, list(opts.names)))
    got = assign.assign_materials(cost, ["raster_id"]).orderBy("cluster").collect()  # one row per centre
    return Model(model.features, model.scaler, model.centres, tuple(r["material"] for r in got))


def classify_batch(px: DataFrame, opts: Options = Options(), model: Model | None = None) -> DataFrame:
    """Many rasters under one shared model and one shared colour table; no per-raster step."""
    feats = features(px, opts)
    model = name_centres(model or train(px, feats, opts), opts, px.sparkSession)
    labels = label(feats, model, opts)
    lut = {i: CLASS_RGB[m] for i, m in enumerate(model.materials, 1)}
    painted = assign.paint_labels(labels, len(lut), lut)
    names = F.element_at(F.array(*[F.lit(m) for m in model.materials]), F.col("cluster"))
    ok = is_covered()
    return painted.select(*PIXEL_KEYS, "cluster", F.when(ok, names).alias("material"),
                          *[F.when(ok, F.col(f"paint_{c}")).otherwise(F.lit(0)).alias(c) for c in "rgb"])


def fuse_masks(painted: DataFrame, original: DataFrame, masks: list[tuple[DataFrame, str, str]],
               opts: Options = Options()) -> DataFrame:
    """Water, then roads, then buildings over the painted raster."""
    order = {"BM_WATER": 0, "BM_ASPHALT": 1, "BM_CONCRETE": 2}
    ranked = sorted(masks, key=lambda m: order.get(m[1], 9))
    return overlay.fuse(painted, original, ranked, {n: CLASS_RGB[n] for n in opts.names}, opts.tile)


def export_index(painted: DataFrame, order, keys: list[str] | None = None, strict: bool = False,
                 size: tuple[int, int] | None = None, raster: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Index raster and its histogram from painted, possibly overlapping tiles.

    With ``size`` (height, width) the index covers the whole grid of one raster, zero
    where nothing was painted, and shares are of all its cells.
    """
    index = merge_index(rgb_to_cmix(painted, build_palette(), strict), keys or PIXEL_KEYS, order)
    if size:
        index = fill_grid(index, *size, raster)
    return index, histogram(index)


# --- tile form ---------------------------------------------------------------

def tile_features(bands: np.ndarray, nir: bool) -> np.ndarray:
    """Feature planes of one padded tile, in the order of ``feature_names``."""
    a = bands.astype(np.float64)
    r, g, b = a[:3]
    den = g + r - b
    den = np.where(np.abs(den) < 1e-6, 1e-6, den)
    hi, lo = a[:3].max(axis=0), a[:3].min(axis=0)
    planes = [*(K.box_mean(x) for x in a[:3]), K.texture_std((r + g + b) / 3.0),
              np.clip((g - r) / den, -1, 1), (hi - lo) / (hi + 1e-6)]
    if nir:
        planes += [K.box_mean(a[3]), (a[3] - b) / (a[3] + b + 1e-6)]
    return np.stack(planes)


def score_tiles(tiles: DataFrame, model: Model, opts: Options = Options()) -> DataFrame:
    """Label tiles straight from stored tiles: one shuffle of bytes plus border strips."""
    mean = np.array([model.scaler[f][0] for f in model.features])
    std = np.array([model.scaler[f][1] for f in model.features])
    centres = np.array(model.centres)
    if len(centres) > 255:
        raise ValueError("label tiles hold bytes: at most 255 centres")
    radius, nir = opts.median, opts.nir

    def run(bands, info):
        f = tile_features(bands, nir)
        z = ((f.reshape(len(mean), -1).T - mean) / std)
        d = (z * z).sum(axis=1)[:, None] - 2 * z @ centres.T + (centres * centres).sum(axis=1)
        lab = (d.argmin(axis=1) + 1).reshape(f.shape[1:])
        if radius:
            lab = K.rank_median(lab, radius)
        covered = bands[:3].sum(axis=0, dtype=np.int64) >= 24
        return np.where(covered, lab, 0)[None].astype(np.uint8)

    return focal_tiles(tiles, 1 + radius, opts.tile, run)


def tile_form(opts: Options) -> tile_kmeans.Features:
    nir = opts.nir
    return tile_kmeans.Features(tuple(feature_names(opts)), lambda canvas: tile_features(canvas, nir), radius=1)


def train_tiles(tiles: DataFrame, opts: Options = Options(), window: int = SAMPLE_WINDOW) -> Model:
    """One shared model from stored tiles: from all covered pixels, or from sample windows if a sample is asked for.

    All pixels are read inside tiles and none becomes a row. Of a sample, the size may follow from the data
    (``auto``). Its windows come from tile headers. Tiles are kept when they meet a window grown
    by one pixel, so every sampled pixel has its true neighbourhood.
    """
    if opts.train_pixels in (None, "auto"):
        form = tile_form(opts)
        kept = tile_kmeans.kept_tiles(tiles, form, opts.tile)
        if opts.train_pixels is None:
            scaler, centres = tile_kmeans.fit(kept, form, len(opts.names))
            return Model(form.names, scaler, tuple(map(tuple, centres)))
        at = tile_kmeans.moments(kept, form)
        opts = replace(opts, train_pixels=cluster.size_from_correlation(at.n, at.correlation, len(opts.names))[1])
    heads = tiles.select("raster_id", "raster_h", "raster_w").distinct()
    windows = cut_lineage(cluster.sample_windows(heads, window=window))
    span = lambda at: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - 1) / opts.tile)).cast("int"),
                                           F.floor((F.col(at) + F.col("win")) / opts.tile).cast("int")))
    near = windows.withColumn("tile_row", span("wr")).withColumn("tile_col", span("wc")).select(*TILE_KEYS).distinct()
    bands = ["r", "g", "b"] + (["nir"] if opts.nir else [])
    px = tiles_to_pixels(tiles.join(near, TILE_KEYS, "left_semi"), bands)
    feats = features(px, opts)
    per = cluster.per_window(cluster.per_raster_budget(windows.select("raster_id").distinct().count(), opts.train_pixels))
    picked = cut_lineage(cluster.window_sample(feats, windows, per, window, keys=px))
    names = feature_names(opts)
    scaler, centres = cluster.fit_kmeans(cluster.uniform_sample(picked, opts.train_pixels), names, len(opts.names))
    return Model(tuple(names), scaler, tuple(map(tuple, centres)))


def classify_tiles(tiles: DataFrame, opts: Options = Options(), model: Model | None = None) -> tuple[DataFrame, Model]:
    """Stored tiles to label tiles under one shared, named model."""
    model = name_centres(model or train_tiles(tiles, opts), opts, tiles.sparkSession)
    return score_tiles(tiles, model, opts), model


def tile_histogram(labels: DataFrame) -> DataFrame:
    """Pixels per label from label tiles: counted in the tile, then summed."""
    def count(frames):
        for pdf in frames:
            total = np.zeros(256, dtype=np.int64)
            for t in pdf.itertuples(index=False):
                total += np.bincount(block_of(t).ravel(), minlength=256)
            ids = np.flatnonzero(total)
            yield pd.DataFrame({"cluster": ids.astype(np.int32), "n": total[ids]})

    return labels.mapInPandas(count, "cluster int, n long").groupBy("cluster").agg(F.sum("n").alias("n"))


def material_shares(painted: DataFrame) -> DataFrame:
    """Pixels per material of a painted raster set."""
    return painted.groupBy("raster_id", "material").agg(F.count("*").alias("n_px"))


__all__ = ["Options", "Model", "features", "train", "label", "classify", "classify_batch", "fuse_masks",
           "export_index", "score_tiles", "tile_histogram", "material_shares", "blank_near_black"]
