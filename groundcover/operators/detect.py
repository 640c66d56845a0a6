"""Feature detection: pre-filter, colour detectors, user models and mask extraction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURE_CONFIGS, PREFILTER_MIN_VALID, PREFILTER_SHARE, PREFILTER_SIDE
from ..functions import color
from ..functions import predicates as P
from ..schema import PIXEL_KEYS
from . import kernels as K
from .components import component_stats, label_components, of_components
from .composite import area_average
from .focal import morphology
from .overlay import mask_union
from .stats import attach_by, join_large
from .tiles import block_of, focal_pixels, focal_tiles, spread


def thumbnail(px: DataFrame, dims: DataFrame, side: int = PREFILTER_SIDE) -> DataFrame:
    """Area-averaged copy whose longest side is at most ``side``."""
    big = F.greatest("raster_h", "raster_w")
    scale = F.greatest(F.lit(1.0), big / F.lit(float(side)))
    out = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / scale))
    d = dims.select("raster_id", (F.col("raster_h") / out("raster_h")).alias("_fy"),
                    (F.col("raster_w") / out("raster_w")).alias("_fx"))
    held = attach_by(px, d, ["raster_id"])
    return area_average(held, ["r", "g", "b"], F.col("_fx"), F.col("_fy"), ["raster_id"])


def feature_ratio(thumb: DataFrame, feature: str) -> DataFrame:
    """Share of valid thumbnail pixels with the feature's signature, and the decision."""
    valid = (F.col("r") > 5) | (F.col("g") > 5) | (F.col("b") > 5)
    hit = P.prefilter_flag(feature, "r", "g", "b")
    per = thumb.filter(valid).groupBy("raster_id").agg(
        F.count("*").alias("n_valid"), F.avg(hit.cast("double")).alias("ratio"))
    few = F.col("n_valid") < PREFILTER_MIN_VALID
    return per.withColumn("run", few | (F.col("ratio") > PREFILTER_SHARE[feature]))


def line_structures(thumb: DataFrame, votes: int = 12, max_gap: int = 10) -> DataFrame:
    """Rasters whose road-coloured thumbnail pixels form a straight run.

    Angle and offset votes find candidate lines; a run with gaps up to
    ``max_gap`` must reach seven per cent of the thumbnail side. A group is one
    thumbnail, so its size is fixed.
    """
    flagged = thumb.select("raster_id", "row", "col", P.prefilter_flag("roads", "r", "g", "b").cast("int").alias("f"))
    theta = np.deg2rad(np.arange(180))
    cos, sin = np.cos(theta), np.sin(theta)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        need = max(8, int(min(pdf["row"].max() + 1, pdf["col"].max() + 1) * 0.07))
        pts = pdf[pdf["f"] > 0]
        y, x = pts["row"].to_numpy(), pts["col"].to_numpy()
        best = 0
        for t in range(180):
            if not len(x):
                break
            rho = np.rint(x * cos[t] + y * sin[t]).astype(np.int64)
            along = -x * sin[t] + y * cos[t]
            order = np.lexsort((along, rho))
            rho, along = rho[order], along[order]
            cut = np.flatnonzero((np.diff(rho) != 0) | (np.diff(along) > max_gap)) + 1
            start, stop = np.r_[0, cut], np.r_[cut, len(rho)]
            counts = pd.Series(rho).value_counts()
            enough = counts.reindex(rho[start]).to_numpy() >= votes
            length = (along[stop - 1] - along[start])[enough]
            best = max(best, float(length.max()) if len(length) else 0.0)
        return pd.DataFrame({"raster_id": [key[0]], "longest": [float(best)], "has_line": [bool(best >= need)]})

    return flagged.groupBy("raster_id").applyInPandas(run, "raster_id string, longest double, has_line boolean")


def should_extract(px: DataFrame, dims: DataFrame, feature: str) -> DataFrame:
    """Whether extraction is worth running, per raster."""
    thumb = thumbnail(px, dims)
    verdict = feature_ratio(thumb, feature)
    if feature != "roads":
        return verdict
    lines = line_structures(thumb)
    few = F.col("n_valid") < PREFILTER_MIN_VALID
    return verdict.join(lines.drop("longest"), "raster_id", "left").withColumn(
        "run", few | (F.col("run") & F.coalesce("has_line", F.lit(False)))).drop("has_line")


# --- colour detectors --------------------------------------------------------

def _hsv(px: DataFrame) -> DataFrame:
    h, s, v = color.hsv("r", "g", "b")
    return px.withColumns({"_h": h, "_s": s, "_v": v})


def solidity(labels: DataFrame, by: list[str]) -> DataFrame:
    """Hull area per component, from the outermost pixels of each row.

    At most two points per raster row reach a group, whatever the component's size.
    """
    ends = labels.groupBy(*by, "comp", "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.r_[pdf["row"], pdf["row"]]
        x = np.r_[pdf["c0"], pdf["c1"]]
        # grow by half a pixel on each side so areas count whole pixels
        corners_y = np.concatenate([y - 0.5, y + 0.5, y - 0.5, y + 0.5])
        corners_x = np.concatenate([x - 0.5, x - 0.5, x + 0.5, x + 0.5])
        data = {c: [k] for c, k in zip([*by, "comp"], key)}
        return pd.DataFrame({**data, "hull": [K.hull_area(corners_y, corners_x)]})

    types = dict(labels.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "comp long, hull double"
    return spread(ends, [*by, "comp"]).groupBy(*by, "comp").applyInPandas(run, schema)


def _shape_filter(mask: DataFrame, px: DataFrame, kind: str, scene: int | Column | DataFrame, tile: int) -> DataFrame:
    """Keep components that pass the area, shape and colour rules of a feature."""
    by = ["raster_id"]
    labels = label_components(mask, by, tile, 8, with_node=True)

    def sized(cells: DataFrame) -> DataFrame:
        if not isinstance(scene, DataFrame):
            return cells.withColumn("_scene", scene if isinstance(scene, Column) else F.lit(scene))
        area = scene.select(*by, (F.col("raster_h").cast("long") * F.col("raster_w")).alias("_scene"))
        return attach_by(cells, area, by)

    part = lambda least, share: F.greatest(F.lit(float(least)), F.col("_scene") * share)
    if kind == "water":
        coloured = join_large(labels, px.select(*PIXEL_KEYS, "r", "g", "b"), PIXEL_KEYS)
        cells = sized(component_stats(coloured, by, [F.avg(c).alias(f"m{c}") for c in "rgb"]))
        odd = ((F.col("mr") > F.col("mb") + 30) & (F.col("mr") > F.col("mg") + 20)) | (
            (F.col("mr") > 200) & (F.col("mg") > 200) & (F.col("mb") > 200))
        small = F.col("area") < F.col("_scene") * 0.01
        keep = cells.filter((F.col("area") >= part(200, 0.001)) & (F.col("area") <= F.col("_scene") * 0.95) & ~(small & odd))
    elif kind == "buildings":
        cells = sized(component_stats(labels, by)).filter(
            F.col("area").between(part(300, 0.0015), F.col("_scene") * 0.35) & (F.col("aspect") <= 7) & (F.col("fill") >= 0.35))
        hull = solidity(of_components(labels, cells, by), by)
        keep = cells.join(hull, [*by, "comp"]).filter(F.col("area") / F.col("hull") >= 0.55)
    else:
        floor = part(400, 0.002) if kind == "trees" else part(800, 0.005)
        keep = sized(component_stats(labels, by)).filter(F.col("area") >= floor)
    return of_components(labels, keep, by).select(*PIXEL_KEYS)


CLEANUP = {
    "buildings": [("open", "ellipse", 3), ("close", "rect", 9)],
    "trees": [("open", "ellipse", 3), ("close", "ellipse", 11)],
    "fields": [("open", "ellipse", 5), ("close", "rect", 15)],
}


def colour_candidates(px: DataFrame, kind: str, tile: int = 512) -> DataFrame:
    """Pixels whose colour fits a feature, after morphological clean-up (column ``f``)."""
    src = _hsv(px)
    h, s, v = F.col("_h"), F.col("_s"), F.col("_v")
    if kind == "water":
        return _water_candidates(src, tile)
    rule = {"buildings": P.building_colour, "trees": P.tree_colour, "fields": P.field_colour}[kind]
    flagged = src.select(*PIXEL_KEYS, rule(h, s, v).cast("int").alias("f"))
    return morphology(flagged, "f", CLEANUP[kind], tile)


def _water_candidates(src: DataFrame, tile: int) -> DataFrame:
    """Certain colours, smooth blue and very smooth ambiguous colours, in one pass with halo."""
    parts = P.water_colours("r", "g", "b", F.col("_h"), F.col("_s"), F.col("_v"))
    gray = F.floor((F.col("r") * 9798 + F.col("g") * 19235 + F.col("b") * 3735 + 16384) / 32768)
    flagged = src.select(*PIXEL_KEYS, gray.alias("gray"), *[c.cast("int").alias(n) for n, c in parts.items()])
    small, large = K.ellipse(3), K.ellipse(21)

    def run(a, present):
        std, valid = K.gaussian_std(a["gray"], 11), a["valid"] > 0
        m = (a["certain"] > 0) | ((std < 12) & (a["hint"] > 0)) | ((std < 8) & (a["ambiguous"] > 0))
        m = K.closing(K.opening(m & valid, small), large) & valid
        return {"f": (K.dilate(m, small) & valid).astype(np.int32)}

    return focal_pixels(flagged, ["gray", *parts], 35, max(tile, 64), run, {"f": "int"})


def detect(px: DataFrame, kind: str, scene: int | Column | DataFrame, tile: int = 512) -> DataFrame:
    """Mask of a feature from colour and shape alone.

    ``scene`` is the area the shape rules refer to: a number, or the raster sizes
    ``raster_id, raster_h, raster_w``, one area per raster.
    """
    cand = colour_candidates(px, kind, tile).filter("f = 1")
    return _shape_filter(cand, px, kind, scene, tile)


# --- user models -------------------------------------------------------------

def segment_tiles(tiles: DataFrame, model: Callable[[np.ndarray, str, float], np.ndarray], prompt: str,
                  threshold: float, tile: int, overlap: int, max_share: float | None = None) -> DataFrame:
    """Run a user's segmenter on tiles with overlap; one-band mask tiles.

    ``model(rgb, prompt, threshold)`` gets ``(h, w, 3)`` bytes. An error of the model
    fails the job; where ``max_share`` is given, a mask that covers more of its tile
    is emptied.
    """
    def run(bands, info):
        rgb = np.ascontiguousarray(np.moveaxis(bands[:3], 0, -1))
        m = np.array(model(rgb, prompt, threshold)) > 0
        if max_share is not None and m.mean() > max_share:
            m[:] = False
        return m[None].astype(np.uint8)

    return focal_tiles(tiles, overlap // 2, tile, run)


def mask_pixels(masks: DataFrame) -> DataFrame:
    """Set pixels of one-band mask tiles."""
    def unpack(frames):
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                y, x = np.nonzero(block_of(t)[0])
                yield pd.DataFrame({"raster_id": np.full(len(y), t.raster_id, dtype=object),
                                    "row": (y + t.row0).astype(np.int32), "col": (x + t.col0).astype(np.int32)})

    return masks.mapInPandas(unpack, "raster_id string, row int, col int")


def extract_masks(px: DataFrame, dims: DataFrame, feature: str, closing: int = 15, scene_px: int | None = None,
                  tile: int = 512, model_masks: dict[str, DataFrame] | None = None,
                  prefilter: bool = False) -> DataFrame:
    """Closed masks of every sub-type of a feature, as set pixels with ``suffix`` and colour.

    With ``prefilter``, rasters whose small copy shows no sign of the feature are left
    out. ``model_masks`` holds set pixels from user models by sub-type; they are
    united with the colour detector's. Shape rules follow each raster's own area
    unless ``scene_px`` is given.
    """
    if feature not in FEATURE_CONFIGS:
        raise ValueError(f"unknown feature type {feature!r}")
    src = px
    if prefilter:
        runs = should_extract(px, dims, feature).filter("run").select("raster_id", F.lit(True).alias("_run"))
        src = attach_by(px, runs, ["raster_id"]).filter("_run").drop("_run")
    scene = F.lit(scene_px) if scene_px is not None else dims
    detected: dict[str, DataFrame] = {}
    outs = []
    for cfg in FEATURE_CONFIGS[feature]:
        parts = [m for m in [(model_masks or {}).get(cfg["suffix"])] if m is not None]
        kind = cfg.get("detector")
        if kind:
            if kind not in detected:
                detected[kind] = detect(src, kind, scene, tile)
            parts.append(detected[kind])
        if not parts:
            continue
        hit = mask_union(parts).withColumn("_hit", F.lit(1))
        full = src.select(*PIXEL_KEYS).join(hit, PIXEL_KEYS, "left").select(
            *PIXEL_KEYS, F.coalesce("_hit", F.lit(0)).alias("f"))
        closed = morphology(full, "f", [("close", "ellipse", closing)], tile).filter("f = 1")
        r, g, b = cfg["color"]
        outs.append(closed.select(*PIXEL_KEYS, F.lit(cfg["suffix"]).alias("suffix"), F.lit(r).alias("r"),
                                  F.lit(g).alias("g"), F.lit(b).alias("b")))
    if not outs:
        return src.select(*PIXEL_KEYS).limit(0).selectExpr(*PIXEL_KEYS, "'' suffix", "0 r", "0 g", "0 b")
    out = outs[0]
    for nxt in outs[1:]:
        out = out.unionByName(nxt)
    return out
