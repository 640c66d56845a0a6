"""Semantic fractions and scores per cluster."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.predicates import scene_flag_planes, scene_flags
from ..session import cut_lineage
from . import focal
from . import kernels as K
from .chains import Chain, Scalar, Step, chain_counts, prepared
from .components import compact_score, component_stats, elongated_score, label_components
from .runs import label_runs, run_stats, tile_runs
from .stats import attach_by, float_percentile, int_percentiles, join_large
from .tiles import one_band

FRACTIONS = {"veg_frac": "f_veg", "dry_frac": "f_dry_barren", "sand_frac": "f_sand", "dry_grass_frac": "f_dry_grass",
             "lush_frac": "f_lush_grass", "gray_frac": "f_gray", "dark_gray_frac": "f_dark_gray",
             "achro_frac": "f_achro_road", "warm_frac": "f_warm", "blue_dom_frac": "f_blue_dom",
             "water_frac": "f_water", "edge_frac": "f_edge"}


def pooled_scale(px: DataFrame, by: list[str], prob: float = 0.98, name: str = "scale") -> DataFrame:
    """Percentile over the red, green and blue values together."""
    pooled = px.select(*by, F.explode(F.array("r", "g", "b")).alias("v"))
    return int_percentiles(pooled, F.col("v"), {name: prob}, by)


def edge_flags(px: DataFrame, tile: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Pixels whose luma gradient exceeds 0.30 of the raster's 95th percentile (``f_edge``)."""
    by = ["raster_id"]
    scaled = px if "scale" in px.columns else attach_by(px, pooled_scale(px, by), by)
    luma = scaled.withColumn("luma", color.luma(*[color.scale_clip(c, "scale") for c in ("r", "g", "b")]))
    # the percentile reads the gradient three times; compute it once
    grad = cut_lineage(focal.gradient(luma, "luma", tile, by, keep))
    held = attach_by(grad, float_percentile(grad, "grad", 0.95, by, "p95"), by)
    norm = color.clip(F.col("grad") / F.greatest(F.col("p95"), F.lit(1e-6)), 0.0, 1.0)
    return held.select("raster_id", "row", "col", *(keep or []), (norm > 0.30).alias("f_edge"))


def cluster_fractions(px: DataFrame, nir: str | None = "nir", tile: int = 512, edges: bool = True) -> DataFrame:
    """Flag shares per raster and cluster; ``px`` holds bands and ``cluster``."""
    by = ["raster_id"]
    held = attach_by(px, pooled_scale(px, by), by)
    bands = ["r", "g", "b"] + ([nir] if nir else [])
    if edges:
        held = edge_flags(held, tile, keep=[*bands, "cluster", "scale"])
    else:
        held = held.withColumn("f_edge", F.lit(False))
    flagged = scene_flags(held, "scale", nir)
    return flagged.groupBy("raster_id", "cluster").agg(
        F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(n) for n, c in FRACTIONS.items()])


def continuity(px: DataFrame, tile: int = 512) -> DataFrame:
    """Road-like and water-like continuity of every cluster's mask."""
    by = ["raster_id", "cluster"]
    stats = component_stats(label_components(px, by, tile, 4), by)
    return elongated_score(stats, by).join(compact_score(stats, by), by)


def semantic_scores(fractions: DataFrame, totals: DataFrame) -> DataFrame:
    """The fifteen scores per cluster from fractions and the two continuity values.

    ``fractions`` holds FRACTIONS, ``continuity`` and ``water_continuity``;
    ``totals`` holds the labelled pixels of each raster as ``total``.
    """
    c = F.col
    one = F.lit(1.0)
    unit = lambda x: color.clip(x, 0.0, 1.0)
    floor0 = lambda x: F.greatest(F.lit(0.0), x)
    gated = lambda frac, limit, value: F.when(c(frac) >= limit, value).otherwise(F.lit(0.0))

    def weighted(**parts: float) -> Column:
        terms = [F.lit(w) * c(n) for n, w in parts.items()]
        return sum(terms[1:], terms[0])

    out = attach_by(fractions, totals, ["raster_id"])
    out = out.withColumn("size_frac", c("n") / F.greatest(F.lit(1), c("total")))
    out = out.withColumn("road", unit(F.greatest(
        weighted(gray_frac=0.30, achro_frac=0.30, continuity=0.40),
        gated("gray_frac", 0.55, F.lit(0.65) * c("gray_frac")),
        gated("achro_frac", 0.40, F.lit(0.80) * c("achro_frac")))))
    out = out.withColumn("_net_veg", floor0(c("veg_frac") - weighted(gray_frac=0.60, achro_frac=0.40)))
    out = out.withColumn("asphalt", unit(
        weighted(gray_frac=0.25, dark_gray_frac=0.25, achro_frac=0.25, road=0.25)
        * (one - F.lit(1.40) * c("_net_veg")) * (one - F.lit(0.60) * c("sand_frac"))))
    out = out.withColumn("line", unit(weighted(edge_frac=0.65, continuity=0.35)))
    out = out.withColumn("water", unit(weighted(water_frac=0.45, water_continuity=0.55)))
    out = out.withColumn("dry", unit(weighted(dry_frac=0.70) + F.lit(0.30) * c("warm_frac") * (one - c("water"))
                                     - weighted(gray_frac=0.40)))
    out = out.withColumn("sand", unit(
        weighted(sand_frac=0.65, dry_frac=0.35) * (one - F.lit(0.90) * c("lush_frac"))
        * (one - F.lit(0.75) * c("veg_frac")) * (one - F.lit(0.75) * c("water")) * (one - F.lit(0.40) * c("road"))
        * (one - F.lit(0.45) * floor0(c("dry_grass_frac") - c("sand_frac")))))
    out = out.withColumn("grass", unit(c("lush_frac") * (one - F.lit(0.70) * c("sand_frac"))
                                       * (one - F.lit(0.60) * c("dry_frac"))))
    sure = F.when((c("water_frac") >= 0.22) | (c("water_continuity") >= 0.40), one).otherwise(F.lit(0.45))
    cool = F.when(c("warm_frac") >= 0.20, floor0(one - F.lit(1.8) * c("warm_frac"))).otherwise(one)
    out = out.withColumn("water_conf", unit(
        F.least(one, c("water") * F.lit(1.20)) * sure * (one - F.lit(0.65) * c("road"))
        * (one - F.lit(0.60) * c("asphalt")) * (one - F.lit(0.45) * c("line")) * cool))
    grayness = F.least(one, weighted(gray_frac=0.90, dark_gray_frac=0.50, achro_frac=1.20))
    out = out.withColumn("veg", unit(c("veg_frac") * (one - F.lit(0.40) * c("road")) * (one - F.lit(0.65) * c("water"))
                                     * (one - F.lit(0.50) * c("dry")) * (one - grayness)))
    return out.select("raster_id", "cluster", "n", "veg", "road", "water", "asphalt", "line", "water_conf", "dry",
                      "sand", "grass", "gray_frac", "dark_gray_frac", "achro_frac", "warm_frac", "size_frac",
                      "blue_dom_frac")


def cluster_semantics(px: DataFrame, nir: str | None = "nir", tile: int = 512) -> DataFrame:
    """Fractions, continuity and scores of every cluster of every raster."""
    parts = cluster_fractions(px, nir, tile).join(continuity(px, tile), ["raster_id", "cluster"])
    return semantic_scores(parts, px.groupBy("raster_id").agg(F.count("*").alias("total")))


def _luma(r, g, b, scale):
    r, g, b = (np.clip(x / max(scale, 1.0), 0.0, 1.0) for x in (r, g, b))
    return 0.299 * r + 0.587 * g + 0.114 * b


def _edge(grad, p95):
    return np.clip(grad / max(p95, 1e-6), 0.0, 1.0) > 0.30


def semantic_chain(nir: str | None = "nir", edges: bool = True) -> Chain:
    """Flags of FRACTIONS as planes of tiles with bands ``r, g, b``, the near-infrared one if there is one, and ``cluster``.

    Cells of cluster zero are no pixels. The colour scale and the gradient's percentile are values of the raster.
    """
    bands = ("r", "g", "b") + (("nir",) if nir else ())
    flags = tuple(n for n in FRACTIONS.values() if n != "f_edge")

    def scene(*args):
        got = scene_flag_planes(dict(zip(bands, args)), args[-1], [n[2:] for n in flags])
        return tuple(got[n[2:]] for n in flags)

    return Chain((*bands, "cluster"), (
        Step(flags, (*bands, "scale"), scene),
        Step("luma", ("r", "g", "b", "scale"), _luma),
        Step("grad", ("luma",), K.gradient_magnitude, 1),
        Step("f_edge", ("grad", "p95"), _edge) if edges else Step("f_edge", ("r",), lambda r: np.zeros(r.shape, dtype=bool)),
    ), (Scalar("scale", ("r", "g", "b"), 0.98), Scalar("p95", ("grad",), 0.95)), "cluster")


def tile_fractions(tiles: DataFrame, tile: int, nir: str | None = "nir", edges: bool = True) -> DataFrame:
    """``cluster_fractions`` from byte tiles: one exchange of halos, and counts of a few rows a task."""
    chain = semantic_chain(nir, edges)
    held = prepared(tiles, chain, FRACTIONS.values(), tile)
    counted = chain_counts(held, chain, "cluster", FRACTIONS.values())
    return counted.select("raster_id", "cluster", "n", *[(F.col(c) / F.col("n")).alias(n) for n, c in FRACTIONS.items()])


def run_continuity(tiles: DataFrame, band: int, tile: int) -> DataFrame:
    """``continuity`` from byte tiles whose band number ``band`` holds the cluster: components come from runs."""
    by = ["raster_id", "cluster"]
    labels = label_runs(tile_runs(one_band(tiles, band)), tile, 4, ("raster_id", "value")).withColumnRenamed("value", "cluster")
    stats = run_stats(labels, tuple(by))
    return elongated_score(stats, by).join(compact_score(stats, by), by)


def tile_semantics(tiles: DataFrame, tile: int, nir: str | None = "nir") -> DataFrame:
    """``cluster_semantics`` from byte tiles with bands ``r, g, b``, the near-infrared one if there is one, and ``cluster``.

    Fractions and components need nothing of each other, so their jobs run side by side.
    """
    with ThreadPoolExecutor(2) as pool:
        shares = pool.submit(lambda: cut_lineage(tile_fractions(tiles, tile, nir)))
        lasting = pool.submit(lambda: cut_lineage(run_continuity(tiles, 4 if nir else 3, tile)))
        parts, both = shares.result(), shares.result().join(lasting.result(), ["raster_id", "cluster"])
    return semantic_scores(both, parts.groupBy("raster_id").agg(F.sum("n").alias("total")))


def segment_features(px: DataFrame, segment: list[str], nir: bool = True) -> DataFrame:
    """Band means, gray deviation and mean NDVI per segment."""
    gray = color.gray("r", "g", "b")
    aggs = [F.avg(c).alias(f"mean_{c}") for c in ("r", "g", "b")]
    aggs.append(F.sqrt(F.greatest(F.avg(gray * gray) - F.avg(gray) * F.avg(gray), F.lit(0.0))).alias("texture"))
    if nir:
        aggs.append(F.avg(color.ndvi("nir", "b")).alias("ndvi"))
    return px.groupBy(*segment).agg(*aggs)


def superpixels(px: DataFrame, dims: DataFrame, step: int, compactness: float = 0.01, rounds: int = 10) -> DataFrame:
    """Colour-driven superpixels on a regular seed grid (``segment`` is the seed's number).

    Each pixel chooses among the seeds of its own and the eight neighbouring grid
    cells. Those at most nine centres travel as one array per cell, so a round is
    one join on the cell and one aggregation.
    """
    by = ["raster_id"]
    held = attach_by(px.select("raster_id", "row", "col", "r", "g", "b"), dims, by)
    gy, gx = F.floor(F.col("row") / step).cast("int"), F.floor(F.col("col") / step).cast("int")
    held = held.withColumn("gy", gy).withColumn("gx", gx)
    cells = held.select("raster_id", "gy", "gx").distinct()
    values = ["r", "g", "b", "row", "col"]
    home = held.groupBy("raster_id", "gy", "gx").agg(*[F.avg(v).alias(f"c_{v}") for v in values])
    centres = cut_lineage(home)
    weight = F.lit((compactness / step) ** 2)
    shifts = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    labelled = None
    for i in range(rounds + 1):
        seed = F.struct("id", *[f"c_{v}" for v in values])
        near = centres.withColumn("id", F.col("gy").cast("long") * 1_000_000 + F.col("gx")).select("raster_id", seed.alias("c"), "gy", "gx", F.explode(shifts).alias("s")).select(
            "raster_id", (F.col("gy") + F.col("s.y")).alias("gy"), (F.col("gx") + F.col("s.x")).alias("gx"), "c")
        near = join_large(near, cells, ["raster_id", "gy", "gx"]).groupBy("raster_id", "gy", "gx").agg(
            F.collect_list("c").alias("near"))  # at most nine
        sq = lambda c, v: (F.col(v) - c[f"c_{v}"]) * (F.col(v) - c[f"c_{v}"])
        cost = lambda c: sq(c, "r") + sq(c, "g") + sq(c, "b") + weight * (sq(c, "row") + sq(c, "col"))
        best = F.array_min(F.transform("near", lambda c: F.struct(cost(c).alias("d"), c["id"].alias("id"))))
        labelled = join_large(held, near, ["raster_id", "gy", "gx"]).withColumn("segment", best["id"])
        if i == rounds:
            break
        moved = labelled.groupBy("raster_id", "segment").agg(*[F.avg(v).alias(f"n_{v}") for v in values]).select(
            "raster_id", F.floor(F.col("segment") / 1_000_000).cast("int").alias("gy"),
            (F.col("segment") % 1_000_000).cast("int").alias("gx"), *[f"n_{v}" for v in values])
        centres = cut_lineage(join_large(centres, moved, ["raster_id", "gy", "gx"], "left").select(
            "raster_id", "gy", "gx", *[F.coalesce(f"n_{v}", f"c_{v}").alias(f"c_{v}") for v in values]))
    return labelled.select("raster_id", "row", "col", "segment")
