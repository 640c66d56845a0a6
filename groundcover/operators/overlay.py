"""Painting masks over a class raster, colour resolution and colour picking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CLASS_RGB, CLASSES, INCOMPATIBLE, OVERLAY_CANDIDATES, OVERLAY_FALLBACK,
                         OVERLAY_MIN_DISTANCE, VETO_DEFAULT, VETO_THRESHOLDS)
from ..functions import color
from ..functions.predicates import incompatible
from ..schema import PIXEL_KEYS
from .components import label_components, of_components, vetoed_components

Mask = tuple[DataFrame, tuple[int, int, int]]


def paint(base: DataFrame, masks: list[Mask], keys: list[str] | None = None) -> DataFrame:
    """Paint masks over a base image, later masks win; set pixels only in each mask.

    Base and masks go through one aggregation: each carries its place in the
    paint order above its colour in one long, and the largest survives. Mask
    pixels outside the base are dropped.
    """
    keys = keys or PIXEL_KEYS
    rows = [base.select(*keys, color.pack_rgb("r", "g", "b").cast("long").alias("_p"), F.lit(1).alias("_base"))]
    for place, (mask, rgb) in enumerate(masks, start=1):
        value = (place << 24) | (rgb[0] << 16) | (rgb[1] << 8) | rgb[2]
        rows.append(mask.select(*keys, F.lit(value).cast("long").alias("_p"), F.lit(0).alias("_base")))
    top = reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.max("_p").alias("_p"), F.max("_base").alias("_base"))
    r, g, b = color.unpack_rgb(F.col("_p").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    return top.filter("_base = 1").select(*keys, r.alias("r"), g.alias("g"), b.alias("b"))


def mask_from_raster(px: DataFrame, band: str, nodata: Column) -> DataFrame:
    """Pixels above zero, after nodata is read as zero."""
    return px.filter((F.col(band) > 0) & ~F.col(band).eqNullSafe(nodata)).select(*PIXEL_KEYS)


def mask_from_rgb(px: DataFrame) -> DataFrame:
    """A coloured mask: any non-zero band counts as set."""
    return px.filter((F.col("r") + F.col("g") + F.col("b")) > 0).select(*PIXEL_KEYS)


def mask_union(masks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.select(*PIXEL_KEYS) for m in masks]).distinct()


def align_mask(mask: DataFrame, base: DataFrame, src_row: Column, src_col: Column) -> DataFrame:
    """Base pixels whose centre falls on a set pixel of a mask on another grid."""
    m = mask.select(F.col("raster_id").alias("_rid"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    b = base.select(*PIXEL_KEYS, src_row.cast("int").alias("_sr"), src_col.cast("int").alias("_sc"))
    on = (b["raster_id"] == m["_rid"]) & (b["_sr"] == m["_r"]) & (b["_sc"] == m["_c"])
    return b.join(m, on, "left_semi").select(*PIXEL_KEYS)


def surviving_mask(mask: DataFrame, original: DataFrame, material: str, source: str,
                   kmeans_rgb: dict[str, tuple[int, int, int]], tile: int = 512) -> tuple[DataFrame, DataFrame]:
    """Mask pixels left after the component veto, and the veto table.

    Thresholds above one never veto, so labelling is skipped for them.
    """
    threshold = VETO_THRESHOLDS.get(source, VETO_DEFAULT)
    names = [n for n in INCOMPATIBLE.get(material, ()) if n in kmeans_rgb]
    labels = label_components(mask, ["raster_id"], tile, 8, with_node=True)
    bad = original.filter(incompatible("r", "g", "b", [kmeans_rgb[n] for n in names]))
    table = vetoed_components(labels, bad, threshold)
    keep = of_components(labels, table.filter(~F.col("vetoed")))
    return keep.select(*PIXEL_KEYS), table


def fuse(base: DataFrame, original: DataFrame, masks: list[tuple[DataFrame, str, str]],
         kmeans_rgb: dict[str, tuple[int, int, int]], tile: int = 512) -> DataFrame:
    """Paint named masks in order; a mask whose source can veto loses its vetoed components."""
    painted = []
    for mask, material, source in masks:
        if VETO_THRESHOLDS.get(source, VETO_DEFAULT) <= 1.0:
            mask, _ = surviving_mask(mask, original, material, source, kmeans_rgb, tile)
        painted.append((mask, CLASS_RGB[material]))
    return paint(base, painted)


def pick_overlay_colours(classes: DataFrame, n_layers: int) -> DataFrame:
    """Distinct overlay colours: far from every class colour first, then any unused one.

    ``classes`` has ``r, g, b``; the candidate list is short, so classes are
    reduced to one flag per candidate in a single aggregation.
    """
    too_close = [F.max(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g)
                        + (F.col("b") - b) * (F.col("b") - b)) <= F.lit(OVERLAY_MIN_DISTANCE ** 2))
                 for r, g, b in OVERLAY_CANDIDATES]
    near = classes.agg(F.array(*[F.coalesce(f, F.lit(False)) for f in too_close]).alias("near"))
    cand = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
                     for i, (r, g, b) in enumerate(OVERLAY_CANDIDATES)])
    ranked = F.array_sort(F.transform(cand, lambda c: F.struct(
        F.element_at("near", c["i"] + 1).cast("int").alias("near"), c["i"].alias("i"),
        c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))))
    fr, fg, fb = OVERLAY_FALLBACK
    fallback = F.struct(F.lit(1).alias("near"), F.lit(99).alias("i"), F.lit(fr).alias("r"),
                        F.lit(fg).alias("g"), F.lit(fb).alias("b"))
    picks = near.withColumn("_all", ranked).select(
        F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(n_layers)),
                                 lambda k: F.coalesce(F.get("_all", k - 1), fallback))).alias("layer", "c"))
    return picks.select("layer", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"))


def resolve_overlay_colours(layers: DataFrame, classes: DataFrame, auto: DataFrame) -> DataFrame:
    """Colour of each layer: caller class id, caller name, built-in id, built-in name, own, automatic.

    ``layers`` has ``layer, class_id, name, override``; ``classes`` has ``id, name, color``.
    """
    ok = F.col("color").rlike("^#[0-9A-Fa-f]{6}$")
    last = lambda key, out: classes.filter(ok).groupBy(F.col(key).alias(out)).agg(
        F.max_by(F.lower("color"), F.col("pos")).alias(f"_{out}"))
    built_id = {c["id"]: c["color"].lower() for c in CLASSES}
    built_name = {c["name"]: c["color"].lower() for c in CLASSES}
    from ..functions.naming import literal_map
    hexed = auto.select("layer", F.lower(color.rgb_to_hex("r", "g", "b")).alias("_auto"))
    out = (layers.join(last("id", "class_id"), "class_id", "left").join(last("name", "name"), "name", "left")
           .join(hexed, "layer", "left"))
    resolved = F.coalesce("_class_id", "_name", literal_map(built_id)[F.col("class_id")],
                          literal_map(built_name)[F.col("name")], F.lower("override"), "_auto")
    return out.select(*layers.columns, resolved.alias("color"))


def veto_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("material").agg(F.count("*").alias("total"),
                                         F.sum(F.col("vetoed").cast("int")).cast("long").alias("vetoed"))


def numbered_layers(layers: DataFrame, n_classes: int) -> DataFrame:
    """Burn value of each overlay layer (zero-based ``layer``), after the class values."""
    return layers.withColumn("burn", F.col("layer") + F.lit(n_classes + 1))
