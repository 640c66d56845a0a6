"""Queries on run-length masks and on runs over stored tiles."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import composite, reproject, runs, tiles
from ..operators.stats import attach_scalar
from ..session import ensure_checkpoint_dir
from ..sources import tile_store
from . import material_map as mm
from . import tile_run
from .q_features import (BLDG, ROAD, _BAD, _FSQL, KM, W_RGB, given_model, height_of, mask_of, reach_sql)
from .q_grid import TILE, mercator_raster
from .q_sources import dims_of
from .registry import query
from .views import view

SIDE = 16
FEATURES = ("roads", "buildings", "water")


def mask_tiles(spark, sf, feature: str, side: int = SIDE) -> DataFrame:
    px = mask_of(spark, sf, feature).withColumn("v", F.lit(1))
    return tiles.pixels_to_tiles(px, ["v"], side, dims_of(view(spark, sf, "pixel")))


def feature_runs(spark, sf, features=FEATURES) -> DataFrame:
    every = [mask_tiles(spark, sf, f).withColumn("feature", F.lit(f)) for f in features]
    return runs.tile_runs(reduce(DataFrame.unionByName, every), ("feature",))


def block_runs(spark, sf, connectivity: int) -> DataFrame:
    """Runs of the blocks, whose value is one more than the block's number."""
    px = view(spark, sf, "pixel").withColumn("v", F.col("blk") + 1)
    packed = tiles.pixels_to_tiles(px, ["v"], SIDE, dims_of(px))
    return runs.label_runs(runs.tile_runs(packed), SIDE, connectivity, ("raster_id", "value"))


@query("i1_runs_8", same_as="i1_components_8")
def i1(spark, sf):
    labels = runs.label_runs(feature_runs(spark, sf), SIDE, 8, ("raster_id", "feature"))
    return runs.run_pixels(labels, "feature", "comp").select("feature", "row", "col", "comp")


@query("i1_runs_4", same_as="i1_components_4")
def i14(spark, sf):
    return runs.run_pixels(block_runs(spark, sf, 4), "value", "comp").select((F.col("value") - 1).alias("blk"), "row", "col", "comp")


@query("i4_runs_veto", same_as="i4_component_veto")
def i4(spark, sf):
    by = ("raster_id", "feature")
    labels = runs.label_runs(feature_runs(spark, sf, ("roads", "buildings")), SIDE, 8, by)
    px = view(spark, sf, "pixel")

    def bad(bands):
        r, g, b = bands.astype(int)
        return [((r - 34) ** 2 + (g - 139) ** 2 + (b - 34) ** 2 <= 4500) | ((r - 28) ** 2 + (g - 107) ** 2 + (b - 160) ** 2 <= 4500)]

    counted = runs.with_sums(labels, tiles.pixels_to_tiles(px, ["r", "g", "b"], SIDE, dims_of(px)), ["bad"], bad)
    stats = runs.run_stats(counted.withColumnRenamed("bad", "n_bad"), by, [F.sum("n_bad").alias("bad")])
    return stats.select("feature", "comp", "area", "bad", (F.col("bad") / F.col("area") >= 0.3).alias("vetoed"))


@query("i6_runs_area", same_as="i6_area_filter")
def i6(spark, sf):
    stats = runs.run_stats(block_runs(spark, sf, 8), ("raster_id", "value"))
    return stats.filter("area >= 120").select((F.col("value") - 1).alias("blk"), "comp", "area")


@query("i7_runs_water", same_as="i7_water_shapes")
def i7(spark, sf):
    px = view(spark, sf, "pixel")
    stored = tiles.pixels_to_tiles(px, ["r", "g", "b"], SIDE, dims_of(px))
    summed = runs.with_sums(block_runs(spark, sf, 8), stored, ["sr", "sg", "sb"], lambda bands: list(bands.astype(int)))
    s = runs.run_stats(summed, ("raster_id", "value"), [F.sum(f"s{c}").alias(f"t{c}") for c in "rgb"])
    s = s.withColumns({f"m{c}": F.col(f"t{c}") / F.col("area") for c in "rgb"})
    odd = ((F.col("mr") > F.col("mb") + 30) & (F.col("mr") > F.col("mg") + 20)) | (
        (F.col("mr") > 200) & (F.col("mg") > 200) & (F.col("mb") > 200))
    return s.filter((F.col("area") >= 100) & (F.col("area") <= 9500) & ~((F.col("area") < 200) & odd)).select(
        (F.col("value") - 1).alias("blk"), "comp", "area")


@query("i5_runs_solidity", same_as="i5_solidity")
def i5(spark, sf):
    by = ("raster_id", "value")
    labels = block_runs(spark, sf, 4)
    both = runs.run_stats(labels, by).join(runs.hulls(labels, by), [*by, "comp"])
    return both.select((F.col("value") - 1).alias("blk"), "comp", "area", F.round("hull", 4).alias("hull"),
                       F.round(F.col("area") / F.col("hull"), 6).alias("solidity"))


@query("e10_runs_fill", same_as="e10_fill_holes")
def e10(spark, sf):
    px = view(spark, sf, "pixel").withColumn("v", (F.col("blk") != 3).cast("int"))
    packed = tiles.pixels_to_tiles(px, ["v"], SIDE, dims_of(px))
    inner = runs.holes(runs.tile_runs(packed, blank=True), height_of(spark, sf), F.lit(100), SIDE)
    both = runs.tile_runs(packed).unionByName(inner.select(runs.RUN_COLUMNS))
    return runs.run_pixels(both).select("row", "col")


_VETOED = f"""{reach_sql("SELECT 'buildings' AS grp, row, col FROM mask WHERE feature='buildings'", 8)},
v AS (SELECT comp, avg(case when {_BAD} then 1e0 else 0e0 end) >= 0.55e0 AS vetoed FROM cc JOIN pixel USING (row,col) GROUP BY 1),
k AS (SELECT row, col FROM cc JOIN v USING (comp) WHERE NOT vetoed)"""


@query("g6_tiles_veto", f"""WITH RECURSIVE {_VETOED}
SELECT p.row, p.col, case when k.row IS NOT NULL then 2 when {ROAD.replace('row', 'p.row')} then 1 else p.blk+1 end AS cmix
FROM pixel p LEFT JOIN k ON k.row=p.row AND k.col=p.col""", ["mask"])
def g6(spark, sf):
    """Index tiles under two masks, one of unknown origin, which loses the components the image contradicts."""
    px = view(spark, sf, "pixel")
    base = tiles.pixels_to_tiles(px.withColumn("v", F.col("blk") + 1), ["v"], SIDE, dims_of(px))
    image = tiles.pixels_to_tiles(px, ["r", "g", "b"], SIDE, dims_of(px))
    masks = [(mask_tiles(spark, sf, "buildings"), "BM_CONCRETE", "survey"), (mask_tiles(spark, sf, "roads"), "BM_ASPHALT", "shapefile")]
    index, _ = tile_run.fuse_tiles_with_veto(base, image, masks, SIDE, {**KM, "BM_WATER": W_RGB})
    return tiles.tiles_to_pixels(index, ["cmix"]).select("row", "col", "cmix")


@query("p4_masked_tiles", f"""WITH {_FSQL}
SELECT case when {BLDG} then 2 when {ROAD} then 1 when blk=4 then 4 when r+g+b<24 then 0 else [3,5,6][cluster] end AS cmix, count(*) AS n_px
FROM lab JOIN (SELECT row, col, blk FROM pixel) q USING (row, col) GROUP BY 1""", ["pixel"])
def p4(spark, sf):
    """The masked run from stored tiles to the histogram of its index."""
    px = view(spark, sf, "pixel")
    opts = mm.Options(tile=TILE, use_prior=False)
    masks = [(mask_tiles(spark, sf, "water", TILE), "BM_WATER", "raster"), (mask_tiles(spark, sf, "roads", TILE), "BM_ASPHALT", "shapefile"),
             (mask_tiles(spark, sf, "buildings", TILE), "BM_CONCRETE", "shapefile")]
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    _, counts, _ = tile_run.masked_run(packed, masks, opts, given_model(mm.features(px, opts)))
    return counts.select("cmix", "n_px")


# --- stored tiles ------------------------------------------------------------

def store(spark, packed: DataFrame, name: str, **options) -> DataFrame:
    """A stored table of the tiles in a new folder below the session's shared one."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    tile_store.write(packed, path, **options)
    return tile_store.read(spark, path)


@query("a2_stored_window", same_as="a2_window_scan")
def a2(spark, sf):
    """A window of the stored table: file statistics leave out what it does not meet."""
    px = view(spark, sf, "scene")
    stored = store(spark, tiles.pixels_to_tiles(px, ["r", "g", "b"], 16, dims_of(px)), "tiles", files=4, group_rows=4)
    out = tiles.tiles_to_pixels(tile_store.window(stored, None, 5, 20, 9, 40), ["r", "g", "b"])
    return out.filter("row >= 5 AND row < 14 AND col >= 20 AND col < 60")


@query("g1_composite_visible", same_as="g1_composite_tiles")
def g1(spark, sf):
    """The composite of stored tiles, without those that a better source hides."""
    px = view(spark, sf, "source_pixel").select(F.col("path").alias("raster_id"), "priority", "row", "col", "r", "g", "b")
    high = px.agg((F.max("row") + 1).alias("raster_h"), (F.max("col") + 1).alias("raster_w"))
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, attach_scalar(px.select("raster_id").distinct(), high))
    stored = store(spark, packed, "sources", files=4)
    ranked = stored.withColumn("ord", F.lit(1000) - F.substring("raster_id", 2, 1).cast("int")).withColumn("raster_id", F.lit("cell"))
    merged = composite.composite_visible(ranked, TILE, 2)
    return tiles.tiles_to_pixels(merged, ["r", "g", "b"], drop_blank=True).select("row", "col", "r", "g", "b")


@query("f6_reproject_tiles", same_as="f6_nearest_reproject")
def f6(spark, sf):
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], SIDE, dims_of(px))
    out = reproject.nearest_tiles(packed, mercator_raster(px), reproject.mercator_axes, 2 * SIDE)
    return tiles.tiles_to_pixels(out, ["r", "g", "b", "there"]).filter("there > 0").drop("there")


@query("f7_bilinear_tiles", same_as="f7_bilinear")
def f7(spark, sf):
    px = view(spark, sf, "pixel")
    dims = dims_of(px)
    packed = tiles.pixels_to_tiles(px, ["r", "b"], SIDE, dims)
    grids = dims.select("raster_id", F.col("raster_h").alias("height"), F.col("raster_w").alias("width"))
    axes = lambda g: (np.arange(g.height) * 0.8 + 0.3, np.arange(g.width) * 0.9 + 0.25)
    out = reproject.value_pixels(reproject.bilinear_tiles(packed, grids, axes, SIDE, 2 * SIDE), ["r", "b"])
    return out.select("raster_id", "row", "col", F.round("r", 4).alias("r"), F.round("b", 4).alias("b"))
