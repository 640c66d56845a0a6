"""Raster tables: headers, footprints and images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import TILE


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of a stored raster set; filters on keys and offsets reach the scan."""
    return spark.read.parquet(path)


def footprints(rasters: DataFrame) -> DataFrame:
    """Bounds in degrees and the coarser pixel size, from headers only."""
    no_crs = F.raise_error(F.concat(F.lit("source has no CRS: "), F.col("path"))).cast("int")
    b = geo.bounds_wgs84(F.coalesce("epsg", no_crs), geo.bounds("west", "north", "xres", "yres", "width", "height"))
    out = rasters.withColumn("_b", b)
    px = F.greatest((F.col("_b.east") - F.col("_b.west")) / F.greatest(F.lit(1), F.col("width")),
                    (F.col("_b.north") - F.col("_b.south")) / F.greatest(F.lit(1), F.col("height")))
    return out.select("path", "priority", F.col("_b.west").alias("west"), F.col("_b.south").alias("south"),
                      F.col("_b.east").alias("east"), F.col("_b.north").alias("north"), px.alias("px"))


def raster_info(rasters: DataFrame) -> DataFrame:
    b = geo.bounds("west", "north", "xres", "yres", "width", "height")
    return rasters.select("raster_id", "width", "height", "n_bands", F.lit("uint8").alias("dtype"),
                          F.concat(F.lit("EPSG:"), F.col("epsg")).alias("crs"), "epsg",
                          b["west"].alias("left"), b["south"].alias("bottom"), b["east"].alias("right"),
                          b["north"].alias("top"))


def touching_cell(sources: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Sources that overlap a cell; comparisons on plain columns, so they reach the scan."""
    return sources.filter(geo.overlaps(geo.box(), geo.lit_box(west, south, east, north)))


def summary_by_priority(sources: DataFrame) -> DataFrame:
    return sources.groupBy("priority").agg(
        F.count("*").alias("n_files"), F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"))


def finest_pixel(sources: DataFrame) -> DataFrame:
    """Smallest positive pixel size; none is an error."""
    px = F.min(F.when(F.col("px") > 0, F.col("px")))
    return sources.agg(F.coalesce(px, F.raise_error(F.lit("no source has a usable pixel size")).cast("double")).alias("gsd"))


def union_extent(rasters: DataFrame) -> DataFrame:
    """Union bounds, number of rasters and the first path."""
    return rasters.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"),
                       F.max("north").alias("north"), F.count("*").alias("n_rasters"), F.min("path").alias("first"))


def read_images(spark: SparkSession, path: str, tile: int = 512) -> DataFrame:
    """Plain images through Spark's image source, cut to byte tiles (RGB order).

    One image is one row, so a task holds one image; large scenes should arrive
    as tiles. An image that cannot be read fails the job.
    """
    img = spark.read.format("image").load(path).select("image.*")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TILE.split(", ")]
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.nChannels < 1:
                    raise ValueError(f"{r.origin} is not a readable image")
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                a = a[:, :, 2::-1] if r.nChannels >= 3 else np.repeat(a, 3, axis=2)
                rows = []
                for y in range(0, r.height, tile):
                    for x in range(0, r.width, tile):
                        part = np.moveaxis(a[y:y + tile, x:x + tile], 2, 0)
                        rows.append((r.origin, y // tile, x // tile, y, x, part.shape[1], part.shape[2], r.height,
                                     r.width, 3, np.ascontiguousarray(part).tobytes()))
                yield pd.DataFrame(rows, columns=names)

    return img.mapInPandas(cut, TILE)
