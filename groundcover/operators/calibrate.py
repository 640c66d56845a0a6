"""Region statistics for calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .stats import attach_by


def region_cells(regions: DataFrame) -> DataFrame:
    """How many regions of each material cover each pixel.

    Equal row spans are merged before columns are expanded, and rows are spread
    first, so one large or often repeated region is not expanded by one task.
    """
    rows = regions.select("material", "x", "w", F.explode(F.expr("sequence(y, y + h - 1)")).alias("row"))
    spans = rows.groupBy("material", "row", "x", "w").agg(F.count("*").alias("_n"))
    cells = spans.select("material", "row", "_n", F.explode(F.expr("sequence(x, x + w - 1)")).alias("col"))
    return cells.groupBy("material", "row", "col").agg(F.sum("_n").alias("_n"))


def region_statistics(px: DataFrame, regions: DataFrame) -> DataFrame:
    """Pooled colour statistics per material.

    ``regions`` has ``material, x, y, w, h``; a pixel in two regions counts twice.
    The join pairs each pixel with its own cell only, weighted by the count.
    """
    hit = px.select("row", "col", "r", "g", "b").join(region_cells(regions), ["row", "col"])
    n = F.sum("_n")
    mean = lambda c: F.sum(F.col("_n") * F.col(c)) / n
    square = lambda c: F.sum(F.col("_n") * F.col(c) * F.col(c)) / n
    stats = hit.groupBy("material").agg(
        n.alias("sample_count"), *[F.bround(mean(c)).cast("int").alias(f"mean_{c}") for c in "rgb"],
        *[F.sqrt(F.greatest(square(c) - mean(c) * mean(c), F.lit(0.0))).alias(f"_s{c}") for c in "rgb"])
    worst = F.greatest("_sr", "_sg", "_sb")
    return stats.select("material", "sample_count", *[f"mean_{c}" for c in "rgb"],
                        *[F.bround(f"_s{c}", 2).alias(f"std_{c}") for c in "rgb"],
                        color.rgb_to_hex("mean_r", "mean_g", "mean_b").alias("reference_color"),
                        color.tolerance_radius(worst).alias("tolerance_radius"))


def expand_palette(index_px: DataFrame, colormap: DataFrame) -> DataFrame:
    """Index values to colours; an index without an entry is black."""
    out = attach_by(index_px, colormap.select("idx", "r", "g", "b"), ["idx"])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgb"})
