"""Vector features: buffering, tiling and burning onto pixel grids.

Burning is a relational scanline: ring edges become rows, each edge yields the
pixels it passes through, and the crossings of each pixel row pair up into
filled spans. Work follows the outline and the filled area, never the product
of pixels and edges. A pixel is the half-open square from its upper-left corner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .rangejoin import grid_cells

DISC_STEPS = 64


def with_bbox(features: DataFrame, rings: str = "rings") -> DataFrame:
    pts = F.flatten(F.col(rings))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return (features.withColumn("minx", F.array_min(xs)).withColumn("miny", F.array_min(ys))
            .withColumn("maxx", F.array_max(xs)).withColumn("maxy", F.array_max(ys)))


def drop_empty(features: DataFrame, rings: str = "rings") -> DataFrame:
    return features.filter(F.col(rings).isNotNull() & (F.size(F.flatten(F.col(rings))) > 0))


def ring_edges(features: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """One row per ring edge, in pixel units (x to the right, y down)."""
    ring = features.select(*keys, F.explode(rings).alias("_ring"))
    n = F.size("_ring")
    nxt = F.concat(F.slice("_ring", 2, n), F.slice("_ring", 1, 1))
    edge = ring.select(*keys, F.explode(F.arrays_zip(F.col("_ring").alias("p"), nxt.alias("q"))).alias("e"))
    return edge.select(*keys, F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"),
                       F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")).filter(
        F.col("x1").isNotNull() & F.col("x0").isNotNull())


def burned_spans(features: DataFrame, keys: list[str], height: Column | int, width: Column | int,
                 all_touched: bool = True, rings: str = "rings") -> DataFrame:
    """Spans (row, _a, _b; both ends inside) of the pixels of polygons, which may overlap."""
    # a small file of features makes many pixels: without a number of partitions they would be merged into one task
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    features = features.repartition(parts, *keys)
    h = height if isinstance(height, Column) else F.lit(height)
    w = width if isinstance(width, Column) else F.lit(width)
    edges = ring_edges(features.withColumn("_h", h).withColumn("_w", w), [*keys, "_h", "_w"], rings)
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    row_range = F.sequence(F.greatest(F.lit(0), F.floor(lo).cast("int")),
                           F.least(F.col("_h") - 1, F.floor(hi).cast("int")))
    rows = edges.filter((hi >= 0) & (lo < F.col("_h"))).withColumn("row", F.explode(row_range))
    slope = (F.col("x1") - F.col("x0")) / F.when(F.col("y1") != F.col("y0"), F.col("y1") - F.col("y0"))
    x_at = lambda y: F.coalesce(F.col("x0") + (y - F.col("y0")) * slope, F.col("x0"))

    centre = F.col("row") + 0.5
    cross = rows.filter((F.col("y0") <= centre) != (F.col("y1") <= centre)).withColumn("_x", x_at(centre))
    by_row = W.partitionBy(*keys, "row").orderBy("_x")
    spans = cross.withColumn("_n", F.row_number().over(by_row)).withColumn("_to", F.lead("_x").over(by_row)).filter(
        F.col("_n") % 2 == 1)
    first = F.greatest(F.lit(0), F.ceil(F.col("_x") - 0.5).cast("int"))
    last = F.least(F.col("_w") - 1, (F.ceil(F.col("_to") - 0.5) - 1).cast("int"))
    inside = spans.withColumn("_a", first).withColumn("_b", last).filter("_b >= _a").select(
        *keys, "row", "_a", "_b")
    if not all_touched:
        return inside

    top, bottom = F.greatest(lo, F.col("row").cast("double")), F.least(hi, F.col("row") + 1.0)
    flat = F.col("y0") == F.col("y1")
    xa = F.when(flat, F.least("x0", "x1")).otherwise(F.least(x_at(top), x_at(bottom)))
    xb = F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest(x_at(top), x_at(bottom)))
    on_edge = rows.withColumn("_a", F.greatest(F.lit(0), F.floor(xa).cast("int"))).withColumn(
        "_b", F.least(F.col("_w") - 1, F.floor(xb).cast("int"))).filter("_b >= _a").select(
        *keys, "row", "_a", "_b")
    return inside.unionByName(on_edge)


def span_pixels(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel of the spans once: a span gives what those before it in its row do not reach, so only spans are shuffled."""
    before = W.partitionBy(*keys, "row").orderBy("_a", "_b").rowsBetween(W.unboundedPreceding, -1)
    own = spans.withColumn("_a", F.greatest(F.col("_a"), F.max("_b").over(before) + 1)).filter("_b >= _a")
    return own.select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col"))


def burn(features: DataFrame, keys: list[str], height: Column | int, width: Column | int,
         all_touched: bool = True, rings: str = "rings") -> DataFrame:
    """Pixels of polygons, even-odd over all rings; with ``all_touched`` also every pixel on an edge."""
    return span_pixels(burned_spans(features, keys, height, width, all_touched, rings), keys)


def buffer_lines(lines: DataFrame, points: str, half_width: str) -> DataFrame:
    """Rings of flat-capped strips, one per segment, plus discs at inner vertices.

    Each part is its own row (``rings``), so burning their union gives the
    buffered line with round joins.
    """
    n = F.size(points)
    hw = F.col(half_width)
    seg = lines.filter(n >= 2).withColumn("_i", F.explode(F.sequence(F.lit(1), n - 1)))
    p, q = F.element_at(points, F.col("_i")), F.element_at(points, F.col("_i") + 1)
    seg = seg.withColumn("_p", p).withColumn("_q", q)
    dx, dy = F.col("_q.x") - F.col("_p.x"), F.col("_q.y") - F.col("_p.y")
    length = F.sqrt(dx * dx + dy * dy)
    seg = seg.withColumn("_nx", -dy / length * hw).withColumn("_ny", dx / length * hw).filter(length > 0)
    at = lambda o, s: F.struct((F.col(f"{o}.x") + s * F.col("_nx")).alias("x"),
                               (F.col(f"{o}.y") + s * F.col("_ny")).alias("y"))
    strips = seg.withColumn("rings", F.array(F.array(at("_p", 1), at("_q", 1), at("_q", -1), at("_p", -1))))
    keep = lines.columns
    inner = lines.filter(n >= 3).withColumn("_i", F.explode(F.sequence(F.lit(2), n - 1)))
    inner = inner.withColumn("_c", F.element_at(points, F.col("_i")))
    angle = lambda k: k * F.lit(2 * math.pi / DISC_STEPS)
    disc = F.transform(F.sequence(F.lit(0), F.lit(DISC_STEPS - 1)), lambda k: F.struct(
        (F.col("_c.x") + hw * F.cos(angle(k))).alias("x"), (F.col("_c.y") + hw * F.sin(angle(k))).alias("y")))
    discs = inner.withColumn("rings", F.array(disc))
    return strips.select(*keep, "rings").unionByName(discs.select(*keep, "rings"))


def burn_lines(lines: DataFrame, keys: list[str], points: str, half_width: str, height, width,
               all_touched: bool = True) -> DataFrame:
    """Pixels of buffered lines. Parts are burned on their own and united, since they overlap."""
    parts = buffer_lines(lines, points, half_width).withColumn("_part", F.monotonically_increasing_id())
    return span_pixels(burned_spans(parts, [*keys, "_part"], height, width, all_touched), keys)


def features_per_tile(features: DataFrame, origin_x: float, origin_y: float, size: float, n_x, n_y) -> DataFrame:
    """Every tile a feature's box meets, shared edges included; a feature may repeat."""
    return grid_cells(features, "minx", "miny", "maxx", "maxy", origin_x, origin_y, size, n_x, n_y, inclusive=True)


def extract_tiles(boxes: DataFrame, size: float) -> DataFrame:
    """Tiles of at most ``size`` covering each box, clipped, with WKT text."""
    s = F.lit(float(size))
    span = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / s).cast("int"))
    out = boxes.filter((F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny")) & (s > 0))
    out = out.withColumn("iy", F.explode(F.sequence(F.lit(0), span("miny", "maxy") - 1)))
    out = out.withColumn("ix", F.explode(F.sequence(F.lit(0), span("minx", "maxx") - 1)))
    out = out.withColumn("x0", F.col("minx") + F.col("ix") * s).withColumn("y0", F.col("miny") + F.col("iy") * s)
    out = out.withColumn("x1", F.least(F.col("maxx"), F.col("x0") + s)).withColumn(
        "y1", F.least(F.col("maxy"), F.col("y0") + s))
    return out.withColumn("wkt", geo.wkt_box("x0", "y0", "x1", "y1"))


def with_fallback_rings(features: DataFrame, raster_box: dict, by: str = "layer") -> DataFrame:
    """Use projected rings where a layer's projected box meets the raster, else the original ones.

    Layers that meet it in neither form are dropped. ``features`` has ``rings``
    (projected) and ``orig_rings``.
    """
    def layer_box(prefix: str, rings: str) -> list[Column]:
        pts = F.flatten(F.col(rings))
        return [F.min(F.array_min(F.transform(pts, lambda p: p["x"]))).alias(f"{prefix}west"),
                F.min(F.array_min(F.transform(pts, lambda p: p["y"]))).alias(f"{prefix}south"),
                F.max(F.array_max(F.transform(pts, lambda p: p["x"]))).alias(f"{prefix}east"),
                F.max(F.array_max(F.transform(pts, lambda p: p["y"]))).alias(f"{prefix}north")]

    boxes = features.groupBy(by).agg(*layer_box("p_", "rings"), *layer_box("o_", "orig_rings"))
    choice = F.when(geo.touches(geo.box("p_"), raster_box), "projected").when(
        geo.touches(geo.box("o_"), raster_box), "original")
    pick = boxes.select(by, choice.alias("_use")).filter(F.col("_use").isNotNull())
    return features.join(pick, by).withColumn(
        "rings", F.when(F.col("_use") == "projected", F.col("rings")).otherwise(F.col("orig_rings"))).withColumnRenamed(
        "_use", "coords")
