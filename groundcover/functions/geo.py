"""Geographic expressions: cells, grids, windows, projections and bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MERCATOR_HALF, METRES_PER_DEGREE
from .color import as_col


def mercator_x(lon) -> Column:
    return as_col(lon) * F.lit(MERCATOR_HALF) / F.lit(180.0)


def mercator_y(lat) -> Column:
    return F.ln(F.tan((F.lit(90.0) + as_col(lat)) * F.lit(math.pi) / F.lit(360.0))) * F.lit(
        MERCATOR_HALF / math.pi)


def lon_from_mercator(x) -> Column:
    return as_col(x) / F.lit(MERCATOR_HALF) * F.lit(180.0)


def lat_from_mercator(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(as_col(y) / F.lit(MERCATOR_HALF) * F.lit(math.pi)))
                     - F.lit(math.pi / 2))


def rings_to_mercator(rings) -> Column:
    """Project every vertex of ``array<array<struct<x,y>>>``."""
    point = lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y"))
    return F.transform(as_col(rings), lambda ring: F.transform(ring, point))


def metres_to_units(metres, is_geographic, unit_factor=None) -> Column:
    factor = F.lit(1.0) if unit_factor is None else as_col(unit_factor)
    projected = F.when(factor == 0, as_col(metres)).otherwise(as_col(metres) / factor)
    return F.when(as_col(is_geographic), as_col(metres) / F.lit(METRES_PER_DEGREE)).otherwise(projected)


def pixel_to_geo(west, north, xres, yres, col, row) -> tuple[Column, Column]:
    return as_col(west) + as_col(col) * as_col(xres), as_col(north) - as_col(row) * as_col(yres)


def geo_to_pixel(west, north, xres, yres, x, y) -> tuple[Column, Column]:
    return (F.floor((as_col(x) - as_col(west)) / as_col(xres)).cast("int"),
            F.floor((as_col(north) - as_col(y)) / as_col(yres)).cast("int"))


def geo_window(west, north, xres, yres, width, height, left, top, right, bottom) -> Column:
    """Pixel window of a geographic box, clamped to the raster, at least 1x1."""
    c0, r0 = geo_to_pixel(west, north, xres, yres, left, top)
    c1, r1 = geo_to_pixel(west, north, xres, yres, right, bottom)
    x = F.greatest(F.lit(0), F.least(c0, c1))
    y = F.greatest(F.lit(0), F.least(r0, r1))
    w = F.greatest(F.lit(1), F.least(as_col(width), F.greatest(c0, c1)) - x)
    h = F.greatest(F.lit(1), F.least(as_col(height), F.greatest(r0, r1)) - y)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def bounds(west, north, xres, yres, width, height) -> Column:
    west, north = as_col(west), as_col(north)
    return F.struct(
        west.alias("west"), (north - as_col(height) * as_col(yres)).alias("south"),
        (west + as_col(width) * as_col(xres)).alias("east"), north.alias("north"))


def bounds_wgs84(epsg, box) -> Column:
    """Bounds in degrees for 4326 and 3857; other systems pass through unchanged."""
    b, merc = as_col(box), as_col(epsg) == 3857
    lon = lambda v: F.when(merc, lon_from_mercator(v)).otherwise(v)
    lat = lambda v: F.when(merc, lat_from_mercator(v)).otherwise(v)
    return F.struct(lon(b["west"]).alias("west"), lat(b["south"]).alias("south"),
                    lon(b["east"]).alias("east"), lat(b["north"]).alias("north"))


def crs_code(crs_text, epsg) -> Column:
    """A local Pseudo-Mercator label counts as 3857."""
    text = as_col(crs_text)
    local = text.startswith("LOCAL_CS") & text.contains("Pseudo-Mercator")
    return F.when(local, F.lit(3857)).otherwise(as_col(epsg))


def zone_width(lat) -> Column:
    """Longitude width in degrees of a cell at a latitude."""
    a = F.abs(as_col(lat))
    return (F.when(a >= 80, F.lit(12)).when(a >= 75, F.lit(6)).when(a >= 70, F.lit(4))
            .when(a >= 50, F.lit(2)).otherwise(F.lit(1)))


def cell_name(south_lat, west_lon) -> Column:
    lat, lon = as_col(south_lat), as_col(west_lon)
    return F.concat(
        F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")), F.lpad(F.abs(lat).cast("string"), 2, "0"),
        F.when(lon >= 0, F.lit("E")).otherwise(F.lit("W")), F.lpad(F.abs(lon).cast("string"), 3, "0"))


def cell_width(south_lat) -> Column:
    """Width of the cell, decided at its middle latitude."""
    return zone_width(as_col(south_lat) + F.lit(0.5))


def cell_is_snapped(south_lat, west_lon) -> Column:
    lat, lon = as_col(south_lat), as_col(west_lon)
    return (lat.between(-90, 89) & lon.between(-180, 179)
            & (F.pmod(lon, cell_width(south_lat)) == 0))


def snapped_cell(south_lat, west_lon) -> Column:
    """Cell bounds; a cell off the zone grid fails the query."""
    lat, lon = as_col(south_lat), as_col(west_lon)
    err = F.raise_error(F.format_string("west_lon=%d is off the zone grid at latitude %d", lon, lat))
    west = F.when(cell_is_snapped(lat, lon), lon.cast("double")).otherwise(err.cast("double"))
    return F.struct(
        cell_name(lat, lon).alias("name"), west.alias("west"), lat.cast("double").alias("south"),
        (west + cell_width(lat)).alias("east"), (lat + 1).cast("double").alias("north"))


def overlaps(a: dict | None = None, b: dict | None = None) -> Column:
    """Strict box overlap: a shared edge does not count."""
    return ((a["west"] < b["east"]) & (a["east"] > b["west"])
            & (a["south"] < b["north"]) & (a["north"] > b["south"]))


def touches(a: dict, b: dict) -> Column:
    """Inclusive box overlap: a shared edge counts."""
    return ((a["west"] <= b["east"]) & (a["east"] >= b["west"])
            & (a["south"] <= b["north"]) & (a["north"] >= b["south"]))


def box(prefix: str = "") -> dict:
    return {k: F.col(f"{prefix}{k}") for k in ("west", "south", "east", "north")}


def lit_box(west, south, east, north) -> dict:
    return {k: F.lit(float(v)) for k, v in
            zip(("west", "south", "east", "north"), (west, south, east, north))}


def grid_size(extent_x, extent_y, gsd, max_side: int | None = None) -> Column:
    """Grid width, height and used resolution; over a cap, if one is given, the grid is coarsened."""
    ex, ey, g = as_col(extent_x), as_col(extent_y), as_col(gsd)
    w0 = F.greatest(F.lit(1), F.bround(ex / g).cast("int"))
    h0 = F.greatest(F.lit(1), F.bround(ey / g).cast("int"))
    if max_side is None:
        return F.struct(w0.alias("width"), h0.alias("height"), g.alias("gsd"))
    longest = F.greatest(w0, h0)
    over = longest > max_side
    used = F.when(over, g * (longest / F.lit(float(max_side)))).otherwise(g)
    w1 = F.greatest(F.lit(1), F.ceil(ex / used).cast("int"))
    h1 = F.greatest(F.lit(1), F.ceil(ey / used).cast("int"))
    return F.struct(F.when(over, w1).otherwise(w0).alias("width"),
                    F.when(over, h1).otherwise(h0).alias("height"), used.alias("gsd"))


def source_window(src: dict, cell: dict, gsd, width, height, pad: int = 1) -> Column:
    """Padded, clipped pixel window of a source on the target grid; null when empty."""
    gsd, width, height = as_col(gsd), as_col(width), as_col(height)
    iw, ie = F.greatest(src["west"], cell["west"]), F.least(src["east"], cell["east"])
    js, jn = F.greatest(src["south"], cell["south"]), F.least(src["north"], cell["north"])
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(v, hi)).cast("int")
    c0 = clamp(F.floor((iw - cell["west"]) / gsd) - pad, width)
    c1 = clamp(F.ceil((ie - cell["west"]) / gsd) + pad, width)
    r0 = clamp(F.floor((cell["north"] - jn) / gsd) - pad, height)
    r1 = clamp(F.ceil((cell["north"] - js) / gsd) + pad, height)
    keep = (ie > iw) & (jn > js) & (c1 > c0) & (r1 > r0)
    return F.when(keep, F.struct(c0.alias("col0"), r0.alias("row0"),
                                 (c1 - c0).alias("w"), (r1 - r0).alias("h")))


def overview_factor(factors, downsample) -> Column:
    """Largest decimation factor not above ``downsample``; null below two."""
    d = as_col(downsample)
    usable = F.array_max(F.filter(as_col(factors), lambda f: f <= d))
    return F.when(d >= 2, usable)


def auto_tile_size(height, width, max_pixels) -> Column:
    side = F.floor(F.sqrt(F.greatest(F.lit(128 * 128), as_col(max_pixels).cast("long")).cast("double")))
    return F.least(F.greatest(F.lit(128), side), F.greatest(as_col(height), as_col(width))).cast("int")


def wkt_box(x0, y0, x1, y1) -> Column:
    pt = lambda x, y: F.concat(as_col(x).cast("string"), F.lit(" "), as_col(y).cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(
        ", ", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)), F.lit("))"))
