"""A whole cell: catalogue, grid, composite, labelling, masks and index export."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MOSAIC_TILE_PX
from ..functions import geo
from ..operators.composite import (area_average, composite_order, composite_tiles, priority_composite,
                                   resample_tiles)
from ..operators.rangejoin import grid_cells
from ..operators.stats import attach_by
from ..sources.rasters import finest_pixel, touching_cell
from . import material_map as mm


@dataclass(frozen=True)
class Layer:
    folder: str
    priority: int
    glob: tuple[str, ...] = ("*.tif", "*.tiff", "*.jp2")
    name: str | None = None


@dataclass(frozen=True)
class CellConfig:
    """One cell run. Unknown keys, repeated priorities and unsnapped cells are errors."""

    south_lat: int
    west_lon: int
    layers: tuple[Layer, ...]
    output: str
    sources: tuple[str, ...] = ()
    overwrite: bool = False
    use_models: bool = True
    water_mask: str | None = None
    max_side: int | None = None

    def __post_init__(self):
        if not -90 <= self.south_lat <= 89 or not -180 <= self.west_lon <= 179:
            raise ValueError("cell is out of range")
        if self.west_lon % self.lon_width:
            raise ValueError(f"west_lon={self.west_lon} is not a multiple of the zone width {self.lon_width}")
        if not self.layers:
            raise ValueError("at least one layer is required")
        seen = [x.priority for x in self.layers]
        if min(seen) < 1 or len(set(seen)) != len(seen):
            raise ValueError("layer priorities must be distinct and at least one")
        if any(not g.strip() for x in self.layers for g in x.glob) or any(not x.glob for x in self.layers):
            raise ValueError("glob patterns must not be empty")
        if self.max_side is not None and not 256 <= self.max_side <= 100_000:
            raise ValueError("max_side is out of range")

    @property
    def lon_width(self) -> int:
        mid = abs(self.south_lat + 0.5)
        return next(w for limit, w in ((80, 12), (75, 6), (70, 4), (50, 2), (0, 1)) if mid >= limit)

    @property
    def box(self) -> tuple[float, float, float, float]:
        return (float(self.west_lon), float(self.south_lat), float(self.west_lon + self.lon_width), float(self.south_lat + 1))


def _checked(section: dict, allowed: set[str], where: str) -> dict:
    extra = set(section) - allowed
    if extra:
        raise ValueError(f"unknown keys in {where}: {sorted(extra)}")
    return section


def load_config(path: str) -> CellConfig:
    """Read a manifest; relative paths are taken from its own folder."""
    p = Path(path)
    data = tomllib.loads(p.read_text(encoding="utf-8"))
    base = p.resolve().parent
    at = lambda v: str(v) if "://" in str(v) or Path(v).is_absolute() else str(base / v)
    _checked(data, {"geocell", "layers", "sources", "classify", "output", "parallelism"}, "manifest")
    cell = _checked(data["geocell"], {"south_lat", "west_lon"}, "geocell")
    out = _checked(data["output"], {"path", "overwrite"}, "output")
    cls = _checked(data.get("classify", {}), {"sam3", "water_mask", "max_mosaic_side"}, "classify")
    _checked(data.get("parallelism", {}), {"workers"}, "parallelism")
    layers = []
    for raw in data.get("layers", []):
        raw = dict(_checked(raw, {f.name for f in fields(Layer)}, "layers"))
        raw["folder"] = at(raw["folder"])
        if "glob" in raw:
            raw["glob"] = (raw["glob"],) if isinstance(raw["glob"], str) else tuple(raw["glob"])
        layers.append(Layer(**raw))
    return CellConfig(cell["south_lat"], cell["west_lon"], tuple(layers), at(out["path"]),
                      tuple(at(s) for s in data.get("sources", [])), bool(out.get("overwrite", False)),
                      bool(cls.get("sam3", True)), at(cls["water_mask"]) if cls.get("water_mask") else None,
                      cls.get("max_mosaic_side"))


def plan_grid(sources: DataFrame, cfg: CellConfig) -> tuple[DataFrame, int, int, float]:
    """Sources in the cell with composite order, and the grid they share."""
    west, south, east, north = cfg.box
    kept = touching_cell(sources, west, south, east, north)
    g = geo.grid_size(F.lit(east - west), F.lit(north - south), "gsd", cfg.max_side)
    row = finest_pixel(kept).select(g.alias("g")).select("g.*").first()  # one row
    return composite_order(kept), int(row["width"]), int(row["height"]), float(row["gsd"])


def placement(sources: DataFrame, cfg: CellConfig, gsd: float) -> DataFrame:
    """Scale and offset of each source on the cell grid.

    Positions are snapped to a millionth of a pixel, so aligned grids stay aligned.
    """
    west, _, _, north = cfg.box
    return sources.select("path", "ord", F.round(F.lit(gsd) / F.col("px_x"), 6).alias("rx"),
                          F.round(F.lit(gsd) / F.col("px_y"), 6).alias("ry"),
                          F.round((F.col("west") - west) / gsd, 6).alias("ox"),
                          F.round((F.lit(north) - F.col("north")) / gsd, 6).alias("oy"))


def to_cell_grid(px: DataFrame, sources: DataFrame, cfg: CellConfig, gsd: float, width: int, height: int) -> DataFrame:
    """Area-average source pixels onto the cell grid, one result per source and cell pixel.

    ``px`` holds ``path, row, col, r, g, b``; ``sources`` holds ``path, west,
    north, px_x, px_y, ord``.
    """
    held = attach_by(px, placement(sources, cfg, gsd), ["path"])
    held = held.filter(F.col("ord").isNotNull())
    flat = area_average(held, ["r", "g", "b"], F.col("rx"), F.col("ry"), ["path", "ord"], F.col("ox"), F.col("oy"))
    flat = flat.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))
    return flat.withColumns({c: F.floor(F.col(c) + 0.5).cast("int") for c in "rgb"})


def mosaic(px: DataFrame, sources: DataFrame, cfg: CellConfig) -> tuple[DataFrame, int, int, float]:
    """Priority composite of all sources on the cell grid, as pixels of one raster."""
    ranked, width, height, gsd = plan_grid(sources, cfg)
    flat = to_cell_grid(px, ranked, cfg, gsd, width, height)
    out = priority_composite(flat, ["row", "col"], F.col("ord")).drop("ord")
    return out.withColumn("raster_id", F.lit("cell")), width, height, gsd


SOURCES_PER_TASK = 64


def merge_salts(ranked: DataFrame, cfg: CellConfig, gsd: float, width: int, height: int, tile: int) -> int:
    """Salts for the composite: enough that no merge reads more than a fixed number of sources on average."""
    west, _, _, north = cfg.box
    px = lambda c: (F.col(c) - west) / gsd
    py = lambda c: (F.lit(north) - F.col(c)) / gsd
    boxes = ranked.select(px("west").alias("x0"), px("east").alias("x1"), py("north").alias("y0"), py("south").alias("y1"))
    cells = grid_cells(boxes, "x0", "y0", "x1", "y1", 0.0, 0.0, float(tile), -(-width // tile), -(-height // tile),
                       inclusive=False)
    most = cells.groupBy("cell_y", "cell_x").agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).first()["m"]
    return max(1, -(-(most or 1) // SOURCES_PER_TASK))


def mosaic_tiles(tiles: DataFrame, sources: DataFrame, cfg: CellConfig, tile: int = MOSAIC_TILE_PX,
                 salts: int | None = None) -> tuple[DataFrame, int, int, float]:
    """The same composite from stored tiles (``raster_id`` is the source path), as byte tiles."""
    ranked, width, height, gsd = plan_grid(sources, cfg)
    place = placement(ranked, cfg, gsd).withColumnRenamed("path", "raster_id")
    flat = resample_tiles(tiles, place, width, height, tile)
    salts = salts or merge_salts(ranked, cfg, gsd, width, height, tile)
    return composite_tiles(flat, tile, salts), width, height, gsd


def run_cell(px: DataFrame, sources: DataFrame, cfg: CellConfig, masks: list | None = None,
             opts: mm.Options = mm.Options(), model: mm.Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Composite, label, paint masks and export the index of the whole cell; returns index and histogram."""
    image, width, height, _ = mosaic(px, sources, cfg)
    painted = mm.classify_batch(image, opts, model)
    if masks:
        painted = mm.fuse_masks(painted, image, masks, opts)
    return mm.export_index(painted, F.lit(0), size=(height, width))
