"""Reprojection of stored tiles, axis by axis.

The source row of a target pixel depends on its row alone, and the source column on its
column alone, as between geographic and Mercator grids or between scales. Both run one way,
so a source tile feeds one block of the target: it is cut out where the tile lies, split at
the borders of target tiles, and only these pieces are shuffled. No pixel becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MERCATOR_HALF
from ..schema import TILE, TILE_KEYS
from .stats import attach_by
from .tiles import TILE_COLUMNS, block_of, padded_tiles, spread

#: Source positions of all target rows and of all target columns, from the raster's row of the grid table.
Axes = Callable[[object], tuple[np.ndarray, np.ndarray]]

_PIECE = ("raster_id string, tile_row int, tile_col int, y0 int, x0 int, h int, w int, raster_h int, raster_w int, "
          "n_bands int, data binary")


def mercator_axes(g) -> tuple[np.ndarray, np.ndarray]:
    """From a Web Mercator raster to a degree grid of the same size over the same bounds, in whole source pixels."""
    def lat(y: float) -> float:
        return np.degrees(2.0 * np.arctan(np.exp(y / MERCATOR_HALF * np.pi)) - np.pi / 2)

    west, east = g.west / MERCATOR_HALF * 180.0, (g.west + g.width * g.xres) / MERCATOR_HALF * 180.0
    north, south = lat(g.north), lat(g.north - g.height * g.yres)
    lon = west + (np.arange(g.width) + 0.5) * ((east - west) / g.width)
    lats = north - (np.arange(g.height) + 0.5) * ((north - south) / g.height)
    x, y = lon * MERCATOR_HALF / 180.0, np.log(np.tan((90.0 + lats) * np.pi / 360.0)) * (MERCATOR_HALF / np.pi)
    return np.floor((g.north - y) / g.yres), np.floor((x - g.west) / g.xres)


class _Maps:
    """The axes of the raster in hand; tiles of one raster mostly come together."""

    def __init__(self, axes: Axes):
        self.axes, self.raster, self.found = axes, None, None

    def of(self, t) -> tuple[np.ndarray, np.ndarray]:
        if self.raster != t.raster_id:
            rows, cols = (np.asarray(a, dtype=np.float64) for a in self.axes(t))
            if (np.diff(rows) < 0).any() or (np.diff(cols) < 0).any():
                raise ValueError(f"positions of {t.raster_id} run backwards")
            self.raster, self.found = t.raster_id, (rows, cols)
        return self.found


def _fed(at: np.ndarray, first: int, n: int) -> tuple[int, int]:
    """The target places whose source place is one of n from ``first``."""
    return int(np.searchsorted(at, first, "left")), int(np.searchsorted(at, first + n, "left"))


def _pieces(t, block: np.ndarray, y: int, x: int, height: int, width: int, tile: int) -> Iterator[tuple]:
    """A block of the target from row y and column x, split at the borders of its tiles."""
    y1, x1 = y + block.shape[1], x + block.shape[2]
    for ty in range(y // tile, (y1 - 1) // tile + 1):
        for tx in range(x // tile, (x1 - 1) // tile + 1):
            a, b, c, d = max(y, ty * tile), min(y1, (ty + 1) * tile), max(x, tx * tile), min(x1, (tx + 1) * tile)
            part = np.ascontiguousarray(block[:, a - y:b - y, c - x:d - x])
            yield t.raster_id, ty, tx, a, c, b - a, d - c, height, width, len(block), part.tobytes()


def _pasted(pieces: DataFrame, tile: int, dtype: type, blank: float) -> DataFrame:
    def paste(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rid, tr, tc = key
        p = pdf.iloc[0]
        r0, c0 = int(tr) * tile, int(tc) * tile
        h, w = min(tile, p.raster_h - r0), min(tile, p.raster_w - c0)
        out = np.full((p.n_bands, h, w), blank, dtype=dtype)
        for t in pdf.itertuples(index=False):
            part = np.frombuffer(t.data, dtype=dtype).reshape(t.n_bands, t.h, t.w)
            out[:, t.y0 - r0:t.y0 - r0 + t.h, t.x0 - c0:t.x0 - c0 + t.w] = part
        return pd.DataFrame([(rid, tr, tc, r0, c0, h, w, p.raster_h, p.raster_w, p.n_bands, out.tobytes())], columns=TILE_COLUMNS)

    return spread(pieces, TILE_KEYS).groupBy(*TILE_KEYS).applyInPandas(paste, TILE)


def nearest_tiles(tiles: DataFrame, grids: DataFrame, axes: Axes, tile: int) -> DataFrame:
    """Target tiles with the source pixel under each target centre; a last band is 255 where there is one, else 0.

    ``grids`` has one row per raster (``raster_id``) with what ``axes`` reads; rasters without one give nothing.
    ``axes`` gives whole source rows and columns, those outside the source included.
    """
    held = attach_by(tiles, grids.withColumn("_grid", F.lit(True)), ["raster_id"]).filter("_grid")
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = _Maps(axes)
        for pdf in frames:
            out = []
            for t in pdf.itertuples(index=False):
                rows, cols = maps.of(t)
                (y, y1), (x, x1) = _fed(rows, t.row0, t.h), _fed(cols, t.col0, t.w)
                if y1 > y and x1 > x:
                    at = np.ix_((rows[y:y1] - t.row0).astype(int), (cols[x:x1] - t.col0).astype(int))
                    part = np.stack([*(band[at] for band in block_of(t)), np.full((y1 - y, x1 - x), 255, dtype=np.uint8)])
                    out.extend(_pieces(t, part, y, x, len(rows), len(cols), tile))
            yield pd.DataFrame(out, columns=names)

    return _pasted(held.mapInPandas(cut, _PIECE), tile, np.uint8, 0)


def bilinear_tiles(tiles: DataFrame, grids: DataFrame, axes: Axes, source_tile: int, tile: int) -> DataFrame:
    """Target tiles of doubles, the mean of four neighbours by weight; not a number where there is none.

    ``axes`` gives source positions in units of pixel centres; positions beyond the edge read the edge.
    A tile computes the target pixels whose upper left neighbour lies in it, from a border of one pixel that
    its neighbours send. Pixels of tiles that are not there have no weight, and what would start in one is blank.
    """
    marked = F.concat(F.col("data"), F.expr("cast(repeat('~', h * w) as binary)"))
    padded = padded_tiles(tiles.withColumn("data", marked).withColumn("n_bands", F.col("n_bands") + 1), 1, source_tile)
    held = attach_by(padded, grids.withColumn("_grid", F.lit(True)), ["raster_id"]).filter("_grid")
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def neighbours(at: np.ndarray, n: int, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
        low = np.floor(at)
        return [((np.clip(low + d, 0, n - 1) - first).astype(int), 1.0 - np.abs(at - low - d)) for d in (0, 1)]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = _Maps(axes)
        for pdf in frames:
            out = []
            for t in pdf.itertuples(index=False):
                rows, cols = maps.of(t)
                (y, y1), (x, x1) = (_fed(np.clip(np.floor(a), 0, n - 1), first, k) for a, n, first, k in (
                    (rows, t.raster_h, t.row0, t.h), (cols, t.raster_w, t.col0, t.w)))
                if y1 <= y or x1 <= x:
                    continue
                canvas = np.frombuffer(t.data, dtype=np.uint8).reshape(t.n_bands, t.pad_h, t.pad_w)
                there, total, weight = canvas[-1] > 0, 0.0, 0.0
                for r, wr in neighbours(rows[y:y1], t.raster_h, t.y0):
                    for c, wc in neighbours(cols[x:x1], t.raster_w, t.x0):
                        w = wr[:, None] * wc[None, :] * there[np.ix_(r, c)]
                        total = total + w * canvas[:-1][:, r[:, None], c[None, :]]
                        weight = weight + w
                part = np.divide(total, weight, out=np.full(total.shape, np.nan), where=np.broadcast_to(weight > 0, total.shape))
                out.extend(_pieces(t, part, y, x, len(rows), len(cols), tile))
            yield pd.DataFrame(out, columns=names)

    return _pasted(held.mapInPandas(cut, _PIECE), tile, np.float64, np.nan)


def value_pixels(tiles: DataFrame, names: list[str]) -> DataFrame:
    """Pixel rows of tiles of doubles, without blank ones."""
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.data, dtype=np.float64).reshape(t.n_bands, t.h, t.w)
                r, c = np.nonzero(~np.isnan(a).any(axis=0))
                yield pd.DataFrame({"raster_id": t.raster_id, "row": r + t.row0, "col": c + t.col0,
                                    **{n: a[i][r, c] for i, n in enumerate(names)}})

    return tiles.mapInPandas(unpack, "raster_id string, row int, col int, " + ", ".join(f"{n} double" for n in names))
