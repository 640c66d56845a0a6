"""Resampling onto a target grid and the priority composite."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, geo
from ..functions.predicates import is_covered
from ..schema import TILE, TILE_KEYS
from ..session import cut_lineage
from .stats import attach_by, join_large, ordered_index
from .tiles import TILE_COLUMNS, block_of


def composite_order(sources: DataFrame) -> DataFrame:
    """Number sources so the highest value wins: lowest priority number, then last path."""
    return ordered_index(sources, [F.col("priority").desc(), F.col("path").asc()], "ord")


def priority_composite(px: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last-wins merge of source pixels (``r, g, b``) that cover the same cell.

    Order and colour are packed into one long, so the merge is a plain ``max``
    that combines before the shuffle and never sorts the pixels of a cell.
    ``order`` is a non-negative integer, higher wins.
    """
    packed = F.shiftleft(order.cast("long"), 24) + color.pack_rgb("r", "g", "b").cast("long")
    best = px.filter(is_covered()).groupBy(*keys).agg(F.max(packed).alias("_p"))
    r, g, b = color.unpack_rgb(F.col("_p").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    return best.select(*keys, r.alias("r"), g.alias("g"), b.alias("b"),
                       F.shiftright(F.col("_p"), 24).alias("ord"))


def composite_tiles(tiles: DataFrame, tile: int, salts: int = 16) -> DataFrame:
    """Last-wins merge of RGB byte tiles on one grid; ``ord`` numbers the sources.

    A block may cover only part of its grid cell of side ``tile``; the result
    covers whole cells, black where no source does.

    A cell of the grid may hold a third of all sources: tiles are merged per
    salt first, then across salts, and each merge reads its group as a stream
    that keeps only one canvas.
    """
    partial_schema = TILE + ", ords binary"

    def merge(key, batches, ranks_of):
        rank = rgb = last = None
        r0, c0 = int(key[1]) * tile, int(key[2]) * tile
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                if rank is None:
                    h, w = min(tile, t.raster_h - r0), min(tile, t.raster_w - c0)
                    rank, rgb, last = np.full((h, w), -1, dtype=np.int32), np.zeros((3, h, w), dtype=np.uint8), t
                block = block_of(t)[:3]
                here = np.s_[t.row0 - r0:t.row0 - r0 + t.h, t.col0 - c0:t.col0 - c0 + t.w]
                theirs = ranks_of(t, block)
                wins = theirs > rank[here]
                np.copyto(rank[here], theirs, where=wins)
                np.copyto(rgb[:, *here], block, where=wins)
        if rank is not None:
            row = (key[0], key[1], key[2], r0, c0, *rank.shape, last.raster_h, last.raster_w, 3,
                   rgb.tobytes(), rank.tobytes())
            yield pd.DataFrame([row], columns=[*TILE_COLUMNS, "ords"])

    def first(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def covered(t, block):
            bright = block[0].astype(np.uint16) + block[1] + block[2] >= 24
            return np.where(bright, np.int32(t.ord), np.int32(-1))

        return merge(key, batches, covered)

    def second(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return merge(key, batches, lambda t, b: np.frombuffer(t.ords, dtype=np.int32).reshape(t.h, t.w))

    keys = ["raster_id", "tile_row", "tile_col"]
    if salts <= 1:
        return tiles.groupBy(*keys).applyInPandas(first, partial_schema).drop("ords")
    salted = tiles.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "_salt").applyInPandas(first, partial_schema)
    return partial.groupBy(*keys).applyInPandas(second, partial_schema).drop("ords")


#: Grid cells whose coverage is sent to all tasks at most, some 40 bytes each.
FEW_CELLS = 1_000_000


def coverage_of(tiles: DataFrame, tile: int) -> DataFrame:
    """Per grid cell with any coverage: the best source that covers all of it (``top``, else null) and the number of visible tiles.

    Reads the narrow columns only: ``cover`` and ``ord`` with the tiles' places.
    """
    whole = (F.col("cover") == 2) & (F.col("row0") == F.col("tile_row") * tile) & (F.col("col0") == F.col("tile_col") * tile) & (
        F.col("h") == F.least(F.lit(tile), F.col("raster_h") - F.col("row0"))) & (
        F.col("w") == F.least(F.lit(tile), F.col("raster_w") - F.col("col0")))
    # cells repeat over sources: counts by order are bounded by the tiles of a cell, which are not collected
    seen = tiles.filter("cover > 0").select(*TILE_KEYS, "ord", whole.alias("whole"))
    top = seen.groupBy(*TILE_KEYS).agg(F.max(F.when(F.col("whole"), F.col("ord"))).alias("top"))
    visible = seen.join(top, TILE_KEYS).filter(F.col("top").isNull() | (F.col("ord") >= F.col("top")))
    return visible.groupBy(*TILE_KEYS).agg(F.first("top").alias("top"), F.count("*").alias("n"))


def composite_visible(tiles: DataFrame, tile: int, salts: int = 16) -> DataFrame:
    """As ``composite_tiles`` over stored tiles with ``cover``: hidden tiles are dropped before any of their bytes move.

    A tile is hidden where a better source covers its whole grid cell, or where it covers nothing. A cell with one visible
    tile is finished where that tile lies. Only cells with several visible tiles are shuffled.
    """
    cells = cut_lineage(coverage_of(tiles, tile))
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    held = tiles.filter("cover > 0").join(F.broadcast(cells) if few else cells, TILE_KEYS).filter(
        F.col("top").isNull() | (F.col("ord") >= F.col("top")))

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t in pdf.itertuples(index=False):
                r0, c0 = t.tile_row * tile, t.tile_col * tile
                rgb = np.zeros((3, min(tile, t.raster_h - r0), min(tile, t.raster_w - c0)), dtype=np.uint8)
                block = block_of(t)[:3]
                bright = block.sum(axis=0, dtype=np.int32) >= 24
                np.copyto(rgb[:, t.row0 - r0:t.row0 - r0 + t.h, t.col0 - c0:t.col0 - c0 + t.w], block, where=bright)
                rows.append((t.raster_id, t.tile_row, t.tile_col, r0, c0, *rgb.shape[1:], t.raster_h, t.raster_w, 3, rgb.tobytes()))
            yield pd.DataFrame(rows, columns=TILE_COLUMNS)

    single = held.filter("n = 1").select(TILE_COLUMNS).mapInPandas(alone, TILE)
    several = held.filter("n > 1").select(*TILE_COLUMNS, "ord")
    return single.unionByName(composite_tiles(several, tile, salts))


def _reduce(block: np.ndarray, axis: int, start: int, ratio: float, offset: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Sums over target cells along one axis: first cell, sums and covered lengths.

    Whole source cells are added per target cell; cells cut by a border are
    shared by their two targets.
    """
    n = block.shape[axis]
    first = int(np.floor(start / ratio + offset + 1e-9))
    last = int(np.ceil((start + n) / ratio + offset - 1e-9))
    u = np.clip((np.arange(first, last + 1) - offset) * ratio - start, 0.0, n)
    low = np.floor(u + 1e-9).astype(np.int64)
    cut = np.clip(u - low, 0.0, 1.0)
    shape = list(block.shape)
    shape[axis] += 1  # one empty cell, so the far border has an index
    full = np.zeros(shape, dtype=np.float32)
    full[tuple(slice(0, k) for k in block.shape)] = block
    along = [1, 1, 1]
    along[axis] = -1
    sums = np.add.reduceat(full, low, axis=axis)
    sums = np.delete(sums, -1, axis=axis) * (np.diff(low) > 0).reshape(along)
    if (cut > 1e-9).any():
        edge = np.take(full, low, axis=axis) * cut.reshape(along).astype(np.float32)
        sums = sums + np.diff(edge, axis=axis)
    return first, sums, np.diff(u)


def resample_tiles(tiles: DataFrame, placement: DataFrame, width: int, height: int, tile: int,
                   target_id: str = "cell") -> DataFrame:
    """Area-average RGB byte tiles onto a shared grid; one byte tile per source and target tile, with ``ord``.

    ``placement`` has ``raster_id, ord, rx, ry, ox, oy`` as in ``area_average``.
    Each stored tile is reduced where it lies; only weighted sums on the target
    grid are shuffled and added up.
    """
    held = attach_by(tiles, placement, ["raster_id"]).filter(F.col("ord").isNotNull())
    schema = "tile_row int, tile_col int, ord long, y0 int, x0 int, h int, w int, data binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t in pdf.itertuples(index=False):
                y, part, wy = _reduce(block_of(t)[:3], 1, t.row0, t.ry, t.oy)
                x, part, wx = _reduce(part, 2, t.col0, t.rx, t.ox)
                part = part.astype(np.float32, copy=False)
                y1, x1 = min(y + part.shape[1], height), min(x + part.shape[2], width)
                for ty in range(max(y, 0) // tile, (y1 - 1) // tile + 1):
                    for tx in range(max(x, 0) // tile, (x1 - 1) // tile + 1):
                        a, b = max(y, ty * tile, 0), min(y1, (ty + 1) * tile)
                        c, d = max(x, tx * tile, 0), min(x1, (tx + 1) * tile)
                        if b > a and d > c:
                            data = b"".join((wy[a - y:b - y].astype(np.float32).tobytes(),
                                             wx[c - x:d - x].astype(np.float32).tobytes(),
                                             np.ascontiguousarray(part[:, a - y:b - y, c - x:d - x]).tobytes()))
                            rows.append((ty, tx, t.ord, a, c, b - a, d - c, data))
            yield pd.DataFrame(rows, columns=names)

    def add_up(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ty, tx, rank = (int(k) for k in key)
        r0, c0 = ty * tile, tx * tile
        h, w = min(tile, height - r0), min(tile, width - c0)
        total = np.zeros((4, h, w), dtype=np.float32)
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                flat = np.frombuffer(t.data, dtype=np.float32)
                wy, wx = flat[:t.h], flat[t.h:t.h + t.w]
                here = np.s_[t.y0 - r0:t.y0 - r0 + t.h, t.x0 - c0:t.x0 - c0 + t.w]
                total[:3, *here] += flat[t.h + t.w:].reshape(3, t.h, t.w)
                total[3][here] += wy[:, None] * wx
        # only the covered part of the cell goes on
        rows, cols = np.flatnonzero(total[3].any(axis=1)), np.flatnonzero(total[3].any(axis=0))
        if not len(rows):
            return
        y0, x0 = rows[0], cols[0]
        total = total[:, y0:rows[-1] + 1, x0:cols[-1] + 1]
        weight = np.where(total[3] > 1e-6, total[3], np.inf)
        rgb = np.floor(total[:3] / weight + 0.5).astype(np.uint8)
        row = (target_id, ty, tx, r0 + y0, c0 + x0, *rgb.shape[1:], height, width, 3, rgb.tobytes(), rank)
        yield pd.DataFrame([row], columns=[*TILE_COLUMNS, "ord"])

    sums = held.mapInPandas(project, schema)
    return sums.groupBy("tile_row", "tile_col", "ord").applyInPandas(add_up, TILE + ", ord long")


def area_average(px: DataFrame, bands: list[str], ratio_x: Column, ratio_y: Column, keys: list[str],
                 offset_x: Column | None = None, offset_y: Column | None = None) -> DataFrame:
    """Area-weighted mean of source pixels on a coarser grid.

    ``ratio`` is source pixels per target pixel; ``offset`` moves the source
    origin, in target pixels. Each source pixel meets at most four targets.
    """
    ox = offset_x if offset_x is not None else F.lit(0.0)
    oy = offset_y if offset_y is not None else F.lit(0.0)
    eps = F.lit(1e-9)
    out = px.withColumn("_x0", F.col("col") / ratio_x + ox).withColumn("_x1", (F.col("col") + 1) / ratio_x + ox)
    out = out.withColumn("_y0", F.col("row") / ratio_y + oy).withColumn("_y1", (F.col("row") + 1) / ratio_y + oy)
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) + eps).cast("int"),
                                              (F.ceil(F.col(b) - eps) - 1).cast("int")))
    out = out.withColumn("_tx", cells("_x0", "_x1")).withColumn("_ty", cells("_y0", "_y1"))
    share = lambda a, b, t: F.least(F.col(b), F.col(t) + 1) - F.greatest(F.col(a), F.col(t))
    out = out.withColumn("_w", share("_x0", "_x1", "_tx") * share("_y0", "_y1", "_ty"))
    return out.groupBy(*keys, F.col("_ty").alias("row"), F.col("_tx").alias("col")).agg(
        *[(F.sum(F.col("_w") * F.col(b)) / F.sum("_w")).alias(b) for b in bands])


def target_pixels(rasters: DataFrame, keep: list[str]) -> DataFrame:
    """One row per pixel of each raster (``height``, ``width``): rows, a spread, then columns."""
    rows = rasters.select(*keep, "height", "width", F.explode(F.expr("sequence(0, height - 1)")).alias("row"))
    return rows.repartition("row").select(*keep, "row", F.explode(F.expr("sequence(0, width - 1)")).alias("col"))


def nearest_reproject(px: DataFrame, targets: DataFrame, src_row: Column, src_col: Column,
                      bands: list[str]) -> DataFrame:
    """Value of the source pixel under each target centre; nothing outside the source."""
    want = targets.withColumn("_sr", src_row.cast("int")).withColumn("_sc", src_col.cast("int"))
    src = px.select(F.col("raster_id").alias("_rid"), F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    on = (want["raster_id"] == src["_rid"]) & (want["_sr"] == src["_r"]) & (want["_sc"] == src["_c"])
    return join_large(want, src, on).select("raster_id", "row", "col", *bands)


def mercator_to_degrees(px: DataFrame, rasters: DataFrame, bands: list[str]) -> DataFrame:
    """Nearest reprojection of 3857 rasters to a degree grid of the same size."""
    lo = geo.bounds_wgs84("epsg", geo.bounds("west", "north", "xres", "yres", "width", "height"))
    dim = rasters.withColumn("_b", lo)
    dim = dim.withColumn("dx", (F.col("_b.east") - F.col("_b.west")) / F.col("width")).withColumn(
        "dy", (F.col("_b.north") - F.col("_b.south")) / F.col("height"))
    keep = ["raster_id", "west", "north", "xres", "yres", "_b", "dx", "dy", "epsg"]
    t = target_pixels(dim, keep)
    lon = F.col("_b.west") + (F.col("col") + 0.5) * F.col("dx")
    lat = F.col("_b.north") - (F.col("row") + 0.5) * F.col("dy")
    merc = F.col("epsg") == 3857
    x = F.when(merc, geo.mercator_x(lon)).otherwise(lon)
    y = F.when(merc, geo.mercator_y(lat)).otherwise(lat)
    sc, sr = geo.geo_to_pixel("west", "north", "xres", "yres", x, y)
    return nearest_reproject(px, t, sr, sc, bands)


def bilinear(px: DataFrame, targets: DataFrame, u: Column, v: Column, height: Column, width: Column,
             bands: list[str]) -> DataFrame:
    """Four-neighbour weighted sample at source position ``(u, v)`` in pixel-centre units."""
    t = targets.withColumn("_u", u).withColumn("_v", v)
    corner = lambda d, e: F.struct(
        F.greatest(F.lit(0), F.least(F.floor(F.col("_v")).cast("int") + d, height - 1)).alias("r"),
        F.greatest(F.lit(0), F.least(F.floor(F.col("_u")).cast("int") + e, width - 1)).alias("c"),
        ((F.lit(1.0) - F.abs(F.col("_v") - F.floor(F.col("_v")) - d))
         * (F.lit(1.0) - F.abs(F.col("_u") - F.floor(F.col("_u")) - e))).alias("w"))
    t = t.withColumn("_n", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))))
    t = t.filter(F.col("_n.w") > 0)
    src = px.select(F.col("raster_id").alias("_rid"), F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    on = (t["raster_id"] == src["_rid"]) & (t["_n.r"] == src["_r"]) & (t["_n.c"] == src["_c"])
    return join_large(t, src, on).groupBy("raster_id", "row", "col").agg(
        *[(F.sum(F.col("_n.w") * F.col(b)) / F.sum("_n.w")).alias(b) for b in bands])


def missing_fraction(covered: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    w = width if isinstance(width, Column) else F.lit(width)
    h = height if isinstance(height, Column) else F.lit(height)
    return covered.agg((F.lit(1.0) - F.count("*") / (w * h)).alias("missing_fraction"))


def tile_jobs(tiles: DataFrame, existing: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every tile: ``skip`` when it exists, else ``write`` or ``empty``."""
    done = existing.select(*keys).distinct().withColumn("_done", F.lit(True))
    full = covered.groupBy(*keys).agg(F.count("*").alias("_px"))
    return tiles.join(done, keys, "left").join(full, keys, "left").withColumn(
        "status", F.when(F.col("_done"), "skip").when(F.col("_px") > 0, "write").otherwise("empty")).withColumn(
        "covered_px", F.coalesce("_px", F.lit(0))).drop("_done", "_px")


def grid_signature(sources: DataFrame, geometry: str) -> DataFrame:
    """Identity of a grid and its source set: sums of row digests, so no list is built."""
    line = F.concat_ws("|", "path", "size", "mtime", "priority")
    digest = F.md5(line)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return sources.agg(F.count("*").alias("n"), F.sum(part(1)).alias("s1"), F.sum(part(9)).alias("s2")).select(
        F.md5(F.concat_ws("|", F.lit(geometry), "n", "s1", "s2")).alias("signature"), F.col("n").alias("n_sources"))
