"""Tiles: windows, packing, and neighbourhood work with a halo.

A raster is never brought into one task. Neighbourhood operators run per tile;
each tile also receives the border pixels of its neighbours, so results do not
depend on the tiling. A task holds at most ``(tile + 2 * radius)`` squared cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TILE, TILE_KEYS
from .stats import attach_by


TILE_COLUMNS = [f.split()[0] for f in TILE.split(", ")]


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as a NumPy array."""
    return table.column(name).to_numpy()


def empty_frame(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys for work in Python: few bytes, much work, which by their number alone would be merged until one task has them all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tile_windows(rasters: DataFrame, size, overlap=0) -> DataFrame:
    """One row per window of every raster (columns ``height``, ``width``), row-major names.

    Rows and columns are expanded in two steps so a huge raster's windows are
    produced by many tasks when the plan shuffles in between.
    """
    size = size if isinstance(size, Column) else F.lit(size)
    step = F.greatest(F.lit(1), size - F.greatest(F.lit(0), F.lit(overlap) if isinstance(overlap, int) else overlap))
    out = rasters.withColumn("_size", size).withColumn("_step", step)
    out = out.withColumn("row0", F.explode(F.expr("sequence(0, height - 1, _step)")))
    out = out.withColumn("col0", F.explode(F.expr("sequence(0, width - 1, _step)")))
    return out.withColumn("h", F.least(F.col("_size"), F.col("height") - F.col("row0")).cast("int")).withColumn(
        "w", F.least(F.col("_size"), F.col("width") - F.col("col0")).cast("int")).drop("_size", "_step")


def read_write_windows(rasters: DataFrame, size: int, overlap: int) -> DataFrame:
    """Write windows without overlap, each with the larger window to read around it."""
    step, half = size - overlap, overlap // 2
    out = tile_windows(rasters, step)
    edge = lambda at, n, limit: F.least(F.col(at) + step + half, F.col(limit))
    return (out.withColumn("read_row0", F.greatest(F.col("row0") - half, F.lit(0)))
            .withColumn("read_col0", F.greatest(F.col("col0") - half, F.lit(0)))
            .withColumn("read_h", edge("row0", "h", "height") - F.col("read_row0"))
            .withColumn("read_w", edge("col0", "w", "width") - F.col("read_col0")))


def _reach(coord: str, radius: int, tile: int) -> Column:
    """Tiles whose padded window holds a coordinate."""
    at = F.col(coord)
    base, off = F.floor(at / tile).cast("int"), F.pmod(at, F.lit(tile))
    near = F.array(base, F.when(off < radius, base - 1), F.when(off >= tile - radius, base + 1))
    return F.filter(near, lambda t: t.isNotNull() & (t >= 0))


def focal_pixels(px: DataFrame, bands: list[str], radius: int, tile: int,
                 fn: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]],
                 out: dict[str, str], by: list[str] | None = None, carry: list[str] | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Run ``fn`` on padded tiles of a pixel table; one shuffle.

    ``fn(bands, present)`` returns arrays on the padded canvas; rows come back for
    the pixels that exist. ``by`` names the raster key, ``carry`` names columns
    that are constant per raster and are handed to ``fn`` as scalars. Columns in
    ``keep`` travel along unchanged, so the result needs no join back.
    """
    by, carry, keep = by or ["raster_id"], carry or [], keep or []
    if radius > tile:
        raise ValueError("radius must not exceed the tile side")
    # bands travel in their own type, once, also when they are kept
    sent = list(dict.fromkeys([*bands, *keep]))
    spread = (px.select(*by, *carry, "row", "col", *sent)
              .withColumn("_tr", F.explode(_reach("row", radius, tile)))
              .withColumn("_tc", F.explode(_reach("col", radius, tile))))

    types = dict(px.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["row int", "col int"] + [f"{c} {types[c]}" for c in keep]
                       + [f"{k} {v}" for k, v in out.items()])
    numpy_types = {"int": np.int32, "double": np.float64, "long": np.int64, "boolean": np.bool_}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = key[-2].as_py(), key[-1].as_py()
        row, col = column(table, "row"), column(table, "col")
        r0, c0 = row.min(), col.min()
        shape = (row.max() - r0 + 1, col.max() - c0 + 1)
        at = (row - r0, col - c0)
        present = np.zeros(shape, dtype=bool)
        present[at] = True
        arrays = {}
        for b in bands:
            a = np.zeros(shape)
            a[at] = column(table, b)
            arrays[b] = a
        for c in carry:
            arrays[c] = table.column(c)[0].as_py()
        core = ((row >= tr * tile) & (row < (tr + 1) * tile) & (col >= tc * tile) & (col < (tc + 1) * tile))
        n = int(core.sum())
        res = fn(arrays, present) if n else {}
        data = {c: pa.repeat(k, n) for c, k in zip(by, key)}
        data["row"], data["col"] = pa.array(row[core]), pa.array(col[core])
        mask = pa.array(core)
        for c in keep:
            data[c] = table.column(c).filter(mask)
        for name, kind in out.items():
            values = res[name][at][core] if n else np.empty(0)
            data[name] = pa.array(values.astype(numpy_types[kind]))
        return pa.table(data)

    return spread.groupBy(*by, "_tr", "_tc").applyInArrow(run, schema)


def pixels_to_tiles(px: DataFrame, bands: list[str], tile: int, dims: DataFrame) -> DataFrame:
    """Pack pixel rows into byte tiles. ``dims`` holds raster_id, raster_h, raster_w."""
    keyed = (attach_by(px.select("raster_id", "row", "col", *bands), dims, ["raster_id"])
             .withColumn("tile_row", F.floor(F.col("row") / tile).cast("int"))
             .withColumn("tile_col", F.floor(F.col("col") / tile).cast("int")))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        rid, tr, tc = (k.as_py() for k in key)
        rh, rw = table.column("raster_h")[0].as_py(), table.column("raster_w")[0].as_py()
        r0, c0 = tr * tile, tc * tile
        h, w = min(tile, rh - r0), min(tile, rw - c0)
        block = np.zeros((len(bands), h, w), dtype=np.uint8)
        at = (column(table, "row") - r0, column(table, "col") - c0)
        for i, b in enumerate(bands):
            block[i][at] = column(table, b)
        ints = dict(tile_row=tr, tile_col=tc, row0=r0, col0=c0, h=h, w=w, raster_h=rh, raster_w=rw, n_bands=len(bands))
        return pa.table({"raster_id": pa.array([rid], pa.string()),
                         **{k: pa.array([v], pa.int32()) for k, v in ints.items()},
                         "data": pa.array([block.tobytes()], pa.binary())})

    return keyed.groupBy(*TILE_KEYS).applyInArrow(pack, TILE)


def tiles_to_pixels(tiles: DataFrame, names: list[str], drop_blank: bool = False) -> DataFrame:
    """Unpack byte tiles to pixel rows; each tile is independent, so no shuffle."""
    schema = "raster_id string, row int, col int, " + ", ".join(f"{n} int" for n in names)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                a = block_of(t)
                rr, cc = np.divmod(np.arange(t.h * t.w), t.w)
                cols = {"raster_id": t.raster_id, "row": rr + t.row0, "col": cc + t.col0}
                for i, n in enumerate(names):
                    cols[n] = a[i].ravel().astype(np.int32)
                res = pd.DataFrame(cols)
                if drop_blank:
                    res = res[(res[names] != 0).any(axis=1)]
                yield res

    return tiles.mapInPandas(unpack, schema)


def block_of(t) -> np.ndarray:
    return np.frombuffer(t.data, dtype=np.uint8).reshape(t.n_bands, t.h, t.w)


def one_band(tiles: DataFrame, band: int) -> DataFrame:
    """Tiles of one band alone; its bytes are a slice, so nothing leaves the JVM."""
    data = F.expr(f"substring(data, {band} * h * w + 1, h * w)")
    return tiles.select(*[data.alias(c) if c == "data" else F.lit(1).alias(c) if c == "n_bands" else F.col(c) for c in TILE_COLUMNS])


def read_window(tiles: DataFrame, raster_id: str | None, row: int, col: int, h: int, w: int) -> DataFrame:
    """Tiles that meet a pixel window; the comparisons are pushed to the scan."""
    out = tiles if raster_id is None else tiles.filter(F.col("raster_id") == raster_id)
    return out.filter((F.col("row0") < row + h) & (F.col("row0") + F.col("h") > row)
                      & (F.col("col0") < col + w) & (F.col("col0") + F.col("w") > col))


_STRIP = TILE + ", dest_row int, dest_col int"


def focal_tiles(tiles: DataFrame, radius: int, tile: int,
                fn: Callable[[np.ndarray, dict], np.ndarray], attrs: list[str] | None = None) -> DataFrame:
    """Run ``fn(bands, info)`` on padded byte tiles and crop back; one shuffle.

    Every tile sends itself to its own key and only its border strips to the
    eight neighbours. ``fn`` returns ``(bands, h, w)`` bytes on the padded canvas.
    A missing neighbour (no coverage) reads as zero; beyond the raster edge there
    is no canvas, so edge rules stay with the kernel. ``attrs`` are extra columns
    handed to ``fn`` in ``info``.
    """
    attrs = attrs or []

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rid, tr, tc = key
        own = pdf[(pdf.tile_row == tr) & (pdf.tile_col == tc)]
        if own.empty:  # an uncovered tile has nothing to compute
            return empty_frame(TILE_COLUMNS)
        o = own.iloc[0]
        y0, x0, canvas = _canvas(pdf, o, tr, tc, radius, tile)
        info = {"row0": y0, "col0": x0, "raster_id": rid, **{a: o[a] for a in attrs}}
        res = np.asarray(fn(canvas, info), dtype=np.uint8)
        crop = res[:, o.row0 - y0:o.row0 - y0 + o.h, o.col0 - x0:o.col0 - x0 + o.w]
        return pd.DataFrame([(rid, tr, tc, o.row0, o.col0, o.h, o.w, o.raster_h, o.raster_w,
                              crop.shape[0], np.ascontiguousarray(crop).tobytes())],
                            columns=TILE_COLUMNS)

    keys = ["raster_id", "dest_row", "dest_col"]
    return spread(_sent_strips(tiles, radius, tile, attrs), keys).groupBy(*keys).applyInPandas(run, TILE)


#: A tile with the border its neighbours gave it: ``data`` is the canvas of ``pad_h`` times ``pad_w`` from ``y0, x0``.
PADDED = TILE + ", y0 int, x0 int, pad_h int, pad_w int"


def padded_tiles(tiles: DataFrame, radius: int, tile: int) -> DataFrame:
    """Tiles with their border, for passes that read the same neighbourhoods again and again; one shuffle."""
    names = [f.split()[0] for f in PADDED.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rid, tr, tc = key
        own = pdf[(pdf.tile_row == tr) & (pdf.tile_col == tc)]
        if own.empty:
            return empty_frame(names)
        o = own.iloc[0]
        y0, x0, canvas = _canvas(pdf, o, tr, tc, radius, tile)
        return pd.DataFrame([(rid, tr, tc, o.row0, o.col0, o.h, o.w, o.raster_h, o.raster_w, o.n_bands, canvas.tobytes(),
                              y0, x0, *canvas.shape[1:])], columns=names)

    keys = ["raster_id", "dest_row", "dest_col"]
    return spread(_sent_strips(tiles, radius, tile, []), keys).groupBy(*keys).applyInPandas(run, PADDED)


def _canvas(pdf: pd.DataFrame, own, tr: int, tc: int, radius: int, tile: int) -> tuple[int, int, np.ndarray]:
    """Where the padded canvas of a tile begins, and its bands."""
    y0, y1 = max(0, tr * tile - radius), min(own.raster_h, (tr + 1) * tile + radius)
    x0, x1 = max(0, tc * tile - radius), min(own.raster_w, (tc + 1) * tile + radius)
    canvas = np.zeros((own.n_bands, y1 - y0, x1 - x0), dtype=np.uint8)
    for t in pdf.itertuples(index=False):
        canvas[:, t.row0 - y0:t.row0 - y0 + t.h, t.col0 - x0:t.col0 - x0 + t.w] = block_of(t)
    return y0, x0, canvas


def _sent_strips(tiles: DataFrame, radius: int, tile: int, attrs: list[str]) -> DataFrame:
    """Every tile for its own key, and its border strips for its neighbours'."""
    types = dict(tiles.dtypes)
    schema = _STRIP + "".join(f", {a} {types[a]}" for a in attrs)
    names = [f.split()[0] for f in _STRIP.split(", ")] + attrs
    if radius > tile:
        raise ValueError("radius must not exceed the tile side")

    def strips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t in pdf.itertuples(index=False):
                a = block_of(t)
                extra = [getattr(t, x) for x in attrs]
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        tr, tc = t.tile_row + dr, t.tile_col + dc
                        if tr < 0 or tc < 0 or tr * tile >= t.raster_h or tc * tile >= t.raster_w:
                            continue
                        y0, y1 = max(t.row0, tr * tile - radius), min(t.row0 + t.h, (tr + 1) * tile + radius)
                        x0, x1 = max(t.col0, tc * tile - radius), min(t.col0 + t.w, (tc + 1) * tile + radius)
                        if y1 <= y0 or x1 <= x0:
                            continue
                        part = a[:, y0 - t.row0:y1 - t.row0, x0 - t.col0:x1 - t.col0]
                        rows.append((t.raster_id, t.tile_row, t.tile_col, y0, x0, y1 - y0, x1 - x0,
                                     t.raster_h, t.raster_w, t.n_bands, part.tobytes(), tr, tc, *extra))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return tiles.mapInPandas(strips, schema)
