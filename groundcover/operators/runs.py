"""Masks as run-length tables: one row per run of set pixels in a raster row, ``row, c0, c1`` (both ends inside).

Runs end at tile borders, so a tile's runs are labelled in one task from the overlaps of intervals in neighbouring
rows. Runs that meet across a border are edges of a small graph, which ``contract`` reduces; areas, boxes, vetoes,
holes and hulls follow from runs. A pixel is never a row: a filled tile of 512 by 512 is 512 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TILE, TILE_KEYS
from ..session import cut_lineage
from .components import contract
from .tiles import TILE_COLUMNS, block_of, column, spread

RUN = "raster_id string, tile_row int, tile_col int, row int, c0 int, c1 int, value int"
RUN_COLUMNS = [f.split()[0] for f in RUN.split(", ")]


def _node(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return (row.astype(np.int64) << 31) + col


def find_runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of equal non-zero values, in row-major order."""
    wide = np.zeros((a.shape[0], a.shape[1] + 2), dtype=np.int16)
    wide[:, 1:-1] = a
    differ = wide[:, 1:] != wide[:, :-1]
    row, c0 = np.nonzero(differ & (wide[:, 1:] > 0))
    return row, c0, np.nonzero(differ & (wide[:, :-1] > 0))[1] - 1


def tile_runs(tiles: DataFrame, carry: tuple[str, ...] = (), blank: bool = False) -> DataFrame:
    """Runs of equal non-zero values of the first band (with ``blank`` of its zeros); every tile is on its own."""
    types = dict(tiles.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                a = block_of(t)[0]
                a = a == 0 if blank else a
                row, c0, c1 = find_runs(a)
                out = pd.DataFrame({"row": row + t.row0, "c0": c0 + t.col0, "c1": c1 + t.col0, "value": a[row, c0]}).astype(np.int32)
                for c in ("raster_id", "tile_row", "tile_col", *carry):
                    out[c] = getattr(t, c)
                yield out[[*RUN_COLUMNS, *carry]]

    return tiles.mapInPandas(run, RUN + "".join(f", {c} {types[c]}" for c in carry))


def run_pixels(runs: DataFrame, *more: str) -> DataFrame:
    """Pixels of runs, for results that ask for them."""
    return runs.select("raster_id", *more, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _tile_nodes(row: np.ndarray, c0: np.ndarray, c1: np.ndarray, connectivity: int) -> np.ndarray:
    """Place of the first run of each run's component, from runs of one tile in row-major order."""
    reach = 1 if connectivity == 8 else 0
    first = c0.min() - 1
    wide = np.int64(c1.max() - first + 3)
    r = (row - row.min()).astype(np.int64) + 1
    starts, ends = r * wide + (c0 - first), r * wide + (c1 - first)
    lo = np.searchsorted(ends, starts + wide - reach, "left")
    hi = np.searchsorted(starts, ends + wide + reach, "right")
    n = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(len(row)), n)
    v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = np.arange(len(row))
    while True:
        ru, rv = root[u], root[v]
        differ = ru != rv
        if not differ.any():
            return root
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]


def label_runs(runs: DataFrame, tile: int, connectivity: int = 8, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Runs with ``node``, the first position of their component in the tile, and ``comp``, that in the whole raster."""
    by = list(by)
    schema = ", ".join(f"{c} {t}" for c, t in runs.dtypes) + ", node long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("c0", "ascending")])
        row, c0, c1 = (column(table, c) for c in ("row", "c0", "c1"))
        root = _tile_nodes(row, c0, c1, connectivity)
        return table.append_column("node", pa.array(_node(row[root], c0[root])))

    keys = [*by, "tile_row", "tile_col"]
    inside = cut_lineage(spread(runs, keys).groupBy(*keys).applyInArrow(run, schema))
    roots = contract(_meetings(inside, tile, connectivity, by), by)
    out = inside.join(roots, [*by, "node"], "left")
    return out.select(*inside.columns, F.coalesce("root", "node").alias("comp"))


def _meetings(runs: DataFrame, tile: int, connectivity: int, by: list[str]) -> DataFrame:
    """Pairs of tile components that touch across a border."""
    near = [-1, 0, 1] if connectivity == 8 else [0]
    ends = runs.filter(F.pmod(F.col("c1") + 1, F.lit(tile)) == 0).select(
        *by, (F.col("c1") + 1).alias("c0"), F.col("node").alias("u"), F.explode(F.array(*[F.col("row") + d for d in near])).alias("row"))
    begins = runs.filter(F.pmod("c0", F.lit(tile)) == 0).select(*by, "row", "c0", F.col("node").alias("v"))
    sideways = ends.join(begins, [*by, "row", "c0"]).select(*by, "u", "v")
    reach = 1 if connectivity == 8 else 0
    above = runs.filter(F.pmod("row", F.lit(tile)) == tile - 1).select(
        *by, "tile_col", (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("node").alias("u"))
    below = runs.filter(F.pmod("row", F.lit(tile)) == 0).select(*by, "tile_col", "row", "c0", "c1", F.col("node").alias("v"))
    # both sides of a join key are at most half a tile's columns
    down = above.join(below, [*by, "tile_col", "row"]).filter(
        (F.col("c0") <= F.col("a1") + reach) & (F.col("c1") >= F.col("a0") - reach)).select(*by, "u", "v")
    return sideways.unionByName(down).distinct()


def run_stats(labels: DataFrame, by: tuple[str, ...] = ("raster_id",), extra: list[Column] | None = None) -> DataFrame:
    """Area, box, aspect and fill of every component; sums combine before they are shuffled."""
    width = (F.col("c1") - F.col("c0") + 1).cast("long")
    return labels.groupBy(*by, "comp").agg(
        F.sum(width).alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("c0").alias("col0"),
        F.max("c1").alias("col1"), *(extra or [])).withColumn(
        "bh", F.col("row1") - F.col("row0") + 1).withColumn("bw", F.col("col1") - F.col("col0") + 1).withColumn(
        "aspect", F.greatest("bh", "bw") / F.least("bh", "bw")).withColumn("fill", F.col("area") / (F.col("bh") * F.col("bw")))


def runs_of(labels: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Runs of the wanted components, matched by their parts in tiles, so that no component is a hot key."""
    parts = labels.select(*by, "comp", "node").distinct()
    inside = parts.join(wanted.select(*by, "comp"), [*by, "comp"], "left_semi").select(*by, "node")
    return labels.join(inside, [*by, "node"], "left_semi").select(labels.columns)


def with_sums(runs: DataFrame, tiles: DataFrame, names: list[str], planes) -> DataFrame:
    """Adds to every run the sums of planes of its tile: ``planes(bands)`` gives one integer array per name.

    Runs meet their tile on its key, in one exchange; a run without a tile has zeros. Columns of the runs are kept.
    """
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in runs.columns) + "".join(f", {n} long" for n in names)

    def run(own: pa.Table, stored: pa.Table) -> pa.Table:
        sums = {n: np.zeros(own.num_rows, dtype=np.int64) for n in names}
        if stored.num_rows and own.num_rows:
            t = next(stored.to_pandas().itertuples(index=False))
            row, c0, c1 = column(own, "row") - t.row0, column(own, "c0") - t.col0, column(own, "c1") - t.col0
            for n, plane in zip(names, planes(block_of(t))):
                total = np.zeros((t.h, t.w + 1), dtype=np.int64)
                np.cumsum(plane, axis=1, out=total[:, 1:])
                sums[n] = total[row, c1 + 1] - total[row, c0]
        for n in names:
            own = own.append_column(n, pa.array(sums[n]))
        return own

    stored = spread(tiles.select(TILE_COLUMNS), TILE_KEYS)
    return spread(runs, TILE_KEYS).groupBy(*TILE_KEYS).cogroup(stored.groupBy(*TILE_KEYS)).applyInArrow(run, schema)


def hulls(labels: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Convex hull area of the pixels of each component; only the ends of runs can lie on it."""
    from .detect import solidity
    ends = labels.select(*by, "comp", "node", "row", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("col"))
    return solidity(ends, list(by))


def holes(blank: DataFrame, height: Column, width: Column, tile: int, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Runs of the background components that do not reach the raster's edge."""
    labels = label_runs(blank, tile, 4, by)
    inner = run_stats(labels, by).filter((F.col("row0") > 0) & (F.col("col0") > 0) & (F.col("row1") < height - 1) & (F.col("col1") < width - 1))
    return runs_of(labels, inner, by)


def painted_tiles(base: DataFrame, runs: DataFrame, order: str, value: str, everywhere: bool = False) -> DataFrame:
    """One-band tiles with runs painted on, the highest ``order`` on top; one exchange for all runs.

    Zero cells, which nothing covers, stay zero but with ``everywhere``.
    """
    def run(stored: pa.Table, own: pa.Table) -> pa.Table:
        if not stored.num_rows:
            return stored.select(TILE_COLUMNS)
        t = next(stored.to_pandas().itertuples(index=False))
        a = block_of(t)[0].copy()
        covered = a > 0
        if own.num_rows:
            own = own.sort_by([("_o", "ascending")])
            for r, c0, c1, v in zip(*(column(own, c).tolist() for c in ("row", "c0", "c1", "_v"))):
                a[r - t.row0, c0 - t.col0:c1 - t.col0 + 1] = v
        out = stored.to_pandas()[TILE_COLUMNS]
        out["data"] = [np.where(covered | everywhere, a, 0).astype(np.uint8).tobytes()]
        return pa.Table.from_pandas(out, preserve_index=False).cast(stored.select(TILE_COLUMNS).schema)

    rows = runs.select(*TILE_KEYS, "row", "c0", "c1", F.col(order).cast("int").alias("_o"), F.col(value).cast("int").alias("_v"))
    stored = spread(base.select(TILE_COLUMNS), TILE_KEYS)
    return stored.groupBy(*TILE_KEYS).cogroup(spread(rows, TILE_KEYS).groupBy(*TILE_KEYS)).applyInArrow(run, TILE)
