"""One stored table of the tiles of all rasters, laid out so that a window reads few files and row groups.

Tiles are range-partitioned and sorted by raster and the Z-order of their position, so neighbours lie together
in both directions, whatever the number of rasters; files are of about equal size and none is per raster or per task. The least and
the last row and column of a tile are columns of their own, so a window is plain comparisons that file statistics
can answer. ``cover`` says whether a tile holds nothing (0), something (1) or only covered pixels (2).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import TILE_COLUMNS, block_of
from ..schema import TILE
from ..session import cut_lineage

STORED = TILE + ", row1 int, col1 int, cover int"
STORED_COLUMNS = [f.split()[0] for f in STORED.split(", ")]
NONE, PART, FULL = 0, 1, 2
#: Tiles of a row group, the least that a window reads of a file.
GROUP_ROWS = 32
#: Bytes and row groups of a file at most, about: whoever reads a part of a file reads the list of all its groups.
FILE_BYTES, FILE_GROUPS = 64 << 20, 128


def z_order(row: Column, col: Column, bits: int = 20) -> Column:
    """The bits of row and column in turn, as one long; positions beyond 2 ** bits share the order of their low bits."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        one = lambda c, i=i: F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(one(col), 2 * i)).bitwiseOR(F.shiftleft(one(row), 2 * i + 1))
    return out


def with_cover(tiles: DataFrame) -> DataFrame:
    """Tiles with their last row and column, and how much of them is covered; other columns stay."""
    more = [c for c in tiles.columns if c not in STORED_COLUMNS]
    types = dict(tiles.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cover = []
            for t in pdf.itertuples(index=False):
                bright = block_of(t)[:3].sum(axis=0, dtype="int32") >= 24
                cover.append(FULL if bright.all() else PART if bright.any() else NONE)
            pdf = pdf.assign(row1=pdf.row0 + pdf.h - 1, col1=pdf.col0 + pdf.w - 1, cover=cover)
            yield pdf[[*STORED_COLUMNS, *more]]

    return tiles.select(*TILE_COLUMNS, *more).mapInPandas(run, STORED + "".join(f", {c} {types[c]}" for c in more))


def write(tiles: DataFrame, path: str, files: int | None = None, group_rows: int = GROUP_ROWS, mode: str = "error") -> None:
    """Writes tiles to a new table in Z-order, at least ``files`` files (the session's shuffle partitions if not said).

    There are more as soon as these would be large, so that neither a task nor a file grows with the table.
    """
    # fixed, because the bounds of the ranges take a pass of their own
    keyed = cut_lineage(with_cover(tiles).withColumn("_z", z_order(F.col("tile_row"), F.col("tile_col"))))
    keys = ["raster_id", "_z"]
    n, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    least = files or int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = max(-(-size // FILE_BYTES), -(-n // (FILE_GROUPS * group_rows)))
    dealt = keyed.repartitionByRange(max(least, needed), *keys) if files or needed > least else keyed.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).drop("_z").write.mode(mode).option("parquet.block.row.count.limit", group_rows).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window(stored: DataFrame, raster_id: str | None, row: int, col: int, h: int, w: int) -> DataFrame:
    """Stored tiles that meet a pixel window (of one raster, or of all); every comparison reaches the scan."""
    out = stored if raster_id is None else stored.filter(F.col("raster_id") == raster_id)
    return out.filter((F.col("row0") < row + h) & (F.col("row1") >= row) & (F.col("col0") < col + w) & (F.col("col1") >= col))
