"""The stored tile table and the composite of visible tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover.operators import composite, tiles
from groundcover.schema import TILE
from groundcover.sources import tile_store


def blocks(spark, arrays, side):
    """Tiles of (raster, bands, first row, first column, raster height, raster width) rows."""
    rows = []
    for name, a, y, x, h, w in arrays:
        rows.append((name, y // side, x // side, y, x, *a.shape[1:], h, w, a.shape[0], bytearray(a.astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, TILE)


def many(spark, rasters=6, side=8, n=16):
    rng = np.random.default_rng(1)
    return blocks(spark, [(f"r{k}", rng.integers(30, 200, (3, side, side)), i * side, j * side, n * side, n * side)
                          for k in range(rasters) for i in range(n) for j in range(n)], side)


def scanned(df) -> tuple[int, int]:
    """Files and rows that the scan of a finished query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    metric = lambda n: plan.metrics().apply(n).value()
    return metric("numFiles"), metric("numOutputRows")


def test_z_order_follows_both_axes(spark):
    got = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "r int, c int").withColumn(
        "z", tile_store.z_order(F.col("r"), F.col("c"))).orderBy("z").select("r", "c").collect()
    assert [tuple(x) for x in got[:8]] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def test_a_window_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "tiles")
    tile_store.write(many(spark), path, files=6, group_rows=16)
    stored = tile_store.read(spark, path)
    assert stored.count() == 6 * 256 and stored.select("cover").distinct().collect()[0][0] == tile_store.FULL
    near = tile_store.window(stored, "r3", 20, 20, 10, 10)
    files, rows = scanned(near.select("raster_id", "tile_row", "tile_col"))
    assert {(r.raster_id, r.tile_row, r.tile_col) for r in near.collect()} == {("r3", i, j) for i in (2, 3) for j in (2, 3)}
    assert rows <= 32 and files <= 6
    assert scanned(stored.select("raster_id"))[1] == 6 * 256


def test_cover_of_tiles(spark):
    dark, half = np.zeros((3, 4, 4)), np.full((3, 4, 4), 90)
    half[:, 0, 0] = 7
    got = tile_store.with_cover(blocks(spark, [("a", dark, 0, 0, 8, 8), ("b", half, 4, 0, 8, 8), ("c", half + 8, 4, 4, 8, 8)], 4))
    assert {r.raster_id: (r.cover, r.row1, r.col1) for r in got.collect()} == {"a": (0, 3, 3), "b": (1, 7, 3), "c": (2, 7, 7)}


def stack(spark, side=8):
    """Five sources over a grid of two by three cells: full, part, none, and blocks smaller than their cell."""
    rng = np.random.default_rng(2)
    arrays = []
    for ord_ in range(5):
        for i in range(2):
            for j in range(3):
                kind = (ord_ + 2 * i + j) % 4
                a = rng.integers(30, 200, (3, side, side))
                if kind == 1:
                    a[:, rng.random((side, side)) < 0.5] = 0
                if kind == 2:
                    a[:] = 3
                y = x = 0
                if kind == 3:
                    y, x = 2, 1
                    a = a[:, 2:6, 1:7]
                arrays.append((f"{ord_}", a, i * side + y, j * side + x, 2 * side, 3 * side))
    return blocks(spark, arrays, side)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_visible_composite_equals_the_whole(spark, monkeypatch, few):
    monkeypatch.setattr(composite, "FEW_CELLS", few)
    ranked = tile_store.with_cover(stack(spark)).withColumn("ord", F.col("raster_id").cast("int")).withColumn("raster_id", F.lit("cell"))
    key = lambda df: sorted((r.tile_row, r.tile_col, r.h, r.w, bytes(r.data)) for r in df.collect())
    got, want = key(composite.composite_visible(ranked, 8, 2)), key(composite.composite_tiles(ranked, 8, 2))
    assert [x for x in want if any(x[-1])] == got and len(got) == 6


def test_hidden_tiles_do_not_move(spark):
    """Ten full sources and one that covers a single cell in part: two tiles of 41 are merged."""
    rng = np.random.default_rng(3)
    arrays = [(f"{k}", rng.integers(30, 200, (3, 8, 8)), 0, 8 * j, 8, 32) for k in range(10) for j in range(4)]
    top = rng.integers(30, 200, (3, 8, 8))
    top[:, 0] = 0
    ranked = tile_store.with_cover(blocks(spark, [*arrays, ("10", top, 0, 8, 8, 32)], 8)).withColumn(
        "ord", F.col("raster_id").cast("int")).withColumn("raster_id", F.lit("cell"))
    cells = {(r.tile_row, r.tile_col): (r.top, r.n) for r in composite.coverage_of(ranked, 8).collect()}
    assert cells == {(0, 0): (9, 1), (0, 1): (9, 2), (0, 2): (9, 1), (0, 3): (9, 1)}
    got = {r.tile_col: np.frombuffer(r.data, dtype=np.uint8).reshape(3, 8, 8) for r in composite.composite_visible(ranked, 8, 2).collect()}
    assert (got[0] == arrays[9 * 4][1]).all() and (got[1][:, 1:] == top[:, 1:]).all() and (got[1][:, 0] == arrays[9 * 4 + 1][1][:, 0]).all()


def test_files_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tile_store, "FILE_GROUPS", 2)
    rows = [(f"r{i}", 0, 0, 0, 0, 2, 2, 2, 2, 3, bytes([i] * 12)) for i in range(64)]
    path = str(tmp_path / "many")
    tile_store.write(spark.createDataFrame(rows, TILE), path, files=2, group_rows=2)
    files = tile_store.read(spark, path).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 12 and max(r["count"] for r in files) <= 12 and sum(r["count"] for r in files) == 64
