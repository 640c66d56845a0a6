"""Reprojection of tiles against plain arrays."""

import numpy as np
import pytest

from groundcover.operators import reproject, tiles
from groundcover.schema import TILE

H, W = 21, 34


def packed(spark, a, side, missing=()):
    rows = [("r", y // side, x // side, y, x, *a[:, y:y + side, x:x + side].shape[1:], *a.shape[1:], len(a),
             bytearray(a[:, y:y + side, x:x + side].tobytes()))
            for y in range(0, a.shape[1], side) for x in range(0, a.shape[2], side) if (y // side, x // side) not in missing]
    return spark.createDataFrame(rows, TILE)


def grid(spark):
    return spark.createDataFrame([("r", H, W)], "raster_id string, height int, width int")


@pytest.mark.parametrize("side,target", [(5, 7), (8, 64)])
def test_nearest(spark, side, target):
    a = np.random.default_rng(3).integers(0, 256, (2, H, W)).astype(np.uint8)
    axes = lambda g: (np.floor(np.arange(30) * 0.9 - 2), np.floor(np.arange(50) * 0.6))
    out = reproject.nearest_tiles(packed(spark, a, side, {(1, 1)}), grid(spark), axes, target)
    got = {(r.row, r.col): (r.x, r.y) for r in tiles.tiles_to_pixels(out, ["x", "y", "there"]).filter("there > 0").collect()}
    want = {}
    for i, r in enumerate(axes(None)[0].astype(int)):
        for j, c in enumerate(axes(None)[1].astype(int)):
            if 0 <= r < H and 0 <= c < W and (r // side, c // side) != (1, 1):
                want[i, j] = tuple(int(v) for v in a[:, r, c])
    assert got == want


@pytest.mark.parametrize("side,target", [(5, 7), (8, 64)])
def test_bilinear(spark, side, target):
    a = np.random.default_rng(4).integers(0, 256, (2, H, W)).astype(np.uint8)
    axes = lambda g: (np.arange(30) * 0.8 - 1.3, np.arange(50) * 0.75 + 0.25)
    out = reproject.value_pixels(reproject.bilinear_tiles(packed(spark, a, side), grid(spark), axes, side, target), ["x", "y"])
    got = {(r.row, r.col): (r.x, r.y) for r in out.collect()}
    assert len(got) == 30 * 50
    for (i, j), values in got.items():
        v, u = axes(None)[0][i], axes(None)[1][j]
        r, c = int(np.floor(v)), int(np.floor(u))
        at = lambda k, n: min(max(k, 0), n - 1)
        want = sum((1 - abs(v - r - d)) * (1 - abs(u - c - e)) * a[:, at(r + d, H), at(c + e, W)].astype(float)
                   for d in (0, 1) for e in (0, 1))
        assert np.allclose(values, want)


def test_backward_positions_fail(spark):
    a = np.zeros((1, H, W), dtype=np.uint8)
    out = reproject.nearest_tiles(packed(spark, a, 8), grid(spark), lambda g: (np.arange(9)[::-1], np.arange(9)), 8)
    with pytest.raises(Exception, match="run backwards"):
        out.collect()
