"""Run-length masks against labels, holes and fusion of whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover.constants import CLASS_RGB
from groundcover.operators import kernels as K
from groundcover.operators import overlay, runs, tiles
from groundcover.plans import material_map as mm
from groundcover.plans import tile_run

from .test_runs import dims, image


def stored(spark, a, side, raster="a"):
    px = spark.createDataFrame([(raster, int(r), int(c), int(a[r, c])) for r, c in np.ndindex(a.shape)], "raster_id string, row int, col int, v int")
    return tiles.pixels_to_tiles(px, ["v"], side, dims(spark, *a.shape, raster))


def shapes(seed, size=(37, 53)):
    rng = np.random.default_rng(seed)
    a = (rng.random(size) < 0.55).astype(int)
    a[5:9, :] = 1
    a[:, 20] = 1
    return a


def test_runs_of_values():
    a = np.array([[0, 2, 2, 3, 0], [1, 1, 0, 0, 4], [0, 0, 0, 0, 0], [5, 5, 5, 5, 5]], dtype=np.uint8)
    row, c0, c1 = runs.find_runs(a)
    assert list(zip(row.tolist(), c0.tolist(), c1.tolist())) == [(0, 1, 2), (0, 3, 3), (1, 0, 1), (1, 4, 4), (3, 0, 4)]


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("side", [8, 13, 64])
def test_labels_do_not_depend_on_tiles(spark, side, connectivity):
    a = shapes(side + connectivity)
    labels = runs.label_runs(runs.tile_runs(stored(spark, a, side)), side, connectivity)
    got = np.full(a.shape, -1, dtype=np.int64)
    for r in labels.collect():
        got[r.row, r.c0:r.c1 + 1] = (r.comp >> 31) * a.shape[1] + (r.comp & (2**31 - 1))
    assert (got == K.label(a > 0, connectivity)).all()


def test_values_are_labelled_apart(spark):
    a = shapes(3) + 2 * shapes(4)
    by = ("raster_id", "value")
    stats = runs.run_stats(runs.label_runs(runs.tile_runs(stored(spark, a, 16)), 16, 8, by), by)
    want = []
    for v in (1, 2, 3):
        lab = K.label(a == v, 8)
        for c in np.unique(lab[lab >= 0]):
            y, x = np.nonzero(lab == c)
            want.append((v, len(y), y.min(), y.max(), x.min(), x.max()))
    assert sorted((r.value, r.area, r.row0, r.row1, r.col0, r.col1) for r in stats.collect()) == sorted(want)


def test_holes_of_a_whole_array(spark):
    a = shapes(5)
    packed = stored(spark, a, 16)
    inner = runs.holes(runs.tile_runs(packed, blank=True), F.lit(a.shape[0]), F.lit(a.shape[1]), 16)
    got = a > 0
    for r in inner.collect():
        got[r.row, r.c0:r.c1 + 1] = True
    assert (got == K.fill_holes(a > 0)).all()


def test_hulls_and_sums(spark):
    a = shapes(6)
    labels = runs.label_runs(runs.tile_runs(stored(spark, a, 16)), 16, 8)
    lab = K.label(a > 0, 8)
    want = {}
    for c in np.unique(lab[lab >= 0]):
        y, x = np.nonzero(lab == c)
        ys = np.concatenate([y - .5, y - .5, y + .5, y + .5])
        xs = np.concatenate([x - .5, x + .5, x - .5, x + .5])
        want[int(c // a.shape[1] << 31 | c % a.shape[1])] = (round(K.hull_area(ys, xs), 6), int((y * x).sum()))
    weights = np.arange(a.shape[0])[:, None] * np.arange(a.shape[1])[None]
    low, high = stored(spark, weights % 256, 16), weights
    hulls = {r.comp: round(r.hull, 6) for r in runs.hulls(labels).collect()}
    sums = runs.with_sums(labels, low, ["s"], lambda bands: [bands[0].astype(int)]).groupBy("comp").agg(F.sum("s").alias("s"))
    assert hulls == {c: h for c, (h, _) in want.items()}
    for r in sums.collect():
        y, x = np.nonzero(lab == (r.comp >> 31) * a.shape[1] + (r.comp & (2**31 - 1)))
        assert r.s == int((high[y, x] % 256).sum())


def test_masked_run_equals_the_pixel_form(spark):
    """Three masks, two of which can lose components, over random blocks of colours."""
    rng = np.random.default_rng(7)
    names = ["BM_VEGETATION", "BM_SAND", "BM_SOIL"]
    part = np.kron(rng.integers(0, 3, (6, 7)), np.ones((8, 8), dtype=int))
    bands = np.array([CLASS_RGB[n] for n in names])[part].transpose(2, 0, 1)
    px = image(spark, bands, "a")
    masks = [(shapes(8, (48, 56)), "BM_CONCRETE", "survey"), (shapes(9, (48, 56)) * (part != 1), "BM_ASPHALT", "survey"),
             ((part == 2).astype(int), "BM_WATER", "shapefile")]
    cells = lambda a: spark.createDataFrame([("a", int(r), int(c)) for r, c in zip(*np.nonzero(a))], "raster_id string, row int, col int")
    colours = {n: CLASS_RGB[n] for n in names}
    want = mm.fuse_masks(px, px, [(cells(a), m, s) for a, m, s in masks], mm.Options(tile=16, names=tuple(names)))
    index = stored(spark, np.array([tile_run.CMIX[n] for n in names])[part], 16)
    image_tiles = tiles.pixels_to_tiles(px, ["r", "g", "b"], 16, dims(spark, 48, 56, "a"))
    got, table = tile_run.fuse_tiles_with_veto(index, image_tiles, [(stored(spark, a, 16), m, s) for a, m, s in masks], 16, colours, True)
    by_colour = {c: tile_run.CMIX[n] for n, c in CLASS_RGB.items() if n in tile_run.CMIX}
    want = {(r.row, r.col): by_colour[r.r, r.g, r.b] for r in want.collect()}
    assert {(r.row, r.col): r.v for r in tiles.tiles_to_pixels(got, ["v"]).collect()} == want
    totals = {(r.material, r.vetoed): r.n for r in table.groupBy("material", "vetoed").agg(F.count("*").alias("n")).collect()}
    assert totals.get(("BM_CONCRETE", True), 0) + totals.get(("BM_ASPHALT", True), 0) > 0
    rows = overlay.veto_summary(table).collect()
    assert sum(r.total for r in rows) == sum(totals.values())


def test_no_mask_and_empty_masks(spark):
    a = np.ones((20, 20), dtype=int)
    index = stored(spark, a * 3, 16)
    image_tiles = tiles.pixels_to_tiles(image(spark, np.full((3, 20, 20), 90), "a"), ["r", "g", "b"], 16, dims(spark, 20, 20, "a"))
    model = mm.Model(tuple(mm.feature_names(mm.Options())), {f: (0.0, 1.0) for f in mm.feature_names(mm.Options())}, ((90.0,) * 3 + (0.0,) * 3,) * 3,
                     ("BM_SOIL", "BM_SAND", "BM_VEGETATION"))
    _, counts, veto = tile_run.masked_run(image_tiles, [], mm.Options(tile=16), model)
    assert sum(r.n_px for r in counts.collect()) == 400 and veto.count() == 0
    empty = stored(spark, a * 0, 16)
    got, table = tile_run.fuse_tiles_with_veto(index, image_tiles, [(empty, "BM_CONCRETE", "survey")], 16, {})
    assert {r.v for r in tiles.tiles_to_pixels(got, ["v"]).collect()} == {3} and table.count() == 0
