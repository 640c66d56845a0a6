"""Training inside stored tiles: moments, seeding, rounds, and the estimator."""

import numpy as np
import pytest

from groundcover.models import TileKMeans, TileKMeansModel
from groundcover.operators import cluster, tile_kmeans, tiles
from groundcover.plans import material_map as mm

from .test_runs import dims, image, scene

PLAIN = tile_kmeans.Features(("r", "g", "b"), lambda canvas: canvas.astype(float))


def packed(spark, side=16, rasters="a"):
    px = None
    for i, name in enumerate(rasters, 1):
        one = image(spark, scene(i), name)
        px = one if px is None else px.unionByName(one)
    sizes = dims(spark, 48, 60, rasters[0])
    for name in rasters[1:]:
        sizes = sizes.unionByName(dims(spark, 48, 60, name))
    return px, tiles.pixels_to_tiles(px, ["r", "g", "b"], side, sizes)


def test_moments_equal_the_aggregates(spark):
    opts = mm.Options(tile=16)
    px, stored = packed(spark, rasters="ab")
    form = mm.tile_form(opts)
    at = tile_kmeans.moments(tile_kmeans.kept_tiles(stored, form, 16), form)
    feats = mm.features(px, opts).filter("r + g + b >= 24")
    scaler = cluster.fit_scaler(feats, list(form.names))
    assert at.n == feats.count()
    for i, f in enumerate(form.names):
        assert (at.mean[i], at.std[i]) == pytest.approx(scaler[f], abs=1e-4)
        assert at.correlation[0, i] == pytest.approx(feats.corr("mean_r", f), abs=1e-4)


@pytest.mark.parametrize("side", [16, 60])
def test_rounds_equal_the_pixel_form(spark, side):
    px, stored = packed(spark, side)
    start = [(10.0, 20.0, 30.0), (200.0, 190.0, 170.0), (60.0, 140.0, 60.0), (300.0, 300.0, 300.0)]
    none = tile_kmeans.Moments(0, np.zeros(3), np.ones(3), np.eye(3))
    got, _ = tile_kmeans.lloyd(tile_kmeans.kept_tiles(stored, PLAIN, side), PLAIN, none, np.array(start)[None], 3, -1.0)
    assert got == pytest.approx(np.array(cluster.lloyd(px.filter("r + g + b >= 24"), ["r", "g", "b"], start, 3)), abs=1e-4)


def test_trained_model_does_not_depend_on_tiles(spark):
    got = [tile_kmeans.fit(tile_kmeans.kept_tiles(packed(spark, side, "ab")[1], PLAIN, side), PLAIN, 3) for side in (16, 60)]
    assert np.array(got[0][1]) == pytest.approx(np.array(got[1][1]), abs=1e-4)


def test_planted_mixture_is_recovered(spark):
    rng = np.random.default_rng(1)
    means = np.array([(30, 200, 40), (200, 190, 60), (90, 60, 30), (120, 120, 220), (240, 240, 240), (200, 30, 30)])
    part = rng.choice(6, size=(64, 64), p=[.5, .3, .1, .06, .03, .01])
    bands = np.clip(means[part] + rng.integers(-5, 6, (64, 64, 3)), 0, 255).transpose(2, 0, 1)
    stored = tiles.pixels_to_tiles(image(spark, bands, "a"), ["r", "g", "b"], 32, dims(spark, 64, 64, "a"))
    scaler, centres = tile_kmeans.fit(tile_kmeans.kept_tiles(stored, PLAIN, 32), PLAIN, 6)
    raw = sorted(tuple(c * scaler[f][1] + scaler[f][0] for c, f in zip(centre, PLAIN.names)) for centre in centres)
    assert np.array(raw) == pytest.approx(np.array(sorted(map(tuple, means.tolist()))), abs=2)


def test_no_pixel_becomes_a_row(spark, monkeypatch):
    _, stored = packed(spark, rasters="ab")
    stored = stored.checkpoint()
    monkeypatch.setattr(mm, "tiles_to_pixels", lambda *a: pytest.fail("pixels"))
    labels, named = mm.classify_tiles(stored, mm.Options(tile=16))
    assert sorted(named.materials) == ["BM_SAND", "BM_SOIL", "BM_VEGETATION"]
    kept = tile_kmeans.kept_tiles(stored, mm.tile_form(mm.Options(tile=16)), 16)
    assert kept.count() == stored.count()
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert " row#" not in plan and " col#" not in plan
    px, _ = packed(spark, rasters="ab")
    got = {(r.raster_id, r.row, r.col): r.cluster for r in tiles.tiles_to_pixels(labels, ["cluster"]).collect()}
    at = lambda rid, y, x: named.materials[got[rid, y, x] - 1]
    for rid in "ab":
        assert [at(rid, 5, 20), at(rid, 24, 30), at(rid, 40, 10)] == ["BM_VEGETATION", "BM_SAND", "BM_SOIL"]


def test_automatic_sample_size(spark, monkeypatch):
    _, stored = packed(spark, rasters="ab")
    asked = []
    monkeypatch.setattr(cluster, "size_from_correlation", lambda n, m, k: asked.append((n, m.shape, k)) or (0.5, 3000))
    model = mm.train_tiles(stored, mm.Options(tile=16, train_pixels="auto"), window=12)
    assert asked == [(2 * 48 * 60, (6, 6), 3)] and len(model.centres) == 3


def test_nothing_covered(spark):
    stored = tiles.pixels_to_tiles(image(spark, np.zeros((3, 48, 60), dtype=int), "a"), ["r", "g", "b"], 16, dims(spark, 48, 60, "a"))
    with pytest.raises(ValueError, match="covered"):
        mm.train_tiles(stored, mm.Options(tile=16))


def test_fewer_colours_than_clusters(spark):
    bands = np.full((3, 20, 20), 50)
    bands[:, :, 10:] = 200
    stored = tiles.pixels_to_tiles(image(spark, bands, "a"), ["r", "g", "b"], 16, dims(spark, 20, 20, "a"))
    _, centres = tile_kmeans.fit(tile_kmeans.kept_tiles(stored, PLAIN, 16), PLAIN, 4)
    assert len(centres) == 4 and len({tuple(np.round(c, 6)) for c in centres}) == 2


def test_estimator_saves_and_loads(spark, tmp_path):
    _, stored = packed(spark, rasters="ab")
    stored = stored.checkpoint()
    est = TileKMeans(k=3, tile=16, smoothing="median_1", seed=5)
    est.write().overwrite().save(str(tmp_path / "estimator"))
    est = TileKMeans.load(str(tmp_path / "estimator"))
    model = est.fit(stored)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = TileKMeansModel.load(str(tmp_path / "model"))
    assert loaded.model == model.model and loaded.getOrDefault("smoothing") == "median_1"
    want = mm.score_tiles(stored, model.model, mm.Options(tile=16, smoothing="median_1"))
    key = lambda df: sorted((r.raster_id, r.tile_row, r.tile_col, bytes(r.data)) for r in df.collect())
    assert key(loaded.transform(stored)) == key(want) and len(key(want)) == stored.count()
