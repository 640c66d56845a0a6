"""Chains on tiles against the kernels on whole rasters, the pixel form and plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover.functions.predicates import SCENE_FLAGS, scene_flag_planes, scene_flags
from groundcover.operators import chains, focal, semantics, stats, tiles
from groundcover.operators import kernels as K
from tests.test_operators import dims, grid, image

RNG = np.random.default_rng(23)
H, W = 41, 57


@pytest.fixture(scope="module")
def raster():
    """Patches of colour with noise, five bands with a cluster that has gaps."""
    patch = (np.arange(H)[:, None] // 9 + 2 * (np.arange(W)[None] // 13)) % 4
    base = np.array([[40, 130, 45, 220], [232, 200, 176, 210], [178, 178, 180, 188], [28, 107, 160, 27]])[patch]
    a = np.clip(np.moveaxis(base, 2, 0) + RNG.integers(-20, 21, (4, H, W)), 0, 255)
    cluster = np.where(RNG.random((H, W)) < 0.06, 0, patch + 1)
    cluster[3:9, 20:23] = 0
    return np.concatenate([a, cluster[None]])


def packed(spark, a, names, tile):
    return tiles.pixels_to_tiles(image(spark, a, names=names), list(names), tile, dims(spark, *a.shape[1:]))


def test_radii_add_up_and_idle_steps_are_left_out():
    used = []
    step = lambda out, need, r: chains.Step(out, need, lambda *x: used.append(out) or x[0], r)
    c = chains.Chain(("a", "b"), (step("p", ("a",), 2), step("q", ("p", "b"), 3), step("s", ("b",), 9), step("t", ("q", "lim"), 1)),
                     (chains.Scalar("lim", ("s",), 0.5),))
    assert (c.radius(["p"]), c.radius(["q"]), c.radius(["t"]), c.radius(["a"])) == (2, 5, 9, 0)
    c.run(np.zeros((2, 3, 3), np.uint8), ["t"], {"lim": 1.0})
    assert used == ["p", "q", "t"]
    with pytest.raises(ValueError, match="nothing makes"):
        c.radius(["z"])


@pytest.mark.parametrize("tile", [11, 16, 64])
def test_features_do_not_depend_on_tiles(spark, raster, tile):
    a = raster[:3].astype(float)
    names = ["mean_r", "texture", "entropy", "local_std"]
    held = chains.prepared(packed(spark, raster[:3], "rgb", tile), focal.FEATURE_CHAIN, names, tile)
    got = chains.chain_pixels(held, focal.FEATURE_CHAIN, dict.fromkeys(names, "double")).cache()
    gray = a.sum(axis=0) / 3
    u8 = ((gray - gray.min()) / (gray.max() - gray.min()) * 255).astype(np.uint8)
    luma = (a[0] * 9798 + a[1] * 19235 + a[2] * 3735 + 16384) // 32768
    for n, want in zip(names, (K.box_mean(a[0]), K.texture_std(gray), K.disk_entropy(u8), K.gaussian_std(luma))):
        assert np.allclose(grid(got, n, (H, W)), want, atol=1e-6), n
    got.unpersist()


def test_a_chain_of_morphology_equals_one_pass(spark, raster):
    steps = [("open", "ellipse", 3), ("close", "rect", 9), ("dilate", "ellipse", 5)]
    m = (raster[:1] > 120).astype(int)
    chain = focal.morphology_chain("f", steps, "out")
    assert chain.radius(["out"]) == 2 + 8 + 2
    got = chains.chain_tiles(chains.prepared(packed(spark, m, "f", 13), chain, ["out"], 13), chain, ["out"])
    want = focal.morphology(image(spark, m, names="f"), "f", steps, 64)
    assert (grid(tiles.tiles_to_pixels(got, ["f"]), "f", (H, W)) == grid(want, "f", (H, W))).all()


def test_flags_equal_the_column_form(spark):
    a = RNG.integers(0, 256, (4, 20, 30))
    px = spark.createDataFrame([(int(y), int(x), *map(int, a[:, y, x])) for y in range(20) for x in range(30)],
                               "row int, col int, r int, g int, b int, nir int").withColumn("scale", F.lit(231.5))
    for nir in ("nir", None):
        bands = dict(zip(["r", "g", "b"] + (["nir"] if nir else []), a))
        got, want = scene_flag_planes(bands, 231.5), scene_flags(px, "scale", nir).collect()
        names = [n for n in SCENE_FLAGS if nir or n != "water_nir"] + ["water"]
        assert set(got) == set(names)
        for n in names:
            assert all(got[n][r["row"], r["col"]] == r[f"f_{n}"] for r in want), n


@pytest.mark.parametrize("tile", [16, 64])
@pytest.mark.parametrize("few", [stats.FEW_VALUES, 4])
def test_values_of_a_raster(spark, raster, monkeypatch, tile, few):
    """Percentiles over pixels of a cluster only, in two passes and in four, for two rasters at once."""
    monkeypatch.setattr(stats, "FEW_VALUES", few)
    chain = semantics.semantic_chain()
    both = packed(spark, raster, ["r", "g", "b", "nir", "cluster"], tile)
    half = raster.copy()
    half[:4] //= 2
    other = tiles.pixels_to_tiles(image(spark, half, "y", ["r", "g", "b", "nir", "cluster"]), ["r", "g", "b", "nir", "cluster"],
                                  tile, dims(spark, H, W, "y"))
    held = chains.prepared(both.unionByName(other), chain, ["f_edge"], tile)
    got = {r["raster_id"]: (r["scale"], r["p95"]) for r in held.select("raster_id", "scale", "p95").distinct().collect()}
    for rid, a in (("x", raster), ("y", half)):
        there = a[4] > 0
        rgb = np.where(there, a[:3], 0)
        scale = np.percentile(rgb[:, there], 98)
        s = np.clip(rgb / scale, 0, 1)
        grad = K.gradient_magnitude(0.299 * s[0] + 0.587 * s[1] + 0.114 * s[2])
        assert got[rid] == (pytest.approx(scale), pytest.approx(np.percentile(grad[there], 95), rel=1e-12))


@pytest.mark.parametrize("nir", ["nir", None])
def test_scores_equal_the_pixel_form(spark, raster, nir):
    names = ["r", "g", "b"] + (["nir"] if nir else []) + ["cluster"]
    a = raster if nir else raster[[0, 1, 2, 4]]
    px = image(spark, a, names=names).filter("cluster > 0")
    want = {r["cluster"]: r for r in semantics.cluster_semantics(px, nir, 64).collect()}
    got = semantics.tile_semantics(packed(spark, a, names, 16), 16, nir).collect()
    assert len(got) == len(want) == 4
    for r in got:
        for c in got[0].asDict():
            assert r[c] == pytest.approx(want[r["cluster"]][c], abs=1e-9), c


def test_no_pixel_is_a_row(spark, raster):
    """Between the tiles and the scores, what crosses a shuffle is tiles and a few counts."""
    t = packed(spark, raster, ["r", "g", "b", "nir", "cluster"], 16)
    chain = semantics.semantic_chain()
    held = chains.prepared(t, chain, semantics.FRACTIONS.values(), 16)
    assert held.count() == t.count()
    got = chains.chain_counts(held, chain, "cluster", ["f_edge"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row#" not in plan.replace("tile_row#", "") and sum(r["n"] for r in got.collect()) == (raster[4] > 0).sum()


def test_nothing_covered(spark):
    a = np.zeros((5, 9, 9), int)
    t = packed(spark, a, ["r", "g", "b", "nir", "cluster"], 4)
    assert semantics.tile_fractions(t, 4).count() == 0
    assert semantics.tile_semantics(t, 4).count() == 0
