"""Operators against brute force on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover.constants import CLASSES, CLASS_RGB
from groundcover.functions import color, geo, naming
from groundcover.operators import (assign, cluster, components, composite, detect, export, focal, overlay, rangejoin,
                                   stats, tiles, vector)
from groundcover.operators import kernels as K

RNG = np.random.default_rng(11)


def image(spark, a, rid="x", names="rgb"):
    """Pixel rows of a (bands, h, w) array."""
    h, w = a.shape[1:]
    rows = [(rid, y, x, *[int(v) for v in a[:, y, x]]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, " + ", ".join(f"{n} int" for n in names))


def grid(df, name, shape, fill=0):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def dims(spark, h, w, rid="x"):
    return spark.createDataFrame([(rid, h, w)], "raster_id string, raster_h int, raster_w int")


# --- composite ---------------------------------------------------------------

def serial_composite(sources, h, w):
    out = np.zeros((3, h, w), int)
    for _, _, a in sorted(sources, key=lambda s: (-s[0], s[1])):
        ok = a.sum(axis=0) >= 24
        out[:, ok] = a[:, ok]
    return out


@pytest.fixture(scope="module")
def sources():
    out = []
    for i in range(7):
        a = RNG.integers(0, 256, (3, 13, 11))
        a[:, RNG.random((13, 11)) < 0.4] = 2
        out.append((i % 3 + 1, f"s{i}.tif", a))
    return out


def test_composite_equals_serial(spark, sources):
    rows = [(p, n, y, x, *map(int, a[:, y, x])) for p, n, a in sources for y in range(13) for x in range(11)]
    px = spark.createDataFrame(rows, "priority int, path string, row int, col int, r int, g int, b int")
    order = composite.composite_order(px.select("priority", "path").distinct())
    got = composite.priority_composite(stats.attach_by(px, order, ["priority", "path"]), ["row", "col"], F.col("ord"))
    want = serial_composite(sources, 13, 11)
    for k, n in enumerate("rgb"):
        assert (grid(got, n, (13, 11)) == want[k]).all()


@pytest.mark.parametrize("salts", [1, 4])
def test_tile_composite_equals_serial(spark, sources, salts):
    rank = {n: i for i, (_, n, _) in enumerate(sorted(sources, key=lambda s: (-s[0], s[1])))}
    parts = None
    for _, n, a in sources:
        t = tiles.pixels_to_tiles(image(spark, a, n), ["r", "g", "b"], 5, dims(spark, 13, 11, n))
        t = t.withColumn("ord", F.lit(rank[n])).withColumn("raster_id", F.lit("cell"))
        parts = t if parts is None else parts.unionByName(t)
    got = tiles.tiles_to_pixels(composite.composite_tiles(parts, 5, salts), ["r", "g", "b"])
    want = serial_composite(sources, 13, 11)
    for k, n in enumerate("rgb"):
        assert (grid(got, n, (13, 11)) == want[k]).all()


def test_area_average_of_any_ratio(spark):
    a = RNG.integers(0, 256, (3, 10, 9))
    got = composite.area_average(image(spark, a), ["r"], F.lit(2.7), F.lit(3.1), ["raster_id"])
    h, w = math.ceil(10 / 3.1), math.ceil(9 / 2.7)
    want = np.zeros((h, w))
    for ty, tx in itertools.product(range(h), range(w)):
        wy = np.clip(np.minimum((np.arange(10) + 1) / 3.1, ty + 1) - np.maximum(np.arange(10) / 3.1, ty), 0, None)
        wx = np.clip(np.minimum((np.arange(9) + 1) / 2.7, tx + 1) - np.maximum(np.arange(9) / 2.7, tx), 0, None)
        wt = wy[:, None] * wx[None]
        want[ty, tx] = (wt * a[0]).sum() / wt.sum()
    assert np.allclose(grid(got, "r", (h, w)), want)


@pytest.mark.parametrize("ratio,offset", [(2.0, 3.0), (2.7, -1.3), (0.6, 0.25)])
def test_tile_resampling_equals_pixel_resampling(spark, ratio, offset):
    a = RNG.integers(0, 256, (3, 30, 33))
    px = image(spark, a)
    want = composite.area_average(px, ["r", "g"], F.lit(ratio), F.lit(ratio + 0.1), ["raster_id"], F.lit(offset), F.lit(offset + 1))
    want = {(r["row"], r["col"]): (r["r"], r["g"]) for r in want.collect() if 0 <= r["row"] < 24 and 0 <= r["col"] < 20}
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], 8, dims(spark, 30, 33))
    place = spark.createDataFrame([("x", 5, ratio, ratio + 0.1, offset, offset + 1)],
                                  "raster_id string, ord long, rx double, ry double, ox double, oy double")
    flat = composite.resample_tiles(packed, place, 20, 24, 7).drop("ord")
    got = {(r["row"], r["col"]): (r["r"], r["g"]) for r in tiles.tiles_to_pixels(flat, ["r", "g", "b"]).collect()}
    assert set(want) <= set(got)
    for k, v in want.items():
        assert all(abs(p - q) <= 0.501 for p, q in zip(got[k], v)), (k, got[k], v)


# --- samples, numbering, joins -----------------------------------------------

@pytest.mark.parametrize("limit", [100_000, 0])
def test_exact_samples_in_both_join_forms(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", limit)
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id"))
    hot = df.withColumn("g", F.when(F.col("id") < 2500, 7).otherwise(F.col("g")))
    got = stats.take_lowest(hot, 50, F.pmod(F.xxhash64("id"), F.lit(9973)), ["id"], ["g"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 50, 1: 50, 2: 50, 7: 50}
    all_equal = stats.take_lowest(hot, 20, F.lit(3), ["id"], ["g"])
    assert sorted(r["id"] for r in all_equal.filter("g = 7").collect()) == list(range(20))
    assert stats.take_lowest(hot, 5000, F.lit(3), ["id"], []).count() == 4000
    assert stats.take_lowest(hot, 0, F.lit(3), ["id"], []).count() == 0
    assert stats.take_lowest(hot, F.lit(-2), F.lit(3), ["id"], ["g"]).count() == 0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_attach_keeps_unmatched_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", limit)
    df = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = {r["id"]: r["v"] for r in stats.attach_by(df, small, ["k"]).collect()}
    assert len(got) == 100 and got[0] == "a" and got[5] == "b" and got[2] is None


def test_ordered_index(spark):
    words = [f"{v:x}" for v in RNG.integers(0, 9999, 700)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(9)
    got = stats.ordered_index(df, [F.col("w").desc()]).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(700)) and [r["w"] for r in got] == sorted(words, reverse=True)


@pytest.mark.parametrize("prob", [0.0, 0.5, 0.95, 1.0])
def test_float_percentile(spark, prob):
    v = np.where(RNG.random(900) < 0.4, 0.0, RNG.normal(size=900))
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "g int, v double")
    for r in stats.float_percentile(df, "v", prob, ["g"], "p").collect():
        assert r["p"] == pytest.approx(np.percentile(v[r["g"]::2], prob * 100))


def test_percentile_with_a_far_outlier(spark, monkeypatch):
    """One value far out, ties, both signs, infinity and nulls; and few bins a pass, whatever the values are."""
    v = np.concatenate([RNG.normal(size=700) * 1e-3, [-0.0, 0.0, 1e18, -1e-300], np.full(50, 2.5)])
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)] + [(0, None)], "g int, v double")
    for few in (stats.FEW_VALUES, 1):
        monkeypatch.setattr(stats, "FEW_VALUES", few)
        for prob in (0.0, 0.3, 0.95, 1.0):
            for r in stats.float_percentile(df, "v", prob, ["g"], "p").collect():
                assert r["p"] == np.percentile(v[r["g"]::2], prob * 100, method="linear") or r["p"] == pytest.approx(
                    np.percentile(v[r["g"]::2], prob * 100), rel=1e-12)
    assert stats.float_percentile(df, "v", 0.5, [], "p").first()["p"] == pytest.approx(np.median(v))
    none = df.filter("v > 1e30")
    assert stats.float_percentile(none, "v", 0.5, ["g"], "p").count() == 0
    keys = stats.ordered_bits(np.sort(v))
    assert (np.diff(keys) >= 0).all() and (stats.from_bits(keys) == np.sort(v)).all()


@pytest.mark.parametrize("inclusive,hot", [(False, 3), (True, 3), (True, 10_000)])
def test_box_join(spark, inclusive, hot):
    def boxes(n, off):
        p, s = RNG.integers(0, 12, (n, 2)), RNG.integers(1, 5, (n, 2))
        return [(i + off, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(p, s))]

    a, b = boxes(60, 0), boxes(50, 100)
    schema = "id int, west double, south double, east double, north double"
    got = rangejoin.bbox_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 4.0,
                              inclusive=inclusive, hot_rows=hot)
    pairs = [(r["id"], r["r_id"]) for r in got.collect()]
    lt = (lambda x, y: x <= y) if inclusive else (lambda x, y: x < y)
    want = {(p[0], q[0]) for p in a for q in b if lt(p[1], q[3]) and lt(q[1], p[3]) and lt(p[2], q[4]) and lt(q[2], p[4])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


# --- vectors -----------------------------------------------------------------

def ring_frame(spark, shapes):
    rows = [(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "fid int, rings array<array<struct<x:double,y:double>>>")


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def test_burn_matches_dense_walk(spark):
    shapes = [[[(2.2, 1.3), (17.7, 4.9), (12.1, 14.6), (9.4, 6.2), (3.8, 12.9)]],
              [[(1.1, 1.2), (18.3, 1.4), (18.2, 17.6), (1.3, 17.3)], [(5.4, 5.2), (12.7, 6.1), (9.9, 13.3)]],
              [[(-4.5, 3.5), (25.5, 3.6), (25.4, 3.9), (-4.4, 3.8)]]]
    f = ring_frame(spark, shapes)
    core = {(r["fid"], r["row"], r["col"]) for r in vector.burn(f, ["fid"], 20, 20, all_touched=False).collect()}
    want = {(i, r, c) for i, s in enumerate(shapes) for r in range(20) for c in range(20) if inside(s, c + 0.5, r + 0.5)}
    assert core == want
    for i, s in enumerate(shapes):
        for ring in s:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                for t in np.linspace(0, 1, 4001):
                    x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
                    if 0 <= x < 20 and 0 <= y < 20:
                        want.add((i, int(y), int(x)))
    got = {(r["fid"], r["row"], r["col"]) for r in vector.burn(f, ["fid"], 20, 20).collect()}
    assert want <= got and len(got - want) <= 2  # a corner may be grazed between two steps of the walk


def test_buffered_bend(spark):
    pts, hw = [(3.3, 4.1), (14.2, 5.3), (16.1, 15.4)], 2.4
    lines = spark.createDataFrame([(0, [tuple(p) for p in pts], hw)], "fid int, points array<struct<x:double,y:double>>, hw double")
    got = {(r["row"], r["col"]) for r in vector.burn_lines(lines, ["fid"], "points", "hw",
                                                     22, 22, all_touched=False).collect()}

    def margin(x, y):
        best = math.inf
        for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
            dx, dy = x1 - x0, y1 - y0
            n = math.hypot(dx, dy)
            t = ((x - x0) * dx + (y - y0) * dy) / n
            across = abs((x - x0) * dy - (y - y0) * dx) / n
            best = min(best, max(across - hw, -t, t - n))
        return min(best, math.hypot(x - pts[1][0], y - pts[1][1]) - hw)

    for r, c in itertools.product(range(22), range(22)):
        m = margin(c + 0.5, r + 0.5)
        if abs(m) > 0.02:
            assert ((r, c) in got) == (m < 0), (r, c, m)


def test_road_width_tiers():
    cases = [(10.0, "MAIN", 10.0), (0.0, " main ", 8.0), (None, "side", 4.0), (None, "TRACK", 2.0), (-1.0, None, 2.0)]
    from pyspark.sql import SparkSession
    df = SparkSession.getActiveSession().createDataFrame([(i, w, t) for i, (w, t, _) in enumerate(cases)], "i int, w double, t string")
    got = df.orderBy("i").select(naming.road_width("w", "t", "Main", 8.0, "SIDE ", 4.0, 2.0).alias("m")).collect()
    assert [r["m"] for r in got] == [c[2] for c in cases]
    text = df.selectExpr("i", "case when i = 0 then 'NaN' else 'x' end w", "t").filter("i = 0")
    assert text.select(naming.road_width("w", "t", "", 0.0, "", 0.0, 3.0).alias("m")).first()["m"] == 3.0


# --- components and neighbourhoods --------------------------------------------

@pytest.mark.parametrize("conn,share,few", [(8, 0.42, 20_000), (4, 0.6, 3), (8, 1.0, 3)])
def test_components_over_many_tiles(spark, monkeypatch, conn, share, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    monkeypatch.setattr(components, "HUB_SHARE", 20)
    m = RNG.random((45, 52)) < share
    df = spark.createDataFrame([("x", int(y), int(x)) for y, x in np.argwhere(m)], "raster_id string, row int, col int")
    lab = K.label(m, conn)
    got = components.label_components(df, None, 7, conn).collect()
    assert len(got) == m.sum()
    for r in got:
        root = lab[r["row"], r["col"]]
        assert r["comp"] == ((root // 52) << 31) + root % 52


def test_few_links_take_one_step(spark, monkeypatch):
    pairs = [(("x", "y", None)[k % 3], int(a), int(b)) for k, (a, b) in enumerate(RNG.integers(0, 400, (300, 2)))]
    edges = spark.createDataFrame([*pairs, ("x", 1000, 1001), ("x", 1002, 1001)], "raster_id string, u long, v long")
    sc = spark.sparkContext
    sc.setJobGroup("few links", "few links")
    few = {tuple(r) for r in components.contract(edges.filter("raster_id IS NOT NULL"), ["raster_id"]).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few links")) <= 8
    assert ("x", 1001, 1000) in few and ("x", 1002, 1000) in few
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert few == {tuple(r) for r in components.contract(edges.filter("raster_id IS NOT NULL"), ["raster_id"]).collect()}


def test_links_of_hubs_stay_spread(spark, tmp_path):
    """A star of 400,000 links beside a chain and small stars: right roots, and no task that holds the star."""
    n = 400_000
    star = spark.range(1, n + 1, numPartitions=16).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    small = spark.range(n + 1, n + 60_001, numPartitions=4).select((F.col("id") - F.col("id") % 100).alias("u"), F.col("id").alias("v"))
    star.unionByName(small.filter("u > 400000")).write.parquet(str(tmp_path / "links"))
    edges = spark.read.parquet(str(tmp_path / "links")).repartition(16)
    total = edges.count()
    assert total > components.FEW_EDGES
    near = components._with_min(edges, ["u"], total)
    sizes = sorted(r["count"] for r in near.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == total and sizes[-1] <= n // 8
    got = components.contract(edges, []).groupBy("root").count()
    roots = {r["root"]: r["count"] for r in got.collect()}
    assert roots.pop(0) == n
    assert all(u % 100 == 0 and c <= 99 for u, c in roots.items()) and len(roots) >= 599


@pytest.mark.parametrize("tile", [8, 13, 64])
def test_tiling_does_not_show(spark, tile):
    a = RNG.integers(0, 256, (3, 29, 37))
    px = image(spark, a)
    got = focal.box_features(px, ["r", "g", "b"], tile, keep=["r"])
    assert np.allclose(grid(got, "mean_g", (29, 37)), K.box_mean(a[1])) and (grid(got, "r", (29, 37)) == a[0]).all()
    med = focal.median_labels(px.withColumn("l", F.col("r") % 4), "l", 5, tile)
    assert (grid(med, "l", (29, 37)) == K.rank_median(a[0] % 4, 5)).all()
    t = tiles.pixels_to_tiles(px.withColumn("l", F.col("r") % 4), ["l"], max(tile, 8), dims(spark, 29, 37))
    back = tiles.tiles_to_pixels(focal.smooth_tiles(t, 5, max(tile, 8)), ["l"])
    assert (grid(back, "l", (29, 37)) == K.rank_median(a[0] % 4, 5)).all()


def test_window_reaches_the_scan(spark, tmp_path):
    a = RNG.integers(0, 256, (3, 40, 40))
    packed = tiles.pixels_to_tiles(image(spark, a), ["r", "g", "b"], 16, dims(spark, 40, 40))
    export.write_tiles(packed, str(tmp_path / "t"))
    got = tiles.read_window(spark.read.parquet(str(tmp_path / "t")), "x", 17, 17, 3, 3)
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "LessThan(row0,20)" in plan and got.count() == 1
    with pytest.raises(Exception, match="already exists"):
        export.write_tiles(packed, str(tmp_path / "t"))
    export.write_tiles(packed, str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9


# --- palette and index ---------------------------------------------------------

def test_palette_is_positional():
    p = export.build_palette()
    assert [p[(r << 16) | (g << 8) | b] for r, g, b in CLASS_RGB.values()] == [1, 2, 3, 4, 5, 6] and 0 not in p
    with pytest.raises(ValueError, match="black"):
        export.build_palette([{"name": "A", "color": "#000000"}])
    with pytest.raises(ValueError, match="injective"):
        export.build_palette([{"name": "A", "color": "#112233"}, {"name": "B", "color": "#112233"}])
    with pytest.raises(ValueError, match="RRGGBB"):
        export.build_palette([{"name": "A", "color": "#12"}])


def test_index_is_exact(spark):
    a = np.array([[[34, 34, 0]], [[139, 139, 0]], [[34, 35, 0]]])
    got = export.rgb_to_cmix(image(spark, a), export.build_palette()).orderBy("col").collect()
    assert [(r["cmix"], r["known"]) for r in got] == [(3, True), (0, False), (0, True)]
    with pytest.raises(Exception, match="outside the class palette"):
        export.rgb_to_cmix(image(spark, a), export.build_palette(), strict=True).collect()


def test_black_tile_does_not_erase_and_histogram_recounts(spark):
    rows = [(0, y, x, 3) for y in range(4) for x in range(4)] + [(1, y, x, 0) for y in range(4) for x in range(4)] + [
        (2, y, x + 2, 6) for y in range(4) for x in range(4)]
    px = spark.createDataFrame(rows, "ord int, row int, col int, cmix int")
    index = export.merge_index(px, ["row", "col"], F.col("ord"))
    a = grid(index, "cmix", (4, 6))
    assert (a[:, :2] == 3).all() and (a[:, 2:] == 6).all()
    hist = {r["cmix"]: r["n_px"] for r in export.histogram(index).collect()}
    assert hist == {3: 8, 6: 16} and sum(hist.values()) == a.size


def test_mixed_systems_and_flat_grids_fail(spark):
    schema = "west double, south double, east double, north double, xres double, yres double, epsg int"
    ok = (35.0, 33.0, 35.006, 33.004, 0.001, 0.001, 4326)
    g = export.union_grid(spark.createDataFrame([ok], schema)).first()
    assert (g["width"], g["height"]) == (6, 4)
    with pytest.raises(Exception, match="disagree"):
        export.union_grid(spark.createDataFrame([ok, (*ok[:6], 3857)], schema)).collect()
    with pytest.raises(Exception, match="degenerate"):
        export.union_grid(spark.createDataFrame([(35.0, 33.0, 35.0, 34.0, 0.1, 0.1, 4326)], schema)).collect()


# --- clusters --------------------------------------------------------------------

def test_known_colours_are_named(spark):
    rows = [("x", 1, 124, 252, 0), ("x", 2, 235, 205, 150), ("x", 3, 90, 60, 30)]
    df = spark.createDataFrame(rows, "raster_id string, cluster int, r int, g int, b int")
    anchors = {c["name"]: c["anchors"] for c in CLASSES if c["source"] == "kmeans"}
    got = {r["cluster"]: r["material"] for r in assign.assign_materials(assign.naming_cost(df, anchors), ["raster_id"]).collect()}
    assert got == {1: "BM_VEGETATION", 2: "BM_SAND", 3: "BM_SOIL"}


def test_leftover_clusters_take_the_cheapest(spark):
    rows = [("x", i, *c) for i, c in enumerate([(0, 100, 0), (230, 200, 130), (85, 55, 30), (5, 110, 5), (80, 50, 28)], 1)]
    df = spark.createDataFrame(rows, "raster_id string, cluster int, r int, g int, b int")
    anchors = {c["name"]: c["anchors"] for c in CLASSES if c["source"] == "kmeans"}
    got = {r["cluster"]: r["material"] for r in assign.assign_materials(assign.naming_cost(df, anchors), ["raster_id"]).collect()}
    assert got == {1: "BM_VEGETATION", 2: "BM_SAND", 3: "BM_SOIL", 4: "BM_VEGETATION", 5: "BM_SOIL"}


def test_greedy_uses_each_colour_once(spark):
    colours = [(0, 0, 0), (10, 10, 10), (250, 250, 250)]
    rows = [("x", 1, 1, 1, 1), ("x", 2, 2, 2, 2), ("x", 3, 3, 3, 3), ("x", 4, 9, 9, 9)]
    df = spark.createDataFrame(rows, "raster_id string, cluster int, r int, g int, b int")
    got = [r["colour"] for r in assign.greedy_colours(df, colours, ["raster_id"]).orderBy("cluster").collect()]
    assert got == [1, 2, 3, 2]


def test_both_trainers_find_clear_clusters(spark):
    centres = np.array([[20.0, 200.0], [200.0, 30.0], [120.0, 120.0]])
    pts = np.vstack([c + RNG.normal(0, 3, (200, 2)) for c in centres])
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in pts], "g string, u double, v double")
    scaler, got = cluster.fit_kmeans(df, ["u", "v"], 3)
    back = sorted([[x * scaler[f][1] + scaler[f][0] for x, f in zip(c, ("u", "v"))] for c in got])
    assert np.allclose(back, sorted(centres.tolist()), atol=1.5)
    twice = df.unionByName(df.withColumn("g", F.lit("h")).withColumn("u", F.col("u") + 500))
    start = spark.createDataFrame([(g, [[20.0 + d, 180.0], [180.0 + d, 50.0], [100.0 + d, 100.0]], [1.0, 1.0])
                                   for g, d in (("g", 0), ("h", 500))], "g string, centres array<array<double>>, scale array<double>")
    for r in cluster.lloyd_by(twice, ["u", "v"], start, ["g"], 4).collect():
        shift = np.array([500.0 if r["g"] == "h" else 0.0, 0.0])
        assert np.allclose(sorted(r["centres"]), sorted((centres + shift).tolist()), atol=1.5)


def test_empty_cluster_keeps_its_centre(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "u double")
    assert cluster.lloyd(df, ["u"], [(0.0,), (10.0,), (500.0,)], 3) == [[0.5], [9.0], [500.0]]


def test_representatives_fill_the_budget(spark):
    rows = [(f"p{i}", float(i % 40), float(i // 40), i % 40 + 1.0, i // 40 + 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, west double, south double, east double, north double")
    got = cluster.representative_rasters(df)
    n = got.filter("selected").count()
    assert n >= 20 and got.count() == 400
    few = cluster.representative_rasters(df.limit(5))
    assert few.filter("selected").count() == 5


# --- detection -------------------------------------------------------------------

def painted(shape, spots, base=(90, 60, 30)):
    a = np.empty((3, *shape), int)
    a[:] = np.array(base)[:, None, None]
    for (y0, y1, x0, x1), rgb in spots:
        a[:, y0:y1, x0:x1] = np.array(rgb)[:, None, None]
    return a


def test_water_and_buildings_are_found(spark):
    a = painted((80, 90), [((5, 35, 5, 40), (28, 107, 160)), ((58, 78, 50, 80), (178, 178, 180)), ((43, 47, 0, 90), (178, 178, 180))])
    px = image(spark, a)
    water = grid(detect.detect(px, "water", 7200, 32).withColumn("v", F.lit(1)), "v", (80, 90))
    assert water[8:32, 8:37].all() and not water[40:].any()
    bld = grid(detect.detect(px, "buildings", 7200, 32).withColumn("v", F.lit(1)), "v", (80, 90))
    assert bld[59:77, 51:79].all() and not bld[40:50].any() and not bld[:40].any()
    # one tile or many: the same mask
    again = grid(detect.detect(px, "water", 7200, 128).withColumn("v", F.lit(1)), "v", (80, 90))
    assert (again == water).all()


def test_lines_need_a_straight_run(spark):
    road = painted((64, 64), [((30, 32, 0, 64), (100, 100, 100))])
    dots = painted((64, 64), [((y, y + 1, x, x + 1), (100, 100, 100)) for y in range(0, 64, 16) for x in range(0, 64, 16)])
    got = lambda a: detect.line_structures(image(spark, a)).first()["has_line"]
    assert got(road) and not got(dots)


def test_model_failures_stop_and_floods_may_be_emptied(spark):
    a = painted((20, 20), [((0, 5, 0, 5), (0, 200, 0))])
    t = tiles.pixels_to_tiles(image(spark, a), ["r", "g", "b"], 10, dims(spark, 20, 20))

    def broken(rgb, prompt, threshold):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        detect.mask_pixels(detect.segment_tiles(t, broken, "x", 0.1, 10, 2)).count()
    flood = lambda rgb, p, th: np.ones(rgb.shape[:2])
    assert detect.mask_pixels(detect.segment_tiles(t, flood, "x", 0.1, 10, 2)).count() == 400
    assert detect.mask_pixels(detect.segment_tiles(t, flood, "x", 0.1, 10, 2, max_share=0.5)).count() == 0
    assert detect.mask_pixels(detect.segment_tiles(t, lambda rgb, p, th: rgb[:, :, 1] > 150, "x", 0.1, 10, 2)).count() == 25


def test_known_sources_never_veto(spark):
    a = painted((20, 20), [], base=(34, 139, 34))
    px = image(spark, a)
    mask = px.filter("row between 5 and 14 and col between 5 and 14").select("raster_id", "row", "col")
    km = {"BM_VEGETATION": CLASS_RGB["BM_VEGETATION"]}
    kept = overlay.fuse(px, px, [(mask, "BM_CONCRETE", "shapefile")], km)
    assert kept.filter("r = 180").count() == 100
    assert overlay.fuse(px, px, [(mask, "BM_CONCRETE", "survey")], km).filter("r = 180").count() == 0


# --- scalar errors ---------------------------------------------------------------

def test_strict_colour_and_cell_checks_fail_loudly(spark):
    df = spark.createDataFrame([("#12345", 60, 7)], "c string, lat int, lon int")
    with pytest.raises(Exception, match="RRGGBB"):
        df.select(color.hex_to_rgb_strict("c")).collect()
    with pytest.raises(Exception, match="zone grid"):
        df.select(geo.snapped_cell("lat", "lon")).collect()
    cell = spark.createDataFrame([(45, 6)], "lat int, lon int").select(geo.snapped_cell("lat", "lon").alias("c")).first()["c"]
    assert (cell["name"], cell["west"], cell["south"], cell["east"], cell["north"]) == ("N45E006", 6.0, 45.0, 7.0, 46.0)


def test_samples_and_windows_differ_between_rasters(spark):
    px = spark.range(10_000).select(F.format_string("r%d", "id").alias("raster_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    px = px.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3))))
    got = cluster.uniform_sample(px, 20_000).groupBy("raster_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("rasters"), F.max("n").alias("most")).first()
    assert got["rasters"] > 8000 and got["most"] <= 12
    sizes = spark.createDataFrame([(f"r{i}", 10_000, 10_000) for i in range(5)], "raster_id string, raster_h int, raster_w int")
    w = [tuple(r) for r in cluster.sample_windows(sizes, grid=2).select("raster_id", "wr", "wc").collect()]
    extra = [x for x in w if not {x[1], x[2]} <= {0, max(v[1] for v in w)}]
    assert len({x[1:] for x in extra}) == len(extra) and len({x[1] - x[2] for x in extra}) > len(extra) * 0.9


def test_index_over_a_byte_fails(spark):
    px = spark.createDataFrame([("a", 0, 0, 300)], "raster_id string, row int, col int, cmix int")
    with pytest.raises(Exception, match="does not fit"):
        export.merge_index(px, ["raster_id", "row", "col"], F.lit(0)).collect()


# --- joins and numbers that grow with the pixels -----------------------------------

def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reprojection_sends_no_pixels_to_all_tasks(spark):
    px = image(spark, RNG.integers(0, 256, (3, 9, 8)))
    raster = spark.createDataFrame([("x", 9, 8, 3857, 3900000.0, 4000000.0, 30.0, 25.0)],
                                   "raster_id string, height int, width int, epsg int, west double, north double, xres double, yres double")
    out = composite.mercator_to_degrees(px, raster, ["r", "g", "b"])
    assert "BroadcastHashJoin" not in plan_text(out)
    assert out.count() > 0


def test_superpixels_below_row_15029(spark):
    from groundcover.operators import semantics
    px = image(spark, RNG.integers(0, 256, (3, 15, 16)))
    far = px.withColumn("row", F.col("row") + 7 * 3000)
    near = {(r["row"], r["col"]): r["segment"] for r in semantics.superpixels(px, dims(spark, 15, 16), 7, rounds=1).collect()}
    got = {(r["row"] - 21000, r["col"]): r["segment"] - 3000 * 1_000_000
           for r in semantics.superpixels(far, dims(spark, 21015, 16), 7, rounds=1).collect()}
    assert got == near


def test_components_send_no_pixels_to_all_tasks(spark):
    px = image(spark, RNG.integers(0, 256, (3, 9, 8)))
    labels = components._tile_labels(px, ["raster_id"], 4, 8)
    assert "BroadcastHashJoin" not in plan_text(components._border_edges(labels, ["raster_id"], 4, 8))
    out = plan_text(detect._shape_filter(px.select("raster_id", "row", "col"), px, "water", 1000, 4))
    assert not [j for j in out.splitlines() if "BroadcastHashJoin [raster_id" in j and " row#" in j]


def test_burning_shuffles_spans_and_not_pixels(spark):
    f = spark.range(20).selectExpr("id as fid", "array(array(named_struct('x', 0.5D, 'y', 0.5D), named_struct('x', 90.5D, 'y', 0.5D), "
                                   "named_struct('x', 90.5D, 'y', 3.5D), named_struct('x', 0.5D, 'y', 3.5D))) as rings")
    got = vector.burn(f, ["fid"], 10, 100)
    assert got.count() == got.distinct().count() == 20 * 4 * 91
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.index("explode(sequence(_a") < plan.index("Window")
