"""Sources, sinks and whole runs on files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover.constants import CLASS_RGB
from groundcover.operators import cluster, export, stats, tiles
from groundcover.plans import cell_run, material_map as mm
from groundcover.sources import files, profiles, rasters, vectors
from groundcover.streaming.incremental import score_arrivals
from tests.test_operators import dims, grid, image, painted


def png(path, a):
    """A small RGB image written by hand."""
    h, w = a.shape[1:]
    raw = b"".join(b"\0" + np.moveaxis(a[:, y], 0, 1).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_become_tiles(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 256, (3, 21, 30))
    png(tmp_path / "a.png", a)
    px = tiles.tiles_to_pixels(rasters.read_images(spark, str(tmp_path), 16), ["r", "g", "b"])
    for k, n in enumerate("rgb"):
        assert (grid(px, n, (21, 30)) == a[k]).all()


def test_discovery(spark, tmp_path):
    for name in ("a.tif", "sub/b.TIF", "sub/c.jp2", "x_mosaic_tiles/d.tif", "notes.txt", ".mc_footprint_cache.json"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    found = files.scan_folder(spark, str(tmp_path))
    assert [r["relative_path"] for r in found.collect()] == ["a.tif", "sub/b.TIF", "sub/c.jp2", "x_mosaic_tiles/d.tif"]
    layer = files.discover_layer(spark, str(tmp_path), 2)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in layer.collect()) == ["a.tif", "c.jp2"]
    with pytest.raises(ValueError, match="matched no files"):
        files.discover_layer(spark, str(tmp_path / "sub"), 1, ("png",))


def test_footprints_need_a_system(spark):
    row = ("t", "p", 1, None, 10, 20, 3, 35.0, 34.0, 0.1, 0.05, 1, 1)
    from groundcover.schema import RASTER
    with pytest.raises(Exception, match="no CRS"):
        rasters.footprints(spark.createDataFrame([row], RASTER)).collect()
    got = rasters.footprints(spark.createDataFrame([(*row[:3], 4326, *row[4:])], RASTER)).first()
    assert (got["south"], got["east"], got["px"]) == (33.0, 36.0, pytest.approx(0.1))
    with pytest.raises(Exception, match="usable pixel size"):
        rasters.finest_pixel(spark.createDataFrame([(0.0,)], "px double")).collect()


def test_cache_reads_only_changed_files(spark):
    schema = "path string, size long, mtime long"
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], schema)
    old = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 9, 2, 0.5), ("gone", 1, 1, 0.5)], schema + ", px double")
    got = files.refresh_cache(now, old, lambda misses: misses.withColumn("px", F.lit(0.7)))
    assert {r["path"]: (r["px"], r["cache_hit"]) for r in got.collect()} == {"a": (0.5, True), "b": (0.7, False), "c": (0.7, False)}


def test_profile_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"version": 2, "material_overrides": {"BM_ROCK": {"anchors": [[1,2,3],[4,5,6]]}, '
                                     '"BM_METAL": {"anchors": [[1,2,3]]}, "BM_CONCRETE": {"anchors": [[9,9,9]]}, "BM_FOLIAGE": null, '
                                     '"BM_WATER": {"tolerance_radius": 40}}}')
    got = {r["material"]: r["anchors"] for r in profiles.migrate(profiles.read_profile(spark, str(tmp_path / "p.json"))).collect()}
    assert got == {"BM_CONCRETE": [[9, 9, 9], [1, 2, 3], [4, 5, 6]], "BM_WATER": []}


def test_rare_tags_are_dropped(spark):
    rows = [(i, {"k": "v", **({"rare": "1"} if i == 0 else {})}, []) for i in range(40)]
    f = spark.createDataFrame(rows, "osm_id long, tags map<string,string>, rings array<array<struct<x:double,y:double>>>")
    assert {tuple(r["tags"]) for r in vectors.keep_frequent_tags(f).collect()} == {("k",)}


def test_lines_keep_their_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("pos"), F.concat(F.lit("line "), "id").alias("text")).repartition(7)
    export.write_lines(rows, str(tmp_path / "s"), ["pos"])
    parts = sorted((tmp_path / "s").glob("part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text == [f"line {i}" for i in range(500)]


def test_manifest_rules(tmp_path):
    good = '[geocell]\nsouth_lat = 33\nwest_lon = 35\n[[layers]]\nfolder = "a"\npriority = 1\n[output]\npath = "o.tif"\n'
    p = tmp_path / "cell.toml"
    p.write_text(good)
    cfg = cell_run.load_config(str(p))
    assert cfg.box == (35.0, 33.0, 36.0, 34.0) and cfg.layers[0].folder == str(tmp_path / "a")
    for bad in (good + 'typo = 1\n', good.replace("west_lon = 35", "west_lon = 35\nx = 1"),
                good + '[[layers]]\nfolder = "b"\npriority = 1\n', good.replace("south_lat = 33", "south_lat = 60"),
                good.replace("priority = 1", "priority = 0"), good + "[classify]\nmax_mosaic_side = 5\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            cell_run.load_config(str(p))


def scene(seed=0):
    a = painted((48, 60), [((0, 16, 0, 60), (40, 130, 45)), ((16, 32, 0, 60), (232, 200, 176))], base=(105, 70, 36))
    return np.clip(a + np.random.default_rng(seed).integers(-5, 6, a.shape), 0, 255)


def test_natural_materials_are_recovered(spark):
    a = scene()
    a[:, 40:, 50:] = 2
    out = mm.classify(image(spark, a), dims(spark, 48, 60), mm.Options(tile=32, smoothing="median_2", train_pixels=1500))
    names = {(r["row"], r["col"]): r["material"] for r in out.collect()}
    assert names[(5, 5)] == "BM_VEGETATION" and names[(24, 30)] == "BM_SAND" and names[(38, 10)] == "BM_SOIL"
    assert names[(45, 55)] is None
    assert out.filter("row >= 40 and col >= 50").agg(F.sum(F.col("r") + F.col("g") + F.col("b"))).first()[0] == 0


def given_model(spark, px, opts):
    feats = mm.features(px, opts)
    names = mm.feature_names(opts)
    scaler = cluster.fit_scaler(feats, names)
    raw = [(40, 130, 45, 3, .5, .6), (232, 200, 176, 3, -.05, .25), (105, 70, 36, 3, -.2, .6)]
    return feats, mm.Model(tuple(names), scaler, tuple(tuple((v - scaler[f][0]) / scaler[f][1] for f, v in zip(names, c)) for c in raw))


@pytest.mark.parametrize("smoothing", ["none", "median_3"])
def test_tile_form_equals_pixel_form(spark, smoothing):
    opts = mm.Options(tile=16, smoothing=smoothing)
    px = image(spark, scene(3))
    feats, model = given_model(spark, px, opts)
    rel = grid(mm.label(feats, model, opts), "cluster", (48, 60))
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], 16, dims(spark, 48, 60))
    til = grid(tiles.tiles_to_pixels(mm.score_tiles(packed, model, opts), ["cluster"]), "cluster", (48, 60))
    assert (rel == til).all()


def test_batch_shares_one_table(spark):
    px = image(spark, scene(1), "a").unionByName(image(spark, scene(2), "b"))
    out = mm.classify_batch(px, mm.Options(tile=32, train_pixels=2000))
    per = {(r["raster_id"], r["cluster"]): r["material"] for r in out.select("raster_id", "cluster", "material").distinct().collect()}
    assert {k[1]: v for k, v in per.items() if k[0] == "a"} == {k[1]: v for k, v in per.items() if k[0] == "b"}
    assert sorted(set(per.values())) == ["BM_SAND", "BM_SOIL", "BM_VEGETATION"]


def test_tiles_train_and_score(spark):
    """Window training finds the planted materials, in stored tiles from end to end."""
    packed = tiles.pixels_to_tiles(image(spark, scene(1), "a").unionByName(image(spark, scene(2), "b")), ["r", "g", "b"], 16,
                                   dims(spark, 48, 60, "a").unionByName(dims(spark, 48, 60, "b")))
    opts = mm.Options(tile=16, train_pixels=3000)
    model = mm.train_tiles(packed, opts, window=12)
    labels, named = mm.classify_tiles(packed, opts, model)
    got = {(r["raster_id"], r["row"], r["col"]): r["cluster"] for r in tiles.tiles_to_pixels(labels, ["cluster"]).collect()}
    at = lambda rid, y, x: named.materials[got[(rid, y, x)] - 1]
    for rid in "ab":
        assert [at(rid, 5, 20), at(rid, 24, 30), at(rid, 40, 10)] == ["BM_VEGETATION", "BM_SAND", "BM_SOIL"]


def test_cell_run(spark):
    """Two sources on one cell; the first layer wins, buildings win over roads, shares add up."""
    cfg = cell_run.CellConfig(33, 35, (cell_run.Layer("/a", 1), cell_run.Layer("/b", 2)), "/o.tif", max_side=400)
    low, high = scene(1), scene(2)
    high[:, :, 30:] = 0
    px = image(spark, low, "low").unionByName(image(spark, high, "high")).withColumnRenamed("raster_id", "path")
    step = 1 / 400
    src = spark.createDataFrame([(n, p, 35.0 + 10 * step, 34.0 - 20 * step, 35.0 + 70 * step, 34.0 - 68 * step, step, step, step)
                                 for n, p in (("high", 1), ("low", 2))],
                                "path string, priority int, west double, north double, east double, south double, px double, px_x double, px_y double")
    img, w, h, gsd = cell_run.mosaic(px, src, cfg)
    assert (w, h) == (400, 400)
    for k, n in enumerate("rgb"):
        got = grid(img, n, (400, 400))
        assert (got[20:68, 10:40] == high[k][:, :30]).all() and (got[20:68, 40:70] == low[k][:, 30:]).all()
    cells = img.select("raster_id", "row", "col")
    roads, bld = cells.filter("row between 30 and 33"), cells.filter("row between 32 and 35 and col < 30")
    index, hist = cell_run.run_cell(px, src, cfg, [(bld, "BM_CONCRETE", "shapefile"), (roads, "BM_ASPHALT", "shapefile")],
                                    mm.Options(tile=64, train_pixels=2000))
    n = {r["cmix"]: r["n_px"] for r in hist.collect()}
    assert sum(n.values()) == 400 * 400 and n[0] == 400 * 400 - 48 * 60 and n[2] == 4 * 20 and n[1] == 4 * 60 - 2 * 20 and {3, 5, 6} <= set(n)
    assert hist.agg(F.sum("pct")).first()[0] == pytest.approx(100.0)
    assert index.count() == 400 * 400 and index.filter("cmix > 0").count() == 48 * 60


def test_arrivals_are_scored_once(spark, tmp_path):
    opts = mm.Options(tile=16)
    px = image(spark, scene(1), "a")
    _, model = given_model(spark, px, opts)
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    pack = lambda rid, seed: tiles.pixels_to_tiles(image(spark, scene(seed), rid), ["r", "g", "b"], 16,
                                                   dims(spark, 48, 60, rid)).coalesce(1)
    pack("a", 1).write.mode("append").parquet(src)
    score_arrivals(spark, src, out, model, opts, chk).awaitTermination()
    assert spark.read.parquet(out).select("raster_id").distinct().count() == 1
    pack("b", 2).write.mode("append").parquet(src)
    score_arrivals(spark, src, out, model, opts, chk).awaitTermination()
    score_arrivals(spark, src, out, model, opts, chk).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 * 12 and got.select("raster_id", "tile_row", "tile_col").distinct().count() == 24


def test_checkpoint_folder_comes_from_the_session(spark):
    assert stats.cut_lineage(spark.range(3)).count() == 3
    assert CLASS_RGB["BM_WATER"] == (28, 107, 160)


def test_manifest_run_in_tiles(spark, tmp_path):
    """From a manifest to the written pair: only new files are read again, finished runs are not repeated."""
    from groundcover.plans import tile_run
    step, h, w = 1 / 400, 48, 60
    for name in ("a/high.tif", "b/low.tif"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(b"x")
    text = ('[geocell]\nsouth_lat = 33\nwest_lon = 35\n[[layers]]\nfolder = "a"\npriority = 1\n[[layers]]\nfolder = "b"\npriority = 2\n'
            '[output]\npath = "out"\n')
    (tmp_path / "cell.toml").write_text(text)
    cfg = cell_run.load_config(str(tmp_path / "cell.toml"))
    low, high = scene(1), scene(2)
    high[:, :, 30:] = 0
    asked = []

    def read_headers(found):
        asked.append(found.count())
        return found.select("path", "size", "mtime", "priority", F.lit(4326).alias("epsg"), F.lit(w).alias("width"), F.lit(h).alias("height"),
                            F.lit(35.0 + 10 * step).alias("west"), F.lit(34.0 - 20 * step).alias("north"),
                            F.lit(step).alias("xres"), F.lit(step).alias("yres"))

    def read_tiles(sources):
        paths = {p.rsplit("/", 1)[1]: p for p in (r["path"] for r in sources.select("path").collect())}
        both = [tiles.pixels_to_tiles(image(spark, a, paths[n]), ["r", "g", "b"], 16, dims(spark, h, w, paths[n]))
                for n, a in (("high.tif", high), ("low.tif", low)) if n in paths]
        return both[0].unionByName(both[1])

    opts = mm.Options(tile=64)
    _, model = given_model(spark, image(spark, scene(1), "a"), opts)
    index, hist = tile_run.run_manifest(spark, cfg, read_headers, read_tiles, opts=opts, model=model)
    n = {r["cmix"]: r["n_px"] for r in hist.collect()}
    assert sum(n.values()) == 400 * 400 and n[0] == 400 * 400 - h * w and {3, 5, 6} <= set(n)
    px = tiles.tiles_to_pixels(index, ["cmix"], drop_blank=True)
    assert px.count() == h * w and asked == [2]
    assert spark.read.text(str(tmp_path / "out/materials")).filter("value like '%Composite_Material index%'").count() == 7
    tile_run.run_manifest(spark, cfg, read_headers, read_tiles, opts=opts, model=model)
    assert asked == [2]
    (tmp_path / "a/high.tif").write_bytes(b"xyz")
    with pytest.raises(FileExistsError):
        tile_run.run_manifest(spark, cfg, read_headers, read_tiles, opts=opts, model=model)
    (tmp_path / "cell.toml").write_text(text + "overwrite = true\n")
    again = cell_run.load_config(str(tmp_path / "cell.toml"))
    mask = tiles.pixels_to_tiles(px.filter("row between 30 and 33").withColumn("raster_id", F.lit("cell")).withColumn("m", F.lit(1)),
                                 ["m"], 64, dims(spark, 400, 400, "cell"))
    rid = index.first()["raster_id"]
    _, hist = tile_run.run_manifest(spark, again, read_headers, read_tiles, [(mask.withColumn("raster_id", F.lit(rid)), "BM_ASPHALT")], opts, model)
    n = {r["cmix"]: r["n_px"] for r in hist.collect()}
    assert asked == [2, 1] and n[1] == 4 * w and sum(n.values()) == 400 * 400


def test_published_runs(spark, tmp_path):
    """A run that dies leaves the published one whole, goes on where it stopped, and appears at once."""
    from groundcover.plans import tile_run
    step, h, w = 1 / 400, 48, 60
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.tif").write_bytes(b"x")
    text = '[geocell]\nsouth_lat = 33\nwest_lon = 35\n[[layers]]\nfolder = "a"\npriority = 1\n[classify]\nwater_mask = "w.tif"\n[output]\npath = "out"\noverwrite = true\n'
    (tmp_path / "cell.toml").write_text(text)
    cfg = cell_run.load_config(str(tmp_path / "cell.toml"))
    calls, fail = [], []

    def read_headers(found):
        calls.append("headers")
        return found.select("path", "size", "mtime", "priority", F.lit(4326).alias("epsg"), F.lit(w).alias("width"), F.lit(h).alias("height"),
                            F.lit(35.0 + 10 * step).alias("west"), F.lit(34.0 - 20 * step).alias("north"),
                            F.lit(step).alias("xres"), F.lit(step).alias("yres"))

    def read_tiles(sources):
        calls.append("tiles")
        path = sources.select("path").first()[0]
        return tiles.pixels_to_tiles(image(spark, scene(1), path), ["r", "g", "b"], 16, dims(spark, h, w, path))

    def read_mask(path):
        if fail:
            raise fail.pop()
        cells = spark.range(60).select(F.lit("cell").alias("raster_id"), F.lit(22).alias("row"), (F.col("id") + 10).cast("int").alias("col"), F.lit(1).alias("m"))
        return tiles.pixels_to_tiles(cells, ["m"], 64, spark.createDataFrame([("cell", 400, 400)], "raster_id string, raster_h int, raster_w int"))

    opts = mm.Options(tile=64)
    run = lambda o=opts: tile_run.run_manifest(spark, cfg, read_headers, read_tiles, opts=o, read_mask=read_mask)
    with pytest.raises(ValueError, match="water mask"):
        tile_run.run_manifest(spark, cfg, read_headers, read_tiles, opts=opts)
    _, hist = run()
    first = {r.cmix: r.n_px for r in hist.collect()}
    assert first[tile_run.CMIX["BM_WATER"]] == 60 and sum(first.values()) == 400 * 400 and calls == ["headers", "tiles"]
    other = mm.Options(tile=64, smoothing="median_1")
    fail.append(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        run(other)
    assert {r.cmix: r.n_px for r in tile_run.published(spark, cfg.output)[1].collect()} == first
    # the first settings are still the published run: nothing is read again
    calls.clear()
    assert {r.cmix: r.n_px for r in run()[1].collect()} == first and calls == []
    # the other run goes on after the mosaic and its model
    index, hist = run(other)
    assert calls == [] and {r.cmix: r.n_px for r in tile_run.published(spark, cfg.output)[1].collect()} == {r.cmix: r.n_px for r in hist.collect()}
    assert tile_run._current(spark, cfg.output) != tile_run.signature(tile_run.discover(spark, cfg), cfg, opts)
    # content that no run wrote is not touched
    (tmp_path / "out2").mkdir()
    (tmp_path / "out2/index").write_text("mine")
    (tmp_path / "cell.toml").write_text(text.replace('"out"', '"out2"').replace("overwrite = true\n", ""))
    cfg = cell_run.load_config(str(tmp_path / "cell.toml"))
    with pytest.raises(FileExistsError, match="no run wrote"):
        run()


def test_work_on_few_bytes_is_not_merged_into_one_task(spark):
    from groundcover.operators import runs
    px = spark.range(4000).selectExpr("'r' as raster_id", "cast(id / 40 as int) as row", "cast(id % 40 as int) as col", "1 + id % 7 % 2 as v")
    packed = tiles.pixels_to_tiles(px, ["v"], 8, spark.createDataFrame(
        [("r", 100, 40)], "raster_id string, raster_h int, raster_w int"))
    labels = runs.label_runs(runs.tile_runs(packed), 8, 4, ("raster_id", "value"))
    for df in (runs.hulls(labels, ("raster_id", "value")), runs.with_sums(labels, packed, ["n"], lambda bands: [bands[0] > 0])):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert runs.run_stats(labels, ("raster_id", "value")).agg(F.sum("area")).first()[0] == 4000
