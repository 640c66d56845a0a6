"""Queries on scans, discovery, footprints, vectors and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LEGACY_PARENT, RASTER_SUFFIXES, BATCH_SUFFIXES
from ..functions import geo
from ..functions.naming import literal_map
from ..operators import overlay, tiles, vector
from ..operators.calibrate import expand_palette
from ..sources import files, profiles, rasters, vectors
from .registry import query
from .views import table, view

TILE = 32


def dims_of(px):
    return px.groupBy("raster_id").agg((F.max("row") + 1).alias("raster_h"), (F.max("col") + 1).alias("raster_w"))


@query("a1_full_scan", """
SELECT raster_id, cast(floor(row/32) as int) AS tile_row, cast(floor(col/32) as int) AS tile_col, count(*) AS n_px,
       cast(sum(r) as bigint) AS sum_r, cast(sum(g) as bigint) AS sum_g, cast(sum(b) as bigint) AS sum_b,
       cast(sum(nir) as bigint) AS sum_nir
FROM pixel GROUP BY 1, 2, 3""", ["pixel"])
def a1(spark, sf):
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b", "nir"], TILE, dims_of(px))
    back = tiles.tiles_to_pixels(packed, ["r", "g", "b", "nir"])
    return back.groupBy("raster_id", F.floor(F.col("row") / TILE).cast("int").alias("tile_row"),
                        F.floor(F.col("col") / TILE).cast("int").alias("tile_col")).agg(
        F.count("*").alias("n_px"), *[F.sum(c).alias(f"sum_{c}") for c in ("r", "g", "b", "nir")])


@query("a2_window_scan", """
SELECT raster_id, row, col, r, g, b FROM scene WHERE row >= 5 AND row < 14 AND col >= 20 AND col < 60""", ["scene"])
def a2(spark, sf):
    px = view(spark, sf, "scene")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], 16, dims_of(px))
    near = tiles.read_window(packed, None, 5, 20, 9, 40)
    out = tiles.tiles_to_pixels(near, ["r", "g", "b"])
    return out.filter("row >= 5 AND row < 14 AND col >= 20 AND col < 60")


_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@query("a3_folder_scan", f"""
SELECT path, regexp_replace(path, '^/data/', '') AS relative_path, {_SUFFIX} AS suffix FROM listing
WHERE {_SUFFIX} IN ('.tif','.tiff','.jpg','.jpeg','.png','.img','.bmp','.jp2','.ecw','.sid')""", ["listing"])
def a3(spark, sf):
    from ..functions.naming import file_suffix
    found = files.with_suffix(view(spark, sf, "listing"), RASTER_SUFFIXES)
    return found.select("path", files.relative_path("path", "/data").alias("relative_path"),
                        file_suffix("path").alias("suffix"))


@query("a4_batch_scan", f"""
SELECT path FROM listing WHERE {_SUFFIX} IN ('.tif','.tiff','.jpg','.jpeg') ORDER BY path""", ["listing"])
def a4(spark, sf):
    return files.with_suffix(view(spark, sf, "listing"), BATCH_SUFFIXES).select("path").orderBy("path")


@query("a5_layer_discovery", """
SELECT DISTINCT path FROM listing
WHERE (lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff' OR lower(path) LIKE '%.jp2' OR path LIKE '%img1%')
  AND path NOT LIKE '%\\_mosaic\\_tiles/%' ESCAPE '\\' AND path NOT LIKE '%\\_classified\\_tiles/%' ESCAPE '\\'
  AND path NOT LIKE '%\\_with\\_vectors\\_tiles/%' ESCAPE '\\'""", ["listing"])
def a5(spark, sf):
    ls = view(spark, sf, "listing")
    globs = [ls.filter(F.lower("path").endswith(s)) for s in (".tif", ".tiff", ".jp2")]
    globs.append(ls.filter(F.col("path").contains("img1")))
    return files.require_rows(files.union_matches(globs), "layer matched no files")


@query("a6_flat_sources", """
SELECT path, priority FROM footprint
UNION ALL SELECT c_name AS path, (SELECT max(priority)+1 FROM footprint) AS priority FROM customer""", ["footprint"])
def a6(spark, sf):
    flat = table(spark, sf, "customer").select(F.col("c_name").alias("path"))
    return files.add_flat_sources(view(spark, sf, "footprint"), flat)


_MERC = "20037508.34e0"


def _lon(x):
    return f"case when epsg=3857 then ({x})/{_MERC}*180e0 else {x} end"


def _lat(y):
    return f"case when epsg=3857 then degrees(2e0*atan(exp(({y})/{_MERC}*pi()))-pi()/2e0) else {y} end"


_FOOT = f"""b AS (SELECT path, priority, width, height, {_lon('west')} AS w, {_lat('north-height*yres')} AS s,
  {_lon('west+width*xres')} AS e, {_lat('north')} AS n FROM raster)"""


@query("a7_footprint_read", f"""
WITH {_FOOT} SELECT path, priority, round(w,8) AS west, round(s,8) AS south, round(e,8) AS east, round(n,8) AS north,
  round(greatest((e-w)/width, (n-s)/height),10) AS px FROM b""", ["raster"])
def a7(spark, sf):
    f = rasters.footprints(view(spark, sf, "raster"))
    return f.select("path", "priority", *[F.round(c, 8).alias(c) for c in ("west", "south", "east", "north")],
                    F.round("px", 10).alias("px"))


@query("a8_footprint_cache", """
SELECT f.path, f.size, EXISTS (SELECT 1 FROM cached_stat c WHERE c.path=f.path AND c.size=f.size AND c.mtime=f.mtime) AS cache_hit
FROM file_stat f""", ["file_stat", "cached_stat"])
def a8(spark, sf):
    return files.flag_cached(view(spark, sf, "file_stat"), view(spark, sf, "cached_stat")).select("path", "size", "cache_hit")


@query("a9_raster_info", """
SELECT raster_id, width, height, n_bands, 'uint8' AS dtype, concat('EPSG:', epsg) AS crs, epsg, west AS left_x,
  round(north-height*yres,8) AS bottom_y, round(west+width*xres,8) AS right_x, north AS top_y FROM raster""", ["raster"])
def a9(spark, sf):
    i = rasters.raster_info(view(spark, sf, "raster"))
    return i.select("raster_id", "width", "height", "n_bands", "dtype", "crs", "epsg", F.col("left").alias("left_x"),
                    F.round("bottom", 8).alias("bottom_y"), F.round("right", 8).alias("right_x"),
                    F.col("top").alias("top_y"))


def rect_features(spark, sf):
    """Rectangles inset by a quarter pixel, as rings."""
    r = view(spark, sf, "rect")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = F.col("x") + 0.25, F.col("y") + 0.25
    x1, y1 = F.col("x") + F.col("w") - 0.25, F.col("y") + F.col("h") - 0.25
    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
    return vector.with_bbox(r.select("layer", "feature_id", "fid", F.lit("polygon").alias("kind"), F.array(ring).alias("rings")))


@query("a10_vector_bbox", """
SELECT layer, feature_id FROM rect WHERE x+0.25 <= 60.25 AND x+w-0.25 >= 20.25 AND y+0.25 <= 50.75 AND y+h-0.25 >= 10.75""",
       ["rect"])
def a10(spark, sf):
    return vectors.read_bbox(rect_features(spark, sf), 20.25, 10.75, 60.25, 50.75).select("layer", "feature_id")


_EXTRACT = """t AS (SELECT i AS cell_y, j AS cell_x FROM generate_series(0,9) a(i), generate_series(0,9) c(j)),
m AS (SELECT layer, feature_id, cast(cell_x as int) AS cell_x, cast(cell_y as int) AS cell_y FROM rect, t
 WHERE x+0.25 <= (cell_x+1)*10 AND x+w-0.25 >= cell_x*10 AND y+0.25 <= (cell_y+1)*10 AND y+h-0.25 >= cell_y*10)"""


@query("a11_tiled_extract", f"WITH {_EXTRACT} SELECT * FROM m", ["rect"])
def a11(spark, sf):
    out = vectors.tiled_extract(rect_features(spark, sf), 0.0, 0.0, 10.0, 10, 10)
    return out.select("layer", "feature_id", "cell_x", "cell_y")


@query("a11_distinct_extract", f"WITH {_EXTRACT} SELECT DISTINCT layer, feature_id FROM m", ["rect"])
def a11d(spark, sf):
    return vectors.tiled_extract(rect_features(spark, sf), 0.0, 0.0, 10.0, 10, 10, distinct=True).select("layer", "feature_id")


@query("a12_layer_profile", """
WITH req AS (SELECT DISTINCT c_mktsegment AS layer FROM customer UNION SELECT r_name FROM region),
s AS (SELECT layer, count(*) AS n, min(x)+0.25e0 AS minx, min(y)+0.25e0 AS miny, max(x+w)-0.25e0 AS maxx, max(y+h)-0.25e0 AS maxy FROM rect GROUP BY 1)
SELECT req.layer, n, minx, miny, maxx, maxy, n IS NOT NULL AS ok FROM req LEFT JOIN s ON s.layer=req.layer""", ["rect"])
def a12(spark, sf):
    req = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("layer")).union(
        table(spark, sf, "region").select("r_name")).distinct()
    return vectors.profile_layers(rect_features(spark, sf), req).drop("kind")


def osm_docs(spark, sf):
    """One document per customer: a way with 1..6 points, closed for every third, and a relation for some."""
    c = table(spark, sf, "customer")
    n = (F.col("c_custkey") % 6 + 1).cast("int")
    pt = lambda i: F.struct((i * 0.5 + F.col("c_nationkey")).alias("lat"), (i * i * 0.25 + F.col("c_custkey")).cast("double").alias("lon"))
    path = F.transform(F.sequence(F.lit(0), n - 1), pt)
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(path, F.slice(path, 1, 1))).otherwise(path)
    tags = F.map_filter(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("rare"),
                                     F.when(F.col("c_custkey") % 50 == 0, F.lit("yes"))), lambda k, v: v.isNotNull())
    way = F.struct(F.lit("way").alias("type"), F.col("c_custkey").alias("id"), tags.alias("tags"), path.alias("geometry"),
                   F.array().cast("array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>").alias("members"))
    member = F.struct(F.lit("way").alias("type"),
                      F.when(F.col("c_custkey") % 4 == 0, "inner").otherwise("outer").alias("role"), path.alias("geometry"))
    rel = F.struct(F.lit("relation").alias("type"), (F.col("c_custkey") + 10_000_000).alias("id"), tags.alias("tags"),
                   F.array().cast("array<struct<lat:double,lon:double>>").alias("geometry"), F.array(member).alias("members"))
    els = F.when(F.col("c_custkey") % 2 == 0, F.array(way, rel)).otherwise(F.array(way))
    return c.select(F.to_json(F.struct(els.alias("elements"))).alias("json"))


_OSM = """w AS (SELECT c_custkey AS k, cast(c_custkey%6+1 as int) AS n, c_custkey%3=0 AS loop, c_nationkey FROM customer),
c AS (SELECT *, n + case when loop then 1 else 0 end AS pts, loop OR n = 1 AS closed FROM w),
f AS (SELECT k AS osm_id, pts + case when closed then 0 else 1 end AS n_points, cast(k as double) AS first_x FROM c
      WHERE pts >= 2 AND pts + case when closed then 0 else 1 end >= 4
      UNION ALL SELECT k + 10000000, pts + case when closed then 0 else 1 end, cast(k as double) FROM c
      WHERE k%2=0 AND k%4<>0 AND pts >= 3)"""


@query("a13_osm_features", f"WITH {_OSM} SELECT * FROM f", [])
def a13(spark, sf):
    f = vectors.parse_osm(osm_docs(spark, sf), "polygon")
    ring = F.element_at("rings", 1)
    return f.select("osm_id", F.size(ring).alias("n_points"), F.element_at(ring, 1)["x"].alias("first_x"))


@query("a13_frequent_tags", f"""WITH {_OSM}, t AS (SELECT 'segment' AS tag, osm_id FROM f
 UNION ALL SELECT 'rare', osm_id FROM f WHERE (osm_id%10000000)%50=0)
SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= (SELECT count(*) FROM f) * 0.05e0""", [])
def a13t(spark, sf):
    return vectors.frequent_tags(vectors.parse_osm(osm_docs(spark, sf), "polygon"))


@query("a14_water_mask", """
SELECT raster_id, row, col FROM pixel WHERE (case when blk=4 then 1 when blk=5 then 255 else 0 end) > 0
 AND (case when blk=4 then 1 when blk=5 then 255 else 0 end) <> 255""", ["pixel"])
def a14(spark, sf):
    band = F.when(F.col("blk") == 4, 1).when(F.col("blk") == 5, 255).otherwise(0)
    return overlay.mask_from_raster(view(spark, sf, "pixel").withColumn("value", band), "value", F.lit(255))


@query("a15_palette_expand", """
WITH cm AS (SELECT n_nationkey AS idx, (n_nationkey*37)%256 AS r, (n_nationkey*91)%256 AS g, (n_nationkey*53)%256 AS b FROM nation)
SELECT raster_id, row, p.col, cast(r0 as int) AS idx, coalesce(cm.r,0) AS r, coalesce(cm.g,0) AS g, coalesce(cm.b,0) AS b
FROM (SELECT raster_id, row, col, r%31 AS r0 FROM pixel) p LEFT JOIN cm ON cm.idx = p.r0""", ["pixel"])
def a15(spark, sf):
    k = F.col("n_nationkey")
    cm = table(spark, sf, "nation").select(k.alias("idx"), (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"),
                                           (k * 53 % 256).alias("b"))
    px = view(spark, sf, "pixel").select("raster_id", "row", "col", (F.col("r") % 31).alias("idx"))
    return expand_palette(px, cm)


NAMES = [*LEGACY_PARENT, "BM_ASPHALT", "BM_CONCRETE", "BM_VEGETATION", "BM_WATER", "BM_SAND", "BM_SOIL"]


def user_materials(spark, sf):
    """Thirteen materials per profile; a profile is a run of thirteen parts."""
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % 13 + 1).cast("int"))
    a = F.array(F.col("p_size"), (F.col("p_partkey") % 200).cast("int"), F.lit(7))
    both = F.array(a, F.array(F.lit(1), (F.floor(F.col("p_partkey") / 13) % 5).cast("int"), F.lit(3)))
    anchors = F.when(F.col("p_partkey") % 11 != 0, F.when(F.col("p_partkey") % 2 == 0, F.array(a)).otherwise(both))
    return table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 13).alias("profile"),
        F.when(F.floor(F.col("p_partkey") / 13) % 4 == 0, 3).otherwise(2).alias("version"), name.alias("material"),
        anchors.alias("anchors"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("tolerance_radius"))


_NAME_CASE = "case p_partkey%13 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end"
_PARENT_CASE = "case material " + " ".join(f"when '{k}' then '{v}'" for k, v in LEGACY_PARENT.items()) + " end"
_USER = f"""u AS (SELECT cast(floor(p_partkey/13) as bigint) AS profile, case when cast(floor(p_partkey/13) as bigint)%4=0 then 3 else 2 end AS version,
 {_NAME_CASE} AS material, p_partkey%11<>0 AS good,
 concat(p_size, ',', p_partkey%200, ',7') AS a1, case when p_partkey%2=1 then concat('1,', cast(floor(p_partkey/13) as bigint)%5, ',3') end AS a2,
 case when p_size > 25 then p_size end AS tol FROM part),
m AS (SELECT *, {_PARENT_CASE} AS parent FROM u)"""


@query("a16_profile_migrate", f"""WITH {_USER},
k AS (SELECT profile, case when version<3 and parent is not null then parent else material end AS material, version, good, a1, a2,
      version<3 AND parent IS NOT NULL AS moved FROM m),
x AS (SELECT * FROM k WHERE NOT moved OR good),
l AS (SELECT profile, material, a1 AS a FROM x WHERE good UNION SELECT profile, material, a2 FROM x WHERE good AND a2 IS NOT NULL),
g AS (SELECT DISTINCT profile, material, 3 AS version FROM x)
SELECT g.profile, g.material, g.version, count(l.a) AS n_anchors, coalesce(string_agg(l.a, ';' ORDER BY l.a), '') AS anchors
FROM g LEFT JOIN l USING (profile, material) GROUP BY 1,2,3""", [])
def a16m(spark, sf):
    out = profiles.migrate(user_materials(spark, sf), ["profile"])
    text = F.transform("anchors", lambda a: F.array_join(a.cast("array<string>"), ","))
    return out.select("profile", "material", "version", F.size("anchors").cast("long").alias("n_anchors"),
                      F.array_join(F.array_sort(text), ";").alias("anchors"))


@query("a16_profile_merge", f"""WITH {_USER},
p AS (SELECT DISTINCT profile FROM u),
f AS (SELECT profile, material, tol FROM p, (VALUES ('BM_ASPHALT',34),('BM_CONCRETE',38),('BM_VEGETATION',50),('BM_WATER',34),('BM_SAND',34),('BM_SOIL',34)) v(material,tol)),
q AS (SELECT profile, material, tol FROM u)
SELECT coalesce(q.profile,f.profile) AS profile, coalesce(q.material,f.material) AS material, coalesce(q.tol,f.tol) AS tolerance_radius
FROM f FULL OUTER JOIN q ON q.profile=f.profile AND q.material=f.material""", [])
def a16(spark, sf):
    user = user_materials(spark, sf).select("profile", "material", "tolerance_radius")
    fixed = {"BM_ASPHALT": 34, "BM_CONCRETE": 38, "BM_VEGETATION": 50, "BM_WATER": 34, "BM_SAND": 34, "BM_SOIL": 34}
    entries = F.explode(F.map_entries(literal_map(fixed))).alias("e")
    factory = user.select("profile").distinct().select("profile", entries).select(
        "profile", F.col("e.key").alias("material"), F.col("e.value").alias("tolerance_radius"))
    return profiles.merge(factory, user, ["tolerance_radius"], ["profile"])


@query("a17_legacy_names", f"""WITH {_USER}
SELECT profile, material, coalesce(parent, material) AS current_name FROM m""", [])
def a17(spark, sf):
    m = user_materials(spark, sf)
    legacy = profiles.legacy_names(profiles.class_dim(spark))
    return m.join(F.broadcast(legacy), m["material"] == legacy["legacy"], "left").select(  # seven fixed names
        "profile", "material", F.coalesce("parent", "material").alias("current_name"))


@query("d4_drop_empty", """
SELECT layer, feature_id FROM rect WHERE fid%5 NOT IN (0, 1)""", ["rect"])
def d4(spark, sf):
    f = rect_features(spark, sf)
    rings = F.when(F.col("fid") % 5 == 0, F.lit(None)).when(
        F.col("fid") % 5 == 1, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.col("rings"))
    return vector.drop_empty(f.withColumn("rings", rings)).select("layer", "feature_id")


@query("g2_cell_sources", """
SELECT path, priority, west, south, east, north FROM footprint WHERE west < 36 AND east > 35 AND south < 34 AND north > 33""",
       ["footprint"])
def g2(spark, sf):
    return rasters.touching_cell(view(spark, sf, "footprint"), 35, 33, 36, 34).select(
        "path", "priority", "west", "south", "east", "north")


@query("h9_priority_summary", """
SELECT priority, count(*) AS n_files, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north
FROM footprint GROUP BY priority""", ["footprint"])
def h9(spark, sf):
    return rasters.summary_by_priority(view(spark, sf, "footprint"))


@query("f1_target_resolution", "SELECT min(case when px>0.0006 then px end) AS gsd FROM footprint", ["footprint"])
def f1(spark, sf):
    return rasters.finest_pixel(view(spark, sf, "footprint").withColumn(
        "px", F.when(F.col("px") > 0.0006, F.col("px")).otherwise(F.lit(-1.0))))


@query("f14_union_extent", """
SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, count(*) AS n_rasters, min(path) AS first FROM footprint""",
       ["footprint"])
def f14(spark, sf):
    return rasters.union_extent(view(spark, sf, "footprint"))


@query("k1_distinct_matches", """
SELECT path FROM listing WHERE lower(path) LIKE '%.tif' UNION SELECT path FROM listing WHERE path LIKE '%img2%'""", ["listing"])
def k1(spark, sf):
    ls = view(spark, sf, "listing").select("path")
    return ls.filter(F.lower("path").endswith(".tif")).union(ls.filter(F.col("path").contains("img2"))).distinct()


@query("g11_concat_layers", """
SELECT feature_id, x, cast(null as int) AS width_val FROM rect
UNION ALL SELECT concat('p', fid), x, width_val FROM road""", ["rect", "road"])
def g11(spark, sf):
    rd = view(spark, sf, "road")
    return vectors.concat_layers([view(spark, sf, "rect").select("feature_id", "x"),
                                  rd.select(F.concat(F.lit("p"), "fid").alias("feature_id"), "x", "width_val")])


@query("k2_concat_tiles", """
SELECT feature_id, cast(w as int) AS w, cast(null as varchar) AS type_val FROM rect WHERE x < 45
UNION ALL SELECT concat('p', fid), cast(null as int), type_val FROM road""", ["rect", "road"])
def k2(spark, sf):
    rd = view(spark, sf, "road")
    return vectors.concat_layers([view(spark, sf, "rect").filter("x < 45").select("feature_id", "w"),
                                  rd.select(F.concat(F.lit("p"), "fid").alias("feature_id"), "type_val")])


@query("c20_bounds_degrees", f"""
WITH {_FOOT} SELECT path, round(w,8) AS west, round(s,8) AS south, round(e,8) AS east, round(n,8) AS north FROM b""", ["raster"])
def c20(spark, sf):
    b = geo.bounds_wgs84("epsg", geo.bounds("west", "north", "xres", "yres", "width", "height"))
    return view(spark, sf, "raster").select("path", *[F.round(b[c], 8).alias(c) for c in ("west", "south", "east", "north")])
