"""Queries on grids, resampling, composites and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TXS_LIBRARY, TXS_LINES
from ..functions import color, geo, naming
from ..operators import chains, composite, export, focal, semantics, stats, tiles, vector
from ..operators.stats import attach_by, attach_scalar
from .q_pixels import KEYS, scaled_cte
from .q_sources import dims_of, rect_features
from .registry import query
from .views import table, view

TILE = 32
_K = "raster_id, row, col"


# --- grid maths --------------------------------------------------------------

@query("f2_grid_size", """
WITH a AS (SELECT path, px, greatest(1, cast(round_even(1e0/px,0) as int)) AS w0, greatest(1, cast(round_even(1e0/px,0) as int)) AS h0 FROM footprint),
u AS (SELECT *, case when greatest(w0,h0) > 1200 then px*(greatest(w0,h0)/1200e0) else px end AS gsd FROM a)
SELECT path, case when w0>1200 then greatest(1, cast(ceil(1e0/gsd) as int)) else w0 end AS width,
 case when h0>1200 then greatest(1, cast(ceil(1e0/gsd) as int)) else h0 end AS height, round(gsd,10) AS gsd FROM u""", ["footprint"])
def f2(spark, sf):
    g = geo.grid_size(F.lit(1.0), F.lit(1.0), "px", 1200)
    return view(spark, sf, "footprint").withColumn("_g", g).select(
        "path", F.col("_g.width").alias("width"), F.col("_g.height").alias("height"), F.round("_g.gsd", 10).alias("gsd"))


@query("f3_source_window", """
WITH a AS (SELECT path, greatest(west,35e0) AS iw, least(east,36e0) AS ie, greatest(south,33e0) AS js, least(north,34e0) AS jn FROM footprint),
c AS (SELECT *, greatest(0, least(cast(floor((iw-35e0)/0.002e0) as int)-1, 500)) AS c0, greatest(0, least(cast(ceil((ie-35e0)/0.002e0) as int)+1, 500)) AS c1,
 greatest(0, least(cast(floor((34e0-jn)/0.002e0) as int)-1, 500)) AS r0, greatest(0, least(cast(ceil((34e0-js)/0.002e0) as int)+1, 500)) AS r1 FROM a WHERE ie>iw AND jn>js)
SELECT path, c0 AS col0, r0 AS row0, c1-c0 AS w, r1-r0 AS h FROM c WHERE c1>c0 AND r1>r0""", ["footprint"])
def f3(spark, sf):
    win = geo.source_window(geo.box(), geo.lit_box(35, 33, 36, 34), F.lit(0.002), F.lit(500), F.lit(500))
    return view(spark, sf, "footprint").withColumn("_w", win).filter(F.col("_w").isNotNull()).select("path", "_w.*")


@query("f4_overview", """
SELECT path, case when 0.002e0/px >= 2 then (SELECT max(f) FROM (VALUES (2),(4),(8),(16)) v(f) WHERE f <= 0.002e0/px) end AS factor FROM footprint""",
       ["footprint"])
def f4(spark, sf):
    levels = F.array(*[F.lit(x) for x in (2, 4, 8, 16)])
    return view(spark, sf, "footprint").select("path", geo.overview_factor(levels, F.lit(0.002) / F.col("px")).alias("factor"))


@query("f5_area_average", """
WITH x AS (SELECT raster_id, r, g, b, t.ty AS trow, t2.tx AS tcol,
 (least((row+1)/2.5e0, t.ty+1)-greatest(row/2.5e0, t.ty))*(least((col+1)/3e0, t2.tx+1)-greatest(col/3e0, t2.tx)) AS wt
 FROM pixel, (SELECT unnest(generate_series(0, (SELECT cast(max(row) as int) FROM pixel))) AS ty) t,
 (SELECT unnest(generate_series(0, 99)) AS tx) t2
 WHERE t.ty = floor(row/2.5e0+1e-9) AND t2.tx = floor(col/3e0+1e-9)
 UNION ALL SELECT raster_id, r, g, b, floor(row/2.5e0+1e-9)+1, floor(col/3e0+1e-9), ((row+1)/2.5e0-(floor(row/2.5e0+1e-9)+1))*(1/3e0)
 FROM pixel WHERE (row+1)/2.5e0 > floor(row/2.5e0+1e-9)+1+1e-9)
SELECT raster_id, cast(trow as int) AS row, cast(tcol as int) AS col, round(sum(wt*r)/sum(wt),5) AS r, round(sum(wt*g)/sum(wt),5) AS g, round(sum(wt*b)/sum(wt),5) AS b
FROM x GROUP BY 1,2,3""", ["pixel"])
def f5(spark, sf):
    out = composite.area_average(view(spark, sf, "pixel"), ["r", "g", "b"], F.lit(3.0), F.lit(2.5), ["raster_id"])
    return out.select(*KEYS, *[F.round(c, 5).alias(c) for c in "rgb"])


_MH, _PI = "20037508.34e0", "3.141592653589793e0"
_F6 = f"""d AS (SELECT max(row)+1 AS h FROM pixel),
k AS (SELECT h, 3900000e0 AS west, 4000000e0 AS north, 3900000e0/{_MH}*180e0 AS lw, (3900000e0+100*30e0)/{_MH}*180e0 AS le,
 degrees(2e0*atan(exp(4000000e0/{_MH}*{_PI}))-{_PI}/2) AS ln, degrees(2e0*atan(exp((4000000e0-h*25e0)/{_MH}*{_PI}))-{_PI}/2) AS ls FROM d),
t AS (SELECT p.row AS trow, p.col AS tcol, lw+(p.col+0.5e0)*((le-lw)/100) AS lon, ln-(p.row+0.5e0)*((ln-ls)/h) AS lat, west, north FROM pixel p, k),
s AS (SELECT trow, tcol, cast(floor((lon*{_MH}/180e0-west)/30e0) as int) AS sc,
 cast(floor((north-ln(tan((90e0+lat)*{_PI}/360e0))*{_MH}/{_PI})/25e0) as int) AS sr FROM t)"""


def mercator_raster(px):
    return dims_of(px).select("raster_id", F.col("raster_h").alias("height"), F.col("raster_w").alias("width"),
                              F.lit(3857).alias("epsg"), F.lit(3900000.0).alias("west"), F.lit(4000000.0).alias("north"),
                              F.lit(30.0).alias("xres"), F.lit(25.0).alias("yres"))


@query("f6_nearest_reproject", f"""WITH {_F6}
SELECT p.raster_id, trow AS row, tcol AS col, p.r, p.g, p.b FROM s JOIN pixel p ON p.row=s.sr AND p.col=s.sc""", ["pixel"])
def f6(spark, sf):
    px = view(spark, sf, "pixel")
    return composite.mercator_to_degrees(px, mercator_raster(px), ["r", "g", "b"])


@query("f7_bilinear", """
WITH d AS (SELECT max(row)+1 AS h FROM pixel), t AS (SELECT row AS trow, col AS tcol, row*0.8e0+0.3e0 AS v, col*0.9e0+0.25e0 AS u, h FROM pixel, d),
n AS (SELECT trow, tcol, dy, dx, greatest(0, least(cast(floor(v) as int)+dy, h-1)) AS r0, greatest(0, least(cast(floor(u) as int)+dx, 99)) AS c0,
 (1-abs(v-floor(v)-dy))*(1-abs(u-floor(u)-dx)) AS wt FROM t, (VALUES (0),(1)) a(dy), (VALUES (0),(1)) c(dx))
SELECT p.raster_id, trow AS row, tcol AS col, round(sum(wt*p.r)/sum(wt),4) AS r, round(sum(wt*p.b)/sum(wt),4) AS b
FROM n JOIN pixel p ON p.row=n.r0 AND p.col=n.c0 WHERE wt>0 GROUP BY 1,2,3""", ["pixel"])
def f7(spark, sf):
    px = view(spark, sf, "pixel")
    t = attach_by(px.select(*KEYS), dims_of(px), ["raster_id"])
    out = composite.bilinear(px, t, F.col("col") * 0.9 + 0.25, F.col("row") * 0.8 + 0.3, F.col("raster_h"),
                             F.col("raster_w"), ["r", "b"])
    return out.select(*KEYS, F.round("r", 4).alias("r"), F.round("b", 4).alias("b"))


@query("f8_tile_windows", """
SELECT raster_id, cast(y as int) AS row0, cast(x as int) AS col0, cast(least(256, height-y) as int) AS h, cast(least(256, width-x) as int) AS w,
 concat(raster_id, '_tile_r', y, '_c', x) AS name
FROM raster, (SELECT unnest(generate_series(0, 1000, 224)) AS y) a, (SELECT unnest(generate_series(0, 1000, 224)) AS x) c WHERE y<height AND x<width""", ["raster"])
def f8(spark, sf):
    w = tiles.tile_windows(view(spark, sf, "raster"), 256, 32)
    return w.select("raster_id", "row0", "col0", "h", "w", naming.tile_name("raster_id", "row0", "col0").alias("name"))


@query("f8_read_write_windows", """
SELECT raster_id, cast(y as int) AS row0, cast(x as int) AS col0, cast(greatest(y-16,0) as int) AS read_row0, cast(greatest(x-16,0) as int) AS read_col0,
 cast(least(y+224+16,height)-greatest(y-16,0) as int) AS read_h, cast(least(x+224+16,width)-greatest(x-16,0) as int) AS read_w
FROM raster, (SELECT unnest(generate_series(0, 1000, 224)) AS y) a, (SELECT unnest(generate_series(0, 1000, 224)) AS x) c WHERE y<height AND x<width""", ["raster"])
def f8rw(spark, sf):
    w = tiles.read_write_windows(view(spark, sf, "raster"), 256, 32)
    return w.select("raster_id", "row0", "col0", "read_row0", "read_col0", "read_h", "read_w")


@query("f9_extract_tiles", """
WITH m AS (SELECT feature_id, x*1000 AS minx, y*1000 AS miny, (x+w*4)*1000 AS maxx, (y+h*4)*1000 AS maxy FROM rect),
t AS (SELECT *, unnest(generate_series(0, cast(ceil((maxy-miny)/5000e0) as int)-1)) AS iy FROM m),
u AS (SELECT *, unnest(generate_series(0, cast(ceil((maxx-minx)/5000e0) as int)-1)) AS ix FROM t)
SELECT feature_id, cast(ix as int) AS ix, cast(iy as int) AS iy, cast(minx+ix*5000 as double) AS x0, cast(miny+iy*5000 as double) AS y0,
 cast(least(maxx, minx+ix*5000+5000) as double) AS x1, cast(least(maxy, miny+iy*5000+5000) as double) AS y1 FROM u""", ["rect"])
def f9(spark, sf):
    b = view(spark, sf, "rect").select("feature_id", *[c.cast("double").alias(n) for n, c in (
        ("minx", F.col("x") * 1000), ("miny", F.col("y") * 1000), ("maxx", (F.col("x") + F.col("w") * 4) * 1000),
        ("maxy", (F.col("y") + F.col("h") * 4) * 1000))])
    return vector.extract_tiles(b, 5000.0).select("feature_id", "ix", "iy", "x0", "y0", "x1", "y1")


@query("f10_union_grid", """
SELECT min(west) AS west, min(north-height*yres) AS south, max(west+width*xres) AS east, max(north) AS north, min(xres) AS xres, min(yres) AS yres, 4326 AS epsg,
 cast(round_even((max(west+width*xres)-min(west))/min(xres),0) as int) AS width, cast(round_even((max(north)-min(north-height*yres))/min(yres),0) as int) AS height
FROM raster WHERE epsg=4326""", ["raster"])
def f10(spark, sf):
    t = view(spark, sf, "raster").filter("epsg = 4326").withColumn("south", F.col("north") - F.col("height") * F.col("yres"))
    return export.union_grid(t.withColumn("east", F.col("west") + F.col("width") * F.col("xres")))


_CELL = "cast(floor(row/16) as int) AS tile_row, cast(floor(col/16) as int) AS tile_col"


@query("f11_mosaic_jobs", f"""
WITH t AS (SELECT DISTINCT {_CELL} FROM pixel), e AS (SELECT DISTINCT tile_row, tile_col FROM t WHERE (tile_row+tile_col)%3=0),
c AS (SELECT {_CELL}, count(*) AS n FROM pixel WHERE blk<>5 AND blk<>0 GROUP BY 1,2)
SELECT t.tile_row, t.tile_col, case when e.tile_row IS NOT NULL then 'skip' when c.n>0 then 'write' else 'empty' end AS status, coalesce(c.n,0) AS covered_px
FROM t LEFT JOIN e USING (tile_row,tile_col) LEFT JOIN c USING (tile_row,tile_col)""", ["pixel"])
def f11(spark, sf):
    px = view(spark, sf, "pixel").withColumn("tile_row", F.floor(F.col("row") / 16).cast("int")).withColumn(
        "tile_col", F.floor(F.col("col") / 16).cast("int"))
    keys = ["tile_row", "tile_col"]
    all_tiles = px.select(*keys).distinct()
    done = all_tiles.filter((F.col("tile_row") + F.col("tile_col")) % 3 == 0)
    return composite.tile_jobs(all_tiles, done, px.filter("blk <> 5 AND blk <> 0"), keys)


@query("f12_grid_signature", """
WITH d AS (SELECT md5(concat_ws('|', path, size, epoch_us(mtime), path%3)) AS m FROM file_stat),
s AS (SELECT count(*) AS n, sum(cast(concat('0x', substr(m,1,8)) as bigint)) AS s1, sum(cast(concat('0x', substr(m,9,8)) as bigint)) AS s2 FROM d)
SELECT md5(concat_ws('|', '6000x6000', n, s1, s2)) AS signature, n AS n_sources FROM s""", ["file_stat"])
def f12(spark, sf):
    fs = view(spark, sf, "file_stat").select("path", "size", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime"),
                                             (F.col("path") % 3).alias("priority"))
    return composite.grid_signature(fs, "6000x6000")


@query("f12_stale_check", """
WITH d AS (SELECT md5(concat_ws('|', path, size, epoch_us(mtime), 1)) AS a FROM file_stat), e AS (SELECT md5(concat_ws('|', path, size, epoch_us(mtime), 1)) AS a FROM cached_stat)
SELECT (SELECT count(*) FROM (SELECT a FROM d EXCEPT SELECT a FROM e) x) + (SELECT count(*) FROM (SELECT a FROM e EXCEPT SELECT a FROM d) y) > 0 AS stale""", ["file_stat", "cached_stat"])
def f12s(spark, sf):
    def sig(name):
        v = view(spark, sf, name).select("path", "size", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime"),
                                         F.lit(1).alias("priority"))
        return composite.grid_signature(v, "g")
    old = sig("cached_stat").select("signature").scalar()
    return sig("file_stat").select((F.col("signature") != old).alias("stale"))


@query("f13_thumbnail", """
WITH d AS (SELECT max(row)+1 AS h, max(col)+1 AS w FROM pixel), k AS (SELECT h, w, greatest(1e0, greatest(h,w)/50e0) AS sc FROM d),
z AS (SELECT h/greatest(1, floor(h/sc)) AS fy, w/greatest(1, floor(w/sc)) AS fx FROM k),
x AS (SELECT p.*, floor(row/fy+1e-9) AS ty, floor(col/fx+1e-9) AS tx FROM pixel p, z)
SELECT raster_id, cast(ty as int) AS row, cast(tx as int) AS col, round(avg(r),4) AS r, round(avg(g),4) AS g, round(avg(b),4) AS b FROM x GROUP BY 1,2,3""", ["pixel"])
def f13(spark, sf):
    from ..operators.detect import thumbnail
    px = view(spark, sf, "pixel")
    return thumbnail(px, dims_of(px), 50).select(*KEYS, *[F.round(c, 4).alias(c) for c in "rgb"])


# --- composite ---------------------------------------------------------------

_COMP = """best AS (SELECT row, col, r, g, b, path, row_number() OVER (PARTITION BY row, col ORDER BY priority, path DESC) AS k FROM source_pixel WHERE r+g+b >= 24)"""


@query("g1_priority_composite", f"WITH {_COMP} SELECT row, col, r, g, b FROM best WHERE k=1", ["source_pixel"])
def g1(spark, sf):
    px = view(spark, sf, "source_pixel")
    return composite.priority_composite(px, ["row", "col"], F.lit(1000) - F.col("priority")).drop("ord")


@query("g1_composite_by_path", """
WITH s AS (SELECT concat('src', blk, '_', r%7) AS path, 1+blk%2 AS priority, floor(row/4) AS y, floor(col/4) AS x, r, g, b FROM pixel WHERE r+g+b>=24),
k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY priority, path DESC, r DESC, g DESC, b DESC) AS n FROM s)
SELECT y AS row, x AS col, r, g, b FROM (SELECT cast(y as bigint) AS y, cast(x as bigint) AS x, r, g, b, n FROM k) z WHERE n=1""", ["pixel"])
def g1p(spark, sf):
    px = view(spark, sf, "pixel").select(
        F.concat(F.lit("src"), "blk", F.lit("_"), F.col("r") % 7).alias("path"), (F.col("blk") % 2 + 1).alias("priority"),
        F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col"), "r", "g", "b")
    order = composite.composite_order(px.select("path", "priority").distinct())
    held = attach_by(px, order, ["path", "priority"])
    return composite.priority_composite(held, ["row", "col"], F.col("ord")).drop("ord")


@query("g1_composite_tiles", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY priority) AS n FROM source_pixel WHERE r+g+b>=24)
SELECT row, col, r, g, b FROM k WHERE n=1""", ["source_pixel"])
def g1t(spark, sf):
    px = view(spark, sf, "source_pixel").select(F.col("path").alias("raster_id"), "priority", "row", "col", "r", "g", "b")
    high = px.agg((F.max("row") + 1).alias("raster_h"), (F.max("col") + 1).alias("raster_w"))
    dims = attach_scalar(px.select("raster_id").distinct(), high)
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims)
    ranked = packed.withColumn("ord", F.lit(1000) - F.substring("raster_id", 2, 1).cast("int")).withColumn("raster_id", F.lit("cell"))
    merged = composite.composite_tiles(ranked, TILE, 2)
    return tiles.tiles_to_pixels(merged, ["r", "g", "b"], drop_blank=True).select("row", "col", "r", "g", "b")


@query("g3_source_tiles", """
WITH t AS (SELECT a.i AS ty, c.j AS tx FROM generate_series(0,9) a(i), generate_series(0,9) c(j))
SELECT path, priority, cast(tx as int) AS cell_x, cast(ty as int) AS cell_y FROM footprint, t
WHERE west < 35+(tx+1)*0.1e0 AND east > 35+tx*0.1e0 AND south < 33+(ty+1)*0.1e0 AND north > 33+ty*0.1e0""", ["footprint"])
def g3(spark, sf):
    from ..operators.rangejoin import bbox_join
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("cell_x"), F.floor(F.col("id") / 10).cast("int").alias("cell_y"))
    t = cells.select("cell_x", "cell_y", (F.lit(35) + F.col("cell_x") * 0.1).alias("west"), (F.lit(33) + F.col("cell_y") * 0.1).alias("south"),
                     (F.lit(35) + (F.col("cell_x") + 1) * 0.1).alias("east"), (F.lit(33) + (F.col("cell_y") + 1) * 0.1).alias("north"))
    j = bbox_join(view(spark, sf, "footprint"), t, 0.25, hot_rows=30)
    return j.select("path", "priority", F.col("r_cell_x").alias("cell_x"), F.col("r_cell_y").alias("cell_y"))


@query("g9_feature_tiles", """
WITH t AS (SELECT i AS cell_y, j AS cell_x FROM generate_series(0,9) a(i), generate_series(0,9) c(j))
SELECT feature_id, cast(cell_x as int) AS cell_x, cast(cell_y as int) AS cell_y FROM rect, t
 WHERE x <= (cell_x+1)*10 AND x+w >= cell_x*10 AND y <= (cell_y+1)*10 AND y+h >= cell_y*10""", ["rect"])
def g9(spark, sf):
    f = view(spark, sf, "rect").select("feature_id", F.col("x").alias("minx"), F.col("y").alias("miny"),
                                       (F.col("x") + F.col("w")).alias("maxx"), (F.col("y") + F.col("h")).alias("maxy"))
    return vector.features_per_tile(f, 0.0, 0.0, 10.0, 10, 10).select("feature_id", "cell_x", "cell_y")


@query("h8_missing_fraction", """
WITH c AS (SELECT DISTINCT row, col FROM source_pixel WHERE r+g+b>=24), d AS (SELECT max(row)+1 AS h FROM source_pixel)
SELECT round(1-count(*)/(100e0*(SELECT h FROM d)), 8) AS missing_fraction FROM c""", ["source_pixel"])
def h8(spark, sf):
    px = view(spark, sf, "source_pixel")
    done = composite.priority_composite(px, ["row", "col"], F.lit(1000) - F.col("priority"))
    h = px.agg((F.max("row") + 1).alias("h")).scalar()
    return composite.missing_fraction(done, F.lit(100.0), h).select(F.round("missing_fraction", 8).alias("missing_fraction"))


@query("j1_composite_order", "SELECT path, priority, row_number() OVER (ORDER BY priority DESC, path)-1 AS ord FROM footprint", ["footprint"])
def j1(spark, sf):
    return composite.composite_order(view(spark, sf, "footprint").select("path", "priority")).select("path", "priority", "ord")


@query("j3_sorted_files", "SELECT path, row_number() OVER (ORDER BY path)-1 AS pos FROM (SELECT DISTINCT path FROM listing) z", ["listing"])
def j3(spark, sf):
    return stats.ordered_index(view(spark, sf, "listing").select("path").distinct(), [F.col("path").asc()], "pos")


@query("j5_even_sample", """
WITH s AS (SELECT path, row_number() OVER (ORDER BY path)-1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT path FROM listing) z)
SELECT DISTINCT path FROM s, generate_series(0,19) k(i) WHERE n > 20 AND pos = cast(floor(case when i=19 then n-1 else i*((n-1)/19e0) end) as bigint)""", ["listing"])
def j5(spark, sf):
    p = stats.ordered_index(view(spark, sf, "listing").select("path").distinct(), [F.col("path").asc()], "pos")
    wanted = p.agg(F.count("*").alias("n")).select(stats.linspace_index(F.col("n"), 20).alias("w")).scalar()
    return p.filter(F.array_contains(wanted, F.col("pos"))).select("path")


# --- neighbourhoods ----------------------------------------------------------

_NB = """dm AS (SELECT max(row) AS mr, max(col) AS mc FROM pixel),
o AS (SELECT a.i AS dy, c.j AS dx FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) c(j)),
nb AS (SELECT p.raster_id, p.row, p.col, q.r AS qr, q.g AS qg, q.b AS qb, (q.r+q.g+q.b)/3e0 AS gray FROM pixel p, dm, o
 JOIN pixel q ON q.row = greatest(0, least(mr, p.row+dy)) AND q.col = greatest(0, least(mc, p.col+dx)))"""


@query("e1_box_mean", f"WITH {_NB} SELECT {_K}, round(avg(qr),5) AS mean_r, round(avg(qg),5) AS mean_g, round(avg(qb),5) AS mean_b FROM nb GROUP BY 1,2,3", ["pixel"])
def e1(spark, sf):
    f = focal.box_features(view(spark, sf, "pixel"), ["r", "g", "b"], TILE)
    return f.select(*KEYS, *[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in "rgb"])


@query("e2_texture", f"WITH {_NB} SELECT {_K}, round(sqrt(greatest(avg(gray*gray)-avg(gray)*avg(gray),0e0)),4) AS texture FROM nb GROUP BY 1,2,3", ["pixel"])
def e2(spark, sf):
    f = focal.box_features(view(spark, sf, "pixel"), ["r", "g", "b"], TILE)
    return f.select(*KEYS, F.round("texture", 4).alias("texture"))


_DISK2 = "(SELECT a.i AS dy, c.j AS dx FROM generate_series(-2,2) a(i), generate_series(-2,2) c(j) WHERE a.i*a.i+c.j*c.j<=4)"


@query("e3_local_entropy", f"""
WITH s AS (SELECT min(r+g+b)/3e0 AS lo, max(r+g+b)/3e0 AS hi FROM pixel),
u AS (SELECT {_K}, cast(floor(((r+g+b)/3e0-lo)/(hi-lo)*255e0) as int) AS v FROM pixel, s),
n AS (SELECT p.raster_id, p.row, p.col, q.v, count(*) AS c FROM u p, {_DISK2} o JOIN u q ON q.row=p.row+dy AND q.col=p.col+dx GROUP BY 1,2,3,4),
t AS (SELECT *, c/cast(sum(c) OVER (PARTITION BY row, col) as double) AS f FROM n)
SELECT {_K}, round(-sum(f*log2(f)),5)+0e0 AS entropy FROM t GROUP BY 1,2,3""", ["pixel"])
def e3(spark, sf):
    px = view(spark, sf, "pixel").withColumn("gray", color.gray("r", "g", "b"))
    return focal.local_entropy(px, "gray", TILE).select(*KEYS, (F.round("entropy", 5) + 0.0).alias("entropy"))


@query("e3_half_size_entropy", f"""
WITH s AS (SELECT min(r+g+b)/3e0 AS lo, max(r+g+b)/3e0 AS hi FROM pixel),
u AS (SELECT raster_id, cast(floor(row/2) as int) AS row, cast(floor(col/2) as int) AS col, cast(floor(((r+g+b)/3e0-lo)/(hi-lo)*255e0) as int) AS v FROM pixel, s WHERE row%2=0 AND col%2=0),
n AS (SELECT p.raster_id, p.row, p.col, q.v, count(*) AS c FROM u p, {_DISK2} o JOIN u q ON q.row=p.row+dy AND q.col=p.col+dx GROUP BY 1,2,3,4),
t AS (SELECT *, c/cast(sum(c) OVER (PARTITION BY row, col) as double) AS f FROM n),
h AS (SELECT row, col, round(-sum(f*log2(f)),5)+0e0 AS entropy FROM t GROUP BY 1,2)
SELECT p.raster_id, p.row, p.col, entropy FROM pixel p JOIN h ON h.row=cast(floor(p.row/2) as int) AND h.col=cast(floor(p.col/2) as int)""", ["pixel"])
def e3h(spark, sf):
    """The rule for large rasters, with its limit lowered so this one counts as large."""
    px = view(spark, sf, "pixel").withColumn("gray", color.gray("r", "g", "b"))
    return focal.local_entropy(px, "gray", TILE, full_pixels=500).select(*KEYS, (F.round("entropy", 5) + 0.0).alias("entropy"))


@query("e4_gaussian_std", f"""
WITH w AS (SELECT i, exp(-(i*i)/8e0) AS k FROM generate_series(-5,5) a(i)), wn AS (SELECT i, k/(SELECT sum(k) FROM w) AS k FROM w),
dm AS (SELECT max(row) AS mr, max(col) AS mc FROM pixel),
gx AS (SELECT {_K}, cast(floor((r*9798+g*19235+b*3735+16384)/32768e0) as double) AS v FROM pixel),
h AS (SELECT p.row, p.col, sum(k*q.v) AS m, sum(k*q.v*q.v) AS m2 FROM gx p, wn, dm JOIN gx q ON q.row=p.row
 AND q.col = case when p.col+i<0 then -(p.col+i) when p.col+i>mc then 2*mc-(p.col+i) else p.col+i end GROUP BY 1,2),
z AS (SELECT p.raster_id, p.row, p.col, sum(k*q.m) AS m, sum(k*q.m2) AS m2 FROM gx p, wn, dm JOIN h q ON q.col=p.col
 AND q.row = case when p.row+i<0 then -(p.row+i) when p.row+i>mr then 2*mr-(p.row+i) else p.row+i end GROUP BY 1,2,3)
SELECT {_K}, round(sqrt(greatest(m2-m*m,0e0)),3) AS local_std FROM z""", ["pixel"])
def e4(spark, sf):
    gray = F.floor((F.col("r") * 9798 + F.col("g") * 19235 + F.col("b") * 3735 + 16384) / 32768)
    px = view(spark, sf, "pixel").withColumn("gray", gray)
    return focal.gaussian_texture(px, "gray", TILE).select(*KEYS, F.round("local_std", 3).alias("local_std"))


def feature_pixels(spark, sf, *names):
    """Features of the raster from its tiles, through one chain."""
    px = view(spark, sf, "pixel")
    held = chains.prepared(tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px)), focal.FEATURE_CHAIN, names, TILE)
    return chains.chain_pixels(held, focal.FEATURE_CHAIN, dict.fromkeys(names, "double"))


@query("e1_chain_mean", same_as="e1_box_mean")
def e1c(spark, sf):
    f = feature_pixels(spark, sf, "mean_r", "mean_g", "mean_b")
    return f.select(*KEYS, *[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in "rgb"])


@query("e2_chain_texture", same_as="e2_texture")
def e2c(spark, sf):
    return feature_pixels(spark, sf, "texture").select(*KEYS, F.round("texture", 4).alias("texture"))


@query("e3_chain_entropy", same_as="e3_local_entropy")
def e3c(spark, sf):
    return feature_pixels(spark, sf, "entropy").select(*KEYS, (F.round("entropy", 5) + 0.0).alias("entropy"))


@query("e4_chain_std", same_as="e4_gaussian_std")
def e4c(spark, sf):
    return feature_pixels(spark, sf, "local_std").select(*KEYS, F.round("local_std", 3).alias("local_std"))


def median_sql(radius):
    return f"""WITH o AS (SELECT a.i AS dy, c.j AS dx FROM generate_series(-{radius},{radius}) a(i), generate_series(-{radius},{radius}) c(j) WHERE a.i*a.i+c.j*c.j<={radius * radius}),
n AS (SELECT p.raster_id, p.row, p.col, q.v FROM lb p, o JOIN lb q ON q.row=p.row+dy AND q.col=p.col+dx)
SELECT {_K}, list_sort(list(v))[cast(floor(count(*)/2) as int)+1] AS cluster FROM n GROUP BY 1,2,3"""


def labelled(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, ((F.col("r") + F.col("b")) % 4 + 1).alias("cluster"))


for _r in (1, 2, 3, 5):
    _sql = median_sql(_r).replace("WITH o AS", f"WITH lb AS (SELECT {_K}, (r+b)%4+1 AS v FROM pixel), o AS")

    @query(f"e5_median_{_r}", _sql, ["pixel"])
    def e5(spark, sf, radius=_r):
        return focal.median_labels(labelled(spark, sf), "cluster", radius, TILE)


_GRAD = f"""lm AS (SELECT {_K}, 0.299e0*r+0.587e0*g+0.114e0*b AS v FROM p1), dm AS (SELECT max(row) AS mr, max(col) AS mc FROM lm),
gr AS (SELECT c.raster_id, c.row, c.col, sqrt(power((d.v-u.v)/(least(mr,c.row+1)-greatest(0,c.row-1)),2)+power((t.v-l.v)/(least(mc,c.col+1)-greatest(0,c.col-1)),2)) AS grad
 FROM lm c, dm JOIN lm u ON u.row=greatest(0,c.row-1) AND u.col=c.col JOIN lm d ON d.row=least(mr,c.row+1) AND d.col=c.col
 JOIN lm l ON l.row=c.row AND l.col=greatest(0,c.col-1) JOIN lm t ON t.row=c.row AND t.col=least(mc,c.col+1)),
eg AS (SELECT {_K}, least(1e0, grad/greatest((SELECT quantile_cont(grad,0.95e0) FROM gr),1e-6)) > 0.3e0 AS f_edge FROM gr)"""


@query("e6_edge_flags", f"WITH {scaled_cte()}, {_GRAD} SELECT {_K}, f_edge FROM eg", ["pixel"])
def e6(spark, sf):
    return semantics.edge_flags(view(spark, sf, "pixel"), TILE)


@query("e6_chain_edges", same_as="e6_edge_flags")
def e6c(spark, sf):
    """The gradient, its percentile over the raster and the flags, inside tiles."""
    px = view(spark, sf, "pixel").withColumn("cluster", F.lit(1))
    chain = semantics.semantic_chain(None)
    held = chains.prepared(tiles.pixels_to_tiles(px, ["r", "g", "b", "cluster"], TILE, dims_of(px)), chain, ["f_edge"], TILE)
    return chains.chain_pixels(held, chain, {"f_edge": "boolean"})


def ellipse_offsets(size):
    from ..operators.kernels import ellipse
    import numpy as np
    k, r = ellipse(size), size // 2
    return "(VALUES " + ",".join(f"({y - r},{x - r})" for y, x in np.argwhere(k)) + ") o(dy,dx)"


def rect_offsets(size):
    r = size // 2
    return f"(SELECT cast(a.i as int) AS dy, cast(c.j as int) AS dx FROM generate_series(-{r},{r}) a(i), generate_series(-{r},{r}) c(j)) o"


def dilate_sql(src, offsets):
    return f"SELECT DISTINCT p.raster_id, p.row+dy AS row, p.col+dx AS col FROM {src} p, {offsets}, dm WHERE p.row+dy BETWEEN 0 AND mr AND p.col+dx BETWEEN 0 AND mc"


def complement_sql(src):
    return f"SELECT {_K} FROM pixel EXCEPT SELECT {_K} FROM {src}"


def erode_sql(src, offsets, tag):
    """Erosion as the complement of the dilated complement, as two named steps."""
    return (f"{tag}c AS ({complement_sql(src)}), {tag}d AS ({dilate_sql(tag + 'c', offsets)}), "
            f"{tag} AS ({complement_sql(tag + 'd')})")


_DM = "dm AS (SELECT max(row) AS mr, max(col) AS mc FROM pixel), m0 AS (SELECT raster_id, row, col FROM pixel WHERE (r*7+b)%5=0)"


def seeded_mask(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, ((F.col("r") * 7 + F.col("b")) % 5 == 0).cast("int").alias("f"))


@query("e7_close", f"""WITH {_DM}, m1 AS ({dilate_sql('m0', ellipse_offsets(5))}), {erode_sql('m1', ellipse_offsets(5), 'm2')}
SELECT {_K} FROM m2""", ["pixel"])
def e7(spark, sf):
    return focal.morphology(seeded_mask(spark, sf), "f", [("close", "ellipse", 5)], TILE).filter("f = 1").select(*KEYS)


@query("e7_close_tiles", f"""WITH {_DM}, m1 AS ({dilate_sql('m0', ellipse_offsets(7))}), {erode_sql('m1', ellipse_offsets(7), 'm2')}
SELECT {_K} FROM m2""", ["pixel"])
def e7t(spark, sf):
    m = seeded_mask(spark, sf)
    packed = tiles.pixels_to_tiles(m, ["f"], TILE, dims_of(m))
    return tiles.tiles_to_pixels(focal.close_tiles(packed, 7, TILE), ["f"], drop_blank=True).select(*KEYS)


@query("e8_open_close", f"""WITH {_DM}, b0 AS (SELECT raster_id, row, col FROM pixel WHERE blk in (0,3)),
{erode_sql('b0', ellipse_offsets(3), 'o1')}, o2 AS ({dilate_sql('o1', ellipse_offsets(3))}),
o3 AS ({dilate_sql('o2', rect_offsets(9))}), {erode_sql('o3', rect_offsets(9), 'o4')} SELECT {_K} FROM o4""", ["pixel"])
def e8(spark, sf):
    m = view(spark, sf, "pixel").select(*KEYS, F.col("blk").isin(0, 3).cast("int").alias("f"))
    return focal.morphology(m, "f", [("open", "ellipse", 3), ("close", "rect", 9)], TILE).filter("f = 1").select(*KEYS)


@query("e8_chain_tiles", same_as="e8_open_close")
def e8c(spark, sf):
    m = view(spark, sf, "pixel").select(*KEYS, F.col("blk").isin(0, 3).cast("int").alias("f"))
    chain = focal.morphology_chain("f", [("open", "ellipse", 3), ("close", "rect", 9)], "closed")
    held = chains.prepared(tiles.pixels_to_tiles(m, ["f"], TILE, dims_of(m)), chain, ["closed"], TILE)
    return tiles.tiles_to_pixels(chains.chain_tiles(held, chain, ["closed"]), ["f"], drop_blank=True).select(*KEYS)


@query("e9_border_dilate", f"""WITH {_DM}, g AS ({dilate_sql('m0', ellipse_offsets(5))}), z AS (SELECT least(4, floor(least(mr+1,mc+1)/6)) AS bz FROM dm)
SELECT raster_id, row, col FROM m0 UNION SELECT raster_id, row, col FROM g, z, dm WHERE row<bz OR col<bz OR row>=mr+1-bz OR col>=mc+1-bz""", ["pixel"])
def e9(spark, sf):
    m = seeded_mask(spark, sf)
    return focal.extend_at_border(m.select(*KEYS, "f"), "f", dims_of(m), 4, 5, TILE).filter("f = 1").select(*KEYS)


@query("e11_seamless_tiles", f"WITH {_NB} SELECT {_K}, round(avg(qr),5) AS mean_r FROM nb GROUP BY 1,2,3", ["pixel"])
def e11(spark, sf):
    """The same means from an uneven tile size: seams must not show."""
    f = focal.box_features(view(spark, sf, "pixel"), ["r", "g", "b"], 17)
    return f.select(*KEYS, F.round("mean_r", 5).alias("mean_r"))


# --- sidecars ----------------------------------------------------------------

@query("b1_tile_names", f"""
SELECT DISTINCT concat(raster_id, '_tile_r', cast(floor(row/32) as int), '_c', cast(floor(col/32) as int)) AS name FROM pixel""", ["pixel"])
def b1(spark, sf):
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    return packed.select(naming.tile_name("raster_id", "tile_row", "tile_col").alias("name"))


_F12 = "printf('%.12f', {})"


@query("b2_bounds_sidecar", f"""
SELECT path, concat('csm=Geographic', chr(10), 'datumId=4326', chr(10), 'dcType=NONE', chr(10), 'dcSelectorId=0', chr(10), 'EndMapTokens', chr(10),
 'Top: ', {_F12.format('north')}, chr(10), 'Bottom: ', {_F12.format('south')}, chr(10), 'Left: ', {_F12.format('west')}, chr(10), 'Right: ', {_F12.format('east')}, chr(10)) AS text
FROM (SELECT path, s_suppkey/8e0 AS west, s_suppkey/8e0+2.5e0 AS east, s_nationkey+0.75e0 AS north, s_nationkey-0.125e0 AS south FROM (SELECT s_name AS path, * FROM supplier) z) q""")
def b2(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_name").alias("path"), (F.col("s_suppkey") / 8.0).alias("west"), (F.col("s_suppkey") / 8.0 + 2.5).alias("east"),
        (F.col("s_nationkey") + 0.75).alias("north"), (F.col("s_nationkey") - 0.125).alias("south"))
    return s.select("path", export.txr_text("north", "south", "west", "east").alias("text"))


def txs_sql():
    """Every template line with its fields replaced, as the check engine writes it."""
    rows = ", ".join(f"({i}, '{line.replace('{lib}', TXS_LIBRARY)}')" for i, line in enumerate(TXS_LINES))
    text = "t.text"
    fields = {"path": "path", "width": "'256'", "height": "cast(pos%7+100 as varchar)"}
    fields |= {k: _F12.format(k + "_v") for k in ("top", "right", "left", "bottom")}
    for name, v in fields.items():
        text = f"replace({text}, '{{{name}}}', {v})"
    return f"""WITH i AS (SELECT s_suppkey AS pos, s_name AS path, s_suppkey/8e0 AS left_v, s_suppkey/8e0+1 AS right_v,
 s_nationkey+0.75e0 AS top_v, s_nationkey-0.125e0 AS bottom_v FROM supplier), t(line, text) AS (VALUES {rows})
SELECT pos, t.line, {text} AS text FROM i, t"""


@query("b3_batch_script", txs_sql())
def b3(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("path"), (F.col("s_suppkey") / 8.0).alias("left"),
        (F.col("s_nationkey") - 0.125).alias("bottom"), (F.col("s_suppkey") / 8.0 + 1).alias("right"),
        (F.col("s_nationkey") + 0.75).alias("top"), F.lit(256).alias("width"), (F.col("s_suppkey") % 7 + 100).alias("height"))
    return export.txs_lines(s)


_ARGB = "case when color LIKE '#%' AND length(color)=7 then concat('#ff', lower(substr(color,2,6))) else '#ff000000' end"
_CNAME = ("case name when 'BM_ASPHALT' then 'ASPHALT' when 'BM_CONCRETE' then 'CONCRETE' when 'BM_VEGETATION' then 'GENVEGETATION' "
          "when 'BM_WATER' then 'WATER' when 'BM_SAND' then 'SAND' when 'BM_SOIL' then 'SOIL' else replace(name,'BM_','') end")


def block_sql(index, name, argb, material):
    nl = "chr(10)"
    return (f"""concat('  <Composite_Material index="', {index}, '">', {nl}, '    <Name>', {name}, '</Name>', {nl}, '    <Color>', {argb}, '</Color>', {nl}, """
            f"""'    <Primary_Substrate>', {nl}, '      <Thickness>1</Thickness>', {nl}, '      <Material>', {nl}, '        <Name>', {material}, '</Name>', {nl}, """
            f"""'        <Weight>100</Weight>', {nl}, '      </Material>', {nl}, '    </Primary_Substrate>', {nl}, '  </Composite_Material>')""")


@query("b4_material_table", f"SELECT pos, {block_sql('pos', _CNAME, _ARGB, 'name')} AS text FROM part_class", ["part_class"])
def b4(spark, sf):
    return export.material_table(view(spark, sf, "part_class"))


_SHOWN = "case when pos%3=0 then concat('C', pos) else replace(name,'BM_','') end"


@query("b5_cell_material_table", f"""SELECT 0 AS pos, {block_sql("'0'", "'DEFAULT'", "'#ff000000'", "'BM_SOIL'")} AS text
UNION ALL SELECT pos, {block_sql('pos', _SHOWN, _ARGB, 'name')} AS text FROM part_class""", ["part_class"])
def b5(spark, sf):
    named = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("C"), "pos")).otherwise(F.lit(""))
    return export.cell_material_table(view(spark, sf, "part_class").withColumn("composite_name", named))


_STRIP = "regexp_replace(color, '^#+', '')"


def _hexpart(at):
    return f"case when length({_STRIP})=6 then cast(concat('0x', substr({_STRIP},{at},2)) as integer) else 255 end"


_MTYPE = ("case name when 'BM_ASPHALT' then 'ROAD_SURFACE' when 'BM_CONCRETE' then 'BUILDING' when 'BM_VEGETATION' then 'VEGETATION' "
          "when 'BM_WATER' then 'WATER' when 'BM_SAND' then 'SOIL_EARTH' when 'BM_SOIL' then 'SOIL_EARTH' else 'OTHER' end")


@query("b6_palette_csv", f"""SELECT id AS class_id, name AS material, {_MTYPE} AS material_type, color AS hex_color,
 concat({_hexpart(1)}, ',', {_hexpart(3)}, ',', {_hexpart(5)}) AS final_rgb FROM part_class""", ["part_class"])
def b6(spark, sf):
    return export.palette_csv(view(spark, sf, "part_class"))


@query("b7_tile_index", """
WITH d AS (SELECT max(row)+1 AS h, max(col)+1 AS w FROM pixel), t AS (SELECT DISTINCT raster_id, cast(floor(row/32) as int) AS i, cast(floor(col/32) as int) AS j FROM pixel WHERE blk<>5)
SELECT concat(raster_id, '_tile_r', i, '_c', j, '.tif') AS path, j*32 AS col0, i*32 AS row0, least(32, w-j*32) AS w, least(32, h-i*32) AS h FROM t, d""", ["pixel"])
def b7(spark, sf):
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px.filter("blk <> 5"), ["r", "g", "b"], TILE, dims_of(px))
    return export.tile_index(packed)


@query("b10_coloured_mask", """
SELECT p.raster_id, p.row, p.col, case when p.row%20 in (9,10) then 45 else 0 end AS r, case when p.row%20 in (9,10) then 45 else 0 end AS g,
 case when p.row%20 in (9,10) then 48 else 0 end AS b FROM pixel p""", ["pixel"])
def b10(spark, sf):
    return export.colour_mask(view(spark, sf, "pixel"), view(spark, sf, "mask").filter("feature = 'roads'"), (45, 45, 48), KEYS)


_ERR = "case when o_orderkey%13=0 then concat('Traceback', chr(10), 'ValueError: bad tile ', o_orderkey) end"


@query("b11_failures", f"""WITH e AS (SELECT concat('r', o_orderkey) AS path, {_ERR} AS error, o_orderkey FROM orders)
SELECT path, concat('ValueError: bad tile ', o_orderkey) AS summary, concat('===== ', path, ' =====', chr(10), error, chr(10), chr(10)) AS detail FROM e WHERE error IS NOT NULL""")
def b11(spark, sf):
    return export.failures(run_results(spark, sf))


def run_results(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), k).alias("path"),
        F.when(k % 13 == 0, F.concat(F.lit("Traceback\nValueError: bad tile "), k)).alias("error"))


@query("h15_batch_outcome", f"""WITH e AS (SELECT {_ERR} AS error FROM orders)
SELECT count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_error,
 case when count(*) FILTER (WHERE error IS NULL) > 0 then 'ok' else 'error' end AS status, case when count(*) FILTER (WHERE error IS NOT NULL) > 0 then 1 else 0 end AS exit_code FROM e""")
def h15(spark, sf):
    return export.batch_outcome(run_results(spark, sf))


@query("b9_tile_store", """
SELECT raster_id, cast(floor(row/32) as int) AS tile_row, cast(floor(col/32) as int) AS tile_col, cast(sum(r+g+b) as bigint) AS total FROM pixel GROUP BY 1,2,3""", ["pixel"])
def b9(spark, sf):
    """Tiles written under the shared folder and read back: all or nothing, never over existing output."""
    import uuid
    from ..session import ensure_checkpoint_dir
    px = view(spark, sf, "pixel")
    path = f"{ensure_checkpoint_dir(spark)}/tiles-{uuid.uuid4().hex}"
    export.write_tiles(tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px)), path)
    back = tiles.tiles_to_pixels(spark.read.parquet(path).select(*tiles.TILE_COLUMNS), ["r", "g", "b"])
    return back.groupBy("raster_id", F.floor(F.col("row") / TILE).cast("int").alias("tile_row"),
                        F.floor(F.col("col") / TILE).cast("int").alias("tile_col")).agg(
        F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total"))
