"""Queries on colour maths, geographic maths and pixel predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CUSTOM_PALETTE, GOLDEN_RATIO
from ..functions import color, geo, naming
from ..functions import predicates as P
from ..operators import semantics, stats
from ..operators.stats import attach_by, attach_scalar
from .registry import query
from .views import table, view

KEYS = ["raster_id", "row", "col"]
_K = "raster_id, row, col"


def rounded(*pairs, digits=6):
    return [F.round(c, digits).alias(n) for n, c in pairs]


_STRIP = "regexp_replace(color, '^#+', '')"


def _hex(at, strip=_STRIP):
    return f"case when length({strip})=6 then cast(concat('0x', substr({strip},{at},2)) as integer) else 255 end"


@query("c1_hex_to_rgb", f"SELECT pos, {_hex(1)} AS r, {_hex(3)} AS g, {_hex(5)} AS b FROM part_class", ["part_class"])
def c1(spark, sf):
    c = color.hex_to_rgb("color")
    return view(spark, sf, "part_class").select("pos", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


@query("c1_hex_strict", f"""
SELECT pos, {_hex(1)} AS r, {_hex(3)} AS g, {_hex(5)} AS b FROM part_class WHERE color LIKE '#______'""", ["part_class"])
def c1s(spark, sf):
    c = color.hex_to_rgb_strict("color")
    return view(spark, sf, "part_class").filter(F.length("color") == 7).select(
        "pos", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


@query("c2_rgb_to_hex", f"SELECT {_K}, upper(printf('#%02x%02x%02x', r, g, b)) AS hex FROM pixel", ["pixel"])
def c2(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, color.rgb_to_hex("r", "g", "b").alias("hex"))


_MAX, _MIN = "greatest(r,g,b)", "least(r,g,b)"


@query("c3_gray", f"""SELECT {_K}, round((r+g+b)/3e0, 6) AS gray, cast(floor((r+g+b)/3e0) as int) AS brightness FROM pixel""", ["pixel"])
def c3(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.gray("r", "g", "b"), 6).alias("gray"),
                                           color.brightness_int("r", "g", "b").alias("brightness"))


@query("c4_ndvi", f"SELECT {_K}, round((nir-b)/(nir+b+1e-6), 6) AS ndvi FROM pixel", ["pixel"])
def c4(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.ndvi("nir", "b"), 6).alias("ndvi"))


_VARI = "greatest(-1e0, least(1e0, (g-r)/(case when abs(g+r-b)<1e-6 then 1e-6 else cast(g+r-b as double) end)))"


@query("c5_vari", f"SELECT {_K}, round({_VARI}, 6) AS vari FROM pixel", ["pixel"])
def c5(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.vari("r", "g", "b"), 6).alias("vari"))


@query("c6_saturation", f"SELECT {_K}, round(({_MAX}-{_MIN})/({_MAX}+1e-6), 6) AS sat, {_MAX}-{_MIN} AS sat_range FROM pixel", ["pixel"])
def c6(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.saturation("r", "g", "b"), 6).alias("sat"),
                                           color.saturation_range("r", "g", "b").alias("sat_range"))


def pool(name="pixel", p=0.98):
    return f"(SELECT greatest(1e0, quantile_cont(v, {p}e0)) FROM (SELECT r AS v FROM {name} UNION ALL SELECT g FROM {name} UNION ALL SELECT b FROM {name}) z)"


def scaled_cte(name="pixel"):
    c = lambda x: f"greatest(0e0, least(1e0, {x}/s.scale)) AS {x}"
    return f"sc AS (SELECT {pool(name)} AS scale), p1 AS (SELECT {_K}, blk, {c('r')}, {c('g')}, {c('b')}, {c('nir')} FROM {name}, sc s)"


def scaled(spark, sf, name="pixel"):
    px = view(spark, sf, name)
    out = attach_by(px, semantics.pooled_scale(px, ["raster_id"]), ["raster_id"])
    return out.select(*KEYS, *[color.scale_clip(c, "scale").alias(c) for c in ("r", "g", "b", "nir")])


@query("c7_excess_green", f"""WITH {scaled_cte()}
SELECT {_K}, round(2e0*g-r-b, 6) AS exg, round((g-r)/(g+r-b+1e-6), 6) AS vari FROM p1""", ["pixel"])
def c7(spark, sf):
    return scaled(spark, sf).select(*KEYS, *rounded(("exg", color.exg("r", "g", "b")), ("vari", color.vari_scaled("r", "g", "b"))))


@query("c8_ndwi", f"SELECT {_K}, round((g-nir)/(g+nir+1e-6), 6) AS ndwi FROM pixel", ["pixel"])
def c8(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.ndwi("g", "nir"), 6).alias("ndwi"))


@query("c9_luma", f"SELECT {_K}, round(0.299e0*r+0.587e0*g+0.114e0*b, 6) AS luma FROM pixel", ["pixel"])
def c9(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, F.round(color.luma("r", "g", "b"), 6).alias("luma"))


HSV_CTE = f"""hv AS (SELECT *, {_MAX} AS v, {_MAX}-{_MIN} AS d FROM pixel),
ht AS (SELECT *, case when v=0 then 0 else cast(floor((d*cast(round_even(1044480e0/v,0) as int)+2048)/4096e0) as int) end AS s,
 case when d=0 then 0 else cast(floor(((case when v=r then g-b when v=g then b-r+2*d else r-g+4*d end)
  * cast(round_even(737280e0/(6e0*greatest(d,1)),0) as int)+2048)/4096e0) as int) end AS t FROM hv),
hsv AS (SELECT *, case when t<0 then t+180 else t end AS h FROM ht)"""


@query("c10_hsv", f"WITH {HSV_CTE} SELECT {_K}, h, s, v FROM hsv", ["pixel"])
def c10(spark, sf):
    h, s, v = color.hsv("r", "g", "b")
    return view(spark, sf, "pixel").select(*KEYS, h.alias("h"), s.alias("s"), v.alias("v"))


@query("c11_pooled_scale", f"""WITH {scaled_cte()}
SELECT {_K}, round(r,6) AS r, round(g,6) AS g, round(b,6) AS b FROM p1""", ["pixel"])
def c11(spark, sf):
    return scaled(spark, sf).select(*KEYS, *rounded(("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b"))))


@query("c12_percentile_stretch", f"""
WITH q AS (SELECT quantile_cont(r,0.02e0) AS r2, quantile_cont(r,0.98e0) AS r98, quantile_cont(g,0.02e0) AS g2, quantile_cont(g,0.98e0) AS g98,
 quantile_cont(b,0.02e0) AS b2, quantile_cont(b,0.98e0) AS b98 FROM pixel)
SELECT {_K}, """ + ", ".join(
    f"cast(floor(greatest(0e0, least(255e0, ({c}-{c}2)/greatest({c}98-{c}2,1e0)*255e0))) as int) AS {c}" for c in "rgb")
       + " FROM pixel, q", ["pixel"])
def c12(spark, sf):
    px = view(spark, sf, "pixel")
    out = px
    for c in "rgb":
        out = attach_by(out, stats.int_percentiles(px, F.col(c), {f"{c}2": 0.02, f"{c}98": 0.98}, ["raster_id"]), ["raster_id"])
    return out.select(*KEYS, *[color.stretch_uint8(c, f"{c}2", f"{c}98").alias(c) for c in "rgb"])


@query("c13_minmax_stretch", """
WITH q AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, case when hi>lo then cast(floor(greatest(0e0, least(255e0, (o_totalprice-lo)/(hi-lo)*255e0))) as int) else 0 end AS level FROM orders, q""")
def c13(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = attach_scalar(o, o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))
    return out.select("o_orderkey", color.minmax_uint8("o_totalprice", "lo", "hi").alias("level"))


@query("c14_zscore", f"""
WITH q AS (SELECT avg(r) AS mr, stddev_pop(r) AS sr, avg(nir) AS mn, stddev_pop(nir) AS sn FROM pixel)
SELECT {_K}, round((r-mr)/case when sr=0 then 1e0 else sr end, 6) AS z_r, round((nir-mn)/case when sn=0 then 1e0 else sn end, 6) AS z_nir,
 round(0e0, 6) AS z_const FROM pixel, q""", ["pixel"])
def c14(spark, sf):
    from ..operators.cluster import fit_scaler, standardise
    px = view(spark, sf, "pixel").withColumn("const", F.lit(5.0))
    z = standardise(px, fit_scaler(px, ["r", "nir", "const"]))
    return z.select(*KEYS, *rounded(("z_r", F.col("r")), ("z_nir", F.col("nir")), ("z_const", F.col("const"))))


@query("c15_pack_rgb", f"SELECT {_K}, r*65536+g*256+b AS packed FROM pixel", ["pixel"])
def c15(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, color.pack_rgb("r", "g", "b").alias("packed"))


LUT = {1: (45, 45, 48), 2: (180, 180, 180), 3: (34, 139, 34), 4: (28, 107, 160)}


@query("c16_lut_paint", f"""SELECT {_K}, blk AS cluster, """ + ", ".join(
    f"case least(4, blk) when 0 then 0 " + " ".join(f"when {k} then {v[i]}" for k, v in LUT.items()) + f" end AS paint_{c}"
    for i, c in enumerate("rgb")) + " FROM pixel", ["pixel"])
def c16(spark, sf):
    from ..operators.assign import paint_labels
    px = view(spark, sf, "pixel").select(*KEYS, F.col("blk").alias("cluster"))
    return paint_labels(px, 4, LUT)


_PI = "3.141592653589793e0"


@query("c17_mercator", f"""
SELECT path, round(west*20037508.34e0/180e0, 6) AS x, round(ln(tan((90e0+south)*{_PI}/360e0))*20037508.34e0/{_PI}, 6) AS y FROM footprint""",
       ["footprint"])
def c17(spark, sf):
    return view(spark, sf, "footprint").select("path", F.round(geo.mercator_x("west"), 6).alias("x"),
                                               F.round(geo.mercator_y("south"), 6).alias("y"))


@query("c17_mercator_rings", f"""
SELECT feature_id, 4 AS n_points, round((x+w-0.25e0)*20037508.34e0/180e0, 6) AS x3,
 round(ln(tan((90e0+y+h-0.25e0-60e0)*{_PI}/360e0))*20037508.34e0/{_PI}, 6) AS y3 FROM rect""", ["rect"])
def c17r(spark, sf):
    from .q_sources import rect_features
    f = rect_features(spark, sf)
    shifted = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), (p["y"] - 60.0).alias("y"))))
    m = f.withColumn("rings", geo.rings_to_mercator(shifted))
    ring = F.element_at("rings", 1)
    return m.select("feature_id", F.size(ring).alias("n_points"), F.round(F.element_at(ring, 3)["x"], 6).alias("x3"),
                    F.round(F.element_at(ring, 3)["y"], 6).alias("y3"))


@query("c18_metres_to_units", """
SELECT fid, round(case when fid%3=0 then width_val/111320e0 when fid%3=1 then cast(width_val as double) else width_val/0.3048e0 end, 10) AS units FROM road""",
       ["road"])
def c18(spark, sf):
    r = view(spark, sf, "road")
    factor = F.when(F.col("fid") % 3 == 2, F.lit(0.3048)).otherwise(F.lit(1.0))
    return r.select("fid", F.round(geo.metres_to_units(F.col("width_val").cast("double"), F.col("fid") % 3 == 0, factor), 10).alias("units"))


@query("c19_geo_window", """
WITH c AS (SELECT path, cast(floor((west-35e0)/0.002e0) as int) AS c0, cast(floor((34e0-north)/0.002e0) as int) AS r0,
 cast(floor((east-35e0)/0.002e0) as int) AS c1, cast(floor((34e0-south)/0.002e0) as int) AS r1 FROM footprint),
x AS (SELECT *, greatest(0, least(c0,c1)) AS x, greatest(0, least(r0,r1)) AS y FROM c)
SELECT path, x, y, greatest(1, least(500, greatest(c0,c1))-x) AS w, greatest(1, least(500, greatest(r0,r1))-y) AS h FROM x""", ["footprint"])
def c19(spark, sf):
    win = geo.geo_window(F.lit(35.0), F.lit(34.0), F.lit(0.002), F.lit(0.002), F.lit(500), F.lit(500),
                         "west", "north", "east", "south")
    return view(spark, sf, "footprint").select("path", win["x"].alias("x"), win["y"].alias("y"),
                                               win["width"].alias("w"), win["height"].alias("h"))


_LAT = "(cast(p_partkey%181 as int)-90)"
_ZONE = f"case when abs({_LAT}) >= 80 then 12 when abs({_LAT}) >= 75 then 6 when abs({_LAT}) >= 70 then 4 when abs({_LAT}) >= 50 then 2 else 1 end"


@query("c21_zone_width", f"SELECT p_partkey, {_ZONE} AS width FROM part")
def c21(spark, sf):
    lat = (F.col("p_partkey") % 181).cast("int") - 90
    return table(spark, sf, "part").select("p_partkey", geo.zone_width(lat).alias("width"))


_ZONE_MID = _ZONE.replace(f"abs({_LAT})", "abs(lat+0.5)")


@query("c22_cells", f"""
WITH c AS (SELECT p_partkey, cast(p_partkey%180 as int)-90 AS lat, cast((p_partkey*7)%360 as int)-180 AS lon FROM part),
z AS (SELECT *, {_ZONE_MID} AS wd FROM c), s AS (SELECT *, ((lon%wd)+wd)%wd=0 AS snapped FROM z)
SELECT p_partkey, snapped, concat(case when lat>=0 then 'N' else 'S' end, lpad(cast(abs(lat) as varchar),2,'0'),
 case when lon>=0 then 'E' else 'W' end, lpad(cast(abs(lon) as varchar),3,'0')) AS name,
 cast(lon as double) AS west, cast(lat as double) AS south, cast(lon+wd as double) AS east, cast(lat+1 as double) AS north FROM s WHERE snapped""")
def c22(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 180).cast("int") - 90).alias("lat"),
                                        ((F.col("p_partkey") * 7 % 360).cast("int") - 180).alias("lon"))
    ok = c.withColumn("snapped", geo.cell_is_snapped("lat", "lon")).filter("snapped")
    cell = geo.snapped_cell("lat", "lon")
    return ok.select("p_partkey", "snapped", *[cell[n].alias(n) for n in ("name", "west", "south", "east", "north")])


@query("c23_road_width", """
SELECT fid, case when width_val>0 then cast(width_val as double) when lower(trim(type_val))='large' then 8e0
 when lower(trim(type_val))='small' then 4e0 else 2e0 end AS width_m FROM road""", ["road"])
def c23(spark, sf):
    w = naming.road_width("width_val", "type_val", " large ", 8.0, "Small", 4.0, 2.0)
    return view(spark, sf, "road").select("fid", w.alias("width_m"))


_PAL = "[" + ",".join(f"'{c}'" for c in CUSTOM_PALETTE) + "]"


@query("c24_class_palette", f"""
WITH i AS (SELECT cast(p_partkey as bigint) AS i FROM part),
h AS (SELECT i, (i*{GOLDEN_RATIO!r}e0) - floor(i*{GOLDEN_RATIO!r}e0) AS h, case when i%2=0 then 0.9e0 else 0.7e0 end AS s,
 case when cast(floor(i/2) as bigint)%2=0 then 0.95e0 else 0.75e0 end AS v FROM i),
k AS (SELECT *, cast(floor(h*6) as int)%6 AS six, h*6-floor(h*6) AS f FROM h),
q AS (SELECT *, v*(1-s) AS p, v*(1-f*s) AS q, v*(1-(1-f)*s) AS t FROM k),
c AS (SELECT i, case six when 0 then v when 1 then q when 2 then p when 3 then p when 4 then t else v end AS r,
 case six when 0 then t when 1 then v when 2 then v when 3 then q else p end AS g,
 case six when 0 then p when 1 then p when 2 then t when 3 then v when 4 then v else q end AS b FROM q)
SELECT i, case when i < 30 then {_PAL}[i+1] else printf('#%02x%02x%02x', cast(floor(r*255) as int), cast(floor(g*255) as int), cast(floor(b*255) as int)) end AS color FROM c""")
def c24(spark, sf):
    i = F.col("i")
    h = i * F.lit(GOLDEN_RATIO) - F.floor(i * F.lit(GOLDEN_RATIO))
    s = F.when(i % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.7))
    v = F.when(F.floor(i / 2) % 2 == 0, F.lit(0.95)).otherwise(F.lit(0.75))
    rgb = [F.floor(c * 255).cast("int") for c in color.hsv_to_rgb(h, s, v)]
    fixed = F.get(F.array(*[F.lit(c) for c in CUSTOM_PALETTE]), i.cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("i")).select(
        "i", F.coalesce(fixed, F.format_string("#%02x%02x%02x", *rgb)).alias("color"))


@query("c25_crs_code", """
SELECT raster_id, case when epsg=3857 then 3857 else epsg end AS epsg FROM raster""", ["raster"])
def c25(spark, sf):
    local = F.lit('LOCAL_CS["WGS 84 / Pseudo-Mercator",UNIT["metre",1]]')
    r = view(spark, sf, "raster").withColumn("crs_text", F.when(F.col("epsg") == 3857, local).otherwise("EPSG:4326"))
    code = geo.crs_code("crs_text", F.when(F.col("epsg") != 3857, F.col("epsg")))
    return r.select("raster_id", code.alias("epsg"))


_TYPE = ("case name when 'BM_ASPHALT' then 'ROAD_SURFACE' when 'BM_CONCRETE' then 'BUILDING' when 'BM_VEGETATION' then 'VEGETATION' "
         "when 'BM_WATER' then 'WATER' when 'BM_SAND' then 'SOIL_EARTH' when 'BM_SOIL' then 'SOIL_EARTH' else 'OTHER' end")


@query("c26_material_type", f"SELECT pos, {_TYPE} AS material_type, cast(substr(id, 7) as int) AS class_index FROM part_class", ["part_class"])
def c26(spark, sf):
    return view(spark, sf, "part_class").select("pos", naming.material_type("name").alias("material_type"),
                                                F.col("pos").alias("class_index"))


@query("c27_tolerance", """
SELECT event_type, greatest(30, cast(round_even(2e0*stddev_pop(value), 0) as int)) AS tolerance_radius FROM events GROUP BY event_type""")
def c27(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.stddev_pop("value").alias("sd")).select(
        "event_type", color.tolerance_radius("sd").alias("tolerance_radius"))


@query("c28_stage_shares", """
SELECT event_type AS stage, round(sum(value), 4) AS seconds, round(sum(value)*100e0/sum(sum(value)) OVER (), 6) AS pct FROM events GROUP BY event_type""")
def c28(spark, sf):
    from pyspark.sql import Window as W
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    total = F.sum("s").over(W.partitionBy())  # one row per stage
    return s.select("stage", F.round("s", 4).alias("seconds"), F.round(F.col("s") * 100.0 / total, 6).alias("pct"))


@query("c29_output_names", """
WITH s AS (SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS parent FROM listing)
SELECT path, concat(parent, '/', regexp_replace(base, '(.)\\.[^.]+$', '\\1'), '_classified.tif') AS output,
 concat('/out/', regexp_replace(base, '(.)\\.[^.]+$', '\\1'), '_classified.tif') AS in_folder FROM s""", ["listing"])
def c29(spark, sf):
    ls = view(spark, sf, "listing")
    return ls.select("path", naming.output_path("path", F.lit(None).cast("string"), "_classified").alias("output"),
                     naming.output_path("path", F.lit("/out"), "_classified").alias("in_folder"))


# --- predicates --------------------------------------------------------------

@query("d1_near_black", f"""
SELECT {_K}, case when (r+g+b)/3e0 >= 8 then r else 0 end AS r, case when (r+g+b)/3e0 >= 8 then g else 0 end AS g,
 case when (r+g+b)/3e0 >= 8 then b else 0 end AS b FROM pixel""", ["pixel"])
def d1(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, *P.blank_near_black())


_PAIRS = """p AS (SELECT a.path AS a, b.path AS b, a.west AS aw, a.south AS asx, a.east AS ae, a.north AS an,
 b.west AS bw, b.south AS bs, b.east AS be, b.north AS bn FROM {0} a, {0} b WHERE a.path < b.path)"""


def footprint_pairs(spark, sf, inclusive):
    from ..operators.rangejoin import bbox_join
    q = lambda c: F.floor(F.col(c) * 100).cast("double")
    f = view(spark, sf, "footprint").select("path", *[q(c).alias(c) for c in ("west", "south", "east", "north")])
    pairs = bbox_join(f, f, 20.0, inclusive=inclusive, hot_rows=40)
    return pairs.filter(F.col("path") < F.col("r_path")).select(F.col("path").alias("a"), F.col("r_path").alias("b"))


_QUANT = "qf AS (SELECT path, floor(west*100) AS west, floor(south*100) AS south, floor(east*100) AS east, floor(north*100) AS north FROM footprint)"


@query("d2_strict_overlap", f"WITH {_QUANT}, {_PAIRS.format('qf')} SELECT a, b FROM p WHERE aw<be AND ae>bw AND asx<bn AND an>bs", ["footprint"])
def d2(spark, sf):
    return footprint_pairs(spark, sf, False)


@query("d3_inclusive_overlap", f"WITH {_QUANT}, {_PAIRS.format('qf')} SELECT a, b FROM p WHERE aw<=be AND ae>=bw AND asx<=bn AND an>=bs", ["footprint"])
def d3(spark, sf):
    return footprint_pairs(spark, sf, True)


_SAT = "(greatest(r,g,b)-least(r,g,b))/(greatest(r,g,b)+1e-6)"
FLAG_CTE = f"""p2 AS (SELECT *, {_SAT} AS sat, greatest(r,g,b) AS maxc, 2e0*g-r-b AS exg, (g-r)/(g+r-b+1e-6) AS vari, (g-nir)/(g+nir+1e-6) AS ndwi FROM p1),
p3 AS (SELECT *, sat<0.15e0 AS achromatic, (sat<0.2e0 AND maxc>0.1e0 AND maxc<0.6e0 AND exg<0.06e0) AS dark_road FROM p2),
fl AS (SELECT {_K},
 ((exg>0.06e0 AND g>r*1.05e0 AND g>b*1.03e0 AND sat>0.1e0 AND maxc>0.1e0 AND NOT achromatic AND NOT dark_road)
  OR (g>=maxc-0.005e0 AND sat>0.16e0 AND maxc>0.08e0 AND exg>0.03e0 AND g>b AND NOT achromatic)
  OR (vari>0.08e0 AND sat>0.14e0 AND maxc>0.1e0 AND g>=r AND NOT achromatic AND NOT dark_road)) AS veg,
 (r>g*1.04e0 AND r>b*1.1e0 AND b<g*1.12e0 AND sat<0.3e0 AND maxc>0.2e0 AND exg<0.04e0) AS dry_barren,
 ((r>g*1.05e0 AND r>b*1.18e0 AND g>=b AND sat<0.36e0 AND maxc>0.32e0 AND exg<0.01e0)
  OR (r>=g AND r>b*1.12e0 AND g>=b AND sat<0.15e0 AND maxc>0.52e0 AND exg < -0.01e0)) AS sand,
 (r>b*1.08e0 AND g>b*1.05e0 AND r<g*1.18e0 AND sat>0.07e0 AND maxc>0.18e0 AND exg > -0.05e0 AND exg<0.12e0) AS dry_grass,
 (g>=maxc-0.005e0 AND exg>0.08e0 AND sat>0.14e0 AND maxc>0.18e0 AND r<g*1.05e0) AS lush_grass,
 (sat<0.16e0 AND maxc>0.12e0 AND maxc<0.86e0) AS gray, (sat<0.16e0 AND maxc>0.12e0 AND maxc<0.46e0) AS dark_gray,
 ((achromatic OR dark_road) AND maxc>0.1e0 AND maxc<0.8e0) AS achro_road,
 (r>b*1.12e0 AND r>=g*0.9e0 AND sat>0.04e0 AND maxc>0.15e0 AND exg<0.06e0) AS warm,
 (ndwi>0.05e0 AND sat<0.3e0 AND maxc>0.06e0) AS water_nir,
 ((b-greatest(r,g)>0.03e0 AND sat<0.35e0 AND b>0.1e0 AND r<0.55e0) OR (maxc<0.28e0 AND sat<0.22e0 AND b>=r AND b>=g)
  OR (b>=maxc-0.005e0 AND sat>0.06e0 AND maxc>0.1e0 AND r<0.55e0)) AS water_rgb,
 (b>g+0.03e0 AND b>r+0.03e0 AND maxc>0.08e0) AS blue_dom FROM p3)"""
FLAGS = ["veg", "dry_barren", "sand", "dry_grass", "lush_grass", "gray", "dark_gray", "achro_road", "warm",
         "water_nir", "water_rgb", "blue_dom"]


@query("d5_scene_flags", f"WITH {scaled_cte()}, {FLAG_CTE} SELECT * FROM fl", ["pixel"])
def d5(spark, sf):
    px = view(spark, sf, "pixel")
    held = attach_by(px, semantics.pooled_scale(px, ["raster_id"]), ["raster_id"])
    return P.scene_flags(held).select(*KEYS, *[F.col(f"f_{n}").alias(n) for n in FLAGS])


@query("d6_building_colour", f"""WITH {HSV_CTE} SELECT {_K}, ((s<40 AND v>90 AND v<215) OR ((h<15 OR h>170) AND s>50 AND v>80)
 OR (v>210 AND s<35) OR (s<35 AND v>120 AND v<200)) AS hit FROM hsv""", ["pixel"])
def d6(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, P.building_colour(*color.hsv("r", "g", "b")).alias("hit"))


@query("d7_tree_colour", f"WITH {HSV_CTE} SELECT {_K}, (h>25 AND h<90 AND s>30 AND v>25 AND v<170) AS hit FROM hsv", ["pixel"])
def d7(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, P.tree_colour(*color.hsv("r", "g", "b")).alias("hit"))


@query("d8_water_colour", f"""WITH {HSV_CTE}, br AS (SELECT *, cast(floor((r+g+b)/3e0) as int) AS m FROM hsv)
SELECT {_K}, ((h>90 AND h<135 AND s>25 AND v>20 AND v<230) OR (h>95 AND h<140 AND s>50 AND v>15 AND v<160)
 OR (h>75 AND h<100 AND s>30 AND v>60 AND v<230) OR (h>55 AND h<95 AND s>20 AND v>25 AND v<180 AND b>floor(g*3/10e0))
 OR (h>70 AND h<120 AND s>15 AND v>10 AND v<90) OR (b>r+8 AND b>g-15 AND b>30) OR (b>r AND g>r AND g+b>r*2+30 AND b>30)
 OR (m<70 AND b>r+2 AND b>15) OR (g>70 AND b>60 AND r<g-8 AND r<b+10)) AS certain,
 (b>r+5 AND b>30 AND m>10 AND m<200) AS hint,
 ((h>8 AND h<30 AND s>15 AND s<100 AND v>30 AND v<140) OR (s<25 AND v>50 AND v<170 AND b>r)
  OR (m>30 AND m<110 AND b>=r-10 AND b>g-20 AND s>10)) AS ambiguous, m>5 AS valid FROM br""", ["pixel"])
def d8(spark, sf):
    parts = P.water_colours("r", "g", "b", *color.hsv("r", "g", "b"))
    return view(spark, sf, "pixel").select(*KEYS, *[c.alias(n) for n, c in parts.items()])


@query("d9_field_colour", f"""WITH {HSV_CTE} SELECT {_K}, ((h>25 AND h<85 AND s>20 AND v>60 AND v<240) OR (h>18 AND h<35 AND s>25 AND v>80)) AS hit FROM hsv""", ["pixel"])
def d9(spark, sf):
    return view(spark, sf, "pixel").select(*KEYS, P.field_colour(*color.hsv("r", "g", "b")).alias("hit"))


@query("d12_six_class_route", """
WITH p AS (SELECT cast(floor(pos/6) as int) AS request, list(name) AS names FROM (SELECT pos,
 case when cast(floor(pos/6) as int)%5=0 then case pos%6 when 0 then 'BM_ASPHALT' when 1 then 'BM_CONCRETE' when 2 then 'BM_VEGETATION' when 3 then 'BM_WATER' when 4 then 'BM_SAND' else 'BM_SOIL' end
 else name end AS name FROM part_class) z GROUP BY 1)
SELECT request, len(names) AS n_names, (len(names)=6 AND len(list_filter(names, lambda x: x NOT IN ('BM_ASPHALT','BM_CONCRETE','BM_VEGETATION','BM_WATER','BM_SAND','BM_SOIL')))=0 AND request%3<>1) AS routed FROM p""",
       ["part_class"])
def d12(spark, sf):
    six = F.array(*[F.lit(n) for n in ("BM_ASPHALT", "BM_CONCRETE", "BM_VEGETATION", "BM_WATER", "BM_SAND", "BM_SOIL")])
    req = F.floor(F.col("pos") / 6).cast("int")
    p = view(spark, sf, "part_class").withColumn("request", req).withColumn(
        "name", F.when(F.col("request") % 5 == 0, F.get(six, F.col("pos") % 6)).otherwise(F.col("name")))
    r = p.groupBy("request").agg(F.collect_list("name").alias("names"))  # six names per request
    return r.select("request", F.size("names").cast("long").alias("n_names"),
                    naming.six_class_route("names", F.col("request") % 3 != 1).alias("routed"))


@query("d13_class_source", """
SELECT pos, coalesce(case when pos%4=0 then 'mask' when pos%4=1 then 'kmeans' end,
 case when name in ('BM_ASPHALT','BM_CONCRETE','BM_WATER') then 'mask' else 'kmeans' end) AS source FROM part_class""", ["part_class"])
def d13(spark, sf):
    own = F.when(F.col("pos") % 4 == 0, "mask").when(F.col("pos") % 4 == 1, "kmeans").when(F.col("pos") % 4 == 2, "")
    return view(spark, sf, "part_class").select("pos", naming.class_source(own, "name").alias("source"))


@query("d14_open_weight", f"""WITH {scaled_cte()}, x AS (SELECT *, {_SAT} AS sat, greatest(r,g,b) AS hi FROM p1),
y AS (SELECT avg(case when 2e0*g-r-b>0.08e0 AND g>0.22e0 then 1e0 else 0e0 end) AS veg,
 avg(case when r>g AND g>b AND sat>0.07e0 AND hi>0.18e0 then 1e0 else 0e0 end) AS soil,
 avg(case when sat<0.12e0 AND hi>0.15e0 AND hi<0.85e0 then 1e0 else 0e0 end) AS gray FROM x)
SELECT round(veg,6) AS veg, round(soil,6) AS soil, round(gray,6) AS gray,
 round(greatest(0e0, least(1e0, 0.5e0+1.1e0*(veg+0.65e0*soil-0.9e0*gray))),6) AS open_weight FROM y""", ["pixel"])
def d14(spark, sf):
    flags = P.open_scene_flags("r", "g", "b")
    one = scaled(spark, sf).agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()])
    return one.select(*rounded(("veg", F.col("veg")), ("soil", F.col("soil")), ("gray", F.col("gray")),
                               ("open_weight", P.open_weight("veg", "soil", "gray"))))


@query("d15_incompatible", f"""SELECT {_K} FROM pixel WHERE (r-34)*(r-34)+(g-139)*(g-139)+(b-34)*(b-34) <= 4500
 OR (r-28)*(r-28)+(g-107)*(g-107)+(b-160)*(b-160) <= 4500""", ["pixel"])
def d15(spark, sf):
    return view(spark, sf, "pixel").filter(P.incompatible("r", "g", "b", [(34, 139, 34), (28, 107, 160)])).select(*KEYS)
