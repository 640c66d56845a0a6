"""Queries on masks, overlays, components, vectors, detection and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASS_RGB, CLASSES, FEATURE_CONFIGS, OVERLAY_CANDIDATES, PREFILTER_SHARE
from ..functions import color, geo, naming
from ..functions.predicates import incompatible
from ..operators import assign, cluster, components, detect, export, overlay, tiles, vector
from ..operators.stats import attach_by
from . import cell_run, material_map as mm
from .q_grid import TILE, _NB, dilate_sql, ellipse_offsets, erode_sql, rect_offsets
from .q_materials import (ANCHORS, CENTRES6, _M3, _NAMES7, _NEAR6, _pick, argmin_sql, dist_sql)
from .q_pixels import HSV_CTE, KEYS
from .q_sources import dims_of, rect_features
from .registry import query
from .views import table, view

_K = "raster_id, row, col"
RGB = [CLASS_RGB[c["name"]] for c in CLASSES]


def block_colours(spark, sf):
    """Base image: the class colour of each block."""
    px = view(spark, sf, "pixel")
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in RGB]), F.col("blk"))
    return px.select(*KEYS, pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


_BASE = "bs AS (SELECT raster_id, row, col, " + ", ".join(
    f"case blk {' '.join(f'when {i} then {c[k]}' for i, c in enumerate(RGB))} end AS {n}" for k, n in enumerate("rgb")) + " FROM pixel)"


def mask_of(spark, sf, feature):
    return view(spark, sf, "mask").filter(F.col("feature") == feature).select(*KEYS)


def paint_sql(rules):
    """Painted colours under ordered rules: the last rule that holds wins."""
    cols = []
    for k, n in enumerate("rgb"):
        cases = " ".join(f"when {cond} then {rgb[k]}" for cond, rgb in reversed(rules))
        cols.append(f"case {cases} else {n} end AS {n}")
    return f"WITH {_BASE} SELECT {_K}, {', '.join(cols)} FROM bs"


ROAD, BLDG = "row%20 in (9,10)", "(row%25<6 and col%20<6)"



@query("g4_mask_same_grid", paint_sql([(ROAD, (45, 45, 48))]), ["pixel"])
def g4(spark, sf):
    return overlay.paint(block_colours(spark, sf), [(mask_of(spark, sf, "roads"), (45, 45, 48))])


@query("g5_mask_other_grid", paint_sql([("(cast(floor((row+0.5e0)/3) as int)%5=2 and cast(floor((col+0.5e0)/4) as int)%6<2 and cast(floor((row+0.5e0)/3) as int) < 30)", (180, 180, 180))]), ["pixel"])
def g5(spark, sf):
    coarse = view(spark, sf, "pixel").select("raster_id", F.floor(F.col("row") / 3).cast("int").alias("row"),
                                             F.floor(F.col("col") / 4).cast("int").alias("col")).distinct()
    coarse = coarse.filter("row % 5 = 2 AND col % 6 < 2 AND row < 30")
    base = block_colours(spark, sf)
    hit = overlay.align_mask(coarse, base, F.floor((F.col("row") + 0.5) / 3), F.floor((F.col("col") + 0.5) / 4))
    return overlay.paint(base, [(hit, (180, 180, 180))])


_WATER_BASE = _BASE.replace(" FROM pixel)", ", blk FROM pixel)")


def blk_paint_sql(rules):
    cols = []
    for k, n in enumerate("rgb"):
        cases = " ".join(f"when {cond} then {rgb[k]}" for cond, rgb in reversed(rules))
        cols.append(f"case {cases} else {n} end AS {n}")
    return f"WITH {_WATER_BASE} SELECT {_K}, {', '.join(cols)} FROM bs"


W_RGB, R_RGB, B_RGB = CLASS_RGB["BM_WATER"], CLASS_RGB["BM_ASPHALT"], CLASS_RGB["BM_CONCRETE"]
KM = {c["name"]: CLASS_RGB[c["name"]] for c in CLASSES if c["source"] == "kmeans"}


@query("g6_ordered_fusion", blk_paint_sql([("blk=4", W_RGB), (ROAD, R_RGB), (BLDG, B_RGB)]), ["pixel"])
def g6(spark, sf):
    masks = [(mask_of(spark, sf, "buildings"), "BM_CONCRETE", "shapefile"), (mask_of(spark, sf, "water"), "BM_WATER", "raster"),
             (mask_of(spark, sf, "roads"), "BM_ASPHALT", "shapefile")]
    return mm.fuse_masks(block_colours(spark, sf), view(spark, sf, "pixel"), masks)


@query("g7_hard_override", blk_paint_sql([(BLDG, (1, 2, 3)), (ROAD, (4, 5, 6)), ("blk=4", (7, 8, 9))]), ["pixel"])
def g7(spark, sf):
    return overlay.paint(block_colours(spark, sf), [(mask_of(spark, sf, "buildings"), (1, 2, 3)),
                                                    (mask_of(spark, sf, "roads"), (4, 5, 6)), (mask_of(spark, sf, "water"), (7, 8, 9))])


@query("k3_mask_union", f"SELECT {_K} FROM pixel WHERE {ROAD} OR {BLDG} OR blk=4", ["pixel"])
def k3(spark, sf):
    return overlay.mask_union([mask_of(spark, sf, f) for f in ("roads", "buildings", "water")])


@query("g5_rgb_mask", f"SELECT {_K} FROM pixel WHERE {ROAD}", ["pixel"])
def g5m(spark, sf):
    coloured = export.colour_mask(view(spark, sf, "pixel"), mask_of(spark, sf, "roads"), (45, 45, 48), KEYS)
    return overlay.mask_from_rgb(coloured)


# --- vectors -----------------------------------------------------------------

_H = "(SELECT max(row) FROM pixel)"


def height_of(spark, sf):
    return view(spark, sf, "pixel").agg((F.max("row") + 1).alias("h")).scalar()


_RECT_PX = f"""SELECT DISTINCT feature_id, cast(y+dy as int) AS row, cast(x+dx as int) AS col FROM rect, (VALUES (0),(1),(2)) a(dy), (VALUES (0),(1),(2),(3),(4)) c(dx)
 WHERE dy<h AND dx<w AND y+dy <= {_H} AND x+dx <= 99"""


@query("g8_burn_rectangles", _RECT_PX, ["rect", "pixel"])
def g8(spark, sf):
    return vector.burn(rect_features(spark, sf), ["feature_id"], height_of(spark, sf), 100)


_TRI = """t AS (SELECT c_custkey AS fid, c_custkey%80+0.13e0 AS x1, c_custkey%70+0.37e0 AS y1, c_custkey%80+4.61e0+c_nationkey%9 AS x2, c_custkey%70+2.29e0 AS y2,
 c_custkey%80+1.47e0 AS x3, c_custkey%70+6.83e0+c_nationkey%5 AS y3 FROM customer)"""


@query("g8_burn_triangles", f"""WITH {_TRI}, k AS (SELECT fid, row, col, (x2-x1)*(row+0.5e0-y1)-(y2-y1)*(col+0.5e0-x1) AS d1, (x3-x2)*(row+0.5e0-y2)-(y3-y2)*(col+0.5e0-x2) AS d2,
 (x1-x3)*(row+0.5e0-y3)-(y1-y3)*(col+0.5e0-x3) AS d3 FROM t JOIN pixel ON row BETWEEN y1-1 AND y3+1 AND col BETWEEN x1-1 AND x2+1)
SELECT fid, row, col FROM k WHERE (d1>0 AND d2>0 AND d3>0) OR (d1<0 AND d2<0 AND d3<0)""", ["pixel"])
def g8t(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(pt(k % 80 + 0.13, k % 70 + 0.37), pt(k % 80 + 4.61 + F.col("c_nationkey") % 9, k % 70 + 2.29),
                   pt(k % 80 + 1.47, k % 70 + 6.83 + F.col("c_nationkey") % 5))
    f = c.select(k.alias("fid"), F.array(ring).alias("rings"))
    return vector.burn(f, ["fid"], height_of(spark, sf), 100, all_touched=False)


_ROADW = "case when width_val>0 then cast(width_val as double) when lower(trim(type_val))='large' then 8e0 when lower(trim(type_val))='small' then 4e0 else 2e0 end/2e0"


@query("g10_road_strips", f"""WITH b AS (SELECT fid, x+0.3e0 AS x0, x+8.3e0 AS x1, y+0.3e0-{_ROADW} AS y0, y+0.3e0+{_ROADW} AS y1 FROM road)
SELECT fid, row, col FROM b JOIN pixel ON row BETWEEN floor(y0) AND floor(y1) AND col BETWEEN floor(x0) AND floor(x1)""", ["road", "pixel"])
def g10(spark, sf):
    r = view(spark, sf, "road")
    pt = lambda dx: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + 0.3).alias("y"))
    width = naming.road_width("width_val", "type_val", " large ", 8.0, "Small", 4.0, 2.0)
    lines = r.select("fid", F.array(pt(0.3), pt(8.3)).alias("points"), (width / 2).alias("hw"))
    return vector.burn_lines(lines, ["fid"], "points", "hw", height_of(spark, sf), 100)


_BEND = f"""b AS (SELECT fid, x+0.3e0 AS x0, y+0.3e0 AS y0, x+5.3e0 AS x1, y+6.3e0 AS y1, {_ROADW} AS hw FROM road),
near AS (SELECT fid, row, col, col+0.5e0 AS cx, row+0.5e0 AS cy, x0, y0, x1, y1, hw FROM b JOIN pixel ON row BETWEEN y0-hw-1 AND y1+hw+1 AND col BETWEEN x0-1 AND x1+hw+1),
ang AS (SELECT i, 2*pi()/64 AS st FROM generate_series(0,63) a(i)),
disc AS (SELECT fid, row, col FROM near, ang WHERE (cx-x1)*(cx-x1)+(cy-y0)*(cy-y0) <= hw*hw GROUP BY 1,2,3
 HAVING min(hw*(cos((i+1)*st)-cos(i*st))*(cy-y0-hw*sin(i*st)) - hw*(sin((i+1)*st)-sin(i*st))*(cx-x1-hw*cos(i*st))) > 0)"""


@query("g10_road_bends", f"""WITH {_BEND}
SELECT fid, row, col FROM near WHERE (cx BETWEEN x0 AND x1 AND abs(cy-y0) < hw) OR (cy BETWEEN y0 AND y1 AND abs(cx-x1) < hw)
UNION SELECT * FROM disc""", ["road", "pixel"])
def g10b(spark, sf):
    """Three-point roads: strips and the joining disc, by pixel centres."""
    r = view(spark, sf, "road")
    pt = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    width = naming.road_width("width_val", "type_val", " large ", 8.0, "Small", 4.0, 2.0)
    lines = r.select("fid", F.array(pt(0.3, 0.3), pt(5.3, 0.3), pt(5.3, 6.3)).alias("points"), (width / 2).alias("hw"))
    return vector.burn_lines(lines, ["fid"], "points", "hw", height_of(spark, sf), 100, all_touched=False)


_CAND = "cand(i, cr, cg, cb) AS (VALUES " + ",".join(f"({i},{r},{g},{b})" for i, (r, g, b) in enumerate(OVERLAY_CANDIDATES)) + ")"


def picks_sql(classes, n):
    return f"""{_CAND}, cls AS ({classes}),
nr AS (SELECT i, cr, cg, cb, EXISTS (SELECT 1 FROM cls WHERE power(r-cr,2)+power(g-cg,2)+power(b-cb,2) <= 6400) AS near FROM cand),
rk AS (SELECT row_number() OVER (ORDER BY near, i)-1 AS layer, cr, cg, cb FROM nr),
auto AS (SELECT cast(k.layer as int) AS layer, coalesce(cr,255) AS r, coalesce(cg,255) AS g, coalesce(cb,0) AS b FROM ({n}) k LEFT JOIN rk ON rk.layer=k.layer)"""


_NATCLS = "SELECT cast(concat('0x', substr(md5(cast(n_nationkey as varchar)),1,2)) as integer) AS r, cast(concat('0x', substr(md5(cast(n_nationkey as varchar)),3,2)) as integer) AS g, cast(concat('0x', substr(md5(cast(n_nationkey as varchar)),5,2)) as integer) AS b FROM nation"


def nation_classes(spark, sf):
    hexed = F.concat(F.lit("#"), F.substring(F.md5(F.col("n_nationkey").cast("string")), 1, 6))
    c = color.hex_to_rgb("color")
    return table(spark, sf, "nation").select("n_nationkey", hexed.alias("color")).select(
        "n_nationkey", "color", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


@query("g13_overlay_colours", f"WITH {picks_sql(_NATCLS, 'SELECT unnest(generate_series(0,12)) AS layer')} SELECT * FROM auto")
def g13(spark, sf):
    return overlay.pick_overlay_colours(nation_classes(spark, sf), 13)


_LAYER = """lay AS (SELECT cast(s_suppkey as int)%12 AS layer, s_suppkey AS key, case when s_suppkey%3=0 then concat('class-', (s_suppkey*7)%60) when s_suppkey%3=1 then 'zzz' else '' end AS class_id,
 case s_suppkey%5 when 0 then 'BM_WATER' when 1 then 'BM_MUD' when 2 then 'roads' when 3 then 'BM_SAND' else '' end AS name, case when s_suppkey%4=0 then '#AABB01' end AS override FROM supplier)"""
_VALID = "regexp_matches(color, '^#[0-9A-Fa-f]{6}$')"


@query("g12_overlay_resolve", f"""WITH {picks_sql(_NATCLS, 'SELECT unnest(generate_series(0,11)) AS layer')}, {_LAYER},
pc AS (SELECT * FROM part_class WHERE pos%2=1 OR name='BM_MUD'),
ids AS (SELECT id, arg_max(lower(color), pos) AS c FROM pc WHERE {_VALID} GROUP BY id), nms AS (SELECT name, arg_max(lower(color), pos) AS c FROM pc WHERE {_VALID} GROUP BY name),
bid(id, c) AS (VALUES {','.join(f"('{c['id']}','{c['color'].lower()}')" for c in CLASSES)}), bnm(name, c) AS (VALUES {','.join(f"('{c['name']}','{c['color'].lower()}')" for c in CLASSES)})
SELECT key, coalesce(ids.c, nms.c, bid.c, bnm.c, lower(override), printf('#%02x%02x%02x', auto.r, auto.g, auto.b)) AS color
FROM lay LEFT JOIN ids ON ids.id=class_id LEFT JOIN nms ON nms.name=lay.name LEFT JOIN bid ON bid.id=class_id LEFT JOIN bnm ON bnm.name=lay.name LEFT JOIN auto ON auto.layer=lay.layer""", ["part_class"])
def g12(spark, sf):
    k = F.col("s_suppkey")
    lay = table(spark, sf, "supplier").select(
        (k.cast("int") % 12).alias("layer"), k.alias("key"),
        F.when(k % 3 == 0, F.concat(F.lit("class-"), k * 7 % 60)).when(k % 3 == 1, "zzz").otherwise("").alias("class_id"),
        F.when(k % 5 == 0, "BM_WATER").when(k % 5 == 1, "BM_MUD").when(k % 5 == 2, "roads").when(k % 5 == 3, "BM_SAND").otherwise("").alias("name"),
        F.when(k % 4 == 0, "#AABB01").alias("override"))
    classes = view(spark, sf, "part_class").filter("pos % 2 = 1 OR name = 'BM_MUD'")
    auto = overlay.pick_overlay_colours(nation_classes(spark, sf), 12)
    return overlay.resolve_overlay_colours(lay, classes, auto).select("key", "color")


@query("g8_burn_values", "SELECT cast(s_suppkey as int) AS layer, cast(s_suppkey as int)+7 AS burn FROM supplier")
def g8v(spark, sf):
    return overlay.numbered_layers(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("layer")), 6)


@query("g18_fallback_coordinates", """
WITH l AS (SELECT layer, feature_id, x, y, w, h, case layer when 'BUILDING' then 0 when 'AUTOMOBILE' then 1000 when 'MACHINERY' then 2000 else 500 end AS off,
 case layer when 'MACHINERY' then 3000 when 'AUTOMOBILE' then 0 else 900 end AS orig FROM rect),
b AS (SELECT layer, min(x+0.25)+min(off) <= 100 AND max(x+w-0.25)+min(off) >= 0 AS p, min(x+0.25)+min(orig) <= 100 AND max(x+w-0.25)+min(orig) >= 0 AS o FROM l GROUP BY layer)
SELECT l.layer, feature_id, case when p then 'projected' else 'original' end AS coords, round(x+0.25+case when p then off else orig end, 4)::DOUBLE AS first_x
FROM l JOIN b ON b.layer=l.layer WHERE p OR o""", ["rect"])
def g18(spark, sf):
    f = rect_features(spark, sf)
    layer = F.col("layer")
    off = F.when(layer == "BUILDING", 0).when(layer == "AUTOMOBILE", 1000).when(layer == "MACHINERY", 2000).otherwise(500)
    orig = F.when(layer == "MACHINERY", 3000).when(layer == "AUTOMOBILE", 0).otherwise(900)
    move = lambda d: F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + d).alias("x"), p["y"].alias("y"))))
    f = f.withColumn("orig_rings", move(orig)).withColumn("rings", move(off))
    out = vector.with_fallback_rings(f, geo.lit_box(0, 0, 100, 100))
    first = F.element_at(F.element_at("rings", 1), 1)["x"]
    return out.select("layer", "feature_id", "coords", F.round(first, 4).alias("first_x"))


# --- components --------------------------------------------------------------

def reach_sql(source, conn, extra="0 AS grp"):
    near = "abs(p.row-q.row)<=1 AND abs(p.col-q.col)<=1" if conn == 8 else "abs(p.row-q.row)+abs(p.col-q.col)<=1"
    return f"""ms AS ({source}),
e AS (SELECT p.grp, (cast(p.row as bigint)<<31)+p.col AS a, (cast(q.row as bigint)<<31)+q.col AS b FROM ms p JOIN ms q ON q.grp=p.grp AND q.row BETWEEN p.row-1 AND p.row+1 AND {near}),
reach(grp, n, m) AS (SELECT grp, (cast(row as bigint)<<31)+col, (cast(row as bigint)<<31)+col FROM ms UNION SELECT reach.grp, reach.n, e.b FROM reach JOIN e ON e.a=reach.m AND e.grp=reach.grp),
cc AS (SELECT grp, cast(n>>31 as int) AS row, cast(n&2147483647 as int) AS col, min(m) AS comp FROM reach GROUP BY 1,2,3)"""


@query("i1_components_8", f"WITH RECURSIVE {reach_sql('SELECT feature AS grp, row, col FROM mask', 8)} SELECT grp AS feature, row, col, comp FROM cc", ["mask"])
def i1(spark, sf):
    out = components.label_components(view(spark, sf, "mask"), ["raster_id", "feature"], 16, 8)
    return out.select("feature", "row", "col", "comp")


@query("i1_components_4", f"WITH RECURSIVE {reach_sql('SELECT blk AS grp, row, col FROM pixel', 4)} SELECT grp AS blk, row, col, comp FROM cc", ["pixel"])
def i14(spark, sf):
    return components.label_components(view(spark, sf, "pixel"), ["raster_id", "blk"], 32, 4).select("blk", "row", "col", "comp")


_BAD = "((r-34)*(r-34)+(g-139)*(g-139)+(b-34)*(b-34) <= 4500 OR (r-28)*(r-28)+(g-107)*(g-107)+(b-160)*(b-160) <= 4500)"
_VETO = f"""{reach_sql("SELECT feature AS grp, row, col FROM mask WHERE feature IN ('roads','buildings')", 8)},
v AS (SELECT grp AS feature, comp, count(*) AS area, count(*) FILTER (WHERE {_BAD}) AS bad FROM cc JOIN pixel USING (row,col) GROUP BY 1,2)"""


@query("i4_component_veto", f"WITH RECURSIVE {_VETO} SELECT feature, comp, area, bad, bad/cast(area as double) >= 0.3e0 AS vetoed FROM v", ["mask"])
def i4(spark, sf):
    return veto_table(spark, sf).select("feature", "comp", "area", "bad", "vetoed")


def veto_table(spark, sf):
    by = ["raster_id", "feature"]
    masks = view(spark, sf, "mask").filter("feature IN ('roads', 'buildings')")
    labels = components.label_components(masks, by, 16, 8)
    bad = view(spark, sf, "pixel").filter(incompatible("r", "g", "b", [(34, 139, 34), (28, 107, 160)]))
    both = bad.withColumn("feature", F.explode(F.array(F.lit("roads"), F.lit("buildings"))))
    return components.vetoed_components(labels, both, 0.3, by)


@query("h14_veto_totals", f"WITH RECURSIVE {_VETO} SELECT feature AS material, count(*) AS total, count(*) FILTER (WHERE bad/cast(area as double) >= 0.3e0) AS vetoed FROM v GROUP BY 1", ["mask"])
def h14(spark, sf):
    return overlay.veto_summary(veto_table(spark, sf).withColumnRenamed("feature", "material"))


@query("i4_veto_fusion", f"""WITH RECURSIVE {reach_sql("SELECT 'buildings' AS grp, row, col FROM mask WHERE feature='buildings'", 8)}, {_BASE},
v AS (SELECT comp, avg(case when {_BAD} then 1e0 else 0e0 end) >= 0.55e0 AS vetoed FROM cc JOIN pixel USING (row,col) GROUP BY 1),
k AS (SELECT row, col FROM cc JOIN v USING (comp) WHERE NOT vetoed)
SELECT raster_id, bs.row, bs.col, case when k.row IS NOT NULL then 180 else r end AS r, case when k.row IS NOT NULL then 180 else g end AS g, case when k.row IS NOT NULL then 180 else b end AS b
FROM bs LEFT JOIN k ON k.row=bs.row AND k.col=bs.col""", ["mask"])
def i4f(spark, sf):
    """A mask of unknown origin loses the components that look like vegetation or water."""
    return overlay.fuse(block_colours(spark, sf), view(spark, sf, "pixel"),
                        [(mask_of(spark, sf, "buildings"), "BM_CONCRETE", "survey")],
                        {**KM, "BM_WATER": W_RGB}, 16)


@query("i6_area_filter", f"""WITH RECURSIVE {reach_sql('SELECT blk AS grp, row, col FROM pixel', 8)}
SELECT grp AS blk, comp, count(*) AS area FROM cc GROUP BY 1,2 HAVING count(*) >= 120""", ["pixel"])
def i6(spark, sf):
    labels = components.label_components(view(spark, sf, "pixel"), ["raster_id", "blk"], 32, 8)
    return components.component_stats(labels, ["raster_id", "blk"]).filter("area >= 120").select("blk", "comp", "area")


@query("i7_water_shapes", f"""WITH RECURSIVE {reach_sql('SELECT blk AS grp, row, col FROM pixel', 8)},
s AS (SELECT grp, comp, count(*) AS area, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM cc JOIN pixel USING (row, col) GROUP BY 1,2)
SELECT grp AS blk, comp, area FROM s WHERE area >= 100 AND area <= 9500 AND NOT (area < 200 AND ((mr>mb+30 AND mr>mg+20) OR (mr>200 AND mg>200 AND mb>200)))""", ["pixel"])
def i7(spark, sf):
    by = ["raster_id", "blk"]
    px = view(spark, sf, "pixel")
    labels = components.label_components(px, by, 32, 8).join(px, [*by, "row", "col"])
    s = components.component_stats(labels, by, [F.avg(c).alias(f"m{c}") for c in "rgb"])
    odd = ((F.col("mr") > F.col("mb") + 30) & (F.col("mr") > F.col("mg") + 20)) | (
        (F.col("mr") > 200) & (F.col("mg") > 200) & (F.col("mb") > 200))
    return s.filter((F.col("area") >= 100) & (F.col("area") <= 9500) & ~((F.col("area") < 200) & odd)).select("blk", "comp", "area")


@query("i5_solidity", f"""WITH RECURSIVE {reach_sql('SELECT blk AS grp, row, col FROM pixel', 4)},
s AS (SELECT grp, comp, count(*) AS area, (max(row)-min(row)+1)*(max(col)-min(col)+1) AS box FROM cc GROUP BY 1,2)
SELECT grp AS blk, comp, area, round(cast(box as double),4) AS hull, round(area/cast(box as double),6) AS solidity FROM s""", ["pixel"])
def i5(spark, sf):
    """Blocks are rectangles, so each hull is its box."""
    by = ["raster_id", "blk"]
    labels = components.label_components(view(spark, sf, "pixel"), by, 16, 4)
    both = components.component_stats(labels, by).join(detect.solidity(labels, by), [*by, "comp"])
    return both.select("blk", "comp", "area", F.round("hull", 4).alias("hull"), F.round(F.col("area") / F.col("hull"), 6).alias("solidity"))


@query("e10_fill_holes", f"""WITH RECURSIVE dm AS (SELECT max(row) AS mr, max(col) AS mc FROM pixel), {reach_sql('SELECT 0 AS grp, row, col FROM pixel WHERE blk=3', 4)},
h AS (SELECT comp FROM cc, dm GROUP BY comp HAVING NOT bool_or(row=0 OR col=0 OR row=mr OR col=mc))
SELECT row, col FROM pixel WHERE blk<>3 UNION ALL SELECT row, col FROM cc WHERE comp IN (SELECT comp FROM h)""", ["pixel"])
def e10(spark, sf):
    px = view(spark, sf, "pixel")
    return components.fill_holes(px.filter("blk <> 3"), px.filter("blk = 3"), height_of(spark, sf), F.lit(100), None, 16).select("row", "col")


# --- detection ---------------------------------------------------------------

_BR, _SR = "(r+g+b)/3e0", "greatest(r,g,b)-least(r,g,b)"
_PRE = {
    "roads": f"{_SR}<30 AND abs(r-b)<20 AND {_BR}>30 AND {_BR}<175",
    "buildings": f"({_SR}<40 AND {_BR}>40 AND {_BR}<240) OR (r>g+20 AND r>b+35 AND {_BR}>50 AND {_BR}<230) OR ({_SR}<25 AND {_BR}>160)",
    "trees": f"g-greatest(r,b)>8 AND {_BR}<170",
    "fields": f"(g>r+5 AND g>b+10 AND {_BR}>40) OR ((r+g)/2e0-b>15 AND {_BR}>40 AND {_BR}<220 AND g>b)",
    "water": f"(b>r+5 AND b>g-15 AND b>20) OR (b>=r AND {_BR}<90 AND b>15) OR (g>r AND b>r AND {_BR}<150) OR {_BR}<40",
}


_PRE_ROADS = _PRE["roads"]


@query("d10_feature_prefilter", "WITH v AS (SELECT * FROM scene WHERE r>5 OR g>5 OR b>5) " + " UNION ALL ".join(
    f"SELECT raster_id, '{f}' AS feature, count(*) AS n_valid, round(avg(case when {c} then 1e0 else 0e0 end),6) AS ratio, count(*) < 100 OR avg(case when {c} then 1e0 else 0e0 end) > {PREFILTER_SHARE[f]}e0 AS run FROM v GROUP BY 1"
    for f, c in _PRE.items()), ["scene"])
def d10(spark, sf):
    px = view(spark, sf, "scene")
    thumb = detect.thumbnail(px, dims_of(px))
    outs = [detect.feature_ratio(thumb, f).withColumn("feature", F.lit(f)) for f in PREFILTER_SHARE]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.select("raster_id", "feature", "n_valid", F.round("ratio", 6).alias("ratio"), "run")


_GRAYED = "SELECT raster_id, row, col, cast(floor(r/2) as int) AS r, cast(floor(g/2) as int) AS g, cast(floor(b/2) as int) AS b FROM scene"


@query("d11_road_lines", f"""
WITH t AS ({_GRAYED}), sz AS (SELECT raster_id, greatest(8, cast(floor(least(max(row)+1, max(col)+1)*0.07e0) as int)) AS need FROM t GROUP BY 1),
p AS (SELECT raster_id, row, col, th, radians(th) AS a FROM t, generate_series(0,179) g(th) WHERE {_PRE_ROADS}),
v AS (SELECT raster_id, th, round_even(col*cos(a)+row*sin(a),0) AS rho, -col*sin(a)+row*cos(a) AS along FROM p),
w AS (SELECT *, case when along - lag(along) OVER k > 10 then 1 else 0 end AS brk, count(*) OVER (PARTITION BY raster_id, th, rho) AS votes FROM v WINDOW k AS (PARTITION BY raster_id, th, rho ORDER BY along)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY raster_id, th, rho ORDER BY along ROWS UNBOUNDED PRECEDING) AS isl FROM w WHERE votes >= 12),
l AS (SELECT raster_id, max(len) AS longest FROM (SELECT raster_id, max(along)-min(along) AS len FROM i GROUP BY raster_id, th, rho, isl) z GROUP BY 1)
SELECT sz.raster_id, round(coalesce(longest,0e0),4) AS longest, coalesce(longest,0e0) >= need AS has_line FROM sz LEFT JOIN l USING (raster_id)""", ["scene"])
def d11(spark, sf):
    """The scenes at half brightness, so their concrete reads as road surface."""
    px = view(spark, sf, "scene").select(*KEYS, *[F.floor(F.col(c) / 2).cast("int").alias(c) for c in "rgb"])
    out = detect.line_structures(detect.thumbnail(px, dims_of(px)))
    return out.select("raster_id", F.round("longest", 4).alias("longest"), "has_line")


def enlarged(spark, sf, by: int = 3):
    """The raster at three times its size, so shapes pass the area rules."""
    steps = F.sequence(F.lit(0), F.lit(by - 1))
    px = view(spark, sf, "pixel").withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return px.select("raster_id", (F.col("row") * by + F.col("dy")).alias("row"), (F.col("col") * by + F.col("dx")).alias("col"), "r", "g", "b")


_BIG = "big AS (SELECT raster_id, row*3+dy AS row, col*3+dx AS col, r, g, b FROM pixel, (VALUES (0),(1),(2)) a(dy), (VALUES (0),(1),(2)) c(dx))"


def detect_sql(rule, opened, closed, floor):
    """Colour rule, opening, closing and the area rule on the enlarged raster.

    Components come from label propagation: the lowest position spreads until
    nothing changes.
    """
    swap = lambda t: t.replace("FROM pixel", "FROM big")
    hsv = swap(HSV_CTE)
    steps = [swap(erode_sql("m0", opened, "m1")), f"m2 AS ({dilate_sql('m1', opened)})", f"m3 AS ({dilate_sql('m2', closed)})",
             swap(erode_sql("m3", closed, "m4"))]
    return f"""WITH RECURSIVE {_BIG}, dm AS (SELECT max(row) AS mr, max(col) AS mc FROM big), {hsv}, m0 AS (SELECT raster_id, row, col FROM hsv WHERE {rule}),
{', '.join(steps)}, nd AS (SELECT row*100000+col AS id, row, col FROM m4),
ed AS (SELECT a.id AS a, b.id AS b FROM nd a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy,dx) JOIN nd b ON b.row=a.row+dy AND b.col=a.col+dx),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nd UNION
 (SELECT ed.a, min(cc.comp) FROM cc JOIN ed ON ed.b=cc.id JOIN recurring.cc AS old ON old.id=ed.a GROUP BY ed.a HAVING min(cc.comp) < min(old.comp))),
ok AS (SELECT comp FROM cc GROUP BY 1 HAVING count(*) >= {floor})
SELECT 'r0' AS raster_id, cast(floor(id/100000) as int) AS row, cast(id%100000 as int) AS col FROM cc WHERE comp IN (SELECT comp FROM ok)"""


_DETECT_SQL = {
    "trees": detect_sql("h>25 AND h<90 AND s>30 AND v>25 AND v<170", ellipse_offsets(3), ellipse_offsets(11), 400),
    "fields": detect_sql("(h>25 AND h<85 AND s>20 AND v>60 AND v<240) OR (h>18 AND h<35 AND s>25 AND v>80)",
                         ellipse_offsets(5), rect_offsets(15), 800),
}
for _kind in ("buildings", "trees", "fields", "water"):
    @query(f"u1_detect_{_kind}", _DETECT_SQL.get(_kind), ["pixel"])
    def u1(spark, sf, kind=_kind):
        return detect.detect(enlarged(spark, sf), kind, 100_000, 128)


def green_model(rgb, prompt, threshold):
    """Stand-in for a user's segmenter: green pixels, by a fixed rule."""
    a = rgb.astype(int)
    return a[:, :, 1] > a[:, :, 0] + 100 * threshold


@query("u2_segment_tiles", f"SELECT {_K} FROM pixel WHERE g > r + 20", ["pixel"])
def u2(spark, sf):
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    return detect.mask_pixels(detect.segment_tiles(packed, green_model, "green", 0.2, TILE, 10, max_share=1.0))


# --- whole runs --------------------------------------------------------------

FEATS = ["mean_r", "mean_g", "mean_b", "texture", "vari", "sat"]
RAW3 = [(40.0, 130.0, 45.0, 5.0, 0.5, 0.6), (230.0, 200.0, 175.0, 5.0, -0.05, 0.25), (100.0, 70.0, 40.0, 8.0, -0.2, 0.6)]
_FSQL = f"""{_NB}, bx AS (SELECT raster_id, row, col, avg(qr) AS mean_r, avg(qg) AS mean_g, avg(qb) AS mean_b, sqrt(greatest(avg(gray*gray)-avg(gray)*avg(gray),0e0)) AS texture FROM nb GROUP BY 1,2,3),
ft AS (SELECT p.*, mean_r, mean_g, mean_b, texture, greatest(-1e0, least(1e0, (g-r)/(case when abs(g+r-b)<1e-6 then 1e-6 else cast(g+r-b as double) end))) AS vari,
 (greatest(r,g,b)-least(r,g,b))/(greatest(r,g,b)+1e-6) AS sat FROM pixel p JOIN bx USING (raster_id,row,col)),
sc AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATS)} FROM ft),
dd AS (SELECT ft.raster_id, ft.row, ft.col, ft.r, ft.g, ft.b, {', '.join('+'.join(f'power(({f}-{v!r}e0)/s_{f},2)'.replace('--', '+') for f, v in zip(FEATS, c)) + f' AS d{i}' for i, c in enumerate(RAW3, 1))} FROM ft, sc),
lab AS (SELECT *, case when d1<=d2 AND d1<=d3 then 1 when d2<=d3 then 2 else 3 end AS cluster FROM dd)"""


def given_model(feats):
    """A model with fixed centres in feature units, scaled by the data."""
    scaler = cluster.fit_scaler(feats, FEATS)
    z = tuple(tuple((v - scaler[f][0]) / scaler[f][1] for f, v in zip(FEATS, c)) for c in RAW3)
    return mm.Model(tuple(FEATS), scaler, z)


@query("p1_classify_labels", f"WITH {_FSQL} SELECT raster_id, row, col, cluster FROM lab", ["pixel"])
def p1l(spark, sf):
    opts = mm.Options(tile=TILE)
    feats = mm.features(view(spark, sf, "pixel"), opts)
    return mm.label(feats, given_model(feats), opts).select(*KEYS, "cluster")


_P1 = f"""{_FSQL}, mn AS (SELECT cluster, cast(floor(avg(r)) as int) AS r, cast(floor(avg(g)) as int) AS g, cast(floor(avg(b)) as int) AS b FROM lab GROUP BY 1),
{_M3.split('c AS', 1)[1].join(['c AS', '']).replace('raster_id, cluster', "'x' AS raster_id, cluster").replace('FROM m)', 'FROM mn)')},
pm(x,y,z) AS (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)),
t AS (SELECT x, y, z, {_pick('a','x')}+{_pick('b','y')}+{_pick('d','z')} AS total FROM c a, c b, c d, pm WHERE a.cluster=1 AND b.cluster=2 AND d.cluster=3),
w AS (SELECT * FROM t ORDER BY total LIMIT 1)"""


@query("p1_classify_and_export", f"""WITH {_P1}
SELECT raster_id, row, col, cluster, case when r+g+b>=24 then ['BM_VEGETATION','BM_SAND','BM_SOIL'][case cluster when 1 then x when 2 then y else z end + 1] end AS material,
 {', '.join(f"case when r+g+b>=24 then [{KM['BM_VEGETATION'][k]},{KM['BM_SAND'][k]},{KM['BM_SOIL'][k]}][case cluster when 1 then x when 2 then y else z end + 1] else 0 end AS {n}" for k, n in enumerate('rgb'))}
FROM lab, w""", ["pixel"])
def p1(spark, sf):
    px = view(spark, sf, "pixel")
    opts = mm.Options(tile=TILE, use_prior=False)
    return mm.classify(px, dims_of(px), opts, given_model(mm.features(px, opts)))


@query("p1_trained_run")
def p1t(spark, sf):
    """Training, prior, smoothing and painting in one run."""
    px = view(spark, sf, "pixel")
    return mm.material_shares(mm.classify(px, dims_of(px), mm.Options(tile=64, smoothing="median_2", nir=True)))


@query("p1_score_tiles", f"WITH {_FSQL} SELECT case when r+g+b>=24 then cluster else 0 end AS cluster, count(*) AS n FROM lab GROUP BY 1", ["pixel"])
def p1s(spark, sf):
    """The storage form: byte tiles in, label tiles out, counted in the tile."""
    px = view(spark, sf, "pixel")
    opts = mm.Options(tile=TILE)
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    labels = mm.score_tiles(packed, given_model(mm.features(px, opts)), opts)
    return mm.tile_histogram(labels).select("cluster", "n")


@query("p6_trained_tiles")
def p6tt(spark, sf):
    """Stored tiles of all scenes: window training, shared names, label tiles."""
    px = view(spark, sf, "scene")
    opts = mm.Options(tile=TILE)
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    labels, _ = mm.classify_tiles(packed, opts)
    return mm.tile_histogram(labels).select("cluster", "n")


_TRAINED = f"""{_FSQL.replace("FROM ft)," + chr(10) + "dd", "FROM ft WHERE r+g+b>=24)," + chr(10) + "dd")},
lf AS (SELECT ft.*, cluster FROM ft JOIN lab USING (raster_id, row, col)),
k1 AS (SELECT cluster, {', '.join(f'avg({f}) AS c_{f}' for f in FEATS)} FROM lf WHERE r+g+b>=24 GROUP BY 1),
tr AS (SELECT lf.raster_id, lf.row, lf.col, lf.r+lf.g+lf.b>=24 AS ok, arg_min(k1.cluster, {'+'.join(f'power(({f}-c_{f})/s_{f},2)' for f in FEATS)}) AS cluster
 FROM lf, k1, sc GROUP BY 1,2,3,4)"""


@query("u3_model_interface", f"WITH {_TRAINED} SELECT case when ok then cluster else 0 end AS cluster, count(*) AS n FROM tr GROUP BY 1", ["pixel"])
def u3(spark, sf):
    """Estimator and model on stored tiles: one round from a fixed start, then label tiles."""
    from ..models import TileKMeans
    px = view(spark, sf, "pixel")
    packed = tiles.pixels_to_tiles(px, ["r", "g", "b"], TILE, dims_of(px))
    model = TileKMeans(k=3, tile=TILE, maxIter=1, start=[v for c in RAW3 for v in c]).fit(packed)
    return mm.tile_histogram(model.transform(packed)).select("cluster", "n")


_RECT_HIT = "EXISTS (SELECT 1 FROM rect f WHERE bs.row>=f.y AND bs.row<f.y+f.h AND bs.col>=f.x AND bs.col<f.x+f.w{})"


@query("p2_overlay_vectors", f"""WITH {_BASE} SELECT raster_id, row, col, """ + ", ".join(
    f"case when {_RECT_HIT.format(' AND f.fid%2=0')} then {a} when {_RECT_HIT.format(' AND f.fid%2=1')} then {o} else {n} end AS {n}"
    for n, o, a in (("r", 255, 0), ("g", 0, 255), ("b", 255, 255))) + " FROM bs", ["rect", "pixel"])
def p2(spark, sf):
    base = block_colours(spark, sf)
    f = rect_features(spark, sf)
    burn = lambda odd: vector.burn(f.filter(F.col("fid") % 2 == odd).withColumn("raster_id", F.lit("r0")),
                                   ["raster_id", "feature_id"], height_of(spark, sf), 100)
    return overlay.paint(base, [(burn(1), (255, 0, 255)), (burn(0), (0, 255, 255))])


@query("p3_classify_with_vectors", f"""WITH {_P1}, bs AS (SELECT raster_id, row, col, r+g+b>=24 AS ok,
 ['BM_VEGETATION','BM_SAND','BM_SOIL'][case cluster when 1 then x when 2 then y else z end + 1] AS material FROM lab, w)
SELECT case when {_RECT_HIT.format('')} then 'overlay' when ok then material else 'uncovered' end AS shown, count(*) AS n_px FROM bs GROUP BY 1""", ["rect", "pixel"])
def p3(spark, sf):
    px = view(spark, sf, "pixel")
    opts = mm.Options(tile=TILE, use_prior=False)
    painted = mm.classify(px, dims_of(px), opts, given_model(mm.features(px, opts)))
    hit = vector.burn(rect_features(spark, sf).withColumn("raster_id", F.lit("r0")), ["raster_id", "feature_id"],
                      height_of(spark, sf), 100)
    out = overlay.paint(painted, [(hit, (255, 255, 0))])
    names = naming.literal_map({0: "uncovered", (255 << 16) | (255 << 8): "overlay"} | {
        (r << 16) | (g << 8) | b: n for n, (r, g, b) in KM.items()})
    return out.groupBy(names[color.pack_rgb("r", "g", "b")].alias("shown")).agg(F.count("*").alias("n_px"))


@query("p4_classify_with_masks", f"""WITH {_P1}
SELECT case when {BLDG} then 2 when {ROAD} then 1 when blk=4 then 4 when r+g+b<24 then 0 else [3,5,6][case cluster when 1 then x when 2 then y else z end + 1] end AS cmix, count(*) AS n_px
FROM lab JOIN (SELECT row, col, blk FROM pixel) q USING (row, col), w GROUP BY 1""", ["pixel"])
def p4(spark, sf):
    px = view(spark, sf, "pixel")
    opts = mm.Options(tile=TILE, use_prior=False)
    painted = mm.classify(px, dims_of(px), opts, given_model(mm.features(px, opts)))
    masks = [(mask_of(spark, sf, "water"), "BM_WATER", "raster"), (mask_of(spark, sf, "roads"), "BM_ASPHALT", "shapefile"),
             (mask_of(spark, sf, "buildings"), "BM_CONCRETE", "shapefile")]
    _, hist = mm.export_index(mm.fuse_masks(painted, px, masks, opts), F.lit(0), strict=True)
    return hist.select("cmix", "n_px")


_P5 = """sp AS (SELECT raster_id AS path, cast(substr(raster_id,2) as int) AS k, row, col, r, g, b FROM scene),
av AS (SELECT path, k%3+1 AS priority, cast(floor(row/2)+(k%8)*6 as int) AS row, cast(floor(col/2)+(k%5)*9 as int) AS col, cast(floor(avg(r)+0.5e0) as int) AS r, cast(floor(avg(g)+0.5e0) as int) AS g, cast(floor(avg(b)+0.5e0) as int) AS b FROM sp GROUP BY 1,2,3,4),
cp AS (SELECT row, col, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY priority, path DESC) AS n FROM av WHERE r+g+b>=24) z WHERE n=1)"""
CELL = cell_run.CellConfig(33, 35, (cell_run.Layer("/data/a", 1), cell_run.Layer("/data/b", 2), cell_run.Layer("/data/c", 3)), "/out/cell.tif", max_side=1000)


def cell_sources(spark, sf):
    """Scenes placed on the cell at half its pixel size, on even offsets."""
    px = view(spark, sf, "scene").withColumnRenamed("raster_id", "path")
    k = F.substring("path", 2, 9).cast("int")
    step = 0.001
    west, north = F.lit(35.0) + k % 5 * 9 * step, F.lit(34.0) - k % 8 * 6 * step
    src = px.groupBy("path").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    src = src.select("path", (k % 3 + 1).alias("priority"), west.alias("west"), north.alias("north"),
                     (west + F.col("w") * step / 2).alias("east"), (north - F.col("h") * step / 2).alias("south"),
                     F.lit(step / 2).alias("px_x"), F.lit(step / 2).alias("px_y"), F.lit(step).alias("px"))
    return px, src


@query("p5_cell_mosaic", f"WITH {_P5} SELECT row, col, r, g, b FROM cp", ["scene"])
def p5m(spark, sf):
    px, src = cell_sources(spark, sf)
    return cell_run.mosaic(px, src, CELL)[0].select("row", "col", "r", "g", "b")


@query("p5_cell_mosaic_tiles", f"WITH {_P5} SELECT row, col, r, g, b FROM cp", ["scene"])
def p5t(spark, sf):
    """The same mosaic from stored tiles."""
    px, src = cell_sources(spark, sf)
    sized = src.select(F.col("path").alias("raster_id"), F.lit(20).alias("raster_h"), F.lit(100).alias("raster_w"))
    packed = tiles.pixels_to_tiles(px.withColumnRenamed("path", "raster_id"), ["r", "g", "b"], 16, sized)
    merged, _, _, _ = cell_run.mosaic_tiles(packed, src, CELL, 64)
    return tiles.tiles_to_pixels(merged, ["r", "g", "b"], drop_blank=True).select("row", "col", "r", "g", "b")


@query("p5_cell_run", f"""WITH {_P5} SELECT {_NEAR6} AS cmix, {_NAMES7}[{_NEAR6}+1] AS name, count(*) AS n_px FROM cp GROUP BY 1,2""", ["scene"])
def p5(spark, sf):
    """Cell mosaic, nearest class colour and index histogram."""
    px, src = cell_sources(spark, sf)
    image, _, _, _ = cell_run.mosaic(px, src, CELL)
    lab = cluster.nearest_centre(image, ["r", "g", "b"], [tuple(map(float, c)) for c in RGB])
    painted = assign.paint_labels(lab, 6, dict(enumerate(RGB, 1))).select(
        "raster_id", "row", "col", F.col("paint_r").alias("r"), F.col("paint_g").alias("g"), F.col("paint_b").alias("b"))
    return mm.export_index(painted, F.lit(0), strict=True)[1].select("cmix", "name", "n_px")


@query("p5_whole_cell_index", f"""WITH {_P5}, c AS (SELECT {_NEAR6} AS cmix, count(*) AS n FROM cp GROUP BY 1)
SELECT cmix, cast(sum(n) as bigint) AS n_px, round(sum(n)*100e0/1000000,6) AS pct FROM (SELECT cmix, n FROM c UNION ALL SELECT 0, 1000000-(SELECT sum(n) FROM c)) z GROUP BY 1""", ["scene"])
def p5w(spark, sf):
    """Index of the whole cell: what no image covers counts as zero."""
    px, src = cell_sources(spark, sf)
    image, width, height, _ = cell_run.mosaic(px, src, CELL)
    lab = cluster.nearest_centre(image, ["r", "g", "b"], [tuple(map(float, c)) for c in RGB])
    painted = assign.paint_labels(lab, 6, dict(enumerate(RGB, 1))).select(
        "raster_id", "row", "col", F.col("paint_r").alias("r"), F.col("paint_g").alias("g"), F.col("paint_b").alias("b"))
    index, _ = mm.export_index(painted, F.lit(0), strict=True, size=(height, width))
    return export.histogram(index).select("cmix", "n_px", F.round("pct", 6).alias("pct"))


@query("p6_batch_shared_model", f"""WITH {_FSQL.replace('FROM pixel p JOIN bx', 'FROM scene p JOIN bx').replace(_NB, _NB.replace('FROM pixel p, dm, o', 'FROM scene p, dm, o').replace('JOIN pixel q ON', 'JOIN scene q ON q.raster_id=p.raster_id AND').replace('FROM pixel)', 'FROM scene)'))}
SELECT raster_id, case when r+g+b>=24 then ['BM_VEGETATION','BM_SAND','BM_SOIL'][cluster] end AS material, count(*) AS n_px FROM lab GROUP BY 1,2""", ["scene"])
def p6(spark, sf):
    px = view(spark, sf, "scene")
    opts = mm.Options(tile=TILE)
    model = given_model(mm.features(px, opts))
    return mm.material_shares(mm.classify_batch(px, opts, model))


@query("p6_batch_trained")
def p6t(spark, sf):
    return mm.material_shares(mm.classify_batch(view(spark, sf, "scene"), mm.Options(tile=64, smoothing="median_1")))


@query("p7_index_pair", """
WITH t AS (SELECT row+p AS row, col, p AS ord, case when (nir+p)%9=0 then 0 else [1,2,3,4,5,0][blk+1] end AS cmix FROM pixel, (VALUES (0),(1),(2)) v(p)),
i AS (SELECT row, col, coalesce(arg_max(cmix, ord) FILTER (WHERE cmix<>0), 0) AS cmix FROM t GROUP BY 1,2)
SELECT cmix, count(*) AS n_px, round(count(*)*100e0/sum(count(*)) OVER (), 6) AS pct FROM i GROUP BY 1""", ["pixel"])
def p7(spark, sf):
    base = block_colours(spark, sf).join(view(spark, sf, "pixel").select(*KEYS, "nir", "blk"), KEYS)
    moved = base.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    blank = ((F.col("nir") + F.col("ord")) % 9 == 0) | (F.col("blk") == 5)
    px = moved.select("raster_id", (F.col("row") + F.col("ord")).alias("row"), "col", "ord",
                      *[F.when(blank, 0).otherwise(F.col(c)).alias(c) for c in "rgb"])
    _, hist = mm.export_index(px, F.col("ord"), strict=True)
    return hist.select("cmix", "n_px", F.round("pct", 6).alias("pct"))


@query("p8_extract_masks")
def p8(spark, sf):
    px = enlarged(spark, sf)
    out = None
    for feature in FEATURE_CONFIGS:
        got = detect.extract_masks(px, dims_of(px), feature, scene_px=100_000, tile=128).groupBy("suffix").agg(F.count("*").alias("n_px"))
        out = got if out is None else out.unionByName(got)
    return out


@query("p9_calibration", """
WITH g AS (SELECT c_nationkey AS profile, case c_custkey%3 when 0 then 'BM_VEGETATION' when 1 then 'BM_SAND' else 'BM_SOIL' end AS material, c_custkey%90 AS x, c_custkey%80 AS y FROM customer),
p AS (SELECT material, r, pixel.g AS gg, b FROM g JOIN pixel ON col>=x AND col<x+3 AND row>=y AND row<y+3),
a AS (SELECT material, cast(round_even(avg(r),0) as int) AS r, cast(round_even(avg(gg),0) as int) AS g, cast(round_even(avg(b),0) as int) AS b FROM p GROUP BY 1),
f(material, anchor) AS (VALUES ('BM_ASPHALT','44,44,56'),('BM_CONCRETE','180,180,180'),('BM_VEGETATION','0,100,0'),('BM_WATER','28,107,160'),('BM_SAND','230,200,130'),('BM_SOIL','85,55,30'))
SELECT f.material, case when a.r IS NULL then f.anchor else concat(a.r, ',', a.g, ',', a.b) end AS anchor FROM f LEFT JOIN a USING (material)""", ["pixel"])
def p9(spark, sf):
    """Region samples become the user's anchors and win over the factory's."""
    from ..operators.calibrate import region_statistics
    from ..sources import profiles
    name = F.element_at(F.array(F.lit("BM_VEGETATION"), F.lit("BM_SAND"), F.lit("BM_SOIL")), (F.col("c_custkey") % 3 + 1).cast("int"))
    regions = table(spark, sf, "customer").select(
        name.alias("material"), (F.col("c_custkey") % 90).cast("int").alias("x"), (F.col("c_custkey") % 80).cast("int").alias("y"),
        F.lit(3).alias("w"), F.lit(3).alias("h"))
    stats = region_statistics(view(spark, sf, "pixel"), regions)
    user = stats.select("material", F.array(F.array("mean_r", "mean_g", "mean_b")).alias("anchors"))
    defaults = profiles.class_dim(spark).select(F.col("name").alias("material"), "anchors")
    out = profiles.resolve_anchors(user, defaults)
    return out.select("material", F.array_join(F.element_at("anchors", 1).cast("array<string>"), ",").alias("anchor"))


def lloyd_by_sql(rounds):
    """Three centres per raster from quantiles of the gray level, moved to their means."""
    ctes = ["px AS (SELECT raster_id, row, col, r, g, b, (cast(r as double)+cast(g as double)+cast(b as double))/3 AS v FROM scene WHERE r+g+b>=24)",
            "sc AS (SELECT raster_id, coalesce(nullif(stddev_pop(r),0e0),1e0) AS sr, coalesce(nullif(stddev_pop(g),0e0),1e0) AS sg, coalesce(nullif(stddev_pop(b),0e0),1e0) AS sb FROM px GROUP BY 1)",
            "k0 AS (" + " UNION ALL ".join(f"SELECT raster_id, {i + 1} AS i, quantile_cont(v, {(2 * i + 1) / 6!r}) AS cr, quantile_cont(v, {(2 * i + 1) / 6!r}) AS cg, quantile_cont(v, {(2 * i + 1) / 6!r}) AS cb FROM px GROUP BY 1"
                                           for i in range(3)) + ")"]
    for n in range(rounds):
        ctes.append(f"a{n} AS (SELECT p.raster_id, p.r, p.g, p.b, arg_min(k.i, power((p.r-k.cr)/sr,2)+power((p.g-k.cg)/sg,2)+power((p.b-k.cb)/sb,2)) AS i "
                    f"FROM px p JOIN k{n} k USING (raster_id) JOIN sc USING (raster_id) GROUP BY p.raster_id, p.row, p.col, p.r, p.g, p.b)")
        ctes.append(f"k{n + 1} AS (SELECT k.raster_id, k.i, coalesce(avg(a.r), any_value(k.cr)) AS cr, coalesce(avg(a.g), any_value(k.cg)) AS cg, coalesce(avg(a.b), any_value(k.cb)) AS cb "
                    f"FROM k{n} k LEFT JOIN a{n} a ON a.i=k.i AND a.raster_id=k.raster_id GROUP BY k.raster_id, k.i)")
    return f"WITH {', '.join(ctes)} SELECT raster_id, i AS cluster, round(cr,4) AS r, round(cg,4) AS g, round(cb,4) AS b FROM k{rounds}"


def raster_models(spark, sf, rounds):
    px = view(spark, sf, "scene").filter("r + g + b >= 24")
    feats = ["r", "g", "b"]
    return px, feats, cluster.lloyd_by(px, feats, cluster.start_models(px, feats, 3, ["raster_id"]), ["raster_id"], rounds)


@query("l5_kmeans_per_raster", lloyd_by_sql(3), ["scene"])
def l5r(spark, sf):
    """Every raster's own centres after three rounds from a fixed start."""
    _, _, models = raster_models(spark, sf, 3)
    each = models.select("raster_id", F.posexplode("centres").alias("i", "c"))
    return each.select("raster_id", (F.col("i") + 1).alias("cluster"), *[
        F.round(F.get("c", F.lit(k)), 4).alias(n) for k, n in enumerate("rgb")])


@query("p10_independent_rasters")
def p10(spark, sf):
    """Every raster trains its own model on all its covered pixels."""
    px, feats, models = raster_models(spark, sf, 10)
    labels = cluster.nearest_centre_by(px, feats, models, ["raster_id"])
    mapping = assign.assign_materials(assign.naming_cost(assign.cluster_mean_rgb(labels, 3, ["raster_id"]), ANCHORS), ["raster_id"])
    held = attach_by(labels, mapping.select("raster_id", "cluster", "material"), ["raster_id", "cluster"])
    return held.groupBy("raster_id", "material").agg(F.count("*").alias("n_px"))


@query("g14_per_raster_centres", f"""WITH m AS (SELECT raster_id, avg(r) AS mr FROM scene GROUP BY 1)
SELECT raster_id, row, col, {argmin_sql(dist_sql([CENTRES6[0], CENTRES6[1]], 'rgb'))[0]} AS cluster FROM scene JOIN m USING (raster_id)""", ["scene"])
def g14r(spark, sf):
    px = view(spark, sf, "scene").select(*KEYS, "r", "g", "b")
    centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in CENTRES6[:2]])
    models = px.select("raster_id").distinct().withColumn("centres", centres).withColumn(
        "scale", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    return cluster.nearest_centre_by(px, ["r", "g", "b"], models, ["raster_id"]).select(*KEYS, "cluster")


@query("l6_shared_training_sample", """
WITH n AS (SELECT count(DISTINCT raster_id) AS k FROM scene), b AS (SELECT greatest(40, cast(floor(2000/k) as int)) AS q FROM n)
SELECT raster_id, least(count(*), max(q)) AS n_sampled FROM scene, b GROUP BY 1""", ["scene"])
def l6(spark, sf):
    """The same number of pixels from every raster, for one shared model."""
    px = view(spark, sf, "scene")
    budget = max(40, 2000 // px.select("raster_id").distinct().count())
    got = cluster.uniform_sample(px, budget, by=["raster_id"])
    return got.groupBy("raster_id").agg(F.count("*").alias("n_sampled"))


@query("l7_shared_colour_table")
def l7(spark, sf):
    """One trained model named from its centres, for all rasters."""
    opts = mm.Options(tile=64)
    px = view(spark, sf, "scene")
    model = mm.name_centres(mm.train(px, mm.features(px, opts), opts), opts, spark)
    rows = [(i, m, c["color"]) for i, m in enumerate(model.materials, 1) for c in CLASSES if c["name"] == m]
    return spark.createDataFrame(rows, "cluster int, material string, color string")


@query("u4_progress_counts", "SELECT raster_id, count(*) AS n_px FROM scene GROUP BY 1", ["scene"])
def u4(spark, sf):
    """Progress as an observed metric of the running job: no extra pass."""
    from pyspark.sql import Observation
    seen = Observation("progress")
    px = view(spark, sf, "scene").observe(seen, F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("r") + F.col("g") + F.col("b") < 24).alias("blank"))
    return px.groupBy("raster_id").agg(F.count("*").alias("n_px"))



