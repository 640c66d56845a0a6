"""Queries on sampling, clustering, naming, scores and statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..constants import CLASS_RGB, CLASSES
from ..functions import color
from ..operators import assign, calibrate, chains, cluster, export, semantics, tile_kmeans, tiles
from ..session import cut_lineage
from ..sources import profiles
from .q_grid import TILE, _GRAD
from .q_pixels import FLAG_CTE, KEYS, rounded, scaled_cte
from .q_sources import _USER, dims_of, user_materials
from .registry import query
from .views import table, view

_K = "raster_id, row, col"
SIDE = 64
NATURAL = [c for c in CLASSES if c["source"] == "kmeans"]
ANCHORS = {c["name"]: c["anchors"] for c in NATURAL}
CENTRES6 = [(40.0, 130.0, 45.0), (232.0, 200.0, 176.0), (105.0, 70.0, 36.0), (178.0, 178.0, 180.0),
            (28.0, 107.0, 160.0), (2.0, 2.0, 2.0)]


def dist_sql(centres, cols, expr="({c}-({v!r}e0))*({c}-({v!r}e0))"):
    return ["+".join(expr.format(c=c, v=v) for c, v in zip(cols, ctr)) for ctr in centres]


def argmin_sql(dists):
    best = f"least({', '.join(dists)})"
    cases = " ".join(f"when {d} = {best} then {i}" for i, d in enumerate(dists, 1))
    return f"case {cases} end", best


_LAB, _BEST = argmin_sql(dist_sql(CENTRES6, "rgb"))


# --- nearest centres and k-means ---------------------------------------------

@query("g14_nearest_centre", f"SELECT {_K}, {_LAB} AS cluster, round({_BEST},4) AS distance FROM pixel", ["pixel"])
def g14(spark, sf):
    out = cluster.nearest_centre(view(spark, sf, "pixel"), ["r", "g", "b"], CENTRES6, distance="distance")
    return out.select(*KEYS, "cluster", F.round("distance", 4).alias("distance"))


_VEC = """c AS (SELECT row_number() OVER (ORDER BY label) AS i, embedding::DOUBLE[] AS c FROM (
 SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) z),
d AS (SELECT vec_id, i, power(list_distance(embedding::DOUBLE[], c),2) AS d FROM embeddings, c),
a AS (SELECT vec_id, cast(arg_min(i, d) as int) AS cluster, min(d) AS distance FROM d GROUP BY vec_id)"""


def vector_centres(spark, sf):
    import numpy as np
    e = table(spark, sf, "embeddings")
    rows = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").limit(
        cluster.MAX_CENTRES + 1).collect()  # one row per label; the assignment refuses more
    return e, np.array([r["c"] for r in rows], dtype=float)


@query("g14_nearest_vector", f"WITH {_VEC} SELECT vec_id, cluster, round(distance,4) AS distance FROM a")
def g14v(spark, sf):
    e, centres = vector_centres(spark, sf)
    out = cluster.nearest_centre_vectors(e.select("vec_id", "embedding"), "embedding", centres)
    return out.select("vec_id", "cluster", F.round("distance", 4).alias("distance"))


@query("h16_inertia", f"WITH {_VEC} SELECT round(sum(distance),2) AS inertia FROM a")
def h16(spark, sf):
    e, centres = vector_centres(spark, sf)
    out = cluster.nearest_centre_vectors(e.select("embedding"), "embedding", centres)
    return out.agg(F.round(F.sum("distance"), 2).alias("inertia"))


def lloyd_sql(rounds):
    start = " UNION ALL ".join(f"SELECT {i} AS i, {a!r}e0 AS cr, {b!r}e0 AS cg, {c!r}e0 AS cb" for i, (a, b, c) in enumerate(START, 1))
    ctes = [f"k0 AS ({start})"]
    for n in range(rounds):
        ctes.append(f"a{n} AS (SELECT p.r, p.g, p.b, arg_min(k.i, power(p.r-k.cr,2)+power(p.g-k.cg,2)+power(p.b-k.cb,2)) AS i "
                    f"FROM pixel p, k{n} k GROUP BY p.raster_id, p.row, p.col, p.r, p.g, p.b)")
        ctes.append(f"k{n + 1} AS (SELECT k.i, coalesce(avg(a.r), any_value(k.cr)) AS cr, coalesce(avg(a.g), any_value(k.cg)) AS cg, "
                    f"coalesce(avg(a.b), any_value(k.cb)) AS cb FROM k{n} k LEFT JOIN a{n} a ON a.i=k.i GROUP BY k.i)")
    return f"WITH {', '.join(ctes)} SELECT i AS cluster, round(cr,5) AS r, round(cg,5) AS g, round(cb,5) AS b FROM k{rounds}"


START = [(10.0, 20.0, 30.0), (60.0, 140.0, 60.0), (120.0, 90.0, 40.0), (200.0, 190.0, 170.0), (30.5, 100.0, 200.0), (255.0, 0.0, 255.0)]


@query("l5_kmeans_fixed_start", lloyd_sql(4), ["pixel"])
def l5(spark, sf):
    got = cluster.lloyd(view(spark, sf, "pixel"), ["r", "g", "b"], START, 4)
    rows = [(i, *map(float, c)) for i, c in enumerate(got, 1)]
    return spark.createDataFrame(rows, "cluster int, r double, g double, b double").select(
        "cluster", *rounded(*[(c, F.col(c)) for c in "rgb"], digits=5))


@query("l5_tiles_fixed_start", lloyd_sql(4).replace("FROM pixel p,", "FROM (SELECT * FROM pixel WHERE r+g+b>=24) p,"), ["pixel"])
def l5t(spark, sf):
    """The same rounds as sums inside stored tiles, over the covered pixels."""
    packed = tiles.pixels_to_tiles(view(spark, sf, "pixel"), ["r", "g", "b"], TILE, dims_of(view(spark, sf, "pixel")))
    form = tile_kmeans.Features(("r", "g", "b"), lambda canvas: canvas.astype(float))
    plain = tile_kmeans.Moments(0, np.zeros(3), np.ones(3), np.eye(3))
    got, _ = tile_kmeans.lloyd(tile_kmeans.kept_tiles(packed, form, TILE), form, plain, np.array(START)[None], 4, -1.0)
    rows = [(i, *map(float, c)) for i, c in enumerate(got, 1)]
    return spark.createDataFrame(rows, "cluster int, r double, g double, b double").select(
        "cluster", *rounded(*[(c, F.col(c)) for c in "rgb"], digits=5))


@query("l5_kmeans_ml")
def l5m(spark, sf):
    """Seeded k-means on every covered pixel."""
    px = view(spark, sf, "pixel").filter("r + g + b >= 24")
    feats = ["r", "g", "b"]
    scaler, centres = cluster.fit_kmeans(px, feats, 5)
    z = cluster.standardise(px, scaler)
    return cluster.nearest_centre(z, feats, centres).groupBy("cluster").agg(F.count("*").alias("n_px"))


@query("l4_fit_scaler", """SELECT 'r' AS feature, round(avg(r),6) AS mean, round(stddev_pop(r),6) AS scale FROM pixel
UNION ALL SELECT 'nir', round(avg(nir),6), round(stddev_pop(nir),6) FROM pixel""", ["pixel"])
def l4(spark, sf):
    s = cluster.fit_scaler(view(spark, sf, "pixel"), ["r", "nir"])
    return spark.createDataFrame([(k, round(m, 6), round(v, 6)) for k, (m, v) in s.items()], "feature string, mean double, scale double")


@query("l8_score_given_model", f"""
WITH s AS (SELECT avg(r) AS mr, stddev_pop(r) AS sr, avg(g) AS mg, stddev_pop(g) AS sg, avg(b) AS mb, stddev_pop(b) AS sb FROM pixel),
z AS (SELECT {_K}, (r-mr)/sr AS r, (g-mg)/sg AS g, (b-mb)/sb AS b FROM pixel, s)
SELECT {_K}, {argmin_sql(dist_sql([(-1.0, 0.5, -0.5), (1.0, 1.0, 1.0), (0.0, -1.0, 0.5)], "rgb"))[0]} AS cluster FROM z""", ["pixel"])
def l8(spark, sf):
    px = view(spark, sf, "pixel")
    z = cluster.standardise(px, cluster.fit_scaler(px, ["r", "g", "b"]))
    return cluster.nearest_centre(z, ["r", "g", "b"], [(-1.0, 0.5, -0.5), (1.0, 1.0, 1.0), (0.0, -1.0, 0.5)]).select(*KEYS, "cluster")


# --- sampling ----------------------------------------------------------------

_HASH = "cast(concat('0x', substr(md5(concat_ws('|', raster_id, row, col, 42)), 1, 12)) as bigint)"


@query("l2_uniform_sample", f"""SELECT {_K} FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, row, col) AS k FROM pixel) z WHERE k <= 2500""", ["pixel"])
def l2(spark, sf):
    return cluster.uniform_sample(view(spark, sf, "pixel"), 2500).select(*KEYS)


@query("l3_sample_per_raster", f"""SELECT {_K} FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY {_HASH}, row, col) AS k FROM scene) z WHERE k <= 300""", ["scene"])
def l3(spark, sf):
    return cluster.uniform_sample(view(spark, sf, "scene"), 300, by=["raster_id"]).select(*KEYS)


@query("l1_window_sample", f"""
WITH d AS (SELECT raster_id, max(row)+1 AS h, max(col)+1 AS w, least(16, max(row)+1, max(col)+1) AS n FROM pixel GROUP BY 1),
g AS (SELECT raster_id, n, cast(floor(case when i=3 then h-n else i*((h-n)/3e0) end) as bigint) AS wr, cast(floor(case when j=3 then w-n else j*((w-n)/3e0) end) as bigint) AS wc
 FROM d, generate_series(0,3) a(i), generate_series(0,3) c(j)),
x AS (SELECT raster_id, n, cast(concat('0x', substr(md5(concat_ws('|', raster_id, k, 'row', 42)), 1, 12)) as bigint) % greatest(1, h-n) AS wr, cast(concat('0x', substr(md5(concat_ws('|', raster_id, k, 'col', 42)), 1, 12)) as bigint) % greatest(1, w-n) AS wc FROM d, generate_series(1,5) e(k)),
win AS (SELECT * FROM g UNION SELECT * FROM x),
s AS (SELECT p.raster_id, row, col, wr, wc, row_number() OVER (PARTITION BY wr, wc ORDER BY cast(concat('0x', substr(md5(concat_ws('|', p.raster_id, row, col, 42)), 1, 12)) as bigint), row, col) AS k FROM pixel p, win
 WHERE row>=wr AND row<wr+n AND col>=wc AND col<wc+n AND r+g+b>=24)
SELECT raster_id, row, col, wr, wc FROM s WHERE k <= 47""", ["pixel"])
def l1(spark, sf):
    px = view(spark, sf, "pixel").select(*KEYS, "r", "g", "b")
    windows = cluster.sample_windows(dims_of(px), grid=4, window=16, extra=5)
    return cluster.window_sample(px, windows, cluster.per_window(1000, 4, 5), 16).select(*KEYS, "wr", "wc")


_GRID = """c AS (SELECT path, (west+east)/2 AS cx, (south+north)/2 AS cy FROM footprint),
b AS (SELECT count(*) AS n, least(greatest(8, cast(ceil(sqrt(count(*))) as bigint)), count(*)) AS budget, min(cx) AS x0, min(cy) AS y0, max(cx)-min(cx) AS rx0, max(cy)-min(cy) AS ry0 FROM c),
b1 AS (SELECT *, case when rx0=0 then 1e0 else rx0 end AS rx, case when ry0=0 then 1e0 else ry0 end AS ry FROM b),
k AS (SELECT *, greatest(1, cast(round_even(sqrt(budget/(rx/ry)),0) as int)) AS ny FROM b1),
m AS (SELECT *, greatest(1, cast(round_even(cast(budget as double)/ny,0) as int)) AS nx FROM k),
h AS (SELECT c.*, m.*, least(floor((cx-x0)/(rx/nx)), nx-1) AS ix, least(floor((cy-y0)/(ry/ny)), ny-1) AS iy FROM c, m),
r AS (SELECT path, row_number() OVER (PARTITION BY ix, iy ORDER BY power(cx-(x0+(ix+0.5)*(rx/nx)),2)+power(cy-(y0+(iy+0.5)*(ry/ny)),2), path) AS k FROM h)"""


@query("j2_representatives", f"WITH {_GRID} SELECT path FROM r WHERE k=1", ["footprint"])
def j2(spark, sf):
    """The grid part of the choice; the seeded fill is checked in the tests."""
    return cluster.grid_representatives(view(spark, sf, "footprint"))


@query("k4_skipped_rasters", f"""WITH {_GRID}
SELECT n AS n_all, case when n<=budget then n else greatest(budget, (SELECT count(*) FROM r WHERE k=1)) end AS n_selected FROM b""", ["footprint"])
def k4(spark, sf):
    every = view(spark, sf, "footprint").select("path")
    chosen = cluster.representative_rasters(view(spark, sf, "footprint")).filter("selected").select("path")
    skipped = every.join(chosen, "path", "left_anti")
    both = chosen.withColumn("s", F.lit(1)).unionByName(skipped.withColumn("s", F.lit(0)))
    return both.agg(F.count("*").alias("n_all"), F.sum("s").alias("n_selected"))


@query("h17_train_size")
def h17(spark, sf):
    from .q_features import enlarged
    px = enlarged(spark, sf).withColumns({"vari": color.vari("r", "g", "b"), "sat": color.saturation("r", "g", "b")})
    return cluster.complexity_sample_size(px, ["r", "g", "b", "vari", "sat"], 3)


_H17 = """
WITH c AS (SELECT count(*)*9 AS n, corr(r,b) AS c FROM pixel), e AS (SELECT n, greatest((1+c)/2,1e-12) AS e1, greatest((1-c)/2,1e-12) AS e2 FROM c),
h AS (SELECT n, -(e1*ln(e1)+e2*ln(e2))/ln(2e0) AS ne FROM e)
SELECT n AS n_pixels, case when n<=20000 then 0e0 else round(ne,6) end AS norm_entropy,
 case when n<=20000 then least(n,100000) else least(n, cast(floor(greatest(20000, least(120000, 20000+(0.6e0*(1-ne)+0.4e0*0.2e0)*100000))) as bigint)) end AS train_pixels FROM h"""


@query("h17_two_features", _H17, ["pixel"])
def h17b(spark, sf):
    from .q_features import enlarged
    return cluster.complexity_sample_size(enlarged(spark, sf), ["r", "b"], 3)


@query("h17_tiles", _H17, ["pixel"])
def h17t(spark, sf):
    """The same size from moments that are formed inside stored tiles."""
    from .q_features import enlarged
    px = enlarged(spark, sf)
    form = tile_kmeans.Features(("r", "b"), lambda canvas: canvas.astype(float), covered_only=False)
    at = tile_kmeans.moments(tile_kmeans.kept_tiles(tiles.pixels_to_tiles(px, ["r", "b"], TILE, dims_of(px)), form, TILE), form)
    norm, size = cluster.size_from_correlation(at.n, at.correlation, 3)
    return spark.createDataFrame([(at.n, round(norm, 6), size)], "n_pixels long, norm_entropy double, train_pixels long")


# --- cluster summaries and naming --------------------------------------------

def by_block(spark, sf, name="scene"):
    """Labels one to six from the blocks."""
    return view(spark, sf, name).withColumn("cluster", F.col("blk") + 1)


@query("h1_cluster_counts", """
WITH k AS (SELECT i AS cluster FROM generate_series(1,8) a(i)), r AS (SELECT DISTINCT raster_id FROM scene),
c AS (SELECT raster_id, blk+1 AS cluster, count(*) AS n FROM scene GROUP BY 1,2)
SELECT r.raster_id, cast(k.cluster as int) AS cluster, coalesce(c.n,0) AS n FROM r CROSS JOIN k LEFT JOIN c ON c.raster_id=r.raster_id AND c.cluster=k.cluster""", ["scene"])
def h1(spark, sf):
    return assign.cluster_counts(by_block(spark, sf), 8, ["raster_id"])


_MEANS = """m AS (SELECT raster_id, blk+1 AS cluster, cast(floor(avg(r)) as int) AS r, cast(floor(avg(g)) as int) AS g, cast(floor(avg(b)) as int) AS b FROM scene GROUP BY 1,2)"""


@query("h2_cluster_mean_rgb", f"""
WITH k AS (SELECT i AS cluster FROM generate_series(1,8) a(i)), r AS (SELECT DISTINCT raster_id FROM scene), {_MEANS}
SELECT r.raster_id, cast(k.cluster as int) AS cluster, coalesce(m.r,128) AS r, coalesce(m.g,128) AS g, coalesce(m.b,128) AS b FROM r CROSS JOIN k LEFT JOIN m ON m.raster_id=r.raster_id AND m.cluster=k.cluster""", ["scene"])
def h2(spark, sf):
    return assign.cluster_mean_rgb(by_block(spark, sf), 8, ["raster_id"])


@query("h3_centres_to_rgb", """
WITH s AS (SELECT avg(r) AS mr, stddev_pop(r) AS sr, avg(g) AS mg, stddev_pop(g) AS sg, avg(b) AS mb, stddev_pop(b) AS sb FROM pixel),
c AS (SELECT cast(blk+1 as int) AS cluster, avg((r-mr)/sr)*1.7e0 AS r, avg((g-mg)/sg)*1.7e0 AS g, avg((b-mb)/sb)*1.7e0 AS b FROM pixel, s GROUP BY 1)
SELECT cluster, cast(greatest(0, least(255, round_even(r*sr+mr,0))) as int) AS r, cast(greatest(0, least(255, round_even(g*sg+mg,0))) as int) AS g,
 cast(greatest(0, least(255, round_even(b*sb+mb,0))) as int) AS b FROM c, s""", ["pixel"])
def h3(spark, sf):
    px = by_block(spark, sf, "pixel")
    scaler = cluster.fit_scaler(px, ["r", "g", "b"])
    centres = cluster.standardise(px, scaler).groupBy("cluster").agg(*[(F.avg(c) * 1.7).alias(c) for c in "rgb"])
    return assign.centres_to_rgb(centres, scaler, ["r", "g", "b"])


@query("h5_weighted_scores", """
WITH p AS (SELECT raster_id, blk+1 AS cluster, count(*) AS n, avg(case when r<g*1.05e0 then 1e0 else 0e0 end) AS greenish, avg(nir) AS nir FROM scene GROUP BY 1,2)
SELECT cluster, cast(sum(n) as bigint) AS n, round(sum(greenish*n)/sum(n),6) AS greenish, round(sum(nir*n)/sum(n),6) AS nir FROM p GROUP BY 1""", ["scene"])
def h5(spark, sf):
    per = by_block(spark, sf).groupBy("raster_id", "cluster").agg(
        F.count("*").alias("n"), F.avg((F.col("r") < F.col("g") * 1.05).cast("double")).alias("greenish"), F.avg("nir").alias("nir"))
    return assign.weighted_cluster_mean(per, ["greenish", "nir"]).select(
        "cluster", "n", *rounded(("greenish", F.col("greenish")), ("nir", F.col("nir"))))


_PC = "case when length(regexp_replace(color,'^#+',''))=6 then cast(concat('0x', substr(regexp_replace(color,'^#+',''),{0},2)) as integer) else m.{1} end"


@query("h6_class_colours", f"""
WITH m AS (SELECT cast(floor(row) as int)+1 AS cluster, cast(floor(avg(r)) as int) AS r, cast(floor(avg(g)) as int) AS g, cast(floor(avg(b)) as int) AS b FROM pixel GROUP BY 1)
SELECT m.cluster, {_PC.format(1, 'r')} AS r, {_PC.format(3, 'g')} AS g, {_PC.format(5, 'b')} AS b FROM m LEFT JOIN part_class c ON c.pos=m.cluster""", ["pixel", "part_class"])
def h6(spark, sf):
    px = view(spark, sf, "pixel").withColumn("cluster", F.col("row") + 1)
    means = px.groupBy("cluster").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    classes = view(spark, sf, "part_class").select(F.col("pos").alias("cluster"), "color")
    return assign.class_colours(means, classes)


def cost_sql(anchors, r="r", g="g", b="b"):
    return "least(" + ", ".join(f"power({r}-{x},2)+power({g}-{y},2)+power({b}-{z},2)" for x, y, z in anchors) + (
        ")" if len(anchors) > 1 else ", 1e18)")


_ALL_COST = " UNION ALL ".join(
    f"SELECT raster_id, cluster, {i} AS pos, '{c['name']}' AS material, {cost_sql(c['anchors'])} AS cost FROM m" for i, c in enumerate(CLASSES))


@query("g15_anchor_cost", f"WITH {_MEANS} {_ALL_COST}", ["scene"])
def g15(spark, sf):
    means = by_block(spark, sf).groupBy("raster_id", "cluster").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    out = assign.anchor_cost(means, {c["name"]: c["anchors"] for c in CLASSES})
    return out.select("raster_id", "cluster", "pos", "material", "cost")


_M3 = """m AS (SELECT raster_id, blk%3+1 AS cluster, cast(floor(avg(r)) as int) AS r, cast(floor(avg(g)) as int) AS g, cast(floor(avg(b)) as int) AS b FROM scene GROUP BY 1,2),
c AS (SELECT raster_id, cluster, """ + ", ".join(
    f"{cost_sql(a)} + {pen} AS c{j}" for j, (a, pen) in enumerate([
        (ANCHORS["BM_VEGETATION"], "case when g<=r then 30000e0 else 0e0 end"),
        (ANCHORS["BM_SAND"], "case when r+g+b<=420 then 30000e0 else 0e0 end"),
        (ANCHORS["BM_SOIL"], "case when g>r then 30000e0 else 0e0 end")])) + " FROM m)"


def _pick(alias, var):
    return f"case {var} when 0 then {alias}.c0 when 1 then {alias}.c1 else {alias}.c2 end"


@query("m1_assign_materials", f"""
WITH {_M3}, pm(x,y,z) AS (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)),
t AS (SELECT a.raster_id, x, y, z, {_pick('a','x')} AS ca, {_pick('b','y')} AS cb, {_pick('d','z')} AS cc FROM c a JOIN c b ON b.raster_id=a.raster_id AND b.cluster=2
 JOIN c d ON d.raster_id=a.raster_id AND d.cluster=3, pm WHERE a.cluster=1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY ca+cb+cc) AS k FROM t) q WHERE k=1)
SELECT raster_id, cl AS cluster, ['BM_VEGETATION','BM_SAND','BM_SOIL'][case cl when 1 then x when 2 then y else z end + 1] AS material,
 case cl when 1 then ca when 2 then cb else cc end AS cost FROM w, (VALUES (1),(2),(3)) v(cl)""", ["scene"])
def m1(spark, sf):
    px = view(spark, sf, "scene").withColumn("cluster", F.col("blk") % 3 + 1)
    means = assign.cluster_mean_rgb(px, 3, ["raster_id"])
    return assign.assign_materials(assign.naming_cost(means, ANCHORS), ["raster_id"])


_M6 = _M3.replace("blk%3+1", "blk+1")


@query("m1_more_clusters", f"""
WITH {_M6}, t AS (SELECT p0.raster_id, p0.cluster AS k0, p1.cluster AS k1, p2.cluster AS k2, row_number() OVER (PARTITION BY p0.raster_id ORDER BY p0.c0+p1.c1+p2.c2) AS n
 FROM c p0 JOIN c p1 ON p1.raster_id=p0.raster_id AND p1.cluster<>p0.cluster JOIN c p2 ON p2.raster_id=p0.raster_id AND p2.cluster NOT IN (p0.cluster, p1.cluster)),
j AS (SELECT c.*, case when cluster=k0 then 0 when cluster=k1 then 1 when cluster=k2 then 2 when c0<=c1 AND c0<=c2 then 0 when c1<=c2 then 1 else 2 end AS m FROM c JOIN t ON t.raster_id=c.raster_id AND t.n=1)
SELECT raster_id, cluster, ['BM_VEGETATION','BM_SAND','BM_SOIL'][m+1] AS material, [c0,c1,c2][m+1] AS cost, ['#228B22','#EDC9AF','#654321'][m+1] AS color,
 [34,237,101][m+1] AS paint_r, [139,201,67][m+1] AS paint_g, [34,175,33][m+1] AS paint_b FROM j""", ["scene"])
def m1x(spark, sf):
    """Six clusters for three materials: three are assigned, three take the cheapest."""
    means = assign.cluster_mean_rgb(by_block(spark, sf), 6, ["raster_id"])
    return assign.with_material_colour(assign.assign_materials(assign.naming_cost(means, ANCHORS), ["raster_id"]))


_COL6 = ",".join(f"({i},{r},{g},{b})" for i, (r, g, b) in enumerate(CLASS_RGB.values(), 1))


def greedy_sql(k=8):
    """The greedy choice unrolled cluster by cluster; used colours are a bit set."""
    steps = ["s0 AS (SELECT DISTINCT raster_id, 0 AS used FROM scene)"]
    for n in range(1, k + 1):
        steps.append(f"""s{n} AS (SELECT raster_id, p AS pick, used | (1 << p) AS used FROM (
 SELECT s.raster_id, s.used, arg_min(col.j, power(q.r-col.r,2)+power(q.g-col.g,2)+power(q.b-col.b,2) + case when (s.used >> col.j) & 1 = 1 AND s.used <> 126 then 1e9 else 0e0 end + col.j*1e-6) AS p
 FROM s{n - 1} s JOIN mm q ON q.raster_id=s.raster_id AND q.cluster={n}, col GROUP BY 1,2) z)""")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT raster_id, {n} AS cluster, pick AS colour FROM s{n}" for n in range(1, k + 1))


@query("m2_greedy_colours", f"""
WITH {_MEANS}, mm AS (SELECT r.raster_id, cast(k.cluster as int) AS cluster, coalesce(m.r,128) AS r, coalesce(m.g,128) AS g, coalesce(m.b,128) AS b
 FROM (SELECT DISTINCT raster_id FROM scene) r CROSS JOIN (SELECT i AS cluster FROM generate_series(1,8) a(i)) k LEFT JOIN m ON m.raster_id=r.raster_id AND m.cluster=k.cluster),
col(j, r, g, b) AS (VALUES {_COL6}), {greedy_sql()}""", ["scene"])
def m2(spark, sf):
    means = assign.cluster_mean_rgb(by_block(spark, sf), 8, ["raster_id"])
    return assign.greedy_colours(means, [c for c in CLASS_RGB.values()], ["raster_id"])


_DEF = ", ".join(f"('{c['name']}','{';'.join(','.join(map(str, a)) for a in c['anchors'])}')" for c in CLASSES)


@query("m3_active_anchors", f"""WITH {_USER},
o AS (SELECT profile, material, concat(a1, coalesce(';'||a2,'')) AS a FROM u WHERE good),
p AS (SELECT DISTINCT profile FROM u), b AS (SELECT profile, material, a FROM p, (VALUES {_DEF}) v(material, a))
SELECT coalesce(o.profile,b.profile) AS profile, coalesce(o.material,b.material) AS material, coalesce(o.a,b.a) AS anchors
FROM b FULL OUTER JOIN o ON o.profile=b.profile AND o.material=b.material""")
def m3(spark, sf):
    user = user_materials(spark, sf).select("profile", "material", "anchors")
    defaults = profiles.class_dim(spark).select(F.col("name").alias("material"), "anchors")
    out = profiles.resolve_anchors(user, defaults, ["profile"])
    text = F.array_join(F.transform("anchors", lambda a: F.array_join(a.cast("array<string>"), ",")), ";")
    return out.select("profile", "material", text.alias("anchors"))


@query("k5_anchor_union", """
SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size, cast(p_partkey%7 as int), cast(p_partkey%5 as int), p_size])), ',') AS merged FROM part""")
def k5(spark, sf):
    a, b = F.array("p_size", (F.col("p_partkey") % 7).cast("int")), F.array((F.col("p_partkey") % 5).cast("int"), F.col("p_size"))
    merged = F.array_join(F.array_sort(F.array_union(a, b)).cast("array<string>"), ",")
    return table(spark, sf, "part").select("p_partkey", merged.alias("merged"))


# --- scene prior -------------------------------------------------------------

def prior_sql(zone_rows, names):
    u = {"BM_VEGETATION": (0.21, 0.39), "BM_SAND": (0.04, 0.08), "BM_SOIL": (0.15, 0.25)}
    mix = {n: f"((1-w)*{u[n][0]}e0+w*{u[n][1]}e0)" for n in names}
    total = "+".join(mix.values())
    rows = " UNION ALL ".join(f"SELECT raster_id, round(w,6) AS open_weight, '{n}' AS material, round({mix[n]}/({total}),6) AS prior FROM ow" for n in names)
    return f"""WITH {zone_rows},
sc AS (SELECT raster_id, zone, greatest(1e0, quantile_cont(v,0.98e0)) AS s FROM (SELECT raster_id, zone, r AS v FROM z UNION ALL SELECT raster_id, zone, g FROM z UNION ALL SELECT raster_id, zone, b FROM z) q GROUP BY 1,2),
n AS (SELECT z.raster_id, z.zone, least(1e0,r/s) AS r, least(1e0,g/s) AS g, least(1e0,b/s) AS b FROM z JOIN sc USING (raster_id, zone)),
x AS (SELECT *, (greatest(r,g,b)-least(r,g,b))/(greatest(r,g,b)+1e-6) AS sat, greatest(r,g,b) AS hi FROM n),
f AS (SELECT raster_id, zone, avg(case when 2e0*g-r-b>0.08e0 AND g>0.22e0 then 1e0 else 0e0 end) AS veg, avg(case when r>g AND g>b AND sat>0.07e0 AND hi>0.18e0 then 1e0 else 0e0 end) AS soil,
 avg(case when sat<0.12e0 AND hi>0.15e0 AND hi<0.85e0 then 1e0 else 0e0 end) AS gray FROM x GROUP BY 1,2),
ow AS (SELECT raster_id, avg(greatest(0e0, least(1e0, 0.5e0+1.1e0*(veg+0.65e0*soil-0.9e0*gray)))) AS w FROM f GROUP BY 1) {rows}"""


NAT = [c["name"] for c in NATURAL]


@query("h12_scene_prior", prior_sql("z AS (SELECT raster_id, 0 AS zone, r, g, b FROM scene)", NAT), ["scene"])
def h12(spark, sf):
    """Openness over the whole raster."""
    px = view(spark, sf, "scene")
    out = assign.scene_prior(assign.scene_fractions(px), NAT)
    return out.select("raster_id", F.round("open_weight", 6).alias("open_weight"), "material", F.round("prior", 6).alias("prior"))


_ZONES = """d AS (SELECT raster_id, max(row)+1 AS h, max(col)+1 AS w FROM pixel GROUP BY 1),
zz AS (SELECT raster_id, i*4+j AS zone, case when i=3 then h-21 else cast(floor(20+i*((h-41)/3e0)) as int) end AS cy, case when j=3 then w-21 else cast(floor(20+j*((w-41)/3e0)) as int) end AS cx
 FROM d, generate_series(0,3) a(i), generate_series(0,3) c(j) WHERE h>=41 AND w>=41),
z AS (SELECT p.raster_id, zone, r, g, b FROM pixel p JOIN zz ON row BETWEEN cy-20 AND cy+20 AND col BETWEEN cx-20 AND cx+20
 UNION ALL SELECT p.raster_id, 0, r, g, b FROM pixel p JOIN d USING (raster_id) WHERE h<41 OR w<41)"""


@query("h12_zone_prior", prior_sql(_ZONES, NAT), ["pixel"])
def h12z(spark, sf):
    """Large raster: sixteen zones of radius twenty."""
    px = view(spark, sf, "pixel")
    out = assign.scene_prior(assign.zone_fractions(px, dims_of(px), F.lit(9.0)), NAT)
    return out.select("raster_id", F.round("open_weight", 6).alias("open_weight"), "material", F.round("prior", 6).alias("prior"))


# --- semantic scores ---------------------------------------------------------

REACH = """e AS (SELECT p.cluster, (cast(p.row as bigint)<<31)+p.col AS a, (cast(q.row as bigint)<<31)+q.col AS b FROM lab p JOIN lab q
 ON q.cluster=p.cluster AND abs(p.row-q.row)+abs(p.col-q.col)<=1 AND q.row BETWEEN p.row-1 AND p.row+1),
reach(cluster, n, m) AS (SELECT cluster, (cast(row as bigint)<<31)+col, (cast(row as bigint)<<31)+col FROM lab
 UNION SELECT reach.cluster, reach.n, e.b FROM reach JOIN e ON e.a=reach.m AND e.cluster=reach.cluster),
cc AS (SELECT cluster, n, min(m) AS comp FROM reach GROUP BY 1,2),
st AS (SELECT cluster, comp, count(*) AS area, max(n>>31)-min(n>>31)+1 AS bh, max(n&2147483647)-min(n&2147483647)+1 AS bw FROM cc GROUP BY 1,2),
ct AS (SELECT cluster, case when sum(area)<80 then 0e0 else least(1e0, sum(case when area>=28 AND greatest(bh,bw)/least(bh,bw)>=3 AND area/cast(bh*bw as double)<=0.78e0 then area else 0 end)/cast(sum(area) as double)*1.4e0) end AS continuity,
 case when sum(area)<120 then 0e0 else least(1e0, 0.55e0*coalesce(max(case when area>=40 then area end),0)/sum(area)+0.45e0*sum(case when area>=40 AND area/cast(bh*bw as double)>=0.38e0 AND greatest(bh,bw)/cast(least(bh,bw) as double)<=3.5e0 then area else 0 end)/sum(area)) end AS water_continuity
 FROM st GROUP BY 1)"""


def block_tiles(spark, sf):
    """Tiles with the bands and, as cluster, one more than the block's number."""
    px = by_block(spark, sf, "pixel")
    return cut_lineage(tiles.pixels_to_tiles(px, ["r", "g", "b", "nir", "cluster"], SIDE, dims_of(px)))


@query("i2_i3_continuity", f"""WITH RECURSIVE lab AS (SELECT row, col, blk+1 AS cluster FROM pixel), {REACH}
SELECT 'r0' AS raster_id, cluster, round(continuity,6) AS continuity, round(water_continuity,6) AS water_continuity FROM ct""", ["pixel"])
def i23(spark, sf):
    out = semantics.continuity(by_block(spark, sf, "pixel"), 16)
    return out.select("raster_id", "cluster", *rounded(("continuity", F.col("continuity")), ("water_continuity", F.col("water_continuity"))))


_FR = {"veg_frac": "veg", "dry_frac": "dry_barren", "sand_frac": "sand", "dry_grass_frac": "dry_grass", "lush_frac": "lush_grass",
       "gray_frac": "gray", "dark_gray_frac": "dark_gray", "achro_frac": "achro_road", "warm_frac": "warm",
       "blue_dom_frac": "blue_dom", "water_frac": "water_nir", "edge_frac": "f_edge"}
_FRAC = "fr AS (SELECT blk+1 AS cluster, count(*) AS n, " + ", ".join(
    f"avg(case when {c} then 1e0 else 0e0 end) AS {n}" for n, c in _FR.items()) + (
    " FROM fl JOIN eg USING (raster_id,row,col) JOIN (SELECT raster_id,row,col,blk FROM pixel) bp USING (raster_id,row,col) GROUP BY 1)")
_U = "greatest(0e0, least(1e0, {}))".format


_SCORES = f"""s1 AS (SELECT fr.*, continuity, water_continuity, cast(n as double)/(SELECT count(*) FROM pixel) AS size_frac FROM fr JOIN ct USING (cluster)),
s2 AS (SELECT *, {_U('greatest(0.3e0*gray_frac+0.3e0*achro_frac+0.4e0*continuity, case when gray_frac>=0.55e0 then 0.65e0*gray_frac else 0e0 end, case when achro_frac>=0.4e0 then 0.8e0*achro_frac else 0e0 end)')} AS road,
 greatest(0e0, veg_frac-0.6e0*gray_frac-0.4e0*achro_frac) AS nv, {_U('0.65e0*edge_frac+0.35e0*continuity')} AS line, {_U('0.45e0*water_frac+0.55e0*water_continuity')} AS water FROM s1),
s3 AS (SELECT *, {_U('(0.25e0*gray_frac+0.25e0*dark_gray_frac+0.25e0*achro_frac+0.25e0*road)*(1-1.4e0*nv)*(1-0.6e0*sand_frac)')} AS asphalt,
 {_U('0.7e0*dry_frac+0.3e0*warm_frac*(1-water)-0.4e0*gray_frac')} AS dry,
 {_U('(0.65e0*sand_frac+0.35e0*dry_frac)*(1-0.9e0*lush_frac)*(1-0.75e0*veg_frac)*(1-0.75e0*water)*(1-0.4e0*road)*(1-0.45e0*greatest(0e0,dry_grass_frac-sand_frac))')} AS sand,
 {_U('lush_frac*(1-0.7e0*sand_frac)*(1-0.6e0*dry_frac)')} AS grass FROM s2),
s4 AS (SELECT *, {_U('least(1e0,water*1.2e0)*(case when water_frac>=0.22e0 OR water_continuity>=0.4e0 then 1e0 else 0.45e0 end)*(1-0.65e0*road)*(1-0.6e0*asphalt)*(1-0.45e0*line)*(case when warm_frac>=0.2e0 then greatest(0e0,1-1.8e0*warm_frac) else 1e0 end)')} AS water_conf,
 {_U('veg_frac*(1-0.4e0*road)*(1-0.65e0*water)*(1-0.5e0*dry)*(1-least(1e0,0.9e0*gray_frac+0.5e0*dark_gray_frac+1.2e0*achro_frac))')} AS veg FROM s3)"""
SCORES = ["veg", "road", "water", "asphalt", "line", "water_conf", "dry", "sand", "grass", "gray_frac", "dark_gray_frac",
          "achro_frac", "warm_frac", "size_frac", "blue_dom_frac"]


@query("h4_cluster_semantics", f"""WITH RECURSIVE lab AS (SELECT row, col, blk+1 AS cluster FROM pixel), {REACH}, {scaled_cte()}, {FLAG_CTE}, {_GRAD}, {_FRAC}, {_SCORES}
SELECT cluster, n, {', '.join(f'round({c},5) AS {c}' for c in SCORES)} FROM s4""", ["pixel"])
def h4(spark, sf):
    out = semantics.tile_semantics(block_tiles(spark, sf), SIDE)
    return out.select("cluster", "n", *[F.round(c, 5).alias(c) for c in SCORES])


@query("h4_pixel_semantics", same_as="h4_cluster_semantics")
def h4p(spark, sf):
    """The same scores from rows of pixels."""
    out = semantics.cluster_semantics(by_block(spark, sf, "pixel"), "nir", 16)
    return out.select("cluster", "n", *[F.round(c, 5).alias(c) for c in SCORES])


@query("i2_i3_runs_continuity", same_as="i2_i3_continuity")
def i23r(spark, sf):
    out = semantics.run_continuity(block_tiles(spark, sf), 4, SIDE)
    return out.select("raster_id", "cluster", *rounded(("continuity", F.col("continuity")), ("water_continuity", F.col("water_continuity"))))


@query("e12_line_score", f"""WITH RECURSIVE lab AS (SELECT row, col, blk+1 AS cluster FROM pixel), {REACH}, {scaled_cte()}, {FLAG_CTE}, {_GRAD}, {_FRAC}
SELECT cluster, round(greatest(0e0, least(1e0, 0.65e0*edge_frac+0.35e0*continuity)),5) AS line FROM fr JOIN ct USING (cluster)""", ["pixel"])
def e12(spark, sf):
    packed = block_tiles(spark, sf)
    chain = semantics.semantic_chain()
    edges = chains.chain_counts(chains.prepared(packed, chain, ["f_edge"], SIDE), chain, "cluster", ["f_edge"])
    both = edges.join(semantics.run_continuity(packed, 4, SIDE), ["raster_id", "cluster"])
    line = F.lit(0.65) * (F.col("f_edge") / F.col("n")) + F.lit(0.35) * F.col("continuity")
    return both.select("cluster", F.round(color.clip(line, 0.0, 1.0), 5).alias("line"))


@query("h11_segment_features", """
SELECT cast(floor(row/5) as int) AS sy, cast(floor(col/25) as int) AS sx, round(avg(r),5) AS mean_r, round(avg(g),5) AS mean_g, round(avg(b),5) AS mean_b,
 round(sqrt(greatest(avg(((r+g+b)/3e0)*((r+g+b)/3e0))-avg((r+g+b)/3e0)*avg((r+g+b)/3e0),0e0)),4) AS texture, round(avg((nir-b)/(nir+b+1e-6)),6) AS ndvi FROM pixel GROUP BY 1,2""", ["pixel"])
def h11(spark, sf):
    px = view(spark, sf, "pixel").withColumn("sy", F.floor(F.col("row") / 5).cast("int")).withColumn("sx", F.floor(F.col("col") / 25).cast("int"))
    out = semantics.segment_features(px, ["sy", "sx"])
    return out.select("sy", "sx", *[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in "rgb"], F.round("texture", 4).alias("texture"),
                      F.round("ndvi", 6).alias("ndvi"))


# --- calibration and histograms ----------------------------------------------

_MAT = "case c_custkey%6 when 0 then 'BM_ASPHALT' when 1 then 'BM_CONCRETE' when 2 then 'BM_VEGETATION' when 3 then 'BM_WATER' when 4 then 'BM_SAND' else 'BM_SOIL' end"


@query("h10_region_statistics", f"""
WITH g AS (SELECT {_MAT} AS material, cast(c_custkey%90 as int) AS x, cast(c_custkey%80 as int) AS y, cast(1+c_nationkey%5 as int) AS w, cast(1+c_nationkey%3 as int) AS h FROM customer),
p AS (SELECT material, r, g.* EXCLUDE (material), pixel.g AS gg, b FROM g JOIN pixel ON col>=x AND col<x+w AND row>=y AND row<y+h),
a AS (SELECT material, count(*) AS n, cast(round_even(avg(r),0) as int) AS mr, cast(round_even(avg(gg),0) as int) AS mg, cast(round_even(avg(b),0) as int) AS mb,
 stddev_pop(r) AS sr, stddev_pop(gg) AS sg, stddev_pop(b) AS sb FROM p GROUP BY 1)
SELECT material, n AS sample_count, mr AS mean_r, mg AS mean_g, mb AS mean_b, round_even(sr,2) AS std_r, round_even(sg,2) AS std_g, round_even(sb,2) AS std_b,
 upper(printf('#%02x%02x%02x', mr, mg, mb)) AS reference_color, greatest(30, cast(round_even(2e0*greatest(sr,sg,sb),0) as int)) AS tolerance_radius FROM a""", ["pixel"])
def h10(spark, sf):
    name = F.element_at(F.array(*[F.lit(c["name"]) for c in CLASSES]), (F.col("c_custkey") % 6 + 1).cast("int"))
    regions = table(spark, sf, "customer").select(
        name.alias("material"), (F.col("c_custkey") % 90).cast("int").alias("x"), (F.col("c_custkey") % 80).cast("int").alias("y"),
        (F.col("c_nationkey") % 5 + 1).alias("w"), (F.col("c_nationkey") % 3 + 1).alias("h"))
    return calibrate.region_statistics(view(spark, sf, "pixel"), regions)


_NEAR6 = argmin_sql(dist_sql([tuple(float(v) for v in CLASS_RGB[c["name"]]) for c in CLASSES], "rgb"))[0]
_NAMES7 = "['DEFAULT'," + ",".join(f"'{c['name']}'" for c in CLASSES) + "]"


@query("h7_material_histogram", f"""
WITH i AS (SELECT case when (r+g+b)/3e0 < 8 then 0 else {_NEAR6} end AS cmix FROM pixel)
SELECT cmix, {_NAMES7}[cmix+1] AS name, count(*) AS n_px, round(count(*)*100e0/sum(count(*)) OVER (), 6) AS pct FROM i GROUP BY 1""", ["pixel"])
def h7(spark, sf):
    """Near-black rule, nearest class colour, paint, index, shares: the whole chain in one pass."""
    px = view(spark, sf, "pixel")
    centres = [tuple(map(float, CLASS_RGB[c["name"]])) for c in CLASSES]
    labels = cluster.nearest_centre(px, ["r", "g", "b"], centres).withColumn(
        "cluster", F.when(F.col("r") + F.col("g") + F.col("b") >= 24, F.col("cluster")).otherwise(F.lit(0)))
    painted = assign.paint_labels(labels, 6, {i: CLASS_RGB[c["name"]] for i, c in enumerate(CLASSES, 1)}).select(
        *KEYS, F.col("paint_r").alias("r"), F.col("paint_g").alias("g"), F.col("paint_b").alias("b"))
    index = export.rgb_to_cmix(painted, export.build_palette())
    return export.histogram(index).select("cmix", "name", "n_px", F.round("pct", 6).alias("pct"))


_LOOK = "case r*65536+g*256+b " + " ".join(
    f"when {(CLASS_RGB[c['name']][0] << 16) | (CLASS_RGB[c['name']][1] << 8) | CLASS_RGB[c['name']][2]} then {i}" for i, c in enumerate(CLASSES, 1)) + " when 0 then 0 end"


def painted_pixels(spark, sf):
    """Class colours by block, black for block five, and off-palette colours where noise is high."""
    rgb = {i: CLASS_RGB[c["name"]] for i, c in enumerate(CLASSES[:5])}
    px = view(spark, sf, "pixel")
    pick = lambda k: F.get(F.array(*[F.lit(rgb[i][k]) for i in range(5)], F.lit(0)), F.col("blk"))
    off = (F.col("nir") % 9 == 0).cast("int")
    return px.select(*KEYS, pick(0).alias("r"), pick(1).alias("g"), (pick(2) + off * (F.col("col") % 11)).alias("b"))


_PAINT = "pp AS (SELECT raster_id, row, col, " + ", ".join(
    f"case blk {' '.join(f'when {i} then {CLASS_RGB[c['name']][k]}' for i, c in enumerate(CLASSES[:5]))} else 0 end"
    + (" + case when nir%9=0 then col%11 else 0 end" if n == "b" else "") + f" AS {n}" for k, n in enumerate("rgb")) + " FROM pixel)"


@query("g16_index_lookup", f"WITH {_PAINT} SELECT {_K}, coalesce({_LOOK},0) AS cmix, ({_LOOK}) IS NOT NULL AS known FROM pp", ["pixel"])
def g16(spark, sf):
    return export.rgb_to_cmix(painted_pixels(spark, sf), export.build_palette()).select(*KEYS, "cmix", "known")


@query("h13_unknown_colours", f"""WITH {_PAINT}, u AS (SELECT r*65536+g*256+b AS packed, count(*) AS n_px FROM pp WHERE ({_LOOK}) IS NULL GROUP BY 1)
SELECT printf('#%06x', packed) AS color, n_px, greatest(0, (SELECT count(*) FROM u)-8) AS more FROM u ORDER BY packed LIMIT 8""", ["pixel"])
def h13(spark, sf):
    return export.unknown_colours(painted_pixels(spark, sf), export.build_palette())


@query("g16_palette_errors", """
WITH c AS (SELECT cast(concat('0x', substr(md5(cast(p_partkey%50 as varchar)),1,6)) as integer)*case when p_partkey%17=0 then 0 else 1 end AS packed FROM part)
SELECT packed, count(*) AS n_classes FROM c GROUP BY 1 HAVING packed=0 OR count(*)>1""")
def g16e(spark, sf):
    hexed = F.when(F.col("p_partkey") % 17 == 0, F.lit("#000000")).otherwise(
        F.concat(F.lit("#"), F.substring(F.md5((F.col("p_partkey") % 50).cast("string")), 1, 6)))
    return export.palette_errors(table(spark, sf, "part").select(hexed.alias("color")))


@query("g17_merge_index", """
WITH t AS (SELECT row+p AS row, col, p AS ord, case when blk=5 then 0 else (blk+p)%7 end AS cmix FROM pixel, (VALUES (0),(1),(2)) v(p))
SELECT row, col, coalesce(arg_max(cmix, ord) FILTER (WHERE cmix<>0), 0) AS cmix FROM t GROUP BY 1,2""", ["pixel"])
def g17(spark, sf):
    px = view(spark, sf, "pixel").withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    px = px.withColumn("cmix", F.when(F.col("blk") == 5, 0).otherwise((F.col("blk") + F.col("ord")) % 7)).withColumn("row", F.col("row") + F.col("ord"))
    return export.merge_index(px, ["row", "col"], F.col("ord"))


@query("j4_first_minimum", """
SELECT o_custkey, arg_min(o_orderkey, round(o_totalprice/50000)*1e12+o_orderkey) AS o_orderkey, min(round(o_totalprice/50000)) AS price_band FROM orders GROUP BY 1""")
def j4(spark, sf):
    """Lowest cost wins and the lowest index breaks ties, as one struct minimum."""
    o = table(spark, sf, "orders")
    band = F.round(F.col("o_totalprice") / 50000)
    low = o.groupBy("o_custkey").agg(F.min(F.struct(band.alias("band"), "o_orderkey")).alias("m"))
    return low.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.band").alias("price_band"))


def slic_sql(rounds, step):
    vals = ["r", "g", "b", "row", "col"]
    w = (0.01 / step) ** 2
    cell = f"cast(floor(row/{step}) as int) AS gy, cast(floor(col/{step}) as int) AS gx"
    out = [f"px AS (SELECT raster_id, row, col, r, g, b, {cell} FROM pixel)",
           "k0 AS (SELECT raster_id, gy, gx, " + ", ".join(f"avg({v}) AS c_{v}" for v in vals) + " FROM px GROUP BY 1,2,3)"]
    for n in range(rounds + 1):
        d = "+".join(f"power(p.{v}-k.c_{v},2)" for v in "rgb") + f"+{w!r}*(power(p.row-k.c_row,2)+power(p.col-k.c_col,2))"
        out.append(f"""a{n} AS (SELECT raster_id, row, col, r, g, b, id AS segment FROM (SELECT p.*, cast(k.gy*1000000+k.gx as bigint) AS id,
 row_number() OVER (PARTITION BY p.row, p.col ORDER BY {d}, k.gy*1000000+k.gx) AS n FROM px p JOIN k{n} k ON k.gy BETWEEN p.gy-1 AND p.gy+1 AND k.gx BETWEEN p.gx-1 AND p.gx+1) z WHERE n=1)""")
        out.append(f"""k{n + 1} AS (SELECT k.raster_id, k.gy, k.gx, {', '.join(f'coalesce(avg(a.{v}), any_value(k.c_{v})) AS c_{v}' for v in vals)}
 FROM k{n} k LEFT JOIN a{n} a ON a.segment=k.gy*1000000+k.gx GROUP BY 1,2,3)""")
    return f"WITH {', '.join(out)} SELECT raster_id, row, col, segment FROM a{rounds}"


@query("l9_superpixels", slic_sql(2, 7), ["pixel"])
def l9(spark, sf):
    px = view(spark, sf, "pixel")
    return semantics.superpixels(px, dims_of(px), 7, rounds=2)
