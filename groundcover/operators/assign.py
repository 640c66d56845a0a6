"""Naming clusters: colour costs, one-to-one assignment and the scene prior."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (BRIGHT_SUM, CLASSES, CLASS_RGB, PRIOR_COST, PRIOR_OPEN, PRIOR_UNLISTED, PRIOR_URBAN,
                         SHAPE_COST, ZONE_COUNT, ZONE_MAX_PX, ZONE_MIN_PX, ZONE_RADIUS_M)
from ..functions import color
from ..functions.naming import literal_map
from ..functions.predicates import open_scene_flags, open_weight
from .stats import attach_by, int_percentiles

MAX_CLUSTERS = 256


def _every_cluster(present: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Ids one to ``k``, for every group that occurs."""
    ids = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("cluster")
    if by:
        return present.select(*by).distinct().select(*by, ids)
    return present.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("cluster"))


def cluster_counts(labels: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Pixels per cluster; clusters without pixels are listed with zero."""
    by = by or []
    counted = labels.groupBy(*by, "cluster").agg(F.count("*").alias("n"))
    return _every_cluster(counted, k, by).join(counted, [*by, "cluster"], "left").select(
        *by, "cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cluster_mean_rgb(labels: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Mean colour per cluster, truncated; an empty cluster is mid gray."""
    by = by or []
    means = labels.groupBy(*by, "cluster").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in ("r", "g", "b")])
    return _every_cluster(means, k, by).join(means, [*by, "cluster"], "left").select(
        *by, "cluster", *[F.coalesce(c, F.lit(128)).alias(c) for c in ("r", "g", "b")])


def centres_to_rgb(centres: DataFrame, scaler: dict[str, tuple[float, float]], bands: list[str]) -> DataFrame:
    """Centres back in colour units, rounded and clipped."""
    back = lambda f: color.clip(F.bround(F.col(f) * scaler[f][1] + scaler[f][0]), 0.0, 255.0).cast("int")
    return centres.select("cluster", *[back(f).alias(n) for f, n in zip(bands, ("r", "g", "b"))])


def class_colours(means: DataFrame, classes: DataFrame) -> DataFrame:
    """A class's own well-formed colour, else the mean colour of its cluster."""
    ok = F.col("color").rlike("^#?[0-9A-Fa-f]{6}$")
    own = classes.select("cluster", F.when(ok, color.hex_to_rgb("color")).alias("_own"))
    return means.join(own, "cluster", "left").select(
        *[c for c in means.columns if c not in "rgb"],
        *[F.coalesce(F.col(f"_own.{c}"), F.col(c)).alias(c) for c in ("r", "g", "b")])


def active_anchors(profile: dict[str, list[list[int]]] | None, names: list[str]) -> dict[str, list[list[int]]]:
    """Anchor colours: the profile's list when it has one, else the built-in list."""
    built = {c["name"]: c["anchors"] for c in CLASSES}
    profile = profile or {}
    return {n: (profile.get(n) or built.get(n) or []) for n in names}


def anchor_cost(clusters: DataFrame, anchors: dict[str, list[list[int]]]) -> DataFrame:
    """Lowest squared colour distance from each cluster to each material's anchors.

    Materials and anchors are a short literal list, so pairs come from an
    explode and nothing is joined.
    """
    d = lambda a: ((F.col("r") - a["r"]) * (F.col("r") - a["r"]) + (F.col("g") - a["g"]) * (F.col("g") - a["g"])
                   + (F.col("b") - a["b"]) * (F.col("b") - a["b"]))
    rgb = lambda a: F.struct(F.lit(a[0]).alias("r"), F.lit(a[1]).alias("g"), F.lit(a[2]).alias("b"))
    table = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("material"),
                               F.array(*[rgb(a) for a in lst]).alias("anchors"))
                      for i, (n, lst) in enumerate(anchors.items())])
    out = clusters.withColumn("_m", F.explode(table))
    return out.select(*clusters.columns, F.col("_m.pos").alias("pos"), F.col("_m.material").alias("material"),
                      F.array_min(F.transform("_m.anchors", d)).cast("double").alias("cost"))


def naming_cost(clusters: DataFrame, anchors: dict[str, list[list[int]]],
                prior: dict[str, float] | None = None) -> DataFrame:
    """Anchor cost plus the prior term and the hue-shape term."""
    out = anchor_cost(clusters, anchors)
    cost = F.col("cost")
    if prior:
        share = F.coalesce(literal_map({k: float(v) for k, v in prior.items()})[F.col("material")], F.lit(0.0))
        cost = cost + F.lit(PRIOR_COST) * (F.lit(1.0) - share)
    green, bright = F.col("g") > F.col("r"), (F.col("r") + F.col("g") + F.col("b")) > BRIGHT_SUM
    m = F.col("material")
    odd = ((m == "BM_VEGETATION") & ~green) | ((m == "BM_SOIL") & green) | ((m == "BM_SAND") & ~bright)
    return out.withColumn("cost", cost + F.when(odd, F.lit(SHAPE_COST)).otherwise(F.lit(0.0)))


def solve_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment; -1 for rows left over.

    Shortest augmenting paths with potentials on a small dense matrix.
    """
    n, m = cost.shape
    if n > m:
        got = solve_assignment(cost.T)
        out = np.full(n, -1)
        out[got] = np.arange(m)
        return out
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        dist, prev = cost[i] - u[i] - v, np.full(m, -1)
        used = np.zeros(m, dtype=bool)
        while True:
            j = int(np.where(used, np.inf, dist).argmin())
            used[j] = True
            if owner[j] < 0:
                break
            row = owner[j]
            step = dist[j] + cost[row] - u[row] - v
            better = ~used & (step < dist)
            prev[better], dist[better] = j, step[better]
        reach = dist[j]
        seen = used.copy()
        seen[j] = False
        for c in np.flatnonzero(seen):
            u[owner[c]] += reach - dist[c]
            v[c] -= reach - dist[c]
        u[i] += reach
        while j >= 0:
            back = int(prev[j])
            owner[j] = owner[back] if back >= 0 else i
            j = back
    out = np.full(n, -1)
    for j, r in enumerate(owner):
        if r >= 0:
            out[r] = j
    return out


def assign_materials(cost: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one naming per raster; leftover clusters take their cheapest material.

    A group is one raster's cost table, at most a few hundred rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_CLUSTERS * MAX_CLUSTERS:
            raise ValueError("cost table too large: is the grouping key complete?")
        names = pdf.sort_values("pos").drop_duplicates("pos")["material"].tolist()
        grid = pdf.pivot(index="cluster", columns="pos", values="cost").sort_index()
        c = grid.to_numpy()
        pick = solve_assignment(c)
        pick = np.where(pick < 0, c.argmin(axis=1), pick)
        data = {k: [v] * len(pick) for k, v in zip(by, key)}
        return pd.DataFrame({**data, "cluster": grid.index.to_numpy(), "material": [names[j] for j in pick],
                             "cost": c[np.arange(len(pick)), pick]})

    types = dict(cost.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "cluster int, material string, cost double"
    return cost.groupBy(*by).applyInPandas(run, schema)


def with_material_colour(mapping: DataFrame) -> DataFrame:
    hexes = literal_map({c["name"]: c["color"] for c in CLASSES})
    rgb = color.hex_to_rgb(hexes[F.col("material")])
    return mapping.withColumn("color", hexes[F.col("material")]).withColumn("_c", rgb).select(
        *mapping.columns, "color", *[F.col(f"_c.{c}").alias(f"paint_{c}") for c in "rgb"])


def greedy_colours(clusters: DataFrame, colours: list[tuple[int, int, int]], by: list[str]) -> DataFrame:
    """Nearest colour in cluster order, each used once while unused ones remain."""
    table = np.asarray(colours, dtype=np.int64)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        free = np.ones(len(table), dtype=bool)
        picks = []
        for rgb in pdf[["r", "g", "b"]].to_numpy(dtype=np.int64):
            d = ((table - rgb) ** 2).sum(axis=1).astype(float)
            j = int(np.where(free, d, np.inf).argmin()) if free.any() else int(d.argmin())
            free[j] = False
            picks.append(j)
        data = {k: [v] * len(picks) for k, v in zip(by, key)}
        return pd.DataFrame({**data, "cluster": pdf["cluster"].to_numpy(), "colour": np.array(picks) + 1})

    types = dict(clusters.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "cluster int, colour int"
    return clusters.groupBy(*by).applyInPandas(run, schema)


def paint_labels(labels: DataFrame, n_classes: int, lut: dict[int, tuple[int, int, int]],
                 label: str = "cluster") -> DataFrame:
    """Colour of each label; ids are clipped to the table and zero is black."""
    packed = {int(k): (r << 16) | (g << 8) | b for k, (r, g, b) in lut.items()} | {0: 0}
    at = F.greatest(F.lit(0), F.least(F.lit(n_classes), F.col(label).cast("int")))
    r, g, b = color.unpack_rgb(F.coalesce(literal_map(packed)[at], F.lit(0)))
    return labels.withColumns({"paint_r": r, "paint_g": g, "paint_b": b})


def weighted_cluster_mean(per_raster: DataFrame, scores: list[str], weight: str = "n") -> DataFrame:
    """Score means over rasters, weighted by cluster size; no pixels gives zero."""
    total = F.sum(weight)
    return per_raster.groupBy("cluster").agg(
        total.cast("long").alias("n"),
        *[F.when(total > 0, F.sum(F.col(s) * F.col(weight)) / total).otherwise(F.lit(0.0)).alias(s) for s in scores])


def scene_zones(rasters: DataFrame, metres_per_px: Column) -> DataFrame:
    """Square zones of each raster; one zone over all of a small raster.

    Columns: ``zone, y0, y1, x0, x1`` with exclusive ends.
    """
    radius = F.greatest(F.lit(ZONE_MIN_PX), F.least(F.lit(ZONE_MAX_PX), F.floor(F.lit(ZONE_RADIUS_M) / metres_per_px)))
    d = rasters.withColumn("_rad", radius.cast("int"))
    side = 4  # the zone count is a square
    small = (F.col("raster_h") < 2 * F.col("_rad") + 1) | (F.col("raster_w") < 2 * F.col("_rad") + 1)
    centre = lambda n, i: F.when(i == side - 1, n - F.col("_rad") - 1).otherwise(
        F.floor(F.col("_rad") + i * ((n - 2 * F.col("_rad") - 1) / F.lit(float(side - 1))))).cast("int")
    cells = F.explode(F.sequence(F.lit(0), F.lit(ZONE_COUNT - 1)))
    big = d.filter(~small).withColumn("zone", cells)
    i, j = F.floor(F.col("zone") / side), F.col("zone") % side
    big = big.withColumn("_cy", centre(F.col("raster_h"), i)).withColumn("_cx", centre(F.col("raster_w"), j))
    big = big.select("raster_id", "zone", (F.col("_cy") - F.col("_rad")).alias("y0"),
                     (F.col("_cy") + F.col("_rad") + 1).alias("y1"), (F.col("_cx") - F.col("_rad")).alias("x0"),
                     (F.col("_cx") + F.col("_rad") + 1).alias("x1"))
    one = d.filter(small).select("raster_id", F.lit(0).alias("zone"), F.lit(0).alias("y0"),
                                 F.col("raster_h").alias("y1"), F.lit(0).alias("x0"), F.col("raster_w").alias("x1"))
    return big.unionByName(one)


def _openness(zoned: DataFrame) -> DataFrame:
    """Openness and its three fractions per raster, averaged over the zones of its pixels."""
    keys = ["raster_id", "zone"]
    pooled = zoned.select(*keys, F.explode(F.array("r", "g", "b")).alias("v"))
    scale = int_percentiles(pooled, F.col("v"), {"scale": 0.98}, keys)
    s = attach_by(zoned, scale, keys).select(*keys, *[color.scale_clip(c, "scale").alias(c) for c in ("r", "g", "b")])
    flags = open_scene_flags("r", "g", "b")
    per = s.groupBy(*keys).agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()])
    per = per.withColumn("open_weight", open_weight("veg", "soil", "gray"))
    return per.groupBy("raster_id").agg(F.avg("open_weight").alias("open_weight"), F.avg("veg").alias("veg"),
                                        F.avg("soil").alias("soil"), F.avg("gray").alias("gray"),
                                        F.count("*").alias("zones"))


def scene_fractions(px: DataFrame) -> DataFrame:
    """Openness and its three fractions per raster, over all its pixels."""
    return _openness(px.select("raster_id", F.lit(0).alias("zone"), "r", "g", "b"))


def zone_fractions(px: DataFrame, rasters: DataFrame, metres_per_px: Column) -> DataFrame:
    """The same averaged over sixteen zones of a large raster, where a caller asks for zones."""
    zones = scene_zones(rasters, metres_per_px).groupBy("raster_id").agg(
        F.collect_list(F.struct("zone", "y0", "y1", "x0", "x1")).alias("_zones"))  # at most 16 each
    held = attach_by(px.select("raster_id", "row", "col", "r", "g", "b"), zones, ["raster_id"])
    inside = F.filter("_zones", lambda z: (F.col("row") >= z["y0"]) & (F.col("row") < z["y1"])
                      & (F.col("col") >= z["x0"]) & (F.col("col") < z["x1"]))
    return _openness(held.select("raster_id", "r", "g", "b", F.explode(inside).alias("_z")).select(
        "raster_id", F.col("_z.zone").alias("zone"), "r", "g", "b"))


def scene_prior(fractions: DataFrame, names: list[str]) -> DataFrame:
    """Urban and open shares blended by openness and normalised, one row per material."""
    pairs = F.array(*[F.struct(F.lit(n).alias("material"), F.lit(PRIOR_URBAN.get(n, PRIOR_UNLISTED)).alias("u"),
                               F.lit(PRIOR_OPEN.get(n, PRIOR_UNLISTED)).alias("o")) for n in names])
    w = F.col("open_weight")
    blended = F.transform(pairs, lambda p: F.struct(
        p["material"].alias("material"), ((F.lit(1.0) - w) * p["u"] + w * p["o"]).alias("p")))
    total = F.aggregate("_b", F.lit(0.0), lambda acc, p: acc + p["p"])
    return fractions.withColumn("_b", blended).withColumn("_t", total).select(
        "raster_id", "open_weight", F.explode("_b").alias("_p"), "_t").select(
        "raster_id", "open_weight", F.col("_p.material").alias("material"), (F.col("_p.p") / F.col("_t")).alias("prior"))
