"""Scaling, k-means, nearest-centre assignment and training-sample size."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import (KMEANS_SEED, PER_RASTER_MIN, SAMPLE_EXTRA, SAMPLE_GRID, SAMPLE_MIN_PER_WINDOW,
                         SAMPLE_WINDOW, TRAIN_HIGH, TRAIN_LOW, TRAIN_MAX)
from ..functions import color
from ..session import cut_lineage
from .stats import attach_by, attach_scalar, drawn, linspace_index, sample_hash, take_lowest

MAX_CENTRES = 1024
KMEANS_STARTS = 10
PARALLEL_STARTS = 5


def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature: one row, whatever the input size."""
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                 *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (float(row[f"m_{f}"]), float(row[f"s_{f}"]) or 1.0) for f in features}


def standardise(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: color.zscore(f, F.lit(m), F.lit(s)) for f, (m, s) in scaler.items()})


def squared_distance(features: list[str], centre) -> Column:
    terms = [(F.col(f).cast("double") - F.lit(float(c))) * (F.col(f).cast("double") - F.lit(float(c)))
             for f, c in zip(features, centre)]
    return sum(terms[1:], terms[0])


def nearest_centre(df: DataFrame, features: list[str], centres, label: str = "cluster",
                   distance: str | None = None) -> DataFrame:
    """One-based index of the nearest centre; the lowest index wins ties.

    Centres are literals in the expression: there are at most a few dozen, and
    the pixels are neither shuffled nor joined.
    """
    if not 0 < len(centres) <= MAX_CENTRES:
        raise ValueError(f"expected 1..{MAX_CENTRES} centres, got {len(centres)}")
    names = [f"_d{i}" for i in range(len(centres))]
    out = df.withColumns({n: squared_distance(features, c) for n, c in zip(names, centres)})
    best = F.least(*names) if len(names) > 1 else F.col(names[0])
    out = out.withColumn("_best", best)
    pick = F.coalesce(*[F.when(F.col(n) == F.col("_best"), F.lit(i + 1)) for i, n in enumerate(names)])
    out = out.withColumn(label, pick)
    if distance:
        out = out.withColumn(distance, F.col("_best"))
    return out.drop("_best", *names)


def nearest_centre_vectors(df: DataFrame, vector: str, centres: np.ndarray, label: str = "cluster",
                           distance: str = "distance") -> DataFrame:
    """Nearest centre for long vectors, in Arrow batches with one matrix product each."""
    c = np.asarray(centres, dtype=np.float64)
    if not 0 < len(c) <= MAX_CENTRES:
        raise ValueError(f"expected 1..{MAX_CENTRES} centres, got {len(c)}")
    c2 = (c * c).sum(axis=1)

    @pandas_udf("struct<label:int,distance:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + c2[None, :], 0.0)
        i = d.argmin(axis=1)
        return pd.DataFrame({"label": i + 1, "distance": d[np.arange(len(i)), i]})

    return df.withColumn("_a", assign(vector)).withColumn(label, F.col("_a.label")).withColumn(
        distance, F.col("_a.distance")).drop("_a")


def lloyd(df: DataFrame, features: list[str], init, iterations: int) -> list[list[float]]:
    """Fixed-start k-means: each round is one aggregation with k output rows.

    An empty cluster keeps its centre.
    """
    centres = [list(map(float, c)) for c in init]
    for _ in range(iterations):
        rows = nearest_centre(df, features, centres).groupBy("cluster").agg(
            *[F.avg(f).alias(f) for f in features]).collect()  # at most k rows
        for r in rows:
            centres[r["cluster"] - 1] = [float(r[f]) for f in features]
    return centres


def start_models(df: DataFrame, features: list[str], k: int, by: list[str]) -> DataFrame:
    """A fixed start per group: ``k`` evenly spaced quantiles of the mean feature, and the features' deviations."""
    level = sum((F.col(f).cast("double") for f in features[1:]), F.col(features[0]).cast("double")) / len(features)
    counted = df.groupBy(*by, level.alias("_v")).agg(F.count("*").alias("_n"))
    probs = F.array(*[F.lit((2 * i + 1) / (2 * k)) for i in range(k)])
    start = counted.groupBy(*by).agg(F.percentile("_v", probs, F.col("_n")).alias("_q"))
    centres = F.transform("_q", lambda q: F.array(*[q] * len(features)))
    spread = df.groupBy(*by).agg(F.array(*[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0))
                                           for f in features]).alias("scale"))
    return start.select(*by, centres.alias("centres")).join(spread, by)


def lloyd_by(df: DataFrame, features: list[str], models: DataFrame, by: list[str], rounds: int = 10) -> DataFrame:
    """Fixed-start k-means of every group at once; a round is one aggregation over all groups.

    ``models`` has ``centres`` and ``scale`` per group. An empty cluster keeps its centre.
    """
    df = df.select(*by, *features)
    for _ in range(rounds):
        means = nearest_centre_by(df, features, models, by).groupBy(*by, "cluster").agg(
            F.array(*[F.avg(f) for f in features]).alias("_m"))
        found = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "_m"))).alias("_new"))
        centres = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("_new", i + 1), c))
        models = cut_lineage(models.join(found, by, "left").select(*by, centres.alias("centres"), "scale"))
    return models


def nearest_centre_by(df: DataFrame, features: list[str], models: DataFrame, by: list[str],
                      label: str = "cluster") -> DataFrame:
    """Nearest centre under each group's own model (``centres``, ``scale``)."""
    held = attach_by(df, models, by)
    x = F.array(*[F.col(f).cast("double") for f in features])
    cost = lambda c: F.aggregate(F.zip_with(F.zip_with(x, c, lambda a, b: a - b), F.col("scale"),
                                            lambda d, s: (d / s) * (d / s)), F.lit(0.0), lambda t, v: t + v)
    best = F.array_min(F.transform("centres", lambda c, i: F.struct(cost(c).alias("d"), i.alias("i"))))
    return held.withColumn(label, best["i"] + 1).drop("centres", "scale")


def inertia(df: DataFrame, features: list[str], centres) -> DataFrame:
    return nearest_centre(df, features, centres, distance="_dist").agg(F.sum("_dist").alias("inertia"))


def fit_kmeans(sample: DataFrame, features: list[str], k: int, seed: int = KMEANS_SEED, starts: int = KMEANS_STARTS):
    """Spark ML k-means on the given rows, the best of several seeded starts.

    Returns the scaler and the centres in standard units.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    sample = cut_lineage(sample.select(*features))
    scaler = fit_scaler(sample, features)
    vec = VectorAssembler(inputCols=features, outputCol="_v").transform(standardise(sample, scaler)).select("_v").cache()
    try:
        vec.count()
        fit = lambda i: KMeans(k=k, seed=seed + i, maxIter=300, featuresCol="_v").fit(vec)
        with ThreadPoolExecutor(PARALLEL_STARTS) as pool:  # independent jobs on the same cached rows
            best = min(pool.map(fit, range(starts)), key=lambda m: m.summary.trainingCost)
        return scaler, sorted([list(map(float, c)) for c in best.clusterCenters()])
    finally:
        vec.unpersist()


def size_from_correlation(n: int, correlation: np.ndarray, n_clusters: int) -> tuple[float, int]:
    """Normalised entropy of the spectrum of a correlation matrix, and the training-sample size that follows."""
    n_feat = len(correlation)
    if n <= TRAIN_LOW or n_feat <= 1:
        return 0.0, min(n, TRAIN_MAX)
    share = np.clip(np.linalg.eigvalsh(correlation) / n_feat, 1e-12, None)
    norm = float(-(share * np.log(share)).sum()) / max(math.log(n_feat), 1e-9)
    part = 0.6 * (1.0 - norm) + 0.4 * min(1.0, n_clusters / 15.0)
    return norm, min(int(np.clip(TRAIN_LOW + part * (TRAIN_HIGH - TRAIN_LOW), TRAIN_LOW, TRAIN_HIGH)), n)


def complexity_sample_size(df: DataFrame, features: list[str], n_clusters: int) -> DataFrame:
    """Training-sample size from the entropy of the correlation spectrum.

    The correlation matrix is one aggregation; its eigenvalues are those of a
    matrix as small as the feature list.
    """
    n_feat = len(features)
    pairs = [(i, j) for i in range(n_feat) for j in range(i + 1, n_feat)]
    row = df.agg(F.count("*").alias("n"), *[F.corr(features[i], features[j]).alias(f"c_{i}_{j}")
                                            for i, j in pairs]).first()
    m = np.eye(n_feat)
    for i, j in pairs:
        c = row[f"c_{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if c is None or math.isnan(c) else c
    n = int(row["n"])
    norm, size = size_from_correlation(n, m, n_clusters)
    return df.sparkSession.createDataFrame([(n, round(norm, 6), size)],
                                           "n_pixels long, norm_entropy double, train_pixels long")


def sample_windows(dims: DataFrame, seed: int = 42, grid: int = SAMPLE_GRID, window: int = SAMPLE_WINDOW,
                   extra: int = SAMPLE_EXTRA) -> DataFrame:
    """A grid of windows plus seeded extra ones for every raster: ``wr, wc`` and side ``win``.

    Arithmetic on the raster sizes ``raster_h, raster_w`` only; the extra windows are
    drawn from the raster, the window's number and the axis, so rasters differ.
    """
    d = dims.withColumn("win", F.least(F.lit(window), F.col("raster_h"), F.col("raster_w")))
    top = lambda side: F.greatest(F.lit(0), F.col(side) - F.col("win"))
    rows, cols = linspace_index(top("raster_h") + 1, grid), linspace_index(top("raster_w") + 1, grid)
    regular = d.select("raster_id", "win", F.explode(rows).alias("wr"), cols.alias("_cs")).select(
        "raster_id", "win", "wr", F.explode("_cs").alias("wc"))
    pick = lambda side, axis: F.pmod(
        drawn("raster_id", "k", F.lit(axis), F.lit(seed)), F.greatest(F.lit(1), top(side)).cast("long"))
    more = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(extra))))
    more = more.select("raster_id", "win", pick("raster_h", "row").alias("wr"), pick("raster_w", "col").alias("wc"))
    return regular.unionByName(more).distinct()


def window_sample(px: DataFrame, windows: DataFrame, per: int, window: int = SAMPLE_WINDOW, seed: int = 42,
                  keys: DataFrame | None = None) -> DataFrame:
    """Exactly ``per`` covered pixels from every window (all of a smaller one).

    ``keys`` may be a cheaper frame with the same pixels for the counting passes.
    """
    # equi-join on cells of one window side keeps this from being a range scan
    cells = lambda at: F.explode(F.sequence(F.floor(F.col(at) / window),
                                            F.floor((F.col(at) + F.col("win") - 1) / window)))
    w = windows.withColumn("_ky", cells("wr")).withColumn("_kx", cells("wc"))

    def inside(p: DataFrame) -> DataFrame:
        p = p.filter((F.col("r") + F.col("g") + F.col("b")) >= 24).withColumn(
            "_ky", F.floor(F.col("row") / window)).withColumn("_kx", F.floor(F.col("col") / window))
        return p.join(w, ["raster_id", "_ky", "_kx"]).filter(
            (F.col("row") >= F.col("wr")) & (F.col("row") < F.col("wr") + F.col("win"))
            & (F.col("col") >= F.col("wc")) & (F.col("col") < F.col("wc") + F.col("win")))

    picked = take_lowest(inside(px), per, sample_hash("row", "col", seed), ["row", "col"], ["raster_id", "wr", "wc"],
                         inside(keys) if keys is not None else None)
    return picked.select(*px.columns, "wr", "wc")


def per_window(n_samples: int, grid: int = SAMPLE_GRID, extra: int = SAMPLE_EXTRA) -> int:
    return max(SAMPLE_MIN_PER_WINDOW, n_samples // (grid * grid + extra))


def uniform_sample(df: DataFrame, n: int, row: str = "row", col: str = "col", seed: int = 42,
                   by: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Exactly ``n`` rows (per group), chosen by a hash of raster and position."""
    raster = "raster_id" if "raster_id" in df.columns else None
    tie = [*([raster] if raster else []), row, col]
    return take_lowest(df, n, sample_hash(row, col, seed, raster), tie, by or [], keys)


def per_raster_budget(n_rasters: int, total: int = TRAIN_MAX) -> int:
    """Training pixels each raster gives to a shared model."""
    return max(PER_RASTER_MIN, total // max(1, n_rasters))


def _centre_cells(rasters: DataFrame, budget: int | None) -> tuple[DataFrame, DataFrame]:
    """Rasters with their grid cell, and the one-row grid description."""
    src = rasters.select("path", ((F.col("west") + F.col("east")) / 2).alias("_cx"),
                         ((F.col("south") + F.col("north")) / 2).alias("_cy"))
    n = F.count("*")
    want = F.lit(budget) if budget else F.greatest(F.lit(8), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    box = src.agg(n.alias("n"), F.least(want, n).alias("budget"), F.min("_cx").alias("x0"), F.min("_cy").alias("y0"),
                  (F.max("_cx") - F.min("_cx")).alias("rx"), (F.max("_cy") - F.min("_cy")).alias("ry"))
    one = lambda c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c))
    side = lambda x: F.greatest(F.lit(1), F.bround(x).cast("int"))
    box = box.withColumn("rx", one("rx")).withColumn("ry", one("ry"))
    box = box.withColumn("ny", side(F.sqrt(F.col("budget") / (F.col("rx") / F.col("ry")))))
    box = box.withColumn("nx", side(F.col("budget") / F.col("ny")))
    box = box.withColumn("cw", F.col("rx") / F.col("nx")).withColumn("ch", F.col("ry") / F.col("ny"))
    held = attach_scalar(src, box)
    cell = lambda v, lo, size, m: F.least(F.floor((F.col(v) - F.col(lo)) / F.col(size)), F.col(m) - 1)
    return held.withColumn("_ix", cell("_cx", "x0", "cw", "nx")).withColumn("_iy", cell("_cy", "y0", "ch", "ny")), box


def grid_representatives(rasters: DataFrame, budget: int | None = None) -> DataFrame:
    """The raster nearest the centre of each cell of a grid with about ``budget`` cells."""
    held, _ = _centre_cells(rasters, budget)
    dx = F.col("_cx") - (F.col("x0") + (F.col("_ix") + 0.5) * F.col("cw"))
    dy = F.col("_cy") - (F.col("y0") + (F.col("_iy") + 0.5) * F.col("ch"))
    near = F.struct((dx * dx + dy * dy).alias("d"), F.col("path"))
    return held.groupBy("_ix", "_iy").agg(F.min_by("path", near).alias("path")).select("path")


def representative_rasters(rasters: DataFrame, budget: int | None = None) -> DataFrame:
    """Mark a spatially spread subset of rasters for training (``selected``).

    ``rasters`` has ``path, west, south, east, north``. Grid cells give one raster
    each; a seeded hash of the path fills what is left of the budget.
    """
    held, box = _centre_cells(rasters, budget)
    first = grid_representatives(rasters, budget)
    taken = first.agg(F.count("*").alias("c"))
    left = attach_scalar(box.select("budget"), taken).select((F.col("budget") - F.col("c")).alias("left")).scalar()
    rest = rasters.select("path").join(first, "path", "left_anti")
    fill = take_lowest(rest, left, F.pmod(F.xxhash64("path", F.lit(42)), F.lit(1 << 48)), ["path"], [])
    chosen = first.unionByName(fill.select("path")).withColumn("_sel", F.lit(True))
    return held.select("path", "n", "budget").join(chosen, "path", "left").select(
        "path", (F.coalesce("_sel", F.lit(False)) | (F.col("n") <= F.col("budget"))).alias("selected"))
