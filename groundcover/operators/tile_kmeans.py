"""K-means on stored tiles: moments, seeding and Lloyd rounds are sums formed inside tiles.

Tiles get their border once and are kept; every pass reads them where they lie, computes the
features of a tile, and gives a few numbers a task. No pixel becomes a row and no pass shuffles more than
these numbers. Sums of a tile are fixed-point numbers, so totals do not depend on how tiles meet.

Seeding follows k-means|| (Bahmani et al., "Scalable K-Means++", VLDB 2012): each round draws pixels with
probability in proportion to their squared distance from the candidates so far. It is drawn as a race: every pixel
gets an exponential time over its distance, and the earliest win, so one pass does without the total cost. The
candidates, weighed by the pixels nearest to them, are few; k-means++ on them gives the starts, which run side by side in each pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tiles import padded_tiles

#: Fixed-point steps in one: squares of bytes over a tile of 4096 by 4096 still fit 63 bits.
STEPS = 1 << 16
SEED_ROUNDS, STARTS, MAX_ROUNDS, TOLERANCE = 4, 3, 100, 1e-4
_U = np.uint64


@dataclass(frozen=True)
class Features:
    """Names of the features and the function from a padded canvas of bands to their planes."""

    names: tuple[str, ...]
    planes: Callable[[np.ndarray], np.ndarray]
    radius: int = 0
    covered_only: bool = True


def kept_tiles(tiles: DataFrame, features: Features, tile: int) -> DataFrame:
    """Tiles with the border that the features need, kept for many passes."""
    return cut_lineage(padded_tiles(tiles, features.radius, tile))


def _points(t, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of a tile's own pixels, and their place in the raster as ``row << 32 | col``."""
    canvas = np.frombuffer(t.data, dtype=np.uint8).reshape(t.n_bands, t.pad_h, t.pad_w)
    core = (slice(t.row0 - t.y0, t.row0 - t.y0 + t.h), slice(t.col0 - t.x0, t.col0 - t.x0 + t.w))
    planes = features.planes(canvas)[(slice(None), *core)]
    keep = np.ones((t.h, t.w), dtype=bool)
    if features.covered_only:
        keep = canvas[(slice(0, 3), *core)].sum(axis=0, dtype=np.int64) >= 24
    rows, cols = np.nonzero(keep)
    return np.ascontiguousarray(planes[:, keep].T), (rows + t.row0).astype(np.int64) << 32 | (cols + t.col0)


def _fixed(values: np.ndarray) -> list[int]:
    return [int(v) for v in np.rint(np.asarray(values, dtype=np.float64).ravel() * STEPS)]


def _sums(kept: DataFrame, features: Features, of_tile: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tiles of a small array that ``of_tile`` makes of a tile's points."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[int] = []
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                x, _ = _points(t, features)
                part = _fixed(of_tile(x))
                total = [a + b for a, b in zip(total, part)] if total else part
        if total:
            yield pd.DataFrame({"at": range(len(total)), "v": [Decimal(v) for v in total]})

    rows = kept.mapInPandas(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for at, v in rows:  # as many as the array has places
        out[at] = int(v) / STEPS
    return out


@dataclass(frozen=True)
class Moments:
    """Number of pixels, means, deviations and correlation of the features."""

    n: int
    mean: np.ndarray
    std: np.ndarray
    correlation: np.ndarray


def moments(kept: DataFrame, features: Features) -> Moments:
    f = len(features.names)
    got = _sums(kept, features, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    if not len(got) or got[0] == 0:
        return Moments(0, np.zeros(f), np.ones(f), np.eye(f))
    n, mean = got[0], got[1:f + 1] / got[0]
    cov = got[f + 1:].reshape(f, f) / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(cov.diagonal(), 0))
    std = np.where(std > 1e-9 * np.maximum(1, np.abs(mean)), std, 1.0)
    correlation = np.clip(cov / np.outer(std, std), -1, 1)
    np.fill_diagonal(correlation, 1.0)
    return Moments(int(n), mean, std, correlation)


def nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre, the lowest on ties, and its squared distance."""
    best, at = np.full(len(z), np.inf), np.zeros(len(z), dtype=np.int64)
    for i, c in enumerate(centres):
        d = ((z - c) ** 2).sum(axis=1)
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at, best


def _per_centre(kept: DataFrame, features: Features, mean: np.ndarray, std: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """For every centre of every set: pixels nearest to it, their sums by feature, and their squared distances."""
    s, k, f = sets.shape

    def of_tile(x: np.ndarray) -> np.ndarray:
        z, out = (x - mean) / std, np.zeros((s, k, f + 2))
        for i, centres in enumerate(sets):
            at, d = nearest(z, centres)
            out[i, :, 0] = np.bincount(at, minlength=k)
            for j in range(f):
                out[i, :, j + 1] = np.bincount(at, weights=x[:, j], minlength=k)
            out[i, :, f + 1] = np.bincount(at, weights=d, minlength=k)
        return out

    got = _sums(kept, features, of_tile)
    return got.reshape(s, k, f + 2) if len(got) else np.zeros((s, k, f + 2))


def _drawn(raster: str, place: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) of each pixel, the same on every run."""
    x = place.astype(_U) + _U(0x9E3779B97F4A7C15) * _U(zlib.crc32(raster.encode()) + (seed << 32) + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(np.float64) / 2**53 + 2**-54


def _race(kept: DataFrame, features: Features, mean, std, candidates: np.ndarray | None, n: int, seed: int) -> np.ndarray:
    """Features of ``n`` pixels drawn by their squared distance from the candidates; without any, evenly."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                x, place = _points(t, features)
                with np.errstate(over="ignore"):
                    time = -np.log(_drawn(t.raster_id, place, seed))
                if candidates is not None:
                    _, d = nearest((x - mean) / std, candidates)
                    x, time, place = x[d > 0], time[d > 0] / d[d > 0], place[d > 0]
                first = np.lexsort((place, time))[:n]
                held += [(float(time[i]), t.raster_id, int(place[i]), x[i].tolist()) for i in first]
                held = sorted(held)[:n]
        if held:
            yield pd.DataFrame(held, columns=["time", "raster_id", "place", "x"])

    rows = kept.mapInPandas(run, "time double, raster_id string, place long, x array<double>")
    return np.array([r["x"] for r in rows.orderBy("time", "raster_id", "place").limit(n).collect()]).reshape(-1, len(features.names))


def seeds(kept: DataFrame, features: Features, at: Moments, k: int, starts: int = STARTS, seed: int = 42,
          rounds: int = SEED_ROUNDS) -> np.ndarray:
    """Starting centres in standard units, one set per start."""
    candidates = (_race(kept, features, at.mean, at.std, None, 1, seed) - at.mean) / at.std
    for r in range(1, rounds + 1):
        more = (_race(kept, features, at.mean, at.std, candidates, 2 * k, seed + r) - at.mean) / at.std
        if not len(more):
            break
        candidates = np.unique(np.vstack([candidates, more]), axis=0)
    weight = _per_centre(kept, features, at.mean, at.std, candidates[None])[0, :, 0]
    rng, sets = np.random.default_rng(seed), []
    for _ in range(starts):
        chosen = [rng.choice(len(candidates), p=weight / weight.sum())]
        while len(chosen) < k:
            cost = nearest(candidates, candidates[chosen])[1] * weight
            chosen.append(rng.choice(len(candidates), p=cost / cost.sum()) if cost.sum() > 0 else chosen[0])
        centres = candidates[chosen]
        for _ in range(20):
            label = nearest(candidates, centres)[0]
            total = np.bincount(label, weights=weight, minlength=k)
            means = np.stack([np.bincount(label, weights=weight * c, minlength=k) for c in candidates.T], axis=1)
            centres = np.where(total[:, None] > 0, means / np.maximum(total, 1e-300)[:, None], centres)
        sets.append(centres)
    return np.array(sets)


def lloyd(kept: DataFrame, features: Features, at: Moments, sets: np.ndarray, rounds: int = MAX_ROUNDS,
          tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """The best of several sets of centres, in standard units, after at most ``rounds`` rounds side by side, and its cost.

    An empty cluster keeps its centre. A set whose centres move less than ``tolerance`` is done.
    """
    sets, live = sets.copy(), np.ones(len(sets), dtype=bool)
    for _ in range(rounds):
        if not live.any():
            break
        got = _per_centre(kept, features, at.mean, at.std, sets[live])
        n, sums = got[:, :, :1], got[:, :, 1:-1]
        new = np.where(n > 0, (sums / np.maximum(n, 1) - at.mean) / at.std, sets[live])
        moved = np.abs(new - sets[live]).max(axis=(1, 2))
        sets[live] = new
        live[np.flatnonzero(live)[moved < tolerance]] = False
    if len(sets) == 1:
        return sets[0], float("nan")
    cost = _per_centre(kept, features, at.mean, at.std, sets)[:, :, -1].sum(axis=1)
    return sets[cost.argmin()], float(cost.min())


def fit(kept: DataFrame, features: Features, k: int, seed: int = 42, starts: int = STARTS, rounds: int = MAX_ROUNDS,
        start=None) -> tuple[dict[str, tuple[float, float]], list[list[float]]]:
    """Scaler and centres in standard units of all covered pixels.

    ``start``, centres in units of the features, stands in for the seeding, and keeps its order.
    """
    at = moments(kept, features)
    if not at.n:
        raise ValueError("no covered pixel to train on")
    if start is None:
        centres = sorted(lloyd(kept, features, at, seeds(kept, features, at, k, starts, seed), rounds)[0].tolist())
    else:
        sets = ((np.asarray(start, dtype=float) - at.mean) / at.std)[None]
        centres = lloyd(kept, features, at, sets, rounds)[0].tolist()
    return dict(zip(features.names, zip(at.mean.tolist(), at.std.tolist()))), centres
