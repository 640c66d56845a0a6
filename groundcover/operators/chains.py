"""Chains of neighbourhood operators on stored tiles: one halo for the whole chain.

A chain names its planes: bands of the tile, and steps that make planes from planes. The halo of an output is the
longest sum of radii on the way to it, so tiles get their border once and every step runs inside a task; steps that
no output needs do not run. Values of a whole raster (extremes, percentiles) come from first passes over the same
tiles, which give counts only, and are attached to the tiles. No pixel is a row but in ``chain_pixels``, whose result is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .stats import attach_by, ordered_bits, radix_percentile
from .tiles import TILE_COLUMNS, padded_tiles
from ..schema import TILE

BY = ["raster_id"]


@dataclass(frozen=True)
class Step:
    """Planes ``out`` from planes and raster values ``needs``, handed to ``fn`` in that order.

    ``fn`` gives one array, or a tuple of as many as ``out`` names. A cell may depend on cells up to ``radius`` away.
    """

    out: str | tuple[str, ...]
    needs: tuple[str, ...]
    fn: Callable
    radius: int = 0

    @property
    def names(self) -> tuple[str, ...]:
        return (self.out,) if isinstance(self.out, str) else self.out


@dataclass(frozen=True)
class Scalar:
    """A value of each raster: the percentile ``prob`` of all values of ``planes`` together, interpolated; 0 and 1 are the extremes."""

    name: str
    planes: tuple[str, ...]
    prob: float


@dataclass(frozen=True)
class Chain:
    """Bands in the order of the tile, steps and raster values in an order that puts each after what it needs.

    Where the band ``covered`` is zero there is no pixel: all bands read zero there, and nothing is counted.
    """

    bands: tuple[str, ...]
    steps: tuple[Step, ...] = ()
    scalars: tuple[Scalar, ...] = ()
    covered: str | None = None

    def _maker(self) -> dict[str, Step | Scalar]:
        made: dict[str, Step | Scalar] = {n: s for s in self.steps for n in s.names}
        return made | {s.name: s for s in self.scalars}

    def required(self, outputs) -> set[str]:
        """Names of all planes and raster values on the way to the outputs."""
        made, todo, seen = self._maker(), list(outputs), set()
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            if name not in made and name not in self.bands:
                raise ValueError(f"nothing makes the plane {name!r}")
            if name in made:
                by = made[name]
                todo += by.needs if isinstance(by, Step) else by.planes
        return seen

    def radius(self, outputs) -> int:
        """The halo of the outputs, and of the raster values they need."""
        reach = dict.fromkeys(self.bands, 0) | {s.name: 0 for s in self.scalars}
        for s in self.steps:
            reach |= dict.fromkeys(s.names, s.radius + max((reach[n] for n in s.needs), default=0))
        return max((reach[n] for n in self.required(outputs)), default=0)

    def run(self, canvas: np.ndarray, outputs, values: dict[str, float]) -> dict[str, np.ndarray]:
        """Planes of a padded canvas. ``values`` are the raster values; what needs none of the outputs is left out."""
        held = dict(zip(self.bands, canvas))
        if self.covered:
            there = held[self.covered] > 0
            held = {n: np.where(there, a, 0).astype(a.dtype) for n, a in held.items()}
        wanted, todo = set(outputs), self._needed_steps(outputs)
        for s in todo:
            got = s.fn(*[held[n] if n in held else values[n] for n in s.needs])
            held |= dict(zip(s.names, (got,) if isinstance(s.out, str) else got))
        return {n: held[n] for n in wanted}

    def _needed_steps(self, outputs) -> list[Step]:
        need, todo = set(outputs), []
        for s in reversed(self.steps):
            if need & set(s.names):
                todo.append(s)
                need |= set(s.needs)
        return todo[::-1]


def prepared(tiles: DataFrame, chain: Chain, outputs, tile: int) -> DataFrame:
    """Tiles with the halo that the outputs need and the raster values among what they need; one shuffle of tiles."""
    outputs = list(outputs)
    held = cut_lineage(padded_tiles(tiles, chain.radius(outputs), tile))
    need = chain.required(outputs)
    for s in chain.scalars:
        if s.name in need:
            held = attach_by(held, _value(held, chain, s), BY)
    return held


def _values(t, chain: Chain) -> dict[str, float]:
    return {s.name: getattr(t, s.name) for s in chain.scalars if hasattr(t, s.name)}


def _planes(t, chain: Chain, outputs) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The outputs at a tile's own pixels, and which of its cells are pixels."""
    canvas = np.frombuffer(t.data, dtype=np.uint8).reshape(t.n_bands, t.pad_h, t.pad_w)
    core = (slice(t.row0 - t.y0, t.row0 - t.y0 + t.h), slice(t.col0 - t.x0, t.col0 - t.x0 + t.w))
    got = chain.run(canvas, outputs, _values(t, chain))
    there = canvas[chain.bands.index(chain.covered)][core] > 0 if chain.covered else np.ones((t.h, t.w), dtype=bool)
    return {n: a[core] for n, a in got.items()}, there


def _over(held: DataFrame, chain: Chain, outputs, schema: str, of_tile: Callable) -> DataFrame:
    """Rows that ``of_tile(tile, planes, there)`` gives as a frame, tile by tile."""
    outputs = list(outputs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                yield of_tile(t, *_planes(t, chain, outputs))

    return held.mapInPandas(run, schema)


def _value(held: DataFrame, chain: Chain, s: Scalar) -> DataFrame:
    """One row per raster with the value of a scalar."""
    if s.prob in (0.0, 1.0):
        def ends(t, planes, there):
            v = np.concatenate([planes[n][there] for n in s.planes])
            return pd.DataFrame({"raster_id": [t.raster_id], "lo": [float(v.min())], "hi": [float(v.max())]} if len(v) else
                                {"raster_id": [], "lo": [], "hi": []})
        spans = _over(held, chain, s.planes, "raster_id string, lo double, hi double", ends)
        return spans.groupBy(*BY).agg((F.max("hi") if s.prob else F.min("lo")).alias(s.name))
    if set(s.planes) <= set(chain.bands):
        def bytes_of(t, planes, there):
            n = sum(np.bincount(planes[p][there], minlength=256) for p in s.planes)
            v = np.flatnonzero(n)
            return pd.DataFrame({"raster_id": t.raster_id, "v": v, "n": n[v]})
        counted = _over(held, chain, s.planes, "raster_id string, v int, n long", bytes_of)
        counted = counted.groupBy(*BY, "v").agg(F.sum("n").alias("n"))  # at most 256 rows a raster
        return counted.groupBy(*BY).agg(F.percentile("v", F.lit(s.prob), F.col("n")).alias(s.name))

    def counts(state: DataFrame | None, before: int, shift: int) -> DataFrame:
        narrowed = state is not None
        near = held if not narrowed else attach_by(held, state.select(*BY, F.col("_q0").alias("q0"), F.col("_q1").alias("q1")), BY)

        def bins(t, planes, there):
            key = ordered_bits(np.concatenate([planes[n][there] for n in s.planes]))
            if narrowed:
                prefix = key >> before
                key = key[(prefix == t.q0) | (prefix == t.q1)]
            q, c = np.unique(key >> shift, return_counts=True)
            return pd.DataFrame({"raster_id": t.raster_id, "_q": q, "_c": c})

        got = _over(near, chain, s.planes, "raster_id string, _q long, _c long", bins)
        return got.groupBy(*BY, "_q").agg(F.sum("_c").alias("_c"))

    return radix_percentile(counts, s.prob, BY, s.name)


def chain_pixels(held: DataFrame, chain: Chain, outputs: dict[str, str]) -> DataFrame:
    """Pixel rows with the outputs, for results that ask for them; ``outputs`` maps planes to types. No shuffle."""
    def rows(t, planes, there):
        row, col = np.nonzero(there)
        out = {"raster_id": t.raster_id, "row": row + t.row0, "col": col + t.col0}
        return pd.DataFrame(out | {n: planes[n][there] for n in outputs})

    return _over(held, chain, outputs, "raster_id string, row int, col int, " + ", ".join(f"{n} {k}" for n, k in outputs.items()), rows)


def chain_tiles(held: DataFrame, chain: Chain, outputs) -> DataFrame:
    """Byte tiles of the outputs in their order, zero where there is no pixel. No shuffle."""
    outputs = list(outputs)

    def tile(t, planes, there):
        block = np.stack([np.where(there, planes[n], 0).astype(np.uint8) for n in outputs])
        return pd.DataFrame([(t.raster_id, t.tile_row, t.tile_col, t.row0, t.col0, t.h, t.w, t.raster_h, t.raster_w,
                              len(outputs), block.tobytes())], columns=TILE_COLUMNS)

    return _over(held, chain, outputs, TILE, tile)


def chain_counts(held: DataFrame, chain: Chain, key: str, flags) -> DataFrame:
    """Pixels (``n``) and set flags of every value of a byte plane; counts combine inside tiles and tasks."""
    flags = list(flags)

    def of_tile(t, planes, there):
        at = planes[key][there].astype(np.int64)
        n = np.bincount(at)
        v = np.flatnonzero(n)
        sums = {f: np.bincount(at, weights=planes[f][there], minlength=len(n))[v].astype(np.int64) for f in flags}
        return pd.DataFrame({"raster_id": t.raster_id, key: v, "n": n[v]} | sums)

    schema = f"raster_id string, {key} int, n long, " + ", ".join(f"{f} long" for f in flags)
    return _over(held, chain, [key, *flags], schema, of_tile).groupBy(*BY, key).agg(
        F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in flags])
