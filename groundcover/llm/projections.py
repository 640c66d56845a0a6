"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random lines. On one line, two vectors collide
when one lies in a window centred on the other; the number of lines on which a pair
collides grows with its cosine, and pairs that collide less often than a pair at
the threshold would, but for a set probability, are left out. The rest is verified
by the cosine in double precision.

Lines are sorted in bounded ranges. Vectors meet in cells: those on the same side of
several other lines share one, and this is repeated with new lines until a pair at the
threshold shares a cell but for a set probability. Lines per cell grow with the logarithm
of the number of vectors, so cells stay small whatever the size. In a cell every line is
sorted, a vector's window is two bounds in the sorted line, and collisions are added up
per pair. A place on a line is one byte, and only these bytes travel to the cells; vectors
follow for members of pairs that reach the count. Cells with more vectors than a task
takes, as large groups of near copies make them, are compared block by block.
A pair that meets several times is counted where it meets first. Links are counted
and connected where they are found, so no group is expanded into its pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with
nothing; vectors of different length never link; equal vectors are one with a
number of copies; rows that share an id are one vector, their links add up; a null
id links with nothing and is kept. Only the columns named in ``near_vectors`` come back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import contract
from ..session import cut_lineage
from .blocks import block_pairs, grouped, sorted_groups
from .common import if_few, join_counted
from .memory import tidy
from .store import written

#: Lines on which collisions are counted, and the window in units of the distance at the threshold.
LINES, WINDOW = 64, 1.0
MISS_CELL, MISS_COUNT = 0.01, 0.001
CELL, BLOCK = 256, 1024
#: A place on a line is one byte: steps per unit, and the place of zero. Places beyond the ends are at the ends.
STEPS, ZERO = 32, 128


def needed_collisions(lines: int = LINES, window: float = WINDOW, miss: float = MISS_COUNT) -> int:
    """The count that a pair at the threshold reaches but for probability ``miss``."""
    p = 2 * NormalDist().cdf(window) - 1
    below = 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * p ** c * (1 - p) ** (lines - c)
        if below > miss:
            return c
    return lines


def cell_plan(n: int, cosine: float) -> tuple[int, int]:
    """Sides per cell and repetitions for n vectors."""
    sides = max(1, math.ceil(math.log2(max(n, 2) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** sides
    return sides, math.ceil(math.log(MISS_CELL) / math.log(1 - same))


def _lines(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, n]).standard_normal((dim, n))


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, sides: int, repeats: int) -> np.ndarray:
    """Cell names, one row per vector and one column per repetition."""
    bits = (x @ _lines(1, x.shape[1], sides * repeats) >= 0).reshape(len(x), repeats, sides)
    code = (bits * (1 << np.arange(sides, dtype=np.int64))).sum(axis=2)
    return ((code * repeats + np.arange(repeats)) << 16) + x.shape[1] % (1 << 16)


def prepare(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, key, vector) with the numbers of usable vectors as bytes; key and vector are null for others."""
    dtype = "<f8" if "double" in dict(df.dtypes)[vector_col] else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, keys = [], []
            for v in b.column(1):
                # a null number becomes a non-finite one
                x = np.array(v.as_py() if v.is_valid else [], dtype=np.float64).astype(dtype)
                raw = x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None
                vectors.append(raw)
                keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
                                             ["id", "key", "vector"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col))
    return rows.mapInArrow(run, "id long, key binary, vector binary"), dtype


def _by_size(column: pa.Array) -> list[np.ndarray]:
    sizes = np.array([len(v) for v in column.to_pylist()])
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def encode(sets: DataFrame, dtype: str, sides: int, repeats: int) -> DataFrame:
    """Adds ``code``, a byte per line, and ``cells``, a name per repetition."""
    types = dict(sets.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _by_size(b.column(b.schema.get_field_index("vector"))):  # vectors of one length at a time
                part = b.take(pa.array(rows))
                x = _matrix(part.column(part.schema.get_field_index("vector")), dtype)
                places = np.clip(np.floor(x @ _lines(2, x.shape[1], LINES) * STEPS) + ZERO, 0, 255).astype(np.uint8)
                names = _cells(x, sides, repeats)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * repeats),
                                                 pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([p.tobytes() for p in places], pa.binary()), cells],
                    [*part.schema.names, "code", "cells"])

    schema = ", ".join(f"{c} {types[c]}" for c in sets.columns) + ", code binary, cells array<long>"
    return sets.mapInArrow(tidy(run), schema)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), LINES)


def collisions(codes: np.ndarray, half: int) -> np.ndarray:
    """How often each vector (column) lies in the window around each other one (row), over all lines."""
    n = len(codes)
    at = np.uint16 if n < 1 << 16 else np.uint32
    order, place = np.argsort(codes, axis=0, kind="stable"), np.empty((n, LINES), dtype=at)
    np.put_along_axis(place, order, np.arange(n, dtype=at)[:, None], axis=0)
    # how many lie below each place of a line gives the bounds of a window in the sorted line
    cells, lines = codes.astype(np.int64), np.arange(LINES)
    below = np.zeros((LINES, 257), dtype=at)
    np.cumsum(np.bincount((lines * 256 + cells).ravel(), minlength=LINES * 256).reshape(LINES, 256), axis=1, out=below[:, 1:])
    first = below[lines, np.maximum(cells - half, 0)]
    width = below[lines, np.minimum(cells + half, 255) + 1] - first
    place, first, width = (np.ascontiguousarray(x.T) for x in (place, first, width))
    counts, past, inside = np.zeros((n, n), dtype=np.uint8), np.empty((n, n), dtype=at), np.empty((n, n), dtype=bool)
    for p, f, w in zip(place, first, width):
        # unsigned: places before the first wrap round and lie beyond the width
        np.less(np.subtract(p[None, :], f[:, None], out=past), w[:, None], out=inside)
        np.add(counts, inside.view(np.uint8), out=counts)
    return counts


def _half(cosine: float) -> int:
    """The window in steps, rounded up, so that rounding places loses no collision."""
    return math.ceil(WINDOW * math.sqrt(2 - 2 * cosine) * STEPS)


def passing(members: DataFrame, cosine: float) -> DataFrame:
    """The members (group, rep, _own, _across, repeat) of pairs that collide often enough, from rows with ``code``."""
    least, half = needed_collisions(), _half(cosine)
    out = ["group", "rep", "_own", "_across", "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, "group"):
            codes, own = _codes(table.column("code").combine_chunks()), table.column("_own").to_numpy()
            two, some = table.column("_across").to_pylist(), np.zeros(len(table), dtype=bool)
            for a, b in zip(at[:-1], at[1:]):
                if b - a == 1:
                    continue
                near = collisions(codes[a:b], half) >= least
                np.fill_diagonal(near, False)
                if two[a]:
                    near &= own[a:b, None] != own[None, a:b]
                some[a:b] = near.any(axis=1)
            yield from table.select(out).filter(pa.array(some)).to_batches()

    return sorted_groups(members, run, "group long, rep long, _own int, _across boolean, repeat int")


def links(members: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """(u, v, n): n links of u found in a group where v is null, else a link that connects."""
    least, half = needed_collisions(), _half(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, "group"):
            rep, own, copies, repeat = (table.column(c).to_numpy() for c in ("rep", "_own", "copies", "repeat"))
            two, codes = table.column("_across").to_pylist(), _codes(table.column("code").combine_chunks())
            vector, cells = (table.column(c).combine_chunks() for c in ("vector", "cells"))
            out = ([], [], [])
            for a, b in zip(at[:-1], at[1:]):
                x, part = _matrix(vector.slice(a, b - a), dtype), np.arange(b - a)
                names = cells.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)[:, :repeat[a]]
                near, found = collisions(codes[a:b], half) >= least, np.zeros(b - a, dtype=np.int64)
                for i in range(b - a - 1):
                    j = i + 1 + np.flatnonzero(near[i, i + 1:])
                    if two[a]:
                        j = j[own[a + j] != own[a + i]]
                    # met in an earlier repetition: counted there
                    j = j[~(names[j] == names[i]).any(axis=1)]
                    j = j[x[j] @ x[i] >= cosine]
                    if not len(j):
                        continue
                    found[i] += copies[a + j].sum()
                    found[j] += copies[a + i]
                    # one link to each part that is not yet connected with this one
                    others, first = np.unique(part[j], return_index=True)
                    new = others != part[i]
                    out[0].extend([int(rep[a + i])] * int(new.sum()))
                    out[1].extend(rep[a + j[first[new]]].tolist())
                    out[2].extend([0] * int(new.sum()))
                    if new.any():
                        part[np.isin(part, others[new])] = part[i]
                some = np.flatnonzero(found)
                out[0].extend(rep[a + some].tolist())
                out[1].extend([None] * len(some))
                out[2].extend(found[some].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "n"])

    return sorted_groups(members, run, "u long, v long, n long")


def routed(sets: DataFrame) -> DataFrame:
    """One row per vector, repetition and pair of blocks: (group, rep, _own, _across, repeat, code).

    Only sizes of cells that need several blocks are joined; others are one block each.
    """
    rows = sets.select("rep", "code", F.posexplode("cells").alias("repeat", "cell"))
    sizes = sets.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size"))
    crowded = cut_lineage(sizes.filter(F.col("size") > BLOCK))
    rows = rows.join(if_few(crowded), "cell", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    return block_pairs(rows, ["cell"], "size", "rep", BLOCK).select("group", "rep", "_own", "_across", "repeat", "code")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of ``df``: (id, n_links, component_id, kept).

    ``n_links`` counts the other vectors within the cosine, copies included; a component
    is named by its smallest id, and that row is kept.
    """
    prepared, dtype = prepare(df, id_col, vector_col)
    rows = written(prepared, "vectors")
    usable = rows.filter("key IS NOT NULL AND id IS NOT NULL")
    sides, repeats = cell_plan(usable.count(), cosine)
    sets = usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    sets = written(encode(sets, dtype, sides, repeats), "vector-sets")
    pairs = written(passing(routed(sets), cosine), "passing")
    # vectors are moved for members of passing pairs only
    chosen = sets.select("rep", "copies", "vector", "code", "cells").join(
        if_few(pairs.select("rep").distinct()), "rep", "left_semi")
    found = written(links(pairs.join(chosen, "rep"), dtype, cosine), "links")
    roots = contract(found.filter("v IS NOT NULL").select("u", "v"), [])
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    named = sets.select("key", "rep", "copies").join(counts, "rep", "left").join(
        roots.withColumnsRenamed({"node": "rep", "root": "component"}), "rep", "left")
    named = cut_lineage(named.select("key", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                     F.coalesce("component", "rep").alias("component_id")))
    out = join_counted(usable.select("id", "key"), named, ["key"], "copies").select("id", "n_links", "component_id")
    rest = rows.filter("key IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"),
                                                           F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id",
                                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
