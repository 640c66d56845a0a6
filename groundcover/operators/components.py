"""Connected components of masks that span many tiles.

Tiles are labelled on their own; components that meet across a tile border
become edges of a small graph, contracted with alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014). The rounds grow with the logarithm of the graph, not with
its diameter, and each ends in a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import kernels as K
from .stats import join_large
from .tiles import column

#: Links up to which one small step is enough, and the part of all links that makes a node a hub.
FEW_EDGES, HUB_SHARE = 20_000, 2_048
MAX_ROUNDS = 60


def _node(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("long"), 31) + col.cast("long")


def _tile_labels(mask: DataFrame, by: list[str], tile: int, connectivity: int) -> DataFrame:
    """Pixels with the id of their component inside one tile."""
    keyed = mask.select(*by, "row", "col", F.floor(F.col("row") / tile).cast("int").alias("_tr"),
                        F.floor(F.col("col") / tile).cast("int").alias("_tc"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row, col = column(table, "row"), column(table, "col")
        r0, c0 = row.min(), col.min()
        w = col.max() - c0 + 1
        m = np.zeros((row.max() - r0 + 1, w), dtype=bool)
        m[row - r0, col - c0] = True
        lab = K.label(m, connectivity)[row - r0, col - c0].astype(np.int64)
        node = ((lab // w + r0) << 31) + lab % w + c0
        return pa.table({**{c: pa.repeat(k, len(row)) for c, k in zip(by, key)},
                         "row": pa.array(row), "col": pa.array(col), "node": pa.array(node)})

    types = dict(mask.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "row int, col int, node long"
    return keyed.groupBy(*by, "_tr", "_tc").applyInArrow(run, schema)


def _border_edges(labels: DataFrame, by: list[str], tile: int, connectivity: int) -> DataFrame:
    """Pairs of tile components that touch across a border."""
    r, c = F.pmod(F.col("row"), F.lit(tile)), F.pmod(F.col("col"), F.lit(tile))
    rim = labels.filter((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    cross = F.array(*[F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"))
                      for dy, dx in steps])
    tr, tc = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    away = rim.select(*by, "node", tr.alias("_tr"), tc.alias("_tc"), F.explode(cross).alias("q")).filter(
        (F.floor(F.col("q.row") / tile) != F.col("_tr")) | (F.floor(F.col("q.col") / tile) != F.col("_tc")))
    away = away.select(*by, F.col("q.row").alias("row"), F.col("q.col").alias("col"), F.col("node").alias("u"))
    return join_large(away, rim.withColumnRenamed("node", "v"), [*by, "row", "col"]).select(*by, "u", "v").distinct()


def _with_min(edges: DataFrame, key: list[str], n_edges: int) -> DataFrame:
    """Edges with ``m``, the lowest neighbour of their first node.

    The minimum is aggregated, which combines before the shuffle, and joined back. A hub is a node with more than the ``HUB_SHARE``-th part of all links, so there are
    fewer hubs than twice that number, whatever the graph: their minima are broadcast, their links stay where they
    are, and no task of the other join gets more than that part of the links by one node.
    """
    limit = max(1, n_edges // HUB_SHARE)
    mins = edges.groupBy(*key).agg(F.min("v").alias("m"), F.count("*").alias("_deg"))
    hubs = mins.filter(F.col("_deg") > limit).drop("_deg")
    light = edges.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(mins.filter(F.col("_deg") <= limit).drop("_deg"), key)
    return light.unionByName(edges.join(F.broadcast(hubs), key))


def _few_roots(edges: DataFrame, by: list[str]) -> DataFrame:
    """``contract`` for at most ``FEW_EDGES`` links, in one step: rounds over so few rows are nearly all overhead."""
    types = dict(edges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = table.select(by).to_pandas()
        group = keys.groupby(by, dropna=False).ngroup().to_numpy() if by else np.zeros(table.num_rows, dtype=np.int64)
        ends = np.concatenate([np.column_stack([group, column(table, c)]) for c in "uv"])
        nodes, at = np.unique(ends, axis=0, return_inverse=True)
        u, v = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[u] != root[v]).any():
            ru, rv = root[u], root[v]
            np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
            while (root[root] != root).any():
                root = root[root]
        one = np.flatnonzero(root != np.arange(len(nodes)))
        first = pd.Series(np.arange(len(group))).groupby(group).first().to_numpy()[nodes[one, 0]]
        named = [table.column(c).combine_chunks().take(pa.array(first)) for c in by]
        yield pa.RecordBatch.from_arrays([*named, pa.array(nodes[one, 1]), pa.array(nodes[root[one], 1])], [*by, "node", "root"])

    schema = "".join(f"{c} {types[c]}, " for c in by) + "node long, root long"
    return cut_lineage(edges.select(*by, F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, schema))


def contract(edges: DataFrame, by: list[str], dealt: Callable[[DataFrame], DataFrame] = lambda links: links) -> DataFrame:
    """Map every node of the edge list to the lowest node of its component; ``dealt`` may lay links out in fewer tasks."""

    def fingerprint(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first())

    cur = cut_lineage(dealt(edges.filter("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    seen = fingerprint(cur)
    if not seen[0]:
        return cur.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    if seen[0] <= FEW_EDGES:
        return _few_roots(cur, by)
    key = [*by, "u"]
    for _ in range(MAX_ROUNDS):
        both = cur.unionByName(cur.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_min(both, key, 2 * seen[0]).withColumn("m", F.least("m", "u"))
        large = near.filter("v > u AND v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _with_min(large, key, 2 * seen[0])  # v < u on every edge here
        small = near.select(*by, F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                   F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = cut_lineage(dealt(small.select(*by, "e.u", "e.v").filter("u <> v").distinct()))
        now = fingerprint(cur)
        if now == seen:
            return cur.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("component contraction did not finish")


def label_components(mask: DataFrame, by: list[str] | None = None, tile: int = 512,
                     connectivity: int = 8, with_node: bool = False) -> DataFrame:
    """Set pixels with ``comp``, the lowest row-major position of their component.

    ``with_node`` adds ``node``, the part of the component inside one tile.
    """
    by = by or ["raster_id"]
    labels = cut_lineage(_tile_labels(mask, by, tile, connectivity))
    roots = contract(_border_edges(labels, by, tile, connectivity), by)
    out = labels.join(roots, [*by, "node"], "left")
    return out.select(*by, "row", "col", F.coalesce("root", "node").alias("comp"), *(["node"] if with_node else []))


def of_components(labels: DataFrame, wanted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pixels of the wanted components; ``labels`` come with ``node``.

    Components are matched by their parts and pixels by the part they lie in, which is
    no larger than a tile, so a component that holds most pixels is not a hot key.
    """
    by = by or ["raster_id"]
    parts = labels.select(*by, "comp", "node").distinct()
    inside = parts.join(wanted.select(*by, "comp"), [*by, "comp"], "left_semi").select(*by, "node")
    return labels.join(inside, [*by, "node"], "left_semi").drop("node")


def component_stats(labels: DataFrame, by: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    by = by or ["raster_id"]
    return labels.groupBy(*by, "comp").agg(
        F.count("*").alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"),
        F.min("col").alias("col0"), F.max("col").alias("col1"), *(extra or [])).withColumn(
        "bh", F.col("row1") - F.col("row0") + 1).withColumn("bw", F.col("col1") - F.col("col0") + 1).withColumn(
        "aspect", F.greatest("bh", "bw") / F.least("bh", "bw")).withColumn(
        "fill", F.col("area") / (F.col("bh") * F.col("bw")))


def elongated_score(stats: DataFrame, by: list[str]) -> DataFrame:
    """Road-like continuity: share of area in thin components."""
    thin = (F.col("area") >= 28) & (F.col("aspect") >= 3.0) & (F.col("fill") <= 0.78)
    total = F.sum("area")
    score = F.least(F.lit(1.0), F.sum(F.when(thin, F.col("area")).otherwise(0)) / total * 1.4)
    return stats.groupBy(*by).agg(F.when(total < 80, F.lit(0.0)).otherwise(score).alias("continuity"))


def compact_score(stats: DataFrame, by: list[str]) -> DataFrame:
    """Water-like continuity: dominance of the largest plus share of compact components."""
    big = F.col("area") >= 40
    compact = big & (F.col("fill") >= 0.38) & (F.col("aspect") <= 3.5)
    total = F.sum("area")
    main = F.coalesce(F.max(F.when(big, F.col("area"))), F.lit(0)) / total
    share = F.sum(F.when(compact, F.col("area")).otherwise(0)) / total
    score = F.least(F.lit(1.0), F.lit(0.55) * main + F.lit(0.45) * share)
    return stats.groupBy(*by).agg(F.when(total < 120, F.lit(0.0)).otherwise(score).alias("water_continuity"))


def vetoed_components(labels: DataFrame, incompatible: DataFrame, threshold: Column | float,
                      by: list[str] | None = None) -> DataFrame:
    """Component share of incompatible pixels and whether it vetoes the component."""
    by = by or ["raster_id"]
    hit = incompatible.select(*by, "row", "col", F.lit(1).alias("_bad"))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return labels.join(hit, [*by, "row", "col"], "left").groupBy(*by, "comp").agg(
        F.count("*").alias("area"), F.count("_bad").alias("bad")).withColumn(
        "share", F.col("bad") / F.col("area")).withColumn("vetoed", F.col("share") >= limit)


def fill_holes(mask: DataFrame, background: DataFrame, height: Column, width: Column,
               by: list[str] | None = None, tile: int = 512) -> DataFrame:
    """Add background components that do not reach the raster edge."""
    by = by or ["raster_id"]
    keep = background.select(*by, "row", "col", (
        (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    ).alias("_edge"))
    lab = label_components(background, by, tile, 4, with_node=True)
    inner = lab.join(keep, [*by, "row", "col"]).groupBy(*by, "comp").agg(F.max("_edge").alias("_edge")).filter(~F.col("_edge"))
    holes = of_components(lab, inner, by)
    return mask.select(*by, "row", "col").unionByName(holes.select(*by, "row", "col"))
