"""Exact quantiles, ordered numbering and exact-size samples without a single-task step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..session import cut_lineage


def int_percentiles(df: DataFrame, value: Column, probs: dict[str, float], by: list[str]) -> DataFrame:
    """Exact interpolated percentiles of integer bands (at most a few hundred values).

    Values are counted first, so the percentile step sees one row per distinct
    value however many pixels hold it.
    """
    counted = df.select(*by, value.alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(
        *[F.percentile("_v", F.lit(p), F.col("_n")).alias(name) for name, p in probs.items()])


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: their bits, with those of negative numbers turned round."""
    b = (np.asarray(v, dtype=np.float64) + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, dtype=np.int64)
    return (k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


@F.pandas_udf(LongType())
def _to_bits(v: pd.Series) -> pd.Series:
    return pd.Series(ordered_bits(v.to_numpy()))


@F.pandas_udf(DoubleType())
def _to_double(k: pd.Series) -> pd.Series:
    return pd.Series(from_bits(k.to_numpy()))


#: Bits that a pass settles, and the number of values at most that a pass may tell apart at once.
DIGIT, FEW_VALUES = 16, 1 << 16


def radix_percentile(counts: Callable[[DataFrame | None, int, int], DataFrame], prob: float, by: list[str],
                     name: str) -> DataFrame:
    """Exact interpolated percentile by radix selection on ordered bits, one row per group.

    ``counts(state, before, shift)`` counts values by the bits from ``shift`` on (columns ``_q``, ``_c``); without a state all
    values, else those whose bits from ``before`` on are ``_q0`` or ``_q1`` of their group's row in it. A pass sees at most two to
    the sixteenth bins for either rank, whatever the values; as soon as no more values than that are left in the two bins, the
    next pass is the last. No task holds the values of a bin.
    """
    state, before, shift = None, 64, 64 - DIGIT
    while True:
        hist = counts(state, before, shift)
        if state is None:
            pos = (F.sum("_c").over(W.partitionBy(*by)) - 1) * F.lit(float(prob))
            hist = hist.withColumn("_pos", pos).select(
                *by, "_q", "_c", F.lit(0).alias("_p"), F.lit(0).alias("_q0"), F.lit(0).alias("_q1"), F.floor("_pos").alias("_k0"),
                F.ceil("_pos").alias("_k1"), (F.col("_pos") - F.floor("_pos")).alias("_t"))
        else:
            hist = attach_by(hist, state, by).withColumn("_p", F.shiftright("_q", before - shift))
        run = W.partitionBy(*by, "_p").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("_at", F.coalesce(F.sum("_c").over(run), F.lit(0)))
        found = []
        for i in "01":
            here = (F.col("_p") == F.col(f"_q{i}")) & (F.col("_at") <= F.col(f"_k{i}")) & (F.col(f"_k{i}") < F.col("_at") + F.col("_c"))
            found += [F.max(F.when(here, c)).alias(n) for c, n in (
                (F.col("_q"), f"_q{i}"), (F.col(f"_k{i}") - F.col("_at"), f"_k{i}"), (F.col("_c"), f"_c{i}"))]
        state = cut_lineage(hist.groupBy(*by).agg(*found, F.max("_t").alias("_t")))
        most = state.agg(F.max(F.greatest("_c0", "_c1"))).first()[0]
        state = state.drop("_c0", "_c1")
        if shift == 0 or most is None:
            break
        before, shift = shift, 0 if most <= FEW_VALUES else shift - DIGIT
    ends = state.select(*by, "_t", *[F.when(F.col(c).isNotNull(), _to_double(F.coalesce(c, F.lit(0)))).alias(n)
                                     for c, n in (("_q0", "_a"), ("_q1", "_z"))])
    return ends.select(*by, F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_t")).alias(name))


def float_percentile(df: DataFrame, value: str, prob: float, by: list[str], name: str) -> DataFrame:
    """Exact interpolated percentile of a continuous column, one row per group; nulls do not count.

    Two to four passes over ``df``, each a count by at most sixteen bits of the value.
    """
    known = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    src = known.select(*by, _to_bits("_v").alias("_k"))

    def counts(state: DataFrame | None, before: int, shift: int) -> DataFrame:
        near = src
        if state is not None:
            prefix = F.shiftright("_k", before)
            near = attach_by(src, state.select(*by, "_q0", "_q1"), by).filter(
                (prefix == F.col("_q0")) | (prefix == F.col("_q1")))
        return near.groupBy(*by, F.shiftright("_k", shift).alias("_q")).agg(F.count("*").alias("_c"))

    return radix_percentile(counts, prob, by, name)


def ordered_index(df: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """Zero-based position of every row in a total order.

    A range-partitioned sort numbers rows within each partition; the counts of
    the partitions, one row each, give the offsets. The sorted rows are written
    to the checkpoint folder so both reads see the same partitions.
    """
    laid = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_seq", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    fixed = cut_lineage(laid)
    sizes = fixed.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row per partition of the sort, so the broadcast is bounded by the task count
    return fixed.join(F.broadcast(starts), "_pid").withColumn(
        name, F.col("_start") + F.col("_seq")).drop("_pid", "_seq", "_start")


HASH_DIGITS = 12


def drawn(*parts: Column | str) -> Column:
    """A 48-bit number drawn from the parts by MD5: the same in any SQL engine."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def sample_hash(row: str, col: str, seed: int = 42, raster: str | None = "raster_id") -> Column:
    """Hash of a pixel from its raster, its position and the seed."""
    return drawn(*([raster] if raster else []), row, col, F.lit(seed))


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    value = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return df.withColumn("_one", value).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def join_large(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the pixels, by shuffle and merge.

    Spark takes exploded rows and rows from Python to be no more than what they were made of, and would send such
    a side, millions of rows, through the driver to all tasks.
    """
    return left.join(right.hint("merge"), on, how)


BROADCAST_ROWS = 100_000
SALTS = 32


def attach_by(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Left-join one row of values per group; without group columns the frame has one row.

    The small side is broadcast only after it proved to hold at most
    ``BROADCAST_ROWS`` rows. Beyond that both sides are salted, so a group that
    holds most rows of ``df`` is still spread over many tasks.
    """
    if not by:
        return attach_scalar(df, small)
    extra = [c for c in small.columns if c not in by]
    rows = small.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        left = df
        right = F.broadcast(df.sparkSession.createDataFrame(rows, small.schema))
        keys = by
    else:
        left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = [*by, "_salt"]
    on = [F.col(f"_s.{c}").eqNullSafe(F.col(f"_k.{c}")) for c in keys]
    return left.alias("_s").join(right.alias("_k"), on, "left").select(
        *[F.col(f"_s.{c}") for c in df.columns], *[F.col(f"_k.{c}") for c in extra])


def take_lowest(df: DataFrame, n, order: Column, tie: list[str], by: list[str],
                keys: DataFrame | None = None) -> DataFrame:
    """Exactly ``n`` rows per group, those with the lowest ``order`` then ``tie``.

    ``order`` is a whole number below 2 ** 48. Counts by its upper 16 bits find the
    bucket where the budget runs out, counts by the next 16 bits refine that bucket
    alone, then single values; rows below the last value are kept outright and only
    the rows of that single value are ranked, so a group holding most rows is not
    sorted in one task. Running sums are over at most 65,536 rows per group.

    ``keys`` may name a cheaper frame with the same rows (group, order and tie
    columns) for the counting passes, when ``df`` is costly to compute.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    src = df.withColumn("_h", order)
    near = (keys if keys is not None else df).select(*by, order.alias("_h"))

    def crossing(rows: DataFrame, key: str, start: Column) -> DataFrame:
        run = W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("_before", start + F.coalesce(F.sum("_c").over(run), F.lit(0)))
        return rows.filter((F.col("_before") < n) & (F.col("_before") + F.col("_c") >= n))

    start = F.lit(0)
    for bits in (32, 16):
        near = near.withColumn("_q", F.shiftright("_h", bits))
        found = crossing(near.groupBy(*by, "_q", *(["_cb"] if bits == 16 else [])).agg(F.count("*").alias("_c")), "_q", start)
        found = found.select(*by, F.col("_q").alias("_cq"), F.col("_before").alias("_cb"))
        near = attach_by(near.select(*by, "_h", "_q"), found, by).filter(F.col("_q") == F.col("_cq")).select(*by, "_h", "_cb")
        start = F.col("_cb")
    fine = near.groupBy(*by, "_h", "_cb").agg(F.count("*").alias("_c"))
    cut = crossing(fine, "_h", start).select(
        *by, F.col("_h").alias("_cut"), (n - F.col("_before")).alias("_left"))
    marked = attach_by(src, cut, by).filter(n > 0)
    whole = marked.filter(F.col("_cut").isNull() | (F.col("_h") < F.col("_cut"))).select(*df.columns)
    rank = W.partitionBy(*by).orderBy(*tie)
    edge = marked.filter(F.col("_h") == F.col("_cut")).withColumn("_rk", F.row_number().over(rank))
    return whole.unionByName(edge.filter(F.col("_rk") <= F.col("_left")).select(*df.columns))


def linspace_index(n, samples: int) -> Column:
    """Array of evenly spaced positions 0..n-1, both ends included, rounded down."""
    n = n if isinstance(n, Column) else F.lit(n)
    last = (n - 1).cast("double")
    if samples == 1:
        return F.array(F.lit(0).cast("long"))
    step = last / F.lit(float(samples - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)),
                       lambda i: F.when(i == samples - 1, last).otherwise(i * step).cast("long"))
