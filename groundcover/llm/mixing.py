"""Mixing sources to target weights by hash thresholds.

Every row draws a 48-bit number from its id. Sizes are summed by source and hash
bucket; the bucket where a source's running sum crosses its budget is refined
twice more, to single numbers, and a row is taken when its number lies below its
source's threshold. Budgets are nested: a smaller budget takes a subset. Nothing
is sorted by row; a source with most of the rows is split over its buckets.

Defined cases: rows without a size count zero and are never taken; a null source
is a source of its own and comes last; rows with equal ids draw the same number
and are taken or left together; a null id draws as the empty string. Input columns
whose names the operator makes are replaced; helper columns clash with none. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, carried, draw

WEIGHTS = (5, 2, 1)
SHARE_PCT = 150
MOST_TIMES = 2
#: Rows of the threshold table up to which it is sent to all tasks, at about a hundred bytes a row.
BROADCAST_SOURCES = 10_000
MADE = ("size", "source_size", "target", "copies", "taken")
_H, _B1, _B2, _SRC = "_mix_h", "_mix_b1", "_mix_b2", "_mix_src"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows of (source, source_size).

    Weights repeat over the sources in code point order. Shares above
    ``MOST_TIMES`` the size stop there and the excess goes to the others by weight:
    with sources ordered by size per weight, the common level is the largest of
    (what is left) / (weight that is left). One task orders one row per source, so the
    column is meant to name sources, not to hold as many values as there are rows.
    """
    order = W.orderBy(F.col(_SRC).asc_nulls_last())
    cases = F.lit(WEIGHTS[-1])
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    for i, w in enumerate(WEIGHTS[:-1]):
        cases = F.when(place == i, w).otherwise(cases)
    out = per_source.withColumn("weight", cases.cast("long"))
    everything = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.col(_SRC).asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1)
    out = out.withColumns({
        "_left": SHARE_PCT * F.sum("source_size").over(everything)
        - 100 * MOST_TIMES * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    out = out.withColumn("_level", F.col("_left") / (100 * F.col("_weight")))
    level = F.max("_level").over(everything)
    cap = (MOST_TIMES * F.col("source_size")).cast("double")
    return out.withColumn("target", F.least(cap, F.col("weight") * level)).drop("_left", "_weight", "_level")


def _crossing(hist: DataFrame, on: list[str], bucket: str) -> DataFrame:
    """The bucket of each source where the running sum passes what is left, and what is left there."""
    run = F.sum("_size").over(W.partitionBy(*on).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0))
    crossed = hist.withColumn("_after", run).filter("_after > _left")
    first = crossed.groupBy(*on).agg(F.min(F.struct(F.col(bucket), F.col("_after"), F.col("_size"), F.col("_left"))).alias("x"))
    return first.select(*on, F.col(f"x.{bucket}").alias(bucket), F.col("x._size").alias("_size"),
                        (F.col("x._left") - (F.col("x._after") - F.col("x._size"))).alias("_left"))


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null sources meet."""
    b = b.select(*[F.col(c).alias(f"r{c}") for c in on], *[c for c in b.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"r{c}"))
    return a.join(b, cond).drop(*[f"r{c}" for c in on])


def thresholds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (_src, size, _h, _b1, _b2): the plan of each source, and the first histogram."""
    hist = cut_lineage(rows.groupBy(_SRC, _B1).agg(F.sum("size").alias("_size")))
    plan = targets(hist.groupBy(_SRC).agg(F.sum("_size").alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut_lineage(plan.withColumn("_full", F.least(full, F.lit(MOST_TIMES)).cast("long"))
                       .withColumn("_left", F.col("target") - F.col("_full") * F.col("source_size")))
    at1 = _crossing(_same(hist, plan.select(_SRC, "_left"), [_SRC]), [_SRC], _B1).drop("_size")
    # a bucket of one source holds a small part of its rows, so no key of these joins is hot
    in1 = _same(rows, at1, [_SRC, _B1]).groupBy(_SRC, _B1, _B2, "_left").agg(F.sum("size").alias("_size"))
    at2 = _crossing(in1, [_SRC, _B1], _B2).drop("_size")
    in2 = _same(rows, at2, [_SRC, _B1, _B2]).groupBy(_SRC, _B1, _B2, _H, "_left").agg(F.sum("size").alias("_size"))
    at3 = _crossing(in2, [_SRC, _B1, _B2], _H)
    # the last number is taken when that brings the sum nearer to the target
    nearer = (F.col("_size") - F.col("_left")) < F.col("_left")
    cut = at3.select(_SRC, F.when(nearer, F.col(_H) + 1).otherwise(F.col(_H)).alias("_cut"))
    cut = cut.select(F.col(_SRC).alias("r_src"), "_cut")
    plan = plan.join(cut, F.col(_SRC).eqNullSafe(F.col("r_src")), "left").drop("r_src", "_left")
    return cut_lineage(plan.withColumn("_cut", F.coalesce("_cut", F.lit(0)))), hist


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
        broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Adds size, source_size, target, copies (0 to ``MOST_TIMES``) and taken to every row.

    A source's full passes take every row; one more copy goes to rows below its
    threshold. Small threshold tables are broadcast after counting their rows;
    larger ones join on source and bucket.
    """
    bits = draw(F.lit("mix"), F.col(id_col), digits=12)
    kept, _, back = carried(df, MADE)
    rows = df.select(*kept, F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                     F.col(source_col).alias(_SRC), bits.alias(_H))
    rows = rows.withColumns({_B1: F.shiftright(_H, 36), _B2: F.shiftright(F.col(_H).bitwiseAND((1 << 36) - 1), 24)})
    narrow = cut_lineage(rows.select(_SRC, "size", _H, _B1, _B2))
    plan, hist = thresholds(narrow)
    plan = plan.select(_SRC, "source_size", "target", "_full", "_cut")
    if plan.count() <= broadcast_sources:
        out = _same(rows, F.broadcast(plan), [_SRC])
    else:
        out = _same(rows, _same(hist.select(_SRC, _B1), plan, [_SRC]), [_SRC, _B1])
    out = out.withColumn("copies", (F.col("_full") + (F.col(_H) < F.col("_cut")).cast("long")).cast("int"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*back, *MADE)
