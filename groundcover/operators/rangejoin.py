"""Box joins as equi-joins on grid buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def _buckets(df: DataFrame, cell: float, fields: dict[str, str]) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return (df.withColumn("_bx", F.explode(span(fields["west"], fields["east"])))
            .withColumn("_by", F.explode(span(fields["south"], fields["north"]))))


def bbox_join(left: DataFrame, right: DataFrame, cell: float, *, inclusive: bool = False,
              hot_rows: int = 100_000) -> DataFrame:
    """Pairs of overlapping boxes; columns ``west, south, east, north`` on both sides.

    Both sides are copied to every grid bucket they cover and joined on the
    bucket. A pair is reported only by the bucket that holds the lower-left
    corner of its intersection, so no duplicate removal is needed. Buckets with
    more than ``hot_rows`` rows on a side are split into parts of that side, the other
    side repeated once per part of that bucket only. Right columns get ``r_``.
    """
    l_fields = {k: f"{k}" for k in ("west", "south", "east", "north")}
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r_fields = {k: f"r_{k}" for k in l_fields}
    lb = _buckets(left, cell, l_fields)
    rb = _buckets(right, cell, r_fields)
    key = ["_bx", "_by"]
    parts = lambda side, name: side.groupBy(*key).agg(F.count("*").alias("_n")).filter(
        F.col("_n") > hot_rows).select(*key, F.ceil(F.col("_n") / hot_rows).cast("int").alias(name))
    heat = parts(lb, "_lparts").join(parts(rb, "_rparts"), key, "full")

    def dealt(side: DataFrame, columns: list[str], own: str, other: str) -> DataFrame:
        # a row goes to one part of its own side and is repeated for every part of the other
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        side = side.join(heat, key, "left").withColumn(own.replace("parts", "part"), F.pmod(F.xxhash64(*columns), n).cast("int"))
        return side.withColumn(other.replace("parts", "part"), F.explode(F.sequence(F.lit(0), m - 1))).drop("_lparts", "_rparts")

    ls, rs = dealt(lb, left.columns, "_lparts", "_rparts"), dealt(rb, right.columns, "_rparts", "_lparts")
    a, b = geo.box(""), geo.box("r_")
    hit = geo.touches(a, b) if inclusive else geo.overlaps(a, b)
    home = ((F.floor(F.greatest(a["west"], b["west"]) / cell) == F.col("_bx"))
            & (F.floor(F.greatest(a["south"], b["south"]) / cell) == F.col("_by")))
    return ls.join(rs, [*key, "_lpart", "_rpart"]).filter(hit & home).drop(*key, "_lpart", "_rpart")


def grid_cells(df: DataFrame, x0, y0, x1, y1, origin_x: float, origin_y: float, size: float,
               n_x: Column | int, n_y: Column | int, *, inclusive: bool = True) -> DataFrame:
    """One row per box and regular grid cell it meets: the grid is arithmetic, not a join.

    Rows go up first and columns second, with a spread in between, so one box
    that covers most of the grid is not expanded by a single task.
    """
    n_x = n_x if isinstance(n_x, Column) else F.lit(n_x)
    n_y = n_y if isinstance(n_y, Column) else F.lit(n_y)
    lo = lambda v, o: F.floor((F.col(v) - F.lit(float(o))) / F.lit(float(size))).cast("int")
    first = lambda v, o: (F.ceil((F.col(v) - F.lit(float(o))) / F.lit(float(size))) - 1).cast("int")
    # an inclusive box also meets the cell whose far edge it touches
    fx, fy = (first(x0, origin_x), first(y0, origin_y)) if inclusive else (lo(x0, origin_x), lo(y0, origin_y))
    tx, ty = (lo(x1, origin_x), lo(y1, origin_y)) if inclusive else (first(x1, origin_x), first(y1, origin_y))
    clip = lambda v, n: F.greatest(F.lit(0), F.least(v, n - 1))
    out = df.withColumn("_fx", fx).withColumn("_tx", tx).withColumn("_fy", fy).withColumn("_ty", ty)
    out = out.filter((F.col("_tx") >= 0) & (F.col("_ty") >= 0) & (F.col("_fx") < n_x) & (F.col("_fy") < n_y)
                     & (F.col("_tx") >= F.col("_fx")) & (F.col("_ty") >= F.col("_fy")))
    out = out.withColumn("cell_y", F.explode(F.sequence(clip(F.col("_fy"), n_y), clip(F.col("_ty"), n_y))))
    out = out.withColumn("cell_x", F.explode(F.sequence(clip(F.col("_fx"), n_x), clip(F.col("_tx"), n_x))))
    return out.drop("_fx", "_tx", "_fy", "_ty")
