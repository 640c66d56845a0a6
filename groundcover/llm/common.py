"""Text splitting, reproducible draws and table access shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def draw(*parts: Column, digits: int = 8) -> Column:
    """A whole number below 16 ** digits (at most 15) drawn from the parts by MD5.

    MD5 so that every engine and every rerun draws the same number; a null part
    counts as an empty string.
    """
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, digits), 16, 10).cast("long")


def carried(df: DataFrame, made: tuple[str, ...]) -> tuple[list[Column], list[Column], list[Column]]:
    """The columns of ``df`` other than ``made``, under numbered names that no helper column has.

    Three lists for select: into the numbered names, on with them, and back to the own names.
    """
    names = [c for c in df.columns if c.lower() not in made]
    return ([F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(names)],
            [F.col(f"_in{i}") for i in range(len(names))],
            [F.col(f"_in{i}").alias(c) for i, c in enumerate(names)])


def join_counted(rows: DataFrame, facts: DataFrame, on: list[str], count: str, how: str = "inner",
                 floor: int = 10_000, most_hot: int = 50_000) -> DataFrame:
    """Joins rows to facts about their keys, of which ``count`` says how many rows each has.

    Keys with very many rows are joined by broadcast: with the limit at the total
    divided by ``most_hot`` at least, there are at most ``most_hot`` of them. Other keys
    are joined by shuffle, and none of those is large. Keys may not be null.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    limit = max(floor, total // most_hot)
    hot = facts.filter(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(facts, on, how)
    made = [c for c in facts.columns if c not in on]
    marked = rows.join(F.broadcast(hot.select(*on, F.struct(*made).alias("_hot"))), on, "left")
    usual = marked.filter("_hot IS NULL").drop("_hot").join(facts.filter(F.col(count) <= limit), on, how)
    return marked.filter("_hot IS NOT NULL").select(*rows.columns, "_hot.*").unionByName(usual)


#: Rows that are worth a task of their own.
TASK_ROWS = 20_000


def dealt(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these are worth, and four for each core at least.

    Partitions are joined where they lie, never split. A step of many shuffles over few rows is otherwise mostly starts of
    tasks and files of a block each, unless Spark joins the partitions itself.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each)))


#: Ids sent to all tasks at most: some tens of megabytes.
FEW_IDS = 500_000


def if_few(ids: DataFrame, limit: int = FEW_IDS) -> DataFrame:
    """Marks one column of ids for broadcast when there are no more than ``limit``; else it joins by shuffle."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
