"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; the weight of a node is the number of
shards below it. A row descends level by level: every child draws a number from
the row's id and the child's name, scaled by its weight, and the least wins. A
child whose weight does not change draws the same number again, so growth moves
rows only into subtrees whose weight grew. The first ``base`` shards fill
regions of two racks with four shards; every later shard opens a region of its
own, so one more shard takes rows only into itself.

Defined cases: a null id draws as the empty string; rows with equal ids share a
shard; a null text counts as empty; repeated rows get slots of their own. The id
and the shard count decide, so equal texts under different ids may part. Only the
columns named in ``place`` come back, so clashing names cannot arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import draw

RACKS, PER_RACK = 2, 4
SLOT_BUCKETS_DIGITS = 3
#: Alike rows are written out again in steps of so many.
COPIES = 65_536


def tree(shards: int, base: int) -> list[list[list[int]]]:
    """Shard numbers by region and rack."""
    first = list(range(min(shards, base)))
    racks = [first[i:i + PER_RACK] for i in range(0, len(first), PER_RACK)]
    regions = [racks[i:i + RACKS] for i in range(0, len(racks), RACKS)]
    return regions + [[[s]] for s in range(base, shards)]


def _least(key: Column, level: str, children: Column) -> Column:
    """The winning child of an array of (name, weight, index)."""
    def score(c: Column) -> Column:
        u = (draw(key, F.lit(level), c["name"]) + 0.5) / float(1 << 32)
        return F.struct((-F.log(u) / c["weight"]).alias("score"), c["index"].alias("index"))

    return F.array_min(F.transform(children, score))["index"]


def _nodes(named: list[tuple[str, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("index"))
                     for i, (n, w) in enumerate(named)])


def shard_of(key: Column, shards: int, base: int) -> Column:
    """The shard of a key as one expression."""
    regions = tree(shards, base)

    def in_rack(r: int, k: int, rack: list[int]) -> Column:
        if len(rack) == 1:
            return F.lit(rack[0])
        win = _least(key, "shard", _nodes([(f"{r}.{k}.{s}", 1) for s in rack]))
        return F.get(F.array(*[F.lit(s) for s in rack]), win)

    def in_region(r: int, racks: list[list[int]]) -> Column:
        if len(racks) == 1:
            return in_rack(r, 0, racks[0])
        win = _least(key, "rack", _nodes([(f"{r}.{k}", len(rack)) for k, rack in enumerate(racks)]))
        return _pick(win, [in_rack(r, k, rack) for k, rack in enumerate(racks)])

    win = _least(key, "region", _nodes([(str(r), sum(map(len, racks))) for r, racks in enumerate(regions)]))
    return _pick(win, [in_region(r, racks) for r, racks in enumerate(regions)])


def _pick(index: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i in reversed(range(len(options) - 1)):
        out = F.when(index == i, options[i]).otherwise(out)
    return out


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
          base: int = 16) -> DataFrame:
    """Rows of (id, size, text_crc32, law, shard, slot, grown_shard).

    Slots count rows of a shard from 0 without gaps, ordered by a bucket drawn from
    the id and the text's checksum and then by id: counts per bucket give each bucket its
    first slot, and rows are ranked inside their bucket only, so no task ranks a whole shard,
    nor all rows of one id. Rows alike in id and text are one row with a count until the end.
    """
    if shards < 1 or base < 1:
        raise ValueError("at least one shard is needed")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col)
    rows = df.select(key.alias(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"),
                     F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
                     shard_of(key, shards, base).cast("int").alias("shard"),
                     shard_of(key, shards + 1, base).cast("int").alias("grown_shard"),
                     draw(F.lit("slot"), key, F.crc32(raw), digits=SLOT_BUCKETS_DIGITS).alias("_bucket"))
    made = ["size", "text_crc32", "law", "shard", "grown_shard"]
    rows = cut_lineage(rows.groupBy(id_col, *made, "_bucket").agg(F.count("*").alias("_n")))
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n"))
    first = counts.select("shard", "_bucket", (F.sum("_n").over(
        W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    order = W.partitionBy("shard", "_bucket").orderBy(id_col, "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_rank", F.sum("_n").over(order) - F.col("_n")).join(first, ["shard", "_bucket"])
    out = out.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES))))
    copy = F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + COPIES) - 1)).alias("_copy")
    out = out.select(id_col, *made, "_first", "_rank", copy)
    return out.select(id_col, "size", "text_crc32", "law", "shard",
                      (F.col("_first") + F.col("_rank") + F.col("_copy")).cast("long").alias("slot"), "grown_shard")
