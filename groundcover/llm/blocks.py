"""Groups compared exhaustively, in blocks that fit a task, streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt
from .memory import tidy


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of the groups, from rows sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        last = int(np.searchsorted(k, k[-1])) if (k[:-1] <= k[1:]).all() else 0
        if last:
            held.append(b.slice(0, last))
            yield _bounds(held, key)
            held = [b.slice(last)]
        elif held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != k[0]:
            yield _bounds(held, key)
            held = [b]
        else:
            held.append(b)
    if held:
        yield _bounds(held, key)


def _bounds(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    k = table.column(key).to_numpy()
    return table, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


class Union:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def block_pairs(rows: DataFrame, key: list[str], size: str, index: str, block: int) -> DataFrame:
    """Sends every row to each pair of blocks it has a part in; one group is about two blocks at most.

    Rows are dealt to blocks by a hash, so no pattern of ids fills one of them. ``_across`` marks
    groups of two blocks, whose rows are compared across these only.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(index), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("p"),
                                                                       F.greatest(own, j).alias("q")))
    out = rows.withColumn("_own", own).withColumn("_pair", F.explode(pairs))
    out = out.withColumn("_across", F.col("_pair.p") != F.col("_pair.q"))
    return out.withColumn("group", F.xxhash64(*key, "_pair.p", "_pair.q")).drop("_pair")


def sorted_groups(rows: DataFrame, run: Callable, schema: str, about: int | None = None) -> DataFrame:
    """``run`` over whole groups; ``about`` says how many rows there are, if known, so that few rows get few tasks."""
    parts = rows.repartition("group")
    parts = parts if about is None else dealt(parts, about)
    return parts.sortWithinPartitions("group").mapInArrow(tidy(run), schema)
