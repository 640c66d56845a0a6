"""Facts by 64-bit keys for Python code over texts: broadcast where they are few, else joined block by block."""

from __future__ import annotations

import fcntl
import os
import shutil
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .columns import squeezed, unsqueezed
from .common import join_counted
from .memory import given_back
from .store import written

#: Bytes of text that look their facts up together when these are joined.
BLOCK_BYTES = 4_000_000

_U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (fixed values of the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary ``column`` has about ``most`` bytes (one long value is a slice)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(
        zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


_LOCK, _OPEN = threading.Lock(), {}


def opened(shared, make: Callable):
    """What ``make`` gives for a broadcast value, made once per worker process."""
    with _LOCK:
        if _OPEN.get("value") is not shared.value:
            _OPEN.clear()  # what an earlier value gave is let go first
            _OPEN.update(value=shared.value, made=make(shared.value))
        return _OPEN["made"]


#: Rows of a table that every worker opens for itself at most; those of a larger one are mapped.
FEW_OPENED = 4_000_000
#: Bytes that one broadcast of a table in pieces has.
PIECE_BYTES = 16_000_000


def pieces(rows: DataFrame) -> Iterator[list[tuple]]:
    """The rows, in any order, in lists of about ``PIECE_BYTES`` bytes of their binary columns."""
    held, size = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r))
        size += sum(len(x) for x in r if isinstance(x, (bytes, bytearray)))
        if size > PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Shared:
    """A table for all tasks in pieces, each a broadcast of its own, so nobody holds more than one of them."""

    def __init__(self, spark: SparkSession, parts: Iterable):
        self.name, self.parts = uuid.uuid4().hex, [spark.sparkContext.broadcast(p) for p in parts]

    def __iter__(self) -> Iterator:
        for part in self.parts:
            value = part.value
            part.__dict__.pop("_value", None)  # the worker would keep it
            yield from value

    def destroy(self) -> None:
        for part in self.parts:
            part.destroy()


def _arrays(shared: Shared, make: Callable[[Iterator], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    root = Path(SparkFiles.getRootDirectory())
    folder = root / f"mapped-{shared.name}"
    with open(root / "mapped.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not folder.exists():
            for old in root.glob("mapped-*"):  # who has one open keeps it, who still needs it makes it again
                shutil.rmtree(old)
            part = root / f"mapped-part-{uuid.uuid4().hex}"
            part.mkdir()
            made = make(iter(shared))
            for name, values in made.items():
                np.save(part / name, values)
            del made
            os.rename(part, folder)
            given_back()
        return {f.stem: np.load(f, mmap_mode="r").view(np.ndarray) for f in folder.glob("*.npy")}


def mapped(shared: Shared, make: Callable[[Iterator], dict[str, np.ndarray]], of: Callable[[dict], object]):
    """What ``of`` gives for the arrays that ``make`` gives for the pieces of a table.

    One worker of an executor makes the arrays and writes them to the executor's own folder; all of its
    workers map the files, so a table takes its memory once and not once a worker, and that as file pages.
    """
    with _LOCK:
        if _OPEN.get("name") != shared.name:
            _OPEN.clear()
            _OPEN.update(name=shared.name, made=of(_arrays(shared, make)))
        return _OPEN["made"]


def packed(rows: DataFrame, key: str, *counts: str) -> Shared:
    """Rows of a distinct long key and of whole numbers from 0 on, as compressed pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, *more = (c.to_numpy() for c in b.columns)
                steps = np.diff(own.view(_U), prepend=own[:1].view(_U))
                yield pa.RecordBatch.from_arrays([pa.array([int(own[0])]), pa.array([len(own)]), pa.array([squeezed(steps, *more)], pa.binary())],
                                                 ["least", "size", "raw"])

    parts = written(rows.select(key, *counts).orderBy(key).mapInArrow(run, "least long, size long, raw binary"), "pieces")
    places = sorted(tuple(r) for r in parts.select("least", "size").collect())
    return Shared(rows.sparkSession, chain([[places]], pieces(parts)))


def unpacked(parts: Iterator, *kinds: type) -> list[np.ndarray]:
    """The sorted keys and the other columns of ``packed`` rows."""
    at, end = {}, 0
    for least, size in next(parts):
        at[least] = end
        end += size
    out = [np.empty(end, dtype=t) for t in (np.int64, *kinds)]
    for least, size, raw in parts:
        steps, *more = unsqueezed(raw)
        for column, values in zip(out, (np.cumsum(steps) + least, *more)):
            column[at[least]:at[least] + size] = values
    return out


def let_go() -> None:
    """Drops what ``opened`` keeps, which outlives its tasks, before work that needs none of it."""
    with _LOCK:
        _OPEN.clear()
    given_back()


def sorted_by_key(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable")))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys)  # neighbours are found in memory that is at hand
    at = np.empty(len(keys), dtype=np.int64)
    at[order] = np.minimum(np.searchsorted(sorted_keys, keys[order]), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def with_facts(rows: DataFrame, text: str, facts: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray],
               make: Callable[[pa.Table], object], run: Callable[[pa.RecordBatch, object], pa.RecordBatch],
               schema: str | StructType, few: int, most: int) -> DataFrame:
    """``run(batch, facts)`` over rows in slices of about ``most`` bytes of the binary column ``text``.

    ``facts`` has a distinct long ``key`` and other columns; ``make`` gets them as a table sorted by
    key. Up to ``few`` facts are broadcast. With more of them, texts are numbered in blocks, the
    distinct ``keys`` of a block are joined to the facts, frequent keys apart, and meet their block.
    """
    if facts.limit(few + 1).count() <= few:
        shared = facts.sparkSession.sparkContext.broadcast(sorted_by_key(facts.toArrow()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = opened(shared, make)
            for b in batches:
                for part in text_runs(b, text, most):
                    yield run(part, own)

        return rows.mapInArrow(near, schema)

    numbered = StructType([*rows.schema.fields, StructField("_block", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for part in text_runs(b, text, BLOCK_BYTES):
                size = pc.sum(pc.binary_length(part.column(part.schema.get_field_index(text)))).as_py() or 0
                if held and held + size > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], numbered.names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(b.schema.get_field_index("_block")).to_numpy()
            for n in np.unique(block):
                for part in text_runs(b.filter(pa.array(block == n)), text, most):
                    k = np.unique(keys(part.drop_columns(["_block"])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n)), pa.array(k)], ["_block", "key"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = make(sorted_by_key(right.drop_columns(["_block"])))
        out = [run(part, own) for b in left.drop_columns(["_block"]).combine_chunks().to_batches()
               for part in text_runs(b, text, most)]
        return pa.Table.from_batches(out)

    blocks = written(rows.mapInArrow(number, numbered), "blocks")
    wanted = written(blocks.mapInArrow(asked, "_block long, key long").distinct(), "block-keys")
    counted = cut_lineage(wanted.groupBy("key").agg(F.count("*").alias("_rows")).join(facts, "key"))
    found = join_counted(wanted, counted, ["key"], "_rows").select("_block", *facts.columns)
    return blocks.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(meet, schema)
