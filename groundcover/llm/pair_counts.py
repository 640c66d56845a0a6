"""Counts of words and of pairs of words by label, in compressed blocks, where the distinct words can be broadcast.

Words are numbered by frequency. A task ships its distinct pairs as one binary row per block of words and label;
where a block meets, each pair is one entry with its counts by label. From there on go one row a word, the few pairs and
contexts that labels say something about, and, again as blocks, two sums a context. So a pair is shipped
once in a few bytes, where a table of pairs by 64-bit hashes takes ten times that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookup
from .columns import squeezed, unsqueezed
from .common import if_few
from .lookup import Shared, find, mapped, opened, pieces
from .memory import tidy
from .store import written

#: Entries a task holds; words and tokens of a block.
HELD, BLOCK_WORDS, BLOCK_TOKENS = 1_000_000, 50_000, 2_000_000
#: Bytes of text per hash partition of the words.
WORD_BYTES = 64_000_000
LABELS = 5  # ordinary, toxic, these two of the curve's points, none

#: (texts) to hashes of distinct words and their stems, every token's place there, the place before it plus 1 (0 for none), tokens by text.
Tokens = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _runs(batches: Iterator[pa.RecordBatch], runs: Callable) -> Iterator[tuple[list[str], np.ndarray]]:
    for b in batches:
        labels = np.array([LABELS - 1 if x is None else x for x in b.column(1).to_pylist()], dtype=np.int64)
        at = 0
        for texts in runs(t.as_py() or "" for t in b.column(0)):
            yield texts, labels[at:at + len(texts)]
            at += len(texts)


def _merged(key: list[np.ndarray], *sums: list[np.ndarray]) -> list[np.ndarray]:
    key = np.concatenate(key)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [key[first], order[first], *[np.add.reduceat(np.concatenate(s)[order], first) for s in sums]]


def vocabulary(train: DataFrame, tokens: Tokens, runs: Callable, parts: int) -> DataFrame:
    """(part, distinct, total, words, stems): every distinct word once, by range of its hash, as compressed columns."""
    def run(batches):
        held, size = [], 0

        def shipped():
            key, stem, n = (np.concatenate(x) for x in zip(*held))
            key, first, n = _merged([key], [n])
            stem = stem[first]
            part = _part(key, parts)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in _words(
                    key[own], stem[own], n[own])]], ["part", "words", "stems"])

        for texts, _ in _runs(batches, runs):
            word, stem, codes, _, _ = tokens(texts)
            if len(word):
                held.append((word, stem, np.bincount(codes, minlength=len(word))))
                size += len(word)
                if size > HELD:
                    key, first, n = _merged([x[0] for x in held], [x[2] for x in held])
                    held = [(key, np.concatenate([x[1] for x in held])[first], n)]
                    size = len(key)
                    if size > HELD // 2:
                        yield from shipped()
                        held, size = [], 0
        if held:
            yield from shipped()

    def meet(batches):
        part, held = None, []

        def met():
            key, first, n = _merged([x[0] for x in held], [x[2] for x in held])
            raw = _words(key, np.concatenate([x[1] for x in held])[first], n)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(key)]), pa.array([n.sum()]), *[pa.array([x], pa.binary()) for x in raw]],
                                              ["part", "distinct", "total", "words", "stems"])

        for b in batches:
            for p, words, stems in zip(*[c.to_pylist() for c in b.columns]):
                if p != part and held:
                    yield met()
                    held = []
                part = p
                held.append(_read_words(words, stems))
        if held:
            yield met()

    rows = train.select("text", "label").mapInArrow(tidy(run), "part int, words binary, stems binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(meet), "part int, distinct long, total long, words binary, stems binary")


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, so parts in order are sorted."""
    return (key.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _words(key: np.ndarray, stem: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    order = np.argsort(key.view(np.uint64))
    stems, at = np.unique(stem[order], return_inverse=True)
    return squeezed(np.diff(key[order].view(np.uint64), prepend=np.uint64(0)), at, n[order]), stems.tobytes()


def _read_words(words: bytes, stems: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, at, n = unsqueezed(words)
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64).view(np.int64), np.frombuffer(stems, dtype=np.int64)[at], n


@dataclass
class Numbered:
    """Words numbered from the most frequent: by sorted hash their numbers and the places of their stems, and back. 20 bytes a word."""

    sorted_keys: np.ndarray
    numbers: np.ndarray
    by_number: np.ndarray
    stem_at: np.ndarray
    stems: np.ndarray

    @staticmethod
    def arrays(parts: Iterable[tuple[int, bytes, bytes]]) -> dict[str, np.ndarray]:
        """From compressed parts; those of hashes below come first, so nothing large is sorted but the counts."""
        of = {}
        for part, words, own in parts:
            steps, at, n = unsqueezed(words)
            of[part] = (np.cumsum(steps.view(np.uint64), dtype=np.uint64), np.minimum(n, 2**31 - 1).astype(np.int32),
                        at.astype(np.int32), np.frombuffer(own, dtype=np.int64))
        stems = np.unique(np.concatenate([own for *_, own in of.values()]))
        keys, counts, places = [], [], []
        for part in sorted(of):
            key, n, at, own = of.pop(part)
            keys.append(key)
            counts.append(n)
            places.append(np.searchsorted(stems, own).astype(np.int32)[at])
        by_number = np.argsort(-np.concatenate(counts), kind="stable").astype(np.int32)
        numbers = np.empty(len(by_number), dtype=np.int32)
        numbers[by_number] = np.arange(len(by_number), dtype=np.int32)
        return {"sorted_keys": np.concatenate(keys), "numbers": numbers, "by_number": by_number,
                "stem_at": np.concatenate(places), "stems": stems}

    @classmethod
    def of(cls, parts: list[tuple[int, bytes, bytes]]) -> Numbered:
        return cls(**cls.arrays(parts))

    @classmethod
    def opened(cls, shared) -> Numbered:
        return mapped(shared, cls.arrays, lambda made: cls(**made)) if isinstance(shared, Shared) else opened(shared, cls.of)

    def find(self, key: np.ndarray) -> np.ndarray:
        return self.numbers[find(self.sorted_keys, key.view(np.uint64))[0]].astype(np.int64)

    def key(self, number: np.ndarray) -> np.ndarray:
        return self.sorted_keys[self.by_number[number]].view(np.int64)

    def stem(self, number: np.ndarray) -> np.ndarray:
        return self.stems[self.stem_at[self.by_number[number]]]

    def before(self, number: np.ndarray) -> np.ndarray:
        """Hashes of preceding words, whose numbers begin at 1; 0 is none."""
        return np.where(number > 0, self.key(np.maximum(number - 1, 0)), 0)


def _by_block(place: np.ndarray, blocks: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Entries of numbers ``place`` dealt to blocks: (block, steps of the places in it and other columns)."""
    place = place.astype(np.int64)
    at = place % blocks << 32 | place // blocks
    order = np.argsort(at)
    at = at[order]
    bounds = np.searchsorted(at, np.arange(blocks + 1) << 32)
    at &= 0xFFFFFFFF
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[b], bounds[b + 1])
        yield b, squeezed(np.diff(at[part], prepend=0), *[c[order[part]] for c in columns])


PARTS = "kind int, key long, other long, o0 long, t0 long, o1 long, t1 long, every long, off long, stem long, raw binary"
COLUMNS = ["kind", "key", "other", "o0", "t0", "o1", "t1", "every", "off", "stem"]


def count_blocks(train: DataFrame, words: DataFrame, size: int, total: int, tokens: Tokens, runs: Callable, kinds: tuple[int, int, int],
                 discount: int) -> DataFrame:
    """Rows of the same kind and content as the counts by joins: pairs, words and contexts, from rows of (text, label)."""
    spark = train.sparkSession
    # the driver passes the compressed parts on as they are; workers open them
    words = words.select("part", "words", "stems")
    if size > lookup.FEW_OPENED:
        shared = Shared(spark, pieces(words))
    else:
        shared = spark.sparkContext.broadcast([tuple(r) for r in words.collect()])
    blocks = max(1, -(-size // BLOCK_WORDS), -(-total // BLOCK_TOKENS))
    pair_kind, word_kind, context_kind = kinds
    sums_kind = -1

    def deal(batches):
        held, count = [], 0

        def shipped():
            label, before, word, n = (np.concatenate(x) for x in zip(*held))
            for c in range(LABELS):
                own = np.flatnonzero(label == c)
                if len(own):
                    rows = list(_by_block(word[own], blocks, before[own], n[own]))
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([c] * len(rows), pa.int32()),
                                                      pa.array([r for _, r in rows], pa.binary())], ["block", "label", "raw"])

        for texts, labels in _runs(batches, runs):
            word, _, codes, place, sizes = tokens(texts)
            wide = len(word)
            if not wide:
                continue
            number = Numbered.opened(shared).find(word)
            first = np.concatenate([[0], number + 1])
            key, n = np.unique((np.repeat(labels, sizes) * (wide + 1) + place) * wide + codes, return_counts=True)
            held.append(((key // wide // (wide + 1)).astype(np.int8), first[key // wide % (wide + 1)].astype(np.int32),
                         number[key % wide].astype(np.int32), n.astype(np.int32)))
            count += len(key)
            if count > HELD:
                yield from shipped()
                held, count = [], 0
        if held:
            yield from shipped()

    def meet(batches):
        block, held, count, most, v = None, [], 0, 2 * HELD, Numbered.opened(shared)

        def merged():
            nonlocal held, count
            if len(held) > 1:
                key, _, n = _merged([x[0] for x in held], [x[1] for x in held])
                held = [(key, n)]
            count = len(held[0][0])

        def met():
            merged()
            entry, n = held.pop()
            key = entry >> 3
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at, label = np.cumsum(new) - 1, entry & 7
            key, columns = key[new], []
            for c in range(LABELS):
                own = label == c
                columns.append(np.zeros(len(key), dtype=np.int32))
                columns[-1][at[own]] = n[own]
            o, t, op, tp, none = columns
            word, before = block + blocks * (key >> 32), key & 0xFFFFFFFF
            del entry, n, at, label, new
            classes, every = [o, t, o + op, t + tp], o + t + op + tp + none
            above = [np.maximum(c - discount, 0) for c in classes]
            zero = np.zeros(len(key), dtype=np.int64)

            def rows(kind, key, other, *columns, stem=None):
                arrays = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key), pa.array(other)]
                arrays += [pa.array(c.astype(np.int64)) for c in columns]
                arrays += [pa.nulls(len(key), pa.int64()) if stem is None else pa.array(stem), pa.nulls(len(key), pa.binary())]
                return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "raw"])

            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            own = word[first]
            yield rows(word_kind, v.key(own), zero[first], *[np.add.reduceat((c > 0).astype(np.int64), first) for c in classes],
                       np.diff(np.append(first, len(word))), zero[first], stem=v.stem(own))
            some = np.flatnonzero(above[2] + above[3] > 0)
            yield rows(pair_kind, v.before(before[some]), v.key(word[some]), *[c[some] for c in classes], zero[some], zero[some])
            yield rows(context_kind, v.before(before[some]), zero[some], *[c[some] for c in above], zero[some], zero[some])
            context, _, n, off = _merged([before], [every], [np.minimum(every, discount)])
            packed = list(_by_block(context, blocks, n, off))
            nulls = [pa.nulls(len(packed), pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), sums_kind, dtype=np.int32)), pa.array([b for b, _ in packed], pa.int64()),
                                              *nulls, pa.array([r for _, r in packed], pa.binary())], [*COLUMNS, "raw"])

        for b in batches:
            for own, label, raw in zip(*[c.to_pylist() for c in b.columns]):
                if own != block and held:
                    yield from met()
                    held, count, most = [], 0, 2 * HELD
                block = own
                steps, before, n = unsqueezed(raw)
                held.append(((np.cumsum(steps) << 32 | before) << 3 | label, n.astype(np.int32)))
                count += len(n)
                if count > most:
                    merged()
                    most = max(2 * HELD, 2 * count)
        if held:
            yield from met()

    def add(batches):
        block, held, v = None, [], Numbered.opened(shared)

        def added():
            at, _, n, off = _merged([x[0] for x in held], [x[1] for x in held], [x[2] for x in held])
            at = block + blocks * at
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (v.before(at), n, off)], ["key", "every", "off"])

        for b in batches:
            for own, raw in zip(*[c.to_pylist() for c in b.columns]):
                if own != block and held:
                    yield added()
                    held = []
                block = own
                steps, n, off = unsqueezed(raw)
                held.append((np.cumsum(steps), n, off))
                if len(held) > 200:
                    at, _, n, off = _merged([x[0] for x in held], [x[1] for x in held], [x[2] for x in held])
                    held = [(at, n, off)]
        if held:
            yield added()

    edges = train.select("text", "label").mapInArrow(tidy(deal), "block int, label int, raw binary")
    parts = edges.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(meet), PARTS)
    parts = written(parts, "pair-blocks")
    classes = ("o0", "t0", "o1", "t1")
    contexts = parts.filter(F.col("kind") == context_kind).groupBy("key").agg(*[F.sum(c).alias(c) for c in classes])
    contexts = written(contexts, "pair-contexts")
    sums = parts.filter(F.col("kind") == sums_kind).select("key", "raw").repartition("key").sortWithinPartitions("key").mapInArrow(
        tidy(add), "key long, every long, off long")
    wanted = if_few(contexts)
    contexts = sums.join(wanted, "key").select(F.lit(context_kind).alias("kind"), "key", F.lit(0).cast("long").alias("other"), *classes,
                                               "every", "off", F.lit(None).cast("long").alias("stem"))
    return parts.filter(F.col("kind").isin(pair_kind, word_kind)).select(COLUMNS).unionByName(contexts)
