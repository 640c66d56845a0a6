"""A Brown class-based bigram model: exchange clustering of the words, smoothed class transitions and word emissions.

The probability of a token is that of its class after the class before it, times that of the
word in its class. Every text ends with an end token, which has a class of its own and also
stands before its first word. Classes come from exchange clustering: the most frequent
words open a class each, all others begin in the last one; then each round moves half of the words to
the class in which they add most to the class bigram likelihood f(transitions) - 2 f(totals), f(x) = x log x,
with the other words where they are. The gain of a frequent word is taken exactly, without the word in its own class;
that of other words to the first order, with which f(x + 1) - f(x) is exact for single counts.
All training words are clustered, by all their neighbours.

Transitions are smoothed by class totals. Emissions give a discount, n1 / (n1 + 2 n2), of every word to
words not seen in training, class by class; after such a word, transitions are those of words seen once. So the
probabilities of all known words, the end and one unknown word add up to 1 after any history, as those of the base model do.

Up to ``FEW`` distinct words (and ``FEW_TOKENS`` tokens): words are numbered by frequency and broadcast (``lookup``: many of them in
pieces, mapped by the workers of an executor); bigrams are dealt once, as
compressed blocks, to where their words' decisions are made, and a round moves one byte a word. With more
words, rounds are joins of bigrams and classes that give each word its at most ``CLASSES`` neighbouring
classes, and texts are joined to the words they use, block by block.

Defined cases: a null text is an empty one, which is its end token; a null id counts as an empty
string, so it is a training row; repeated rows count as often as they occur; without training rows both scores are 0
for every text; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lookup
from .common import join_counted
from .lookup import Shared, find, mapped, opened, packed, text_runs, unpacked, with_facts
from .memory import tidy
from .store import written

#: Classes, among them that of the end token, and rounds in which half of the words may move.
CLASSES, ROUNDS = 64, 8
FOLDS, HELD_OUT = 5, 1
#: Words that are broadcast at most, 20 bytes each, and tokens whose bigrams are dealt by word: of more, one
#: frequent word's bigrams would keep a task too long.
FEW, FEW_TOKENS = 64_000_000, 2_000_000_000  # so counts fit 32 bits
#: Counts from which a word's gain is taken exactly; tokens' weight that class totals have in transitions.
HEAVY, BACK = 1000, 20.0
#: Bytes of text counted at a time, distinct bigrams a task holds, words whose decisions one block takes and their tokens on average.
RUN_BYTES, HELD, BLOCK_WORDS, BLOCK_TOKENS = 4_000_000, 2_000_000, 50_000, 4_000_000
#: The end token: no UTF-8 text holds this byte.
END = b"\xff"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END_KEY = int(pd.util.hash_array(np.array([END], dtype=object), categorize=False).view(np.int64)[0])


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of the distinct tokens, every token's place there, tokens by text; the last token of a text is the end."""
    words, sizes = [], []
    for t in texts:
        own = t.as_py().translate(_LOWER).split()
        own.append(END)
        sizes.append(len(own))
        words += own
    codes, names = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(names, categorize=False).view(np.int64), codes, np.array(sizes, dtype=np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(key, n) of all training tokens from rows of (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_runs(b, "text", RUN_BYTES):
                key, codes, _ = tokens(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(codes, minlength=len(key)))], ["key", "n"])

    return train.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _bigrams(train: DataFrame, emit, schema: str, number=None, shared=None) -> DataFrame:
    """Runs ``emit(left, right, n)`` on the distinct bigrams of a task, whenever it holds ``HELD``; the end stands before a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in text_runs(b, "text", RUN_BYTES):
                key, codes, sizes = tokens(part.column(0))
                name = key if number is None else number(Vocabulary.opened(shared), key)
                before = np.concatenate([codes[-1:], codes[:-1]])  # the last token of the text before it is its end
                pair, n = np.unique(before * len(key) + codes, return_counts=True)
                held.append((name[pair // len(key)], name[pair % len(key)], n))
                size += len(n)
                if size > HELD:
                    yield from emit(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held)))

    return train.select("text").mapInArrow(tidy(run), schema)


# the exchange

def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def moved(before: np.ndarray, after: np.ndarray, n: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each word that adds most to the likelihood.

    ``before`` and ``after`` count the classes of a word's neighbours, ``own`` is its class now and
    ``counts`` the transitions between classes. The end's class takes no words. Ties go to the lower class.
    """
    totals = np.maximum(counts.sum(0), counts.sum(1)).astype(float)
    step = _f(counts + 1.0) - _f(counts.astype(float))
    gain = before @ step + after @ step.T - 2 * n[:, None] * (_f(totals + 1) - _f(totals))
    for i in np.flatnonzero(n >= HEAVY).tolist():
        here = np.zeros(len(totals), dtype=bool)
        here[own[i]] = True
        lower = counts - np.where(here[None, :], before[i][:, None], 0) - np.where(here[:, None], after[i][None, :], 0)
        lower, left = np.maximum(lower, 0).astype(float), np.maximum(totals - here * n[i], 0)
        same, b, a = lower.diagonal(), before[i], after[i]
        gain[i] = ((_f(lower + b[:, None]) - _f(lower)).sum(0) + (_f(lower.T + a[:, None]) - _f(lower.T)).sum(0)
                   + _f(same + a + b) + _f(same) - _f(same + a) - _f(same + b) - 2 * (_f(left + n[i]) - _f(left)))
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def turn(key: np.ndarray, round_: int) -> np.ndarray:
    """Words that may move in a round: every word in every other round."""
    return ((key.astype(np.uint64) >> np.uint64(7)) + np.uint64(round_)) % np.uint64(2) == 0


@dataclass
class Vocabulary:
    """Words of the training rows, most frequent first: the end is word 0. ``sorted_keys`` and ``ranks`` find them."""

    sorted_keys: np.ndarray
    ranks: np.ndarray
    n: np.ndarray
    odd: np.ndarray | None = None  # words that move in odd rounds

    @classmethod
    def of(cls, table: pa.Table) -> Vocabulary:
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((key, -n, key != END_KEY))
        by_key = np.argsort(key[order])
        return cls(key[order][by_key], by_key.astype(np.int32), n[order])

    @staticmethod
    def arrays(parts: Iterator) -> dict[str, np.ndarray]:
        """The same from packed pieces, whose keys are sorted, so only the counts are."""
        key, n = unpacked(parts, np.int32)
        first = -n
        first[key == END_KEY] = np.iinfo(np.int32).min
        order = np.argsort(first, kind="stable")
        del first
        ranks = np.empty(len(key), dtype=np.int32)
        ranks[order] = np.arange(len(key), dtype=np.int32)
        return {"sorted_keys": key, "ranks": ranks, "n": n[order], "odd": ~turn(key[order], 0)}

    @classmethod
    def opened(cls, shared) -> Vocabulary:
        return mapped(shared, cls.arrays, lambda made: cls(**made)) if isinstance(shared, Shared) else shared.value

    def number(self, key: np.ndarray) -> np.ndarray:
        return self.ranks[find(self.sorted_keys, key)[0]]


def _packed(word: np.ndarray, other: np.ndarray, n: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """By block of words: (word in block, neighbour, count) as compressed bytes of sorted steps and of numbers."""
    place = word % blocks << 32 | word // blocks
    order = np.argsort(place)
    place, other, n = place[order], other[order], n[order].astype(np.uint32)
    at, place = np.searchsorted(place, np.arange(blocks + 1) << 32), place & 0xFFFFFFFF
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        columns = [c.astype(np.uint32) for c in (np.diff(place[part], prepend=0), other[part], n[part])]
        wide = bytes(max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns)  # bytes that a column needs
        planes = [c.view(np.uint8).reshape(-1, 4)[:, k] for c, w in zip(columns, wide) for k in range(w)]
        yield b, wide + squeeze.compress(np.stack(planes).tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = raw[:3]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[3:]), dtype=np.uint8).reshape(sum(wide), -1)
    columns, at = [], 0
    for w in wide:
        column = planes[at].astype(np.uint32)
        for k in range(1, w):
            column |= planes[at + k].astype(np.uint32) << np.uint32(8 * k)
        columns.append(column)
        at += w
    return np.cumsum(columns[0], dtype=np.int64), *columns[1:]


def dealt(train: DataFrame, vocabulary, blocks: int) -> DataFrame:
    """(block, side, edges): bigrams where the decisions about their right word (side 0) and left word (side 1) are made."""

    def emit(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for side, (word, other) in enumerate(((right, left), (left, right))):
            rows = list(_packed(word.astype(np.int64), other, n, blocks))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([side] * len(rows), pa.int32()),
                                              pa.array([e for _, e in rows], pa.binary())], ["block", "side", "edges"])

    edges = _bigrams(train, emit, "block int, side int, edges binary", Vocabulary.number, vocabulary)
    # a checkpoint keeps the partitions, so every round finds a block whole and in one task
    return cut_lineage(edges.repartition("block").sortWithinPartitions("block"))


def _neighbours(batches: Iterator[pa.RecordBatch], classes: np.ndarray, words: int, blocks: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks with the counts of the classes before and after each of their words."""
    block, held, sums, size = None, ([], []), None, 0

    def add():
        nonlocal size
        for side in (0, 1):
            if held[side]:
                word, other, n = map(np.concatenate, zip(*held[side]))
                sums[side] += np.bincount(word * CLASSES + classes[other], weights=n, minlength=sums[side].size).reshape(-1, CLASSES)
                held[side].clear()
        size = 0

    for b in batches:
        for own, side, edges in zip(*[c.to_pylist() for c in b.columns]):
            if own != block:
                if block is not None:
                    add()
                    yield block, sums
                block, sums = own, [np.zeros((-(-(words - own) // blocks), CLASSES)) for _ in (0, 1)]
            held[side].append(_unpacked(edges))
            size += len(held[side][-1][0])
            if size > HELD // 2:
                add()
    if block is not None:
        add()
        yield block, sums


@dataclass
class Mapped:
    """Words that workers map, and their classes by rank."""

    shared: Shared
    classes: np.ndarray


def clustered(train: DataFrame, words: DataFrame, size: int, total: int, rounds: int) -> tuple[pa.Table | Mapped, np.ndarray, np.ndarray]:
    """Classes of the words when these can be sent: (key, n, cls), the transitions, and those after words seen once."""
    spark = train.sparkSession
    blocks = max(-(-size // BLOCK_WORDS), -(-total // BLOCK_TOKENS))
    own = None if size > lookup.FEW_OPENED else Vocabulary.of(words.toArrow())
    vocabulary = packed(words, "key", "n") if own is None else spark.sparkContext.broadcast(own)
    edges = dealt(train, vocabulary, blocks)
    classes = np.minimum(np.arange(size), CLASSES - 1).astype(np.uint8)
    # rounds need 6 bytes a word: counts, whose turn it is, and classes
    if own is None:
        def facts() -> tuple[np.ndarray, np.ndarray]:
            open_ = Vocabulary.opened(vocabulary)
            return open_.n, open_.odd
    else:
        key = np.empty(size, dtype=np.int64)
        key[own.ranks] = own.sorted_keys
        shared_facts = [spark.sparkContext.broadcast(x) for x in (own.n.astype(np.int32), ~turn(key, 0))]

        def facts() -> tuple[np.ndarray, np.ndarray]:
            return tuple(x.value for x in shared_facts)

    def transitions(classes) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            sums, (often, _) = np.zeros((2 * CLASSES, CLASSES)), facts()
            for block, (_, after) in _neighbours((b.filter(pa.array(b.column(1).to_numpy() == 1)) for b in batches), classes.value, size, blocks):
                ranks = block + blocks * np.arange(len(after))
                np.add.at(sums, classes.value[ranks], after)
                once = np.flatnonzero(often[ranks] == 1)
                np.add.at(sums, CLASSES + classes.value[ranks[once]].astype(int), after[once])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at].astype(np.int64))], ["at", "n"])

        out = np.zeros(2 * CLASSES * CLASSES, dtype=np.int64)
        for at, n in edges.mapInArrow(tidy(run), "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most 2 * CLASSES ** 2 rows
            out[at] = n
        out = out.reshape(2, CLASSES, CLASSES)
        return out[0], out[1].sum(0)

    def decided(classes, counts: np.ndarray, round_: int) -> DataFrame:
        def run(batches):
            often, odd = facts()
            for block, (before, after) in _neighbours(batches, classes.value, size, blocks):
                ranks = block + blocks * np.arange(len(after))
                ranks, row = (x[(odd[ranks] == bool(round_ % 2)) & (ranks > 0)] for x in (ranks, np.arange(len(after))))
                to = np.empty(len(ranks), dtype=np.int64)
                for a in range(0, len(ranks), 10_000):
                    at = slice(a, a + 10_000)
                    to[at] = moved(before[row[at]], after[row[at]], often[ranks[at]].astype(np.int64), classes.value[ranks[at]], counts)
                differ = to != classes.value[ranks]
                yield pa.RecordBatch.from_arrays([pa.array(ranks[differ].astype(np.int32)), pa.array(to[differ].astype(np.int32))],
                                                 ["rank", "cls"])

        return edges.mapInArrow(tidy(run), "rank int, cls int")

    shared = spark.sparkContext.broadcast(classes)
    for round_ in range(rounds):
        counts, _ = transitions(shared)
        new = decided(shared, counts, round_).toArrow()
        classes = classes.copy()
        classes[new.column("rank").to_numpy()] = new.column("cls").to_numpy()
        shared.unpersist()
        shared = spark.sparkContext.broadcast(classes)
    counts, once = transitions(shared)
    shared.unpersist()
    if own is None:
        return Mapped(vocabulary, classes), counts, once
    return pa.table({"key": key, "n": own.n.astype(np.int64), "cls": classes.astype(np.int32)}), counts, once


def joined(train: DataFrame, words: DataFrame, rounds: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The same by joins, for any number of words."""
    def emit(left, right, n):
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n)], ["left", "right", "n"])

    edges = _bigrams(train, emit, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    edges = written(edges, "class-bigrams")
    end = F.col("key") != END_KEY
    first = words.filter(end).orderBy(F.desc("n"), "key").limit(CLASSES - 2).select("key").collect()
    opens = words.sparkSession.createDataFrame([(k, c) for c, (k,) in enumerate(first, 1)], "key long, cls int")
    classes = words.join(F.broadcast(opens), "key", "left").withColumn(
        "cls", F.when(~end, 0).otherwise(F.coalesce("cls", F.lit(CLASSES - 1))))
    classes = written(classes, "classes")

    def side(word: str, other: str) -> DataFrame:
        facts = classes.select(F.col("key").alias(other), "cls", F.col("n").alias("_rows"))
        return join_counted(edges, facts, [other], "_rows").groupBy(F.col(word).alias("key"), "cls").agg(F.sum("n").alias("n"))

    def neighbours() -> DataFrame:
        both = side("right", "left").withColumn("side", F.lit(0)).unionByName(side("left", "right").withColumn("side", F.lit(1)))
        return written(both.groupBy("key").agg(F.collect_list(F.struct("side", "cls", "n")).alias("near")).join(classes, "key"), "near")

    def transitions(near: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out, once = np.zeros((CLASSES, CLASSES), dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        rows = near.select("cls", (F.col("n") == 1).alias("once"), F.inline("near").alias("side", "to", "m")).filter("side = 1")
        for cls, to, m, single in rows.groupBy("cls", "to").agg(F.sum("m"), F.sum(F.when(F.col("once"), F.col("m")).otherwise(0))).collect():
            out[cls, to] = m
            once[to] += single
        return out, once

    def decide(counts: np.ndarray, round_: int):
        def run(batches):
            for b in batches:
                key, n, cls = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "n", "cls"))
                sums = [np.zeros((len(key), CLASSES)) for _ in (0, 1)]
                for i, near in enumerate(b.column(b.schema.get_field_index("near")).to_pylist()):
                    for x in near:
                        sums[x["side"]][i, x["cls"]] += x["n"]
                to = moved(*sums, n, cls, counts) if len(key) else cls
                to = np.where(turn(key, round_) & (key != END_KEY), to, cls)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(to.astype(np.int32))], ["key", "n", "cls"])
        return run

    near = neighbours()
    for round_ in range(rounds):
        counts, _ = transitions(near)
        classes = written(near.mapInArrow(decide(counts, round_), "key long, n long, cls int"), "classes")
        near = neighbours()
    return classes, *transitions(near)


# the model

@dataclass
class Model:
    """Words with counts and classes, transitions, what follows words seen once, and sums of the training rows."""

    words: pa.Table | Mapped | DataFrame
    counts: np.ndarray
    once: np.ndarray
    total: int
    distinct: int
    discount: float
    types: np.ndarray


def learn(train: DataFrame, rounds: int = ROUNDS, few: int = FEW) -> Model | None:
    """The model of all rows of (text), null texts being empty; None without rows."""
    words = written(word_counts(train), "class-words")
    total, distinct, n1, n2 = words.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")),
                                        F.sum((F.col("n") == 2).cast("long"))).first()
    if not total:
        return None
    table, counts, once = clustered(train, words, distinct, total, rounds) if distinct <= few and total <= FEW_TOKENS else joined(train, words, rounds)
    types = np.zeros(CLASSES)
    if isinstance(table, pa.Table):
        types += np.bincount(table.column("cls").to_numpy(), minlength=CLASSES)
    elif isinstance(table, Mapped):
        types += np.bincount(table.classes, minlength=CLASSES)
    else:
        for cls, n in table.groupBy("cls").count().collect():
            types[cls] = n
    types[0] = 0  # the end is always known
    return Model(table, counts, once, total, distinct, min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9), types)


class Scores:
    """log10 probabilities of texts."""

    def __init__(self, model: Model, table: pa.Table | None, words: Vocabulary | None = None, classes: np.ndarray | None = None):
        if words is None:
            self.keys, self.n, self.cls = (table.column(c).to_numpy() for c in ("key", "n", "cls"))
        else:
            self.keys, self.n, self.cls = words.sorted_keys, words.n, classes
        self.ranks = None if words is None else words.ranks  # counts and classes are by rank, or as the keys are
        totals = model.counts.sum(0).astype(float)
        rows = np.vstack([model.counts, model.once]).astype(float)
        # (class before, or words not seen) x class
        after = (rows + BACK * totals / max(totals.sum(), 1)) / (rows.sum(1, keepdims=True) + BACK)
        given = model.discount * model.types
        self.unknown = np.log10(np.maximum(after @ (given / np.maximum(totals, 1)), 1e-300))
        self.after = np.log10(np.maximum(after, 1e-300))
        self.totals, self.off = np.maximum(totals, 1), np.where(np.arange(CLASSES) == 0, 0.0, model.discount)
        self.total, self.distinct = model.total, model.distinct

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Tokens, known ones, base score and score, by text."""
        key, codes, sizes = tokens(texts)
        at, known = find(self.keys, key)
        if self.ranks is not None:
            at = self.ranks[at]
        n, cls = (np.where(known, x[at].astype(np.int64), y) for x, y in ((self.n, 0), (self.cls, CLASSES))) if len(
            self.keys) else (np.zeros(len(key)), np.full(len(key), CLASSES))
        base = np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        inside = np.minimum(cls, CLASSES - 1)
        emits = np.where(known, np.log10(np.maximum(n - self.off[inside], 1e-300) / self.totals[inside]), 0.0)
        now = cls[codes]
        before = np.concatenate([[0], now[:-1]])  # the end of the text before, or of none
        score = np.where(known[codes], self.after[before, np.minimum(now, CLASSES - 1)] + emits[codes], self.unknown[before])
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)
        return [sizes, add(known[codes].astype(np.int64)), add(base[codes]), add(score)]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    names, schema = ["id", "n_tokens", "n_known", "base_score", "score"], "id long, n_tokens long, n_known long, base_score double, score double"
    if model is None:
        def count(batches):
            for b in batches:
                sizes = np.array([len(t.as_py().split()) + 1 for t in b.column(1)], dtype=np.int64)
                zero = np.zeros(len(sizes))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (sizes, zero.astype(np.int64), zero, zero))], names)

        out, total = rows.mapInArrow(count, schema), 0
    else:
        total, small = model.total, Model(None, *[getattr(model, f) for f in ("counts", "once", "total", "distinct", "discount", "types")])
        run = lambda b, own: pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, own.of(b.column(1)))], names)
        make = lambda table: Scores(small, table)
        if isinstance(model.words, Mapped):
            words, classes = model.words.shared, docs.sparkSession.sparkContext.broadcast(model.words.classes)

            def near_mapped(batches):
                own = Scores(small, None, Vocabulary.opened(words), classes.value)
                for b in batches:
                    for part in text_runs(b, "text", RUN_BYTES):
                        yield run(part, own)

            out = rows.mapInArrow(near_mapped, schema)
        elif isinstance(model.words, pa.Table):
            shared = docs.sparkSession.sparkContext.broadcast(model.words.sort_by("key"))

            def near(batches):
                own = opened(shared, make)
                for b in batches:
                    for part in text_runs(b, "text", RUN_BYTES):
                        yield run(part, own)

            out = rows.mapInArrow(near, schema)
        else:
            out = with_facts(rows, "text", model.words, lambda b: tokens(b.column(1))[0], make, run, schema, few, RUN_BYTES)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      "base_score", "score")


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """Scores all rows with a model of those outside the held-out fold, and says which ones those are."""
    train = docs.filter(fold(id_col) != HELD_OUT).select(F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    out = score(docs, learn(train, rounds, few), id_col, text_col, few)
    return out.withColumn("held_out", fold(id_col) == HELD_OUT)
