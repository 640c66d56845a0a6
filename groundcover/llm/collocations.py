"""Phrase collocations by mergeable Misra-Gries summaries and a second, exact pass.

N-grams of one to three words are hashed to partitions and places within them. A task counts its
own n-grams and ships them, by partition, as one binary summary, whenever it holds ``HELD`` of them.
The summaries of a partition are merged: counts are added, and when there are more counters
than the capacity, the largest count beyond it is taken off all and what is left above zero stays.
With a capacity above the partition's mass divided by the threshold, all that is ever taken off
is less than the threshold, so every n-gram with that many places keeps a counter; counters that
with what was taken off reach the threshold are the survivors. Summaries count a place up to the
threshold, more says nothing here, and two n-grams on one place only add a false survivor.

The second pass counts the survivors by their words, exactly. Up to ``FEW`` survivors are
sent to all executors (``lookup``: many of them in pieces, mapped by the workers), and a task adds up what it counts; more are joined to the distinct n-grams of blocks of texts. What a score needs
of the parts of a phrase occurs at least as often as the phrase, so it is among the survivors.

Defined cases: a null text is empty, a null language ``und``; repeated rows count as often as they
occur; empty texts and tables add nothing. Other columns are not read. Scores are exact while a
phrase has less than 10 ** 15 places, in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lookup
from .common import join_counted
from .lookup import find, mapped, opened, packed, scramble, sorted_by_key, text_runs, unpacked, with_facts
from .memory import tidy
from .store import written

LONGEST, THRESHOLD, TOP = 3, 10, 2000
#: Counters a task holds, mass of a hash partition, bytes of text counted at a time.
HELD, MASS, RUN_BYTES = 2_000_000, 8_000_000, 2_000_000
#: Survivors sent to all executors at most, 8 bytes each, and different n-grams a task counts before it ships them.
FEW, COUNTED = 64_000_000, 1_000_000
#: Bytes of text whose counts meet in one part.
MEET_BYTES = 16_000_000
#: Rows ranked in one task.
RANKED = 200_000
_U = np.uint64
#: Ends pieces; no word holds this byte, because it is not UTF-8.
MARK = b"\xff"
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10)


class Grams:
    """The n-grams of some texts: for each length their starts, and a 64-bit hash of language and words."""

    def __init__(self, batch: pa.RecordBatch):
        words, sizes = [], []
        for t in batch.column(1):
            own = t.as_py().translate(_CLEAN).replace(b"\n", b" \xff ").split()
            own.append(MARK)
            sizes.append(len(own))
            words += own
        self.codes, self.words = pd.factorize(np.array(words, dtype=object))
        lang = batch.column(0).to_pylist()
        of_lang, self.langs = pd.factorize(np.array(lang, dtype=object))
        self.lang = np.repeat(of_lang, sizes)
        word = pd.util.hash_array(self.words, categorize=False)[self.codes]
        is_word = self.codes != self.codes[-1]
        with np.errstate(over="ignore"):
            own = scramble(pd.util.hash_array(self.langs, categorize=False))[self.lang]
            whole, held = own, np.ones(len(word), dtype=bool)
            self.starts, self.hashes = [], []
            for n in range(LONGEST):
                size = max(len(word) - n, 0)
                whole = scramble(whole[:size] * _U(0x9E3779B97F4A7C15) + word[n:])
                held = held[:size] & is_word[n:]
                starts = np.flatnonzero(held)
                self.starts.append(starts)
                self.hashes.append(whole[starts])

    def keys(self, parts: int) -> list[np.ndarray]:
        return [place(h, parts) for h in self.hashes]

    def counted(self, hits: list[np.ndarray]) -> pa.RecordBatch:
        """(lang, phrase, size, n) of the n-grams that ``hits`` marks, counted by their words; size 0 has all words."""
        counts = Counts()
        counts.add(self, hits)
        return counts.shipped()


class Counts:
    """N-grams of many texts counted by their words, which are numbered as they come."""

    def __init__(self):
        self.langs, self.words, self.held, self.size = {}, {}, [], 0

    def add(self, grams: Grams, hits: list[np.ndarray]) -> None:
        lang = _numbers(self.langs, grams.langs)
        used = np.zeros(len(grams.words), dtype=bool)
        for n, (starts, hit) in enumerate(zip(grams.starts, hits), 1):
            for i in range(n):
                used[grams.codes[starts[hit] + i]] = True
        word, wide = np.zeros(len(grams.words), dtype=np.int64), len(grams.words)
        own = np.flatnonzero(used)
        word[own] = _numbers(self.words, grams.words[own]) + 1
        for n, (starts, hit) in enumerate(zip(grams.starts, hits), 1):
            at = starts[hit]
            name, steps = grams.lang[at], []
            for i in range(n):
                name, names = pd.factorize(name * wide + grams.codes[at + i])
                steps.append(names)
            up, codes = np.arange(len(steps[-1])), [np.zeros(len(steps[-1]), dtype=np.int64)] * (LONGEST - n)
            for names in reversed(steps):
                up, code = np.divmod(names[up], wide)
                codes.insert(0, word[code])
            self._hold(lang[up], codes, np.bincount(name, minlength=len(steps[-1])))
        totals = np.bincount(grams.lang[grams.starts[0]], minlength=len(lang))
        self._hold(lang, [np.zeros(len(lang), dtype=np.int64)] * LONGEST, totals)

    def _hold(self, lang: np.ndarray, codes: list[np.ndarray], count: np.ndarray) -> None:
        # two numbers of 32 bits each in one of 64: language and first word, second and third
        self.held.append((lang << 32 | codes[0], codes[1] << 32 | codes[2], count))
        self.size += len(count)

    def merge(self) -> None:
        if len(self.held) < 2:
            return
        first, rest, count = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
        self.held = [(first[new], rest[new], np.add.reduceat(count[order], new))]
        self.size = len(new)

    def shipped(self) -> pa.RecordBatch:
        """What is held, which is then let go."""
        self.merge()
        first, rest, count = self.held[0]
        names, low = pa.array([b"", *self.words], pa.binary()).cast(pa.large_string()), 0xFFFFFFFF
        codes = [first & low, rest >> 32, rest & low]
        size = np.add.reduce([(c > 0).astype(np.int32) for c in codes], dtype=np.int32)
        order = np.argsort(size, kind="stable")
        first, count, size, codes = first[order], count[order], size[order], [c[order] for c in codes]
        ends, phrases = np.searchsorted(size, np.arange(LONGEST + 2)), []
        for n in range(LONGEST + 1):
            words = [names.take(pa.array(c[ends[n]:ends[n + 1]])) for c in codes[:max(n, 1)]]
            phrases.append(words[0] if n < 2 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())))
        phrase = pa.concat_arrays(phrases)
        lang = pa.array(list(self.langs), pa.string()).take(pa.array(first >> 32))
        self.__init__()
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(size), pa.array(count.astype(np.int64))],
                                          ["lang", "phrase", "size", "n"])


def _numbers(known: dict, names: np.ndarray) -> np.ndarray:
    return np.fromiter((known.setdefault(x, len(known)) for x in names), dtype=np.int64, count=len(names))


def place(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition (upper half) and place in it (lower half) of n-gram hashes."""
    return ((hashes >> _U(32)) % _U(parts) << _U(32)) | (hashes & _U(0xFFFFFFFF))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _pack(places: np.ndarray) -> bytes:
    """Sorted 32-bit places as the bytes of their steps, high ones apart, where they are alike."""
    steps = np.diff(places.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32)[:, 0], dtype=np.uint32)


SUMMARY = "part int, kind int, mass long, places binary, counts binary"


def summaries(docs: DataFrame, parts: int, threshold: int) -> DataFrame:
    """Summaries of the n-grams of tasks by partition: kind 0 has the mass, kind 1 places and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(parts, dtype=np.int64)
        keys, counts, held = [], [], 0

        def shipped():
            key, count = _added(keys, counts)
            count = np.minimum(count, threshold).astype(np.int32)
            at = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << _U(32))
            some = np.flatnonzero(np.diff(at))
            for p, a, b in zip(some.tolist(), at[some].tolist(), at[some + 1].tolist()):
                mass[p] += count[a:b].sum()
                yield pa.RecordBatch.from_arrays([
                    pa.array([p], pa.int32()), pa.array([1], pa.int32()), pa.array([0], pa.int64()),
                    pa.array([_pack(key[a:b] & _U(0xFFFFFFFF))], pa.binary()),
                    pa.array([count[a:b].astype(np.uint8 if threshold < 256 else np.int32).tobytes()], pa.binary())],
                    ["part", "kind", "mass", "places", "counts"])

        for b in batches:
            for texts in text_runs(b, "text", RUN_BYTES):
                key, count = np.unique(np.concatenate(Grams(texts).keys(parts)), return_counts=True)
                keys.append(key)
                counts.append(count.astype(np.int32))
                held += len(key)
                if held > HELD:
                    yield from shipped()
                    keys, counts, held = [], [], 0
        if keys:
            yield from shipped()
        some = np.flatnonzero(mass)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), dtype=np.int32)),
                                          pa.array(mass[some]), none, none], ["part", "kind", "mass", "places", "counts"])

    return docs.mapInArrow(tidy(run), SUMMARY)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; no count is too low by more than ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.places, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def merge(self, places: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.places, self.counts = _added([self.places, *places], [self.counts, *counts])
        if len(self.places) > self.capacity:
            beyond = len(self.places) - self.capacity - 1
            off = int(np.partition(self.counts, beyond)[beyond])
            self.lost += off
            left = self.counts > off
            self.places, self.counts = self.places[left], self.counts[left] - off


def survivors(summed: DataFrame, threshold: int) -> DataFrame:
    """(key): partition and place of every n-gram that may occur ``threshold`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, held, size = None, 0, None, ([], []), 0

        def merged():
            nonlocal summary, held, size
            summary = summary or Summary(mass // threshold + 1)
            if size:
                summary.merge(*held)
                held, size = ([], []), 0

        def ended():
            merged()
            keep = summary.places[summary.counts + summary.lost >= threshold].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keep | (part << 32))], ["key"])

        for b in batches:
            for p, kind, m, places, counts in zip(*[c.to_pylist() for c in b.columns]):
                if p != part:
                    if part is not None:
                        yield ended()
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                    continue
                held[0].append(_unpack(places))
                held[1].append(np.frombuffer(counts, dtype=np.uint8 if threshold < 256 else np.int32).astype(np.int64))
                size += len(held[0][-1])
                if size > mass // threshold + 1:
                    merged()
        if part is not None:
            yield ended()

    # the mass of a partition comes before its summaries, so the capacity is known when they are merged
    return summed.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), "key long")


class Survivors:
    """Sorted keys, and a table by their last bits, in which few others are."""

    def __init__(self, table: pa.Table | None, arrays: dict[str, np.ndarray] | None = None):
        made = arrays or self.arrays(table.column("key").to_numpy())
        self.keys, self.some = made["keys"], made["some"]

    @staticmethod
    def arrays(keys: np.ndarray) -> dict[str, np.ndarray]:
        keys = keys.view(np.uint64)
        some = np.zeros(max(1 << 22, 1 << (4 * len(keys)).bit_length()), dtype=bool)
        some[keys & _U(len(some) - 1)] = True
        return {"keys": keys, "some": some}

    def hits(self, keys: np.ndarray) -> np.ndarray:
        out = self.some[keys & _U(len(self.some) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = find(self.keys, keys[at])[1]
        return out


def frequent(docs: DataFrame, threshold: int = THRESHOLD, lang_col: str = "lang", text_col: str = "text", few: int = FEW,
             mass: int = MASS) -> DataFrame:
    """(lang, phrase, size, n): every n-gram with ``threshold`` places, and words in all by language at size 0."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # a word takes two bytes at least, so a partition has its mass at most, but for places of one n-gram
    parts = max(1, -(-size * LONGEST // (2 * mass)))
    kept = written(survivors(summaries(rows, parts, threshold), threshold), "collocation-survivors")
    left, schema = kept.limit(few + 1).count(), "lang string, phrase string, size int, n long"
    if left > few:
        exact = with_facts(rows, "text", kept, lambda b: np.concatenate(Grams(b).keys(parts)).view(np.int64), Survivors,
                           lambda b, own: (g := Grams(b)).counted([own.hits(k) for k in g.keys(parts)]), schema, few, RUN_BYTES)
    else:
        if left > lookup.FEW_OPENED:
            shared = packed(kept, "key")
            open_ = lambda: mapped(shared, lambda raw: Survivors.arrays(*unpacked(raw)), lambda made: Survivors(None, made))
        else:
            shared = docs.sparkSession.sparkContext.broadcast(sorted_by_key(kept.toArrow()))
            open_ = lambda: opened(shared, Survivors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, counts, most = open_(), Counts(), COUNTED
            for b in batches:
                for part in text_runs(b, "text", RUN_BYTES):
                    grams = Grams(part)
                    counts.add(grams, [own.hits(k) for k in grams.keys(parts)])
                    if counts.size > most:
                        counts.merge()
                        most = max(COUNTED, 2 * counts.size)
                        if counts.size > COUNTED // 2:
                            yield counts.shipped()
                            most = COUNTED
            if counts.size:
                yield counts.shipped()

        meet = max(1, -(-size // MEET_BYTES))
        shipped = rows.mapInArrow(tidy(lambda batches: dealt(run(batches), meet)), "part int, rows binary")
        exact = shipped.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(added_up), schema)
    if left > few:
        exact = exact.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return written(exact.filter((F.col("n") >= threshold) | (F.col("size") == 0)), "collocation-counts")


def dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, rows): the counts of a task by hash of phrase and language, as compressed bytes."""
    for b in batches:
        own = pd.util.hash_array(b.column(1).to_numpy(zero_copy_only=False), categorize=False)
        own ^= scramble(pd.util.hash_array(b.column(0).to_numpy(zero_copy_only=False)))
        own = (own >> _U(32)) * _U(parts) >> _U(32)
        order = np.argsort(own, kind="stable")
        own, b = own[order], b.take(pa.array(order))
        some, starts = np.unique(own, return_index=True)
        ends = [*starts[1:].tolist(), len(own)]
        raw = []
        for start, end in zip(starts.tolist(), ends):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b.slice(start, end - start))
            raw.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw, pa.binary())], ["part", "rows"])


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the parts, each added up; a part's rows come one after another."""
    part, held, size, most = None, [], 0, HELD

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "size", "n"])

    for b in batches:
        for own, rows in zip(b.column(0).to_pylist(), b.column(1)):
            if own != part and held:
                yield from merged().to_batches()
                held, size, most = [], 0, HELD
            part = own
            held.append(pa.ipc.open_stream(rows.as_buffer()).read_all())
            size += held[-1].num_rows
            if size > most:
                held = [merged()]
                size = held[0].num_rows
                most = max(HELD, 2 * size)
    if held:
        yield from merged().to_batches()


def _words(phrase: str, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): the lowest-scoring cut of every phrase of two words or more."""
    grams = counts.filter("size > 0")
    cuts = grams.filter("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", F.col("n").alias("a"), "k", _words("phrase", F.lit(1), F.col("k")).alias("first"),
                       _words("phrase", F.col("k") + 1, F.lit(LONGEST)).alias("rest"))

    def part(name: str, value: str) -> DataFrame:
        # a part with n places begins or ends at most n phrases of either length
        return grams.filter(F.col("size") < LONGEST).select(
            "lang", F.col("phrase").alias(name), F.col("n").alias(value), (2 * F.col("n")).alias("_rows"))

    cuts = join_counted(cuts, part("first", "l"), ["lang", "first"], "_rows").drop("_rows")
    cuts = join_counted(cuts, part("rest", "r"), ["lang", "rest"], "_rows").drop("_rows")
    cuts = cuts.withColumn("score", F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
                                           " div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def without_parts(phrases: DataFrame, pct: int = 50) -> DataFrame:
    """Phrases that are not, for the most part, parts of a longer candidate."""
    longer = phrases.filter(F.col("size") > 2).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.col("size") - 2)))
    inner = longer.select("lang", F.col("a").alias("by"), _words("phrase", F.col("k") + 1, F.lit(2)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    return phrases.join(inner, ["lang", "phrase"], "left").filter(
        (F.col("size") > 2) | F.col("by").isNull() | (100 * F.col("by") < pct * F.col("a"))).drop("by")


def top_by(rows: DataFrame, by: str, order: list[Column], salted: Column, top: int, ranked: int = RANKED) -> DataFrame:
    """The first ``top`` rows of each ``by``, with ``rank``; found in stages, so no task ranks many more than ``ranked`` rows."""
    salts = -(-rows.count() // ranked)
    while salts > 1:
        near = W.partitionBy(by, "_salt").orderBy(*order)
        rows = rows.withColumn("_salt", F.pmod(salted, F.lit(salts))).withColumn(
            "rank", F.row_number().over(near)).filter(F.col("rank") <= top).drop("rank", "_salt")
        salts = min(-(-salts * top // ranked), salts - 1)
        if salts > 1:
            rows = cut_lineage(rows)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, **options) -> DataFrame:
    """Each language's first phrases: (lang, rank, phrase, a, l, r, n, score)."""
    counts = frequent(docs, threshold, **options)
    phrases = cut_lineage(without_parts(cut_lineage(scored(counts))))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = top_by(phrases, "lang", order, F.xxhash64("phrase"), top)
    totals = counts.filter("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
