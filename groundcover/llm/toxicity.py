"""Toxicity by class-conditional Kneser-Ney models.

Two language models, of toxic and of ordinary texts, are learnt from labelled
rows; a text's score compares its log-likelihoods under both, divided by its
length, and a logistic curve, fitted on labelled rows the models have not seen,
turns that into a probability.

Each model interpolates pairs of words with words and words with stems (their
first letters), all with absolute discounting; words and stems are weighed by the
number of contexts they occur in. What a class has never seen falls back to
counts that both classes share, with a weight that both share, so a rare
expression says little either way. A word's ratio counts as far as it exceeds the
text's median ratio by more than chance would; the mean of that over the text is
what the curve reads, beside the plain mean.
Pairs, words and stems are counted by 64-bit hashes in Spark tables that grow with the
vocabulary, so unrelated ones do not share a count; up to ``FEW_WORDS`` distinct words are numbered, and
their pairs are counted in compressed blocks (``pair_counts``), with the same result. The model is a table of log-likelihood
ratios by these hashes, without those that follow from the level below. Up to ``FEW_ENTRIES``
entries are sent to all executors (``lookup``: large ones in pieces, mapped by the workers); more are joined to the
distinct words and pairs of blocks of texts, with frequent keys joined apart.

Class counts are over every labelled row outside the held-out fold; the counts that both
classes share, and the weights that lead to them, over all documents, labelled or not. Only the
points of the curve are a bounded sample: at most about ``max_rows`` labelled rows of its fold,
chosen by the hash of their id. The curve is fitted with models that leave these out, the scores
are from models that count them too. Few labels are broadcast. Only the text is scored;
labels, ids, sources and languages are not inputs.

Defined cases: a null text counts as empty; a text without letters has the score
of the curve at zero evidence; ids labelled twice count as toxic if any label
says so; null labels are left out; without labels of both classes the score is
0.0 everywhere. ``score`` keeps every input column and replaces ``score``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import cut_lineage
from . import lookup, pair_counts
from .columns import squeezed, unsqueezed
from .common import if_few, join_counted
from .lookup import Shared, find, mapped, opened, pieces
from .memory import given_back
from .store import written

STEM_LETTERS = 5
#: Taken off every count and given to the level below: what occurs once or twice is evidence of nothing.
DISCOUNT = 2
CHANCE = 2.0
#: Texts with at least this score count as toxic.
REJECT = 0.3
MAX_ROWS = 200_000
#: A row of one hash in four is kept from the models, and one for the curve.
FOLDS, HELD_OUT, CURVE = 4, 2, 3
_WORDS = re.compile(r"[^\W\d_]+")
#: Words counted at a time and scored at a time, and pairs a training task holds before it adds them up.
BLOCK, SCORED, PAIRS_HELD = 250_000, 50_000, 400_000
#: Characters of a text whose letters are looked up at once, in eight bytes each.
LOOKED_UP = 1 << 20
#: Entries of the model that are sent to all executors at most; a larger model is joined.
FEW_ENTRIES = 64_000_000
#: Words that are numbered and broadcast at most, and tokens whose pairs are counted by blocks of these.
FEW_WORDS, FEW_TOKENS = 64_000_000, 2_000_000_000
#: Letters of the texts that look their entries up together when the model is joined.
LOOK_UP = 4_000_000
#: What an entry of the model is about.
PAIR, WORD, STEM, CONTEXT = range(4)
_U = np.uint64


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _hash(values: list[str] | np.ndarray) -> np.ndarray:
    return pd.util.hash_array(np.asarray(values, dtype=object), categorize=False).view(np.int64)


def _hash_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for two long columns."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                          0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << _U(n)) | (x >> _U(64 - n))
    h = np.full(len(first), 42, dtype=_U)
    for x in (first, second):
        h = turn((h + p5 + _U(8)) ^ (turn(x.view(_U) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        h ^= h >> _U(32)
    return h.view(np.int64)


class _Letters(dict):
    """For ``str.translate``: letters stay, anything else becomes a blank; characters are looked at once."""

    def __missing__(self, code: int) -> int:
        self[code] = code if _WORDS.match(chr(code)) else 32
        return self[code]


_LETTERS = _Letters()


@cache
def _letter_table() -> np.ndarray:
    """``_LETTERS`` of all characters of two bytes."""
    return np.array([_LETTERS[c] for c in range(1 << 16)], dtype=np.uint32)


def _letters(text: str) -> str:
    """The text in lower case with a blank for what is no letter; ``translate`` is slow after the first character beyond ASCII."""
    low = text.lower()
    if low.isascii() or len(low) > LOOKED_UP:
        return low.translate(_LETTERS)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if codes.max() >= 1 << 16:
        return low.translate(_LETTERS)
    return _letter_table()[codes].tobytes().decode("utf-32-le")


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and of their stems, every token's place there, the word before it (0 for none), tokens by text."""
    words, sizes = [], []
    for t in texts:
        w = _letters(t).split()
        sizes.append(len(w))
        words += w
    sizes = np.array(sizes, dtype=np.int64)
    if not words:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, sizes
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    word, stem = _hash(uniques), _hash([u[:STEM_LETTERS] for u in uniques])
    before = np.empty(len(codes), dtype=np.int64)
    before[1:] = word[codes[:-1]]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 0
    return word, stem, codes, before, sizes


def _blocks(texts: Iterator[str], words: int | None = None) -> Iterator[list[str]]:
    """Texts in runs of a bounded number of characters (one long text is a run)."""
    run, held, most = [], 0, 6 * (words or BLOCK)
    for t in texts:
        run.append(t)
        held += len(t)
        if held > most:
            yield run
            run, held = [], 0
    if run:
        yield run


#: Counts of a pair: in texts that every model counts, by class, in those that make the curve's points, and in all texts.
COUNTS = ("ordinary", "toxic", "ordinary_point", "toxic_point", "n")


def _add_up(held: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """One entry of each key: (key, kind, a, b, counts)."""
    key, kind, a, b, *counts = (np.concatenate(x) for x in zip(*held))
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    sums = [np.bincount(at, weights=c, minlength=len(key)).astype(np.int64) for c in counts]
    return [(key, kind[first], a[first], b[first], *sums)]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) rows to counts of (0, preceding word, word) and to (1, stem, word), added up within the task.

    ``label`` is the place in ``COUNTS``; texts without one count in neither class.
    """
    held, size = [], 0

    def emit(parts):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0][1:]], ["kind", "a", "b", *COUNTS])

    for batch in batches:
        labels = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], dtype=np.int64)
        at = 0
        for run in _blocks(t.as_py() or "" for t in batch.column(0)):
            word, stem, codes, before, sizes = _tokens(run)
            label = np.repeat(labels[at:at + len(run)], sizes)
            at += len(run)
            if not len(word):
                continue
            after, none = word[codes], np.zeros(len(word), dtype=np.int64)
            held += _add_up([(_hash_pairs(before, after), np.zeros(len(codes), dtype=np.int32), before, after,
                              *[label == c for c in range(4)], np.ones(len(codes)))])
            size += len(held[-1][0]) + len(word)
            held.append((_hash_pairs(word, ~stem), np.ones(len(word), dtype=np.int32), stem, word, *[none] * 5))
            if size > PAIRS_HELD:
                held = _add_up(held)
                size = len(held[0][0])
                if size > PAIRS_HELD // 2:
                    yield emit(held)
                    held, size = [], 0
    if held:
        yield emit(_add_up(held))


def count_tables(train: DataFrame) -> DataFrame:
    """Counts by full hashes from rows of (text, label): (kind, key, other, o0, t0, o1, t1, every, off, stem).

    o0 and t0 leave out the curve's points, o1 and t1 are over all labelled texts. Words: distinct
    words before them, by class and in all texts. Contexts: counts above the discount by class,
    counts in all texts, and what is taken off of these. Pairs (``other`` is the word): counts by
    class. Contexts and pairs of which the discount leaves no class anything are left out,
    because nothing is learnt from them.
    """
    pairs = train.select("text", "label").mapInArrow(_count_pairs, "kind int, a long, b long, " + ", ".join(f"{c} long" for c in COUNTS))
    pairs = pairs.groupBy("kind", "a", "b").agg(*[F.sum(c).alias(c) for c in COUNTS])
    classes = [F.col("ordinary"), F.col("toxic"), F.col("ordinary") + F.col("ordinary_point"), F.col("toxic") + F.col("toxic_point")]
    zero, names = F.lit(0).cast("long"), ("o0", "t0", "o1", "t1", "every", "off")

    def row(kind, key, other, *counts, stem=F.lit(None).cast("long")):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), other.alias("other"),
                        *[c.cast("long").alias(n) for c, n in zip(counts, names)], stem.alias("stem"))

    pair, above = F.col("kind") == 0, [F.greatest(c - DISCOUNT, zero) for c in classes]
    every = F.array_compact(F.array(
        F.when(pair, row(WORD, F.col("b"), zero, *[c > 0 for c in classes], F.lit(1), zero)),
        F.when(~pair, row(WORD, F.col("b"), zero, *[zero] * 6, stem=F.col("a"))),
        F.when(pair, row(CONTEXT, F.col("a"), zero, *above, F.col("n"), F.least(F.col("n"), F.lit(DISCOUNT)))),
        F.when(pair & (F.greatest(*above) > 0), row(PAIR, F.col("a"), F.col("b"), *classes, zero, zero))))
    counts = pairs.select(F.inline(every)).groupBy("kind", "key", "other").agg(
        *[F.sum(c).alias(c) for c in names], F.max("stem").alias("stem"))
    return counts.filter((F.col("kind") != CONTEXT) | (F.col("o1") + F.col("t1") > 0))


def _numbered_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_tokens``, with the place of the word before plus 1 (0 for none) and not its hash."""
    word, stem, codes, _, sizes = _tokens(texts)
    return word, stem, codes, _places(codes, sizes), sizes


def _places(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.concatenate([[0], codes[:-1] + 1]) if len(codes) else codes
    place[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return place


def counted(train: DataFrame, few: int | None = None) -> DataFrame:
    """The counts of ``count_tables``: from blocks of numbered words where these are few, else by joins of full hashes."""
    few = FEW_WORDS if few is None else few
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = written(pair_counts.vocabulary(train, _numbered_tokens, _blocks, max(1, size // pair_counts.WORD_BYTES)), "toxicity-vocabulary")
    distinct, total = words.agg(F.sum("distinct"), F.sum("total")).first()
    if not distinct or distinct > few or total > FEW_TOKENS:
        return count_tables(train)
    return pair_counts.count_blocks(train, words, distinct, total, _numbered_tokens, _blocks, (PAIR, WORD, CONTEXT), DISCOUNT)


def _left(c: str) -> Column:
    return F.greatest(F.col(c) - DISCOUNT, F.lit(0))


def _shares(counts: DataFrame, every: str, *more: Column) -> tuple[list[Column], float, list]:
    """Shares of the counts above the discount, by class, the weight left to the level below (as all texts have it), and more sums."""
    sums = counts.agg(F.sum(every), F.sum(_left(every)), F.sum(_left("ordinary")), F.sum(_left("toxic")), *more).first()
    seen, left, *kept = [x or 0 for x in sums]
    back = max(1 - left / max(seen, 1), 1e-3)
    return [(1 - back) * _left(c) / max(k, 1) for c, k in zip(("ordinary", "toxic"), kept)], back, kept[2:]


def log_ratios(counts: DataFrame, points: bool) -> DataFrame | None:
    """The model: (kind, key, value) by 64-bit keys, as many as the texts have; None without texts of both classes.

    With ``points``, the class counts have the curve's points too. ``value`` is the log-likelihood
    ratio of a pair, of a word alone and of a stem, and for a context what it adds to its word when
    the pair has no entry. What is not there is 0 or falls to the next level, exactly as if it were
    written out.
    """
    counts = counts.withColumnsRenamed({f"o{int(points)}": "ordinary", f"t{int(points)}": "toxic"})
    words = counts.filter(F.col("kind") == WORD)
    own, word_back, seen = _shares(words, "every", F.sum("ordinary"), F.sum("toxic"))
    if not all(seen):
        return None
    stems = written(words.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.sum("every").alias("every"),
        F.sum(F.expr("int(toxic + ordinary > 0)")).alias("n")), "toxicity-stems")
    stem_own, stem_back, (total,) = _shares(stems, "every", F.sum(F.col("every") + 1))
    stems = stems.select("stem", (F.col("every") + 1).alias("stem_all"), "n", (_left("toxic") + _left("ordinary") > 0).alias("some"),
                         *[(x + stem_back * (F.col("every") + 1) / total).alias(f"s{c}") for c, x in enumerate(stem_own)])
    inside = F.least((F.col("every") + 1) / F.col("stem_all"), F.lit(1.0))
    words = join_counted(words.filter("toxic + ordinary > 0"), stems.filter("n > 0"), ["stem"], "n").select(
        F.col("key").alias("word"), "every", (_left("toxic") + _left("ordinary") > 0).alias("some"),
        *[(x + word_back * F.col(f"s{c}") * inside).alias(f"p{c}") for c, x in enumerate(own)])
    words = written(words, "toxicity-words")
    contexts = counts.filter((F.col("kind") == CONTEXT) & (F.col("ordinary") + F.col("toxic") > 0)).select(
        F.col("key").alias("before"), F.col("ordinary").alias("k0"), F.col("toxic").alias("k1"),
        (F.col("off") / F.col("every")).alias("back"), F.col("every").alias("n"))
    pairs = counts.filter(F.col("kind") == PAIR).select(F.col("key").alias("before"), F.col("other").alias("word"),
                                                        F.col("ordinary").alias("o0"), F.col("toxic").alias("o1")).filter(F.greatest("o0", "o1") > DISCOUNT)
    pairs = join_counted(join_counted(pairs, words.drop("some"), ["word"], "every"), contexts, ["before"], "n")
    with_own = [F.when(F.col(f"k{c}") > 0, (1 - F.col("back")) * F.greatest(F.col(f"o{c}") - DISCOUNT, F.lit(0))
                       / F.col(f"k{c}") + F.col("back") * F.col(f"p{c}")).otherwise(F.col(f"p{c}")) for c in (0, 1)]
    one = (F.col("k1") > 0).cast("int") - (F.col("k0") > 0).cast("int")
    parts = [(PAIR, pairs, F.xxhash64("before", "word"), F.log(with_own[1] / with_own[0])),
             (WORD, words.filter("some"), F.col("word"), F.log(F.col("p1") / F.col("p0"))),
             (STEM, stems.filter("some"), F.col("stem"), F.log(F.col("s1") / F.col("s0"))),
             (CONTEXT, contexts.filter(one != 0), F.col("before"), one * F.log("back"))]
    out = [df.select(F.lit(k).alias("kind"), key.alias("key"), value.alias("value")) for k, df, key, value in parts]
    return written(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]), "toxicity-model")


def _compressed(model: DataFrame) -> DataFrame:
    """The entries as (kind, least key, size, steps of the sorted keys, values), about 14 bytes each, as the driver passes them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, key, value = (c.to_numpy() for c in b.columns)
            for k in np.unique(kind).tolist():
                own = np.flatnonzero(kind == k)
                steps = np.diff(key[own].view(_U), prepend=key[own[:1]].view(_U))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(key[own[0]])]), pa.array([len(own)]),
                                                  pa.array([squeezed(steps)], pa.binary()), pa.array([value[own].tobytes()], pa.binary())],
                                                 ["kind", "least", "size", "steps", "data"])

    return model.select("kind", "key", "value").orderBy("kind", "key").mapInArrow(
        run, "kind int, least long, size long, steps binary, data binary")


class Entries:
    """Entries of the model, all or those that some texts need."""

    def __init__(self, of: list[tuple[np.ndarray, np.ndarray]], some: np.ndarray | None = None):
        self.of = of
        # most pairs of a text have no entry, and few of those pass here
        self.some = self.pairs(of[PAIR][0]) if some is None else some

    @staticmethod
    def pairs(keys: np.ndarray) -> np.ndarray:
        some = np.zeros(max(1 << 22, 1 << (2 * len(keys)).bit_length()), dtype=bool)
        some[keys & (len(some) - 1)] = True
        return some

    @classmethod
    def of_table(cls, table: pa.Table) -> Entries:
        table = table.sort_by([("kind", "ascending"), ("key", "ascending")])
        kind, key, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
        bounds = np.searchsorted(kind, range(5))
        return cls([(key[a:b], value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])

    @classmethod
    def of_parts(cls, parts: list[tuple[int, int, int, bytes, bytes]]) -> Entries:
        of = []
        for k in range(4):
            keys = [np.cumsum(unsqueezed(steps)[0]) + least for kind, least, _, steps, _ in parts if kind == k]
            values = [np.frombuffer(data, dtype=float) for kind, _, _, _, data in parts if kind == k]
            of.append(tuple(np.concatenate([np.zeros(0, dtype=t), *x]) for t, x in ((np.int64, keys), (float, values))))
        return cls(of)

    @classmethod
    def opened(cls, shared) -> Entries:
        if not isinstance(shared, Shared):
            return opened(shared, cls.of_parts)
        return mapped(shared, cls.arrays, lambda made: cls([(made[f"key{k}"], made[f"value{k}"]) for k in range(4)], made["some"]))

    @classmethod
    def arrays(cls, parts: Iterator) -> dict[str, np.ndarray]:
        """From pieces in any order; before them are all (kind, least key, size) in order, which say where a piece belongs."""
        at, ends = {}, [0] * 4
        for kind, least, size in next(parts):
            at[kind, least] = ends[kind]
            ends[kind] += size
        made = {f"key{k}": np.empty(n, dtype=np.int64) for k, n in enumerate(ends)} | {f"value{k}": np.empty(n) for k, n in enumerate(ends)}
        for kind, least, size, steps, data in parts:
            own = slice(at[kind, least], at[kind, least] + size)
            made[f"key{kind}"][own] = np.cumsum(unsqueezed(steps)[0]) + least
            made[f"value{kind}"][own] = np.frombuffer(data, dtype=float)
        return made | {"some": cls.pairs(made[f"key{PAIR}"])}

    def get(self, kind: int, keys: np.ndarray, otherwise: np.ndarray | float = 0.0) -> np.ndarray:
        names, values = self.of[kind]
        if not len(names):
            return np.zeros(len(keys)) + otherwise
        at, there = find(names, keys)
        return np.where(there, values[at], otherwise)

    def evidence(self, texts: list[str]) -> np.ndarray:
        """By text: mean log-likelihood ratio, its part beyond chance for pairs and for words alone, number of words.

        Ratios are taken from the text's median ratio, which is where its language and
        subject put it; what exceeds it by no more than ``CHANCE`` may be an accident of
        the sample.
        """
        word, stem, codes, before, sizes = _tokens(texts)
        out = np.zeros((len(texts), 4))
        out[:, 3] = sizes
        if not len(word):
            return out
        alone = self.get(WORD, word, self.get(STEM, stem))[codes]
        first = np.concatenate([[0], word])
        place = _places(codes, sizes)
        starts = np.cumsum(sizes) - sizes
        some = sizes > 0
        both, pair = alone + self.get(CONTEXT, first)[place], _hash_pairs(before, word[codes])
        near = np.flatnonzero(self.some[pair & (len(self.some) - 1)])
        both[near] = self.get(PAIR, pair[near], both[near])
        text = np.repeat(np.arange(len(texts)), sizes)
        add = lambda x: np.add.reduceat(x, starts[some]) / sizes[some]
        for i, ratio in ((1, both), (2, alone)):
            median = np.zeros(len(texts))
            if len(text) > 64 * len(texts):  # the same order statistic, in one sort or text by text
                for j in np.flatnonzero(some).tolist():
                    half = (sizes[j] - 1) // 2
                    median[j] = np.partition(ratio[starts[j]:starts[j] + sizes[j]], half)[half]
            else:
                order = np.lexsort((ratio, text))
                median[some] = ratio[order[(starts + (sizes - 1) // 2)[some]]]
            beyond = ratio - median[text]
            out[some, i] = add(np.maximum(beyond - CHANCE, 0))
            if i == 2:
                out[some, 0] = add(beyond)
        return out


def _features(evidence: np.ndarray) -> np.ndarray:
    """Evidence per word, and what is beyond chance also against the length; all bounded."""
    mean, beyond, n = evidence[:, :1], evidence[:, 1:3], np.maximum(evidence[:, 3:], 1)
    return np.hstack([np.ones((len(evidence), 1)), np.clip(10 * mean, -4, 4), np.minimum(50 * beyond, 5),
                      np.minimum(beyond * np.sqrt(n), 5)])


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic curve by Newton steps with a small ridge."""
    x = _features(evidence)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (label - p) - 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Scorer:
    """The model, its entries as a broadcast table or as pieces of one unless they are very many, and the curve."""

    model: DataFrame
    shared: object | None
    curve: np.ndarray | None = None

    @classmethod
    def of(cls, model: DataFrame, curve: np.ndarray | None = None) -> Scorer:
        size, spark = model.count(), model.sparkSession
        if size > FEW_ENTRIES:
            return cls(model, None, curve)
        parts = _compressed(model)
        if size <= lookup.FEW_OPENED:
            return cls(model, spark.sparkContext.broadcast(sorted(tuple(r) for r in parts.collect())), curve)
        parts = written(parts, "toxicity-parts")
        places = sorted(tuple(r) for r in parts.select("kind", "least", "size").collect())
        return cls(model, Shared(spark, chain([[places]], pieces(parts))), curve)


def _rated(entries: Entries, texts: Iterator[str], curve: np.ndarray | None) -> list:
    """Scores of the texts; without a curve, their evidence."""
    out = []
    for run in _blocks(iter(texts), SCORED):
        x = entries.evidence(run)
        out += (x if curve is None else 1 / (1 + np.exp(-np.clip(_features(x) @ curve, -30, 30)))).tolist()
    return out


def label_rows(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, toxic, for the curve): every labelled id outside the held-out fold once.

    About ``max_rows`` rows of the curve's fold, chosen by hash, make its points; all others are counted.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).alias("_lid")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = cut_lineage(rows.withColumn("_fold", fold("_lid")).filter(F.col("_fold") != HELD_OUT))
    part = min(1, max_rows / max(rows.filter(F.col("_fold") == CURVE).count(), 1))
    sampled = F.pmod(F.xxhash64("_lid", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * part)
    return rows.select("_lid", "toxic", ((F.col("_fold") == CURVE) & sampled).alias("_curve"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Scorer | None:
    """Models and curve; None without both classes.

    Class counts are over all labelled rows but the held-out fold, and the counts that both classes
    share over all documents. The curve is fitted with models that have not seen its points.
    """
    chosen = label_rows(labels, id_col, label_col, max_rows)
    texts = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).alias("text"))
    # a null id has no label: kept out of the join, where all of them would meet in one task
    known = texts.filter("_lid IS NOT NULL").join(if_few(chosen), "_lid", "left")
    label = F.col("toxic") + F.when(F.col("_curve"), 2).otherwise(0)
    counts = written(counted(known.select("text", label.alias("label")).unionByName(
        texts.filter("_lid IS NULL").select("text", F.lit(None).cast("int").alias("label")))), "toxicity-counts")
    model = log_ratios(counts, points=False)
    if model is None:
        return None
    unseen = texts.join(F.broadcast(chosen.filter("_curve")), "_lid").select("text", F.col("toxic").cast("double").alias("toxic"))
    first = Scorer.of(model)
    points = rated(unseen, first, "text", "evidence").select("toxic", "evidence").toArrow()  # about max_rows, and so are the broadcast labels
    if first.shared is not None:
        first.shared.destroy()
    toxic = points.column("toxic").to_numpy()
    if len(np.unique(toxic)) < 2:
        return None
    curve = fit_curve(points.column("evidence").combine_chunks().flatten().to_numpy().reshape(len(toxic), -1), toxic)
    return Scorer.of(log_ratios(counts, points=True), curve)


def rated(df: DataFrame, scorer: Scorer, text_col: str, name: str) -> DataFrame:
    """Adds the scores, or without a curve the evidence; a model that is not broadcast is joined."""
    shared, curve = scorer.shared, scorer.curve
    kind = "array<double>" if curve is None else "double"
    if shared is None:
        return _rated_by_join(df, scorer, text_col, name, kind)

    made = pa.list_(pa.float64()) if curve is None else pa.float64()

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        entries = Entries.opened(shared)
        given_back()  # what opening took besides
        for texts in batches:
            # one text at a time becomes a string, and few are held together
            yield pa.array(_rated(entries, (t.as_py() or "" for t in texts), curve), made)
            del texts
            given_back()

    return df.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def _rated_by_join(df: DataFrame, scorer: Scorer, text_col: str, name: str, kind: str) -> DataFrame:
    """Texts in blocks of about ``LOOK_UP`` letters; each block meets the entries of its own words and pairs."""
    curve, block = scorer.curve, "_block"
    while block in map(str.lower, df.columns):  # a name that no input column has
        block += "_"
    with_block = StructType([*df.schema.fields, StructField(block, LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy()
            ends = held + np.cumsum(sizes, dtype=np.int64)
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + ends // LOOK_UP)], [*b.schema.names, block])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy()
            texts = [t.as_py() or "" for t in b.column(0)]
            for n in np.unique(own):
                for run in _blocks(texts[i] for i in np.flatnonzero(own == n)):
                    word, stem, codes, before, _ = _tokens(run)
                    if not len(word):
                        continue
                    pair = np.unique(_hash_pairs(before, word[codes]))
                    first = np.concatenate([[0], word])
                    parts = [(PAIR, pair), (WORD, word), (STEM, np.unique(stem)), (CONTEXT, first)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(sum(len(k) for _, k in parts), n)),
                         pa.array(np.repeat(np.array([k for k, _ in parts], dtype=np.int32), [len(k) for _, k in parts])),
                         pa.array(np.concatenate([k for _, k in parts]))], ["_block", "kind", "key"])

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        own = Entries.of_table(entries)
        out = _rated(own, (t.as_py() or "" for t in texts.column(text_col)), curve)
        made = pa.array(out, pa.list_(pa.float64()) if curve is None else pa.float64())
        return texts.drop_columns([block]).append_column(name, made)

    rows = written(df.mapInArrow(number, with_block), "toxicity-blocks")
    # what is read back may be null in all its fields, and the result is compared with that
    kept = [f for f in rows.schema.fields if f.name != block]
    asked = written(rows.select(text_col, block).mapInArrow(keys, "_block long, kind int, key long").distinct(), "toxicity-keys")
    facts = cut_lineage(asked.groupBy("kind", "key").agg(F.count("*").alias("n")).join(scorer.model, ["kind", "key"]))
    found = join_counted(asked, facts, ["kind", "key"], "n").select("_block", "kind", "key", "value")
    schema = StructType([*kept, StructField(name, ArrayType(DoubleType()) if curve is None else DoubleType())])
    return rows.groupBy(block).cogroup(found.groupBy("_block")).applyInArrow(run, schema)


def score(df: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """Adds ``score``, the probability that a text is toxic."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "score"])
    if scorer is None:
        return kept.withColumn("score", F.lit(0.0))
    return rated(kept, scorer, text_col, "score")
