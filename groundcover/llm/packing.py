"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised and cut where they lie; only the count of pieces by length
travels: at most ``width`` numbers. On these counts bins are filled one after the
other: the longest remaining piece, then the subset of the available lengths that
leaves the least slack, found by a subset-sum over a bitset. A combination is
taken as often as the counts allow, so the number of combinations depends on the
width alone: every run leaves one of its lengths with fewer pieces than the run
needs, at most width / length, so there are at most the sum over lengths of
1 + width / length runs, about 9,000 for 1,024. The plan is therefore small enough
to send to all tasks. Pieces are numbered within their length without sorting:
by partition and place there, with the counts of earlier partitions added.

Defined cases: a null or empty text is one piece that holds the end id alone;
repeated rows are packed one by one; a null id stays null. Only the columns named
in ``pack`` come back. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lookup import let_go, text_runs
from .memory import tidy

WIDTH, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
#: Words whose ids a worker keeps, and the longest word and run of marks that is kept.
CACHE_WORDS, CACHE_CHARS, CACHE_TAIL = 400_000, 48, 8
#: Bytes of text whose words are looked up together.
ENCODED = 4_000_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_MIXED = re.compile(r"\s | \s")
#: The same with all white space of ``re`` written out.
_SPACES = "[" + "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]"
_MIXED_RE2 = f"{_SPACES} | {_SPACES}"
#: Marks that the pattern takes in one run and parts from letters; the apostrophe is not one of them.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _alphabet() -> dict[int, str]:
    """Byte-level vocabularies write visible Latin-1 characters as they are and number the other bytes from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = _alphabet()


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _letters(word: str) -> bool:
    """Latin letters only: one piece of the pattern."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Words(dict):
    """Ids of words, found at their first use; ``space`` stands before each of them."""

    def __init__(self, encoder: Encoder, space: str):
        super().__init__()
        self.encoder, self.space = encoder, space

    def __missing__(self, word: str) -> bytes:
        """Put together from letters, trailing marks and single line ends where a word consists of these, else found and kept."""
        if _letters(word):
            return self.kept(word, self.encoder.merged(self.space + word))
        core = word.rstrip(_MARKS)
        if _letters(core):
            return self[core] + self.encoder.marks(word[len(core):])
        first, *lines = word.split("\n")
        if lines and len(word.split()) == len(lines) + 1:
            return b"".join([self[first], *[x for line in lines for x in (self.encoder.line_end, self.encoder.bare[line])]])
        return self.kept(word, self.encoder.whole(self.space + word))

    def kept(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def trim(self) -> None:
        """Drops what was added first, once there is too much."""
        if len(self) > CACHE_WORDS:
            newest = list(islice(self.items(), len(self) - CACHE_WORDS // 2, None))
            self.clear()
            self.update(newest)


class Encoder:
    """Token ids of whole texts, word by word.

    The vocabulary's pattern never joins a space that follows a character and
    precedes another one to what stands before it. Texts can be cut there, and the
    ids of a word with its leading space looked up. With ``added``, as jobs use it, a text
    that holds one of the vocabulary's added tokens is encoded as a whole, which finds it
    there; without, such a token is text like any other.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.tok = Tokenizer.from_file(str(path))
        self.tok.encode_special_tokens = not added
        found = [t.content for t in self.tok.get_added_tokens_decoder().values() if added or not t.special]
        self.added = re.compile("|".join(map(re.escape, found))) if found else None
        self.model = self.tok.model
        self.words, self.bare, self.tails = _Words(self, " "), _Words(self, ""), {}
        self.line_end = self.merged("\n")

    @classmethod
    def open(cls, vocabulary: str) -> Encoder:
        """One encoder per worker and vocabulary."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary, added=True)
        return cls._open[vocabulary]

    def forget(self) -> None:
        """Lets all words go: a worker that waits for its next task, maybe of other work, holds none."""
        for known in (self.words, self.bare, self.tails):
            known.clear()

    def whole(self, text: str) -> bytes:
        return _bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def merged(self, piece: str) -> bytes:
        """Ids of one piece of the pattern: the merges alone, on the vocabulary's byte alphabet."""
        if piece.isascii() and piece.isprintable():
            written = piece.replace(" ", _ALPHABET[32])  # the only one of these that has another name
        else:
            written = piece.encode().decode("latin-1").translate(_ALPHABET)
        return _bytes([t.id for t in self.model.tokenize(written)])

    def marks(self, tail: str) -> bytes:
        if len(tail) > CACHE_TAIL:
            return self.merged(tail)
        if tail not in self.tails:
            if len(self.tails) > CACHE_WORDS // 10:
                self.tails.clear()
            self.tails[tail] = self.merged(tail)
        return self.tails[tail]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.added and self.added.search(text):
            return self.whole(text)
        if _MIXED.search(text):
            first, *rest = _CUT.split(text)
            rest = [r[1:] for r in rest]
        else:
            first, *rest = text.split(" ")
        self.words.trim()
        self.bare.trim()
        return b"".join([self.whole(first), *map(self.words.__getitem__, rest)])

    def encode_all(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text and ``end_id``, as ``encode`` finds them; equal words of the texts are looked up together."""
        n, special = len(texts), pc.match_substring_regex(texts, _MIXED_RE2)
        if self.added:
            special = pc.or_(special, pc.match_substring_regex(texts, self.added.pattern))
        apart = {i: self.encode(texts[i].as_py()) for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()}
        self.words.trim()
        self.bare.trim()
        lists = pc.split_pattern(pc.if_else(special, "", texts), " ")
        at, every = lists.offsets.to_numpy(), lists.flatten()
        first = np.zeros(len(every), dtype=bool)
        first[at[:-1] - at[0]] = True
        coded = every.filter(pa.array(~first)).dictionary_encode()
        found = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        known = len(found)
        found += [apart[i] if i in apart else self.whole(t) for i, t in enumerate(every.filter(pa.array(first)).to_pylist())]
        found.append(_bytes([end_id]))
        # one row per word, the end of each text included, with its place among those found
        bounds = np.cumsum(np.diff(at) + 1)
        rows = np.full(bounds[-1], -1, dtype=np.int64)
        rows[bounds - 1], rows[bounds - np.diff(at) - 1] = known + n, known + np.arange(n)
        rows[rows < 0] = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids, starts, size = np.frombuffer(b"".join(found), dtype=np.uint32), np.cumsum(sizes) - sizes, sizes[rows]
        ends = np.cumsum(size)
        kind = np.int32 if ends[-1] < 2**31 else np.int64
        ids = ids[np.repeat((starts[rows] - ends + size).astype(kind), size) + np.arange(ends[-1], dtype=kind)]
        cuts = [0, *ends[bounds - 1].tolist()]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def cut(df: DataFrame, id_col: str, text_col: str, width: int, end_id: int, vocabulary: str,
        with_ids: bool) -> DataFrame:
    """Pieces: (id, piece, start, length, ids_crc32[, ids], part, place).

    ``place`` numbers the pieces of one length within the task ``part``.
    """
    id_type = dict(df.dtypes)[id_col]
    schema = (f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, part int, place long"
              + (", ids binary" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        encoder, part = Encoder.open(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(width + 1, dtype=np.int64)
        try:
            for batch in (part for b in batches for part in text_runs(b, text_col, ENCODED)):
                src, rows = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "place", "ids")}
                for i, raw in enumerate(encoder.encode_all(pc.fill_null(batch.column(1), ""), end_id)):
                    n = len(raw) // 4
                    first = (n - 1) % width + 1
                    for k, a in enumerate([0, *range(first, n, width)]):
                        b = first if k == 0 else a + width
                        ids = raw[4 * a:4 * b]
                        src.append(i)
                        for c, v in (("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids)),
                                     ("place", int(seen[b - a])), ("ids", ids if with_ids else None)):
                            rows[c].append(v)
                        seen[b - a] += 1
                if src:
                    cols = {id_col: batch.column(0).take(pa.array(src)), "piece": pa.array(rows["piece"], pa.int32()),
                            **{c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")},
                            "part": pa.array(np.full(len(src), part, dtype=np.int32)),
                            "place": pa.array(rows["place"], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(rows["ids"], pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)
        finally:
            encoder.forget()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """The lengths of a sub-multiset of ``counts`` with the largest sum up to ``room``.

    Bit s of ``reach`` says that sum s can be made. Lengths join from the longest
    down, several at once by doubling; each step is kept to trace the sum back.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.nonzero(counts[:room + 1])[0][::-1].tolist():
        left, times = min(int(counts[length]), room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            grown = (reach | reach << length * times) & mask
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            out += [length] * times
    return out


def plan(counts: np.ndarray, width: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how often each is taken, until no piece is left."""
    counts, runs = counts.copy(), []
    while counts.any():
        longest = int(np.nonzero(counts)[0][-1])
        counts[longest] -= 1
        rest = fullest(counts, width - longest)
        counts[longest] += 1
        lengths, need = np.unique([longest, *rest], return_counts=True)
        times = int((counts[lengths] // need).min())
        counts[lengths] -= need * times
        runs.append((sorted([longest, *rest], reverse=True), times))
    return runs


def _slots(runs: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """By length and first rank: first sequence, pieces of the length in the run, where their offsets begin."""
    rows, offsets, used, seq = [], [], {}, 0
    for lengths, times in runs:
        ends = np.cumsum(lengths)
        for length in dict.fromkeys(lengths):
            at = [int(e - length) for e, x in zip(ends, lengths) if x == length]
            rows.append((length, used.get(length, 0), seq, len(at), len(offsets)))
            used[length] = used.get(length, 0) + times * len(at)
            offsets += at
        seq += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return (*table.T, np.array(offsets, dtype=np.int64))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID,
         vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    pieces = cut_lineage(cut(df, id_col, text_col, width, end_id, vocabulary, with_ids))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    firsts = cut_lineage(by_part.withColumn("_first", earlier))
    counts = np.zeros(width + 1, dtype=np.int64)
    for row in firsts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most width rows
        counts[row["length"]] = row["n"]
    lengths, starts, seqs, many, at, offsets = _slots(plan(counts, width))
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (lengths << 48) + starts
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            nth = rank - starts[i]
            cols = {c: b.column(b.schema.get_field_index(c)) for c in names}
            cols |= {"sequence_id": pa.array(seqs[i] + nth // many[i]), "offset": pa.array(offsets[at[i] + nth % many[i]])}
            if with_ids:
                cols["ids"] = b.column(b.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_pydict(cols)

    ranked = pieces.join(firsts.drop("_n"), ["length", "part"]).select(
        *names, (F.col("_first") + F.col("place")).alias("rank"), *(["ids"] if with_ids else []))
    schema = (f"`{id_col}` {dict(df.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    return ranked.mapInArrow(run, schema)
