"""How five filters interact, for every order in which they may be applied.

Every document gets the set of filters it fails. A (few words), B (few distinct words),
C (many capitals) and D (symbols) follow from its own text. E (a copy of a document
with a smaller id, removed or not) is a left semi self-join on the hash of the text, the
exact text and the smaller id: the right side is one row per distinct text with its
smallest id, which exists exactly if any smaller id does; large groups of copies are
dealt over salts. The ids that fail A to D and those that fail E are united and added up
to combinations of bits, and those are counted by part; what any order of the filters
does follows from these at most 31 counts.

Defined cases: a null text is an empty one, a null source the part ``''``; a null id is
no smaller id, has none itself and no labels; repeated rows count as often as they occur and
are no copies of each other; an id that is labelled twice is good or toxic if any label
says so; an empty table gives no rows. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import FEW_IDS, join_counted
from .store import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 2, b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")
#: Copies of a text that meet in one task.
TOGETHER = 10_000


def own_failures(text: bytes, chars: int) -> int:
    """Bits of the filters A to D that a UTF-8 text of so many code points fails."""
    words = text.split()
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, UPPER))) > MAX_UPPER_PCT * chars) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(3)
        chars = pc.utf8_length(text.cast(pa.string())).to_pylist()
        bits = [own_failures(t.as_py(), n) for t, n in zip(text, chars)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits, pa.int32())], ["id", "part", "h", "bits"])


def copies_of_smaller(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, part, h) of the rows whose text a smaller id has too; ``repeated`` has (h, n) of hashes with several rows."""
    few = repeated.limit(FEW_IDS + 1).count() <= FEW_IDS
    several = rows.join(F.broadcast(repeated), "h") if few else join_counted(rows, repeated, ["h"], "n")
    several = several.withColumn("salts", F.ceil(F.col("n") / TOGETHER).cast("int"))
    first = several.groupBy("h", "text", "salts").agg(F.min("id").alias("first")).filter("first IS NOT NULL")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = several.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.col("salts")).cast("int")).alias("l")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("h", "salt", "text")]
    found = left.join(first.alias("r"), [*same, F.col("r.first") < F.col("l.id")], "left_semi")
    return found.select("id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """(part, total, failing): documents of a part and, by combination of failed filters, (bits, n, good, toxic)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", "part", F.xxhash64("text").alias("h"), "text")
    marked = written(rows.select("id", "part", "h", F.col("text").cast("binary")).mapInArrow(
        _marked, "id long, part string, h long, bits int"), "audit-marked")
    repeated = cut_lineage(marked.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    copies = copies_of_smaller(rows, repeated)
    zero, one = F.lit(0).alias("e"), F.lit(1).alias("e")
    failing = marked.filter("bits > 0").select("id", "part", "h", "bits", zero).unionByName(
        copies.select("id", "part", "h", F.lit(COPY).alias("bits"), one))
    # rows with the same id, part and text fail the same filters; n is how many there are
    failing = failing.groupBy("id", "part", "h").agg(
        F.bit_or("bits").alias("bits"), F.greatest(F.sum("e"), F.sum(1 - F.col("e"))).alias("n"))
    failing = failing.groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = failing.filter("id IS NOT NULL").join(marks, "id", "left").drop("id").unionByName(
        failing.filter("id IS NULL").select("part", "bits", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    counted = known.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("failing"))
    return marked.groupBy("part").agg(F.count("*").alias("total")).join(by_part, "part", "left")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter keeps, removes and adds.

    ``shapley`` is what the filter removes, added up over all orders: a document that fails k
    filters is removed first by each of them in a k-th of the orders.
    """
    parts = combinations(docs, labels, **columns)
    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(
        f"aggregate(sequence(1, step), 0, (a, j) -> a | if(j < step, {bit.format('j')}, 0))"))
    steps = steps.withColumn("failing", F.coalesce("failing", F.array().cast(steps.schema["failing"].dataType)))

    def count(condition: str, value: str = "c.n"):
        return F.expr(f"aggregate(failing, 0L, (a, c) -> a + if({condition}, CAST({value} AS BIGINT), 0L))")

    here = "c.bits & own <> 0 AND c.bits & before = 0"
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - count("c.bits & (before | own) <> 0")).alias("kept"),
        count(here).alias("removed"), count("c.bits & own <> 0 AND c.bits & before <> 0").alias("redundant"),
        count("c.bits = own").alias("unique_fails"), count(here, "c.good").alias("good_lost"),
        count(here, "c.toxic").alias("toxic_lost"),
        count("c.bits & own <> 0", f"c.n * ({len(ORDERS)} div bit_count(c.bits))").alias("shapley"))
