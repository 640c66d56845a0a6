"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a ratio and the range it may take. ``rate`` measures a text once,
in column expressions only, and turns the whole table into one verdict column;
nothing is shuffled and no user function runs.

Defined cases: a null text counts as empty. An empty text has zero in every
measure and fails the length rule. Repeated rows are rated one by one. Every
input column is kept; measures replace input columns of the same name, and helper
columns clash with none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, carried

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as with was on by this are from "
    "der die und das den von zu mit ist des im dem nicht ein eine auf für "
    "le la les de des et un une du que est pour dans qui sur pas au par avec "
    "el los las y en del se una por con para su al lo no"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the range it may take, ends included."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        ratio = F.col(self.over) / F.greatest(F.col(self.under), F.lit(1))
        checks = [ratio >= self.low] if self.low is not None else []
        checks += [ratio <= self.high] if self.high is not None else []
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out


#: Length, symbol, stop-word and line ratios. Limits lie far outside running prose.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("shouting", "n_marks", "n_words", high=0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_marks", "n_lines", "n_dup_lines",
            "n_repeat_words")


def _once(value: Column) -> Column:
    """The same value, marked so that filters on it stay above it and do not repeat the measuring."""
    return F.when(F.spark_partition_id() >= 0, value)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of a text to its row.

    Repeated words are those inside a three-word window that occurs twice or more:
    windows are hashed, sorted within the row, and equal neighbours marked.
    """
    kept, held, back = carried(df, MEASURES)
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.select(*kept, t.alias("_text"),
                     F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
                     F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    step = step.select(
        *held, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count("_text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_hashes") - 3), lambda i: F.xxhash64(
        F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    step = step.withColumn("_hashes", F.when(F.size("_hashes") >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    marked = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # sorting is for texts that repeat a window at all
    step = step.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), marked))

    def again(x: Column, i: Column) -> Column:
        before, after = F.get("_sorted", i - 1)["h"], F.get("_sorted", i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    step = step.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_starts", lambda p, i: F.least(
        F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    step = step.select(*held, *[_once(F.col(m)).alias(m) for m in MEASURES if m != "n_repeat_words"],
                       _once(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"))
    return step.select(*back, *MEASURES)


def rate(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50,
         max_repeated_pct: int = 50) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept``; ``failed_rules`` names what failed.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated_pct``
    of a hundred words repeated. ``kept``: not so, and every rule of the table holds.
    """
    out = measure(df, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_pct * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    out = out.select(*[F.col(f"`{c}`") for c in out.columns if c.lower() not in ("base_failed", "failed_rules", "kept")],
                     base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
