"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all earlier turns are context
and only that reply is trainable. A conversation that does not end with an
assistant turn adds one closing example without a trainable part, so the last
example of every conversation holds all its turns.

Template of a turn: ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts the
characters ``<``, ``[`` and the backslash are each followed by an inserted backslash,
so no control string, of this template or of bracketed ones such as ``[INST]`` or
``</s>``, can appear there; ``unescape`` takes the inserted ones out again.

Defined cases: a null role or text is empty; turns with equal numbers are ordered
by role, then text; null turn numbers come first; repeated rows are turns of their
own; rows with a null conversation id form one conversation. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def expand(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           target_role: str = "assistant") -> DataFrame:
    """Examples: (conv_id, example, is_last, formatted, loss_start, loss_end).

    ``loss_start`` and ``loss_end`` bound the trainable characters of ``formatted``,
    from 0, end excluded; equal where nothing is trainable. A conversation is
    gathered into one row, its turns are not expected to exceed a task.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = df.select(F.col(conv).alias(conv), said.alias("_said")).groupBy(conv).agg(
        F.sort_array(F.collect_list("_said")).alias("_turns"))
    convs = convs.withColumn("_turns", F.transform("_turns", lambda t: F.struct(
        t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
        escape(t["text"]).alias("body"))))
    n = F.size("_turns")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("_turns", i)["role"] == target_role) | (i == n - 1))
    examples = convs.withColumn("_i", F.explode(at))
    last = F.get("_turns", F.col("_i"))
    context = F.array_join(F.transform(F.slice("_turns", 1, F.col("_i")),
                                       lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    prefix = F.concat(context, last["head"])
    examples = examples.select(conv, F.col("_i").cast("long").alias("example"),
                               (F.col("_i") == n - 1).alias("is_last"), prefix.alias("_prefix"),
                               last["body"].alias("_body"), (last["role"] == target_role).alias("_trained"))
    start = F.length("_prefix")
    return examples.select(
        conv, "example", "is_last", F.concat("_prefix", "_body", F.lit(END)).alias("formatted"),
        start.cast("long").alias("loss_start"),
        (start + F.when(F.col("_trained"), F.length("_body")).otherwise(0)).cast("long").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|end\|>")), lambda p: p != "")

    def turn(p: Column) -> Column:
        parts = F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), F.lit(r"<\|text\|>"))
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of a formatted text, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What a reader of the examples gets back, one row per conversation."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = examples.select(
        conv, "example", F.length("formatted").cast("long").alias("_chars"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("_turns"),
        F.when(F.col("loss_end") > F.col("loss_start"),
               read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select(conv, "_chars", "_loss", "example", F.size("_turns").alias("_n"), sha(said).alias("_sha"))
    out = rows.groupBy(conv).agg(
        F.max(F.when(F.col("_n") >= 0, F.col("_n"))).cast("long").alias("n_turns"),
        F.max("_sha").alias("turns_sha256"), F.sum("_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "_loss"))).alias("_loss"))
    loss = F.array_join(F.transform("_loss", lambda x: F.coalesce(x["_loss"], F.lit(""))), "")
    out = out.withColumn("_loss", loss)
    return out.select(conv, "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                      sha(F.col("_loss")).alias("loss_sha256"), "formatted_chars")
