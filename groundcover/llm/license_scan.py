"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the
same hashes in license templates. A hit at word p of the text and word q of a
template votes for the diagonal p - q, the place where the whole template would
start. Votes are summed by diagonal, neighbouring diagonals (words inserted or
left out) merge into a band, and a band becomes a span when its grams, compared
word for word, cover enough of the template within a plausible length.

The templates are a parameter of bounded size, so they are broadcast; texts are
never shuffled, only their votes. Texts are split once: what is written of them is the
number of words, and the words themselves only where a gram of a template can be. A vote keeps the template position as one bit,
so a repeated row adds nothing to another's votes.

Defined cases: null and empty texts have no words and no labels; rows with equal
ids and texts get equal results, one each; a null id is an id of its own. Only the
columns named in ``scan`` come back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: After lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words, written so that the most frequent characters are tried first.
FAST_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
MAX_GRAMS = 60


@dataclass(frozen=True)
class Template:
    """A phrase is found word for word; a notice may differ in some words."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        return min(3, len(self.words))

    @property
    def grams(self) -> list[str]:
        w = self.words
        return [" ".join(w[i:i + self.k]) for i in range(len(w) - self.k + 1)]


#: The phrases of the contract, and opening words of public license notices.
TEMPLATES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa-4.0",
             "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of "
                           "the license at"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
                    "fee is hereby granted"),
)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def gram_positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """Rows of (template, q, k, gram, hash)."""
    rows = [(t, q, x.k, g) for t, x in enumerate(templates) for q, g in enumerate(x.grams)]
    if any(len(x.grams) > MAX_GRAMS for x in templates):
        raise ValueError(f"a template may have {MAX_GRAMS} grams; split a longer one")
    grams = spark.createDataFrame(rows, "template int, q int, gk int, gram string")
    return grams.withColumn("hash", F.xxhash64("gk", "gram"))


def marks(templates: tuple[Template, ...]) -> list[str]:
    """Words of which every gram has one: the longest of each, which ordinary texts have least."""
    return sorted({max(g.split(), key=len) for x in templates for g in x.grams})


def split_words(df: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    """(id, text hash, n_words, words) per row, split once; the words are null where no gram of a template can be."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"),
                      F.regexp_extract_all(ascii_lower(text), F.lit(FAST_WORD), F.lit(0)).alias("_w"))
    some = F.arrays_overlap("_w", F.array(*[F.lit(w) for w in marks(templates)]))
    return written(split.select("_id", "_th", F.size("_w").cast("long").alias("n_words"), F.when(some, F.col("_w")).alias("_w")), "words")


def votes(split: DataFrame, grams: DataFrame) -> DataFrame:
    """Votes by diagonal: (id, text hash, template, diagonal, mask of template positions, first and last start)."""
    split = split.filter("_w IS NOT NULL")

    def rolled(k: int) -> Column:
        at = F.sequence(F.lit(0), F.size("_w") - k)
        words = lambda i: F.concat_ws(" ", *[F.get("_w", i + j) for j in range(k)])
        all_at = F.transform(at, lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), words(i).alias("gram")))
        return F.when(F.size("_w") >= k, all_at).otherwise(F.array().cast("array<struct<p:int,k:int,gram:string>>"))

    rolling = split.select("_id", "_th", F.explode(F.concat(rolled(2), rolled(3))).alias("g"))
    rolling = rolling.select("_id", "_th", "g.p", "g.gram", F.xxhash64("g.k", "g.gram").alias("hash"))
    same = F.broadcast(grams.withColumnRenamed("gram", "known"))
    hits = rolling.join(same, "hash").filter("gram = known")
    return hits.groupBy("_id", "_th", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q"))).alias("mask"),
        F.min("p").alias("first"), F.max("p").alias("last"))


def spans(voted: DataFrame, facts: DataFrame, slack: int, min_share: float) -> DataFrame:
    """Merges neighbouring diagonals into bands and keeps the verified ones.

    A phrase is verified when one diagonal holds all its grams. A notice is verified
    when its band holds at least ``min_share`` of its grams, starts from diagonals at
    most ``slack`` words apart, and is no longer than the template and the slack.
    """
    on = ["_id", "_th", "template"]
    order = W.partitionBy(*on).orderBy("diagonal")
    rows = voted.join(F.broadcast(facts), "template")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    opens = F.col("phrase") | F.coalesce(gap > slack, F.lit(True))
    rows = rows.withColumn("_opens", opens.cast("int")).withColumn("band", F.sum("_opens").over(order))
    band = rows.groupBy(*on, "band", "label", "phrase", "n_grams", "n_words").agg(
        F.bit_count(F.bit_or("mask")).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("k").alias("k"))
    share = F.col("votes") / F.col("n_grams")
    length = F.col("last") - F.col("first") + F.col("k")
    whole = F.when(F.col("phrase"), F.col("votes") == F.col("n_grams")).otherwise(
        (share >= min_share) & (length <= F.col("n_words") * 2 + slack))
    return band.withColumns({"share": share, "words": length}).filter(whole)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         slack: int = 3, min_share: float = 0.6) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the largest share of a template found (a phrase counts 1); ``spans``
    lists (label, first word, words, share) of all verified spans.
    """
    spark = df.sparkSession
    facts = spark.createDataFrame([(t, x.label, x.phrase, len(x.grams), len(x.words), x.k)
                                   for t, x in enumerate(templates)],
                                  "template int, label string, phrase boolean, n_grams int, n_words int, k int")
    split = split_words(df, id_col, text_col, templates)
    found = spans(votes(split, gram_positions(spark, templates)), facts, slack, min_share)
    base = F.col("phrase")
    one = found.groupBy("_id", "_th").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "words", "label", "share"))).alias("spans"))
    one = one.withColumnsRenamed({"_id": "_rid", "_th": "_rth"})
    docs = split.select(F.col("_id").alias(id_col), "_th", "n_words")
    out = docs.join(one, F.col(id_col).eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left")
    return out.select(id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                      F.col("first_word").cast("long").alias("first_word"),
                      F.col("last_word").cast("long").alias("last_word"),
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                      F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
