"""From raw documents to packed sequences: five stages, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundcover.llm import chosen_path, mixing, packing, quality_rules, toxicity
from groundcover.llm.common import if_few, read
from groundcover.llm.store import written
from groundcover.session import cut_lineage

#: Models and tokens cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


KEYS = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """Columns the operators read, and all others in one struct, so their names cannot clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in KEYS]
    return docs.select(*KEYS, F.struct(*rest, F.lit(0).alias("_none")).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in KEYS else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit."""
    scorer = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs), scorer)
    return _unpacked(scored.filter(F.col("score") < toxicity.REJECT), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return _unpacked(quality_rules.rate(_packed(docs)).filter("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity of 0.8 or more.

    Rows that share an id are one document, of which the row with the least hash of its text stays (and of
    equal texts that with the least hash of all columns), so a rerun keeps the same; rows without an id stay.
    """
    found = cut_lineage(chosen_path.near_duplicates(docs).filter("doc_id IS NOT NULL"))
    dropped = cut_lineage(found.filter("NOT kept").select("doc_id").distinct())
    kept = docs.join(if_few(dropped), "doc_id", "left_anti")
    repeated = cut_lineage(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min_by(every, F.struct(F.xxhash64("text"), F.xxhash64(every))).alias("_one"))
        once = once.select(*[F.col(f"_one.`{c}`").alias(c) for c in docs.columns])
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return kept.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(_packed(docs), mixing.word_count(F.col("text")))
    return _unpacked(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mix."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("near-duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
