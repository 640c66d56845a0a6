"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import (
    chat_format,
    check_sql,
    chosen_path,
    class_lm,
    collocations,
    filter_audit,
    license_scan,
    mixing,
    packing,
    projections,
    quality_rules,
    shard_tree,
    toxicity,
    warc,
)
from .common import read
from .store import written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("spans")


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(written(warc.write(read(spark, sf_dir, "pages")), "archive"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    held_out = toxicity.fold("doc_id") == toxicity.HELD_OUT
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(read(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate(read(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "failed_rules", "kept")


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, pct=85)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    mixed = mixing.mix(sized, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(written(chat_format.expand(turns), "examples"))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.place(read(spark, sf_dir, "documents"))


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = class_lm.rate(read(spark, sf_dir, "documents"))
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_warc_chunks, op3_toxicity, op4_pack_sequences, op5_projections, op6_quality_rules,
    op7_chosen_path, op8_mix_sources, op9_chat_format, op10_shard_tree, op11_class_lm, op12_filter_audit,
    op13_collocations)}

ORACLES = {"op1_license_scan": check_sql.license_sql(), "op2_warc_chunks": check_sql.WARC,
           "op6_quality_rules": check_sql.quality_sql(),
           "op8_mix_sources": check_sql.MIXING, "op9_chat_format": check_sql.CHAT, "op10_shard_tree": check_sql.shard_sql(),
           "op12_filter_audit": check_sql.audit_sql(), "op13_collocations": check_sql.PHRASES}
