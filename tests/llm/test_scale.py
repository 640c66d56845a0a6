"""Tables larger than what a worker opens for itself: the same results by other ways."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from groundcover.llm import class_lm, collocations, lookup, pair_counts, toxicity


def scored_texts(spark, tmp_path, rows=240):
    """Documents with columns that the pipeline carries along, and labels in a folder of their own."""
    made = [(i, " ".join(("bad awful", "plain good", "vile nasty", "calm kind")[(i + j) % 2 + 2 * (i % 2)] + f" w{'abcdefghij'[(i * j) % 10]}" for j in range(12)),
             "en", "s", 60) for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(rows)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return docs, labels


def test_pipeline_with_a_joined_model(spark, monkeypatch, tmp_path):
    docs, _ = scored_texts(spark, tmp_path)
    want = sorted(map(tuple, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()))
    monkeypatch.setattr(toxicity, "FEW_ENTRIES", 0)
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < 240


def test_mapped_tables_give_the_same_scores(spark, monkeypatch, tmp_path):
    docs, labels = scored_texts(spark, tmp_path)
    want = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    monkeypatch.setattr(lookup, "FEW_OPENED", 0)
    monkeypatch.setattr(lookup, "PIECE_BYTES", 100)
    monkeypatch.setattr(pair_counts, "WORD_BYTES", 500)
    scorer = toxicity.learn(docs, labels)
    assert isinstance(scorer.shared, lookup.Shared) and len(scorer.shared.parts) > 2
    for _ in range(2):  # opened by one worker, then found there
        got = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_limits_hold_for_six_gigabytes():
    """0.51 GB have 2.4 million words, 1.8 million entries and 3.3 million tokens; all grow more slowly than the table."""
    assert toxicity.FEW_WORDS >= 12 * 2_400_000 and toxicity.FEW_ENTRIES >= 12 * 1_850_000 and class_lm.FEW >= 12 * 3_300_000


def test_mapped_words_give_the_same_classes(spark, monkeypatch):
    rows = [(i, None if i == 7 else " ".join(f"w{(i * j + j) % 17} x{(i + j) % 5}" for j in range(i % 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, class_lm.rate(docs, rounds=3).collect()))
    monkeypatch.setattr(lookup, "FEW_OPENED", 0)
    monkeypatch.setattr(lookup, "PIECE_BYTES", 10)
    assert isinstance(class_lm.learn(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")), 1).words, class_lm.Mapped)
    assert sorted(map(tuple, class_lm.rate(docs, rounds=3).collect())) == want


def test_packed_rows_come_back(spark):
    rows = [(k, k % 7 + (k % 3 > 1) * 100_000) for k in [-2**63, -5, 0, 3, 2**63 - 1, *range(10**15, 10**15 + 30_000, 3)]]
    shared = lookup.packed(spark.createDataFrame(rows, "key long, n long").repartition(4), "key", "n")
    key, n = lookup.unpacked(iter(shared), "int32")
    assert list(zip(key.tolist(), n.tolist())) == sorted(rows)


def phrase_docs(spark):
    rows = [(("en", "de", None)[i % 3], None if i == 5 else " ".join(f"a{(i * j) % 4} b{j % 3}, ü{(i + j) % 5}" for j in range(i % 25))) for i in range(150)]
    return spark.createDataFrame(rows, "lang string, text string").repartition(3)


def test_mapped_survivors_and_often_shipped_counts_give_the_same_phrases(spark, monkeypatch):
    docs = phrase_docs(spark)
    want = sorted(map(tuple, collocations.mine(docs, 3, 40).collect()))
    assert len(want) > 20
    monkeypatch.setattr(lookup, "FEW_OPENED", 0)
    monkeypatch.setattr(lookup, "PIECE_BYTES", 10)
    monkeypatch.setattr(collocations, "COUNTED", 20)
    monkeypatch.setattr(collocations, "RUN_BYTES", 100)
    assert sorted(map(tuple, collocations.mine(docs, 3, 40).collect())) == want


def test_counts_of_several_slices_are_added_up():
    counts, parts, both = collocations.Counts(), 3, pa.record_batch({"lang": ["en"], "text": [b"one two, one two three"]})
    for batch in (both, pa.record_batch({"lang": ["de", "en"], "text": [b"", b"zwei one two"]})):
        grams = collocations.Grams(batch)
        counts.add(grams, [np.ones(len(k), dtype=bool) for k in grams.keys(parts)])
    got = {(r["lang"], r["phrase"], r["size"]): r["n"] for r in counts.shipped().to_pylist()}
    assert got == {("en", "", 0): 8, ("de", "", 0): 0, ("en", "one", 1): 3, ("en", "two", 1): 3, ("en", "three", 1): 1, ("en", "zwei", 1): 1,
                   ("en", "one two", 2): 3, ("en", "two three", 2): 1, ("en", "zwei one", 2): 1, ("en", "one two three", 3): 1, ("en", "zwei one two", 3): 1}
    assert counts.size == 0
