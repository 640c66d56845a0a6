"""License scan, quality rules, mixing, sharding and chat formatting on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from groundcover.llm import chat_format, license_scan, mixing, quality_rules, shard_tree
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_license_edges(edge_docs, no_docs):
    got = rows(license_scan.scan(edge_docs))
    assert len(got) == 11 and Counter(r["doc_id"] for r in got)[5] == 2
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == 0 and by[1]["first_word"] is None and by[1]["labels"] == ""
    assert by[4]["n_words"] == 90_000
    assert (by[8]["n_words"], by[8]["n_base"], by[8]["first_word"], by[8]["base_labels"]) == (5, 1, 3, "cc-by")
    assert rows(license_scan.scan(no_docs)) == []


def test_license_places(spark):
    texts = ["CC BY cc by, cc-BY", "All rights reserved. x All Rights Reserved", "General public licence",
             "x Licensed under the very Apache License, Version 2.0 y", "licensed apache version",
             "cc by nc", "general public license " * 3, "İcc by K cc BY"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(license_scan.scan(df))}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        w = re.findall(license_scan.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        at = [(p, x) for x, l in phrases.items() for p in range(len(w)) if w[p:p + len(x.split())] == x.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(at))
        assert got[i]["first_word"] == min((p for p, _ in at), default=None)
        assert got[i]["last_word"] == max((p for p, _ in at), default=None)
        assert got[i]["base_labels"] == ",".join(sorted({phrases[x] for _, x in at}))
    assert "apache-2.0" in got[3]["labels"] and 0.6 <= got[3]["score"] < 1
    assert got[4]["labels"] == ""


def test_license_does_not_count_copies_twice(spark):
    df = spark.createDataFrame([(1, "released under the")] * 3, "doc_id long, text string")
    assert {r["labels"] for r in rows(license_scan.scan(df))} == {""}


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, edge_docs, no_docs):
    texts = ["a b c a b c", "a a a a a", "x\nx\n\n \nx\ny", "# * é|ü <>", "p q r s t p q r u p q", "one two three " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows(quality_rules.rate(df)):
        want = brute_quality(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    got = rows(quality_rules.rate(edge_docs))
    assert len(got) == 11 and all(r["kept"] is False for r in got if not r["text"])
    assert {r["n_words"] for r in got if r["doc_id"] == 4} == {90_000}
    assert rows(quality_rules.rate(no_docs)) == []


HELPERS = ["_words", "_lines", "_hashes", "_sorted", "_starts", "_text", "_full", "_cut", "_in0", "_in1", "_mix_h", "_mix_src", "r_src"]


@pytest.mark.parametrize("rated", [quality_rules.rate, lambda df: mixing.mix(df, mixing.word_count(F.col("text")))])
def test_columns_named_like_helpers_come_back(spark, rated):
    df = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    df = df.select(*[F.lit(f"mine {c}").alias(c) for c in HELPERS], "*", F.lit(-1).alias("N_Words"), F.lit(-1).alias("Size"))
    got = rated(df)
    assert all(rows(got)[0][c] == f"mine {c}" for c in HELPERS)
    assert len({c.lower() for c in got.columns}) == len(got.columns)


def test_quality_rules_decide(spark):
    prose = " ".join(f"the word{i} of thing{i}" for i in range(30))
    shout = " ".join(f"WORD{i}!!" for i in range(80))
    bars = " | ".join(f"the word{i}" for i in range(60))
    df = spark.createDataFrame([(1, prose), (2, shout), (3, bars)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(quality_rules.rate(df))}
    assert got[1]["kept"] and not got[2]["kept"] and not got[3]["kept"]
    assert "shouting" in got[2]["failed_rules"] and got[3]["failed_rules"] == "symbols"


def level_of(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, out, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and total > 1e-9:
        w = sum(weights[i] for i in open_)
        spill = 0.0
        for i in list(open_):
            out[i] += total * weights[i] / w
            if out[i] >= 2 * sizes[i]:
                spill += out[i] - 2 * sizes[i]
                out[i] = 2.0 * sizes[i]
                open_.remove(i)
        total = spill
    return out


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_mixing(spark, broadcast):
    data = [(i, None if i % 7 == 3 else f"s{i % 7 % 5}" if i % 3 else "s0", i * 37 % 90) for i in range(1, 3000)]
    df = spark.createDataFrame(data, "doc_id long, source string, words long")
    got = rows(mixing.mix(df, F.col("words"), broadcast_sources=broadcast))
    assert len(got) == len(data)
    names = sorted({s for _, s, _ in data if s is not None}) + [None]
    sizes = [sum(z for _, s, z in data if s == n) for n in names]
    want = level_of(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, z, t in zip(names, sizes, want):
        mine = [r for r in got if r["source"] == n]
        assert all(r["source_size"] == z and abs(r["target"] - t) < 1e-6 * max(t, 1) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 90
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in mine)
    again = rows(mixing.mix(df.repartition(5), F.col("words"), broadcast_sources=1000))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_edges(edge_docs, no_docs):
    got = rows(mixing.mix(edge_docs, mixing.word_count(F.col("text"))))
    assert len(got) == 11 and all(r["taken"] == 0 for r in got if not (r["text"] or "").strip())
    assert sum(r["taken"] for r in got if r["source"] == "s") <= 2 * 90_000
    assert rows(mixing.mix(no_docs, mixing.word_count(F.col("text")))) == []


def test_shards(spark, edge_docs, no_docs):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    got = rows(shard_tree.place(df))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert 4000 / 17 * 0.7 < sum(r["grown_shard"] == 16 for r in got) < 4000 / 17 * 1.3
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350
    assert all(r["text_crc32"] == zlib.crc32(f"text {r['doc_id']}".encode()) for r in got)
    edges = rows(shard_tree.place(edge_docs))
    assert len(edges) == 11 and len({(r["shard"], r["slot"]) for r in edges}) == 11
    assert {r["size"] for r in edges if r["doc_id"] in (1, 2)} == {1} and {r["text_crc32"] for r in edges if r["doc_id"] == 1} == {0}
    assert rows(shard_tree.place(no_docs)) == []


def test_rows_of_one_id_share_no_slot_bucket(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "COPIES", 7)
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    got = rows(shard_tree.place(df.unionByName(spark.createDataFrame([(5, "same")] * 100, "doc_id long, text string"))))
    for i, n in ((None, 3000), (5, 100)):
        mine = {r["shard"] for r in got if r["doc_id"] == i}
        assert len(mine) == 1 and sum(r["doc_id"] == i for r in got) == n
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    alike = sorted(r["slot"] for r in got if r["doc_id"] == 5)
    assert alike == list(range(alike[0], alike[0] + 100))


@pytest.mark.parametrize("n", [1, 3, 16, 17, 18])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    df = spark.createDataFrame([(i, "") for i in range(800)], "doc_id long, text string")
    got = rows(shard_tree.place(df, shards=n, base=min(n, 16)))
    assert {r["shard"] for r in got} == set(range(n))
    assert all(r["grown_shard"] in (r["shard"], n) for r in got) and any(r["grown_shard"] == n for r in got)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|turn|>x<|text|>", "a\\<b\\\\[c", "\\", "", None, "é<[\n"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    turns += [(2, 0, "user", "hi"), (2, 1, "assistant", "long [text] " * 50_000), (3, 0, "assistant", "yo"), (3, 0, "assistant", "yo"), (None, 1, None, "x")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, example long")
    examples = chat_format.expand(df).cache()
    got = {r["conv_id"]: r for r in rows(chat_format.digest(examples))}
    for c in (1, 2, 3, None):
        mine = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
    for r in rows(examples):
        body = r["formatted"].replace(chat_format.TURN, "").replace(chat_format.TEXT, "").replace(chat_format.END, "")
        assert not re.search(r"</s>|\[/?INST\]|<\|", body)
        assert r["formatted"][r["loss_end"]:] == chat_format.END or r["loss_start"] == r["loss_end"]
    assert sum(r["loss_end"] > r["loss_start"] for r in rows(examples) if r["conv_id"] == 1) == 2
    empty = spark.createDataFrame([], df.schema)
    assert rows(chat_format.digest(chat_format.expand(empty))) == []


def test_license_texts_are_split_once(spark):
    marks = set(license_scan.marks(license_scan.TEMPLATES))
    assert all(marks & set(g.split()) for x in license_scan.TEMPLATES for g in x.grams)
    texts = ["cc", "by cc", "CC\nBy", "the of to and", "Released under the MIT license.", "one \u00e9 \U0001f600 two", None]
    out = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "regexp" not in out._jdf.queryExecution().toString().lower()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["labels"]) for r in rows(out)}
    assert got == {0: (1, 0, ""), 1: (2, 0, ""), 2: (2, 1, "cc-by"), 3: (4, 0, ""), 4: (5, 0, "mit"), 5: (4, 0, ""), 6: (0, 0, "")}
