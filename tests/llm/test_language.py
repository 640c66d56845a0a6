"""Filter audit, phrase collocations and the class language model against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from groundcover.llm import class_lm, collocations, filter_audit, pair_counts, toxicity
from groundcover.llm.columns import squeezed, unsqueezed
from groundcover.llm.lookup import find
from groundcover.llm.queries import QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


# filter audit

def audited(docs, labels):
    """Every order of the filters, document by document. docs: (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), copy)) if x})
    out, total = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p or "" for _, _, p in docs}:
            left = [k for k, d in enumerate(docs) if (d[2] or "") == part]
            own = list(left)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                earlier = [k for k in own if k not in left and f in fails[k]]
                left = [k for k in left if k not in gone]
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(fails[k] == {f} for k in own),
                                          sum(docs[k][0] in good for k in gone), sum(docs[k][0] in bad for k in gone)]
                total[part, f] += len(gone)
    return Counter((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit_rows():
    rng = random.Random(1)
    plain = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", " \n\t", plain, plain + " #", plain.upper(), "same " * 250, "a b c", "A B C", "é | é", plain + "\x00", plain + " "]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(90)]
    docs += [(1000 + i, "copied text", "s") for i in range(40)] + [(7, "copied text", "t")] * 3
    labels = [(rng.choice([None, *range(60), 1003]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("few, together", [(500_000, 10_000), (0, 5)])
def test_audit_all_orders(spark, monkeypatch, few, together):
    monkeypatch.setattr(filter_audit, "FEW_IDS", few)
    monkeypatch.setattr(filter_audit, "TOGETHER", together)
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*d, -1, -1, "x") for d in docs], "doc_id long, text string, source string, h long, bits int, part string")
    got = filter_audit.audit(df.repartition(3), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert tuples(got) == audited(docs, labels)


def test_audit_edges(spark, edge_docs, no_docs):
    no_labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_docs, no_labels).count() == 0
    docs = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    assert tuples(filter_audit.audit(edge_docs, no_labels)) == audited(docs, [])


# collocations

def phrases(docs, threshold, top):
    """docs: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {}
    for p, a in f.items():
        if len(p) > 2 and a >= threshold:
            score, _, left, rest = min((1_000_000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])])
                                       for k in range(1, len(p) - 1))
            found[p] = (score, a, left, rest)
    inside = {}
    for p, v in found.items():
        for q in ((p[0], *p[1:3]), (p[0], *p[2:4])) if len(p) == 4 else ():
            inside[q] = max(inside.get(q, 0), v[1])
    out = Counter()
    for lang in n:
        mine = [(-v[0], -v[1], " ".join(p[1:]).encode(), v) for p, v in found.items()
                if p[0] == lang and (len(p) == 4 or 100 * inside.get(p, 0) < 50 * v[1])]
        for rank, (_, _, p, v) in enumerate(sorted(mine)[:top], 1):
            out[lang, rank, p.decode(), v[1], v[2], v[3], n[lang], v[0]] += 1
    return out


def phrase_docs():
    rng = random.Random(2)
    words = ["a", "b", "the", "Sea", "ü", "x\x00y", " ", "zz", "of", "\x1c"]
    weights = [2 ** -(i / 2) for i in range(len(words))]
    seps = [" ", " ", " ", "\t", ", ", ".", "\n", "\r\n", "!?", "  ", "\x0b"]
    docs = []
    for _ in range(200):
        text = "".join(w + rng.choice(seps) for w in rng.choices(words, weights, k=rng.randrange(120)))
        docs.append((rng.choice(["en", "de", None, "und", ""]), text))
    return docs + [("en", None), ("en", ""), ("fr", "  \n .,"), ("en", "san francisco bay " * 40), ("en", "san francisco bay, " * 40)]


@pytest.mark.parametrize("few, mass, threshold", [(4_000_000, 8_000_000, 10), (0, 100, 4), (10**9, 300, 3)])
def test_phrases(spark, monkeypatch, few, mass, threshold):
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "RUN_BYTES", 700)
    docs = phrase_docs()
    df = spark.createDataFrame([(i, *d, 1, 2) for i, d in enumerate(docs)], "doc_id long, lang string, text string, key long, _block long")
    got = collocations.mine(df.repartition(4), threshold, 30, few=few, mass=mass)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(docs, threshold, 30)
    assert len(want) > 50
    assert tuples(got) == want


def test_phrases_edges(spark, edge_docs, no_docs):
    assert collocations.mine(no_docs).count() == 0
    docs = [(r.lang, r.text) for r in edge_docs.collect()]
    assert tuples(collocations.mine(edge_docs)) == phrases(docs, 10, 2000)


def test_summary_keeps_every_frequent_place():
    rng = np.random.default_rng(3)
    for threshold in (2, 5, 40):
        stream = rng.zipf(1.3, 20_000) % 100_000
        true = Counter(stream.tolist())
        summary = collocations.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 37):
            key, count = np.unique(part.astype(np.uint32), return_counts=True)
            summary.merge([key], [count])
            assert len(summary.places) <= summary.capacity
        assert summary.lost < threshold
        held = dict(zip(summary.places.tolist(), summary.counts.tolist()))
        assert {k for k, n in true.items() if n >= threshold} <= {k for k, n in held.items() if n + summary.lost >= threshold}
        assert all(true[k] - summary.lost <= n <= true[k] for k, n in held.items())


def test_places_round_trip():
    for places in ([], [0], [5, 2**32 - 1], sorted({random.Random(4).randrange(2**32) for _ in range(999)})):
        assert collocations._unpack(collocations._pack(np.array(places, dtype=np.uint64))).tolist() == places


def test_top_in_stages(spark):
    rows = [(i % 2, i * 7919 % 1000, i) for i in range(4000)]
    got = collocations.top_by(spark.createDataFrame(rows, "g int, v int, i int"), "g", [F.desc("v"), F.col("i")], F.col("i"), 9, ranked=50)
    want = {(g, r + 1, i) for g in (0, 1) for r, (_, i) in enumerate(sorted((-v, i) for h, v, i in rows if h == g)[:9])}
    assert {(r.g, r.rank, r.i) for r in got.collect()} == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, rest = 3 * 10**14, 4 * 10**14 + 1, 5 * 10**14 + 7
    counts = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, rest), ("en", "x y", 2, a)], "lang string, phrase string, size int, n long")
    assert collocations.scored(counts).first().score == 1_000_000 * a * a // (left * rest)


# class language model

def model_docs():
    """Two languages of disjoint words, each with words that follow each other."""
    rng = random.Random(5)
    docs = []
    for i in range(1500):
        lang, text = rng.choice("xy"), []
        for _ in range(rng.randrange(3, 40)):
            text += [f"{lang}N{rng.randrange(120)}", f"{lang}v{rng.randrange(120)}"]
        docs.append((i, " ".join(text)))
    return docs + [(3000, None), (3001, ""), (None, "xn1 xv2"), (5, "repeated id"), (3002, "\x1f   unseen" + " q" * 5000)]


def base_scores(docs):
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    split = lambda t: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")), None]
    c = Counter(w for i, t in docs if crc(i) != 1 for w in split(t))
    total = sum(c.values())
    return sorted(((i is None, i or 0, crc(i) == 1, len(w), sum(c[x] > 0 for x in w), total,
                    round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w), 6)) for i, t in docs for w in [split(t)]))


@pytest.mark.parametrize("few", [class_lm.FEW, 0])
def test_base_and_gain(spark, few):
    docs = model_docs()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key long, id string").repartition(4)
    got = [r.asDict() for r in class_lm.rate(df, few=few).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in got) == base_scores(docs)
    held = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert len(held) > 20
    assert sum(r["score"] - r["base_score"] for r in held) > 0
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_held_out_rows_of_the_given_table(spark, sf):
    rows = QUERIES["op11_class_lm"](spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # more than two thirds of a bit a token better than the base model
    assert rows[0] - rows[1] > 0.2 * rows[2]


def test_broadcast_and_joined_models_agree(spark):
    df = spark.createDataFrame(model_docs(), "doc_id long, text string").repartition(4)
    near, far = ({r.doc_id: r.score for r in class_lm.rate(df.filter("doc_id <> 5"), few=few).collect()} for few in (class_lm.FEW, 0))
    assert near.keys() == far.keys()
    assert all(abs(near[i] - far[i]) < 1e-6 * (1 + abs(near[i])) for i in near)


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame(model_docs(), "doc_id long, text string")
    model = class_lm.learn(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    scores = class_lm.Scores(model, model.words.sort_by("key"))
    emits = np.where(scores.cls == 0, scores.n, scores.n - model.discount) / scores.totals[scores.cls]
    for before in range(class_lm.CLASSES + 1):
        known = (10 ** scores.after[before, scores.cls] * emits).sum()
        assert known + 10 ** scores.unknown[before] == pytest.approx(1, abs=1e-9)


def test_text_probability_by_hand(spark):
    model = class_lm.learn(spark.createDataFrame([(bytearray(b"a b a b"),), (bytearray(b"a b c"),)], "text binary"), rounds=2)
    scores = class_lm.Scores(model, model.words.sort_by("key"))
    cls, n = dict(zip(model.words["key"].to_pylist(), model.words["cls"].to_pylist())), dict(zip(model.words["key"].to_pylist(), model.words["n"].to_pylist()))
    key = lambda w: int(class_lm.tokens([_Text(w)])[0][0])
    at, total = 0, 0.0
    rows = np.vstack([model.counts, model.once]).astype(float)
    sums = model.counts.sum(0)
    p = lambda h, c: (rows[h, c] + class_lm.BACK * sums[c] / sums.sum()) / (rows[h].sum() + class_lm.BACK)
    for w in (b"a", b"b", b"q", b"a"):
        k = key(w)
        if k in cls:
            total += math.log10(p(at, cls[k]) * (n[k] - model.discount) / sums[cls[k]])
            at = cls[k]
        else:
            total += math.log10(sum(p(at, c) * model.discount * model.types[c] / max(sums[c], 1) for c in range(class_lm.CLASSES)))
            at = class_lm.CLASSES
    total += math.log10(p(at, 0))
    assert scores.of([_Text(b"A B q a")])[3][0] == pytest.approx(total)


class _Text:
    def __init__(self, raw):
        self.raw = raw

    def as_py(self):
        return self.raw


def test_exchange_gain_of_a_frequent_word():
    """A frequent word goes where the whole likelihood is highest, all other words staying."""
    rng = np.random.default_rng(6)
    words = 25
    text = [0]
    for w in rng.integers(0, words, 60_000).tolist():
        text += [w] * (w != text[-1] and not (w % 5 and text[-1] % 5 == w % 5))
    n = np.zeros((words, words))
    np.add.at(n, (text, text[1:] + [0]), 1)
    cls = rng.integers(1, 6, words)
    cls[0] = 0

    def counts(cls):
        out = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
        np.add.at(out, (cls[:, None], cls[None, :]), n)
        return out

    def likelihood(cls):
        c = counts(cls)
        return class_lm._f(c).sum() - class_lm._f(c.sum(0)).sum() - class_lm._f(c.sum(1)).sum()

    for w in range(1, words):
        before, after = np.zeros((1, class_lm.CLASSES)), np.zeros((1, class_lm.CLASSES))
        np.add.at(before[0], cls, n[:, w])
        np.add.at(after[0], cls, n[w])
        assert before.sum() >= class_lm.HEAVY and before.sum() == after.sum()
        got = class_lm.moved(before, after, before.sum(1), cls[[w]], counts(cls))[0]
        near = [likelihood(np.where(np.arange(words) == w, c, cls)) for c in range(1, class_lm.CLASSES)]
        assert near[got - 1] == pytest.approx(max(near), abs=1e-4)


def test_model_edges(spark, edge_docs, no_docs):
    assert class_lm.rate(no_docs).count() == 0
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = class_lm.rate(edge_docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got.collect()) == base_scores(docs)
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = class_lm.rate(spark.createDataFrame([(one, "only held out")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(4, 0, 0, 0.0, 0.0)]


def test_edges_round_trip():
    rng = np.random.default_rng(7)
    for words, blocks in ((10, 1), (100_000, 7)):
        word, other, n = (rng.integers(0, words, 3000) for _ in range(3))
        got = Counter()
        for b, raw in class_lm._packed(word, other, n, blocks):
            w, o, c = class_lm._unpacked(raw)
            got.update(zip((w * blocks + b).tolist(), o.tolist(), c.tolist()))
        assert got == Counter(zip(word.tolist(), other.tolist(), n.tolist()))


def test_find():
    at, there = find(np.array([1, 5, 9]), np.array([9, 0, 5, 10]))
    assert there.tolist() == [True, False, True, False] and at[0] == 2 and at[2] == 1


# counts of words and pairs

def test_counts_by_blocks_and_by_joins_agree(spark, monkeypatch):
    rng = random.Random(8)
    vocab = ["la", "mer", "merci", "tout", "toute", "x", "Ünter", "unter", "the"]
    texts = [(" ".join(rng.choices(vocab, [2 ** -i for i in range(9)], k=rng.randrange(60))), rng.choice([None, 0, 1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame(texts + [(None, 0), ("", 1), ("12 3", None), ("the " * 3000, 1)], "text string, label int").repartition(4)
    by_joins = tuples(toxicity.count_tables(df).select(pair_counts.COLUMNS))
    assert tuples(toxicity.counted(df).select(pair_counts.COLUMNS)) == by_joins
    monkeypatch.setattr(pair_counts, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(pair_counts, "WORD_BYTES", 500)
    assert tuples(toxicity.counted(df).select(pair_counts.COLUMNS)) == by_joins
    assert tuples(toxicity.counted(df, few=0).select(pair_counts.COLUMNS)) == by_joins
    assert toxicity.counted(df.limit(0)).count() == 0


def test_columns_round_trip():
    for columns in ([[0]], [[1, 2**63 - 1], [0, 0], [255, 256]], [list(range(5000)), [7] * 5000]):
        assert [c.tolist() for c in unsqueezed(squeezed(*map(np.array, columns)))] == columns


def test_joined_scores_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEW_ENTRIES", 0)
    rows = [(i, ("bad awful words " if i % 3 else "plain good words ") * 5, 7, 0.5, "k") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block long, Score double, key string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels))
    assert sorted(got.columns) == ["_block", "doc_id", "key", "score", "text"]
    out = got.collect()
    assert len(out) == 120 and {r._block for r in out} == {7} and {r.key for r in out} == {"k"}
    assert min(r.score for r in out if r.doc_id % 3) > max(r.score for r in out if r.doc_id % 3 == 0)


def test_letters_beyond_ascii_are_looked_up_at_once(monkeypatch):
    texts = ["", "Plain, ASCII 12!", "Straße ÄÖÜ x y_z", "İI ǅ \ud800 Ω٣", "a𝒳b ‍ 漢字,か", "﻿é\x00ü9"]
    want = [t.lower().translate(toxicity._LETTERS) for t in texts]
    assert [toxicity._letters(t) for t in texts] == want
    slow = []
    monkeypatch.setattr(toxicity, "_LETTERS", type("Slow", (dict,), {"__missing__": lambda self, c: slow.append(c) or c})())
    toxicity._letters("ß, é und ü")
    assert not slow
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "LOOKED_UP", 3)
    assert [toxicity._letters(t) for t in texts] == want


def test_entries_are_looked_up_in_order(monkeypatch):
    names = np.sort(np.random.default_rng(1).integers(-2**62, 2**62, 5_000))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0))
    entries = toxicity.Entries([none, (names, np.arange(5_000.0)), none, none])
    keys = np.concatenate([names[::-7], names[:3] + 1, names[-1:] + 5])
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: asked.append(np.asarray(v)) or search(a, v, *more, **named))
    got = entries.get(toxicity.WORD, keys, -1.0)
    assert got.tolist() == [*np.arange(5_000.0)[::-7], -1.0, -1.0, -1.0, -1.0]
    assert all((v[1:] >= v[:-1]).all() for v in asked)
    assert entries.get(toxicity.STEM, keys, np.ones(len(keys))).tolist() == [1.0] * len(keys)
