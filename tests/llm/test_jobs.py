"""WARC, toxicity, packing, near-duplicate operators and the pipeline against brute force and round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from groundcover.llm import blocks, chosen_path, lookup, packing, projections, toxicity, warc
from groundcover.llm.common import join_counted
from groundcover.llm.queries import QUERIES
from groundcover.llm.store import written
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.collect()]


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# WARC

PAGES = "page_id long, url string, html string, data string"


def pages(spark):
    data = [(3, "http://x/ü\r\nWARC-Type: revisit", "same"), (1, None, "same"), (2, "u", ""), (4, "u", None), (5, "u", "é" * 50_000),
            (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "v", "same"), (None, "u", "same"), (None, "u", "alone"), (7, "u", "é" * 50_000)]
    return spark.createDataFrame([(*r, "clash") for r in data], PAGES).repartition(3), data


@pytest.mark.parametrize("chunk", [64 * 1024, 7])
def test_warc_round_trip(spark, chunk):
    df, data = pages(spark)
    got = rows(warc.read_back(written(warc.write(df, chunk=chunk), "archive-test")))
    key = lambda h: (h or "").encode()
    first = {}
    for i, _, h in data:
        if i is not None:
            first[key(h)] = min(i, first.get(key(h), i))
    want = Counter()
    for i, _, h in data:
        lead = first.get(key(h))
        revisit = lead is not None and i != lead
        want[(i, len(key(h)), base64.b32encode(hashlib.sha1(key(h)).digest()).decode(), "revisit" if revisit else "response",
              lead if revisit else None)] += 1
    assert Counter(tuple(r.values()) for r in got) == want
    assert rows(warc.read_back(warc.write(spark.createDataFrame([], PAGES)))) == []


def test_warc_archive_is_a_file(spark):
    df, _ = pages(spark)
    archive = sorted(rows(warc.write(df.coalesce(1), chunk=1000)), key=lambda r: (r["archive"], r["record"], r["chunk"]))
    raw, at, n = b"".join(r["data"] for r in archive), 0, 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        assert raw[at:at + 8] == b"WARC/1.1"
        size = int(dict(x.split(b": ", 1) for x in raw[at:end - 4].split(b"\r\n")[1:])[b"Content-Length"])
        assert raw[end + size:end + size + 4] == b"\r\n\r\n"
        at, n = end + size + 4, n + 1
    assert n == 10


def test_warc_notices_lost_chunks(spark):
    df, _ = pages(spark)
    archive = warc.write(df.filter("page_id = 5"), chunk=1000)
    with pytest.raises(Exception, match="missing|does not match"):
        warc.read_back(archive.filter("chunk <> 3")).collect()


# toxicity

def test_toxicity(spark):
    rng = random.Random(1)
    def text(bad):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "in"]) + rng.choice(["", "x", "y"]) for _ in range(60)]
        for i in range(0, 60, 10):
            if bad:
                w[i] = rng.choice(["vile", "scum", "rotten"])
        return " ".join(w)

    docs = [(i, text(i % 4 == 0)) for i in range(600)] + [(600, None), (601, ""), (602, "123 !!"), (None, "scum")]
    df = spark.createDataFrame([(*d, -5.0) for d in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(600)] + [(5, None, 1), (None, 1, 1), (0, 0, 0)],
                                   "doc_id long, toxic int, quality int")
    got = rows(toxicity.score(df, toxicity.learn(df, labels)))
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held)
    assert len({r["score"] for r in got if r["doc_id"] in (600, 601, 602)}) == 1
    nothing = toxicity.learn(df, labels.filter("toxic = 0"))
    assert nothing is None and {r["score"] for r in rows(toxicity.score(df, nothing))} == {0.0}
    assert rows(toxicity.score(df.limit(0), toxicity.learn(df, labels))) == []


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] >= 2 * n.get((1, 0), 0) and n.get((0, 1), 0) <= 0.05 * n[(0, 0)]


def test_toxicity_fold(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.fold("doc_id").alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows(df))


def test_toxicity_counts_do_not_collide(spark):
    train = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{'xyz'[j % 3] * (1 + j)} w"
                       for i in range(10_000) for _ in range(3)), j % 2) for j in range(31)]
    counts = toxicity.count_tables(spark.createDataFrame(train, "text string, label int").repartition(4))
    got = {(r["kind"], r["key"], r["other"]): r for r in counts.filter("kind <> 0").collect()}
    words, pairs = Counter(), Counter()
    for text, label in train:
        w = text.split()
        pairs.update(zip(["", *w], w, [label] * len(w)))
    before = {}
    for a, b, _ in pairs:
        before.setdefault(b, set()).add(a)
    assert len(before) > 1 << 18
    key = dict(zip(before, toxicity._hash(list(before)).tolist()))
    assert all(got[(toxicity.WORD, key[w], 0)]["every"] == len(x) for w, x in before.items())
    assert sum(k[0] == toxicity.WORD for k in got) == len(before)


def test_toxicity_counts_all_rows(spark):
    docs = spark.createDataFrame([(i, "rare word" if i % 3 else "other word") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    scorer = toxicity.learn(docs, labels, max_rows=10)
    assert scorer is not None
    chosen = {r["_lid"]: r["_curve"] for r in toxicity.label_rows(labels, "doc_id", "toxic", 10).collect()}
    assert set(chosen) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2} and 0 < sum(chosen.values()) < 30
    rows_ = docs.select("text", F.when(F.col("doc_id") < 200, F.col("doc_id") % 2).cast("int").alias("label"))
    got = {(r["kind"], r["key"], r["other"]): r for r in toxicity.count_tables(rows_).collect()}
    rare, word = toxicity._hash(["rare", "word"]).tolist()
    assert got[(toxicity.CONTEXT, rare, 0)]["every"] == 266 and got[(toxicity.CONTEXT, rare, 0)]["off"] == 2
    assert got[(toxicity.PAIR, rare, word)]["t1"] == sum(i % 3 > 0 and i % 2 for i in range(200))


def test_toxicity_pair_hash(spark):
    pairs = np.random.default_rng(2).integers(-2**63, 2**63, (100, 2))
    df = spark.createDataFrame(pairs.tolist(), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    a, b, h = (np.array(x) for x in zip(*df.collect()))
    assert (toxicity._hash_pairs(a, b) == h).all()


def test_toxicity_joined_model(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    sent = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    monkeypatch.setattr(toxicity, "FEW_ENTRIES", 0)
    monkeypatch.setattr(toxicity, "LOOK_UP", 300_000)
    scorer = toxicity.learn(docs, labels)
    joined = toxicity.score(docs, scorer)
    assert scorer.shared is None and joined.columns == [*docs.columns, "score"]
    joined = {r["doc_id"]: r["score"] for r in joined.collect()}
    assert joined.keys() == sent.keys() and all(abs(joined[i] - sent[i]) < 1e-9 for i in sent)


# packing

def whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tok.encode_special_tokens = True
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def test_encoder():
    enc = packing.Encoder(packing.VOCABULARY)
    for t in ["", " ", "  a  b ", " x", "a\n b\t c", "it's  'll we've 12 3a  \n\n q", "é ñ  x z\x1c w", "<|endoftext|> a",
              "漢字 かな　x", "x" * 5000 + " y", "a \x85 b  c"]:
        assert enc.encode(t) == whole(t)[:-1].tobytes(), t


def test_added_tokens_are_found(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "a <|endoftext| > b", "plain words here"]
    got = rows(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True))
    want = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert np.frombuffer(want[0], dtype="<u4").tolist() == [64, 220, 50256, 275, 2]


def test_fullest_is_best():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = np.zeros(31, dtype=np.int64)
        counts[rng.integers(1, 31, 6)] += rng.integers(1, 4, 6)
        room, sums = int(rng.integers(0, 31)), {0}
        for length in range(31):
            for _ in range(counts[length]):
                sums |= {s + length for s in sums if s + length <= room}
        took = packing.fullest(counts, room)
        assert sum(took) == max(sums) and all(n <= counts[x] for x, n in Counter(took).items())


def test_plan_takes_every_piece_once():
    rng = np.random.default_rng(4)
    counts = np.zeros(65, dtype=np.int64)
    counts[1:] = rng.integers(0, 1000, 64)
    runs = packing.plan(counts, 64)
    used = np.zeros(65, dtype=np.int64)
    for lengths, times in runs:
        assert sum(lengths) <= 64
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    total = sum(t for _, t in runs)
    assert total <= -(-int((counts * np.arange(65)).sum()) // 64) * 1.01 + 1
    assert len(runs) <= 64 + sum(64 // n for n in range(1, 65))


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    enc = packing.Encoder(packing.VOCABULARY, added=True)
    texts = ["", " ", "one two three", "one  two", "two\ttwo three ", "x <|endoftext|> one two", "naïve naïve 東京 one", "one two," * 3,
             "two\nthree one", "  one", *["one two three four"] * 50]
    want = [enc.encode(t) + packing._bytes([2]) for t in texts]
    fresh, asked = packing.Encoder(packing.VOCABULARY, added=True), []

    class Counted(packing._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    fresh.words = Counted(fresh, " ")
    assert fresh.encode_all(pa.array(texts), 2) == want
    assert sum(w == "four" for w in asked) == 1


def test_other_work_lets_a_model_go(spark, monkeypatch):
    class Rows:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"]})
    for run in (packing.cut(Rows(), "doc_id", "text", 8, 2, packing.VOCABULARY, False),
                chosen_path.sketch(Rows(), "doc_id", "text", 3)):
        assert lookup.opened(type("B", (), {"value": object()})(), lambda v: "model") == "model"
        assert len(list(run(iter([batch])))) == 1
        assert not lookup._OPEN
    assert not packing.Encoder.open(packing.VOCABULARY).words


def test_packing(spark, edge_docs, no_docs):
    docs = [r["text"] for r in rows(edge_docs)]
    got = rows(packing.pack(edge_docs, with_ids=True))
    assert Counter(b"".join(r["ids"] for r in got if r["doc_id"] == 4)) == Counter(whole(next(d for d in docs if len(d or "") > 999)).tobytes())
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert sum(r["doc_id"] == 5 for r in got) == 2 and [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 4)
    assert all(p[2] == 1024 for p in pieces[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and sum(n for _, n in x) <= 1024
    assert len(by) == -(-sum(r["length"] for r in got) // 1024)
    assert rows(packing.pack(no_docs)) == []


# near-duplicate texts

def shingles(t, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def check_texts(got, data, k, pct):
    sets = {i: shingles(t, k) for i, t in data if i is not None}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b])]
    comp = components(ids, links)
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (
                len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def near_copies(seed=5):
    rng, out = random.Random(seed), []
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 200))] for _ in range(25)]
    for b in base:
        for _ in range(rng.randrange(1, 8)):
            w = list(b)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out += ["ABC def  ghi", "abc\tDEF ghi", "one", "One", "two words", "É x y z", "é x y z", "", None, " \n"]
    rng.shuffle(out)
    return list(enumerate(out)) + [(None, out[0]), (None, "only here and there")]


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_trees_allow_for_shared_coordinates(similarity):
    same = np.random.default_rng(9).binomial(chosen_path.COORDS, similarity, 400_000) / chosen_path.COORDS
    stays = 1 - (1 - same) * (1 - (1 / similarity - 1) * same)
    assert ((1 - stays ** chosen_path.DEPTH) ** chosen_path.trees_needed(similarity)).mean() <= 1.1 * chosen_path.MISS


@pytest.mark.parametrize(("k", "pct", "node", "block"), [(3, 85, 1024, 256), (5, 80, 4, 3)])
def test_near_texts(spark, monkeypatch, k, pct, node, block):
    monkeypatch.setattr(chosen_path, "NODE", node)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    data = near_copies()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, kept long, rep string").repartition(4)
    check_texts(rows(chosen_path.near_duplicates(df, shingle=k, pct=pct)), data, k, pct)


def test_near_texts_edges(spark, edge_docs, no_docs):
    got = rows(chosen_path.near_duplicates(edge_docs, shingle=3, pct=85))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[7]["component_id"] == by[6]["component_id"] == by[5]["component_id"] == 5
    assert by[4]["n_shingles"] == 3 and by[1]["kept"] and by[2]["component_id"] == 2
    assert rows(chosen_path.near_duplicates(no_docs)) == []


def test_near_texts_brute_force_on_table(spark, sf):
    data = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))]
    check_texts(rows(QUERIES["op7_chosen_path"](spark, sf)), data, 3, 85)


def test_join_counted_both_ways(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(60)], "k long, v long")
    facts = left.groupBy("k").agg(F.count("*").alias("n")).filter("k < 2")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(facts, "k", how).select("k", "v", "n").collect()))
        for floor in (0, 1000):
            assert sorted(map(str, join_counted(left, facts, ["k"], "n", how, floor=floor).select("k", "v", "n").collect())) == plain


# near-duplicate vectors

def check_vectors(got, data, least=1.0):
    usable = {i: np.array(v, dtype=np.float64) for i, v in data if i is not None and v is not None and None not in v
              and np.isfinite(v).all() and np.any(v)}
    ids, links = sorted(usable), []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = usable[a], usable[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links.append((a, b))
    comp, degree = components([i for i, _ in data if i is not None], links), Counter(x for p in links for x in p)
    assert len(got) == len(data)
    found = sum(r["n_links"] for r in got)
    assert least * 2 * len(links) <= found <= 2 * len(links)
    for r in got:
        if r["vec_id"] is None or least < 1:
            assert r["vec_id"] is not None or (r["n_links"] == 0 and r["kept"])
            continue
        assert (r["n_links"], r["component_id"]) == (degree[r["vec_id"]], comp[r["vec_id"]]), r
        assert r["kept"] == (r["vec_id"] == r["component_id"])


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    rng, data = np.random.default_rng(6), []
    for c in rng.standard_normal((40, 16)):
        data += [(c + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist() for _ in range(rng.integers(1, 9))]
    data += [data[0], data[0], [2 * x for x in data[1]], None, [0.0] * 16, [1.0, None], [float("nan")] * 16, [], [1.0, 0.0],
             [1.0, 0.01]]
    rng.shuffle(data)
    data = list(enumerate(data)) + [(None, data[0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, n_links long, key string")
    check_vectors(rows(projections.near_vectors(df.repartition(3))), data)
    assert rows(projections.near_vectors(df.limit(0))) == []


def test_near_vectors_with_gaps_in_the_ids(spark):
    rng = np.random.default_rng(8)
    data = [(2 * i, (np.ones(8) + 0.001 * rng.standard_normal(8)).tolist()) for i in range(1500)]
    got = rows(projections.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert {r["n_links"] for r in got} == {1499} and {r["component_id"] for r in got} == {0}
    members = spark.createDataFrame([(i[0], 1500) for i in data], "rep long, size long")
    groups = blocks.block_pairs(members, ["size"], "size", "rep", 1024).groupBy("group", "_across", "_own").count().collect()
    assert len({r["group"] for r in groups}) == 3 and all(600 < r["count"] < 900 for r in groups)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_windows_on_sorted_lines_count_collisions(n):
    codes = np.random.default_rng(9).integers(0, 256, (n, projections.LINES)).astype(np.uint8)
    codes[n // 2:, 3] = 7  # ties
    wide = codes.astype(int)
    for half in (0, 15, 300):
        expected = (abs(wide[:, None, :] - wide[None, :, :]) <= half).sum(axis=2)
        assert (projections.collisions(codes, half) == expected).all()


def test_only_members_of_passing_pairs_go_on(spark):
    rng = np.random.default_rng(10)
    far = rng.standard_normal((400, 64))
    near = far[0] + 0.01 * rng.standard_normal((5, 64))
    data = [(i, v.tolist()) for i, v in enumerate([*far, *near])]
    prepared, dtype = projections.prepare(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    sets = projections.encode(prepared.select("key", F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"), "vector"),
                              dtype, *projections.cell_plan(len(data), 0.9))
    members = projections.routed(sets)
    assert "vector" not in members.columns
    got = {r["rep"] for r in projections.passing(members, 0.9).collect()}
    assert {0, *range(400, 405)} <= got and len(got) < 60


def test_recall_at_the_threshold(spark):
    rng, data = np.random.default_rng(7), []
    for x in rng.standard_normal((600, 32)):
        x /= np.linalg.norm(x)
        y = rng.standard_normal(32)
        y -= y @ x * x
        data += [x.tolist(), (0.905 * x + np.sqrt(1 - 0.905 ** 2) * y / np.linalg.norm(y)).tolist()]
    data = list(enumerate(data))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    check_vectors(rows(projections.near_vectors(df)), data, least=0.9)


def test_near_vectors_on_table(spark, sf):
    data = [(r["vec_id"], r["embedding"]) for r in rows(spark.read.parquet(f"{sf}/embeddings.parquet"))]
    check_vectors(rows(QUERIES["op5_projections"](spark, sf)), data)


# pipeline

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "stage-test"))
    assert all(d.columns == columns for d in seen[:-1])
    toxic, quality, unique, mixed = ({r["doc_id"]: r["text"] for r in rows(d)} for d in seen[1:5])
    scores = {r["doc_id"]: r["score"] for r in rows(QUERIES["op3_toxicity"](spark, sf))}
    assert set(toxic) == {i for i, s in scores.items() if s < toxicity.REJECT}
    assert set(quality) <= set(toxic)
    sets = {i: shingles(t, 5) for i, t in quality.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    assert set(unique) == {i for i in ids if comp[i] == i}
    copies = Counter(r["doc_id"] for r in rows(seen[4]))
    assert set(mixed) <= set(unique) and max(copies.values()) <= 2
    lengths = Counter()
    for r in rows(seen[5]):
        lengths[r["doc_id"]] += r["length"]
    assert lengths == Counter({i: n * len(whole(unique[i])) for i, n in copies.items()})


def test_pipeline_edges(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() >= 0
            assert name == "packing" or out.columns == docs.columns


def test_cluster_rows_grow_with_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 4)
    found = spark.range(400).selectExpr("7L as cluster", "id as rep", "id as place", "400L as size")
    assert chosen_path.first_pairs(found).count() <= 3 * 400
    joined = spark.range(400).selectExpr("id as rep", "0L as component")
    assert chosen_path.last_pairs(found, joined).isEmpty()
    apart = spark.range(400).selectExpr("id as rep", "if(id < 398, 0, id) as component")
    assert chosen_path.last_pairs(found, apart).count() <= 3 * 400


def test_sets_without_a_link_are_their_own_component(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 4)
    found = spark.range(40).selectExpr("7L as cluster", "id as rep", "id as place", "40L as size")
    linked = spark.range(1, 38).selectExpr("id as rep", "0L as component")
    got = {r["rep"] for r in chosen_path.last_pairs(found, linked).collect()}
    assert got == set(range(40))


def test_verified_takes_texts_by_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SHINGLED", 40)
    text = [f"a{i // 3} b c d e f{i % 3 // 2}" for i in range(30)]
    docs = spark.createDataFrame([*enumerate(text), (3, " "), (4, text[4])], "id long, text string")
    pairs = spark.createDataFrame([(i // 6, i) for i in range(30)], "group long, rep long")
    plan = chosen_path.verified(pairs, pairs, docs, 1, 100)
    assert sorted(map(tuple, plan.collect())) == [(i, i + 1) for i in range(0, 30, 3)]
    assert "shingles" not in plan._jdf.queryExecution().toString()


def test_scoring_holds_few_texts_together(monkeypatch):
    seen = []

    class Held:
        def evidence(self, texts):
            seen.append(sum(map(len, texts)))
            return np.zeros((len(texts), 4))

    assert len(toxicity._rated(Held(), iter(["x" * 1000] * 2000), None)) == 2000
    assert sum(seen) == 2_000_000 and max(seen) <= 6 * 50_000 + 1000


def test_few_sets_take_few_tasks_under_many_shuffle_partitions(spark, monkeypatch):
    files = {}

    def counted(df, name):
        out = written(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(chosen_path, "written", counted)
    data = [(i, " ".join(f"w{(i // 2 * 31 + j) % 997}x{i // 2}" for j in range(9))) for i in range(1_200)]
    many = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = chosen_path.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in data}
    # the sketch is made where the texts lie; all else had up to 211 files
    assert files["sets"] <= 4 * spark.sparkContext.defaultParallelism
    assert files["members"] <= 4 * spark.sparkContext.defaultParallelism
