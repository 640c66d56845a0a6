"""Near-duplicate texts by a chosen-path set similarity join.

A text is the set of its word shingles, hashed to 64 bits; equal sets collapse to
the one with the smallest id. Every set keeps ``COORDS`` minwise tokens. A tree starts
with all sets in one node; every node draws which coordinates to branch on, one
and now and then a second, about 1 / similarity on average, and a set goes to the child named by its token there.
Sets that resemble each other stay together. Nodes that are small enough, or as deep
as ``DEPTH``, are compared exhaustively: first on minwise tokens, and what may be
similar on the full sets, which alone decide. Trees, which share the coordinates but draw
on their own, are repeated until a pair at the threshold is missed with probability ``MISS`` at most. The first tree joins most groups; later
ones compare only sets that are not connected yet, so a large group of near copies
costs a spanning set of links and not all its pairs. No comparison is left out:
nodes with more sets than a task takes are compared block by block.

Defined cases: null and empty texts have no shingles and link with nothing; a text
with fewer words than a shingle is one shingle, its whole sequence; rows that share
an id are one document, linked; a null id links with nothing and is kept. Only the columns
named in ``near_duplicates`` come back. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import contract
from ..operators.stats import join_large
from ..session import cut_lineage
from .blocks import Union, block_pairs, grouped, sorted_groups
from .common import TASK_ROWS, dealt, if_few, join_counted
from .lookup import let_go
from .memory import tidy
from .store import written

COORDS, DEPTH, MISS = 64, 4, 0.001
#: Sets in a node that is compared as one, and in a block of full sets.
NODE, BLOCK = 1024, 256
#: Texts that are worth a task of their own.
TEXTS = 2_000
#: Bytes of text whose sets a comparing task forms together.
SHINGLED = 2_000_000
#: Standard deviations below the threshold at which minwise tokens still count as similar.
MARGIN = 4.0
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (fixed values of the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, COORDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def trees_needed(similarity: float) -> int:
    """Trees after which a pair at the threshold is missed with probability ``MISS`` at most.

    All trees branch on the same coordinates, so the miss is averaged over how many of these agree.
    """
    trees = 1
    while missed(similarity, trees) > MISS:
        trees += 1
    return trees


def missed(similarity: float, trees: int) -> float:
    """Probability that no tree keeps a pair at the threshold together down to ``DEPTH``."""
    total = 0.0
    for same in range(COORDS + 1):
        share = same / COORDS
        stays = 1 - (1 - share) * (1 - (1 / similarity - 1) * share)
        total += math.comb(COORDS, same) * similarity ** same * (1 - similarity) ** (COORDS - same) * (1 - stays ** DEPTH) ** trees
    return total


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words end at ASCII white space, A-Z count as a-z."""
    words, sizes = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()
        sizes.append(len(w))
        words += w
    if not words:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(uniques, categorize=False)[codes]
    rolled = h.copy()
    for i in range(1, k):
        rolled = _mix(rolled)
        rolled[:len(h) - i] += h[i:]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= k:
            out.append(np.unique(rolled[at:at + n - k + 1]))
        elif n:
            whole = _U(n)
            for x in h[at:at + n]:
                whole = _mix(np.array([whole], dtype=np.uint64))[0] ^ x
            out.append(_mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def _tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets, one row of ``COORDS`` 32-bit numbers each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), dtype=np.uint32)
    for c in range(COORDS):
        out[:, c] = np.minimum.reduceat(((flat ^ _SEEDS[c]) * (_SEEDS[c] | _U(1))) >> _U(32), starts)
    return out


def _text_runs(column: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    run, held = [], 0
    for t in column:
        run.append(t.as_py() or "")
        held += len(run[-1])
        if held > chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def sketch(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n_shingles, set_key, tokens, lows) per row; key, tokens and their low bytes are null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            at = 0
            for texts in _text_runs(b.column(1)):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts, k)
                    some = [s for s in sets if len(s)]
                    rows = iter(_tokens(some)) if some else iter(())
                keys, tokens, lows = [], [], []
                for s in sets:
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    own = next(rows) if len(s) else None
                    tokens.append(own.tobytes() if len(s) else None)
                    # of a minwise token the low byte, because the high ones are nearly always zero
                    lows.append(own.astype(np.uint8).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(lows, pa.binary())],
                    ["id", "n_shingles", "set_key", "tokens", "lows"])
                at += len(texts)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "id long, n_shingles long, set_key binary, tokens binary, lows binary")


def _rows(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, COORDS)


def _children(node: np.ndarray, tokens: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of (node, tokens) rows and the rows they come from."""
    x = _mix(node ^ _U(0xA5A5A5A5A5A5A5A5))
    first, second = (x % _U(COORDS)).astype(int), ((x >> _U(40)) % _U(COORDS)).astype(int)
    both = (((x >> _U(12)) & _U(0xFFFFF)) < _U(int(extra * 2**20))) & (second != first)
    row = np.concatenate([np.arange(len(node)), np.flatnonzero(both)])
    coord = np.concatenate([first, second[both]])
    value = tokens[row, coord].astype(np.uint64)
    return _mix(_mix(node[row] + _U(0x9E3779B97F4A7C15) * (coord.astype(np.uint64) + _U(1))) ^ value), row


def _branch(rows: DataFrame, trees: tuple[int, ...], extra: float) -> DataFrame:
    """From (rep, tokens) or (node, rep, tokens) to (node, rep) one level down."""
    rooted = "node" not in rows.columns
    roots = _mix(np.array(trees, dtype=np.uint64) + _U(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                rep, tokens = b.column(b.schema.get_field_index("rep")).to_numpy(), _rows(
                    b.column(b.schema.get_field_index("tokens")))
                starts = ([np.full(len(rep), r, dtype=np.uint64) for r in roots] if rooted
                          else [b.column(b.schema.get_field_index("node")).to_numpy().view(np.uint64)])
                for node in starts:
                    child, row = _children(node, tokens, extra)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[row])], ["node", "rep"])

    return rows.mapInArrow(tidy(run), "node long, rep long")


def leaves(reps: DataFrame, trees: tuple[int, ...], similarity: float) -> DataFrame:
    """(node, rep, size) rows of all nodes with two or more sets that are compared."""
    out, rows = None, reps.select("rep", "tokens")
    extra = 1 / similarity - 1
    n = reps.count() * len(trees)
    for level in range(DEPTH):
        # a pair may branch to one child by both coordinates only if these are the same
        children = dealt(_branch(rows, trees, extra).distinct(), n) if level else _branch(rows, trees, extra)
        children = written(children, "nodes")
        n = children.count()
        sizes = cut_lineage(dealt(children.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), n))
        members = written(dealt(join_counted(children, sizes, ["node"], "size"), n), "members")
        last = level == DEPTH - 1
        small = members if last else members.filter(F.col("size") <= NODE)
        out = small if out is None else out.unionByName(small)
        if last or members.filter(F.col("size") > NODE).isEmpty():
            return out
        rows = dealt(members.filter(F.col("size") > NODE).select("node", "rep").join(reps.select("rep", "tokens"), "rep"), n)
    return out


def candidates(leaf: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Clusters of sets whose tokens look similar: distinct (cluster, rep, place, size).

    Only sets in different components need a comparison, and one byte of each token, ``lows``, does for it:
    different tokens agree there by chance one time in 256. Clusters found by several
    trees with the same members are one.
    """
    agree = similarity + (1 - similarity) / 256
    cut = (agree - MARGIN * math.sqrt(agree * (1 - agree) / COORDS)) * COORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, "group"):
            tokens, rep, comp = _rows(table.column("lows").combine_chunks(), np.uint8), table.column("rep").to_numpy(), table.column(
                "component").to_numpy()
            out = {"cluster": [], "rep": [], "place": [], "size": []}
            n = np.diff(at)
            # groups of two at once, larger ones row by row
            two = at[:-1][n == 2]
            alike = two[((tokens[two] == tokens[two + 1]).sum(1) >= cut) & (comp[two] != comp[two + 1])]
            found = [np.sort(rep[a:a + 2]) for a in alike]
            for a, b in zip(at[:-1][n > 2], at[1:][n > 2]):
                union, hit = Union(b - a), np.zeros(b - a, dtype=bool)
                for i in range(b - a - 1):
                    rest = (comp[a + i + 1:b] != comp[a + i]) & ((tokens[a + i + 1:b] == tokens[a + i]).sum(1) >= cut)
                    for j in np.flatnonzero(rest).tolist():
                        union.join(i, i + 1 + j)
                        hit[i] = hit[i + 1 + j] = True
                some = np.flatnonzero(hit)
                roots = np.array([union.find(i) for i in some.tolist()])
                found += [np.sort(rep[a + some[roots == r]]) for r in np.unique(roots)]
            for members in found:
                members = np.unique(members)
                name = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
                out["cluster"] += [name] * len(members)
                out["rep"] += members.tolist()
                out["place"] += range(len(members))
                out["size"] += [len(members)] * len(members)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    n = leaf.agg(F.sum(F.ceil(F.col("size") / NODE))).first()[0] or 0
    rows = block_pairs(leaf, ["node"], "size", "rep", NODE).select("group", "rep")
    rows = dealt(rows.join(reps.select("rep", "lows", "component"), "rep"), n)
    return dealt(sorted_groups(rows, run, "cluster long, rep long, place long, size long", n).distinct(), n)


def first_pairs(clusters: DataFrame) -> DataFrame:
    """Rows of clusters in blocks that are compared: all with the first one, and, as always in a group, within themselves.

    That connects most near copies with rows in proportion to a cluster; ``last_pairs`` has what it leaves out.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("place"), n).cast("int")
    others = F.when(own == 0, F.sequence(F.least(F.lit(1), n - 1), n - 1)).otherwise(F.array(own))
    return _paired(clusters, F.transform(others, lambda j: F.struct(F.lit(0).alias("p"), j.alias("q"))))


def last_pairs(clusters: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of the clusters of several blocks that are not connected yet, in all blocks that may add a link.

    The largest component of a cluster has blocks of its own, which are compared with those of the other sets only:
    so rows grow with the square of what is not connected, not of the cluster.
    """
    n = clusters.count()
    rows = cut_lineage(dealt(clusters.filter(F.col("size") > BLOCK).join(labelled.select("rep", "component"), "rep", "left"), n).withColumn(
        "component", F.coalesce("component", "rep")))
    sizes = rows.groupBy("cluster", "component").agg(F.count("*").alias("_n"))
    open_ = sizes.groupBy("cluster").agg(F.max(F.struct("_n", "component")).alias("_main"), F.sum("_n").alias("_all")).filter(
        F.col("_main._n") < F.col("_all"))
    facts = cut_lineage(dealt(open_, n).select("cluster", F.col("_main.component").alias("_comp"), F.ceil(F.col("_main._n") / BLOCK).cast("int").alias("_nm"),
                                     F.ceil((F.col("_all") - F.col("_main._n")) / BLOCK).cast("int").alias("_no")))
    held = rows.join(if_few(facts), "cluster")
    main = F.col("component") == F.col("_comp")
    drawn = F.xxhash64("place")
    own = F.when(main, F.col("_no") + F.pmod(drawn, F.col("_nm"))).otherwise(F.pmod(drawn, F.col("_no"))).cast("int")
    last = F.when(main, F.col("_no")).otherwise(F.col("_no") + F.col("_nm")) - 1
    others = F.filter(F.sequence(F.lit(0), last.cast("int")), lambda j: j != own)
    return _paired(held, F.transform(others, lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q"))))


def _paired(rows: DataFrame, pairs) -> DataFrame:
    out = rows.select("cluster", "rep", F.explode(pairs).alias("_pair"))
    return out.select(F.xxhash64("cluster", "_pair.p", "_pair.q").alias("group"), "rep")


def verified(pairs: DataFrame, clusters: DataFrame, docs: DataFrame, k: int, pct: int) -> DataFrame:
    """Links (u, v) between sets of a group of ``pairs`` whose full sets are similar: enough to connect all that are.

    Groups get the texts and form the sets themselves: hashes of shingles take more room than the words, and do not compress.
    """
    def links(rep: np.ndarray, sets: list[np.ndarray], us: list[int], vs: list[int]) -> None:
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts, union = np.cumsum(sizes) - sizes, Union(len(sets))
        here = np.zeros(ids.max() + 1, dtype=np.int32)
        for i in range(len(sets) - 1):
            mine = ids[starts[i]:starts[i] + sizes[i]]
            here[mine] = 1
            common = np.add.reduceat(here[ids[starts[i + 1]:]], starts[i + 1:] - starts[i + 1])
            here[mine] = 0
            either = sizes[i] + sizes[i + 1:] - common
            for j in np.flatnonzero(100 * common >= pct * either).tolist():
                if union.join(i, i + 1 + j):
                    us.append(int(rep[i]))
                    vs.append(int(rep[i + 1 + j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, "group"):
            rep, texts, us, vs = table.column("rep").to_numpy(), table.column("text"), [], []
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
            first = 0
            while first < len(at) - 1:  # whole groups of a bounded number of letters at a time
                before = ends[at[first] - 1] if at[first] else 0
                last = max(first + 1, int(np.searchsorted(ends[at[1:] - 1], before + SHINGLED, "right")))
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts.slice(at[first], at[last] - at[first]).to_pylist(), k)
                for a, b in zip(at[first:last], at[first + 1:last + 1]):
                    links(rep[a:b], sets[a - at[first]:b - at[first]], us, vs)
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    n = pairs.count()
    wanted = if_few(cut_lineage(dealt(clusters.select("rep").distinct(), n)))
    # dealt by rep once, for what repeats and for the join
    full = docs.join(wanted, docs["id"] == wanted["rep"]).select("rep", "text").repartition("rep").dropDuplicates(["rep", "text"])
    # a text without words cannot be a set of its own here: rows of an id that has others as well
    full = full.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return sorted_groups(dealt(join_large(pairs, full, "rep"), n, TEXTS), run, "u long, v long", n * TASK_ROWS // TEXTS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    pct: int = 80) -> DataFrame:
    """One row per row of ``df``: (id, n_shingles, component_id, kept).

    Texts are linked when 100 * |intersection| >= ``pct`` * |union| of their shingle
    sets; a component is named by its smallest id, and that row is kept.
    """
    similarity = pct / 100
    rows = written(sketch(df, id_col, text_col, shingle), "sketch")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    filled = rows.filter("set_key IS NOT NULL")
    n = rows.count()
    sets = written(dealt(filled.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tokens", "lows")).alias("x"),
                                                 F.count("*").alias("copies"))
                   .select("set_key", "copies", F.col("x.id").alias("rep"), F.col("x.tokens").alias("tokens"), F.col("x.lows").alias("lows")), n), "sets")
    reps = sets.filter("rep IS NOT NULL").select("rep", "tokens", "lows")
    roots = None
    # rows with one id but several sets are one document
    labelled = reps.withColumn("component", F.col("rep"))
    for trees in ((0,), tuple(range(1, trees_needed(similarity)))):
        found = cut_lineage(candidates(leaves(reps, trees, similarity), labelled, similarity))
        for last in (False, True):
            if last and found.filter(F.col("size") > BLOCK).isEmpty():
                break
            pairs = cut_lineage(dealt(last_pairs(found, roots), n)) if last else first_pairs(found)
            if last and pairs.isEmpty():
                break
            new = verified(pairs, pairs if last else found, docs, shingle, pct)
            if roots is not None:  # one link a set says what all earlier ones did
                new = new.unionByName(roots.select(F.col("rep").alias("u"), F.col("component").alias("v")))
            # sets that are not the least of their component; all others are their own
            roots = contract(new, [], lambda links: dealt(links, n)).withColumnsRenamed({"node": "rep", "root": "component"})
        labelled = dealt(reps.join(roots, "rep", "left"), n).withColumn("component", F.coalesce("component", "rep"))
    named = sets.select("set_key", "copies", "rep").join(roots, "rep", "left")
    named = cut_lineage(dealt(named, n).select("set_key", "copies", F.coalesce("component", "rep").alias("component_id")))
    out = dealt(join_counted(filled.select("id", "n_shingles", "set_key"), named, ["set_key"], "copies"), n)
    empty = rows.filter("set_key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = out.select("id", "n_shingles", "component_id").unionByName(empty)
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
