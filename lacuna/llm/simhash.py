"""SimHash near-duplicates: fingerprints over word shingles, linked by a binary trie self-join, then components.

Distinct fingerprints are joined, not documents, so groups of copies cost one row. Of fingerprints that differ in at
most 3 of 64 bits, one of four 16-bit blocks agrees. So each fingerprint enters four tries, each with another block
first; there the traversal begins at the node that block leads to, paired with itself, and goes down in pairs of
nodes: differing bits add up, and a pair of nodes whose sum exceeds the budget is left. Nodes of one trie are dealt
to tasks by that block. A node with more than ``NODE_ROWS`` fingerprints is split, and each pair of its parts is a
task's work, so no key is bound to one task. A task gives only the edges of a spanning forest of what it has
linked; components over these are those over all links.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; a
text of fewer words than a shingle is one shingle; repeated shingles count each time; repeated rows each give a row;
a null id never names a component if another id is in it; an empty table gives an empty result.

A fingerprint may be that of any share of the documents: the few that hold many of them are not dealt by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, free_name, join_counted, join_listed, written
from lacuna.llm.components import components, forest

SEED = 42
#: Fingerprints of one trie node that a task takes at once; a larger node is split.
NODE_ROWS = 16_384
#: Rows of many small nodes that are traversed together.
ROWS = 65_536
_LEAF = 256  # pairs of fingerprints under a pair of nodes from which on they are compared directly
_PAIRS = 4_000_000  # pairs compared at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -shingle].tolist()]
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The id, ``hash`` of the text and ``fp``, the fingerprint, as signed 64-bit integers, of each row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["id", "hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, hash bigint, fp bigint")


def trie_pairs(codes: np.ndarray, nodes: list[tuple[int, int, int, int]], budget: int, level: int, found) -> None:
    """Traverse pairs of trie nodes together, and give ``found`` the rows (u, v) whose codes differ in at most ``budget`` bits.

    ``codes`` are sorted within each node; a node is a range of rows that agree in the first ``level`` bits, and
    ``nodes`` are pairs of them that agree with each other there: (a0, a1, b0, b1), a node paired with itself or with another.
    """
    ones: dict[int, np.ndarray] = {}

    def before(bit: int) -> np.ndarray:
        """How many codes before each row have this bit."""
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        return ones[bit]

    first = np.array(nodes, dtype=np.int64).reshape(-1, 4)
    todo = [(level, first, np.zeros(len(first), np.int64))]
    while todo:
        bit, at, err = todo.pop()
        small = ((at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2]) <= _LEAF) | (bit >= 64)
        _compare(codes, at[small], budget, found)
        at, err = at[~small], err[~small]
        if not len(at):
            continue
        if len(at) > 500_000:  # keeps the frontier small
            half = len(at) // 2
            todo += [(bit, at[:half], err[:half]), (bit, at[half:], err[half:])]
            continue
        n = before(bit)
        ma, mb = at[:, 1] - (n[at[:, 1]] - n[at[:, 0]]), at[:, 3] - (n[at[:, 3]] - n[at[:, 2]])
        same = (at[:, 0] == at[:, 2]) & (at[:, 1] == at[:, 3])
        child = lambda a0, a1, b0, b1, more, where: (np.stack([a0, a1, b0, b1], 1)[where], (err + more)[where])
        each = [
            child(at[:, 0], ma, at[:, 2], mb, 0, slice(None)),
            child(ma, at[:, 1], mb, at[:, 3], 0, slice(None)),
            child(at[:, 0], ma, mb, at[:, 3], 1, slice(None)),
            child(ma, at[:, 1], at[:, 2], mb, 1, ~same),
        ]
        at, err = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
        go = (at[:, 0] < at[:, 1]) & (at[:, 2] < at[:, 3]) & (err <= budget)
        if go.any():
            todo.append((bit + 1, at[go], err[go]))


def _compare(codes: np.ndarray, at: np.ndarray, budget: int, found) -> None:
    """Compare all codes under pairs of nodes."""
    width = at[:, 3] - at[:, 2]
    size = (at[:, 1] - at[:, 0]) * width
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), _PAIRS)) if len(at) else []
    for i, x in enumerate(cuts):
        y = cuts[i + 1] if i + 1 < len(cuts) else len(at)
        if x >= y:
            continue
        n = size[x:y]
        of = np.repeat(np.arange(x, y), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        u, v = at[of, 0] + k // width[of], at[of, 2] + k % width[of]
        near = (np.bitwise_count(codes[u] ^ codes[v]) <= budget) & (u != v)
        if near.any():
            found(u[near], v[near])


def _rotated(fp: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The bits with block ``turn`` first."""
    by = (turn * 16).astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) & np.uint64(63))))


def _linked(rows: list[tuple], budget: int):
    """Edges of a spanning forest of what rows (turn, block, i, j, part, fp), sorted by node pair, link."""
    turn, i, j, part = (np.concatenate([r[k] for r in rows]) for k in (0, 2, 3, 4))
    fp = np.concatenate([r[5] for r in rows]).view(np.uint64)
    code = _rotated(fp, turn)
    order = np.lexsort((code, part, j, i, code >> np.uint64(48), turn))
    turn, i, j, part, fp, code = (x[order] for x in (turn, i, j, part, fp, code))
    top = code >> np.uint64(48)
    new = np.ones(len(code), bool)
    new[1:] = (turn[1:] != turn[:-1]) | (top[1:] != top[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(code))
    nodes = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            if i[a] == j[a]:
                nodes.append((a, b, a, b))
            else:
                m = a + int(np.searchsorted(part[a:b], j[a]))
                nodes.append((a, m, m, b))
    label = np.arange(len(code))
    trie_pairs(code, nodes, budget, 16, lambda u, v: forest(label, u, v))
    tied = np.flatnonzero(label != np.arange(len(code)))
    return fp[tied].view(np.int64), fp[label[tied]].view(np.int64)


def _links(distinct: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all links."""
    blocks = F.array(*[F.struct(F.lit(t).alias("turn"), F.shiftrightunsigned("fp", 48 - 16 * t).bitwiseAND(0xFFFF).alias("block")) for t in range(4)])
    rows = distinct.select("fp", F.explode(blocks).alias("x")).select("x.turn", "x.block", "fp")
    large = rows.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).withColumn("parts", F.ceil(F.col("n") / node_rows).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    rows = join_listed(rows, large, ["turn", "block"], "n", 4 * distinct.count())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    rows = rows.select("turn", "block", "part", "fp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("turn", "block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")

    def run(batches):
        held, n = [], 0
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(6)]
            if n + len(now[0]) >= ROWS and held:
                # All but the last node pair can go.
                key = [np.concatenate([h[k] for h in held]) for k in range(6)]
                same = np.all([key[k] == key[k][-1] for k in range(4)], axis=0)
                cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
                if cut:
                    yield from edges([tuple(x[:cut] for x in key)])
                held = [tuple(x[cut:] for x in key)]
                n = len(same) - cut
            held.append(tuple(now))
            n += len(now[0])
        if n:
            yield from edges(held)

    def edges(held):
        u, v = _linked(held, budget)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    dealt = rows.repartition("turn", "block", "i", "j").sortWithinPartitions("turn", "block", "i", "j")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, budget: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, hash, fp) of each row, and (fp, n, first, least) of each fingerprint, both written.

    ``n`` rows have the fingerprint; ``first`` (without, id, hash) is the least of them, and ``least`` that of the
    component; rows without an id come last.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find at most 3 differing bits")
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("without"), "id", "hash")
    groups = written(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("first")), "groups")
    joined = components(_links(groups.select("fp"), budget, node_rows))
    with_first = joined.join(groups, joined.node == groups.fp).select("fp", "root", "first")
    # A component may hold any share of the fingerprints.
    roots = cut(with_first.groupBy("root").agg(F.count("*").alias("size"), F.min("first").alias("least")))
    found = join_counted(with_first, roots, "root", "size").select("fp", "least")
    return marked, written(groups.join(found, "fp", "left").withColumn("least", F.coalesce("least", "first")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, fp, component_id) of each row: the smallest id that links reach from it, itself included."""
    marked, classes = _classes(docs, id_col, text_col, shingle, budget, node_rows)
    rows = join_counted(marked, classes.select("fp", "n", F.col("least.id").alias("component_id")), "fp", "n")
    return rows.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, then the smallest hash of its text.

    A row is known by its id and the hash of its text; a null id is one too, after all others. Of rows that agree in
    both, the one that is least as JSON stays.
    """
    marked, classes = _classes(docs, id_col, text_col, shingle, budget, node_rows)
    key, own = free_name("_key", docs.columns), [F.col(f"`{c}`") for c in docs.columns]
    best = classes.where("first = least").select("fp", F.col("least.id").alias("id"), F.col("least.hash").alias("hash"))
    # How many rows agree with the one that stays; a fingerprint has one best row.
    same = marked.groupBy("fp", "id", "hash").agg(F.count("*").alias("rows"))
    kept = same.join(best, (same.fp == best.fp) & same.id.eqNullSafe(best.id) & (same.hash == best.hash), "left_semi")
    kept = written(kept.select(F.struct("id", "hash").alias(key), F.col("rows").alias("_rows"), F.col("rows").alias("_n")), "kept")
    keyed = docs.select(*own, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("hash")).alias(key))
    if kept.where("_rows > 1").isEmpty():
        return join_counted(keyed, kept.select(key, "_n"), key, "_n", alike=True).select(*own)
    rows, many = free_name("_rows", docs.columns), free_name("_many", docs.columns)
    met = join_counted(keyed, kept.withColumnRenamed("_rows", many) if many != "_rows" else kept, key, "_n", alike=True)
    whole = F.struct(*own)
    first = met.where(F.col(many) > 1).groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(rows))
    return met.where(F.col(many) == 1).select(*own).union(first.select(*[F.col(f"{rows}.`{c}`") for c in docs.columns]))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of what ``near_duplicates`` found."""
    return found.select(id_col, F.format_string("%016x", "fp").alias("fingerprint"), "component_id")
