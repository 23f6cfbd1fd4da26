"""Embedding near-duplicates by iterative quantisation, multi-index Hamming tables and a rerank by original vectors.

``ROTATIONS`` rotations are learned on at most ``MAX_FIT`` vectors, each so that the signs of the rotated principal
components are a balanced binary code. The codes are cut into substrings of ``WIDTH`` bits, each the key of a table;
vectors with equal keys meet, by the same tables however many rows there are. Every row is indexed.

Codes travel first, without vectors: where they meet, a row stays a candidate if another differs from it in at most
``bound`` bits and has not met it in an earlier table. The bound follows from the threshold: sampled vectors are turned
by its angle at random, and what their codes then differ by gives mean and deviation; beyond ``DEVIATIONS`` of these
no pair is expected. Only candidates fetch their vectors, and cosines are computed from those in double precision.

Equal vectors become one row first. A bucket with more than ``BUCKET_ROWS`` rows is split, and each pair of its parts
is a task's work, so no row and no pair is dropped and no key is bound to one task. A task gives counts of links and
edges of a spanning forest per vector, never pairs.

Two vectors at the angle of the threshold differ in a bit with probability p = angle / pi if they lie around the mean;
they meet in no table with probability (1 - (1 - p)^WIDTH)^TABLES, 0.24 % for the cosine 0.98; closer ones less.
Every other rotation is not centred, so where vectors don't lie around the mean, 5 % is what its tables leave.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null,
links with nothing and is its own component; vectors of unequal length do not link; repeated rows link with each
other and each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, join_counted, join_listed, written
from lacuna.llm.components import components, forest

MAX_FIT = 10_000
ROUNDS = 40
#: Bits of a table's key, tables of a rotation, rotations: the same at any number of rows.
WIDTH, PER_ROTATION, ROTATIONS = 12, 5, 2
BITS, TABLES = WIDTH * PER_ROTATION, PER_ROTATION * ROTATIONS
DEVIATIONS = 8.0
#: Cosines by a matrix product may differ from those that decide by so much.
_SLACK = 1e-9
BUCKET_ROWS = 2_048
#: Pairs of codes compared at a time.
_PAIRS = 2_000_000


def fit(vectors: np.ndarray, rounds: int = ROUNDS, bits: int = BITS, seed: int = 3, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) by iterative quantisation of unit vectors: signs of (x - mean) @ projection are the code."""
    mean = vectors.mean(0) * centred
    x = vectors - mean
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)][:, :bits]
    v = x @ axes
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    turned = axes @ r
    if turned.shape[1] < bits:  # few dimensions: the code is filled up with random directions
        turned = np.concatenate([turned, rng.standard_normal((len(turned), bits - turned.shape[1]))], axis=1)
    return mean, turned


class Index:
    """The rotations of one length of vectors, and how many bits two codes of near-duplicates may differ by."""

    def __init__(self, vectors: np.ndarray, threshold: float, seed: int = 3):
        # Every other one is not centred: where all vectors point one way, centring makes large angles of small ones.
        self.models = [fit(vectors, seed=seed + k, centred=k % 2 == 0) for k in range(ROTATIONS)]
        rng = np.random.default_rng(seed)
        away = rng.standard_normal(vectors.shape)
        away -= (away * vectors).sum(1, keepdims=True) * vectors
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        t = min(max(threshold, -1.0), 1.0)
        near = t * vectors + np.sqrt(1 - t * t) * np.divide(away, norm, out=np.zeros_like(away), where=norm > 1e-12)
        d = np.bitwise_count(self.codes(vectors) ^ self.codes(near)).sum(1)
        self.bound = int(min(BITS * ROTATIONS, np.ceil(d.mean() + DEVIATIONS * max(d.std(), 1.0)))) if len(d) else 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit integer for each rotation, of which ``BITS`` are used, for each unit vector."""
        out = np.zeros((len(vectors), ROTATIONS, 8), np.uint8)
        for k, (mean, projection) in enumerate(self.models):
            packed = np.packbits((vectors - mean) @ projection > 0, axis=1, bitorder="little")
            out[:, k, : packed.shape[1]] = packed
        return out.reshape(len(vectors), -1).view(np.uint64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The key of each table, for each row of codes."""
    shift = np.uint64(WIDTH) * np.arange(PER_ROTATION, dtype=np.uint64)
    return ((codes[:, :, None] >> shift) & np.uint64((1 << WIDTH) - 1)).reshape(len(codes), TABLES).astype(np.int64)


def _matrix(vectors) -> np.ndarray:
    """An Arrow column of vectors of one length as rows of a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in (vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors])])
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # very large or small components: no overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(n: int, a: np.ndarray, b: np.ndarray | None):
    """Index pairs within ``a``, or between ``a`` and ``b``, some millions at a time."""
    other = a if b is None else b
    step = max(1, _PAIRS // max(1, len(other)))
    for at in range(0, len(a), step):
        i, j = np.divmod(np.arange(len(a[at : at + step]) * len(other)), len(other))
        i += at
        if b is None:
            later = i < j
            i, j = i[later], j[later]
        yield a[i], other[j]


def _fresh(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bound: int) -> np.ndarray:
    """Which pairs meet in no table before this one and differ in at most ``bound`` bits."""
    x = codes[i] ^ codes[j]
    ok = np.bitwise_count(x).sum(1) <= bound
    if table:
        ok[ok] = (keys_of(x[ok])[:, :table] != 0).all(1)
    return ok


def _units(batches, columns: int):
    """The rows of each unit (the first ``columns`` columns), which stand together."""
    held, last = [], None
    for b in batches:
        heads = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        new = np.zeros(b.num_rows, bool)
        for h in heads:
            new[1:] |= h[1:] != h[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            head = tuple(h[x] for h in heads)
            if head != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = head
            held.append(b.slice(x, y - x))
    if held:
        yield last, pa.Table.from_batches(held)


#: What makes a unit of work: a bucket, and two of its parts.
UNIT = ["label", "dim", "table", "key", "i", "j"]


def _sides(head: tuple, t: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    part, every = t.column("part").to_numpy(), np.arange(t.num_rows)
    return (every, None) if head[4] == head[5] else (every[part == head[4]], every[part == head[5]])


def _codes_in(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(f"c{k}").to_numpy() for k in range(ROTATIONS)], axis=1).view(np.uint64)


def _candidates(codes: DataFrame, sent, bucket_rows: int) -> DataFrame:
    """(unit, part, rid, codes) of rows that meet another one afresh, within the bound; ``codes``: (rid, label, dim, codes)."""
    own = ["rid", "label", "dim", *[f"c{k}" for k in range(ROTATIONS)]]
    key = lambda k, t: F.shiftrightunsigned(f"c{k}", WIDTH * t).bitwiseAND((1 << WIDTH) - 1)
    tables = F.array(*[F.struct(F.lit(k * PER_ROTATION + t).alias("table"), key(k, t).alias("key")) for k in range(ROTATIONS) for t in range(PER_ROTATION)])
    rows = codes.select(*own, F.explode(tables).alias("x")).select(*own, "x.table", "x.key")
    bucket = ["label", "dim", "table", "key"]
    large = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    rows = join_listed(rows, large, bucket, "n", TABLES * codes.count()).withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int"))
    rows = rows.select(*own, "table", "key", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    out = [*UNIT, "part", "rid", *own[3:]]
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select(*out)

    def run(batches):
        held, n = [], 0
        for head, t in _units(batches, len(UNIT)):
            if t.num_rows < 2:
                continue
            a, b = _sides(head, t)
            codes, some = _codes_in(t), np.zeros(t.num_rows, bool)
            for i, j in _pairs(t.num_rows, a, b):
                ok = _fresh(codes, i, j, int(head[2]), sent.value[int(head[1])].bound)
                some[i[ok]] = some[j[ok]] = True
            if some.any():
                held.append(t.filter(pa.array(some)))
                n += held[-1].num_rows
            if n > 10_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, rows.schema)


def _links(candidates: DataFrame, reps: DataFrame, sent, threshold: float) -> DataFrame:
    """(rid, links, other): counts of links and edges of spanning forests, by task."""
    rows = candidates.join(reps.select("rid", "vec", "mult"), "rid").select(*candidates.columns, "vec", "mult")

    def run(batches):
        for head, t in _units(batches, len(UNIT)):
            a, b = _sides(head, t)
            rid, mult, codes = t.column("rid").to_numpy(), t.column("mult").to_numpy(), _codes_in(t)
            vectors = _unit(_matrix(t.column("vec")))
            label, links = np.arange(len(rid)), np.zeros(len(rid), np.int64)
            for i, j in _pairs(len(rid), a, b):
                ok = _fresh(codes, i, j, int(head[2]), sent.value[int(head[1])].bound)
                i, j = i[ok], j[ok]
                for k in range(0, len(i), 200_000):
                    x, y = i[k : k + 200_000], j[k : k + 200_000]
                    close = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
                    x, y = x[close], y[close]
                    if len(x):
                        np.add.at(links, x, mult[y])
                        np.add.at(links, y, mult[x])
                        forest(label, x, y)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(links[some]), pa.array(rid[label[some]])], ["rid", "links", "other"])

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "rid bigint, links bigint, other bigint")


def _coded(reps: DataFrame, sent) -> DataFrame:
    """(rid, label, dim, codes) of each distinct vector."""
    names = ["rid", "label", "dim", *[f"c{k}" for k in range(ROTATIONS)]]

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            codes = np.zeros((b.num_rows, ROTATIONS), np.uint64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                codes[at] = sent.value[dim].codes(_unit(_matrix(b.column(3).take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(codes[:, k].view(np.int64)) for k in range(ROTATIONS)]], names)

    kind = reps.schema["label"].dataType.simpleString()
    return reps.select("rid", "label", "dim", "vec").mapInArrow(run, f"rid bigint, label {kind}, dim int, " + ", ".join(f"c{k} bigint" for k in range(ROTATIONS)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, max_fit: int = MAX_FIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    vec, label = F.col(vector_col), F.col(label_col)
    valid = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    # Equal vectors are known by two hashes, so that vectors need not travel to join.
    even = F.transform(vec, lambda x: x + F.lit(0).cast(vectors.schema[vector_col].dataType.elementType))  # the two zeros are one
    same = F.when(F.coalesce(valid & label.isNotNull(), F.lit(False)), F.struct(label.alias("label"), F.size(vec).alias("dim"), F.xxhash64(even).alias("x"), F.hash(even).alias("h")))
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), same.alias("same"))
    reps = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    reps = written(reps.select("*", "same.label", "same.dim").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # Models are learned where vectors have one length; a table of embeddings has one or a few of those.
    models = {}
    for (dim,) in reps.select("dim").distinct().collect():
        some = reps.where(F.col("dim") == dim).select("vec", "same").orderBy("same.x", "same.h").limit(max_fit).select("vec").toArrow()
        models[dim] = Index(_unit(_matrix(some.column("vec"))), threshold)
    sent = vectors.sparkSession.sparkContext.broadcast(models)  # ROTATIONS matrices of BITS columns for each length
    codes = written(_coded(reps, sent), "codes")
    candidates = written(_candidates(codes, sent, bucket_rows), "candidates")
    links = written(_links(candidates, reps, sent, threshold), "links")
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"))
    first = reps.select("rid", "same", "first", "mult")
    joined = components(links.select(F.col("rid").alias("u"), F.col("other").alias("v"))).join(first.select(F.col("rid").alias("node"), "first"), "node")
    # A component may hold any share of the vectors.
    roots = cut(joined.groupBy("root").agg(F.count("*").alias("size"), F.min("first").alias("least")))
    found = join_counted(joined, roots, "root", "size").select(F.col("node").alias("rid"), "least")
    classes = first.join(counts, "rid", "left").join(found, "rid", "left")
    classes = written(classes.select("same", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "classes")
    out = join_counted(rows.drop("vec"), classes, "same", "mult", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
