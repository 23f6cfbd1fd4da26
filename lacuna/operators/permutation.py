"""The permutation null: label incidences shuffled with both margins kept, in parallel over permutations.

One permutation is a chain of swaps and can't be split, but permutations can. The generator makes exactly two draws
per attempted swap, and its step is linear over bits, so the state in which permutation i begins is reached directly,
by powers of the step's matrix. The stream is the same as if permutations ran one after the other.

A permutation's swaps are done in the JVM, by ``PermutedCounts.java``, a function that is compiled at the first use. The
same in arrays, ``shuffled`` and ``counted``, is what it is tested against.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators.backtest import Backtest
from lacuna.params import SCORERS
from lacuna.session import drop_path, fresh_path, open_fs

# The generator's seed, multiplier and the swaps attempted per incidence.
NULL_SEED = 0x6E756C6C73656564
MULTIPLIER = 0x2545F4914F6CDD1D
SWEEPS = 20
#: Incidences and pairs that a permutation may hold in a worker.
MAX_INCIDENCES = 20_000_000
#: Bytes up to which who holds what is a table, a bit for each document and label.
MAX_CELLS = 1 << 28
#: Pairs of labels up to which all are counted in a table.
MAX_CODES = 1 << 22
#: Swaps that are looked at together, at most; below 2^14, as their places are 16-bit.
RUN = 1 << 12
#: Slots by which swaps of one document are told; a power of two.
SLOTS = 1 << 18
_MASK = 0xFFFFFFFFFFFFFFFF


def step(x: int) -> int:
    """The generator's next state."""
    x ^= x >> 12
    x = (x ^ (x << 25)) & _MASK
    return x ^ (x >> 27)


def _times(columns: list[int], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= columns[i]
        x >>= 1
        i += 1
    return out


def _product(a: list[int], b: list[int]) -> list[int]:
    return [_times(a, c) for c in b]


def jump(state: int, steps: int) -> int:
    """The state after so many steps."""
    power = [step(1 << i) for i in range(64)]
    while steps:
        if steps & 1:
            state = _times(power, state)
        power = _product(power, power)
        steps >>= 1
    return state


@lru_cache(maxsize=256)
def _matrix(steps: int) -> list[int]:
    """The columns of so many steps' matrix."""
    if not steps:
        return [1 << i for i in range(64)]
    half = _matrix(steps // 2)
    both = _product(half, half)
    return [step(c) for c in both] if steps & 1 else both


def draws(state: int, count: int, lanes: int = 16384) -> np.ndarray:
    """The next ``count`` numbers of the generator from ``state``: many stretches of the stream side by side."""
    length = -(-count // lanes)
    x = np.array([state], np.uint64)
    while len(x) < lanes:  # twice as many starts, the new ones as many stretches on
        bits = ((x >> np.uint64(i)) & np.uint64(1) for i in range(64))
        x = np.concatenate([x, np.bitwise_xor.reduce([b * np.uint64(c) for b, c in zip(bits, _matrix(length * len(x)), strict=True)])])
    x = x[:lanes]
    out = np.empty((length, lanes), np.uint64)
    moved = np.empty_like(x)
    for row in out:
        x ^= np.right_shift(x, np.uint64(12), out=moved)
        x ^= np.left_shift(x, np.uint64(25), out=moved)
        x ^= np.right_shift(x, np.uint64(27), out=moved)
        np.multiply(x, np.uint64(MULTIPLIER), out=row)
    return out.T.ravel()[:count]


class _Table:
    """Who holds what, a bit for each document and label. A cell is document << shift | label."""

    def __init__(self, cells: np.ndarray, docs: int, shift: int):
        self.bits = np.zeros(max(1, docs << shift >> 3), np.uint8)
        for begin in range(0, len(cells), 1 << 20):
            some = cells[begin : begin + (1 << 20)]
            np.bitwise_or.at(self.bits, some >> 3, self.bit(some))

    @staticmethod
    def bit(cells: np.ndarray) -> np.ndarray:
        return np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8))

    def holds(self, cells: np.ndarray) -> np.ndarray:
        return (self.bits.take(cells >> 3, mode="clip") & self.bit(cells)) != 0

    def swap(self, old: np.ndarray, new: np.ndarray) -> None:
        """No document twice."""
        for cells in (old, new):
            at = cells >> 3
            self.bits.put(at, self.bits.take(at, mode="clip") ^ self.bit(cells))


class _Lists:
    """The same, by looking at the labels of a document one after the other, as they stand in ``cells``."""

    def __init__(self, cells: np.ndarray, docs: int, shift: int):
        self.cells, self.shift = cells, shift
        self.begin = np.searchsorted(cells >> shift, np.arange(docs + 1))

    def holds(self, cells: np.ndarray) -> np.ndarray:
        own = cells >> self.shift
        out = np.zeros(len(cells), bool)
        at, end, rest = self.begin[own], self.begin[own + 1], np.arange(len(cells))
        while len(rest):
            open_ = at < end
            rest, at, end = rest[open_], at[open_], end[open_]
            out[rest] |= self.cells[at] == cells[rest]
            at = at + 1
        return out

    def swap(self, old: np.ndarray, new: np.ndarray) -> None:
        pass


def shuffled(doc: np.ndarray, label: np.ndarray, state: int) -> np.ndarray:
    """The labels of incidences (document, label) after the attempted swaps: each swaps two labels between two
    documents, unless one of them would have a label twice. ``doc`` is sorted, without gaps.

    A swap reads and writes its two documents alone. So of a run of swaps, all that are the first to touch both of
    their documents are done at once, and those left go before the next run: the outcome is that of one by one.
    """
    m = len(doc)
    if not m:
        return label.copy()
    docs, shift = int(doc[-1]) + 1, max(3, int(label.max()).bit_length())
    cells = np.left_shift(doc, shift, dtype=np.int32 if docs << shift < 1 << 31 else np.int64)
    cells |= label.astype(cells.dtype)
    held = (_Table if docs << shift >> 3 <= MAX_CELLS else _Lists)(cells, docs, shift)
    low = (1 << shift) - 1
    # Few swaps of a run then touch a document that an earlier one touches, the one of most labels included; and a run's
    # arrays stay near the core. Documents that share a slot are taken for one, so the later swap only waits.
    run = max(1, min(docs // 8, m // int(np.bincount(doc).max()), RUN))
    first = np.empty(SLOTS, np.int16)
    orders = np.repeat(np.arange(2 * run, dtype=np.int16), 2)

    def done(at):
        """Do the swaps that wait for none before them; the others, in their order. ``at`` holds the two incidences of
        one swap after the other."""
        order = orders[: len(at)]
        old = cells.take(at, mode="clip")
        slot = (old >> shift & SLOTS - 1).astype(np.int64)
        # Told from the last to the first, the first that touches a document is what stays.
        first[slot[::-1]] = order[::-1]
        mine = first.take(slot, mode="clip") == order
        ready = mine[::2] & mine[1::2]
        # Each document's cell with the other's label: its own bits, but where the two labels differ.
        change = (old[::2] ^ old[1::2]) & low
        new = old ^ np.repeat(change, 2)
        # Of a swap within a document, or of one label, each document holds what it would get.
        has = held.holds(new)
        go = np.flatnonzero(ready & ~(has[::2] | has[1::2]))
        to, old, new = (c.reshape(-1, 2).take(go, axis=0, mode="clip").ravel() for c in (at, old, new))
        held.swap(old, new)
        cells.put(to, new)
        return at.reshape(-1, 2).take(np.flatnonzero(~ready), axis=0).ravel()

    left, now, rest = SWEEPS * m, state, np.empty(0, np.int64)
    while left:
        n = min(left, 1 << 20)
        drawn = draws(now, 2 * n)
        drawn -= drawn // np.uint64(m) * np.uint64(m)
        drawn = drawn.view(np.int64)
        for begin in range(0, 2 * n, 2 * run):
            rest = done(np.concatenate((rest, drawn[begin : begin + 2 * run])))
            while len(rest) > 2 * run:
                rest = done(rest)
        left -= n
        if left:
            now = _times(_matrix(2 * n), now)
    while len(rest):
        rest = done(rest)
    return (cells & low).astype(label.dtype)


def counted(doc: np.ndarray, label: np.ndarray, labels: int, wanted: np.ndarray) -> np.ndarray:
    """How many documents have each wanted pair, as sorted codes smaller * labels + larger; ``doc`` is sorted."""
    count = np.zeros(len(wanted), np.int64)
    shift = 1
    while len(wanted) and shift < len(doc):
        same = np.flatnonzero(doc[shift:] == doc[:-shift])
        if not len(same):
            break
        x, y = label.take(same).astype(np.int64), label.take(same + shift).astype(np.int64)
        code = np.minimum(x, y) * labels + np.maximum(x, y)
        if labels * labels <= MAX_CODES:
            count += np.bincount(code, minlength=labels * labels)[wanted]
        else:
            at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            count += np.bincount(at[wanted[at] == code], minlength=len(wanted))
        shift += 1
    return count


def midrank_auroc(order: np.ndarray, twice: np.ndarray, labels: np.ndarray) -> float | None:
    p = int(labels.sum())
    q = len(labels) - p
    if not p or not q:
        return None
    return float((int(twice[labels[order]].sum()) - p * (p + 1)) / 2 / (p * q))


def _twice_midranks(sorted_scores: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], sorted_scores[1:] != sorted_scores[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(sorted_scores)))
    return np.repeat(2 * first + size + 1, size)


def label_sets(documents: DataFrame, ids: pa.Array) -> str:
    """A folder with the distinct sets of labels that works have, as rows (labels, works) in their order: labels as places
    in the sorted ``ids``, and how many works have the set. Works are numbered, grouped, ordered and written by tasks."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(ids)

    def number(batches):
        for b in batches:
            names = b.column(0)
            places = pc.index_in(names.flatten().cast(sent.value.type), sent.value).cast(pa.int32())
            sizes = np.asarray(pc.list_value_length(names), np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), places)], ["labels"])

    names = documents.where(F.size("labels") > 0).select(F.transform("labels", lambda l: l["label_id"]).alias("labels"))  # noqa: E741
    sets = names.mapInArrow(number, "labels array<int>").select(F.sort_array("labels").alias("labels"))
    path = fresh_path(spark, "label-sets")
    # No work has a label twice.
    sets.groupBy("labels").agg(F.count("*").cast("int").alias("works")).orderBy("labels").write.parquet(path)
    return path


def read_sets(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``label_sets`` wrote: labels, one set after the other, the sets' sizes, and how many works have each."""
    fs, base = open_fs(path)
    # The names of a write's files are in the order of its partitions.
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith(".parquet"))
    values, sizes, works = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for name in names:
        with fs.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches():
                values.append(np.asarray(b["labels"].flatten(), np.int32))
                sizes.append(np.asarray(pc.list_value_length(b["labels"]), np.int32))
                works.append(np.asarray(b["works"], np.int32))
    return np.concatenate(values), np.concatenate(sizes), np.concatenate(works)


def label_lists(documents: DataFrame, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``label_sets`` as arrays, where they fit; the permutations read the folder in workers."""
    return read_sets(label_sets(documents, ids))


def incidences(values: np.ndarray, sizes: np.ndarray, works: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, label) of each incidence of ``read_sets``, sorted."""
    n = np.repeat(sizes, works)
    begin = np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), works)
    ends = np.cumsum(n, dtype=np.int32)
    at = np.repeat(begin - (ends - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return np.repeat(np.arange(len(n), dtype=np.int32), n), values[at]


def register_permuted_counts(spark: SparkSession) -> str:
    """The name of the SQL function (path, state) -> counts that ``PermutedCounts.java`` is. The driver compiles it by
    the compiler that Spark brings for its generated code, and executors get it as a jar."""
    name = "lacuna_permuted_counts"
    if not spark.catalog.functionExists(name):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files(__package__).joinpath("PermutedCounts.java").read_text())
        jar = os.path.join(tempfile.mkdtemp(prefix="lacuna-"), "permuted-counts.jar")
        with zipfile.ZipFile(jar, "w") as f:
            for kind, code in compiler.getBytecodes().items():
                f.writestr(kind.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        gateway = spark.sparkContext._gateway
        # By an instance: a registration by name wants type parameters, which that compiler leaves out.
        kind = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("lacuna.PermutedCounts")
        function = kind.getConstructor(gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(gateway.new_array(spark._jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(T.BinaryType().json()))
    return name


def write_incidences(sets: str, path: str, labels: int, codes: np.ndarray) -> None:
    """The incidences of ``read_sets`` and the wanted pairs' codes as the file that ``PermutedCounts.java`` reads."""
    doc, label = incidences(*read_sets(sets))
    label[np.flatnonzero(np.diff(doc, prepend=-1))] |= np.int32(-(1 << 31))
    fs, name = open_fs(path)
    with fs.open_output_stream(name) as f:
        for part in ([len(label), labels, len(codes)], label, codes // max(labels, 1), codes % max(labels, 1)):
            f.write(np.asarray(part, "<i4").tobytes())


def null_aurocs(pairs: DataFrame, scored: DataFrame, result: Backtest, positive: str, permutations: int) -> list[dict[str, float]]:
    """A row of AUROCs by scorer for each permutation whose labels have both classes."""
    spark = pairs.sparkSession
    n = result.test.labels.agg(F.coalesce(F.sum("works"), F.lit(0))).first()[0]
    if n > MAX_INCIDENCES:
        raise ValueError(f"{n} incidences do not fit in a worker; choose a narrower label filter")
    # Independent of the order of the corpus: labels by id, documents by their labels.
    ids = result.test.labels.select("label_id").orderBy("label_id").toArrow()["label_id"].combine_chunks()
    path = label_sets(result.test.documents, ids)
    rows = pairs.select("place", "label_id_a", "label_id_b", "test_expected").toArrow()
    a, b = (np.asarray(pc.index_in(rows[c].combine_chunks(), ids), np.int64) for c in ("label_id_a", "label_id_b"))
    codes = np.minimum(a, b) * len(ids) + np.maximum(a, b)
    order = np.argsort(codes)
    at = np.empty(len(order), np.int64)  # of a pair by its place
    at[rows["place"].to_numpy()[order]] = np.arange(len(order))
    long = scored.select("place", "scorer", "score").toArrow()
    table = np.zeros((len(SCORERS), len(order)))
    table[np.asarray(pc.index_in(long["scorer"].combine_chunks(), pa.array(SCORERS))), at[long["place"].to_numpy()]] = long["score"].to_numpy() + 0.0
    sent = spark.sparkContext.broadcast((path, len(ids), codes[order], rows["test_expected"].to_numpy()[order], table))
    file = fresh_path(spark, "incidences")

    def write(batches):
        sets, labels, codes = sent.value[:3]
        for b in batches:
            write_incidences(sets, file, labels, codes)
            yield b

    def run(batches):
        expected, table = sent.value[3:]
        orders = [np.argsort(s, kind="stable") for s in table]
        ranks = [_twice_midranks(s[o]) for s, o in zip(table, orders, strict=True)]
        for pdf in batches:
            out = []
            for i, got in zip(pdf["id"], pdf["counts"], strict=True):
                count = np.frombuffer(got, "<i4")
                positives = count > 0 if positive == "co_tagged" else (expected > 0) & (count >= expected)
                found = [midrank_auroc(o, t, positives) for o, t in zip(orders, ranks, strict=True)]
                if None not in found:
                    out.append((int(i), *found))
            yield pd.DataFrame(out, columns=["id", *SCORERS])

    one = spark.range(0, 1, 1, 1)
    one.mapInArrow(write, one.schema).collect()
    states = [NULL_SEED]
    for _ in range(permutations - 1):
        states.append(_times(_matrix(2 * SWEEPS * int(n)), states[-1]))
    # A task for each permutation: all take about as long. The states are signed in the JVM.
    begins = spark.sparkContext.parallelize([(i, x - (x >> 63 << 64)) for i, x in enumerate(states)], permutations)
    dealt = spark.createDataFrame(begins, "id bigint, state bigint")
    counts = F.expr(f"{register_permuted_counts(spark)}('{file}', state)")
    got = dealt.select("id", counts.alias("counts")).mapInPandas(run, "id bigint, " + ", ".join(f"{s} double" for s in SCORERS))
    # Seven numbers for each permutation; Spark would permute twice to sort them, first for the ranges.
    rows = sorted(got.collect(), key=lambda r: r["id"])
    drop_path(spark, path)
    drop_path(spark, file)
    return [r.asDict() for r in rows]
