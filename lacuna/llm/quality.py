"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: one entry for each distinct hashed word (with weight 1/sqrt(number of distinct
words)), and for each statistic one entry for the bin its value falls in. The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)),

the sum-of-squares identity, so it takes time linear in the entries. Word entries and statistics interact through
their factors, e.g. a frequent function word within a page of shouted capitals.

The model is fitted on at most ``max_train`` labelled rows, those with the smallest hashes of their ids, so the
same rows at any partitioning. Whole texts are scored and fitted, never prefixes.

Defined results: a null or empty text has only its statistics and gets a score like any other; with no labelled
rows, or one class alone, every score is that class's (or one half). A document that is labelled more than once
counts once, with its lowest label; of rows that share a labelled id, one is fitted, that with the least features.
Null labels are ignored. Repeated rows each give a row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BITS = 16
RANK = 8
MAX_TRAIN = 6_000
BINS = 12
#: Words remembered with their hashes in a worker, at most.
MEMO = 150_000

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b"#$%&*|!@^~<>{}[]\\_=+/"
_STOPS = b".,;:?\"'()-"
_HIGH = bytes(range(128, 256))
STATS = ("log_bytes", "log_words", "upper", "digits", "marks", "stops", "high", "pipes", "word_length", "distinct", "repeats", "lines", "line_words", "distinct_lines", "longest_line", "metadata_length")

_memo: dict[bytes, int] = {}


def _hashes(words: list[bytes]) -> np.ndarray:
    """The bucket of each word."""
    if len(_memo) > MEMO:
        _memo.clear()
    get, out = _memo.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _memo[w] = zlib.crc32(w.lower()) & ((1 << WORD_BITS) - 1)
        out.append(h)
    return np.array(out, dtype=np.int32)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets, and the statistics in the order of ``STATS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    words = raw.split()
    ids = _hashes(words)
    k = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    m = max(len(lines), 1)
    part = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    distinct = np.unique(ids)
    stats = (
        np.log1p(len(raw)), np.log1p(len(words)), part(_UPPER), part(_DIGITS), part(_MARKS), part(_STOPS), part(_HIGH), raw.count(b" | ") / k,
        (n - len(raw) + len(raw.translate(None, _SPACE))) / k, len(distinct) / k, float((ids[1:] == ids[:-1]).sum()) / k,
        np.log1p(len(lines)), k / m, len(set(lines)) / m, max(map(len, lines), default=0) / n, np.log1p(max(len(text or "") if n_chars is None else n_chars, 0)),
    )
    return distinct, np.array(stats, dtype=np.float64)


@dataclass
class Model:
    """Weights by entry: word buckets first, then the bins of each statistic."""

    edges: np.ndarray  # statistics x (BINS - 1), the inner edges of the bins
    w0: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    def entries(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, values and the start of each document in them; no document is without entries."""
        words = [d[0] for d in docs]
        bins = np.stack([(self.edges < d[1][:, None]).sum(1) for d in docs]) + np.arange(len(STATS)) * BINS + (1 << WORD_BITS)
        sizes = np.array([len(x) for x in words])
        idx = np.concatenate([y for x, b in zip(words, bins, strict=True) for y in (x, b)]).astype(np.int64)
        val = np.concatenate([y for n in sizes for y in (np.full(n, 1 / np.sqrt(max(n, 1))), np.full(len(STATS), 0.5))]).astype(np.float32)
        return idx, val, np.concatenate([[0], np.cumsum(sizes + len(STATS))[:-1]])

    def margin(self, idx: np.ndarray, val: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value before the sigmoid, and the factor sums that the gradient needs."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), start))
        return self.w0 + np.add.reduceat(self.w[idx] * val, start) + pairs, sums

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        z = self.margin(*self.entries(docs))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int | None = None, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Model:
    """A model by mini-batch Adagrad on the logistic loss. Rows in the given order, so the same rows give the same model."""
    rng = np.random.default_rng(seed)
    size = (1 << WORD_BITS) + len(STATS) * BINS
    if len(docs) == 0:
        return Model(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    stats = np.stack([d[1] for d in docs])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    m = Model(edges, float(np.log(p / (1 - p))), np.zeros(size, np.float32), (rng.standard_normal((size, RANK)) * 0.02).astype(np.float32))
    if p in (1e-6, 1 - 1e-6):
        m.v[:] = 0
        return m
    epochs = epochs or max(12, min(80, 40_000 // len(docs)))
    gw, gv, g0 = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            idx, val, start = m.entries([docs[i] for i in rows])
            z, sums = m.margin(idx, val, start)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32)
            doc = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(idx))))
            e = err[doc] * val
            keys, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e, len(keys)).astype(np.float32) / len(rows) + decay * m.w[keys]
            per = e[:, None] * (sums[doc] - m.v[idx] * val[:, None])
            by = np.argsort(inv, kind="stable")
            dv = np.add.reduceat(per[by], np.searchsorted(inv[by], np.arange(len(keys))), axis=0) / len(rows) + decay * m.v[keys]
            gw[keys] += dw**2
            gv[keys] += dv**2
            m.w[keys] -= 5 * rate * dw / np.sqrt(gw[keys])
            m.v[keys] -= rate * dv / np.sqrt(gv[keys])
            d0 = float(err.mean())
            g0 += d0**2
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def _featured(df: DataFrame, columns: list[str]) -> DataFrame:
    """id, buckets and statistics of each row; ``columns``: id, text, length."""

    def run(batches):
        for b in batches:
            docs = [features(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rest = [b.column(i) for i in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *rest, pa.array([d[0].tobytes() for d in docs], pa.binary()), pa.array([d[1].tobytes() for d in docs], pa.binary())], names)

    out = df.select(*columns)
    names = [out.columns[0], *out.columns[3:], "_words", "_stats"]
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    return out.mapInArrow(run, ", ".join(f"`{n}` {kinds.get(n, 'binary')}" for n in names))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled rows, or the ``max_train`` of them with the smallest hashes of their ids.

    What comes to the driver is bounded: hashed words and statistics of ``max_train`` documents.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    met = docs.select(id_col, text_col, length_col).join(F.broadcast(chosen), id_col)
    found = _featured(met, [id_col, text_col, length_col, "_y"]).groupBy(id_col).agg(F.min(F.struct("_words", "_stats", "_y")).alias("_row"))
    rows = [r["_row"] for r in sorted(found.collect(), key=lambda r: r[0])]
    return fit([(np.frombuffer(r["_words"], np.int32), np.frombuffer(r["_stats"], np.float64)) for r in rows], np.array([r["_y"] for r in rows], dtype=np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """id and ``score`` (0 to 1, higher: label 1 is likelier) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 2^16 buckets and the bins, by rank

    def run(batches):
        for b in batches:
            lists = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_in_parts(sent.value, lists), pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, length_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def _in_parts(model: Model, rows, size: int = 256) -> np.ndarray:
    """Scores of (text, length) rows, so many at a time."""
    out, part = [], []
    for t, n in rows:
        part.append(features(t, n))
        if len(part) == size:
            out.append(model.score(part))
            part = []
    out.append(model.score(part))
    return np.concatenate(out)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, length = docs.columns.index(text_col), docs.columns.index(length_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_in_parts(sent.value, zip(b.column(at).to_pylist(), b.column(length).to_pylist(), strict=True)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
