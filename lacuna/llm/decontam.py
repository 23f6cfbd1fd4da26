"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are maximal runs of ASCII letters and digits and of all other characters above U+007F, with A-Z lower-cased.
The automaton holds every substring of every item. Training words stream through it; at each word the longest
matching length ending there is tracked. Where it reaches the window (ten words), the last ten words are hit, and
the automaton's state for that window tells the items it occurs in. Items shorter than the window count whole.

Before a run of words enters the automaton, runs that cannot hold a window are left out: a window of n words needs
n - 1 consecutive word pairs that all stand next to each other in some item. This loses nothing.

The automaton is built in blocks of about ``BLOCK_WORDS`` words of items, each in a task of its own, and written to the
shared folder. Documents are read once, however many blocks there are: a task takes some megabytes of texts through
one block after the other. So neither the driver nor a task ever holds more than one block. Items that are longer are
cut into segments that overlap by a window less one word, which have the same windows.

Defined results: a null or empty text has no words, and is not contaminated; items with equal ids count once; items
with a null id or without words match nothing; an empty benchmark hits nothing; repeated rows each give a row.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lacuna.llm.common import fresh_path, open_fs

WINDOW = 10
#: Words of items in one automaton: some 300 bytes a word in a worker's memory.
BLOCK_WORDS = 200_000
#: Bytes of text that are turned into word numbers at a time.
PART = 4 << 20
#: Bytes of text that pass all blocks together, where there is more than one.
GROUP_BYTES = 64 << 20

_WORD = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))
_END = b"|"  # no word holds it


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Automaton:
    """Of sequences of word numbers: all their substrings, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, object, int]] = []
        pairs: set[tuple[int, int]] = set()
        for key, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            if not ids:
                continue
            pairs.update(zip(ids, ids[1:], strict=False))
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c)
                if i + 1 >= window or i + 1 == len(ids):
                    ends.append((last, key, min(window, len(ids))))
        n = len(self.link)
        # (length, items) of the windows that each state has among its own suffixes, by state.
        self.windows: list[dict[int, set]] = [{} for _ in range(n)]
        for state, key, size in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            self.windows[state].setdefault(size, set()).add(key)
        # The nearest state at or above each that has windows.
        self.nearest = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.nearest[s] = s if self.windows[s] else self.nearest[self.link[s]]
        self.least = min((size for _, _, size in ends), default=0)
        v = max(len(self.number), 1)
        self.pairs = np.array(sorted(a * v + b for a, b in pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def stream(self, ids: list[int]):
        """(first, end, items) of each window that occurs in a sequence of word numbers, by its end."""
        nxt, link, length, nearest, windows = self.next, self.link, self.length, self.nearest, self.windows
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            s = nearest[state]
            while s >= 0:
                for size, keys in windows[s].items():
                    if size <= matched:
                        yield i + 1 - size, i + 1, keys
                s = nearest[link[s]]

    def search(self, ids: np.ndarray) -> list[tuple[int, int, set]]:
        """``stream`` over the runs of ``ids`` (-1: a word of no item) that may hold a window."""
        if not self.least:
            return []
        v = max(len(self.number), 1)
        known = ids >= 0
        if self.least == 1:
            runs = _runs(known)
        else:
            code = ids[:-1].astype(np.int64) * v + ids[1:]
            at = np.searchsorted(self.pairs, code)
            linked = known[:-1] & known[1:]
            linked &= self.pairs[np.minimum(at, len(self.pairs) - 1)] == code if len(self.pairs) else False
            runs = [(a, b + 1) for a, b in _runs(linked) if b - a + 1 >= self.least]
        return [(a + x, a + y, keys) for a, b in runs for x, y, keys in self.stream(ids[a:b].tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true values as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _numbered(raws: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts one after the other, and where each begins; a gap of one stands between texts."""
    words = (b" " + _END + b" ").join(raws).split()
    # A text of no words leaves only its gap, so gaps tell texts apart.
    ids = np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int32, len(words))
    gaps = np.flatnonzero(ids == number[_END]) if len(raws) > 1 else np.zeros(0, np.int64)
    return ids, np.concatenate([[0], gaps + 1])


def _parts(texts: list[str | None]):
    """Normalised texts, some megabytes at a time, as (first, texts)."""
    part, n, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_NORMAL)
        if part and n + len(raw) > PART:
            yield first, part
            part, n, first = [], 0, i
        part.append(raw)
        n += len(raw)
    if part:
        yield first, part


def find_windows(automaton: Automaton, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Of each text: the number of its words, the disjoint word spans that are hit, and the items whose windows occur."""
    out = []
    number = automaton.number | {_END: -2}
    for _, raws in _parts(texts):
        ids, start = _numbered(raws, number)
        end = np.append(start[1:] - 1, len(ids))
        hits: dict[int, list] = {}
        for a, b, keys in automaton.search(ids):
            hits.setdefault(int(np.searchsorted(start, a, "right")) - 1, []).append((a, b, keys))
        for i, (x, y) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            spans = union((a - x, b - x) for a, b, _ in sorted(hits.get(i, ()), key=lambda h: h[:2]))
            out.append((y - x, spans, set().union(*(h[2] for h in hits.get(i, ())))))
    return out


def union(spans) -> list[tuple[int, int]]:
    """Sorted spans as disjoint ones that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """Segments of items as (block, key, words)."""
    step = block_words

    def cut(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if key is None or not words:
                    continue
                for at in range(0, max(1, len(words) - window + 1), step):
                    rows.append((key, at, b" ".join(words[at : at + step + window - 1]), min(len(words) - at, step + window - 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())], ["key", "at", "words", "n"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    cuts = benchmark.select(id_col, text_col).mapInArrow(cut, f"key {kind}, at bigint, words binary, n bigint")
    total = cuts.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-2 * total // block_words)) if total > block_words else 1
    return cuts.select(F.pmod(F.xxhash64("key", "at"), F.lit(n)).alias("block"), "key", "words")


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[str]:
    """The files of the automata, built by tasks, one a block; only those of tasks that succeeded are named."""
    cuts = _blocks(benchmark, id_col, text_col, window, block_words)
    path = fresh_path(benchmark.sparkSession, "automata")

    def build(rows: pa.Table) -> pa.Table:
        items = zip(rows.column("key").to_pylist(), rows.column("words").to_pylist(), strict=True)
        fs, base = open_fs(path)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            pickle.dump(Automaton([(key, words.split()) for key, words in items], window), f, protocol=5)
        return pa.table({"name": [name]})

    return sorted(f"{path}/{r['name']}" for r in cuts.groupBy("block").applyInArrow(build, "name string").collect())


_held: dict[str, Automaton] = {}


def _opened(name: str) -> Automaton:
    """An automaton; a worker holds the one that it used last."""
    if name not in _held:
        _held.clear()
        fs, base = open_fs(name)
        with fs.open_input_stream(base, compression=None) as f:
            _held[name] = pickle.loads(f.read())
    return _held[name]


def _groups(batches, at: int, alone: bool, group_bytes: int):
    """Batches that pass all blocks together."""
    held, size = [], 0
    for whole in batches:
        for i in range(0, max(whole.num_rows, 1), 4096):
            b = whole.slice(i, 4096)
            held.append(b)
            size += b.column(at).nbytes
            if alone or size >= group_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def _search(batches, at: int, names: list[str], window: int, group_bytes: int):
    """Each batch with the texts of its column ``at`` and what ``find_windows`` finds in them by all blocks together."""
    for group in _groups(batches, at, len(names) < 2, group_bytes):
        texts = [b.column(at).to_pylist() for b in group]
        found = None
        for name in names or [""]:
            automaton = _opened(name) if name else Automaton([], window)
            now = [find_windows(automaton, t) for t in texts]
            if found is None:
                found = now
                continue
            for old, new in zip(found, now, strict=True):
                for i, (n, spans, keys) in enumerate(new):
                    if spans:
                        old[i] = n, union(sorted([*old[i][1], *spans])), old[i][2] | keys
        yield from zip(group, texts, found, strict=True)


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``spans`` (disjoint hit word spans, end exclusive) and ``items``."""
    names = _automata(benchmark, item_col, item_text_col, window, block_words)
    item, kind = (to_arrow_type(df.schema[c].dataType) for df, c in ((benchmark, item_col), (docs, id_col)))
    schema = pa.schema([(id_col, kind), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(item))])

    def run(batches):
        for b, _, found in _search(batches, 1, names, window, group_bytes):
            spans = [[{"start": s, "end": e} for s, e in f[1]] for f in found]
            items = [sorted(f[2], key=str) for f in found]
            columns = [b.column(0), [f[0] for f in found], spans, items]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, schema.types, strict=True)], schema.names)

    types = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {types[0]}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<{types[1]}>")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given spans and what stands between the words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    normal = raw.translate(_NORMAL)
    out, done, at, word = [], 0, 0, -1
    todo = deque(spans)
    begin = None
    n = len(normal)
    while todo and at < n:
        while at < n and normal[at] == 32:
            at += 1
        end = normal.find(b" ", at)
        end = n if end < 0 else end
        if at >= n:
            break
        word += 1
        if word == todo[0][0]:
            begin = at
        if word + 1 == todo[0][1]:
            out.append(raw[done:begin])
            done = end
            todo.popleft()
        at = end
    return (b"".join(out) + raw[done:]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` without the hit spans in their texts, and without documents of which more than ``max_coverage`` is hit.

    Texts that hold no window stay as they are; null stays null.
    """
    at = docs.columns.index(text_col)
    names = _automata(benchmark, item_col, item_text_col, window, block_words)

    def run(batches):
        for b, texts, found in _search(batches, at, names, window, group_bytes):
            if not any(f[1] for f in found):
                yield b
                continue
            keep = []
            for i, (n, spans, _) in enumerate(found):
                keep.append(sum(e - s for s, e in spans) <= max_coverage * n)
                if spans and keep[-1]:
                    texts[i] = cut_words(texts[i], spans)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of what ``match`` found."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    keys = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(keys, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
