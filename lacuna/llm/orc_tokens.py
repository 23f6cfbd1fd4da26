"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

``write_tokens`` encodes whole texts and writes them in ascending order of id: texts are dealt by ranges of the id
and sorted, encoded, and written by the same tasks; only whole files of tasks that succeeded are left.
Each row holds its place within its file (``local_start``); where a file begins follows from the totals of the
files before it. ``read_tokens`` is for queries: a filter on ``doc_id`` prunes files and stripes by their statistics
and row groups by Bloom filters. ``read_stripes`` is for passes over all rows: its tasks take equal shares of the stripes,
whatever files they stand in.

A tokenizer of words is context-free between white space, so every distinct word of a worker's documents is encoded
once and remembered, within a bound of memory; Latin letters and the punctuation behind them are two words. Words are
made distinct in Arrow's dictionaries, a few MB of text at a time, so that what is done in Python is done once for each
distinct word. The ids are those that the whole text would get. Strings of special
tokens in a text become those tokens, as the library does by default; with ``specials`` false they are ordinary text.

Defined results: a null or empty text has only the end id; rows with a null id come first; rows with equal ids
keep the order of the input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyarrow.orc import ORCFile, ORCWriter
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.common import open_fs, spread

#: Words remembered with their ids in a worker, at most.
MEMO = 1_200_000
#: Bytes of files that a task reads back, about.
TASK_BYTES = 64 << 20
#: Files of tasks that haven't ended, within the path; readers pass names over that begin so.
_UNFINISHED = "_unfinished"
#: Rows of a row group; Bloom filters and row indexes are kept per row group.
STRIDE = 1_000
ORC_OPTIONS = {"compression": "zstd", "orc.row.index.stride": str(STRIDE), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(32 << 20)}
# Latin letters below U+0250 (but U+0130, whose lower case has a combining mark), then ASCII punctuation without the apostrophe: pre-tokens that do not depend on each other.
_SPLIT = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


#: Bytes of text that are looked up together.
PART = 6 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


class WordEncoder:
    """Ids of whole texts, word by word, for a tokenizer that starts anew at white space and marks the ends of words."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        # Where one of these stands in a text, letter case may tell a special token from text.
        self.marks = {t.content[:2].encode() for t in self.tok.get_added_tokens_decoder().values()} if specials else set()
        self.bare = Tokenizer(self.tok.model)  # for words that are one pre-token, in the letters of the vocabulary
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters() | {32: " "}
        self._forget()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _forget(self) -> None:
        """Remember the empty word alone: each word's number, where its ids begin in ``ids``, and how many there are."""
        self.memo: dict[bytes, int] = {b"": 0}
        self.ids, self.first, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters alone, each of which is one pre-token and so has one token that ends a word."""
        text = b" ".join(words).decode().lower()  # upper case is left beyond ASCII, and in texts with combining marks
        text = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._any(words)

    def _any(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, words: list[bytes], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        """Remember the ids of each of these distinct words."""
        if not words:
            return
        ids, size = encode(words)
        self.memo.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def _numbers(self, words: pa.Array, letters: bool = False) -> np.ndarray:
        """The numbers of distinct words, of which new ones are learned; ``letters``: each is Latin letters alone."""
        keys = words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.memo.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = [keys[i] for i in missing]
            if letters:
                self._learn([w for w in new if w.isascii()], self._plain)
                self._learn([w for w in new if not w.isascii()], self._plain)
            else:
                self._learn(new, self._any)
            found[missing] = [self.memo[w] for w in new]
        return found

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normal texts one after the other, and their numbers."""
        if len(self.memo) > MEMO:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        found = split.values.dictionary_encode()
        words = found.dictionary
        halves = pc.extract_regex(words, _SPLIT)
        core, tail = halves.flatten()
        whole = core.is_null()
        rest = whole.to_numpy(zero_copy_only=False)
        # Each distinct word is two, of which the latter may be empty.
        two = np.zeros((len(words), 2), np.int64)
        two[rest, 0] = self._numbers(words.filter(whole))
        for i, (half, letters) in enumerate([(core, True), (tail, False)]):
            some = half.drop_null().dictionary_encode()
            two[~rest, i] = self._numbers(some.dictionary, letters)[some.indices.to_numpy()]
        size = self.size[two]
        ids = self.ids[spread(self.first[two].ravel(), size.ravel())]
        size = size.sum(axis=1)
        at = found.indices.to_numpy()
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy()]
        return ids[spread((np.cumsum(size) - size)[at], each)], np.diff(ends)

    def encode(self, texts: list[bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) one after the other, each with ``end_id`` behind it if given, and their numbers."""
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for number, pieces in _parts(texts, [b"\xcc", b"\xcd", *self.marks]):
            some, n = self._part(pieces)
            ids.append(some)
            np.add.at(sizes, number, n)
        flat = np.concatenate(ids)
        if end_id is None:
            return flat, sizes
        sizes += 1
        ends = np.cumsum(sizes) - 1
        out = np.full(len(flat) + len(texts), end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = flat
        return out, sizes


def _parts(texts: list[bytes | None], cased: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts and their numbers, together up to ``PART`` bytes; longer ones cut at white space.

    Letter case of ASCII goes first, but where one of ``cased`` stands: a combining mark, which could compose with a
    letter, or the beginning of a special token.
    """
    number, held, n = [], [], 0
    for i, t in enumerate(texts):
        raw = t or b""
        raw = raw if any(c in raw for c in cased) else raw.lower()
        while len(raw) > PART and (m := _SPACE.search(raw, PART)):
            yield [*number, i], [*held, raw[: m.start()]]
            number, held, n, raw = [], [], 0, raw[m.start() :]
        number.append(i)
        held.append(raw)
        n += len(raw)
        if n >= PART:
            yield number, held
            number, held, n = [], [], 0
    if held:
        yield number, held


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, specials: bool) -> WordEncoder:
    if (path, specials) not in _encoders:
        _encoders[path, specials] = WordEncoder(path, specials)
    return _encoders[path, specials]


_NAMES = ["doc_id", "part", "local_start", "n_tokens", "ids"]


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, specials: bool) -> Iterator[pa.RecordBatch]:
    """What ``encode`` gives of a task's rows."""
    enc, part, at = _encoder(tokenizer, specials), TaskContext.get().partitionId(), 0
    gc.disable()  # nothing here makes cycles, and there are millions of small objects to look through
    try:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                ids, n = enc.encode(b.column(1).cast(pa.binary()).to_pylist(), end_id)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(start), pa.array(n), lists], _NAMES)
    finally:
        gc.enable()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, specials: bool = True) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids) of whole texts; ``local_start`` counts within the partition ``part``."""

    def run(batches):
        return _encoded(batches, tokenizer, end_id, specials)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, part bigint, local_start bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, specials: bool = True) -> None:
    """Write the ids of all documents to ``path`` as ORC, in ascending order of id.

    Each task writes a file where it encodes, so no ids go through the JVM; the driver then moves the files of the tasks
    that succeeded into place.
    """
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_n"))
    ordered = dealt.repartitionByRange("doc_id", "_n").sortWithinPartitions("doc_id", "_n").select("doc_id", "text")
    options = {
        "compression": ORC_OPTIONS["compression"],
        "stripe_size": int(ORC_OPTIONS["orc.stripe.size"]),
        "row_index_stride": int(ORC_OPTIONS["orc.row.index.stride"]),
        "bloom_filter_columns": [1 + _NAMES.index(c) for c in ORC_OPTIONS["orc.bloom.filter.columns"].split(",")],  # 0 is the row itself
        "bloom_filter_fpp": float(ORC_OPTIONS["orc.bloom.filter.fpp"]),
    }
    fs, base = open_fs(path)
    if fs.get_file_info(base).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(f"{base}/{_UNFINISHED}", recursive=True)

    def write(batches):
        fs, base = open_fs(path)
        encoded = _encoded(batches, tokenizer, end_id, specials)
        first = next(encoded, None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.orc"
        with fs.open_output_stream(f"{base}/{_UNFINISHED}/{name}", compression=None) as f, ORCWriter(f, **options) as out:
            for b in itertools.chain([first], encoded):
                out.write(pa.Table.from_batches([b]))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    for (name,) in ordered.mapInArrow(write, "name string").collect():
        fs.move(f"{base}/{_UNFINISHED}/{name}", f"{base}/{name}")
    fs.delete_dir(f"{base}/{_UNFINISHED}")


def _before(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids in the files before each; one row per file, so it stays as small as a file listing."""
    files = spark.read.schema("part bigint, n_tokens bigint").orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in ``path``; ``start`` counts the ids of all documents before.

    Filters on ``doc_id`` reach the files: their statistics and Bloom filters prune stripes and row groups.
    """
    rows = spark.read.schema(f"doc_id {id_type}, part bigint, local_start bigint, n_tokens bigint, ids array<int>").orc(path)
    return rows.join(F.broadcast(_before(spark, path)), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_stripes(spark: SparkSession, path: str, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, columns: tuple[str, ...] = ("doc_id", "part", "local_start", "ids")) -> DataFrame:
    """``each`` applied to every stripe, where it is read.

    Tasks count the stripes of the files first. Then all stripes are numbered, and each task takes a range of numbers:
    no file is bound to one task, and nothing is shuffled. What the driver holds is a row per file, as a listing does.
    """
    fs, base = open_fs(path)
    files = sorted((i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith(".orc"))
    names = [name for name, _ in files]
    tasks = max(spark.sparkContext.defaultParallelism, sum(size for _, size in files) // TASK_BYTES)

    def count(batches):
        fs, base = open_fs(path)
        for b in batches:
            n = []
            for i in b.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{names[i]}") as f:
                    n.append(ORCFile(f).nstripes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    counted = spark.range(0, len(files), 1, max(1, min(len(files), spark.sparkContext.defaultParallelism))).mapInArrow(count, "id bigint, n bigint")
    first = np.cumsum([0, *(r["n"] for r in counted.orderBy("id").collect())])

    def run(batches):
        fs, base = open_fs(path)
        opened, f, orc = -1, None, None
        try:
            for b in batches:
                for k in b.column(0).to_pylist():
                    i = int(np.searchsorted(first, k, "right")) - 1
                    if i != opened:
                        if f is not None:
                            f.close()
                        f = fs.open_input_file(f"{base}/{names[i]}")
                        opened, orc = i, ORCFile(f)
                    yield each(orc.read_stripe(k - int(first[i]), columns=list(columns)))
        finally:
            if f is not None:
                f.close()

    total = int(first[-1])
    return spark.range(0, total, 1, max(1, min(total, tasks))).mapInArrow(run, schema)


def checksums(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in ``path``: the checksum of their ids as little-endian
    unsigned 32-bit integers."""

    def each(b):
        ids = b.column("ids")
        at = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
        crc = [zlib.crc32(raw[4 * int(x) : 4 * int(y)]) for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = read_stripes(spark, path, each, f"doc_id {id_type}, part bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(_before(spark, path)), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
