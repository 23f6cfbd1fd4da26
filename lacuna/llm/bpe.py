"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are cut into pre-tokens by the pattern. Within a block (the documents that one task reads, up to
   ``BLOCK_BYTES`` of text) every distinct pre-token gets a number, and each document becomes the sequence of the
   numbers of its pre-tokens: its exploded positions, packed.
2. The blocks' distinct words are dealt into buckets by hash, so that each distinct word of the whole corpus meets in
   one task, is encoded there once, and its ids go back to the blocks that asked. Words travel in packed chunks per
   block and bucket; a chunk does not depend on how often a word occurs, so frequent words are no hot keys.
3. Per block, ids are put back at the positions of the documents, which the task that cut them has left in a file of
   the shared folder: only words and their ids are shuffled, and positions never pass through the JVM. Decoding joins
   the ids with the token-byte table, a fixed table of the vocabulary. A checksum of its text goes with each document,
   and one that does not decode to its text fails the job.

Words are numbered by how often they occur in the block (in powers of two), then by bucket, then by their bytes. So
frequent words have small numbers, which pack well, and a chunk need not carry the numbers of its words.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lacuna.llm.common import fresh_path, open_fs, spread

#: Bytes of text in a block; a block's distinct words fit in a worker's memory.
BLOCK_BYTES = 20 << 20
#: Pre-tokens of the documents in one row, about.
PACK = 250_000
#: Bounds of the number of buckets; between them it is four for each shuffle partition.
LEAST_BUCKETS, MOST_BUCKETS = 64, 4_096
#: Classes of words by frequency: 2^0, 2^1, ... occurrences in the block.
CLASSES = 32

_made: dict[object, object] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks in a vocabulary file: a token in base64 and its rank on each line."""
    if path not in _made:
        with open(path, "rb") as f:
            _made[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
    return _made[path]


def _encoding(path: str, pattern: str):
    import tiktoken

    if ("encoding", path) not in _made:
        _made["encoding", path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return _made["encoding", path]


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and the start and length of each id's."""
    if ("table", path) not in _made:
        ranks = ranks_of(path)
        by = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            by[i] = t
        size = np.array([len(t) for t in by], dtype=np.int64)
        _made["table", path] = (np.frombuffer(b"".join(by), np.uint8), np.cumsum(size) - size, size)
    return _made["table", path]


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The bytes of ids, by the token-byte table."""
    data, start, size = table
    return data[spread(start[ids], size[ids])].tobytes()


class _Out:
    """Numbers and bytes one after the other, compressed as a whole."""

    def __init__(self):
        self.parts: list[bytes] = []

    def numbers(self, x: np.ndarray) -> _Out:
        """All lowest bytes first, then all next ones, as far as any number has them: packs well."""
        x = np.ascontiguousarray(x, dtype="<u4")
        width = (int(x.max(initial=0)).bit_length() + 7) // 8
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T)
        self.parts += [len(x).to_bytes(4, "little"), bytes([width]), planes[:width].tobytes()]
        return self

    def raw(self, data: bytes) -> _Out:
        self.parts += [len(data).to_bytes(4, "little"), data]
        return self

    def pack(self) -> bytes:
        data = b"".join(self.parts)
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


class _In:
    """What ``_Out`` has packed, in the same order."""

    def __init__(self, data: bytes):
        self.data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        self.at = 0

    def numbers(self) -> np.ndarray:
        n, width = int.from_bytes(self.data[self.at : self.at + 4], "little"), self.data[self.at + 4]
        planes = np.zeros((4, n), np.uint8)
        planes[:width] = np.frombuffer(self.data, np.uint8, n * width, self.at + 5).reshape(width, n)
        self.at += 5 + n * width
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def raw(self) -> bytes:
        n = int.from_bytes(self.data[self.at : self.at + 4], "little")
        self.at += 4 + n
        return self.data[self.at - n : self.at]


class _Block:
    """The documents of a block, and its distinct words numbered by appearance."""

    def __init__(self):
        self.key, self.number, self.ids, self.docs, self.checks, self.bytes = uuid.uuid4().hex, {}, [], [], [], 0

    def add(self, key, pieces: list[str], raw: bytes) -> None:
        number = self.number
        found = list(map(number.get, pieces))
        if None in found:
            for w in pieces:
                if w not in number:
                    number[w] = len(number)
            found = list(map(number.__getitem__, pieces))
        self.ids.append(key)
        self.docs.append(np.array(found, dtype=np.uint32))
        self.checks.append(zlib.crc32(raw))
        self.bytes += len(raw)

    def packed(self, buckets: int):
        """Rows (kind, bucket, ids, data): the documents in their order, then the words of each bucket, one chunk at least."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.number]
        self.number = {}
        count = np.bincount(np.concatenate(self.docs), minlength=len(words)) if words else np.zeros(0, np.int64)
        rare = CLASSES - 1 - np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), CLASSES - 1)
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
        by_bytes = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
        order = by_bytes[np.lexsort((bucket[by_bytes], rare[by_bytes]))]
        renumbered = np.empty(len(words), np.uint32)
        renumbered[order] = np.arange(len(words), dtype=np.uint32)
        first, n = 0, 0
        for i, d in enumerate(self.docs):
            n += len(d)
            if n >= PACK or i + 1 == len(self.docs):
                some = self.docs[first : i + 1]
                checks = np.array(self.checks[first : i + 1], dtype=np.uint32)
                data = _Out().numbers(np.array([len(x) for x in some])).numbers(renumbered[np.concatenate(some)]).numbers(checks).pack()
                yield "docs", 0, self.ids[first : i + 1], data
                first, n = i + 1, 0
        mine = order[np.argsort(bucket[order], kind="stable")]  # by bucket, then class, then bytes
        cuts = np.searchsorted(bucket[mine], np.arange(buckets + 1))
        for k in range(buckets):
            if cuts[k] < cuts[k + 1] or not words and k == 0:
                some = mine[cuts[k] : cuts[k + 1]]
                text = [words[i] for i in some]
                yield "words", k, None, _Out().numbers(np.bincount(rare[some], minlength=CLASSES)).numbers(np.fromiter(map(len, text), np.uint32, len(text))).raw(b"".join(text)).pack()


def _cut(docs: DataFrame, id_col: str, text_col: str, pattern: str, block_bytes: int, buckets: int, path: str) -> list[str]:
    """Write the pieces of all blocks to ``path`` and name the blocks of the tasks that succeeded.

    Tasks write them as Arrow streams, the documents of a block in one file and its words in another.
    """
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("bucket", pa.int32()), ("ids", pa.list_(id_type)), ("data", pa.binary())])
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        fs, base = open_fs(path)

        def done(block):
            for kind, rows in itertools.groupby(block.packed(buckets), key=lambda r: r[0]):
                with fs.open_output_stream(f"{base}/{block.key}.{kind}", compression=None) as f, pa.ipc.new_stream(f, schema) as out:
                    while some := list(itertools.islice(rows, 1 if kind == "docs" else 64)):
                        _, bucket, ids, data = zip(*some, strict=True)
                        out.write_batch(pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(ids, schema.field("ids").type), pa.array(data, pa.binary())], schema=schema))
            return pa.RecordBatch.from_arrays([pa.array([block.key])], ["block"])

        block = _Block()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                block.add(key, find(text), text.encode("utf-8", "surrogatepass"))
                if block.bytes >= block_bytes:
                    yield done(block)
                    block = _Block()
        if block.docs:
            yield done(block)
        pa.default_memory_pool().release_unused()

    return [block for (block,) in docs.select(id_col, text_col).mapInArrow(run, "block string").collect()]


def _stream(fs, path: str):
    """The batches of an Arrow stream."""
    with fs.open_input_stream(path, compression=None) as f, pa.ipc.open_stream(f) as batches:
        yield from batches


def _asked(spark: SparkSession, path: str, blocks: list[str], tasks: int) -> DataFrame:
    """Rows (block, bucket, data): the chunks of words of all blocks."""

    def run(batches):
        fs, base = open_fs(path)
        for b in batches:
            for i in b.column(0).to_pylist():
                for words in _stream(fs, f"{base}/{blocks[i]}.words"):
                    yield pa.RecordBatch.from_arrays([pa.array([blocks[i]] * len(words)), words.column("bucket"), words.column("data")], ["block", "bucket", "data"])

    return spark.range(0, len(blocks), 1, max(1, min(len(blocks), tasks))).mapInArrow(run, "block string, bucket int, data binary")


def _encode_words(asked: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each chunk of words the chunk of their ids; a task encodes each distinct word of its buckets once."""

    def run(batches):
        one = _encoding(path, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        last = None
        for b in batches:
            out = []
            for bucket, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                chunk = _In(data.as_py())
                classes, sizes, text = chunk.numbers(), chunk.numbers(), chunk.raw()
                at = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
                ids = []
                for x, y in zip(at, at[1:], strict=False):
                    w = text[x:y]
                    if w not in known:
                        known[w] = one(w)
                    ids.append(known[w])
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
                out.append(_Out().numbers(classes).numbers(np.fromiter(map(len, ids), np.uint32, len(ids))).numbers(flat).pack())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["block", "bucket", "data"])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, asked.schema)


def _together(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's words, and of each word's number their start and count; chunks in the order of their buckets."""
    if not chunks:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = [_In(c) for c in chunks]
    classes = np.stack([c.numbers() for c in opened]).astype(np.int64)  # buckets x classes
    size = np.concatenate([c.numbers() for c in opened]).astype(np.int64)
    flat = np.concatenate([c.numbers() for c in opened])
    first = np.cumsum(size) - size
    # Chunks hold words by bucket, then class; numbers go by class, then bucket.
    begin = (np.cumsum(classes.T.ravel()) - classes.T.ravel()).reshape(classes.T.shape).T
    number = spread(begin.ravel(), classes.ravel())
    start, count = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    start[number], count[number] = first, size
    return flat, start, count


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """(id, ids, decoded) of each row: its token ids, and the bytes that they stand for."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * n))
    pieces = fresh_path(spark, "pieces")
    blocks = _cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", pattern, block_bytes, buckets, pieces)
    back = _encode_words(_asked(spark, pieces, blocks, n), path, pattern)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        fs, base = open_fs(pieces)
        chunks = ((block, data.as_py()) for b in batches for block, data in zip(b.column(0).to_pylist(), b.column(2), strict=True))
        for block, some in itertools.groupby(chunks, key=lambda c: c[0]):
            words, table = _together([data for _, data in some]), _token_bytes(path)
            for packs in _stream(fs, f"{base}/{block}.docs"):
                for keys, data in zip(packs.column("ids"), packs.column("data"), strict=True):
                    yield documents(keys.as_py(), _In(data.as_py()), words, table)

    def documents(keys, packed, words, table):
        flat, start, size = words
        lengths, at, checks = packed.numbers().astype(np.int64), packed.numbers(), packed.numbers()
        ids = flat[spread(start[at], size[at])]
        # Where documents end among the words, then among the ids, then among the bytes.
        ends = np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(lengths)])]
        cuts = np.concatenate([[0], np.cumsum(table[2][ids])])[ends]
        text = decode(ids, table)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
        each = [text[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for key, said, want in zip(keys, each, checks.tolist(), strict=True):
            if zlib.crc32(said) != want:
                raise ValueError(f"the ids of document {key} do not decode to its text")
        texts = pa.array(each, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), lists, texts], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    return back.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digest(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of what ``encode`` gives."""
    return tokens.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
