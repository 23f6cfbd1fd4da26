"""WARC as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per file, or per split of a file that the writer's manifest names. ``record_types`` and
header equalities (``header.<Name>`` options), or pushed filters on ``record_type``, are tested on the headers, which
are parsed first; the payload of a record that isn't wanted is skipped without being read or inflated: seen from
``Content-Length`` in plain files, and from the skip-length field of each gzip member in compressed ones. With
``payload`` set to false no payload is decoded at all.

Writing gives each task a file of its own name; the manifest, written at commit, names the files of the tasks that
succeeded, so those of failed or repeated attempts are never read. Files are reached through ``pyarrow.fs``.

Records of equal payloads are told by digests alone: those that occur more than once are listed, and the listing goes
to the pages, which stay where they are. Only a listing beyond ``LISTED_ROWS`` is joined by a shuffle, and even then
pages with a digest that many share stay.

Defined results: a null payload counts as empty; a null URL has no target header; control characters and spaces in a
URL are percent-encoded; a null id is written as such and read back as null. Files written elsewhere may hold all
records in one gzip member. A file that ends within a record, or holds something else, fails the read with its name
and place; with ``on_error`` "skip" its records before that place are read and the rest of the file is not.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from lacuna.llm.common import join_listed, open_fs

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length bigint, headers map<string,string>, payload binary"
INPUT = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length bigint, payload binary"
MANIFEST = "_manifest.json"
#: A split begins at the first record after so many bytes.
SPLIT_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_SL = struct.Struct("<2sHII")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, record_id: str, uri: str | None, digest: str, length: int, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record; a revisit has the HTTP header alone."""
    block = _HTTP % length + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", _clean(uri)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field tells its own length and that of what it holds."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 12 + _SL.size + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", _SL.size) + _SL.pack(b"sl", 8, size, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.decode("latin-1").strip()] = v.decode("utf-8", "replace").strip()
    return out


def _bare(v: str | None) -> str | None:
    return v.removeprefix("<").removesuffix(">") if v is not None else None


class BadRecord(ValueError):
    """Something that is not a whole record."""


def _parsed(head: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record and the length of its block."""
    headers = _headers(head)
    length = headers.get("Content-Length", "")
    if not head.startswith(b"WARC/") or not length.isdecimal():
        raise BadRecord("not a record")
    return headers, int(length)


class _Plain:
    """Records of an uncompressed file from an offset; blocks are read on demand."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.end = f, at, end

    def heads(self) -> Iterator[dict[str, str]]:
        size = self.f.size()
        while self.at < min(self.end, size):
            self.f.seek(self.at)
            head = b""
            while (cut := head.find(b"\r\n\r\n")) < 0:
                more = self.f.read(4096)
                if not more:
                    raise BadRecord("a record ends within its headers")
                head += more
            h, self.length = _parsed(head[:cut])
            self.block = self.at + cut + 4
            if self.block + self.length > size:
                raise BadRecord("a record ends before its length")
            yield h
            self.at = self.block + self.length + 4

    def body(self) -> bytes:
        self.f.seek(self.block)
        return self.f.read(self.length)


class _Inflated:
    """What gzip members hold from an offset on, as one stream."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.z, self.left, self.data = f, None, b"", bytearray()

    def _more(self) -> bool:
        if self.z is None:
            self.left = self.left or self.f.read(65536)
            if not self.left:
                return False
            self.z = zlib.decompressobj(31)
        raw = self.left or self.f.read(65536)
        got = self.z.decompress(raw, 1 << 20)
        if not raw and not got and not self.z.eof:
            raise BadRecord("a gzip member ends before its length")
        self.data += got
        self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.z.eof:
            self.z = None
        return True

    def find(self, mark: bytes) -> int:
        """Where ``mark`` is; -1 if the stream ends before it."""
        seen = 0
        while (cut := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self._more():
                return -1
        return cut

    def fill(self, n: int) -> bool:
        while len(self.data) < n:
            if not self._more():
                return False
        return True

    def skip(self, n: int) -> bool:
        while n > len(self.data):
            n -= len(self.data)
            self.data.clear()
            if not self._more():
                return False
        del self.data[:n]
        return True


class _Gzip:
    """Records of a gzip file from an offset: a member each whose header tells its length, or any number in a member."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.end = f, at, end

    def _skip_length(self) -> int:
        self.f.seek(self.at)
        first = self.f.read(12 + _SL.size)
        if len(first) == 12 + _SL.size and first[3] & 4 and struct.unpack_from("<H", first, 10)[0] == _SL.size:
            name, _, skip, _ = _SL.unpack_from(first, 12)
            return skip if name == b"sl" else 0
        return 0

    def heads(self) -> Iterator[dict[str, str]]:
        size = self.f.size()
        while self.at < min(self.end, size):
            skip = self._skip_length()
            if self.at + skip > size:
                raise BadRecord("a gzip member ends before its length")
            self.stream = _Inflated(self.f, self.at)
            while (cut := self.stream.find(b"\r\n\r\n")) >= 0:
                head = bytes(self.stream.data[:cut])
                self.stream.skip(cut + 4)
                h, self.length = _parsed(head.lstrip(b"\r\n"))
                yield h
                if skip:
                    break
                if not self.stream.skip(self.length):
                    raise BadRecord("a record ends before its length")
                while self.stream.fill(2) and self.stream.data.startswith(b"\r\n"):
                    self.stream.skip(2)
            if not skip:  # it has been read to the end of the file
                if self.stream.data.strip():
                    raise BadRecord("a record ends within its headers")
                return
            self.at += skip

    def body(self) -> bytes:
        if not self.stream.fill(self.length):
            raise BadRecord("a record ends before its length")
        return bytes(self.stream.data[: self.length])


@dataclass
class WarcSplit(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.types = frozenset(filter(None, options.get("record_types", options.get("recordtypes", "")).split(","))) or None
        self.wanted = {k[7:].lower(): v for k, v in options.items() if k.lower().startswith("header.")}
        self.payload = options.get("payload", "true").lower() != "false"
        self.on_error = options.get("on_error", "raise")
        if self.on_error not in ("raise", "skip"):
            raise ValueError(f"on_error is raise or skip, not {self.on_error!r}")

    def pushFilters(self, filters):
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("record_type",):
                self.types = frozenset(values) if self.types is None else self.types & frozenset(values)
            else:
                yield f

    def partitions(self):
        fs, base = open_fs(self.path)
        if fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
            out = [WarcSplit(x["name"], a, b) for x in files for a, b in zip(x["splits"], [*x["splits"][1:], 1 << 62], strict=True)]
        else:
            out = [WarcSplit(i.base_name, 0, 1 << 62) for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return out or [WarcSplit("", 0, 0)]

    def _whole(self, records, split):
        """The headers of ``records``, up to the first that is not whole."""
        try:
            yield from records.heads()
        except (BadRecord, zlib.error) as e:
            if self.on_error == "raise":
                raise BadRecord(f"{self.path}/{split.path}, record at byte {records.at}: {e}") from None

    def read(self, split):
        fs, base = open_fs(self.path)
        if not split.path:
            return
        rows: list[tuple] = []
        held = 0
        schema = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        with fs.open_input_file(f"{base}/{split.path}") as f:
            records = (_Gzip if split.path.endswith(".gz") else _Plain)(f, split.start, split.end)
            for h in self._whole(records, split):
                kind = h.get("WARC-Type")
                if self.types is not None and kind not in self.types:
                    continue
                if self.wanted and any({k.lower(): v for k, v in h.items()}.get(k) != v for k, v in self.wanted.items()):
                    continue
                # What the payload of an HTTP message is, and how long the whole of it is, its own header tells.
                payload, length = None, None
                if self.payload or kind == "revisit":
                    try:
                        block = records.body()
                    except (BadRecord, zlib.error) as e:
                        if self.on_error == "raise":
                            raise BadRecord(f"{self.path}/{split.path}, record at byte {records.at}: {e}") from None
                        break
                    head, sep, payload = block.partition(b"\r\n\r\n")
                    if not sep:
                        head, payload = b"", head
                    length = int(_headers(head).get("Content-Length", len(payload)))
                    payload = payload if kind != "revisit" and self.payload else None
                rows.append((_bare(h.get("WARC-Record-ID")), kind, h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, _bare(h.get("WARC-Refers-To")), length, list(h.items()), payload))
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class WarcFile(WriterCommitMessage):
    name: str
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.split_bytes = int(options.get("split_bytes", options.get("splitbytes", SPLIT_BYTES)))

    def write(self, iterator):
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        at, splits = 0, []
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in iterator:
                for r in b.to_pylist():
                    raw = record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload_length"], r["payload"] or b"", r["refers_to"])
                    raw = gzip_member(raw) if self.gzip else raw
                    if not splits or at - splits[-1] >= self.split_bytes:
                        splits.append(at)
                    f.write(raw)
                    at += len(raw)
        return WarcFile(name, splits)

    def commit(self, messages):
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        files = [{"name": m.name, "splits": m.splits} for m in messages if m is not None]
        if not self.overwrite and fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read()) + files
        with fs.open_output_stream(f"{base}/{MANIFEST}.new", compression=None) as f:
            f.write(json.dumps([x for x in files if x["splits"]]).encode())
        fs.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")

    def abort(self, messages):
        fs, base = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


URN = "urn:lacuna:page:"


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """A record per row of ``pages``. Of equal payloads of at least ``least_bytes`` bytes, the row with the largest id
    (each such row, if rows share it) is a response and the others revisit it; rows without an id are all responses."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_n", F.octet_length("payload").cast("bigint"))
    # Only digests that occur more than once are listed.
    often = rows.where((F.col("_n") >= least_bytes) & F.col("_id").isNotNull()).groupBy("_sha1", "_n")
    last = often.agg(F.max("_id").alias("_last"), F.min("_id").alias("_first"), F.count("*").alias("_rows")).where("_first < _last").drop("_first")
    rows = join_listed(rows, last, ["_sha1", "_n"], "_rows")
    revisit = F.col("_id") < F.col("_last")
    urn = lambda c: F.concat(F.lit(URN), F.coalesce(c.cast("string"), F.lit("null")))
    kind = F.when(revisit, "revisit").otherwise("response")
    # A revisit is written without its payload.
    out = rows.select(urn(F.col("_id")).alias("record_id"), kind.alias("record_type"), F.col("_url").alias("target_uri"), F.col("_sha1").alias("payload_digest"), F.when(revisit, urn(F.col("_last"))).alias("refers_to"), F.col("_n").alias("payload_length"), F.when(kind == "response", F.col("payload")).alias("payload"))

    def base32(batches):
        for b in batches:
            at = b.schema.get_field_index("payload_digest")
            yield b.set_column(at, b.schema.field(at), pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(at).to_pylist()], pa.string()))

    return out.mapInArrow(base32, INPUT)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records to ``path``."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, record_types: str = "", payload: bool = True, headers: dict[str, str] | None = None, on_error: str = "raise") -> DataFrame:
    """Read the records of ``path``, or those of the given types and headers alone.

    Turns on the session's setting that lets Python sources take filters.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that push filters down
    options = {f"header.{k}": v for k, v in (headers or {}).items()}
    return spark.read.format("warc").options(record_types=record_types, payload=str(payload).lower(), on_error=on_error, **options).load(path)


def digest(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The digest columns of records read back; length and digest of a response are computed from its payload."""

    def run(batches):
        for b in batches:
            ids, kinds, said, refers, lengths, payloads = (b.column(i).to_pylist() for i in range(6))
            seen = [digest_of(p) if p is not None else d for p, d in zip(payloads, said, strict=True)]
            size = [len(p) if p is not None else n for p, n in zip(payloads, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size, pa.int64()), pa.array(seen, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.string())], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = records.select("record_id", "record_type", "payload_digest", "refers_to", "payload_length", "payload").mapInArrow(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) as {id_type})")
    return out.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
