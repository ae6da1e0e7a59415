"""WARC files as a Spark data source (format ``vidra_warc``), written and read in parallel.

Writing gives each task its own file, one gzip member a record; the member's header carries
the ``sl`` skip length, so a reader can pass over a record without inflating it. Each commit
writes a manifest of its own with the files of the tasks that succeeded and offsets to split at,
so files left by a lost or repeated task are never read; an append adds to what is there, an
overwrite takes the place of it once it is complete.

Reading plans partitions of at most ``partitionBytes`` from the manifests (or from the files
found, each whole, if there is none). Every record's header block is inflated and parsed first;
records that fail the pushed predicates (``record_type``, ``page_id``, ``target_uri``,
``refers_to``) are passed over by their skip length, unread, and a payload is only inflated if the
``payload`` option asks for it: ``none``, ``digest`` (SHA-256 and length, checked against the
header) or ``bytes``. Gzip members without a skip length have to be inflated to find their ends;
what is not wanted is not kept.

Defined cases: a null payload is an empty one; a null url or id has no header line and is
read back as null; equal rows give equal records; an empty table gives a manifest without
files and reads as no rows; columns beyond those of ``WRITE`` are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from vidra.llm.shared import count_upto, keep, new_path, ship

SCHEMA = "record_id string, record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
WRITE = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
#: Manifests are named by the commit.
MANIFEST = "_manifest-"
#: Payloads shorter than this are always written in full.
MIN_REVISIT_BYTES = 100
#: Most groups of equal payloads that are sent to every executor; beyond it they are joined by a shuffle.
MAX_BROADCAST_GROUPS = 300_000
_HEAD = 10 + 2 + 12


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _member(record: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = _HEAD + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) + body + tail


def _line(name: str, value: object) -> bytes:
    return b"" if value is None else f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = b"WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _line("WARC-Date", "2000-01-01T00:00:00Z")
    head += _line("WARC-Target-URI", url) + _line("X-Page-Id", page_id)
    if kind == "revisit":
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", f"<urn:page:{refers_to}>")
    head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(block))
    return head + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Wrote(WriterCommitMessage):
    files: list


def _manifests(filesystem: pafs.FileSystem, base: str) -> list[str]:
    if filesystem.get_file_info(base).type != pafs.FileType.Directory:
        return []
    return sorted(x.path for x in filesystem.get_file_info(pafs.FileSelector(base)) if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def _files(filesystem: pafs.FileSystem, manifest: str) -> list:
    with filesystem.open_input_stream(manifest) as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", 6))
        self.most, self.step = int(options.get("filebytes", 256 << 20)), int(options.get("splitbytes", 8 << 20))

    def write(self, iterator) -> _Wrote:
        filesystem, base = _open_fs(self.path)
        filesystem.create_dir(base, recursive=True)
        files, out, at, splits = [], None, 0, []
        name = ""
        for batch in iterator:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in WRITE)):
                if out is None:
                    name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                page_id, url, payload, size, digest, kind, refers_to = row
                data = _member(record(page_id, url, payload or b"", size, digest, kind, refers_to), self.level)
                if at - splits[-1] >= self.step:
                    splits.append(at)
                out.write(data)
                at += len(data)
                if at >= self.most:
                    out.close()
                    files.append([name, splits, at])
                    out = None
        if out is not None:
            out.close()
            files.append([name, splits, at])
        return _Wrote(files)

    def commit(self, messages: list) -> None:
        filesystem, base = _open_fs(self.path)
        filesystem.create_dir(base, recursive=True)
        before = _manifests(filesystem, base) if self.overwrite else []
        name = f"{base}/{MANIFEST}{uuid.uuid4().hex}"
        with filesystem.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        filesystem.move(f"{name}.tmp", f"{name}.json")
        for old in before:
            files = _files(filesystem, old)
            filesystem.delete_file(old)
            for x in files:
                filesystem.delete_file(f"{base}/{x[0]}")

    def abort(self, messages: list) -> None:
        filesystem, base = _open_fs(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else []:
                filesystem.delete_file(f"{base}/{name}")


@dataclass
class _Part(InputPartition):
    pieces: list  # of (file, from, to)


def headers_of(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the header block ends (-1: not within ``block``)."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _number(text: str | None) -> int | None:
    digits = (text or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.want = options["path"].rstrip("/"), options.get("payload", "digest")
        self.most = int(options.get("partitionbytes", 16 << 20))
        self.tests: list[tuple[str, list]] = []
        if self.want not in ("none", "digest", "bytes"):
            raise ValueError(f"payload must be none, digest or bytes, not {self.want!r}")

    def pushFilters(self, filters):  # noqa: N802
        """Equality and membership on header columns are decided from the headers; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "page_id", "target_uri", "refers_to"):
                self.tests.append((f.attribute[0], [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self) -> list:
        filesystem, base = _open_fs(self.path)
        manifests = _manifests(filesystem, base)
        if manifests:
            files = [x for m in manifests for x in _files(filesystem, m)]
        else:
            found = filesystem.get_file_info(pafs.FileSelector(base, recursive=True)) if filesystem.get_file_info(base).type == pafs.FileType.Directory else [filesystem.get_file_info(base)]
            if not found or found[0].type == pafs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            files = [[x.path.removeprefix(base).lstrip("/"), [0], x.size] for x in found if x.type == pafs.FileType.File and (".warc" in x.base_name)]
        pieces = [(name, a, b) for name, splits, size in files for a, b in zip(splits, [*splits[1:], size])]
        out, own, held = [], [], 0
        for p in pieces:
            if own and held + p[2] - p[1] > self.most:
                out.append(_Part(own))
                own, held = [], 0
            own.append(p)
            held += p[2] - p[1]
        return [*out, _Part(own)]

    def read(self, partition):
        filesystem, base = _open_fs(self.path)
        rows, held = [], 0
        for name, a, b in partition.pieces:
            with filesystem.open_input_file(f"{base}/{name}" if name else base) as f:
                for row in self._records(f, a, b):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 4 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["record_id", "record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def _records(self, f, a: int, b: int):
        """Rows of the records that start in [a, b)."""
        raw = io.BufferedReader(f, 1 << 20)
        raw.seek(a)
        at = a
        while at < b:
            raw.seek(at)
            start = raw.read(_HEAD)
            if not start:
                return
            raw.seek(at)
            if start[:2] == b"\x1f\x8b":
                if len(start) >= _HEAD and start[3] & 4 and start[12:14] == b"sl":
                    end_of_member = at + struct.unpack("<I", start[16:20])[0]
                    raw.seek(at + _HEAD)
                    step, block, end, fields = zlib.decompressobj(-15), b"", -1, {}
                    while end < 0 and not step.eof and raw.tell() < end_of_member:
                        block += step.decompress(raw.read(min(1024, end_of_member - raw.tell())))
                        fields, end = headers_of(block)
                    if end >= 0 and self._wanted(fields):
                        yield self._row(fields, lambda: block[end:] + step.decompress(raw.read(end_of_member - raw.tell())) + step.flush())
                    at = end_of_member
                    continue
                step, block, end, fields, wanted = zlib.decompressobj(31), bytearray(), -1, {}, True
                while not step.eof and (piece := raw.read(1 << 16)):
                    more = step.decompress(piece)
                    if wanted:
                        block += more
                    if end < 0:
                        fields, end = headers_of(bytes(block))
                        wanted = end < 0 or self._wanted(fields)
                at = raw.tell() - len(step.unused_data)
                if end >= 0 and wanted:
                    yield self._row(fields, lambda: bytes(block[end:]))
                continue
            block = b""
            while (line := raw.readline()) not in (b"\r\n", b"\n", b""):
                block += line
            fields, end = headers_of(block + b"\r\n")
            body, size = raw.tell(), int(fields.get("content-length", 0))
            at = body + size + 4
            if self._wanted(fields):
                yield self._row(fields, lambda: raw.read(size))

    def _wanted(self, fields: dict) -> bool:
        have = {"record_type": fields.get("warc-type"), "page_id": _number(fields.get("x-page-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": _number(fields.get("warc-refers-to"))}
        return all(have[k] is not None and have[k] in v for k, v in self.tests)

    def _row(self, fields: dict, rest) -> tuple:
        kind, digest, size, payload = fields.get("warc-type"), (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None, None, None
        if self.want != "none":
            block = rest()[: int(fields.get("content-length", 0))]
            http, end = headers_of(block) if block[:5] == b"HTTP/" else ({}, 0)
            end = max(end, 0)
            if kind == "revisit":
                size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            else:
                payload, size = block[end:], len(block) - end
                found = hashlib.sha256(payload).hexdigest()
                if digest is not None and found != digest and (fields.get("warc-payload-digest") or "").startswith("sha256:"):
                    raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
                digest = found
        return fields.get("warc-record-id"), kind, _number(fields.get("x-page-id")), fields.get("warc-target-uri"), _number(fields.get("warc-refers-to")), size, digest, payload if self.want == "bytes" else None


class WarcSource(DataSource):
    """``spark.read.format("vidra_warc")`` and ``df.write.format("vidra_warc")``."""

    @classmethod
    def name(cls) -> str:
        return "vidra_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def pages_to_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Rows of ``WRITE`` for a table of page_id, url and html.

    Of records with equal payloads of ``MIN_REVISIT_BYTES`` bytes or more, the one with the
    smallest page_id is the response and the others revisit it. A null page_id is never the
    smallest; where a group has no id at all, all its records are responses, as are rows
    that repeat the smallest id.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    repeatable = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    groups = base.filter(repeatable).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = keep(spark, groups.filter("n > 1 and first_id is not null").select("payload_digest", "first_id"), "payload-groups")
    if count_upto(groups, MAX_BROADCAST_GROUPS) <= MAX_BROADCAST_GROUPS:
        base = base.join(F.broadcast(groups), "payload_digest", "left")
    else:
        # Short payloads, among them all the empty ones, need no group and are not moved.
        base = base.filter(repeatable).join(groups, "payload_digest", "left").unionByName(base.filter(~repeatable).withColumn("first_id", F.lit(None).cast("long")))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return base.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_warc(spark: SparkSession, records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write rows of ``WRITE`` as WARC files with a manifest; ``mode`` is append or overwrite."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    records.select(*WRITE).write.format("vidra_warc").options(**options).mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "digest", **options) -> DataFrame:
    """The records below ``path``; filters on header columns are pushed into the reader."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("vidra_warc").option("payload", payload).options(**options).load(path)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and read them back, one row a page."""
    path = new_path(spark, "warc")
    write_warc(spark, pages_to_records(spark, pages), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
