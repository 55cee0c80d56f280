"""The queue manifest: a 16-byte header and a task list in one binary file, its codec and its Spark source.

Header: version 1, IPv4 address (little-endian u32), port (u16), epoch (u64), compression (0 none, 1
zstd). Body: `TASK`, count, tasks, zeros up to a multiple of 8; the header is never compressed. A UUID is
two little-endian u64 halves; times are i64 milliseconds; strings end in a zero byte.
"""

from __future__ import annotations

import ipaddress
import struct
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = struct.Struct("<B4sHQB")
MAGIC, VERSION, NONE, ZSTD = b"TASK", 1, 0, 1
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
ANY = "struct<type_url: string, value: binary>"
TASK = (
    "id string, originally_scheduled_at timestamp, scheduled_at timestamp, max_retries int, retry_count int, status int, "
    f"worker_id string, last_heartbeat timestamp, lease_expires_at timestamp, error_message string, details {ANY}, payload {ANY}"
)
HEADER_COLUMNS = "path string, version int, address string, port int, epoch decimal(20,0), compression int"


class WireError(ValueError):
    """Bytes that are no manifest."""


@dataclass(frozen=True)
class Header:
    address: str
    port: int
    epoch: int = 0
    compression: int = NONE

    def to_bytes(self) -> bytes:
        address = int(ipaddress.IPv4Address(self.address)).to_bytes(4, "little")
        return HEADER.pack(VERSION, address, self.port, self.epoch, self.compression)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Header:
        if len(raw) < HEADER.size:
            raise WireError("a header has 16 bytes")
        version, address, port, epoch, compression = HEADER.unpack(raw[: HEADER.size])
        if version != VERSION or compression not in (NONE, ZSTD):
            raise WireError("unknown version or compression")
        return cls(str(ipaddress.IPv4Address(int.from_bytes(address, "little"))), port, epoch, compression)

    @property
    def url(self) -> str:
        return f"http://{self.address}:{self.port}"


@dataclass(frozen=True)
class Any:
    type_url: str
    value: bytes


@dataclass(frozen=True)
class Task:
    id: str
    originally_scheduled_at: datetime
    scheduled_at: datetime
    max_retries: int
    retry_count: int
    payload: Any
    status: int = 0
    worker_id: str | None = None
    last_heartbeat: datetime | None = None
    lease_expires_at: datetime | None = None
    error_message: str | None = None
    details: Any | None = None


@dataclass
class Manifest:
    header: Header
    tasks: list[Task] = field(default_factory=list)

    def to_bytes(self) -> bytes:
        body = MAGIC + struct.pack("<I", len(self.tasks)) + b"".join(map(_task_bytes, self.tasks))
        body += bytes(-len(body) % 8)
        if self.header.compression == ZSTD:
            import zstandard

            body = zstandard.ZstdCompressor().compress(body)
        return self.header.to_bytes() + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Manifest:
        header = Header.from_bytes(raw)
        body = raw[HEADER.size :]
        if header.compression == ZSTD:
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        return cls(header, decode_tasks(body))


def _uuid_bytes(text: str) -> bytes:
    raw = uuid.UUID(text).bytes
    return raw[7::-1] + raw[:7:-1]


def _millis(t: datetime) -> bytes:
    return struct.pack("<q", (t - EPOCH) // timedelta(milliseconds=1))


def _string(text: str) -> bytes:
    raw = text.encode()
    if b"\0" in raw:
        raise WireError("a string can't hold a zero byte")
    return raw + b"\0"


def _any_bytes(a: Any) -> bytes:
    return _string(a.type_url) + struct.pack("<I", len(a.value)) + a.value


def _task_bytes(t: Task) -> bytes:
    out = _uuid_bytes(t.id) + _millis(t.originally_scheduled_at) + _millis(t.scheduled_at)
    out += struct.pack("<HHB", t.max_retries, t.retry_count, t.status)
    if t.status == 1:
        out += _uuid_bytes(t.worker_id) + _millis(t.last_heartbeat) + _millis(t.lease_expires_at)
    elif t.status == 2:
        out += _string(t.error_message) + _any_bytes(t.details)
    return out + _any_bytes(t.payload)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise WireError("the bytes end early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def unpack(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def uuid(self) -> str:
        raw = self.take(16)
        return str(uuid.UUID(bytes=raw[7::-1] + raw[:7:-1]))

    def time(self) -> datetime:
        (ms,) = self.unpack("<q")
        try:
            return EPOCH + timedelta(milliseconds=ms)
        except OverflowError as e:
            raise WireError("a time is out of range") from e

    def string(self) -> str:
        end = self.raw.find(b"\0", self.at)
        if end < 0:
            raise WireError("a string has no end")
        return self.take(end - self.at + 1)[:-1].decode()

    def any(self) -> Any:
        url = self.string()
        return Any(url, self.take(*self.unpack("<I")))


def decode_tasks(body: bytes) -> list[Task]:
    r = _Reader(body)
    if r.take(4) != MAGIC:
        raise WireError("no task list")
    tasks = []
    for _ in range(*r.unpack("<I")):
        id_, original, scheduled = r.uuid(), r.time(), r.time()
        most, count, status = r.unpack("<HHB")
        more: dict = {}
        if status == 1:
            more = {"worker_id": r.uuid(), "last_heartbeat": r.time(), "lease_expires_at": r.time()}
        elif status == 2:
            more = {"error_message": r.string(), "details": r.any()}
        elif status:
            raise WireError("unknown status")
        tasks.append(Task(id_, original, scheduled, most, count, r.any(), status, **more))
    return tasks


def read_headers(spark: SparkSession, paths: str) -> DataFrame:
    """Headers of all manifests under a path pattern; of each file Spark gives its bytes, and 16 of them are parsed in SQL."""
    return headers(spark.read.format("binaryFile").load(paths))


def headers(files: DataFrame) -> DataFrame:
    """Headers of manifests (path, content), parsed in SQL."""
    raw = F.substring("content", 1, HEADER.size)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10)
    little = lambda i, n: F.conv(F.concat(*[F.hex(F.substring(raw, j, 1)) for j in range(i + n - 1, i - 1, -1)]), 16, 10)
    fine = (F.length("content") >= HEADER.size) & (byte(1) == "1") & byte(16).isin("0", "1")
    return files.select(
        F.when(fine, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no manifest: "), "path"))).alias("path"),
        byte(1).cast("int").alias("version"),
        F.concat_ws(".", byte(5), byte(4), byte(3), byte(2)).alias("address"),
        little(6, 2).cast("int").alias("port"),
        little(8, 8).cast("decimal(20,0)").alias("epoch"),
        byte(16).cast("int").alias("compression"),
    ).withColumn("broker_url", F.concat(F.lit("http://"), "address", F.lit(":"), "port"))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ManifestReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path.removeprefix("file://"), "rb") as f:
            m = Manifest.from_bytes(f.read())
        pair = lambda a: None if a is None else (a.type_url, a.value)
        for t in m.tasks:
            yield (t.id, t.originally_scheduled_at, t.scheduled_at, t.max_retries, t.retry_count, t.status, t.worker_id, t.last_heartbeat, t.lease_expires_at, t.error_message, pair(t.details), pair(t.payload))


class ManifestSource(DataSource):
    """spark.read.format("tidemark_manifest").load("a,b"): tasks of local or mounted manifest files."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_manifest"

    def schema(self) -> str:
        return TASK

    def reader(self, schema):
        return _ManifestReader(self.options)


def encode(tasks: DataFrame, by: str, header: Header) -> DataFrame:
    """A manifest (path, content) for each queue `by` of tasks, whose columns are those of TASK. A queue's manifest is one file by its nature."""

    def pack(key, pdf):
        import pandas as pd

        any_ = lambda a: None if a is None else Any(a["type_url"], bytes(a["value"]))
        none = lambda v: None if v is None or v is pd.NaT or v != v else v
        time_ = lambda t: None if none(t) is None else t.to_pydatetime().replace(tzinfo=UTC) if t.tzinfo is None else t.to_pydatetime()
        listed = [
            Task(
                r.id, time_(r.originally_scheduled_at), time_(r.scheduled_at), int(r.max_retries), int(r.retry_count), any_(r.payload), int(r.status),
                none(r.worker_id), time_(r.last_heartbeat), time_(r.lease_expires_at), none(r.error_message), any_(none(r.details)),
            )
            for r in pdf.sort_values("id").itertuples()
        ]
        return pd.DataFrame({"path": [str(key[0])], "content": [Manifest(header, listed).to_bytes()]})

    return tasks.groupBy(by).applyInPandas(pack, "path string, content binary")


def read_tasks(spark: SparkSession, paths: str) -> DataFrame:
    """Tasks of all manifests that Spark's readers can open, one row each."""
    return decode(spark.read.format("binaryFile").load(paths))


def decode(files: DataFrame) -> DataFrame:
    """Tasks of manifests (content), one row each."""

    def unpack(batches):
        import pandas as pd

        pair = lambda a: None if a is None else {"type_url": a.type_url, "value": a.value}
        for pdf in batches:
            rows = [{**t.__dict__, "details": pair(t.details), "payload": pair(t.payload)} for raw in pdf["content"] for t in Manifest.from_bytes(bytes(raw)).tasks]
            yield pd.DataFrame(rows, columns=_names())

    return files.select("content").mapInPandas(unpack, TASK)


def _names() -> list[str]:
    return ["id", "originally_scheduled_at", "scheduled_at", "max_retries", "retry_count", "status", "worker_id", "last_heartbeat", "lease_expires_at", "error_message", "details", "payload"]
