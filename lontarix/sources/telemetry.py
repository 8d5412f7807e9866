"""Length-delimited telemetry as a data source: ``spark.read.format("telemetry")`` and ``df.write.format("telemetry")``.

A file is a run of frames, each the length of a message as a varint and the message: an observation in the protocol-buffer wire format,
fields in order of their numbers, those that are zero, empty or null left out. A dataset is a folder with a ``manifest.json`` that names
its files, their sizes and counts, and the offsets where a reader may begin. Tasks write files under names of their own; the commit
replaces the manifest in one step, so a reader has all of a write or none of it, and what failed tasks leave is never read. ``append`` adds
to the manifest's files, ``overwrite`` takes their place.

Reading stops with an error at a frame that goes beyond its file or split, a length over ``max_bytes``, a field that the message doesn't
have or of another wire type, text that isn't UTF-8, and a file whose size isn't the manifest's.

Paths are what ``pyarrow.fs`` can open: local or mounted folders (``file://``), ``hdfs://``, ``s3://``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "run_id string, request_id string, scheduled_ns long, completion_ns long, outcome int, first_token_ns long, stages array<struct<stage:string,duration_ns:long,queue_ns:long>>"
_ARROW = pa.schema([
    ("run_id", pa.string()), ("request_id", pa.string()), ("scheduled_ns", pa.int64()), ("completion_ns", pa.int64()), ("outcome", pa.int32()), ("first_token_ns", pa.int64()),
    ("stages", pa.list_(pa.struct([("stage", pa.string()), ("duration_ns", pa.int64()), ("queue_ns", pa.int64())]))),
])
#: A message's largest size, and bytes between offsets where a reader may begin.
MAX_BYTES, SPLIT_BYTES = 1 << 20, 4 << 20
#: Types of a field on the wire, a number or a length with bytes.
VARINT, BYTES = 0, 2


class TelemetryError(ValueError):
    pass


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    n = shift = 0
    while at < end and shift < 70:
        b = data[at]
        at, n, shift = at + 1, n | (b & 0x7F) << shift, shift + 7
        if b < 0x80:
            if n >> 64:
                break
            return n, at
    raise TelemetryError("torn or overlong varint")


def _put(number: int, value: str | int | None, optional: bool = False) -> bytes:
    if value is None or (not value and not optional):
        return b""
    if isinstance(value, str):
        value = value.encode()
        return varint(number << 3 | BYTES) + varint(len(value)) + value
    if value < 0:
        raise TelemetryError("telemetry numbers aren't negative")
    return varint(number << 3 | VARINT) + varint(value)


def encode(row: tuple) -> bytes:
    """The message of an observation; null text and numbers are those that are left out, but for the first token's time, which may be zero."""
    *head, first_token, stages = row
    out = b"".join(_put(i, v) for i, v in enumerate(head, 1)) + _put(6, first_token, optional=True)
    for stage in stages or ():
        inner = b"".join(_put(i, v) for i, v in enumerate(stage, 1))
        out += varint(7 << 3 | BYTES) + varint(len(inner)) + inner
    return out


def _fields(data: bytes, at: int, end: int, kinds: dict[int, int]) -> Iterator[tuple[int, int | bytes]]:
    while at < end:
        key, at = read_varint(data, at, end)
        number, kind = key >> 3, key & 7
        if kinds.get(number) != kind:
            raise TelemetryError(f"unknown field {number} of wire type {kind}")
        value, at = read_varint(data, at, end)
        if kind == BYTES:
            if at + value > end:
                raise TelemetryError("a field goes beyond its message")
            value, at = data[at : at + value], at + value
        elif value >= 1 << 63:
            raise TelemetryError("telemetry numbers aren't negative")
        yield number, value


def _text(value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError as e:
        raise TelemetryError("text isn't UTF-8") from e


def decode(data: bytes) -> tuple:
    """The observation of a message; a field that comes twice has its last value."""
    row, stages = ["", "", 0, 0, 0, None], []
    for number, value in _fields(data, 0, len(data), {1: BYTES, 2: BYTES, 3: VARINT, 4: VARINT, 5: VARINT, 6: VARINT, 7: BYTES}):
        if number == 7:
            stage = ["", 0, 0]
            for n, v in _fields(value, 0, len(value), {1: BYTES, 2: VARINT, 3: VARINT}):
                stage[n - 1] = _text(v) if n == 1 else v
            stages.append(dict(zip(("stage", "duration_ns", "queue_ns"), stage, strict=True)))
        else:
            row[number - 1] = _text(value) if number < 3 else value
    return (*row, stages)


def frames(data: bytes, max_bytes: int = MAX_BYTES) -> Iterator[bytes]:
    """The messages of a run of whole frames."""
    at, end = 0, len(data)
    while at < end:
        size, at = read_varint(data, at, end)
        if size > max_bytes:
            raise TelemetryError(f"a message of {size} bytes")
        if at + size > end:
            raise TelemetryError("a frame goes beyond its file")
        yield data[at : at + size]
        at += size


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(files: fs.FileSystem, base: str) -> list[dict]:
    name = f"{base}/manifest.json"
    if files.get_file_info(name).type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(name) as f:
        return json.loads(f.read())["files"]


@dataclass
class Split(InputPartition):
    name: str
    start: int
    stop: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.max_bytes = options["path"], int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[Split]:
        files, base = _opened(self.path)
        listed = _manifest(files, base)
        if not listed and files.get_file_info(f"{base}/manifest.json").type == fs.FileType.NotFound:
            raise TelemetryError(f"no telemetry at {self.path}")
        cuts = [(f, [*f["offsets"], f["size"]]) for f in listed]
        return [Split(f["name"], a, b, f["size"]) for f, at in cuts for a, b in zip(at[:-1], at[1:], strict=True)]

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # Spark asks once where there is no split
            return
        files, base = _opened(self.path)
        with files.open_input_file(f"{base}/{split.name}") as f:
            if f.size() != split.size:
                raise TelemetryError(f"{split.name} has {f.size()} bytes, not {split.size}")
            f.seek(split.start)
            data = f.read(split.stop - split.start)
        rows = []
        for message in frames(data, self.max_bytes):
            rows.append(decode(message))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.max_bytes, self.split = options["path"], overwrite, int(options.get("max_bytes", MAX_BYTES)), int(options.get("split_bytes", SPLIT_BYTES))

    def write(self, rows: Iterator) -> Written:
        files, base = _opened(self.path)
        files.create_dir(base, recursive=True)
        name, size, count, offsets = f"part-{uuid.uuid4().hex}", 0, 0, [0]
        out = None
        for row in rows:
            message = encode((row.run_id, row.request_id, row.scheduled_ns, row.completion_ns, row.outcome, row.first_token_ns, row.stages))
            if len(message) > self.max_bytes:
                raise TelemetryError(f"a message of {len(message)} bytes")
            out = out or files.open_output_stream(f"{base}/{name}")
            if size - offsets[-1] >= self.split:
                offsets.append(size)
            head = varint(len(message))
            out.write(head + message)
            size, count = size + len(head) + len(message), count + 1
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "size": size, "count": count, "offsets": offsets}])

    def commit(self, messages: list[Written]) -> None:
        files, base = _opened(self.path)
        files.create_dir(base, recursive=True)
        before = _manifest(files, base)
        new = [f for m in messages if m for f in m.files]
        aside = f"{base}/manifest-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as f:
            f.write(json.dumps({"files": new if self.overwrite else before + new}).encode())
        files.move(aside, f"{base}/manifest.json")
        for gone in before if self.overwrite else ():
            files.delete_file(f"{base}/{gone['name']}")

    def abort(self, messages: list[Written]) -> None:
        files, base = _opened(self.path)
        for f in (f for m in messages if m for f in m.files):
            files.delete_file(f"{base}/{f['name']}")


class Telemetry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write(rows: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    rows.sparkSession.dataSource.register(Telemetry)
    kinds = StructType.fromDDL(SCHEMA)
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds)).write.format("telemetry").mode(mode).options(**options).save(path)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(Telemetry)
    return spark.read.format("telemetry").options(**options).load(path)


def run_issues(observations: DataFrame, run_id: str) -> DataFrame:
    """(request_id, issue) of a run's observations: of another run, without an id, of an id that repeats, with a stage named twice."""
    n = F.expr("count(*) OVER (PARTITION BY request_id)")
    names = F.transform("stages", lambda s: s.stage)
    found = F.array(
        F.when(F.coalesce(F.col("run_id"), F.lit("")) != run_id, "run_id"), F.when(F.coalesce(F.col("request_id"), F.lit("")) == "", "request_id"),
        F.when(n > 1, "repeated_request"), F.when(F.size(names) != F.size(F.array_distinct(names)), "repeated_stage"),
    )
    return observations.select("request_id", found.alias("found")).select("request_id", F.explode(F.array_compact("found")).alias("issue"))
