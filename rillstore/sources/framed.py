"""Spark data source ``rill``: framed record streams, batch and streaming, reading and writing.

Options: ``path`` (file or folder), ``schema`` (schema text), ``table``, ``tag`` (its type tag), ``source``
(value of ``_source``, default the table), ``columns`` (comma-separated; others are null), ``layout``
(``frames`` or ``checked``), ``split_bytes``, ``empty_string_defaults``; for writing, ``roll_bytes``.

Columns are the declared ones, then ``_source, _rowid, _offset, _data``. ``_rowid`` counts all records of
all tables from 1 in order of path and offset. A batch read makes one partition for every
``split_bytes`` of frames, found by hopping from header to header; the options ``rowid`` and ``offset`` read
one record only, from the one partition that holds it. (Spark 4.1 keeps what filters a scan pushed
down for later scans of the same frame, so filters are not taken here.) A half-written frame at the end
is left alone; a streaming read takes it up once it is whole.

The files are opened by Python on the executors, so they must lie on a file system mounted there;
:func:`rillstore.operators.store.read_frames` reads from any file system Spark knows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rillstore import codec
from rillstore.schema import parse

_LENGTH = struct.Struct("<I").unpack_from
VIRTUAL = [T.StructField("_source", T.StringType()), T.StructField("_rowid", T.LongType()), T.StructField("_offset", T.LongType()), T.StructField("_data", T.BinaryType())]


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def files(path: str) -> list[str]:
    path = local(path)
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        return []
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if not n.startswith(("_", ".")))


def hop(path: str, start: int = 0, limit: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Offset, size and type tag of every whole frame, reading only the headers of large ones."""
    size, block = os.path.getsize(path), 1 << 16
    with open(path, "rb", buffering=0) as f:
        at, base, data = start, start, b""
        while at + 4 <= size and (limit is None or at < limit):
            i = at - base
            if i + 12 > len(data):
                f.seek(at)
                base, data, i = at, f.read(block), 0
                if len(data) < 4:
                    return
            n = _LENGTH(data, i)[0]
            if at + 4 + n > size:
                return
            yield at, n, data[i + 8 : i + 12] if n >= 8 else b""
            at += 4 + n


class Span(InputPartition):
    """Some whole frames of a file; ``first`` is the row id of the first."""

    def __init__(self, path: str, start: int, end: int, first: int, count: int):
        self.path, self.start, self.end, self.first, self.count = path, start, end, first, count


class _Rows:
    def __init__(self, options: dict[str, str]):
        self.schema = parse(options["schema"])
        self.table = options.get("table") or self.schema.root_type or next(iter(self.schema.tables))
        self.tag = options.get("tag") or self.schema.file_identifier
        self.source = options.get("source") or self.table
        self.layout = options.get("layout", "frames")
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.empty = options.get("empty_string_defaults", "false").lower() == "true"

    def kind(self) -> T.StructType:
        declared = [T.StructField(f.name, f.dataType, True) for f in self.schema.struct_type(self.table).fields]
        return T.StructType([*declared, *VIRTUAL])

    def batches(self, items: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Decoded rows of ``(row id, offset, record)``, some thousand records at a time."""
        from pyspark.sql.pandas.types import to_arrow_schema

        from rillstore.operators import store

        def whole(held: list) -> pa.RecordBatch:
            ids, offsets, records = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([self.source] * len(held), pa.string()), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(records, pa.binary())], ["_source", "_rowid", "_offset", "_data"])

        def raw() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for item in items:
                held.append(item)
                size += len(item[2])
                if len(held) >= store.HELD or size >= store.HELD_BYTES:
                    yield whole(held)
                    held, size = [], 0
            if held:
                yield whole(held)

        arrow = to_arrow_schema(self.kind())
        for b in store.decoding(self.schema, self.table, self.columns, self.empty)[1](raw()):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in arrow], schema=arrow)

    def span(self, s: Span, keep=lambda rowid, offset: True) -> Iterator[pa.RecordBatch]:
        return self.batches(self.records(s, keep))

    def records(self, s: Span, keep) -> Iterator[tuple[int, int, bytes]]:
        """Row id, offset and bytes of a span's records of the tag; frames are read one after another."""
        if self.layout == "checked":
            with open(s.path, "rb") as f:
                data = f.read()
            for sequence, offset, table, _, body in codec.read_checked(data):
                if table == self.table[:15] and keep(s.first + sequence, offset) and (not self.tag or codec.type_tag(body) == self.tag):
                    yield s.first + sequence, offset, bytes(body)
            return
        with open(s.path, "rb", buffering=1 << 20) as f:
            f.seek(s.start)
            at, rowid = s.start, s.first
            while at + 4 <= s.end:
                n = _LENGTH(f.read(4))[0]
                record = f.read(n)
                if keep(rowid, at) and (not self.tag or codec.type_tag(record) == self.tag):
                    yield rowid, at, record
                at, rowid = at + 4 + n, rowid + 1


def spans(path: str, start: int, limit: int | None, first: int, size: int, tag: str = "") -> tuple[list[Span], int]:
    """A file's frames from ``start`` as spans of about ``size`` bytes, and the row id after them; spans
    without a record of the tag are left out."""
    out, rowid, end, mine, own = [], first, start, False, tag.encode("latin-1")
    for at, n, got in hop(path, start, limit):
        rowid, end, mine = rowid + 1, at + 4 + n, mine or not own or got == own
        if end - start >= size:
            if mine:
                out.append(Span(path, start, end, first, rowid - first))
            start, first, mine = end, rowid, False
    if mine:
        out.append(Span(path, start, end, first, rowid - first))
    return out, rowid


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.rows = options, _Rows(options)
        self.rowid, self.offset = (int(options[k]) if options.get(k) else None for k in ("rowid", "offset"))

    def partitions(self) -> Sequence[InputPartition]:
        out, rowid, size = [], 1, int(self.options.get("split_bytes", 64 << 20))
        for path in files(self.options["path"]):
            if self.rows.layout == "checked":
                with open(path, "rb") as f:
                    head = f.read(codec.CHECKED_FILE.size)
                count = codec.CHECKED_FILE.unpack(head)[3] if len(head) == codec.CHECKED_FILE.size else 0
                out.append(Span(path, 0, os.path.getsize(path), rowid, count))
                rowid += count
                continue
            own, rowid = spans(path, 0, None, rowid, size, self.rows.tag)
            out += own
        if self.rowid is not None:
            out = [s for s in out if s.first <= self.rowid < s.first + s.count]
        if self.offset is not None:
            out = [s for s in out if s.start <= self.offset < s.end]
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partitions
            return iter(())
        return self.rows.span(partition, lambda r, o: (self.rowid is None or r == self.rowid) and (self.offset is None or o == self.offset))


class StreamReader(DataSourceStreamReader):
    """Offsets are ``{path: [byte, records]}``; only whole frames advance them. A file that shrinks is an error."""

    def __init__(self, options: dict[str, str]):
        self.options, self.rows = options, _Rows(options)
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in files(self.options["path"]):
            at, n = self.seen.get(path, [0, 0])
            if os.path.getsize(path) < at:
                raise RuntimeError(f"{path} is shorter than what was read of it")
            for start, size, _ in hop(path, at):
                at, n = start + 4 + size, n + 1
            out[path] = [at, n]
        for path in self.seen:
            if path not in out:
                raise RuntimeError(f"{path} was read and is gone")
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, size = [], int(self.options.get("split_bytes", 64 << 20))
        for path in sorted(end):
            (a, m), (b, n) = start.get(path, [0, 0]), end[path]
            self.seen.setdefault(path, [b, n])
            if os.path.getsize(path) < b:
                raise RuntimeError(f"{path} is shorter than what was read of it")
            if b - a > size:
                out += spans(path, a, b, m + 1, size, self.rows.tag)[0]
            elif b > a:
                out.append(Span(path, a, b, m + 1, n - m))
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return self.rows.span(partition) if partition is not None else iter(())

    def commit(self, end: dict) -> None:
        pass


class _Part(WriterCommitMessage):
    def __init__(self, paths: list[str], records: int):
        self.paths, self.records = paths, records


class Writer(DataSourceArrowWriter):
    """Frames from ``_data`` where the rows have it, else from the declared columns; a new file begins after ``roll_bytes``."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.options, self.columns, self.overwrite = options, schema.names, overwrite
        self.id = uuid.uuid4().hex
        self.old = files(options["path"]) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        path, n, most = local(self.options["path"]), 0, int(self.options.get("roll_bytes", 32 << 20))
        os.makedirs(path, exist_ok=True)
        context = TaskContext.get()
        own = "_data" in self.columns
        rows_of = None if own else _Rows(self.options)
        encoder = None if own else codec.Encoder(rows_of.schema, rows_of.table, rows_of.tag)

        def begun() -> BinaryIO:
            paths.append(os.path.join(path, f".{self.id}-{context.partitionId():06d}-{len(paths):06d}-{context.taskAttemptId()}"))
            return open(paths[-1], "wb", buffering=1 << 20)

        paths: list[str] = []
        f, size = begun(), 0
        try:
            for b in iterator:
                for record in b.column("_data").to_pylist() if own else map(encoder.record, b.to_pylist()):
                    if size >= most:
                        f.close()
                        f, size = begun(), 0
                    size += f.write(codec.frame(record))
                n += b.num_rows
        finally:
            f.close()
        return _Part(paths, n)

    def commit(self, messages: list) -> None:
        for path in (p for m in messages for p in m.paths):
            folder, name = os.path.split(path)
            os.replace(path, os.path.join(folder, "part-" + name[1:].rpartition("-")[0]))
        for path in self.old:
            os.remove(path)
        with open(os.path.join(local(self.options["path"]), "_SUCCESS"), "w") as f:
            json.dump({"records": sum(m.records for m in messages)}, f)

    def abort(self, messages: list) -> None:
        for path in (p for m in messages if m is not None for p in m.paths):
            if os.path.exists(path):
                os.remove(path)


class RillSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rill"

    def schema(self) -> T.StructType:
        return _Rows(self.options).kind()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), schema, overwrite)


def register(spark) -> None:
    """Make ``spark.read.format("rill")`` known, with its code on the executors."""
    from rillstore.cluster import ship_package

    ship_package(spark)
    spark.dataSource.register(RillSource)
