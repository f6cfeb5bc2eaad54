"""A database of record tables: ingest, routing by type tag, sources, views, lookups, deletes, statistics.

The store is one DataFrame of records ``(_rowid, _offset, _tag, _source, _data)``; a table is the part of it
with the table's tag, decoded. Registration order does not matter: everything is worked out when a
table is asked for. Deletes are a frame of row ids that scans leave out; ``compact`` makes them real.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstore import codec
from rillstore.cluster import cut, ship_package
from rillstore.schema import Schema, parse

RECORDS = "_source string, _rowid long, _offset long, _tag string, _data binary"


#: Records and bytes that Python holds at once while it splits files, about.
HELD, HELD_BYTES = 8192, 4 << 20


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole(path: str, at: int, part: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cols = [pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array([s for s, _ in part], pa.int64()), pa.array([codec.type_tag(r) for _, r in part]), pa.array([r for _, r in part], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["path", "at", "_offset", "_tag", "_data"])

    for b in batches:
        for i in range(b.num_rows):
            path, data = b.column("path")[i].as_py(), b.column("content")[i].as_buffer()
            view = memoryview(data) if data is not None else b""
            at, part, size = 0, [], 0
            for s, start, end in codec.frames(view):
                part.append((s, bytes(view[start:end])))
                size += end - start
                if len(part) >= HELD or size >= HELD_BYTES:
                    yield whole(path, at, part)
                    at, part, size = at + len(part), [], 0
            if part:
                yield whole(path, at, part)
        b = data = view = None  # not held while the next files come


def read_frames(spark: SparkSession, path: str, source: str | None = None, first: int = 1) -> DataFrame:
    """The records of framed files on any file system Spark knows (files under 2 GB; larger ones through
    the ``rill`` source). Row ids count on from ``first`` in order of path and offset; one number a file
    goes to the driver. A half-written frame at a file's end is left out."""
    ship_package(spark)
    parts = cut(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, "path string, at long, _offset long, _tag string, _data binary"))
    counts = sorted(map(tuple, parts.groupBy("path").count().collect()))
    base, rows = first, []
    for name, n in counts:
        rows.append((name, base))
        base += n
    bases = spark.createDataFrame(rows, "path string, base long")
    return parts.join(F.broadcast(bases) if len(rows) < 100_000 else bases, "path").select(F.lit(source).cast("string").alias("_source"), (F.col("base") + F.col("at")).alias("_rowid"), "_offset", "_tag", "_data")


MODES = ("DROPMALFORMED", "PERMISSIVE", "FAILFAST")


def decode(records: DataFrame, schema: Schema, table: str, columns: Sequence[str] | None = None, empty_string_defaults: bool = False, mode: str = "DROPMALFORMED") -> DataFrame:
    """Declared columns (or some of them) and the virtual ones. Records that cannot be decoded are left out,
    kept with nulls and a true ``_corrupt`` (``PERMISSIVE`` adds this column), or an error (``FAILFAST``).

    Tables of scalars, enums and strings are read by column; others record by record."""
    ship_package(records.sparkSession)
    kind, run = decoding(schema, table, columns, empty_string_defaults, mode)
    return records.select("_source", "_rowid", "_offset", "_data").mapInArrow(run, kind)


def decoding(schema: Schema, table: str, columns: Sequence[str] | None = None, empty_string_defaults: bool = False, mode: str = "DROPMALFORMED") -> tuple[T.StructType, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """What :func:`decode` does to batches of ``_source, _rowid, _offset, _data``, and the type of its rows."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    own = schema.struct_type(table)
    fields = [f for f in own.fields if columns is None or f.name in columns]
    kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], *[T.StructField(n, t) for n, t in (("_source", T.StringType()), ("_rowid", T.LongType()), ("_offset", T.LongType()), ("_data", T.BinaryType()))]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names = to_arrow_schema(kind), [f.name for f in fields]
    if mode == "PERMISSIVE":
        kind = T.StructType([*kind.fields, T.StructField("_corrupt", T.BooleanType())])
    kinds = [arrow.field(i).type for i in range(len(names))]

    def by_row(decoder: codec.Decoder, data: list[bytes]) -> tuple[list[pa.Array], list[bool]]:
        rows, blank = [], (None,) * len(names)
        for d in data:
            try:
                rows.append((True, decoder.row(d) if d is not None else blank))
            except codec.DecodeError:
                rows.append((False, blank))
        return [pa.array([_plain(r[j], f.dataType) for _, r in rows], kinds[j]) for j, f in enumerate(fields)], [ok for ok, _ in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from rillstore import columnar

        decoder = codec.Decoder(schema, table, names, empty_string_defaults)
        flat = columnar.is_flat(decoder)
        for b in batches:
            data = b.column("_data")
            try:
                cols, ok = columnar.decode(data, decoder, kinds) if flat else (None, np.zeros(b.num_rows, bool))
            except pa.ArrowInvalid:  # bytes that are no text: the row decoder tells where
                cols, ok = None, np.zeros(b.num_rows, bool)
            if not ok.all():
                odd = np.flatnonzero(~ok)
                more, fine = by_row(decoder, data.take(pa.array(odd)).to_pylist())
                if cols is None:
                    cols = more
                else:
                    which = np.arange(b.num_rows)
                    which[odd] = b.num_rows + np.arange(len(odd))
                    cols = [pa.concat_arrays([x, y]).take(pa.array(which)) for x, y in zip(cols, more, strict=True)]
                ok = ok.copy()
                ok[odd] = fine
                if mode == "FAILFAST" and not ok.all():
                    raise codec.DecodeError(f"record {b.column('_rowid')[int(np.flatnonzero(~ok)[0])].as_py()} is no {table}")
            cols = [*cols, *[b.column(n).cast(arrow.field(n).type) for n in ("_source", "_rowid", "_offset", "_data")]]
            if mode == "PERMISSIVE":
                yield pa.RecordBatch.from_arrays([*cols, pa.array(~ok)], [*arrow.names, "_corrupt"])
            else:
                whole = pa.RecordBatch.from_arrays(cols, schema=arrow)
                yield whole if ok.all() else whole.filter(pa.array(ok))

    return kind, run


def encode(df: DataFrame, schema: Schema, table: str, tag: str, rowid: str | None = None) -> DataFrame:
    """``_rowid, _tag, _data`` of every row, in parallel; columns are matched by name, ``rowid`` gives the row ids."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.Encoder(schema, table, tag)
        for b in batches:
            rows = [encoder.record(r) for r in b.to_pylist()]
            ids = b.column(rowid).cast(pa.int64()) if rowid else pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([tag] * len(rows), pa.string()), pa.array(rows, pa.binary())], ["_rowid", "_tag", "_data"])

    return df.mapInArrow(run, "_rowid long, _tag string, _data binary")


def _plain(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(x, f.dataType) for f, x in zip(kind.fields, v, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in v]
    return v


class Database:
    """Tables of one schema over one store."""

    def __init__(self, spark: SparkSession, schema: str | Schema, name: str = "db"):
        self.spark, self.name = spark, name
        self.schema = parse(schema) if isinstance(schema, str) else schema
        self.tags: dict[str, str] = {}  # table -> type tag
        self.decoders: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.parts: list[DataFrame] = []
        self.landed: list[DataFrame] = []  # those of the parts that are files
        self.uniform: list[tuple[DataFrame, str]] = []  # those of the parts that hold one type tag, and the tag
        self.external: dict[str, DataFrame] = {}
        self.sources: list[str] = []
        self.gone: dict[str, DataFrame] = {}
        self.key: bytes | None = None
        self.next_row = 1
        self.last_error: str | None = None
        self.max_sql = 1_000_000  # characters of a query
        self._ready = False

    # --- registration -------------------------------------------------------------------------
    def register_tag(self, tag: str, table: str) -> None:
        if table not in self.schema.tables:
            raise KeyError(f"no table {table!r}")
        self.tags[table] = tag

    def set_decoder(self, table: str, decoder: Callable[[DataFrame], DataFrame]) -> None:
        """Decode the table's records (``RECORDS`` columns) by a function of frames instead of the schema."""
        self.decoders[table] = decoder

    def register_source(self, name: str) -> None:
        if name in self.sources:
            raise ValueError(f"source {name!r} is registered")
        self.sources.append(name)

    def register_external(self, table: str, df: DataFrame) -> None:
        """A table that is not decoded from records."""
        self.external[table] = df

    # --- ingest, export -----------------------------------------------------------------------
    def ingest(self, data: bytes, source: str | None = None) -> int:
        """Take the whole frames of some bytes; returns how many bytes they are. The tail is the caller's."""
        rows, end = [], 0
        for at, a, b in codec.frames(data):
            rows.append((source, self.next_row + len(rows), at, codec.type_tag(data[a:b]), bytes(data[a:b])))
            end = b
        if rows:
            self.parts.append(self.spark.createDataFrame(rows, RECORDS))
            self.next_row += len(rows)
        return end

    def insert(self, table: str, rows: DataFrame, source: str | None = None) -> int:
        """Encode the rows of a frame as records of a table; returns their number. Row ids follow the frame's order by partition."""
        names = {f.name for f in self.schema.tables[table].fields}
        own = encode(rows.select(*[c for c in rows.columns if c in names]), self.schema, table, self.tags[table])
        own = cut(own.select("_tag", "_data", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
        bases, n = [], 0  # one number a partition
        for part, rows_in in sorted(map(tuple, own.groupBy("part").count().collect())):
            bases.append((part, self.next_row + n))
            n += rows_in
        base = self.spark.createDataFrame(bases, "part int, base long")
        self.parts.append(own.join(F.broadcast(base), "part").select(F.lit(source).cast("string").alias("_source"), (F.col("base") + F.col("at")).alias("_rowid"), F.lit(0).cast("long").alias("_offset"), "_tag", "_data"))
        self.next_row += n
        return n

    def insert_json(self, table: str, rows: DataFrame, column: str = "value", source: str | None = None) -> int:
        """Take JSON texts as records of a table."""
        return self.insert(table, rows.select(F.from_json(F.col(column), self.schema.struct_type(table)).alias("r")).select("r.*"), source)

    def to_json(self, table: str) -> DataFrame:
        """``_rowid, value``: the table's rows as JSON texts."""
        return self.table(table).select("_rowid", F.to_json(F.struct(*[f.name for f in self.schema.tables[table].fields])).alias("value"))

    def ingest_one(self, record: bytes, source: str | None = None) -> int:
        """Take one bare record; returns its row id."""
        self.ingest(codec.frame(record), source)
        return self.next_row - 1

    def ingest_path(self, path: str, source: str | None = None) -> int:
        """Take framed files from any file system; returns the number of records."""
        part = read_frames(self.spark, path, source, self.next_row)
        n = part.count()
        self.parts.append(part)
        self.landed.append(part)
        self.next_row += n
        return n

    def add(self, part: DataFrame, tag: str) -> None:
        """Take a frame of records (``RECORDS`` columns) of one type tag, so that other tables do not read it."""
        self.parts.append(part)
        self.uniform.append((part, tag))

    def records(self, tag: str | None = None) -> DataFrame:
        """All records; with a tag, without the parts that are known to hold another."""
        parts = [p for p in self.parts if tag is None or not any(p is x and t != tag for x, t in self.uniform)]
        if not parts:
            return self.spark.createDataFrame([], RECORDS)
        return reduce(DataFrame.unionByName, parts)

    def export(self, path: str) -> None:
        """All records, deleted or not, as framed files in row order."""
        from rillstore.sources.framed import register

        register(self.spark)
        own = self.records().select("_rowid", "_data")
        if not all(any(p is x for x in self.landed) for p in self.parts):
            own = cut(own)  # the sort reads its input twice, and records should be encoded once
        own.orderBy("_rowid").select("_data").write.format("rill").mode("append").option("path", path).option("schema", "table t { }").save()

    # --- tables -------------------------------------------------------------------------------
    def table(self, name: str, columns: Sequence[str] | None = None, deleted: bool = False) -> DataFrame:
        """A table, ``Table@source`` or external table; ``columns`` limits what is decoded."""
        if name in self.external:
            return self.external[name]
        return self._decoded(*self._own(name, deleted), columns)

    def _own(self, name: str, deleted: bool = False) -> tuple[DataFrame, str]:
        """The undecoded records of a table or ``Table@source``, and the table."""
        base, _, source = name.partition("@")
        if source and source not in self.sources:
            raise KeyError(f"no source {source!r}")
        if base not in self.schema.tables:
            raise KeyError(f"no table {base!r}")
        own = self.records(self.tags[base]).filter(F.col("_tag") == self.tags[base]) if base in self.tags else self.records().filter(F.lit(False))
        if source:
            own = own.filter(F.col("_source") == source)
        own = own.withColumn("_source", F.coalesce("_source", F.lit(base)))
        if not deleted and base in self.gone:
            own = own.join(self.gone[base], "_rowid", "left_anti")
        return own, base

    def _decoded(self, own: DataFrame, base: str, columns: Sequence[str] | None = None) -> DataFrame:
        return self._decrypted(self.decoders[base](own) if base in self.decoders else decode(own, self.schema, base, columns), base)

    def corrupt(self, name: str) -> DataFrame:
        """The records of a table's tag that cannot be decoded: ``_source, _rowid, _offset, _data``."""
        own = self.records().filter(F.col("_tag") == self.tags[name])
        return decode(own, self.schema, name, mode="PERMISSIVE").filter("_corrupt").select("_source", "_rowid", "_offset", "_data")

    def _decrypted(self, df: DataFrame, table: str) -> DataFrame:
        secret = [f.name for f in self.schema.tables[table].fields if f.encrypted and f.name in df.columns]
        if not secret or self.key is None:
            return df
        from rillstore.functions.security import decrypt_field

        return df.withColumns({c: decrypt_field(F.col(c), self.key, f"{table}.{c}") for c in secret})

    def set_encryption_key(self, key: bytes) -> None:
        if len(key) != 32:
            raise ValueError("keys hold 32 bytes")
        self.key = key

    def unified(self, table: str, sources: Sequence[str] | None = None) -> DataFrame:
        """One table over some or all sources; ``_source`` filters prune whole sources."""
        names = list(self.sources if sources is None else sources)
        if not names:
            raise ValueError("at least one source is needed")
        if lost := [n for n in names if n not in self.sources]:
            raise KeyError(f"no source {lost[0]!r}")
        own = self.table(table)  # one pass over the store, whatever the number of sources
        return own.filter(F.col("_source").isin(names))

    def register_views(self) -> list[str]:
        """Temp views of every table, every ``Table@source`` and external table, and, with sources, unified views."""
        names = []
        for t in self.schema.tables:
            (self.unified(t) if self.sources else self.table(t)).createOrReplaceTempView(f"`{t}`")
            names.append(t)
            for s in self.sources:
                self.table(f"{t}@{s}").createOrReplaceTempView(f"`{t}@{s}`")
                names.append(f"{t}@{s}")
        for t, df in self.external.items():
            df.createOrReplaceTempView(f"`{t}`")
            names.append(t)
        return names

    def query(self, sql: str, args: Sequence[Any] | dict[str, Any] | None = None) -> DataFrame:
        """A read-only query over the views, in the dialect of :mod:`rillstore.plans.dialect`; ``?`` or
        ``:name`` parameters must all be given. Double quotes are names, so ``FROM "T@source"`` works."""
        from rillstore.functions.sql import register
        from rillstore.plans import dialect

        if len(sql) > self.max_sql:
            raise ValueError(f"queries hold {self.max_sql} characters at most")
        if not self._ready:
            register(self.spark)
            self._ready = True
        self.register_views()
        try:
            text = dialect.translate(sql)
            return self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)
        except Exception as e:
            self.last_error = str(e).splitlines()[0]
            raise

    def register_aggregate(self, name: str, f: Callable, kind: str) -> None:
        """An aggregate function for queries: ``f`` gets a group's values of each argument as pandas series."""
        from pyspark.sql.functions import PandasUDFType

        self.spark.udf.register(name, F.pandas_udf(f, kind, PandasUDFType.GROUPED_AGG))

    def query_count(self, sql: str, args: Sequence[Any] | None = None) -> int:
        return self.query(sql, args).count()

    # --- lookups ------------------------------------------------------------------------------
    def _hits(self, table: str, column: str, condition: Column) -> DataFrame:
        """Rows by a condition on one column: only this column is decoded of all records, the rest of the hits."""
        if table in self.external or table in self.decoders:
            return self.table(table).filter(condition)
        base = table.partition("@")[0]
        return self._decoded(self.table(table, [column]).filter(condition).select("_source", "_rowid", "_offset", "_data"), base)

    def find_by_index(self, table: str, column: str, value: Any) -> DataFrame:
        """All rows with the value."""
        return self._hits(table, column, F.col(column).eqNullSafe(F.lit(value)))

    def find_by_range(self, table: str, column: str, low: Any, high: Any) -> DataFrame:
        """Rows between the bounds, both included, in order."""
        return self._hits(table, column, F.col(column).between(low, high)).orderBy(column, "_rowid")

    def land(self, table: str, path: str, column: str) -> DataFrame:
        """Write a table as Parquet sorted by a column: an index, since files and row groups out of a query's range are not read."""
        self.table(table).repartitionByRange(column).sortWithinPartitions(column, "_rowid").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def first(self, table: str):
        return self.nth(table, 0)

    def nth(self, table: str, n: int):
        """The table's row number ``n`` in row order, from 0, or None; only the hit is decoded."""
        own, base = self._own(table)
        return self._decoded(own.orderBy("_rowid").offset(n).limit(1), base).first()

    def next_after(self, table: str, rowid: int):
        """The row that follows a row id, or None."""
        own, base = self._own(table)
        return self._decoded(own.filter(F.col("_rowid") > rowid).orderBy("_rowid").limit(1), base).first()

    def find_one(self, table: str, column: str, value: Any):
        return self.find_by_index(table, column, value).orderBy("_rowid").limit(1).first()

    def find_raw(self, table: str, column: str, value: Any) -> bytes | None:
        r = self.find_one(table, column, value)
        return bytes(r["_data"]) if r else None

    def by_rowid(self, table: str, rowid: int) -> DataFrame:
        return self._rows(table, F.col("_rowid") == rowid)

    def by_offset(self, table: str, offset: int) -> DataFrame:
        return self._rows(table, F.col("_offset") == offset)

    def _rows(self, table: str, condition: Column) -> DataFrame:
        """Rows by a condition on the virtual columns, decoded after it."""
        if table in self.external:
            return self.table(table).filter(condition)
        own, base = self._own(table)
        return self._decoded(own.filter(condition), base)

    def iterate(self, table: str) -> Iterator[bytes]:
        """The raw records in row order, a partition at a time."""
        return (bytes(r["_data"]) for r in self.table(table).select("_rowid", "_data").orderBy("_rowid").toLocalIterator())

    def index_order(self, table: str, column: str) -> DataFrame:
        return self.table(table).orderBy(F.col(column).asc_nulls_first(), "_rowid")

    # --- deletes ------------------------------------------------------------------------------
    def mark_deleted(self, table: str, rowids: DataFrame | Sequence[int]) -> None:
        new = rowids.select(F.col(rowids.columns[0]).cast("long").alias("_rowid")) if isinstance(rowids, DataFrame) else self.spark.createDataFrame([(r,) for r in rowids], "_rowid long")
        old = self.gone.get(table)
        self.gone[table] = cut((old.unionByName(new) if old is not None else new).distinct())

    def deleted_count(self, table: str) -> int:
        return self.gone[table].count() if table in self.gone else 0

    def clear_deleted(self, table: str) -> None:
        """Bring marked rows back."""
        self.gone.pop(table, None)

    def compact(self) -> None:
        """Drop marked rows from the store for good."""
        own = self.records()
        for t, ids in self.gone.items():
            own = own.join(ids.withColumn("_tag", F.lit(self.tags[t])), ["_rowid", "_tag"], "left_anti")
        self.parts, self.gone = [cut(own.select("_source", "_rowid", "_offset", "_tag", "_data"))], {}
        self.landed = list(self.parts)

    # --- catalog ------------------------------------------------------------------------------
    def list_tables(self) -> list[str]:
        return [*self.schema.tables, *self.external]

    def definitions(self) -> DataFrame:
        """``table, position, column, type, is_key, indexed`` of every declared column."""
        rows = [(t, i, f.name, kind.dataType.simpleString(), f.name in own.keys, f.name in own.indexes) for t, own in self.schema.tables.items() for i, (f, kind) in enumerate(zip(own.fields, self.schema.struct_type(t).fields, strict=True))]
        return self.spark.createDataFrame(rows, "table string, position int, column string, type string, is_key boolean, indexed boolean")

    def list_sources(self) -> list[str]:
        return list(self.sources)

    def stats(self) -> DataFrame:
        """``table, tag, records, bytes`` from one pass over the store; unrouted tags have no table."""
        names = self.spark.createDataFrame([(t, g) for t, g in self.tags.items()], "table string, _tag string")
        own = self.records().groupBy("_tag").agg(F.count("*").alias("records"), F.sum(F.length("_data") + 4).alias("bytes"))
        return own.join(F.broadcast(names), "_tag", "full").select("table", F.col("_tag").alias("tag"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def like(column: Column, pattern: str) -> Column:
    """``LIKE`` without regard to case, and without an escape character unless one is named."""
    return column.ilike(pattern.replace("\\", "\\\\"))
