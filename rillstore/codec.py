"""Frames and records as bytes: splitting streams, decoding and encoding tables, the checked layout.

A stream is ``[u32 length][record]`` repeated, little-endian. A record begins with the offset of its root
table and a four-byte type tag; a table points back to a list of slot offsets. The checked layout has
a 64-byte file header and 48-byte record headers with a CRC32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from rillstore.schema import SCALARS, Field, Schema, Table

_U16, _U32, _I32 = struct.Struct("<H"), struct.Struct("<I"), struct.Struct("<i")
_BYTES = ("ubyte", "uint8", "byte", "int8")

# Fixed values of the checked layout: file header (magic, version, data start, records, schema name) and
# record header (sequence, table, milliseconds, length, checksum, 8 spare bytes).
CHECKED_MAGIC, CHECKED_VERSION = 0x464C5451, 1
CHECKED_FILE, CHECKED_RECORD = struct.Struct("<IIQQ40s"), struct.Struct("<Q16sQII8s")


class DecodeError(ValueError):
    """The bytes are no record of the schema."""


def frames(data: bytes | memoryview, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """``(frame start, record start, record end)`` of every whole frame from ``at`` on."""
    n = len(data)
    while at + 4 <= n:
        size = _U32.unpack_from(data, at)[0]
        if at + 4 + size > n:
            return
        yield at, at + 4, at + 4 + size
        at += 4 + size


def consumed(data: bytes) -> int:
    """Bytes of whole frames; what follows is the tail to keep for later."""
    end = 0
    for _, _, end in frames(data):
        pass
    return end


def frame(record: bytes) -> bytes:
    return _U32.pack(len(record)) + record


def type_tag(record: bytes | memoryview) -> str:
    """Bytes 4 to 7 of a record, or the empty string if it is shorter."""
    return bytes(record[4:8]).decode("latin-1") if len(record) >= 8 else ""


# --- decoding ----------------------------------------------------------------------------------


class Decoder:
    """Rows (tuples in declared order) of one table; ``columns`` limits what is read.

    Absent scalars get the declared default or 0, absent strings null (or ``''`` with
    ``empty_string_defaults``), absent vectors, structs and tables null.
    """

    def __init__(self, schema: Schema, table: str, columns: list[str] | None = None, empty_string_defaults: bool = False):
        self.schema, self.empty = schema, empty_string_defaults
        own = schema.tables[table]
        self.fields = [(own, f) for f in own.fields if columns is None or f.name in columns]
        self.slots = self._slots(own)

    def _slots(self, t: Table) -> dict[str, int]:
        """The slot of each field: unions take two, the first for the type."""
        out, at, explicit = {}, 0, any(f.slot != i for i, f in enumerate(t.fields))
        for f in t.fields:
            if f.type in self.schema.unions:
                out[f.name] = f.slot if explicit else at + 1
                at += 2
            else:
                out[f.name] = f.slot if explicit else at
                at += 1
        return out

    def row(self, data: bytes) -> tuple:
        try:
            root = _U32.unpack_from(data, 0)[0]
            return tuple(self._field(data, root, f, self.slots[f.name]) for _, f in self.fields)
        except (struct.error, IndexError, UnicodeDecodeError) as e:
            raise DecodeError(str(e)) from e

    def _place(self, data: bytes, table: int, slot: int) -> int:
        listing = table - _I32.unpack_from(data, table)[0]
        if listing < 0 or table < 0:
            raise DecodeError("an offset leaves the record")
        at = 4 + 2 * slot
        if at + 2 > _U16.unpack_from(data, listing)[0]:
            return 0
        inner = _U16.unpack_from(data, listing + at)[0]
        return table + inner if inner else 0

    def _follow(self, data: bytes, at: int) -> int:
        to = at + _U32.unpack_from(data, at)[0]
        if to >= len(data):
            raise DecodeError("an offset leaves the record")
        return to

    def _field(self, data: bytes, table: int, f: Field, slot: int) -> Any:
        at = self._place(data, table, slot)
        if f.vector:
            return self._vector(data, self._follow(data, at), f.type) if at else None
        if f.type in self.schema.unions:
            return self._union(data, table, slot, f.type) if at else None
        if not at:
            return self._default(f)
        return self._value(data, at, f.type)

    def _default(self, f: Field) -> Any:
        if f.type in SCALARS:
            kind = SCALARS[f.type][1]
            value = f.default if f.default is not None else 0
            return bool(value) if kind == "?" else float(value) if kind in "fd" else Decimal(value) if kind == "Q" else int(value)
        if f.type in self.schema.enums:
            e = self.schema.enums[f.type]
            return f.default if isinstance(f.default, str) else self._name(e.values, int(f.default or 0))
        return (f.default if f.default is not None else "") if f.type == "string" and (self.empty or f.default is not None) else None

    @staticmethod
    def _name(values: dict[str, int], n: int) -> str:
        return next((k for k, v in values.items() if v == n), str(n))

    def _value(self, data: bytes, at: int, kind: str) -> Any:
        if kind in SCALARS:
            value = struct.unpack_from("<" + SCALARS[kind][1], data, at)[0]
            return Decimal(value) if SCALARS[kind][1] == "Q" else value
        if kind in self.schema.enums:
            e = self.schema.enums[kind]
            return self._name(e.values, struct.unpack_from("<" + SCALARS[e.type][1], data, at)[0])
        if kind in self.schema.structs:
            return self._struct(data, at, kind)
        to = self._follow(data, at)
        if kind == "string":
            n = _U32.unpack_from(data, to)[0]
            if to + 4 + n > len(data):
                raise DecodeError("a string leaves the record")
            return bytes(data[to + 4 : to + 4 + n]).decode()
        own = self.schema.tables[kind]
        slots = self._slots(own)
        return tuple(self._field(data, to, g, slots[g.name]) for g in own.fields)

    def _width(self, kind: str) -> int:
        if kind in SCALARS:
            return SCALARS[kind][0]
        if kind in self.schema.enums:
            return SCALARS[self.schema.enums[kind].type][0]
        return struct_layout(self.schema, kind)[0] if kind in self.schema.structs else 4

    def _struct(self, data: bytes, at: int, kind: str) -> tuple:
        return tuple(self._value(data, at + place, g.type) for g, place in zip(self.schema.structs[kind].fields, struct_layout(self.schema, kind)[2], strict=True))

    def _vector(self, data: bytes, to: int, kind: str) -> Any:
        n = _U32.unpack_from(data, to)[0]
        width = self._width(kind)
        if to + 4 + n * width > len(data):
            raise DecodeError("a vector leaves the record")
        if kind in _BYTES:
            return bytes(data[to + 4 : to + 4 + n])
        return [self._value(data, to + 4 + i * width, kind) for i in range(n)]

    def _union(self, data: bytes, table: int, slot: int, kind: str) -> Any:
        place = self._place(data, table, slot - 1)
        tag = data[place] if place else 0
        members = self.schema.unions[kind]
        if not 0 < tag <= len(members):
            return None
        to = self._follow(data, self._place(data, table, slot))
        # The member keeps its place in the record's bytes, as a record of its own root.
        return (members[tag - 1], _U32.pack(to) + b"\0\0\0\0" + bytes(data[8:]) if to >= 8 else None)


def struct_layout(schema: Schema, name: str) -> tuple[int, int, list[int]]:
    """Size, alignment and field places of a struct."""
    at, align, places = 0, 1, []
    for g in schema.structs[name].fields:
        if g.type in schema.structs:
            size, own, _ = struct_layout(schema, g.type)
        else:
            size = own = SCALARS[schema.enums[g.type].type if g.type in schema.enums else g.type][0]
        at = -(-at // own) * own
        places.append(at)
        at, align = at + size, max(align, own)
    return -(-at // align) * align, align, places


# --- encoding ----------------------------------------------------------------------------------


class Encoder:
    """Records of one table from dictionaries; values equal to the default are left out."""

    def __init__(self, schema: Schema, table: str, tag: str = ""):
        self.schema, self.name, self.tag = schema, table, tag
        self.slots = {t: Decoder(schema, t).slots for t in schema.tables}

    def record(self, row: dict[str, Any]) -> bytes:
        out = bytearray(8)
        out[4:8] = self.tag.encode("latin-1").ljust(4, b"\0")[:4]
        _U32.pack_into(out, 0, self._table(out, self.name, row))
        return bytes(out)

    @staticmethod
    def _pad(out: bytearray, to: int) -> None:
        out.extend(b"\0" * (-len(out) % to))

    def _table(self, out: bytearray, name: str, row: dict[str, Any]) -> int:
        t, slots = self.schema.tables[name], self.slots[name]
        inline: list[tuple[int, bytes, int, tuple | None]] = []  # slot, bytes, alignment, what the bytes point to
        for f in t.fields:
            v = row.get(f.name)
            if v is None:
                continue
            slot = slots[f.name]
            if f.type in self.schema.unions:
                member, value = v
                inline.append((slot - 1, bytes([self.schema.unions[f.type].index(member) + 1]), 1, None))
                inline.append((slot, bytes(4), 4, ("table", member, value)))
            elif f.vector:
                inline.append((slot, bytes(4), 4, ("vector", f.type, v)))
            elif f.type in SCALARS or f.type in self.schema.enums or f.type in self.schema.structs:
                b, align = self._fixed(f.type, v)
                inline.append((slot, b, align, None))
            else:
                inline.append((slot, bytes(4), 4, ("string" if f.type == "string" else "table", f.type, v)))
        inline.sort(key=lambda x: -x[2])
        count = max((x[0] for x in inline), default=-1) + 1
        self._pad(out, 8)
        listing = len(out)
        out.extend(bytes(4 + 2 * count))
        self._pad(out, 8)
        start = len(out)
        out.extend(_I32.pack(start - listing))
        later = []
        for slot, b, align, child in inline:
            self._pad(out, align)
            _U16.pack_into(out, listing + 4 + 2 * slot, len(out) - start)
            if child:
                later.append((len(out), child))
            out.extend(b)
        _U16.pack_into(out, listing, 4 + 2 * count)
        _U16.pack_into(out, listing + 2, len(out) - start)
        for at, child in later:
            _U32.pack_into(out, at, self._child(out, *child) - at)
        return start

    def _fixed(self, kind: str, v: Any) -> tuple[bytes, int]:
        if kind in self.schema.structs:
            size, align, places = struct_layout(self.schema, kind)
            b = bytearray(size)
            own = self.schema.structs[kind].fields
            for i, (g, at) in enumerate(zip(own, places, strict=True)):
                part, _ = self._fixed(g.type, v[g.name] if isinstance(v, dict) else v[i])
                b[at : at + len(part)] = part
            return bytes(b), align
        if kind in self.schema.enums:
            e = self.schema.enums[kind]
            kind, v = e.type, e.values[v] if isinstance(v, str) else v
        size, code, _ = SCALARS[kind]
        return struct.pack("<" + code, bool(v) if code == "?" else float(v) if code in "fd" else int(v)), size

    def _child(self, out: bytearray, what: str, kind: str, v: Any) -> int:
        if what == "table":
            return self._table(out, kind, v)
        self._pad(out, 8)
        if what == "string" or kind in _BYTES:
            b = v.encode() if isinstance(v, str) else bytes(v)
            at = len(out)
            out.extend(_U32.pack(len(b)) + b + b"\0")
            return at
        if kind in SCALARS or kind in self.schema.enums or kind in self.schema.structs:
            parts = [self._fixed(kind, x)[0] for x in v]
            out.extend(bytes(4))  # so that the items, after the count, are aligned to 8
            at = len(out)
            out.extend(_U32.pack(len(v)) + b"".join(parts))
            return at
        at = len(out)
        out.extend(_U32.pack(len(v)) + bytes(4 * len(v)))
        for i, x in enumerate(v):
            place = at + 4 + 4 * i
            _U32.pack_into(out, place, self._child(out, "string" if kind == "string" else "table", kind, x) - place)
        return at


# --- the checked layout ------------------------------------------------------------------------


def write_checked(records: list[tuple[str, bytes]], schema_name: str = "", millis: int = 0) -> bytes:
    """A file of the checked layout from ``(table, record)``; table names hold 15 bytes at most."""
    out = bytearray(CHECKED_FILE.pack(CHECKED_MAGIC, CHECKED_VERSION, CHECKED_FILE.size, len(records), schema_name.encode()[:39]))
    for i, (table, data) in enumerate(records):
        if len(table.encode()) > 15:
            raise ValueError(f"table name {table!r} is longer than 15 bytes")
        out += CHECKED_RECORD.pack(i, table.encode(), millis, len(data), zlib.crc32(data), bytes(8)) + data
    return bytes(out)


def read_checked(data: bytes) -> Iterator[tuple[int, int, str, int, bytes]]:
    """``(sequence, offset, table, milliseconds, record)``; records whose checksum fails are passed over by
    their length, and a length that leaves the file ends it."""
    if len(data) < CHECKED_FILE.size:
        return
    magic, version, at, _, _ = CHECKED_FILE.unpack_from(data, 0)
    if magic != CHECKED_MAGIC or version != CHECKED_VERSION:
        raise DecodeError("this is no file of the checked layout")
    while at + CHECKED_RECORD.size <= len(data):
        sequence, table, millis, size, crc, _ = CHECKED_RECORD.unpack_from(data, at)
        body = data[at + CHECKED_RECORD.size : at + CHECKED_RECORD.size + size]
        if len(body) < size:
            return
        if zlib.crc32(body) == crc:
            yield sequence, at, table.rstrip(b"\0").decode(), millis, body
        at += CHECKED_RECORD.size + size
