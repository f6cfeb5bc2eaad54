"""Decoding whole columns of records at once: slots, scalars and strings by numpy over the Arrow buffer.

For tables of scalars, enums and strings. Rows whose offsets leave the record are marked; the row decoder
(``codec.Decoder``) has the last word on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rillstore.codec import Decoder
from rillstore.schema import SCALARS

_KINDS = {"?": "u1", "b": "i1", "B": "u1", "h": "<i2", "H": "<u2", "i": "<i4", "I": "<u4", "l": "<i8", "q": "<i8", "f": "<f4", "d": "<f8"}


def is_flat(decoder: Decoder) -> bool:
    """Whether the decoder's fields can be read by column."""
    return all(not f.vector and (f.type == "string" or f.type in decoder.schema.enums or (f.type in SCALARS and SCALARS[f.type][1] in _KINDS)) for _, f in decoder.fields)


class _Records:
    def __init__(self, data: pa.Array):
        _, offsets, buffer = data.buffers()
        wide = pa.types.is_large_binary(data.type)
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        self.bytes = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.start, self.end = at[:-1], at[1:]
        self.ok = np.asarray(data.is_valid()).copy()

    def numbers(self, at: np.ndarray, kind: str, rows: np.ndarray) -> np.ndarray:
        """The number at each place of some rows; rows where it leaves the record are marked and get 0."""
        size = np.dtype(kind).itemsize
        inside = (at >= self.start[rows]) & (at + size <= self.end[rows])
        self.ok[rows[~inside]] = False
        if not len(self.bytes):
            return np.zeros(len(at), kind)
        own = self.bytes[np.where(inside, at, 0)[:, None] + np.arange(size)] if len(self.bytes) >= size else np.zeros((len(at), size), np.uint8)
        return np.where(inside, np.ascontiguousarray(own).view(kind).ravel(), np.zeros((), kind))


def decode(data: pa.Array, decoder: Decoder, kinds: list[pa.DataType]) -> tuple[list[pa.Array], np.ndarray]:
    """The decoder's fields of every record, and which records could be read."""
    r, n = _Records(data), len(data)
    every = np.arange(n)
    table = r.start + r.numbers(r.start, "<u4", every)
    listing = table - r.numbers(table, "<i4", every)
    size = r.numbers(listing, "<u2", every).astype(np.int64)
    out = []
    for (_, f), kind in zip(decoder.fields, kinds, strict=True):
        slot = 4 + 2 * decoder.slots[f.name]
        rows = np.flatnonzero(r.ok & (slot + 2 <= size))
        inner = r.numbers(listing[rows] + slot, "<u2", rows).astype(np.int64)
        rows, place = rows[inner > 0], (table[rows] + inner)[inner > 0]
        default = decoder._default(f)
        if f.type == "string":
            to = place + r.numbers(place, "<u4", rows)
            length = r.numbers(to, "<u4", rows).astype(np.int64)
            inside = r.ok[rows] & (to + 4 + length <= r.end[rows])
            r.ok[rows[~inside]] = False
            rows, to, length = rows[inside], to[inside], length[inside]
            ends = np.cumsum(length)
            own = r.bytes[np.repeat(to + 4 - (ends - length), length) + np.arange(int(length.sum()))] if len(rows) else np.zeros(0, np.uint8)
            texts = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(own.tobytes()))
            texts.validate(full=True)  # raises on bytes that are no text
            which = np.full(n, len(rows), np.int64)
            which[rows] = np.arange(len(rows))
            out.append(pa.concat_arrays([texts, pa.array([default], pa.string())]).take(pa.array(which)).cast(kind))
            continue
        code = SCALARS[decoder.schema.enums[f.type].type if f.type in decoder.schema.enums else f.type][1]
        got = r.numbers(place, _KINDS[code], rows)
        if f.type in decoder.schema.enums:
            values, back = np.unique(got, return_inverse=True)
            names = [*(decoder._name(decoder.schema.enums[f.type].values, int(v)) for v in values), default]
            which = np.full(n, len(values), np.int64)
            which[rows] = back
            out.append(pa.array(names, pa.string()).take(pa.array(which)).cast(kind))
            continue
        whole = np.full(n, default, _KINDS[code])
        whole[rows] = got
        out.append(pa.array(whole != 0 if code == "?" else whole).cast(kind))
    return out, r.ok
