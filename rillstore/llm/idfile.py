"""Token ids on disk as bit or byte planes.

Layout of a data set: ``<path>/frames`` holds rows ``(part, frame, before, n_ids, n_docs, doc_ids,
known, lengths, chunk_index, payload)``. A frame holds whole documents (compressed, it is smaller than the
longest text, which Spark holds in one value anyhow). Its ids, unsigned 32-bit, are cut
into blocks of ``block`` ids; each block is transposed into 4 byte planes (or 32 bit planes) and
every plane is compressed on its own with zstandard. ``chunk_index`` holds, for every block, the
number of ids and the compressed size of each plane, so that any block can be read alone.
``doc_ids`` and ``lengths`` are zstandard-compressed little-endian 64-bit integers, ``known`` the
compressed bits of which documents have an id. ``part`` counts
ranges of ascending ``doc_id``; ``before`` is the number of ids of the part in earlier frames.
The rows are written and read by Spark, so they go wherever the cluster's file systems are.

Defined results: a null text has no ids but the end id; rows without a ``doc_id`` come first and are read back
without one; an empty table gives an empty data set; repeated rows are stored each (ordered by ``doc_id``,
then text); a text of any length lies in one frame; extra columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstore.cluster import ship_package
from rillstore.llm import words as W

FRAMES = "part int, frame int, before long, n_ids long, n_docs long, doc_ids binary, known binary, lengths binary, chunk_index binary, payload binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Ids of a block, and ids after which a frame is closed.
BLOCK, FRAME = 1 << 16, 1 << 19


def to_planes(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = 1) -> tuple[bytes, bytes]:
    """The chunk index and the payload of some ids."""
    import zstandard

    press, n_planes = zstandard.ZstdCompressor(level=level), 32 if bits else 4
    index, payload = [np.array([n_planes, block], "<u4")], []
    for i in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[i : i + block], "<u4")
        planes = part.view(np.uint8).reshape(-1, 4).T
        if bits:
            planes = [np.packbits((part >> np.uint32(k)) & np.uint32(1)) for k in range(32)]
        done = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        index.append(np.array([len(part), *map(len, done)], "<u4"))
        payload += done
    return np.concatenate(index).tobytes(), b"".join(payload)


def from_planes(index: bytes, payload: bytes) -> np.ndarray:
    """The ids again."""
    import zstandard

    open_, index = zstandard.ZstdDecompressor(), np.frombuffer(index, "<u4")
    n_planes, out, at = int(index[0]), [], 0
    for row in index[2:].reshape(-1, n_planes + 1):
        n, planes = int(row[0]), []
        for size in row[1:].tolist():
            planes.append(np.frombuffer(open_.decompress(payload[at : at + size]), np.uint8))
            at += size
        if n_planes == 4:
            out.append(np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel())
        else:
            ids = np.zeros(n, np.uint32)
            for k, p in enumerate(planes):
                ids |= np.unpackbits(p, count=n).astype(np.uint32) << np.uint32(k)
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _pack(x: list[np.ndarray] | np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate(x) if isinstance(x, list) else x, "<i8").tobytes())


def _unpack(x: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")


def _writer(path: str, end_id: int, block: int, frame: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        from rillstore.llm.pieces import pieces
        from rillstore.llm.words import slices

        own, part = pieces(path), TaskContext.get().partitionId()
        held: list[tuple] = []
        number = before = size = 0

        def close() -> pa.RecordBatch:
            docs, known, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            index, payload = to_planes(ids, block, bits)
            row = (part, number, before, len(ids), len(docs), _pack(docs), zstandard.ZstdCompressor(level=1).compress(np.packbits(known).tobytes()), _pack(counts), index, payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
            names = [x.split()[0] for x in FRAMES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in slices(batches, block=3 << 20):
            ids, counts = own.encode(b.column("text"))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            docs = b.column("doc_id")
            held.append((np.asarray(docs.fill_null(0)), np.asarray(docs.is_valid()), counts + 1, ids))
            size += len(ids)
            if size >= frame:
                yield close()
                before, number, size = before + size, number + 1, 0
                held.clear()
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK, frame: int = FRAME, bits: bool = False) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending ``doc_id`` order."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(W.tidy(_writer(tokenizer, end_id, block, frame, bits)), FRAMES).write.parquet(f"{path}/frames")


def _reader(offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in batches:
            for r in range(b.num_rows):
                row = {k: b.column(k)[r].as_py() for k in b.schema.names}
                docs, counts = _unpack(row["doc_ids"]), _unpack(row["lengths"])
                known = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["known"]), np.uint8), count=len(docs)).astype(bool)
                ids = memoryview(from_planes(row["chunk_index"], row["payload"])).cast("B")
                end = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), counts.tolist(), strict=True)]
                start = offsets[row["part"]] + row["before"] + end - counts
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=~known), *[pa.array(x, pa.int64()) for x in (start, counts, crc)]], names)

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: first id's place in the whole, number and checksum of ids.

    Every part's total (one number a partition) goes to the driver; the frames are read where they are.
    """
    ship_package(spark)
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    totals = sorted(map(tuple, frames.groupBy("part").agg(F.sum("n_ids")).collect()))
    offsets, at = {}, 0
    for part, n in totals:
        offsets[part], at = at, at + n
    return frames.select("part", "before", "doc_ids", "known", "lengths", "chunk_index", "payload").mapInArrow(W.tidy(_reader(offsets)), RESULT)
