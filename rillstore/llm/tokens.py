"""Token counts: count each distinct pre-token once, join the counts to the documents' frequencies, sum.

Texts are cut into the tokenizer's own pre-tokens, block of documents by block. A block keeps, as
compressed numbers, how often each document has each of its pre-tokens, and hands its distinct pre-tokens out
in ``buckets`` by hash. Every bucket is met by one task, which has each distinct pre-token counted by the
library's model once; the counts go back to the blocks that have it and are summed there. What is
shuffled follows the distinct pre-tokens of blocks, not the tokens; no ids of a document exist, and no task
holds more than a block or the distinct pre-tokens of a bucket.

Defined results: a null text counts as the empty text and has no tokens; special strings inside a
text count as the library counts them by default; repeated rows are counted each on their own, rows without a
``doc_id`` too; an empty table gives no rows; a text of any length is one document of one block; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut, ship_package
from rillstore.llm import words as W

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of text of a block.
BLOCK = 6 << 20
_HELD = "block long, bucket int, doc_ids array<long>, n_bytes array<long>, added array<long>, sizes array<int>, codes binary, numbers binary, names binary"


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(x: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def _row(kind: str, **values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[t]) for n, t in (x.split() for x in kind.split(", "))], _names(kind))


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        from rillstore.llm.pieces import pieces

        own, press, block = pieces(path), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for b in W.slices(batches, block=BLOCK):
            texts = b.column("text")
            doc, code, number, names, added = own.frequencies(texts)
            total = np.bincount(code, number, minlength=len(names))
            by = np.argsort(-total, kind="stable")[: np.count_nonzero(total)]  # frequent ones get small codes
            rank = np.zeros(len(names), np.int64)
            rank[by] = np.arange(len(by))
            names, code = names.take(pa.array(by)), rank[code]
            order = np.lexsort((code, doc))
            doc, code, number = doc[order], code[order], number[order]
            gap = np.diff(code, prepend=0)  # in a document, from code to code; its first stands as it is
            first = np.diff(doc, prepend=-1) > 0
            gap[first] = code[first]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield _row(_HELD, block=block, doc_ids=b.column("doc_id").to_pylist(), n_bytes=size.to_pylist(), added=added.tolist(), sizes=np.bincount(doc, minlength=b.num_rows).tolist(), codes=pack(gap), numbers=pack(number))
            if len(names):
                data, at = W.flat(names)
                bucket = (W.hashes(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    part = order[s:e]
                    letters, ends = W.flat(names.take(pa.array(part)))
                    yield _row(_HELD, block=block, bucket=int(bucket[part[0]]), codes=pack(part), numbers=pack(np.diff(ends)), names=press.compress(letters.tobytes()))
            block += 1

    return run


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from rillstore.llm.pieces import pieces

        own, open_, seen, now = pieces(path), zstandard.ZstdDecompressor(), {}, None
        for b in batches:
            for block, bucket, codes, numbers, names in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "codes", "numbers", "names")), strict=True):
                if bucket != now:
                    seen, now = {}, bucket
                text, ends = open_.decompress(names), np.concatenate([[0], np.cumsum(unpack(numbers))]).tolist()
                own_names = [text[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
                new = [x for x in own_names if x not in seen]
                seen.update(zip(new, own.sizes([x.decode() for x in new]), strict=True))
                yield _row("block long, codes binary, counts binary", block=block, codes=codes, counts=pack(np.array([seen[x] for x in own_names])))

    return run


def _summer(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                gap, number = unpack(row["codes"].as_py()), unpack(row["numbers"].as_py())
                doc = np.repeat(np.arange(len(row["sizes"])), np.asarray(row["sizes"].values))
                total = np.cumsum(gap)
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                code = total - np.repeat(total[first] - gap[first], np.diff(np.append(first, len(doc))))
                count = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
                for part in row["parts"].as_py() or ():
                    count[unpack(part["codes"])] = unpack(part["counts"])
                n = np.bincount(doc, number * count[code], minlength=len(row["sizes"])).astype(np.int64) + np.asarray(row["added"].values)
                cols = [row["doc_ids"].values, row["n_bytes"].values, pa.array(n), pa.array(np.greater(n, limit))]
                yield pa.RecordBatch.from_arrays(cols, _names(RESULT))

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, buckets: int = 512) -> DataFrame:
    """Bytes and tokens of each text; ``tokenizer`` is the path of a tokenizers file on every machine.

    ``buckets``: tasks that distinct pre-tokens are dealt to at most; more for corpora with more of them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = cut(d.mapInArrow(W.tidy(_blocks(tokenizer, buckets)), _HELD))
    names = held.filter("bucket is not null").select("block", "bucket", "codes", "numbers", "names")
    names = names.repartition(min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
    counts = names.mapInArrow(W.tidy(_counter(tokenizer)), "block long, codes binary, counts binary")
    counts = counts.groupBy("block").agg(F.collect_list(F.struct("codes", "counts")).alias("parts"))  # at most ``buckets`` of a block
    rows = held.filter("bucket is null").select("block", "doc_ids", "n_bytes", "added", "sizes", "codes", "numbers").join(counts, "block", "left")
    return rows.mapInArrow(W.tidy(_summer(limit)), RESULT)
