"""Structured Streaming over framed records and event tables.

A stream of records advances by whole frames only; the checkpoint holds the byte and record reached in
each file, so a restarted query goes on where it stopped and every record is delivered once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstore.sources.framed import register


def records(spark: SparkSession, path: str, schema: str, table: str, tag: str = "", source: str | None = None) -> DataFrame:
    """The rows of one table of a growing file or folder of framed records."""
    register(spark)
    r = spark.readStream.format("rill").option("path", path).option("schema", schema).option("table", table).option("tag", tag)
    return (r.option("source", source) if source else r).load()


def sources(spark: SparkSession, paths: Mapping[str, str], schema: str, table: str, tag: str = "") -> DataFrame:
    """Several growing sources as one stream; ``_source`` names where a row is from."""
    return reduce(DataFrame.unionByName, [records(spark, p, schema, table, tag, s) for s, p in paths.items()])


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Land a stream as Parquet, partitioned by source; ``once`` takes what there is and ends."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("_source")
    return (w.trigger(availableNow=True) if once else w).start()


def current(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream holds now, as a table: takes up what is new since the last call, lands it, and reads all that is landed."""
    append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def land_socket(host: str, port: int, path: str, chunk: int = 1 << 16) -> int:
    """Take framed records from a socket until it closes, appending whole frames only to a file that
    :func:`records` can follow; returns the number of bytes landed. Half a frame at the end is dropped."""
    import socket

    from rillstore import codec

    held, n = b"", 0
    with socket.create_connection((host, port)) as s, open(path, "ab") as f:
        while data := s.recv(chunk):
            held += data
            whole = codec.consumed(held)
            f.write(held[:whole])
            f.flush()
            held, n = held[whole:], n + whole
    return n


def counts(stream: DataFrame, *by: str) -> DataFrame:
    """Rows so far, by source or other columns (update or complete mode)."""
    return stream.groupBy(*(by or ("_source",))).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates by tumbling or sliding windows; rows later than the watermark are left out."""
    aggregates = aggregates or {"n": F.count("*")}
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = own.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = own.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
