"""Command line: ``python -m rillstore --schema FILE --map TAG=Table ... [--load PATH] [--query SQL] [--stats] [--export DIR]``.

Without ``--load``, whole frames are taken from standard input and a partial tail is reported. Results are
tab-separated; nulls print as ``NULL`` and bytes as ``[n bytes]``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rillstore.operators.store import Database


def cell(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bytes, bytearray)):
        return f"[{len(v)} bytes]"
    return str(v).replace("\t", " ").replace("\n", " ")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillstore")
    p.add_argument("--schema", required=True)
    p.add_argument("--map", action="append", default=[], metavar="TAG=TABLE")
    p.add_argument("--load", action="append", default=[], metavar="PATH")
    p.add_argument("--query")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--export")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("rillstore").getOrCreate()
    with open(a.schema, encoding="utf-8") as f:
        db = Database(spark, f.read())
    for m in a.map:
        tag, _, table = m.partition("=")
        db.register_tag(tag, table)
    for path in a.load:
        db.ingest_path(path)
    if not a.load and not sys.stdin.isatty():
        data = sys.stdin.buffer.read()
        used = db.ingest(data)
        if used < len(data):
            print(f"{len(data) - used} bytes of an unfinished frame were left", file=sys.stderr)
    if a.query:
        df = db.query(a.query)
        print("\t".join(df.columns))
        for r in df.toLocalIterator():
            print("\t".join(map(cell, r)))
    if a.stats:
        for r in db.stats().collect():
            print("\t".join(map(cell, r)))
    if a.export:
        db.export(a.export)
    return 0


if __name__ == "__main__":
    sys.exit(main())
