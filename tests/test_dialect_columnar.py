import random
import socket
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstore import codec, columnar
from rillstore.operators import store
from rillstore.plans import dialect
from rillstore.schema import parse
from rillstore.streaming import streams
from tests.test_schema_codec import USER
from tests.test_store import users


def test_glob():
    import re

    for pattern, yes, no in (("Brand#[1-2]*", ["Brand#1", "Brand#2x\n"], ["Brand#3", "brand#1", "xBrand#1"]), ("a?[^x]", ["abc", "a.]"], ["abx", "ab"]), ("*", ["", "x"], []), ("a.b", ["a.b"], ["axb"])):
        rule = re.compile(dialect.glob(pattern))
        assert all(rule.search(x) for x in yes) and not any(rule.search(x) for x in no)


def test_translate():
    assert dialect.translate('SELECT "a ""b" FROM "T@s" -- total(') == 'SELECT `a "b` FROM `T@s` -- total('
    assert dialect.translate("SELECT 'total(x)', TOTAL(f(a, b))") == "SELECT 'total(x)', coalesce(CAST(sum(f(a, b)) AS DOUBLE), 0D)"
    assert dialect.translate("select group_concat(iif(a, b, c), '-')") == "select listagg(CASE WHEN a THEN b ELSE c END, '-')"
    for text in ("DROP TABLE x", "insert into t values (1)", " -- only this\n", "", "update t set a = 1"):
        with pytest.raises(ValueError):
            dialect.translate(text)


def test_database_queries_in_the_dialect(spark):
    db = store.Database(spark, USER)
    db.register_tag("USER", "User")
    for s, n, at in (("satellite-1", 3, 0), ("satellite-2", 2, 100), ("ground-station", 4, 200)):
        db.register_source(s)
        db.ingest(users(n, at), s)
    for s, n in (("satellite-1", 3), ("satellite-2", 2), ("ground-station", 4)):
        assert db.query(f'SELECT id, name FROM "User@{s}"').count() == n
    assert db.query("SELECT * FROM User").count() == 9 and db.unified("User", ["satellite-1"]).count() == 3
    r = db.query("SELECT sqrt(4D) AS a, text_upper('hello') AS b, text_length('test') AS c, fuzzy_leven('kitten', 'sitting') AS d, geo_distance(40.7128D, -74.0060D, 38.9072D, -77.0369D) AS e").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (2.0, "HELLO", 4, 3) and 300 < r["e"] < 350
    with pytest.raises(ValueError):
        db.query("DELETE FROM User")
    db.max_sql = 10
    with pytest.raises(ValueError):
        db.query("SELECT id FROM User")
    with pytest.raises(KeyError):
        db.unified("User", ["elsewhere"])


KINDS = "enum Hue : ubyte { Red = 1, Green, Blue = 8 } table T { a: int = 7; b: string; c: double; d: bool; e: Hue = Green; f: ushort; g: long; h: float; i: byte; }"


def test_columns_equal_rows():
    schema, rng = parse(KINDS), random.Random(4)
    encoder = codec.Encoder(schema, "T", "TTTT")
    rows = [{k: v for k, v in {"a": rng.randrange(-9, 9), "b": rng.choice(["", "é日", "x" * 300, None]), "c": rng.random(), "d": rng.random() < 0.5, "e": rng.choice(["Red", "Green", "Blue"]), "f": rng.randrange(65536), "g": rng.randrange(-(2**60), 2**60), "h": 0.5, "i": -3}.items() if rng.random() < 0.7} for _ in range(300)]
    data = [encoder.record(r) for r in rows]
    data += [d[: rng.randrange(len(d))] for d in data[:100]] + [bytes(rng.randrange(256) for _ in range(40)) for _ in range(100)] + [b""]
    for columns in (None, ["b"], ["a", "e"]):
        decoder = codec.Decoder(schema, "T", columns)
        kinds = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "bool": pa.bool_(), "Hue": pa.string(), "ushort": pa.int32(), "long": pa.int64(), "float": pa.float32(), "byte": pa.int8()}[f.type] for _, f in decoder.fields]
        assert columnar.is_flat(decoder)
        for part in (data[:300], data):
            try:
                cols, ok = columnar.decode(pa.array(part, pa.binary()).slice(3), decoder, kinds)
            except pa.ArrowInvalid:
                assert len(part) > 300
                continue
            for i, d in enumerate(part[3:]):
                try:
                    want = decoder.row(d)
                except codec.DecodeError:
                    want = None
                assert not ok[i] or want is None or tuple(c[i].as_py() for c in cols) == want
                assert ok[i] or want is None or i + 3 >= 300


def test_decode_modes(spark):
    db = store.Database(spark, USER)
    db.register_tag("USER", "User")
    db.ingest(users(5, 0))
    whole = [bytes(r["_data"]) for r in db.records().collect()]
    db.ingest(b"".join(codec.frame(r[:14]) for r in whole[:2]))
    assert db.table("User").count() == 5 and db.corrupt("User").count() == 2
    own = db.records()
    soft = store.decode(own, db.schema, "User", mode="PERMISSIVE")
    assert soft.filter("_corrupt").count() == 2 and soft.filter("_corrupt AND id IS NULL AND name IS NULL").count() == 2 and soft.count() == 7
    with pytest.raises(Exception, match="is no User"):
        store.decode(own, db.schema, "User", mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        store.decode(own, db.schema, "User", mode="OTHER")


def test_insert_and_iterators(spark):
    db = store.Database(spark, USER)
    db.register_tag("USER", "User")
    assert db.insert("User", spark.range(10).select(F.col("id").cast("int"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("other")).repartition(3, "id")) == 10
    assert sorted(r[0] for r in db.table("User").select("_rowid").collect()) == list(range(1, 11))
    assert db.insert_json("User", spark.createDataFrame([('{"id": 77, "name": "j"}',)], "value string")) == 1
    assert db.nth("User", 10)["id"] == 77 and db.nth("User", 11) is None and db.next_after("User", 10)["name"] == "j" and db.first("User")["_rowid"] == 1
    assert db.by_rowid("User", 11).first()["id"] == 77 and '"id":77' in db.to_json("User").filter("_rowid = 11").first()["value"]
    assert db.insert("User", spark.range(0).select(F.col("id").cast("int"))) == 0


def test_socket(spark, tmp_path):
    data, (server, port) = users(30, 0), (s := socket.create_server(("127.0.0.1", 0)), s.getsockname()[1])

    def send():
        c, _ = server.accept()
        for i in range(0, len(data) + 2, 7):
            c.sendall((data + b"\x09\0")[i : i + 7])
        c.close()

    threading.Thread(target=send, daemon=True).start()
    assert streams.land_socket("127.0.0.1", port, str(tmp_path / "a.bin"), 11) == len(data)
    server.close()
    view = streams.current(spark, streams.records(spark, str(tmp_path / "a.bin"), USER, "User", "USER"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert view.count() == 30
