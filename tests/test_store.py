import pytest
from pyspark.sql import functions as F

from rillstore import codec
from rillstore.operators.store import Database, like
from rillstore.schema import parse
from tests.test_schema_codec import USER


def users(n, first=0, **more):
    e = codec.Encoder(parse(USER), "User", "USER")
    return b"".join(codec.frame(e.record(dict(id=i, name=f"User{i}", email=f"user{i}@test.com", age=i) | more)) for i in range(first, first + n))


def posts(n, each):
    e = codec.Encoder(parse(USER), "Post", "POST")
    return b"".join(codec.frame(e.record(dict(id=i * each + j, user_id=i, title="t", content="c"))) for i in range(n) for j in range(each))


@pytest.fixture
def db(spark):
    d = Database(spark, USER)
    d.register_tag("USER", "User")
    d.register_tag("POST", "Post")
    return d


@pytest.mark.parametrize(
    "where, n",
    [("age IN (1, 5, 9, 40)", 4), ("age BETWEEN 20 AND 29", 10), ("name ILIKE 'user1%'", 11), ("email IS NULL", 0), ("age < 20", 20), ("age <= 20", 21), ("NOT age >= 40", 40), ("age < 5 OR age > 44", 10)],
)
def test_filters(db, where, n):
    assert db.ingest(users(50)) == len(users(50))
    assert db.query_count(f"SELECT * FROM User WHERE {where}") == n


def test_aggregates_order_and_columns(db):
    db.ingest(users(50))
    assert tuple(db.query("SELECT sum(age), avg(age), min(age), max(age) FROM User").first()) == (1225, 24.5, 0, 49)
    assert [r[0] for r in db.query("SELECT id FROM User ORDER BY id LIMIT 5 OFFSET 10").collect()] == [10, 11, 12, 13, 14]
    assert db.table("User").columns == ["id", "name", "email", "age", "_source", "_rowid", "_offset", "_data"]
    r = db.query("SELECT _source, _rowid, _offset FROM user WHERE ID = 1").first()
    assert r[0] == "User" and r[1] == 2 and r[2] > 0


def test_bound_parameters_and_injection(db):
    for i, name in enumerate(["O'Brien", "DROP TABLE User;--", "50% Off", "Under_score"]):
        db.ingest_one(codec.Encoder(db.schema, "User", "USER").record(dict(id=i, name=name)))
    for name in ("O'Brien", "DROP TABLE User;--", "50% Off", "Under_score"):
        assert db.query("SELECT id FROM User WHERE name = ?", [name]).count() == 1
    assert db.query("SELECT id FROM User WHERE name = :n AND id > :i", {"n": "50% Off", "i": 1}).count() == 1


def test_lookups(db):
    db.ingest(users(10) + posts(10, 5))
    assert sorted(r["id"] for r in db.find_by_index("Post", "user_id", 3).collect()) == [15, 16, 17, 18, 19]
    assert [r["age"] for r in db.find_by_range("User", "age", 3, 6).collect()] == [3, 4, 5, 6]
    assert db.find_one("User", "email", "user4@test.com")["id"] == 4 and db.find_one("User", "email", "none") is None
    assert codec.type_tag(db.find_raw("User", "id", 2)) == "USER"
    assert db.by_rowid("User", 3).first()["id"] == 2 and db.by_rowid("User", 30).count() == 0
    at = db.by_rowid("Post", 12).first()["_offset"]
    assert db.by_offset("Post", at).first()["_rowid"] == 12
    assert len(list(db.iterate("User"))) == 10
    assert [r["age"] for r in db.index_order("User", "age").collect()] == list(range(10))


def test_malformed_and_unrouted(db):
    bad = codec.frame(b"\0" * 4) + codec.frame(b"\x40\0\0\0USER") + codec.frame(b"\x08\0\0\0XXXX1234")
    whole = users(1) + bad + users(1, 5)
    assert db.ingest(whole + b"\xff\0\0\0ab") == len(whole)
    assert sorted(r["id"] for r in db.table("User").collect()) == [0, 5]
    assert {r["tag"]: r["records"] for r in db.stats().collect()}["XXXX"] == 1


def test_deletes(db):
    db.ingest(users(10))
    db.mark_deleted("User", [2, 3])
    db.mark_deleted("User", db.table("User").filter("age = 9").select("_rowid"))
    assert db.deleted_count("User") == 3
    assert sorted(r["id"] for r in db.query("SELECT id FROM User").collect()) == [0, 3, 4, 5, 6, 7, 8]
    db.clear_deleted("User")
    assert db.table("User").count() == 10
    db.mark_deleted("User", [1])
    db.compact()
    assert db.table("User").count() == 9 and db.records().count() == 9 and db.deleted_count("User") == 0


def test_sources_in_any_order(spark):
    d = Database(spark, USER)
    for name, n, first in (("satellite-1", 3, 0), ("satellite-2", 2, 100), ("ground-station", 4, 200)):
        d.register_source(name)
        d.ingest(users(n, first), name)
    d.register_tag("USER", "User")
    with pytest.raises(ValueError):
        d.register_source("satellite-1")
    assert d.query("SELECT * FROM `User@satellite-2`").count() == 2
    assert d.query("SELECT * FROM User").count() == 9
    assert {r[0]: r[1] for r in d.query("SELECT _source, count(*) FROM User GROUP BY _source").collect()} == {"satellite-1": 3, "satellite-2": 2, "ground-station": 4}
    assert sorted(r[0] for r in d.query("SELECT id FROM User WHERE _source = 'ground-station'").collect()) == [200, 201, 202, 203]
    with pytest.raises(ValueError):
        d.unified("User", [])
    with pytest.raises(KeyError):
        d.table("User@nowhere")
    plan = d.unified("User").filter("_source = 'satellite-1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_path_export_and_reload(spark, db, tmp_path):
    db.ingest(users(20) + posts(2, 3))
    db.export(str(tmp_path / "out"))
    again = Database(spark, USER)
    again.register_tag("USER", "User")
    again.register_tag("POST", "Post")
    assert again.ingest_path(f"file://{tmp_path}/out/part-*") == 26
    assert sorted(r["id"] for r in again.table("User").collect()) == list(range(20))
    ids = sorted(r["_rowid"] for r in again.records().select("_rowid").collect())
    assert ids == list(range(1, 27))


def test_source_format(spark, tmp_path):
    from rillstore.sources.framed import register

    register(spark)
    (tmp_path / "a.bin").write_bytes(users(30) + posts(2, 2) + b"\x09\0\0\0half")
    r = spark.read.format("rill").option("path", str(tmp_path)).option("schema", USER).option("table", "User").option("tag", "USER").option("split_bytes", "500")
    df = r.load()
    assert df.count() == 30 and df.rdd.getNumPartitions() > 3
    assert df.filter("_rowid = 7").select("id").first()[0] == 6
    assert df.filter("_source = 'other'").count() == 0 and df.count() == 30
    one = spark.read.format("rill").option("path", str(tmp_path)).option("schema", USER).option("table", "User").option("tag", "USER").option("split_bytes", "500").option("rowid", "7").load()
    assert one.rdd.getNumPartitions() == 1 and [x["id"] for x in one.collect()] == [6]
    assert r.option("columns", "id").load().select("id", "name").first()[1] is None
    df.select("id", "name", "email", "age").write.format("rill").mode("append").option("path", str(tmp_path / "w")).option("schema", USER).option("table", "User").option("tag", "USER").save()
    back = spark.read.format("rill").option("path", str(tmp_path / "w")).option("schema", USER).option("table", "User").option("tag", "USER").load()
    assert sorted(x[0] for x in back.select("email").collect()) == sorted(f"user{i}@test.com" for i in range(30))
    (tmp_path / "c.chk").write_bytes(codec.write_checked([("User", codec.Encoder(parse(USER), "User", "USER").record(dict(id=5))), ("Post", b"123456789")]))
    c = spark.read.format("rill").option("path", str(tmp_path / "c.chk")).option("schema", USER).option("table", "User").option("layout", "checked").load()
    assert [x["id"] for x in c.collect()] == [5]


def test_external_stats_and_like(spark, db):
    db.ingest(users(3))
    db.register_external("extra", spark.range(4))
    assert db.query("SELECT count(*) FROM extra JOIN User ON extra.id = User.id").first()[0] == 3
    s = {r["table"]: r["records"] for r in db.stats().collect()}
    assert s == {"User": 3, "Post": 0}
    assert db.list_tables() == ["User", "Post", "extra"]
    assert db.table("User").filter(like(F.col("name"), "uSER_")).count() == 3


def test_encrypted_column(spark):
    from rillstore.functions.security import encrypt_field

    d = Database(spark, "table S { id: int (id); secret: string (encrypted); }")
    d.register_tag("SSSS", "S")
    sealed = spark.range(1).select(encrypt_field(F.lit("hush"), bytes(range(32)), "S.secret")).first()[0]
    d.ingest_one(codec.Encoder(d.schema, "S", "SSSS").record(dict(id=1, secret=sealed)))
    assert d.table("S").first()["secret"] == sealed
    d.set_encryption_key(bytes(range(32)))
    assert d.table("S").first()["secret"] == "hush" and d.query("SELECT secret FROM S").first()[0] == "hush"
    d.set_encryption_key(bytes(32))
    assert d.table("S").first()["secret"] is None


def test_splitting_holds_some_records_at_once():
    import pyarrow as pa

    from rillstore.operators import store

    data = users(3 * store.HELD)
    got = list(store._split(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data], pa.binary())], ["path", "content"])])))
    assert len(got) > 1 and max(b.num_rows for b in got) <= store.HELD
    table = pa.Table.from_batches(got)
    assert table["at"].to_pylist() == list(range(3 * store.HELD)) and b"".join(map(codec.frame, table["_data"].to_pylist())) == data


def test_files_roll_and_keep_the_order(spark, tmp_path):
    from rillstore.sources.framed import Reader, StreamReader, files, register

    register(spark)
    data = users(500) + posts(100, 5)
    own = [(bytearray(data[a:e]),) for _, a, e in codec.frames(data)]
    out = str(tmp_path / "w")
    spark.createDataFrame(own, "_data binary").coalesce(1).write.format("rill").mode("append").option("path", out).option("schema", USER).option("roll_bytes", "20000").save()
    parts = files(out)
    assert len(parts) > 2 and b"".join(open(p, "rb").read() for p in parts) == data
    assert max(len(open(p, "rb").read()) for p in parts) < 20_200
    options = {"path": out, "schema": USER, "table": "Post", "tag": "POST", "split_bytes": "5000"}
    spans = Reader(options).partitions()
    assert min(s.first for s in spans) > 400 and sum(s.count for s in spans) < 600  # spans of users only are not read
    stream = StreamReader(options)
    assert max(s.end - s.start for s in stream.partitions({}, stream.latestOffset())) < 5_200  # large files are read in spans, too
    rows = [tuple(r) for s in spans for b in Reader(options).read(s) for r in zip(b["_rowid"].to_pylist(), b["id"].to_pylist(), strict=True)]
    assert rows == [(501 + i, i) for i in range(500)]


def test_tables_read_only_parts_of_their_tag(spark):
    from rillstore.plans import engine

    own = engine.database(spark, "/root/testdata/sf0.001", "Customer", "Order", "Nation")
    plan = own.table("Nation")._jdf.queryExecution().sparkPlan().toString()
    assert "nation.parquet" in plan and "orders.parquet" not in plan and own.table("Nation").count() == 25
    assert "BroadcastHashJoin" in engine.record_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
