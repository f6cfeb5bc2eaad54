"""Queries of the engine's own operators over the driver's tables.

Where a query needs records, rows of a table are encoded to records and read back through the store; the
``framed`` ones also write them as framed files and take these in again, so the whole path (encode, frame,
split, route, decode) is compared with plain SQL on the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstore import codec
from rillstore.cluster import cut, shared_dir, ship_package
from rillstore.functions import fuzzy, geo, ranks, security
from rillstore.operators import relations, store
from rillstore.schema import Schema, parse

IDL = """
namespace demo;
table Customer { custkey: long (id); name: string (key); nationkey: int; acctbal: double; segment: string; }
table Order { orderkey: long (id); custkey: long (key); status: string; total: double; priority: string; }
table Nation { nationkey: int (id); name: string; regionkey: int; }
"""
TAGS = {"Customer": "CUST", "Order": "ORDR", "Nation": "NATN"}
KEY = bytes(range(1, 33))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, schema: Schema, table: str, order: str, source=None) -> DataFrame:
    """Records in the order of a unique key; the key is also the row id, so no global count is needed."""
    out = store.encode(df, schema, table, TAGS[table], order)
    return out.select((source if source is not None else F.lit(None)).cast("string").alias("_source"), "_rowid", F.lit(0).cast("long").alias("_offset"), "_tag", "_data")


def database(spark: SparkSession, sf_dir: str, *tables: str) -> store.Database:
    db = store.Database(spark, IDL)
    for t, tag in TAGS.items():
        db.register_tag(tag, t)
    if "Customer" in tables:
        c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
        db.add(_records(c, db.schema, "Customer", "custkey", F.element_at(F.array(F.lit("north"), F.lit("south"), F.lit("west")), (F.col("_rowid") % 3 + 1).cast("int"))), TAGS["Customer"])
    if "Order" in tables:
        o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
        db.add(_records(o, db.schema, "Order", "orderkey"), TAGS["Order"])
    if "Nation" in tables:
        n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
        db.add(_records(n, db.schema, "Nation", "nationkey"), TAGS["Nation"])
    return db


def _sources(spark: SparkSession, sf_dir: str) -> store.Database:
    db = database(spark, sf_dir, "Customer")
    for s in ("north", "south", "west"):
        db.register_source(s)
    return db


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", ((F.col("c_custkey") * 37) % 17000 / 100.0 - 85.0).alias("lat"), ((F.col("c_custkey") * 101) % 35900 / 100.0 - 179.5).alias("lon"))


_PLACES = "(SELECT c_custkey, (c_custkey * 37) % 17000 / 100.0 - 85.0 AS lat, (c_custkey * 101) % 35900 / 100.0 - 179.5 AS lon FROM customer)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h})))"


def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("c_custkey", F.round(geo.geo_distance(F.lit(40.7128), F.lit(-74.006), F.col("lat"), F.col("lon")), 6).alias("km"))


def geo_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("c_custkey", geo.geo_bbox_contains(F.lit(-30.0), F.lit(45.0), F.lit(-60.0), F.lit(100.0), F.col("lat"), F.col("lon")).alias("inside"))


def geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("c_custkey", geo.geo_within_radius(F.lit(48.8566), F.lit(2.3522), F.col("lat"), F.col("lon"), F.lit(4000.0)).alias("near"))


def geo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _places(spark, sf_dir)
    return geo.geo_join(own, own, 60.0).filter("c_custkey < r_c_custkey").select("c_custkey", "r_c_custkey", F.round("distance", 6).alias("km"))


def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("x"), F.col("p_name").alias("a"))
    queries = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("y"), F.regexp_replace("p_name", "^(.)", "$1_").alias("b"))
    return fuzzy.fuzzy_join(queries, own, ("b", "a"), 2).select("x", "y", "distance")


def fuzzy_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    n, f = _table(spark, sf_dir, "nation"), fuzzy.functions()
    a, b = n.select(F.col("n_name").alias("x"), F.col("n_regionkey").alias("k")), n.select(F.col("n_name").alias("y"), F.col("n_regionkey").alias("k"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "k").select("x", "y", f["fuzzy_damlev"](x, y).alias("dam"), F.round(f["fuzzy_jarowin"](x, y), 9).alias("jw"), f["fuzzy_hamming"](x, y).alias("ham"))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).unified("Customer").select("_source", "custkey", "name", "acctbal")


def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).unified("Customer").filter("_source = 'south'").select("custkey", "segment")


def source_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).query("SELECT custkey, nationkey FROM `Customer@west`")


def source_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).unified("Customer").groupBy("_source").agg(F.count("*").alias("n"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer").find_by_index("Customer", "name", "Customer#000000042").select("custkey", "name")


def rowid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer", "Nation").by_rowid("Customer", 7).select("custkey", "_rowid")


def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Order").find_by_range("Order", "custkey", 10, 20).select("orderkey", "custkey")


def non_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Order").find_by_index("Order", "custkey", 7).select("orderkey")


def bound_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Order").query("SELECT orderkey, total FROM `Order` WHERE custkey = ? AND total > ?", [10, 1000.0])


def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer").table("Customer").select("custkey", "name", "nationkey", "acctbal", "segment")


def record_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer", "Order", "Nation").query(
        "SELECT n.name AS nation, count(*) AS orders FROM `Order` o JOIN Customer c ON o.custkey = c.custkey JOIN Nation n ON c.nationkey = n.nationkey GROUP BY n.name"
    )


def tombstone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Customer")
    db.mark_deleted("Customer", db.table("Customer").filter("acctbal < 0").select("_rowid"))
    return db.table("Customer").select("custkey")


def tombstone_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Customer")
    db.mark_deleted("Customer", db.table("Customer").filter("acctbal < 0").select("_rowid"))
    return db.gone["Customer"].agg(F.count("*").alias("n"))


def tombstone_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Customer", "Nation")
    db.mark_deleted("Customer", db.table("Customer").filter("nationkey % 2 = 0").select("_rowid"))
    db.compact()
    return db.records().groupBy(F.col("_tag").alias("tag")).agg(F.count("*").alias("n"))


def route_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer", "Order", "Nation").records().groupBy(F.col("_tag").alias("tag")).agg(F.count("*").alias("n"))


def stats_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Customer", "Order", "Nation").stats().select("table", "tag", "records")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return items.select(F.col("l_orderkey").alias("_rowid"), "items")


_ITEMS = relations.Link("Order", "items", "vector", ("Item",))


def link_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    child, link = relations.extract(_nested(spark, sf_dir), _ITEMS)
    return link.join(child, link["child_rowid"] == child["_rowid"]).select("parent_rowid", "vec_index", "l_linenumber", "l_partkey")


def link_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_rowid"), F.col("l_partkey").alias("child_rowid"))
    return relations.reference_counts(link).select("child_rowid", F.col("references").alias("n"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_rowid"))
    link = _table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("child_rowid"))
    return relations.orphans(child, link).select(F.col("_rowid").alias("c_custkey"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").select((-1 - F.col("n_regionkey")).cast("long").alias("parent"), (1_000_000_000 + F.col("n_nationkey")).cast("long").alias("child"))
    c = _table(spark, sf_dir, "customer").select((1_000_000_000 + F.col("c_nationkey")).cast("long").alias("parent"), F.col("c_custkey").alias("child"))
    gone = relations.cascade(n.unionByName(c), spark.createDataFrame([(-3,)], "node long"))
    return gone.filter("node between 0 and 999999999").select(F.col("node").alias("c_custkey"))


def crc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def hmac_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").withColumn("mac", security.hmac_sha256(F.col("c_name"), KEY))
    c = c.withColumn("shown", F.when(F.col("c_custkey") % 10 == 0, F.upper(F.reverse("mac"))).otherwise(F.upper("mac")))
    return c.select("c_custkey", security.hmac_verify(F.col("c_name"), KEY, F.col("shown")).alias("ok"))


def field_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").withColumn("sealed", security.encrypt_field(F.col("c_name"), KEY, "customer.name"))
    return c.select("c_custkey", security.decrypt_field(F.col("sealed"), KEY, "customer.name").alias("name"), security.decrypt_field(F.col("sealed"), KEY, "customer.other").isNull().alias("refused"))


def fn_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_name", F.soundex("n_name").alias("code"))


# --- framed files, streams, one record -----------------------------------------------------------
def _framed(spark: SparkSession, sf_dir: str) -> tuple[store.Database, str]:
    """The three tables as framed files in the shared folder, and a database that has taken them in."""
    path = shared_dir(spark)
    database(spark, sf_dir, "Customer", "Order", "Nation").export(path)
    db = database(spark, sf_dir)
    db.ingest_path(path)
    return db, path


def framed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir)[0].table("Order").select("orderkey", "custkey", "status", "total", "priority")


def framed_export_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, _ = _framed(spark, sf_dir)
    path = shared_dir(spark)
    db.export(path)
    again = database(spark, sf_dir)
    again.ingest_path(path)
    return again.stats().select("table", "records")


def framed_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _framed(spark, sf_dir)[0].records()
    return own.agg(F.min("_rowid").alias("lo"), F.max("_rowid").alias("hi"), F.countDistinct("_rowid").alias("n"))


def framed_tag_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _framed(spark, sf_dir)[0].records()
    return own.groupBy(F.substring("_data", 5, 4).cast("string").alias("tag")).agg(F.count("*").alias("n"))


def framed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.sources.framed import register

    _, path = _framed(spark, sf_dir)
    register(spark)
    r = spark.read.format("rill").option("path", path).option("schema", IDL).option("table", "Customer").option("tag", "CUST").option("split_bytes", 20_000)
    return r.load().select("custkey", "name", "acctbal")


def framed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.streaming import streams

    _, path = _framed(spark, sf_dir)
    state = shared_dir(spark)
    view = streams.current(spark, streams.records(spark, path, IDL, "Customer", "CUST", "north"), f"{state}/rows", f"{state}/state")
    return view.select("custkey", "name", "_source")


def framed_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.streaming import streams

    _, path = _framed(spark, sf_dir)
    state = shared_dir(spark)
    both = streams.records(spark, path, IDL, "Customer", "CUST", "customers").select("_source").unionByName(streams.records(spark, path, IDL, "Order", "ORDR", "orders").select("_source"))
    return streams.counts(streams.current(spark, both.withColumn("x", F.lit(1)), f"{state}/rows", f"{state}/state"))


def _nation_bytes(spark: SparkSession, sf_dir: str) -> list[bytes]:
    """The records of the 25 nations, in order."""
    own = database(spark, sf_dir, "Nation").records().orderBy("_rowid").limit(25)
    return [bytes(r["_data"]) for r in own.select("_data").collect()]


def ingest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer that ends in half a frame: the whole frames are taken, the tail is left."""
    data = b"".join(map(codec.frame, _nation_bytes(spark, sf_dir)))
    db = database(spark, sf_dir)
    taken = db.ingest(data[:-3])
    db.ingest(data[taken:])
    return db.table("Nation").select("nationkey", "name", "_rowid")


def ingest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    for record in _nation_bytes(spark, sf_dir)[:5]:
        db.ingest_one(record)
    return db.table("Nation").select("nationkey", "name", "_rowid")


def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken records beside good ones: counted, and left out of the table."""
    own = _nation_bytes(spark, sf_dir)
    db = database(spark, sf_dir)
    db.ingest(b"".join(codec.frame(x) for r in own for x in (r, r[:12])) + codec.frame(b"abc") + codec.frame(b"12345678"))
    return db.table("Nation").agg(F.count("*").alias("good")).crossJoin(db.corrupt("Nation").agg(F.count("*").alias("bad")))


def checked_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _nation_bytes(spark, sf_dir)
    data = bytearray(codec.write_checked([("Nation", r) for r in own], "demo"))
    data[codec.CHECKED_FILE.size + codec.CHECKED_RECORD.size + 9] ^= 1  # the first record is damaged, the others are not
    db = database(spark, sf_dir)
    for *_, body in codec.read_checked(bytes(data)):
        db.ingest_one(body)
    return db.table("Nation").select("nationkey", "name")


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.insert("Customer", _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal")))
    own = db.table("Customer")
    return own.agg(F.count("*").alias("n"), F.max("_rowid").alias("last"), F.sum("custkey").alias("keys"), F.sum("nationkey").alias("defaults"))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    n = _table(spark, sf_dir, "nation")
    db.insert_json("Nation", n.select(F.to_json(F.struct(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))).alias("value")))
    return db.to_json("Nation").select("value")


def external_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Customer")
    db.register_external("Regions", _table(spark, sf_dir, "nation"))
    return db.query('SELECT n_regionkey AS region, count(*) AS n FROM Customer JOIN "Regions" ON nationkey = n_nationkey GROUP BY n_regionkey')


def own_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Customer")
    db.set_decoder("Customer", lambda records: records.select(F.col("_rowid").alias("custkey"), F.substring("_data", 5, 4).cast("string").alias("tag")))
    return db.table("Customer")


def query_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = database(spark, sf_dir, "Order").query_count("SELECT * FROM `Order` WHERE total > 100000")
    return spark.createDataFrame([(n,)], "n long")


def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Order")
    r = db.find_one("Order", "custkey", 10)
    raw = codec.Decoder(db.schema, "Order").row(db.find_raw("Order", "custkey", 10))
    return spark.createDataFrame([(r["orderkey"], raw[0])], "orderkey long, raw_key long")


def store_iterators(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Nation", "Customer")
    a, b, c = db.first("Customer"), db.nth("Customer", 9), db.next_after("Customer", 20)
    names = [codec.Decoder(db.schema, "Nation").row(r)[1] for r in db.iterate("Nation")]
    return spark.createDataFrame([(a["custkey"], b["custkey"], c["custkey"], len(names), max(names))], "first long, tenth long, after_20 long, n long, last_name string")


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = database(spark, sf_dir, "Order").index_order("Order", "custkey").limit(50)
    return own.select("orderkey", "custkey")


def landed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "Order").land("Order", shared_dir(spark), "custkey").filter("custkey between 10 and 20").select("orderkey", "custkey")


def catalog_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).definitions()


def catalog_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _sources(spark, sf_dir)
    return spark.createDataFrame([(i, n) for i, n in enumerate([*db.list_tables(), *db.list_sources()])], "i int, name string")


def import_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"a.fbs": 'include "b.fbs"; include "c.fbs"; table A { b: B; }', "b.fbs": 'include "c.fbs"; table B { c: C; }', "c.fbs": "table C { x: int; }"}
    order = [n.removesuffix(".fbs") for n in relations.import_order(files)]
    loop = relations.import_cycle(files | {"c.fbs": 'include "a.fbs"; table C { x: int; }'})
    return spark.createDataFrame([(" ".join(order), len(set(loop)))], "in_order string, in_loop int")


def link_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = relations.links(parse("table Weapon { name: string; damage: int; } table Monster { name: string; weapon: Weapon; inventory: [Weapon]; }"))
    return spark.createDataFrame([(x.parent, x.field, x.kind, x.children[0]) for x in own], "parent string, field string, kind string, member string")


def link_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_rowid"), F.col("l_partkey").alias("child_rowid"), F.lit(None).cast("int").alias("vec_index"))
    parent = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_rowid"), "o_totalprice")
    return relations.parents(link, parent, 17).select(F.col("_rowid").alias("o_orderkey")).distinct()


def link_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of decoded records: orders that hold their lines as a vector of tables."""
    schema = parse("table Line { number: int; part: long; } table Basket { orderkey: long (id); lines: [Line]; }")
    own = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part")))).alias("lines"))
    records = store.encode(own, schema, "Basket", "BSKT", "orderkey").select(F.lit("s").alias("_source"), "_rowid", F.lit(0).cast("long").alias("_offset"), "_tag", "_data")
    child, link = relations.extract(store.decode(records, schema, "Basket"), relations.Link("Basket", "lines", "vector", ("Line",)))
    return link.join(child, link["child_rowid"] == child["_rowid"]).select("parent_rowid", "number", "part")


def record_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "Nation")
    sealed = security.encrypt_records(db.records(), KEY)
    opened = security.decrypt_records(sealed, KEY)
    back = store.decode(opened.filter("_data is not null"), db.schema, "Nation")
    lost = security.decrypt_records(sealed, bytes(32)).filter("_data is null").select(F.col("_rowid").alias("nationkey"), F.lit(True).alias("refused"))
    return back.select("nationkey", "name").join(lost.withColumn("nationkey", F.col("nationkey").cast("int")), "nationkey")


def hmac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = database(spark, sf_dir, "Customer").records().withColumn("_mac", security.hmac_sha256(F.col("_data"), KEY))
    own = own.withColumn("_data", F.when(F.col("_rowid") % 5 == 0, F.concat("_data", F.lit(b"x"))).otherwise(F.col("_data")))
    return security.verified(own, KEY).select(F.col("_rowid").alias("custkey"))


def crc_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select("r_regionkey", F.crc32(F.format_string("region-%d", "r_regionkey").cast("binary")).alias("crc"))


def uuid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs("SELECT n_nationkey, uuid_str(uuid_blob(upper(md5(n_name)))) AS u, length(uuid4()) + length(uuid7()) AS n FROM nation", "nation")(spark, sf_dir)


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against exact figures: within their error."""
    own = _table(spark, sf_dir, "lineitem")
    exact = own.agg(F.countDistinct("l_partkey").alias("n")).crossJoin(ranks.exact_percentile(own, "l_extendedprice", 0.5, "m"))
    rough = own.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.expr("hll_sketch_estimate(hll_sketch_agg(l_partkey, 14))").alias("h"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("p"))
    near = lambda x, y, e: F.abs(F.col(x) - F.col(y)) <= e * F.col(y)
    return exact.crossJoin(rough).select(near("a", "n", 0.08).alias("distinct_near"), near("h", "n", 0.08).alias("sketch_near"), near("p", "m", 0.02).alias("median_near"))


def own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    db = database(spark, sf_dir, "Order")
    db.register_aggregate("spread", spread, "double")
    return db.query('SELECT priority, spread(total) AS spread FROM "Order" GROUP BY priority')


def native_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of Spark's own beside the records: created, added to, read."""
    import uuid

    name = f"native_{uuid.uuid4().hex}"
    _table(spark, sf_dir, "supplier").createOrReplaceTempView("native_rows")
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT s_suppkey, s_name FROM native_rows WHERE s_nationkey < 10")
    spark.sql(f"INSERT INTO {name} SELECT s_suppkey, s_name FROM native_rows WHERE s_nationkey >= 20")
    out = cut(spark.table(name))
    spark.sql(f"DROP TABLE {name}")
    return out


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _places(spark, sf_dir).selectExpr("c_custkey", "lat AS min_y", "lat + 1.5 AS max_y", "lon AS min_x", "lon + 2.5 AS max_x")
    asked = own.filter("c_custkey % 100 = 0")
    return geo.box_join(asked, own, 5.0).select("c_custkey", "r_c_custkey")


def _dialect(sql: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query text of the embedded dialect, over records."""
    return lambda spark, sf_dir: database(spark, sf_dir, *tables).query(sql)


def dialect_quoted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).query('SELECT custkey, name FROM "Customer@south" WHERE "name" GLOB \'Customer#0*[0-4]\'')


def _packs(sql: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from rillstore.functions.sql import register

        register(spark)
        for t in tables:
            _table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


PACKS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "pack_text": (
        "SELECT p_partkey, text_upper(p_name) AS u, text_left(p_name, -2) AS l, text_right(p_name, 3) AS r, text_slice(p_name, -4, -1) AS s, text_split(p_type, ' ', 1) AS w, text_index(p_name, 'a') AS i, text_has_prefix(p_brand, 'Brand') AS h, text_count(p_type, 'e') AS c, text_reverse(p_brand) AS v, text_lpad(p_brand, 10, '.') AS p, text_trim(p_brand, 'Bd') AS t, text_size(p_name) AS z FROM part",
        "SELECT p_partkey, upper(p_name) AS u, left(p_name, greatest(length(p_name) - 2, 0)) AS l, right(p_name, 3) AS r, CASE WHEN length(p_name) >= 4 THEN substring(p_name, length(p_name) - 3, 3) ELSE left(p_name, greatest(length(p_name) - 1, 0)) END AS s, split_part(p_type, ' ', 1) AS w, instr(p_name, 'a') AS i, CAST(starts_with(p_brand, 'Brand') AS INT) AS h, CAST(length(p_type) - length(replace(p_type, 'e', '')) AS INT) AS c, reverse(p_brand) AS v, lpad(p_brand, 10, '.') AS p, trim(p_brand, 'Bd') AS t, strlen(p_name) AS z FROM part",
        ("part",),
    ),
    "pack_loose": (
        "SELECT l_orderkey, l_linenumber, div_int(l_orderkey, l_linenumber - 1) AS q, mod_safe(l_orderkey, l_linenumber - 1) AS m, trunc_num(l_extendedprice) AS t, max_of(l_tax, l_discount) AS x, to_int_loose(concat(CAST(l_linenumber AS STRING), 'x')) AS i, like_nocase(l_returnflag, 'r%') AS k, quote_text(l_linestatus) AS z FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_orderkey // (l_linenumber - 1) END AS q, CASE WHEN l_linenumber <> 1 THEN l_orderkey % (l_linenumber - 1) END AS m, CAST(trunc(l_extendedprice) AS BIGINT) AS t, greatest(l_tax, l_discount) AS x, CAST(l_linenumber AS BIGINT) AS i, l_returnflag ILIKE 'r%' AS k, chr(39) || l_linestatus || chr(39) AS z FROM lineitem",
        ("lineitem",),
    ),
    "pack_dates": (
        "SELECT o_orderkey, julianday(o_orderdate) AS jd, unixepoch(o_orderdate) AS e, date_text(o_orderdate) AS d, time_text(o_orderdate) AS t, datetime_text(o_orderdate) AS dt FROM orders",
        "SELECT o_orderkey, epoch_us(o_orderdate) / 86400000000::DOUBLE + 2440587.5::DOUBLE AS jd, CAST(epoch(o_orderdate) AS BIGINT) AS e, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt FROM orders",
        ("orders",),
    ),
    "pack_json_edit": (
        "SELECT event_id, json_set(props, '$.extra', json('[1]')) AS s, json_set(props, '$.extra', '[1]') AS t, json_remove(props, '$.k') AS r, json_patch(props, '{\"k\":null,\"z\":1}') AS p FROM events",
        "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"extra\":[1]}' AS s, '{\"k\":' || json_extract_string(props, '$.k') || ',\"extra\":\"[1]\"}' AS t, '{}' AS r, '{\"z\":1}' AS p FROM events",
        ("events",),
    ),
    "pack_fuzzy": (
        "SELECT a.n_name AS x, b.n_name AS y, fuzzy_leven(a.n_name, b.n_name) AS l, fuzzy_damlev(a.n_name, b.n_name) AS d, round(fuzzy_jarowin(a.n_name, b.n_name), 9) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
        "SELECT a.n_name AS x, b.n_name AS y, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS l, CAST(damerau_levenshtein(a.n_name, b.n_name) AS INT) AS d, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
        ("nation",),
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        geo_distance, geo_bbox, geo_radius, geo_join, fuzzy_join, fuzzy_distances, source_union, source_filter, source_one, source_group_count, point_lookup, rowid_lookup, range_lookup,
        non_unique_lookup, bound_query, record_round_trip, record_join, tombstone_scan, tombstone_count, tombstone_compact, route_by_type, stats_by_table, link_children, link_refcount,
        orphans, cascade_delete, crc_check, hmac_verify, field_encryption, fn_soundex,
        framed_ingest, framed_export_reload, framed_row_ids, framed_tag_of_bytes, framed_source, framed_stream, framed_stream_counts, ingest_bytes, ingest_one, malformed_records, checked_layout,
        insert_rows, json_records, external_source, own_decoder, query_count, find_one, store_iterators, index_order, landed_index, catalog_definitions, catalog_lists, import_order, link_definitions,
        link_parents, link_of_records, record_encryption, hmac_filter, crc_known, uuid_round_trip, approximate, own_aggregate, native_table, box_overlap, dialect_quoted_source,
    )
}

_SOURCE = "CASE c_custkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END"
ORACLE: dict[str, str] = {
    "geo_distance": f"SELECT c_custkey, round({_hav('40.7128', '-74.006', 'lat', 'lon')}, 6) AS km FROM {_PLACES} p",
    "geo_bbox": f"SELECT c_custkey, CAST(lat BETWEEN -30 AND 45 AND lon BETWEEN -60 AND 100 AS INT) AS inside FROM {_PLACES} p",
    "geo_radius": f"SELECT c_custkey, CAST({_hav('48.8566', '2.3522', 'lat', 'lon')} <= 4000 AS INT) AS near FROM {_PLACES} p",
    "geo_join": f"SELECT a.c_custkey AS c_custkey, b.c_custkey AS r_c_custkey, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM {_PLACES} a JOIN {_PLACES} b ON a.c_custkey < b.c_custkey AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60",
    "fuzzy_join": "SELECT a.p_partkey AS x, b.p_partkey AS y, CAST(levenshtein(a.p_name, left(b.p_name, 1) || '_' || substring(b.p_name, 2)) AS INT) AS distance FROM part a JOIN part b ON b.p_partkey % 100 = 0 AND levenshtein(a.p_name, left(b.p_name, 1) || '_' || substring(b.p_name, 2)) <= 2",
    "fuzzy_distances": "SELECT a.n_name AS x, b.n_name AS y, CAST(damerau_levenshtein(a.n_name, b.n_name) AS INT) AS dam, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS jw, CASE WHEN length(a.n_name) = length(b.n_name) THEN CAST(hamming(a.n_name, b.n_name) AS INT) ELSE -1 END AS ham FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "source_union": f"SELECT {_SOURCE} AS _source, c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer",
    "source_filter": "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 = 1",
    "source_one": "SELECT c_custkey AS custkey, c_nationkey AS nationkey FROM customer WHERE c_custkey % 3 = 2",
    "source_group_count": f"SELECT {_SOURCE} AS _source, count(*) AS n FROM customer GROUP BY 1",
    "point_lookup": "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_name = 'Customer#000000042'",
    "rowid_lookup": "SELECT c_custkey AS custkey, c_custkey AS _rowid FROM customer WHERE c_custkey = 7",
    "range_lookup": "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20",
    "non_unique_lookup": "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey = 7",
    "bound_query": "SELECT o_orderkey AS orderkey, o_totalprice AS total FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000",
    "record_round_trip": "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer",
    "record_join": "SELECT n_name AS nation, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "tombstone_scan": "SELECT c_custkey AS custkey FROM customer WHERE NOT c_acctbal < 0",
    "tombstone_count": "SELECT count(*) AS n FROM customer WHERE c_acctbal < 0",
    "tombstone_compact": "SELECT 'CUST' AS tag, count(*) AS n FROM customer WHERE c_nationkey % 2 <> 0 UNION ALL SELECT 'NATN', count(*) FROM nation",
    "route_by_type": "SELECT 'CUST' AS tag, count(*) AS n FROM customer UNION ALL SELECT 'ORDR', count(*) FROM orders UNION ALL SELECT 'NATN', count(*) FROM nation",
    "stats_by_table": "SELECT 'Customer' AS \"table\", 'CUST' AS tag, count(*) AS records FROM customer UNION ALL SELECT 'Order', 'ORDR', count(*) FROM orders UNION ALL SELECT 'Nation', 'NATN', count(*) FROM nation",
    "link_children": "SELECT l_orderkey AS parent_rowid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS vec_index, l_linenumber, l_partkey FROM lineitem",
    "link_refcount": "SELECT l_partkey AS child_rowid, count(*) AS n FROM lineitem GROUP BY l_partkey",
    "orphans": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)",
    "cascade_delete": "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "hmac_verify": "SELECT c_custkey, c_custkey % 10 <> 0 AS ok FROM customer",
    "field_encryption": "SELECT c_custkey, c_name AS name, TRUE AS refused FROM customer",
}
_COUNTS = "SELECT 'Customer' AS \"table\", count(*) AS records FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Nation', count(*) FROM nation"
ORACLE |= {
    "framed_ingest": "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority FROM orders",
    "framed_export_reload": _COUNTS,
    "framed_row_ids": f"SELECT CAST(1 AS BIGINT) AS lo, CAST(sum(records) AS BIGINT) AS hi, CAST(sum(records) AS BIGINT) AS n FROM ({_COUNTS}) t",
    "framed_tag_of_bytes": "SELECT 'CUST' AS tag, count(*) AS n FROM customer UNION ALL SELECT 'ORDR', count(*) FROM orders UNION ALL SELECT 'NATN', count(*) FROM nation",
    "framed_source": "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer",
    "framed_stream": "SELECT c_custkey AS custkey, c_name AS name, 'north' AS _source FROM customer",
    "framed_stream_counts": "SELECT 'customers' AS _source, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
    "ingest_bytes": "SELECT n_nationkey AS nationkey, n_name AS name, row_number() OVER (ORDER BY n_nationkey) AS _rowid FROM nation",
    "ingest_one": "SELECT n_nationkey AS nationkey, n_name AS name, CAST(n_nationkey + 1 AS BIGINT) AS _rowid FROM nation WHERE n_nationkey < 5",
    "malformed_records": "SELECT count(*) AS good, count(*) AS bad FROM nation",
    "checked_layout": "SELECT n_nationkey AS nationkey, n_name AS name FROM nation WHERE n_nationkey > 0",
    "insert_rows": "SELECT count(*) AS n, count(*) AS last, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS defaults FROM customer",
    "json_records": "SELECT '{\"nationkey\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"regionkey\":' || n_regionkey || '}' AS value FROM nation",
    "external_source": "SELECT n_regionkey AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    "own_decoder": "SELECT c_custkey AS custkey, 'CUST' AS tag FROM customer",
    "query_count": "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000",
    "find_one": "SELECT min(o_orderkey) AS orderkey, min(o_orderkey) AS raw_key FROM orders WHERE o_custkey = 10",
    "store_iterators": "SELECT min(c_custkey) AS first, (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 1 OFFSET 9) AS tenth, min(c_custkey) FILTER (WHERE c_custkey > 20) AS after_20, (SELECT count(*) FROM nation) AS n, (SELECT max(n_name) FROM nation) AS last_name FROM customer",
    "index_order": "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50",
    "landed_index": "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20",
    "catalog_definitions": "SELECT * FROM (VALUES ('Customer', 0, 'custkey', 'bigint', TRUE, TRUE), ('Customer', 1, 'name', 'string', FALSE, TRUE), ('Customer', 2, 'nationkey', 'int', FALSE, FALSE), ('Customer', 3, 'acctbal', 'double', FALSE, FALSE), ('Customer', 4, 'segment', 'string', FALSE, FALSE), ('Order', 0, 'orderkey', 'bigint', TRUE, TRUE), ('Order', 1, 'custkey', 'bigint', FALSE, TRUE), ('Order', 2, 'status', 'string', FALSE, FALSE), ('Order', 3, 'total', 'double', FALSE, FALSE), ('Order', 4, 'priority', 'string', FALSE, FALSE), ('Nation', 0, 'nationkey', 'int', TRUE, TRUE), ('Nation', 1, 'name', 'string', FALSE, FALSE), ('Nation', 2, 'regionkey', 'int', FALSE, FALSE)) t(\"table\", position, \"column\", type, is_key, indexed)",
    "catalog_lists": "SELECT * FROM (VALUES (0, 'Customer'), (1, 'Order'), (2, 'Nation'), (3, 'north'), (4, 'south'), (5, 'west')) t(i, name)",
    "import_order": "SELECT 'c b a' AS in_order, 3 AS in_loop",
    "link_definitions": "SELECT * FROM (VALUES ('Monster', 'weapon', 'single', 'Weapon'), ('Monster', 'inventory', 'vector', 'Weapon')) t(parent, field, kind, member)",
    "link_parents": "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_partkey = 17",
    "link_of_records": "SELECT l_orderkey AS parent_rowid, l_linenumber AS number, l_partkey AS part FROM lineitem",
    "record_encryption": "SELECT n_nationkey AS nationkey, n_name AS name, TRUE AS refused FROM nation",
    "hmac_filter": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey % 5 <> 0",
    "crc_known": "SELECT * FROM (VALUES @crcs) t(r_regionkey, crc)",
    "uuid_round_trip": "SELECT n_nationkey, regexp_replace(md5(n_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS u, 72 AS n FROM nation",
    "approximate": "SELECT TRUE AS distinct_near, TRUE AS sketch_near, TRUE AS median_near",
    "own_aggregate": "SELECT o_orderpriority AS priority, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority",
    "native_table": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10 OR s_nationkey >= 20",
    "box_overlap": "WITH b AS (SELECT c_custkey, lat AS y, lon AS x FROM @places p) SELECT a.c_custkey AS c_custkey, b.c_custkey AS r_c_custkey FROM b a JOIN b ON a.c_custkey % 100 = 0 AND a.y <= b.y + 1.5 AND b.y <= a.y + 1.5 AND a.x <= b.x + 2.5 AND b.x <= a.x + 2.5",
    "dialect_quoted_source": "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_custkey % 3 = 1 AND c_name GLOB 'Customer#0*[0-4]'",
}
ORACLE["box_overlap"] = ORACLE["box_overlap"].replace("@places", _PLACES)
# CRC-32 of "region-0" to "region-4", by the standard library.
ORACLE["crc_known"] = ORACLE["crc_known"].replace("@crcs", ", ".join(f"({i}, CAST({zlib.crc32(f'region-{i}'.encode())} AS BIGINT))" for i in range(5)))
#: name -> text of the embedded dialect, text for the oracle, record tables
DIALECT: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "dialect_aggregates": (
        'SELECT "nationkey" AS k, total(acctbal) AS t, group_concat(CAST(custkey AS STRING)) IS NOT NULL AS g, iif(count(*) > 50, 1, 0) AS many, typeof(max(name)) AS a, typeof(count(*)) AS b FROM Customer GROUP BY "nationkey"',
        "SELECT c_nationkey AS k, sum(c_acctbal) AS t, TRUE AS g, CASE WHEN count(*) > 50 THEN 1 ELSE 0 END AS many, 'text' AS a, 'integer' AS b FROM customer GROUP BY c_nationkey",
        ("Customer",),
    ),
    "dialect_functions": (
        "SELECT custkey, text_upper(segment) AS u, round(geo_distance(40.7128D, -74.006D, 38.9072D, -77.0369D), 3) AS km, fuzzy_leven(name, segment) AS d, json_extract('{\"a\":5}', '$.a') AS j, strftime('%Y/%m/%d %H:%M', TIMESTAMP '2024-03-01 05:06:07') AS s FROM Customer",
        "SELECT c_custkey AS custkey, upper(c_mktsegment) AS u, 327.583::DOUBLE AS km, CAST(levenshtein(c_name, c_mktsegment) AS INT) AS d, '5' AS j, '2024/03/01 05:06' AS s FROM customer",
        ("Customer",),
    ),
    "dialect_json_group": (
        "SELECT regionkey AS r, json_group_array(nationkey) IS NOT NULL AS a, json_group_object(name, nationkey) IS NOT NULL AS o FROM Nation GROUP BY regionkey",
        "SELECT n_regionkey AS r, TRUE AS a, TRUE AS o FROM nation GROUP BY n_regionkey",
        ("Nation",),
    ),
}
QUERIES |= {k: _dialect(v[0], *v[2]) for k, v in DIALECT.items()}
ORACLE |= {k: v[1] for k, v in DIALECT.items()}
# Letters to digits (vowels part equal ones, H and W do not), equal neighbours to one, without the first letter's.
_SOUNDEX = "translate(regexp_replace(upper(n_name), '[^A-Z]', 'A', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
_SOUNDEX = f"left({_SOUNDEX}, 1) || replace(substring({_SOUNDEX}, 2), '7', '')"
for _digit in "123456":
    _SOUNDEX = f"regexp_replace({_SOUNDEX}, '{_digit}+', '{_digit}', 'g')"
ORACLE["fn_soundex"] = f"SELECT n_name, upper(left(n_name, 1)) || rpad(left(regexp_replace(substring({_SOUNDEX}, 2), '[^1-6]', '', 'g'), 3), 3, '0') AS code FROM nation"
QUERIES |= {k: _packs(v[0], *v[2]) for k, v in PACKS.items()}
ORACLE |= {k: v[1] for k, v in PACKS.items()}
