import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from rillstore.functions import fuzzy, geo, json_edit, ranks, security, sql


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    return spark


@pytest.mark.parametrize(
    "text, want",
    [
        ("sqrt(4)", 2.0), ("text_upper('hello')", "HELLO"), ("text_lower('WORLD')", "world"), ("text_length('test')", 4), ("fuzzy_leven('kitten','sitting')", 3),
        ("text_slice('hello', 2, -1)", "ell"), ("text_slice('hello', -3)", "llo"), ("text_substring('hello', 2, 2)", "el"), ("text_last_index('hello', 'l')", 4),
        ("text_left('hello', -2)", "hel"), ("text_right('hello', 2)", "lo"), ("text_trim('xxaxx', 'x')", "a"), ("text_count('banana', 'an')", 2), ("text_split('a-b-c', '-', 2)", "b"),
        ("text_like('a%', 'ABC')", 1), ("like_nocase('50% Off', '50\\\\% Off')", False), ("div_int(7, 2)", 3), ("div_int(1, 0)", None), ("mod_safe(7, 0)", None), ("to_int_loose('12abc')", 12),
        ("sqrt_safe(-1)", None), ("ln_safe(0)", None), ("max_of(1, NULL)", None), ("trunc_num(2.9)", 2), ("uuid_str(uuid_blob('00112233-4455-6677-8899-aabbccddeeff'))", "00112233-4455-6677-8899-aabbccddeeff"),
        ("substring(uuid7(), 15, 1)", "7"), ("julianday(timestamp'2000-01-01 12:00:00')", 2451545.0), ("json_valid('{x')", 0), ("json_quote('a\"b')", '"a\\"b"'), ("quote_text('it''s')", "'it''s'"),
        ("fuzzy_damlev('ab', 'ba')", 1), ("fuzzy_damlev('ca', 'abc')", 2), ("fuzzy_osadist('ca', 'abc')", 3), ("round(fuzzy_jarowin('MARTHA', 'MARHTA'), 4)", 0.9611), ("fuzzy_hamming('abc', 'abd')", 1),
        ("fuzzy_hamming('a', 'ab')", -1), ("fuzzy_caver('Thompson')", "TMPSN11111"), ("fuzzy_translit('Straße é 日')", "Strasse e ?"), ("fuzzy_soundex('Robert')", "R163"), ("fuzzy_leven(NULL, 'a')", None),
        ("json_set('{\"a\":1}', '$.b', json('[1,2]'))", '{"a":1,"b":[1,2]}'), ("json_insert('{\"a\":1}', '$.a', '2')", '{"a":1}'), ("json_replace('{\"a\":1}', '$.b', '2')", '{"a":1}'),
        ("json_set('[1,2]', '$[#]', 3)", "[1,2,3]"), ("json_remove('[1,2,3]', '$[#-1]')", "[1,2]"), ("json_patch('{\"a\":1}', '{\"a\":null,\"c\":3}')", '{"c":3}'), ("json_set('x', '$.a', '1')", None),
    ],
)
def test_sql_functions(registered, text, want):
    got = registered.sql(f"SELECT {text}").first()[0]
    assert got == want, text


def test_json_tree():
    assert json_edit.tree({"a": [1]}) == [("$", None, '{"a":[1]}'), ("$.a", "a", "[1]"), ("$.a[0]", "0", "1")]


def test_geo(spark):
    d = spark.range(1).select(geo.geo_distance(F.lit(40.7128), F.lit(-74.0060), F.lit(38.9072), F.lit(-77.0369)).alias("km"), geo.geo_distance(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("n"))
    r = d.first()
    assert abs(r["km"] - 327.5827) < 1e-3 and r["n"] is None


def test_geo_join_is_exact_everywhere(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([rng.uniform(-90, 90), 89.9, -89.95, rng.uniform(-1, 1)]), rng.choice([rng.uniform(-180, 180), 179.99, -179.99, 0.0])) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    for km in (30.0, 900.0, 25000.0):
        want = df.crossJoin(df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])).filter(geo.geo_distance(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= km)
        got = geo.geo_join(df, df, km)
        assert sorted(map(tuple, got.select("id", "r_id").collect())) == sorted(map(tuple, want.select("id", "r_id").collect()))


def test_geo_and_box_joins_broadcast_no_cells(spark):
    a = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS lat", "CAST(id * 3 AS DOUBLE) AS lon")
    b = a.selectExpr("id", "lon AS min_x", "lon + 1 AS max_x", "lat AS min_y", "lat + 1 AS max_y")
    for df in (geo.geo_join(a, a, 500.0), geo.box_join(b, b, 2.0)):
        assert "SortMergeJoin" in (plan := df._jdf.queryExecution().sparkPlan().toString()) and "Broadcast" not in plan


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_exact_percentile(spark, p):
    own = spark.range(0, 997, 1, 7).select(((F.col("id") * 7919) % 101 / 7).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    got = ranks.exact_percentile(own, "x", p, "m")
    assert got.columns == ["m"] and got.first()[0] == pytest.approx(own.agg(F.expr(f"percentile(x, {p}D)")).first()[0], abs=1e-12)
    assert ranks.exact_percentile(own.filter("x is null"), "x", p).first()[0] is None


def test_fuzzy_join_is_exact(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    a, b = spark.createDataFrame([(w,) for w in words[:30]], "x string"), spark.createDataFrame([(w,) for w in words[30:]], "y string")
    want = a.crossJoin(b).filter(F.levenshtein("x", "y") <= 1)
    got = fuzzy.fuzzy_join(a, b, ("x", "y"), 1)
    assert sorted(map(tuple, got.select("x", "y").collect())) == sorted(map(tuple, want.collect()))


def test_fuzzy_join_broadcasts_no_pieces_and_deals_out_common_strings(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "GROUP", 7)
    a = spark.createDataFrame([(i, w) for i, w in enumerate(["steel", "ste_el", None, "steal", "x"] * 2)], "i int, x string")
    b = spark.createDataFrame([(j, "steel" if j < 60 else None if j < 62 else f"w{j}") for j in range(70)], "j int, y string")
    got = fuzzy.fuzzy_join(a, b, ("x", "y"), 1)
    assert got.columns == ["i", "x", "j", "y", "distance"]
    want = a.crossJoin(b).withColumn("distance", F.levenshtein("x", "y")).filter("distance <= 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 360
    lines = got._jdf.queryExecution().sparkPlan().toString().splitlines()  # before AQE: what the estimates chose
    joins = [x for x in lines if "Join" in x]
    assert sum("BroadcastHashJoin" in x for x in joins) == 1 and sum("SortMergeJoin" in x for x in joins) == 3


def test_hmac(spark):
    key, data = bytes(range(1, 33)), bytes(range(1, 11))
    mac = hmac.new(key, data, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(bytearray(data), mac), (bytearray(data[:-1] + b"x"), mac), (None, mac)], "_data binary, _mac string")
    assert [r[0] for r in df.select(security.hmac_sha256(F.col("_data"), key)).collect()][0] == mac
    assert security.verified(df, key).count() == 1
    long_key = b"k" * 100
    assert df.select(security.hmac_sha256(F.col("_data"), long_key)).first()[0] == hmac.new(long_key, data, hashlib.sha256).hexdigest()


def test_record_encryption(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "_data binary")
    key = bytes(32)
    sealed = security.encrypt_records(df, key)
    assert bytes(security.decrypt_records(sealed, key).first()[0]) == b"abc"
    assert security.decrypt_records(df, key).first()[0] is None


def test_phonetics():
    assert fuzzy.refined_soundex("testing") == "T6036084" and fuzzy.refined_soundex("12") == ""
    assert fuzzy.caverphone("Stevenson") == "STFNSN1111" and fuzzy.caverphone("") == ""
    assert fuzzy.jaro_winkler("", "a") == 0.0 and fuzzy.osa_distance("", "abc") == 3
