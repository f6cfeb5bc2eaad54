from pyspark.sql import functions as F

from rillstore.streaming import streams
from tests.test_schema_codec import USER
from tests.test_store import users


def test_incremental_with_restart(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    f = src / "a.bin"
    for i in range(5):
        batch = users(20, 20 * i)
        with f.open("ab") as h:
            h.write(batch[:-5])
        streams.append_to(streams.records(spark, str(src), USER, "User", "USER", "s1"), out, state).awaitTermination()
        assert spark.read.parquet(out).count() == 20 * i + 19  # the half-written frame waits
        with f.open("ab") as h:
            h.write(batch[-5:])
        streams.append_to(streams.records(spark, str(src), USER, "User", "USER", "s1"), out, state).awaitTermination()
        assert spark.read.parquet(out).count() == 20 * (i + 1)
    got = spark.read.parquet(out)
    assert sorted(r[0] for r in got.select("id").collect()) == list(range(100))
    assert sorted(r[0] for r in got.select("_rowid").collect()) == list(range(1, 101))


def test_many_sources_and_counts(spark, tmp_path):
    paths = {}
    for s, n in (("a", 3), ("b", 5)):
        (tmp_path / s).mkdir()
        (tmp_path / s / "x.bin").write_bytes(users(n))
        paths[s] = str(tmp_path / s)
    q = streams.counts(streams.sources(spark, paths, USER, "User", "USER")).writeStream.outputMode("complete").format("memory").queryName("tally").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r[0]: r[1] for r in spark.sql("SELECT * FROM tally").collect()} == {"a": 3, "b": 5}


def test_windows_in_batch(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 02:00:00")], "u int, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n"] for r in streams.windowed(df, "ts", "1 hour").collect()) == [1, 2]
    assert sum(r["n"] for r in streams.windowed(df, "ts", "2 hours", "1 hour").collect()) == 6
    assert sorted((r["u"], r["n"]) for r in streams.sessions(df, "ts", "10 minutes", "u").collect()) == [(1, 1), (1, 1), (2, 1)]
