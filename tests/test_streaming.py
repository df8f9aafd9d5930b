"""Streams: pulled rows replay, arms live in state, counts and windows go on over batches."""

import pytest
from pyspark.sql import functions as F

from quillstone.streaming import online, pull, sampler


def run(stream, name, spark, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.table(name).collect()


def test_pulled_rows_are_the_same_on_every_read(spark, tmp_path):
    spark.dataSource.register(pull.PullSource)
    reader = pull.PulledRows({"words": "x y z", "rows": "7", "most": "20"})
    at, rows = reader.initialOffset(), []
    for _ in range(5):
        got, end = reader.read(at)
        got = list(got)
        assert got == list(reader.readBetweenOffsets(at, end))
        rows, at = rows + got, end
    assert [n for n, _ in rows] == list(range(20)) and at == {"n": 20} and len({t for _, t in rows}) > 3
    stream = spark.readStream.format("corruptions").options(words="x y z", rows="7", most="20").load()
    q = stream.writeStream.format("memory").queryName("pulled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted((r["n"], r["text"]) for r in spark.table("pulled").collect()) == rows
    finally:
        q.stop()


def test_arms_by_their_bounds():
    got = sampler.ranked("k", [("a", 10, 9), ("b", 10, 1), ("c", 1, 0)], 2)
    assert [r[1] for r in got] == ["c", "a"] and sum(r[5] for r in got) == pytest.approx(1, abs=1e-5)


def test_adaptive_sampler_keeps_its_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(2):
            spark.createDataFrame([("g", "a", True), ("g", "b", i == 0), ("h", "a", False)], "key string, arm string, hit boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, arm string, hit boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = run(sampler.adaptive(stream, "key"), "arms", spark, tmp_path, "update")
        last = {}
        for r in rows:
            last[r["key"], r["arm"]] = max(last.get((r["key"], r["arm"]), (0, 0)), (r["tries"], r["hits"]))
        assert last == {("g", "a"): (2, 2), ("g", "b"): (2, 1), ("h", "a"): (2, 0)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_running_hits_and_windows(spark, tmp_path):
    rows = [(i % 2, i, f"2024-01-01 00:{i:02d}:00") for i in range(10)]
    spark.createDataFrame(rows, "g int, v int, ts string").selectExpr("g", "v", "cast(ts as timestamp) ts").repartition(3).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema("g int, v int, ts timestamp").parquet(str(tmp_path / "e"))
    got = run(online.running_hits(stream(), "g", F.col("v") > 4), "hits", spark, tmp_path, "complete")
    assert sorted((r["g"], r["hits"], r["total"]) for r in got) == [(0, 2, 5), (1, 3, 5)]
    got = run(online.tumbling(stream(), "ts", "5 minutes", "1 minute", "g"), "windows", spark, tmp_path, "complete")
    assert sorted(r["n"] for r in got) == [2, 2, 3, 3]
    assert len(run(online.seen_once(stream().unionByName(stream()), "ts", "1 hour", "v"), "once", spark, tmp_path)) == 10
