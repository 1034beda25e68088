"""Streams give what batches give."""

import datetime as dt
import json

from pyspark.sql import functions as F

from meterlake.sources.tables import classify_usage_lines, read_lines, read_usage
from meterlake.streaming import ingest


def line(i, **more):
    return {"type": "assistant", "timestamp": f"2024-01-01T{i % 24:02d}:00:00Z", "requestId": f"r{i}", "sessionId": f"s{i % 3}", "message": {"id": f"m{i}", "model": "click", "usage": {"input_tokens": i, "output_tokens": 1}}} | more


def write(path, lines):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def test_gates_name_the_first_reason(spark, tmp_path):
    bad = [line(1), "not json", line(2, type="user"), line(3, timestamp=""), line(4, message={"id": "x", "model": "m"}), line(5, message={"usage": {"input_tokens": 1}}),
           line(6, message={"model": "<synthetic>", "usage": {"input_tokens": 1}}), line(7, timestamp="yesterday")]
    write(tmp_path / "a.jsonl", bad)
    got = sorted(str(r[0]) for r in classify_usage_lines(read_lines(spark, str(tmp_path))).select("skip_reason").collect())
    assert got == ["None", "bad_timestamp", "malformed", "model", "synthetic", "timestamp", "type", "usage"]


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in range(3):
        write(src / f"{n}.jsonl", [line(i) for i in range(n * 10, n * 10 + 10)])
    stream = ingest.stream_usage(spark, str(src), 1)
    q = stream.writeStream.foreachBatch(ingest.insert_absent_sink(str(out), ["msg_id", "req_id"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["msg_id"], r["input_tokens"], r["ts"]) for r in df.collect())
    assert key(spark.read.parquet(str(out))) == key(read_usage(spark, str(src)))


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = ingest.insert_absent_sink(path, ["k"], buckets=4)
    rows = lambda lo, hi: spark.createDataFrame([(i, f"v{i}") for i in range(lo, hi)], "k long, v string")
    for lo, hi in ((0, 0), (0, 50), (0, 50), (30, 80)):
        sink(rows(lo, hi), 0)
    got = spark.read.parquet(path)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(i, f"v{i}") for i in range(80)] and got.select("_bucket").distinct().count() == 4


def test_windowed_cost(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 30), "m", 1.5) for h in (0, 0, 1)], "ts timestamp, model string, cost double")
    got = {r["start"].hour: (r["cost_usd"], r["entries"]) for r in ingest.windowed_cost(df).collect()}
    assert got == {0: (3.0, 2), 1: (1.5, 1)}


def test_debounce_stream(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [(1, i, p) for i, p in enumerate([50.0, 80.0, 10.0, 20.0, 1.0, 2.0, 20.0, 0.5, 18.0])]
    df = spark.createDataFrame(rows, "k long, seq long, percent double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    df.select("k", "ts", "seq", "percent").coalesce(1).write.parquet(path)
    s = spark.readStream.schema("k long, ts timestamp, seq long, percent double").parquet(path)
    q = ingest.debounce(s, "k").writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["seq"], r["action"]) for r in spark.table("debounced").orderBy("seq").collect()] == [(2, "fire"), (4, "arm"), (5, "confirm"), (7, "arm"), (8, "clear")]


def test_partials_of_batches_equal_one_rollup(spark, tmp_path):
    from meterlake.streaming import incremental

    src, out = tmp_path / "in", str(tmp_path / "parts")
    src.mkdir()
    for n in range(4):
        write(src / f"{n}.jsonl", [line(i) for i in range(n * 7, n * 7 + 9)])
    roll = lambda df: df.groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.count("*").alias("n"))
    q = ingest.stream_usage(spark, str(src), 1).writeStream.foreachBatch(incremental.partials_sink(out, roll)).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("session_id", "input_tokens", "n").collect()))
    want = rows(roll(read_usage(spark, str(src))))
    assert rows(incremental.read_partials(spark, out, ["session_id"], ["input_tokens", "n"])) == want
    incremental.compact_partials(spark, out, str(tmp_path / "one"), ["session_id"], ["input_tokens", "n"])
    assert rows(incremental.read_partials(spark, str(tmp_path / "one"), ["session_id"], ["input_tokens", "n"])) == want


def test_refresh_computes_touched_keys_only(spark):
    from meterlake.streaming import incremental

    old = spark.createDataFrame([(1, 1.0), (2, 5.0)], "k long, v double")
    new = spark.createDataFrame([(2, 7.0)], "k long, v double")
    median = lambda df: df.groupBy("k").agg(F.median("v").alias("m"))
    got = incremental.refresh(median(old), old.unionByName(new), new, ["k"], median)
    assert sorted(map(tuple, got.collect())) == [(1, 1.0), (2, 6.0)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, d string"), spark.createDataFrame([(2, "z"), (3, "w"), (1, "x")], "k long, d string")
    assert sorted(r[0] for r in incremental.alert_scope(a, b, ["k"], "d").collect()) == [2, 3]


def test_high_water_stream(spark, tmp_path):
    from meterlake.streaming import incremental

    path = str(tmp_path / "s")
    for n, part in enumerate([[10.04, 30.0], [20.0, 31.26]]):
        df = spark.createDataFrame([(1, n * 2 + i, p) for i, p in enumerate(part)], "k long, seq long, percent double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
        df.select("k", "ts", "seq", "percent").coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("k long, ts timestamp, seq long, percent double").option("maxFilesPerTrigger", 1).parquet(path)
    q = incremental.high_water(s, "k").writeStream.format("memory").queryName("high").option("checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["clamped"] for r in spark.table("high").orderBy("seq").collect()] == [10.0, 30.0, 30.0, 31.3]
