"""Evaluations of a stream with timers against those of a batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import alerts
from meterlake.streaming import alerts as stream

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def random_changes(rng, n):
    rows = []
    for seq in range(n):
        t, kind = rng.randrange(0, 60), rng.choice(["observation"] * 5 + ["gate", "gate", "rule"])
        value = {"gate": rng.choice(["open", "open", "closed"]), "rule": rng.choice(["50", "20,80", "90"])}.get(kind)
        o = kind == "observation"
        rows.append((rng.randrange(3), at(t), seq, kind, value, float(rng.randrange(100)) if o else None, at(t + rng.choice([-5, 0, 1, 3, 20])) if o else None))
    return rows


def told(rows):
    return sorted(((r["root"], r["at"], r["reason"], r["percent"], r["crossed"]) for r in rows), key=str)


def run(spark, path, cp, name):
    s = spark.readStream.schema(alerts.CHANGE).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.stream_evaluations(s, "10 hours").writeStream.format("parquet").option("path", name).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_changes(rng, 120)
    # in batches that overlap by less than the watermark's delay; the last moves the watermark past all
    batches = [[r for r in rows if r[1] + dt.timedelta(hours=(r[2] * 7) % 9) < at(60)], [r for r in rows if r[1] + dt.timedelta(hours=(r[2] * 7) % 9) >= at(60)], [(9, at(200), 0, "gate", "closed", None, None)]]
    path = str(tmp_path / "in")
    for i, b in enumerate(batches):
        if b:
            spark.createDataFrame(b, alerts.CHANGE).coalesce(1).write.mode("append").parquet(path)
        run(spark, path, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = told(spark.read.schema(stream.OUT).parquet(str(tmp_path / "out")).collect())
    want = told(alerts.evaluations(spark.createDataFrame(rows, alerts.CHANGE), F.lit(at(190))).collect())
    assert got == want and {r[2] for r in want} == {"gate_enabled", "gate_disabled", "rule_changed", "window_dirty", "scheduled"}


def test_a_root_without_new_rows_is_evaluated_when_its_instant_comes(spark, tmp_path):
    path = str(tmp_path / "in")
    step = lambda *rows: (spark.createDataFrame(list(rows), alerts.CHANGE).coalesce(1).write.mode("append").parquet(path), run(spark, path, str(tmp_path / "cp"), str(tmp_path / "out")))
    reasons = lambda root: [(r["at"], r["reason"], r["percent"], r["crossed"]) for r in spark.read.schema(stream.OUT).parquet(str(tmp_path / "out")).where(F.col("root") == root).orderBy("at").collect()]
    step((1, at(0), 0, "gate", "open", None, None), (1, at(1), 1, "rule", "50,80", None, None), (1, at(2), 2, "observation", None, 85.0, at(30)), (2, at(0), 3, "gate", "open", None, None), (2, at(1), 4, "observation", None, 60.0, at(30)), (2, at(3), 5, "gate", "closed", None, None))
    step((7, at(25), 6, "gate", "open", None, None))
    assert [r[1] for r in reasons(1)] == ["gate_enabled", "rule_changed", "window_dirty"]
    step((7, at(50), 7, "gate", "closed", None, None))  # the clock moves on; roots 1 and 2 have no rows
    assert reasons(1)[-1] == (at(30), "scheduled", 85.0, 2)
    assert [r[1] for r in reasons(2)] == ["gate_enabled", "window_dirty", "gate_disabled"]  # disarmed


def test_a_changed_rule_and_an_opened_gate_arm_again():
    us = lambda h: int(at(h).replace(tzinfo=dt.UTC).timestamp() * 1e6)
    c = lambda h, seq, kind, value=None, percent=None, capture=None: {"at": us(h), "seq": seq, "kind": kind, "value": value, "percent": percent, "capture_at": capture and us(capture)}
    s = stream.new_root()
    s["waiting"] = [c(0, 0, "gate", "open"), c(1, 1, "observation", None, 40.0, 9), c(2, 2, "gate", "closed"), c(4, 3, "gate", "open"), c(5, 4, "rule", "30"), c(6, 5, "rule", "30")]
    assert [(r[1], r[3]) for r in stream.advance(s, us(8))] == [("gate_enabled", 0), ("window_dirty", 0), ("gate_disabled", None), ("gate_enabled", 0), ("rule_changed", 0)]
    assert [(r[0], r[1], r[2], r[3]) for r in stream.advance(s, us(10))] == [(us(9), "scheduled", 40.0, 1)] and stream.advance(s, us(99)) == []
