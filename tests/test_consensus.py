"""Drops that wait for every source, against a plain machine that keeps whole histories."""

import datetime as dt
import json
import os
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from meterlake.operators import consensus as C


def reading(token, at, percent, key=10, raw=None):
    return {"kind": "reading", "token": token, "received_at": at, "percent": float(percent), "window_key": key, "raw": key * 100 if raw is None else raw}


def published(percent, key=10, generation=0, raw=1):
    return {"kind": "published", "percent": float(percent), "window_key": key, "raw": raw, "generation": generation}


def tick(at):
    return {"kind": "tick", "at": at}


def play(*rows):
    s = C.new_axis()
    return [d for r in rows if (d := C.take(s, r))], s


def actions(*rows):
    return [(d[0], d[1]) for d in play(*rows)[0]]


def test_a_newer_window_wins_over_a_higher_percent():
    for order in (1, -1):
        rows = [reading("a", 0, 90, key=9), reading("b", 0, 5, key=11)][::order]
        assert play(*rows, tick(1))[0] == [("publish", 5.0, 11, 1100, None, None)]
    assert actions(reading("a", 0, 90, key=9), published(5, key=10), tick(1)) == [("none", None)]


def test_a_drop_waits_for_every_contributor():
    rows = [published(50), reading("a", 0, 20), reading("b", 1, 15), tick(2), reading("a", 5, 20), tick(6), reading("b", 7, 15), tick(8)]
    assert actions(*rows) == [("write", None), ("write", None), ("publish", 20.0)]


def test_a_joining_contributor_needs_its_own_later_reading():
    rows = [published(50), reading("a", 0, 20), tick(1), reading("a", 2, 20), reading("b", 2, 10), tick(3), tick(4), reading("b", 5, 10), tick(6)]
    assert actions(*rows) == [("write", None), ("write", None), ("none", None), ("publish", 20.0)]


def test_a_higher_value_ends_a_wait_and_a_lower_rise_begins_another():
    assert actions(published(50), reading("a", 0, 20), tick(1), reading("b", 2, 60), tick(3)) == [("write", None), ("publish", 60.0)]
    rows = [published(50), reading("a", 0, 20), tick(1), reading("a", 2, 30), tick(3), tick(4), reading("a", 5, 30), tick(6)]
    assert actions(*rows) == [("write", None), ("write", None), ("none", None), ("publish", 30.0)]
    assert actions(published(50), reading("a", 0, 20), tick(1), reading("a", 2, 50), tick(3), tick(4)) == [("write", None), ("write", None), ("none", None)]


def test_two_tries_until_something_changes():
    rows = [published(50), reading("a", 0, 20), tick(1), reading("a", 2, 20), tick(3), tick(4), tick(5), published(50, generation=1), tick(6), published(45, generation=1), tick(7)]
    found, s = play(*rows)
    assert [(d[0], d[4], d[5]) for d in found] == [("write", "settling", 0), ("publish", "ready", 1), ("publish", "suppressed", 2), ("none", "suppressed", 2), ("publish", "ready", 1), ("publish", "ready", 1)]
    found, _ = play(published(50), reading("a", 0, 0), tick(1), reading("a", 2, 0), tick(3), tick(4), reading("b", 5, 55), tick(6))
    assert [(d[0], d[4]) for d in found] == [("write", "settling"), ("publish", "zero"), ("publish", "suppressed"), ("publish", None)]


def test_tombstones_and_the_activity_window():
    stone = lambda state, through=None: {"kind": "tombstone", "state": state, "through": through}
    assert actions(reading("a", 0, 20), stone("inflight"), tick(1), stone("committed", 0), tick(2), reading("b", 1, 30), tick(3), stone("none"), tick(4)) == [("none", None), ("none", None), ("publish", 30.0), ("publish", 30.0)]
    assert actions(published(50), reading("a", 0, 20), tick(1), tick(89), tick(90), tick(91)) == [("write", None), ("none", None), ("write", None), ("none", None)]
    assert actions(reading("a", 10, 20), tick(4), tick(5)) == [("none", None), ("publish", 20.0)]


def plain(rows):
    """At each tick all is found anew from the whole history but for what waits, which is a tuple."""
    out, wait = [], None
    for n, row in enumerate(rows):
        if row["kind"] != "tick":
            continue
        past, now = rows[:n], row["at"]
        latest = {}
        for r in past:
            if r["kind"] == "reading":
                latest[r["token"]] = r
        public = ([r for r in past if r["kind"] == "published"] or [None])[-1]
        stone = ([r for r in past if r["kind"] == "tombstone"] or [{"state": "none"}])[-1]
        live = {t: r for t, r in latest.items() if now - 90 < r["received_at"] <= now + 5 and stone["state"] != "inflight" and not (stone["state"] == "committed" and stone["through"] is not None and r["received_at"] <= stone["through"])}
        action, told = "none", (None, None, None)
        if not live:
            action, wait = ("write" if wait else "none"), None
        else:
            key = max(r["window_key"] for r in live.values())
            inside = {t: r for t, r in live.items() if r["window_key"] == key}
            high = max(r["percent"] for r in inside.values())
            order = 1 if public is None else (key, high) > (public["window_key"], public["percent"]) if key != public["window_key"] else None
            raw = public["raw"] if public and public["window_key"] == key else min(r["raw"] for r in inside.values() if r["percent"] == high)
            if order is not None:
                if order:
                    action, told, wait = "publish", (high, key, raw), None
            elif high >= public["percent"]:
                if high > public["percent"]:
                    action, told = "publish", (high, key, raw)
                else:
                    action = "write" if wait else "none"
                wait = None
            elif wait is None or wait[0] != key or high > wait[1]:
                action, wait = "write", (key, high, "settling", 0, None, tuple(sorted((t, r["received_at"], False) for t, r in inside.items())))
            else:
                base = {t: (b, c) for t, b, c in wait[5]}
                people = tuple(sorted((t, base[t][0], base[t][1] or r["received_at"] > base[t][0]) if t in base else (t, r["received_at"], False) for t, r in inside.items()))
                sign = (key, high, public["window_key"], public["percent"], public["generation"])
                was, wait = wait, (*wait[:5], people)
                if all(c for *_, c in people):
                    if was[2] == "settling" or was[4] != sign:
                        action, told, wait = "publish", (high, key, raw), (key, was[1], "ready" if high else "zero", 1, sign, people)
                    elif was[2] != "suppressed":
                        action, told, wait = "publish", (high, key, raw), (key, was[1], "suppressed", 2, sign, people)
                if action == "none" and wait != was:
                    action = "write"
        out.append((action, *told, wait[2] if wait else None, wait[3] if wait else None))
    return out


def random_trace(rng, n):
    rows, now = [], 0
    for _ in range(n):
        now += rng.choice([0, 1, 2, 5, 40])
        kind = rng.random()
        if kind < 0.45:
            rows.append(reading(rng.choice("abc"), now + rng.choice([0, 0, 0, 3, 9, -30]), rng.choice([0, 10, 20, 30, 40]), key=rng.choice([9, 10, 10, 10, 11]), raw=rng.randrange(5)))
        elif kind < 0.55:
            rows.append(published(rng.choice([0, 20, 30, 40, 40]), key=rng.choice([10, 10, 10, 11]), generation=rng.randrange(2), raw=rng.randrange(9)))
        elif kind < 0.62:
            rows.append({"kind": "tombstone", "state": rng.choice(["inflight", "committed", "none", "none"]), "through": rng.choice([None, now, now - 5])})
        else:
            rows.append(tick(now))
    return rows


def test_random_traces_equal_the_plain_machine():
    kinds = set()
    for seed in range(400):
        rows = random_trace(random.Random(seed), 60)
        got = play(*rows)[0]
        assert got == plain(rows), seed
        kinds |= {(d[0], d[4]) for d in got}
    assert {("publish", "ready"), ("publish", "suppressed"), ("publish", "zero"), ("write", "settling"), ("none", "suppressed")} <= kinds


@pytest.fixture
def traces():
    rows = [(axis, i, r) for axis in range(5) for i, r in enumerate(random_trace(random.Random(axis), 80))]
    names = [c.split()[0] for c in C.TRACE.split(", ")]
    return [tuple({"axis": a, "seq": i, **r}.get(n) for n in names) for a, i, r in rows]


def test_batch_and_stream_equal_the_machine(spark, traces, tmp_path):
    df = spark.createDataFrame(traces, C.TRACE)
    got = sorted(map(str, C.decisions(df.unionByName(df.limit(1).selectExpr("cast(null as long) as axis", *df.columns[1:]))).collect()))
    plainly = sorted(str((axis, *d)) for axis in range(5) for d in plain(random_trace(random.Random(axis), 80)))
    assert sorted(str((r["axis"], r["action"], r["percent"], r["window_key"], r["raw"], r["stage"], r["tries"])) for r in C.decisions(df).collect()) == plainly
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo in range(0, 80, 30):
            df.where(f"seq >= {lo} and seq < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            s = spark.readStream.schema(C.TRACE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            C.stream_decisions(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    assert sorted(map(str, spark.read.schema(C.DECISION).parquet(str(tmp_path / "out")).collect())) == got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_query_equals_the_plain_machine(spark):
    from meterlake.plans import catalogue

    traces = defaultdict(list)
    events = pq.read_table("/root/testdata/sf0.001/events.parquet").to_pylist()
    for e in sorted(events, key=lambda e: e["event_id"]):
        k, at, i = json.loads(e["props"])["k"], int(e["ts"].replace(tzinfo=dt.UTC).timestamp()), e["event_id"]
        week, percent, rows = at // 604_800, float(k % 6 * 10), traces[e["user_id"] % 9]
        rows.append((i * 4, reading(f"s{e['user_id'] % 4}", at, percent, key=week, raw=week * 10 + k % 3)))
        if e["event_type"] == "purchase":
            rows.append((i * 4 + 1, published(percent, key=week, generation=i % 3, raw=week * 10)))
        if e["event_type"] == "error":
            rows.append((i * 4 + 2, {"kind": "tombstone", "state": ["inflight", "committed", "none"][k % 3], "through": at - 20}))
        rows.append((i * 4 + 3, tick(at)))
    want = []
    for axis, rows in traces.items():
        ticks = [seq for seq, r in rows if r["kind"] == "tick"]
        want += [(axis, seq, *d) for seq, d in zip(ticks, plain([r for _, r in rows]))]
    assert sorted(map(str, (tuple(r) for r in catalogue.QUERIES["pending_drops"](spark, "/root/testdata/sf0.001").collect()))) == sorted(map(str, want))
