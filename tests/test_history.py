"""Cycles, milestones of segments, and refreshes after changes."""

import random

from pyspark.sql import functions as F

from meterlake.operators import history
from meterlake.streaming import incremental


def test_the_latest_cycle_counts(spark):
    rng = random.Random(2)
    cycles = [(a, f"k{i}", s, s + rng.randrange(1, 60)) for a in range(5) for i in range(12) for s in [rng.randrange(0, 100)]]
    df = spark.createDataFrame(cycles + [(9, "a", 0, 100), (9, "b", 20, 40)], "account long, key string, start long, end long")
    got = history.physical_cycles(df, unit=13).collect()
    owner = {}
    for r in got:
        for x in range(r["piece"], r["piece_end"]):
            assert (r["account"], x) not in owner
            owner[r["account"], x] = (r["start"], r["end"], r["key"])
    want = {}
    for a in range(5):
        for x in range(0, 170):
            over = [(s, e, k) for b, k, s, e in cycles if a == b and s <= x < e]
            if over:
                want[a, x] = max(over)
    assert {k: v for k, v in owner.items() if k[0] < 9} == want
    # a cycle inside another leaves it two pieces
    assert sorted((r["key"], r["piece"], r["piece_end"]) for r in got if r["account"] == 9) == [("a", 0, 20), ("a", 40, 100), ("b", 20, 40)]
    pieces = len([1 for r in got if r["account"] < 5])
    runs = sum(want.get((a, x)) != want.get((a, x - 1)) and (a, x) in want for a in range(5) for x in range(170))
    assert pieces == runs


def test_cycles_are_cut_at_resets_inside(spark):
    kept = spark.createDataFrame([(1, "w", 10, 50), (1, "w", 5, 40), (1, "w", 7, 7), (1, "v", None, 9)], "account long, key string, start long, end long")
    resets = spark.createDataFrame([(1, "w", 20), (1, "w", 20), (1, "w", 5), (1, "w", 50), (1, "v", 8)], "account long, key string, at long")
    assert sorted(map(tuple, history.logical_cycles(kept, resets).collect())) == [(1, "w", 5, 20), (1, "w", 20, 50)]


def test_each_planted_violation_is_found(spark):
    costs = spark.createDataFrame([(1, t, 10 ** (t // 10)) for t in range(0, 100, 10)] + [(2, 5, 7)], "account long, at long, nano long")
    resets = spark.createDataFrame([(1, 11, 30), (1, 12, 60)], "account long, reset_id long, at long")
    good = [(1, 1, 25, 111, 0), (1, 2, 30, 1000, 11), (1, 3, 59, 111_000, 11), (1, 4, 60, 1_000_000, 12), (1, 5, 99, 1_111_000_000, 12), (2, 6, 5, 7, 0), (2, 7, 4, 0, None)]
    schema = "account long, id long, at long, nano long, reset_id long"
    found = lambda rows: sorted(map(tuple, history.milestone_violations(spark.createDataFrame(rows, schema), resets, costs).collect()))
    assert found(good) == []
    bad = [(1, 1, 25, 112, 0), (1, 2, 30, 1000, 0), (1, 3, 59, 111_000, 12), (1, 4, 60, 1_000_000, 13), (2, 6, 5, 7, 11), (1, 8, 99, None, 12)]
    assert found(bad) == [(1, "cost"), (2, "segment"), (3, "segment"), (4, "unknown_reset"), (6, "unknown_reset"), (8, "cost")]
    none = history.milestone_violations(spark.createDataFrame(good, schema), resets.where("false"), costs).collect()
    assert {r["id"] for r in none} == {2, 3, 4, 5}


def test_running_totals_need_no_whole_key(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(0, 5000), i, rng.randrange(-9, 9)) for i in range(600) for k in [i % 2]]
    df = spark.createDataFrame(rows, "k long, at long, i long, v long")
    got = {r["i"]: r["t"] for r in history.running(df, ["k"], ["at", "i"], "at", "v", "t", unit=100).collect()}
    for k in (0, 1):
        total = 0
        for _, at, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            total += v
            assert got[i] == total


def test_old_and_new_images_dirty_their_groups(spark):
    rows = spark.createDataFrame([(i, i % 4, float(i)) for i in range(40)] + [(90, None, 1.0)], "id long, g long, v double")
    image = "struct<id:long,g:long,v:double>"
    feed = spark.createDataFrame([((0, 0, 0.0), (0, 7, 0.0)), ((1, 1, 1.0), None), (None, (50, None, 5.0)), ((7, 3, 7.0), (7, 3, 8.0))], f"before {image}, after {image}")
    assert sorted((r["g"] is None, r["g"] or 0) for r in incremental.dirty_groups(feed, ["g"]).collect()) == [(False, 0), (False, 1), (False, 3), (False, 7), (True, 0)]
    seen = []

    def compute(df):
        seen.append(df)
        return df.groupBy("g").agg(F.count("*").alias("n"), F.median("v").alias("m"))

    now = incremental.apply_feed(rows, feed, "id")
    got = incremental.refresh_groups(compute(rows), now, feed, ["g"], compute)
    assert sorted(map(str, got.collect())) == sorted(map(str, compute(now).collect()))
    assert {r["g"] for r in seen[1].collect()} == {0, 1, 3, 7, None}
    gone = spark.createDataFrame([((i, i % 4, float(i)), None) for i in range(2, 40, 4)], f"before {image}, after {image}")
    assert {r["g"] for r in incremental.refresh_groups(compute(rows), incremental.apply_feed(rows, gone, "id"), gone, ["g"], compute).collect()} == {0, 1, 3, None}
