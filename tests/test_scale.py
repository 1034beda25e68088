"""Operators whose work must not grow with the square of a key's history, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import attribution, blocks, events, intervals, quota, ranks, reports, weeks
from meterlake.sources import logs

DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def brute_blocks(hours, length=5):
    out = []
    for h in sorted(hours):
        if not out or h >= out[-1][0] + length:
            out.append([h, 0])
        out[-1][1] += 1
    return out


def test_a_key_with_very_many_active_hours(spark):
    rng = random.Random(1)
    hours = sorted(rng.sample(range(260_000), 100_000))  # three gaps of five hours in a thousand and long unbroken stretches
    e = spark.createDataFrame([(h,) for h in hours], "h long").select(F.lit(1).alias("key"), F.timestamp_seconds(F.col("h") * 3600 + 59).alias("ts"))
    got = sorted(tuple(r) for r in blocks.fixed_blocks(e, ["key"]).select((F.unix_seconds("start") / 3600).cast("long"), "entries").collect())
    assert got == [tuple(b) for b in brute_blocks(hours)]
    assert blocks.fixed_blocks(e, []).count() == len(got) and blocks.fixed_blocks(e.where("false"), ["key"]).count() == 0


def brute_schedule(windows, length):
    xs = sorted(windows)
    best, take = [0], []
    for i, x in enumerate(xs):
        p = sum(1 for y in xs[:i] if y <= x - length)
        with_x = best[p] + windows[x]
        take.append(with_x >= best[-1])
        best.append(max(best[-1], with_x))
    out, i = [], len(xs) - 1
    while i >= 0:
        if take[i]:
            out.append(xs[i])
            i = sum(1 for y in xs if y <= xs[i] - length) - 1
        else:
            i -= 1
    return sorted(out)


def test_schedules(spark):
    rng = random.Random(2)
    for span in (200, 4000):
        w = {x: rng.randrange(1, 6) for x in rng.sample(range(span), 150)}
        df = spark.createDataFrame([(1, x, n) for x, n in w.items()], "key long, x long, weight long")
        assert sorted(r["x"] for r in blocks.schedule(df, ["key"], 30).collect()) == brute_schedule(w, 30)


@pytest.mark.parametrize("unit", [700, 86_400, 10**9])
def test_canonical_keys_are_carried_from_stretch_to_stretch(spark, unit):
    rng = random.Random(unit)
    rows, t, reset = [], 0, 10_000
    for i in range(400):
        t += rng.choice([5, 60, 900, 5000])
        reset += rng.choice([0, 0, 30, -40, 590, 610, -700])
        rows.append((rng.randrange(2), t, i, reset))
    got = {r["i"]: r["window_key"] for r in weeks.canonical_keys(spark.createDataFrame(rows, "key long, t long, i long, reset long"), ["key"], ["t", "i"], unit=unit).collect()}
    before, first = {}, {}
    for key, _, i, reset in rows:
        if key not in before or abs(reset - before[key]) >= 600:
            first[key] = reset
        before[key] = reset
        assert got[i] == first[key] // 600 * 600


def test_spend_is_adopted_where_one_account_is_open(spark):
    rng = random.Random(3)
    windows = [(rng.randrange(2), s := rng.randrange(20_000), s + rng.randrange(3000), rng.choice([None, 1, 2])) for _ in range(80)]
    entries = [(i, rng.randrange(2), rng.randrange(22_000)) for i in range(300)]
    got = {r["entry_id"]: r["account"] for r in attribution.adopt_spend(spark.createDataFrame(entries, "entry_id long, root long, ts long"), spark.createDataFrame(windows, "root long, start long, end long, account long"), 500).collect()}
    for i, root, ts in entries:
        named = {a for r, s, e, a in windows if r == root and s <= ts < e and a is not None}
        assert got.get(i) == (named.pop() if len(named) == 1 else None)


def test_levels_by_fifths(spark):
    rng = random.Random(4)
    values = [rng.choice([0, -3, 1, 2, 7, 7, 7, 1000, rng.randrange(1, 10**12)]) for _ in range(500)]
    got = sorted((r["v"], r["level"]) for r in reports.intensity(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect())
    pos = sorted(v for v in values if v > 0)
    want = sorted((v, 0 if v <= 0 else max(1, min(5, -(-(pos.index(v) + 1) * 5 // len(pos))))) for v in values)
    assert got == want


def test_no_nested_loops_and_no_row_past_the_cut(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(200)], "key long, percent double")
    q = quota.crossings(s, [50, 90], s.where("false").select("key", F.lit(50).alias("threshold")), ["key"])
    assert "NestedLoop" not in q._jdf.queryExecution().toString() and q.count() == 150 + 110
    rows = spark.createDataFrame([(i, 1.0, 1.0 + i, "changed", float(i), 100.0 * i) for i in range(50)] + [(99, None, 5.0, "new", 5.0, None)], "key long, a double, b double, status string, delta double, delta_pct double")
    got = reports.quiet(rows, 3.0, 500.0, 4).collect()
    assert sorted((r["key"], r["rn"]) for r in got if r["status"] == "changed") == [(46, 4), (47, 3), (48, 2), (49, 1)] and len(got) == 5
    assert tuple(reports.hidden(rows, 3.0, 500.0, 4).first()) == (3, 43)


def test_pages(spark):
    r = spark.range(1, 101).withColumnRenamed("id", "k")
    keys = lambda **kw: [x["k"] for x in reports.page(r, "k", 3, **kw).collect()]
    assert keys() == [1, 2, 3] and keys(after=F.lit(10)) == [11, 12, 13] and keys(before=F.lit(10)) == [7, 8, 9] and keys(tail=True) == [98, 99, 100]
    assert keys(after=F.lit(500)) == [] == keys(before=F.lit(500))
    with pytest.raises(ValueError):
        keys(after=F.lit(1), tail=True)


def test_merging_equals_reading_all(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(20), rng.randrange(4), i, rng.choice(["active", "active", "tombstone"]), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, rev long, seq long, status string, digest string")
    state = events.effective_state(df.where("seq % 4 = 3"))
    for n in (0, 2, 1):
        state = events.merge_effective(state, df.where(f"seq % 4 = {n}"))
    got = state.where("status = 'active'").select("id", "rev", "seq", "digest", (F.col("digest_lo") != F.col("digest_hi")).alias("conflict"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.effective_events(df).collect()))


def test_lines_have_their_place_whatever_the_splits(spark, tmp_path):
    rng = random.Random(6)
    lines = [f"{i} " + "é" * rng.randrange(200) for i in range(3000)]
    (tmp_path / "f.jsonl").write_bytes("".join(x + "\n" for x in lines).encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        got = logs.line_offsets(logs.numbered_lines(spark, str(tmp_path))).orderBy("pos").collect()
    finally:
        spark.conf.set(key, before)
    assert [r["value"] for r in got] == lines
    at = 0
    for r, x in zip(got, lines):
        assert r["offset"] == at
        at += len(x.encode()) + 1


MANY = 100_000


def test_one_key_of_very_many_blocks_and_windows(spark):
    """Blocks ended by the next window: the frame only grows."""
    at = F.timestamp_seconds
    e = spark.range(MANY).select(F.lit(1).alias("key"), at(F.col("id") * 36_000 + 60).alias("ts"))
    w = spark.range(0, MANY, 2).select(F.lit(1).alias("key"), at(F.col("id") * 36_000 + 9000).alias("start"), at(F.col("id") * 36_000 + 9000 + 18_000).alias("end"))
    got = blocks.anchored_blocks(e, w, ["key"])
    ends = got.select((F.unix_seconds("end") - F.unix_seconds("start")).alias("n"), "anchor").groupBy("anchor", "n").count().collect()
    assert sorted(map(tuple, ends)) == [("heuristic", 9000, MANY // 2), ("heuristic", 18_000, MANY // 2)]


def test_one_key_of_very_many_points_and_intervals(spark):
    at = F.timestamp_seconds
    p = spark.range(MANY).select(F.lit(1).alias("key"), "id", at(F.col("id") * 18_000 + F.col("id") % 18_000).alias("ts"))
    i = spark.range(MANY).select(F.lit(1).alias("key"), F.col("id").alias("n"), at(F.col("id") * 18_000).alias("start"), at((F.col("id") + 1) * 18_000).alias("end"))
    j = intervals.assign(p, i, "ts", 18_000, by=["key"])
    assert j.columns.count("key") == 1 and tuple(j.agg(F.count("*"), F.sum((F.col("id") == F.col("n")).cast("int"))).first()) == (MANY, MANY)


def test_sliding_medians(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(0, 3000), rng.choice([None, *(float(x) for x in range(40))]), i) for i in range(1500) for k in [rng.choice([1, 2, None])]] + [(1, None, 5.0, -1)]
    got = {r["i"]: (r["samples"], r["baseline"]) for r in ranks.sliding_median(spark.createDataFrame(rows, "k long, at long, v double, i long"), ["k"], "at", "v", 100, 3).collect()}
    for k, at, _, i in rows:
        inside = sorted(v for k2, a2, v, _ in rows if k2 == k and at is not None and a2 is not None and at - 100 <= a2 < at and v is not None)
        m = len(inside)
        assert got[i] == (m, (inside[(m - 1) // 2] + inside[m // 2]) / 2 if m >= 3 else None)


def test_one_key_of_very_many_samples_a_window(spark):
    d = spark.range(MANY).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 1000).cast("double").alias("v"))
    got = ranks.sliding_median(d, ["k"], "at", "v", 20_000, 10)
    assert tuple(got.where("at >= 20000").agg(F.min("baseline"), F.max("baseline"), F.min("samples")).first()) == (499.5, 499.5, 20_000)


def test_places_in_an_order(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "x long, i long").repartition(7)
    got = {r["i"]: r["place"] for r in ranks.placed(df, [F.desc("x"), "i"]).collect()}
    assert [got[i] for _, i in sorted(rows, key=lambda r: (-r[0], r[1]))] == list(range(1, 5001))
    assert ranks.placed(df.where("false"), ["x"]).count() == 0
