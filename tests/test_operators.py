"""Operators on small hand-made tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import money, text, timekit
from meterlake.operators import blocks, events, intervals, quota, reports, rollups

T = dt.datetime


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dedup_takes_most_tokens_then_speed(spark):
    d = "entry_id long, msg string, req string, input_tokens long, output_tokens long, cache_create_tokens long, cache_read_tokens long, speed string"
    df = spark.createDataFrame([(1, "m", "r", 1, 0, 0, 0, None), (2, "m", "r", 9, 0, 0, 0, None), (3, "m", "r", 9, 0, 0, 0, "fast"), (4, None, "r", 1, 0, 0, 0, None), (5, None, "r", 1, 0, 0, 0, None)], d)
    assert [r[0] for r in rows(events.dedup_usage(df, ["msg", "req"]), "entry_id")] == [3, 4, 5]


def test_gap_rows_need_a_minute_and_a_hole(spark):
    at = lambda m: T(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0)), (1, at(299)), (1, at(330)), (1, at(900))], "k long, ts timestamp")
    b = blocks.fixed_blocks(df, ["k"])
    assert [(r["start"], r["entries"]) for r in b.orderBy("start").collect()] == [(at(0), 2), (at(300), 1), (at(900), 1)]
    assert [(r["gap_start"], r["gap_end"]) for r in blocks.gaps(b, ["k"]).collect()] == [(at(330), at(900))]


def test_fixed_blocks_equal_a_row_by_row_walk(spark):
    rng = random.Random(5)
    data = [(k, T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(6000))) for k in range(3) for _ in range(80)]
    got = {(r["k"], r["start"], r["entries"]) for r in blocks.fixed_blocks(spark.createDataFrame(data, "k long, ts timestamp"), ["k"]).collect()}
    want = set()
    for k, part in itertools.groupby(sorted(data), key=lambda x: x[0]):
        start, n = None, 0
        for _, ts in part:
            if start is None or ts >= start + dt.timedelta(hours=5):
                if start:
                    want.add((k, start, n))
                start, n = ts.replace(minute=0, second=0), 0
            n += 1
        want.add((k, start, n))
    assert got == want


def test_schedule_is_the_best_choice(spark):
    rng = random.Random(3)
    data = [(0, rng.randrange(60), rng.randrange(1, 5)) for _ in range(12)]
    chosen = [r["x"] for r in blocks.schedule(spark.createDataFrame(data, "k long, x long, weight long"), ["k"], 10).collect()]
    weight = {}
    for _, x, w in data:
        weight[x] = weight.get(x, 0) + w
    apart = lambda xs: all(abs(a - b) >= 10 for a, b in itertools.combinations(xs, 2))
    best = max(sum(weight[x] for x in c) for n in range(8) for c in itertools.combinations(weight, n) if apart(c))
    assert apart(chosen) and sum(weight[x] for x in chosen) == best


def test_percent_from_3_to_5_2_crosses_4_and_5(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.2), (1, 3, 4.0), (1, 4, 5.9)], "k long, t long, percent double")
    assert [r["percent"] for r in quota.milestones(df, ["k"], ["t"]).orderBy("percent").collect()] == [4, 5]


def test_small_blip_is_a_reset_only_from_three_points(spark):
    df = spark.createDataFrame([(1, 1, 6.0), (1, 2, 0.0), (1, 3, 1.0), (2, 1, 2.0), (2, 2, 0.0), (3, 1, 90.0), (3, 2, 65.0)], "k long, t long, percent double")
    assert [(r["k"], r["t"]) for r in quota.resets(df, ["k"], ["t"]).orderBy("k").collect()] == [(1, 2), (3, 2)]


def test_resets_within_ten_minutes_chain_to_one_cluster(spark):
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate([1000, 1600, 2200, 2801])], "k long, x long, id long")
    assert [r["cluster"] for r in intervals.clusters(df, ["k"], "x", 600, "id").orderBy("x").collect()] == [0, 0, 0, 1]


def test_interval_assignment_is_half_open(spark):
    w = spark.createDataFrame([("a", T(2024, 1, 1), T(2024, 1, 8)), ("b", T(2024, 1, 8), T(2024, 1, 9))], "week string, start timestamp, end timestamp")
    p = spark.createDataFrame([(T(2024, 1, 1),), (T(2024, 1, 7, 23, 59, 59),), (T(2024, 1, 8),), (T(2024, 1, 9),)], "ts timestamp")
    assert [r["week"] for r in intervals.assign(p, w, "ts", 7 * 86400).orderBy("ts").collect()] == ["a", "a", "b"]


def test_nearest_anchor_takes_the_earlier_of_two(spark):
    p, a = spark.createDataFrame([(1, 1000), (1, 9000)], "k long, x long"), spark.createDataFrame([(1, 900), (1, 1100)], "k long, anchor long")
    assert rows(intervals.nearest(p, a, 600, ["k"]), "x") == [(1, 1000, 900), (1, 9000, None)]


def test_fewer_than_five_days_are_unevaluated_not_clean(spark):
    df = spark.createDataFrame([(1, n, 80.0 if n < 6 else 60.0, 1) for n in range(7)], "k long, n int, hit double, net long")
    got = reports.anomalies(reports.trailing_median(df, ["k"], "n", "hit", 14, 5), 15.0).orderBy("n").collect()
    assert [r["unevaluated"] for r in got] == [True] * 5 + [False] * 2
    assert got[6]["flags"] == "cache_drop" and got[5]["flags"] == ""


def test_two_window_comparison(spark):
    a = spark.createDataFrame([("x", 4.25)], "key string, v double")
    b = spark.createDataFrame([("x", 5.0), ("y", 2.5)], "key string, v double")
    got = {r["key"]: (r["status"], r["delta"], r["delta_pct"]) for r in reports.compare(a, b, "key", "v").collect()}
    assert got["x"] == ("changed", 0.75, pytest.approx(17.647058823)) and got["y"] == ("new", 2.5, None)


def test_cost_modes_tiers_and_unknown_models(spark):
    d = "model string, input_tokens long, output_tokens long, cache_create_tokens long, cache_read_tokens long, cache_1h_tokens long, cost_usd_raw double, speed string"
    df = spark.createDataFrame([("click", 250_000, 0, 0, 0, None, None, None), ("click", 100, 0, 0, 0, None, 7.0, None), ("nothing", 100, 0, 0, 0, None, None, None), ("anthropic/purchase", 10, 0, 0, 0, None, None, "fast")], d)
    e = money.with_prices(df, money.sample_prices(spark))
    got = {m: [r["c"] for r in e.select(money.entry_cost(m).alias("c"), "model", "input_tokens").orderBy("model", "input_tokens").collect()] for m in ("auto", "calculate", "display")}
    assert got["auto"] == pytest.approx([10 * 1.5e-5 * 6, 7.0, 200_000 * 3e-6 + 50_000 * 6e-6, 0.0])
    assert got["calculate"][1] == pytest.approx(100 * 3e-6) and got["display"] == [0.0, 7.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        money.entry_cost("guess")


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(1)
    data = [(rng.random() * 10 ** rng.randrange(-6, 3),) for _ in range(500)]
    sums = set()
    for n in (1, 3, 7):
        rng.shuffle(data)
        sums.add(spark.createDataFrame(data, "cost double").repartition(n).agg(money.stable_sum(F.col("cost"))).first()[0])
    assert len(sums) == 1


def test_insert_if_absent_twice_adds_nothing(spark):
    t = spark.createDataFrame([(1, "a")], "id long, v string")
    more = spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string")
    once = events.insert_absent(t, more, ["id"])
    assert rows(events.insert_absent(once, more, ["id"]), "id") == [(1, "a"), (2, "c")]


def test_effective_events(spark):
    r = spark.createDataFrame([(1, 0, 1, "active", "a"), (1, 2, 3, "active", "c"), (1, 2, 2, "active", "b"), (2, 1, 4, "tombstone", "d")], "id long, rev long, seq long, status string, digest string")
    assert rows(events.effective_events(r), "id") == [(1, 2, 2, "b", True)]


def test_top_and_other(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcd", [1, -9, 5, 2])], "key string, v long")
    assert rows(rollups.top_and_other(df, "key", "v", 2, ["v"]), "key") == [("(other)", 3), ("b", -9), ("c", 5)]


def test_scrub_is_idempotent(spark):
    s = "key sk-ant-abcdefgh12 /home/me/app app-x app.py (app) app token=abcdef123"
    df = spark.createDataFrame([(s,), (None,)], "t string")
    tokens = {"/home/me/app": ("project-1", False), "app": ("project-1", True)}
    once = text.scrub_secrets(text.scrub_identities(F.col("t"), tokens))
    twice = text.scrub_secrets(text.scrub_identities(once, tokens))
    got = df.select(once.alias("a"), twice.alias("b")).collect()
    assert got[0]["a"] == got[0]["b"] == "key [REDACTED:anthropic-key] project-1 app-x app.py (project-1) project-1 token=[REDACTED:secret-assignment]"
    assert got[1]["a"] is None


def test_line_diff(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nc\nd\n"), (None, "x"), ("a\fb\u2028c\rd\x0be\n", "a\fb\n"), ("x\r\ny", "x\ny"), ("", None)], "o string, n string")
    assert [tuple(r[0]) for r in df.select(text.line_diff(F.col("o"), F.col("n"))).collect()] == [(1, 1), (1, 0), (1, 1), (1, 1), (0, 0)]


def test_line_diff_equals_the_table(spark):
    rng = random.Random(6)
    rows = [tuple("\n".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(2)) for _ in range(60)]

    def brute(o, n):
        a, b = (x.split("\n") if x else [] for x in (o, n))
        a, b = ([x + "\n" for x in y[:-1]] + [x for x in y[-1:] if x] for y in (a, b))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return len(b) - t[-1][-1], len(a) - t[-1][-1]

    df = spark.createDataFrame(rows, "o string, n string")
    assert [tuple(r[0]) for r in df.select(text.line_diff(F.col("o"), F.col("n"))).collect()] == [brute(*r) for r in rows]
    assert {tuple(r[0]) for r in df.where("o <> '' and n <> ''").select(text.line_diff(F.col("o"), F.col("n"), budget=0)).collect()} == {(None, None)}


@pytest.mark.parametrize(("token", "want"), [
    ("last-7d", (T(2024, 3, 6, 12), T(2024, 3, 13, 12))), ("prev-7d", (T(2024, 2, 28, 12), T(2024, 3, 6, 12))),
    ("this-week", (T(2024, 3, 11), T(2024, 3, 13, 12))), ("1w-ago", (T(2024, 3, 4), T(2024, 3, 11))),
    ("last-week", (T(2024, 3, 4), T(2024, 3, 11))), ("this-month", (T(2024, 3, 1), T(2024, 4, 1))), ("14m-ago", (T(2023, 1, 1), T(2023, 2, 1))),
    ("last-month", (T(2024, 2, 1), T(2024, 3, 1))), ("2024-01-01..2024-01-02", (T(2024, 1, 1), T(2024, 1, 3)))])
def test_window_tokens(token, want):
    now = T(2024, 3, 13, 12, tzinfo=dt.UTC)
    week = T(2024, 3, 11, tzinfo=dt.UTC), T(2024, 3, 18, tzinfo=dt.UTC)
    assert tuple(x.replace(tzinfo=None) for x in timekit.parse_window(token, now, week=week)) == want
    if "week" in token or "w-" in token:
        with pytest.raises(ValueError):
            timekit.parse_window(token, now)


def test_month_window_follows_the_clock():
    a, b = timekit.month_window(T(2024, 3, 15, tzinfo=dt.UTC), "America/New_York")
    assert b - a == dt.timedelta(days=31) - dt.timedelta(hours=1)
    with pytest.raises(ValueError):
        timekit.parse_window("someday", T(2024, 1, 1, tzinfo=dt.UTC))


def test_gap_fill_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([], "day date, n long")
    assert reports.fill_days(df, "day", ["n"]).count() == 0
