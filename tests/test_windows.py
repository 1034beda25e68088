"""Weeks, attribution, forecasts and log formats on small hand-made inputs."""

import json

from pyspark.sql import functions as F

from meterlake.operators import attribution, forecasts, weeks
from meterlake.sources import logs

D = 86_400


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_weeks_reanchor_within_ten_and_a_half_days(spark):
    a = spark.createDataFrame([(1, 0), (1, 10 * D), (1, 31 * D)], "k long, anchor long")
    got = [r["start"] // D for r in weeks.generate(a, ["k"], 40 * D).orderBy("start").collect()]
    assert got == [0, 10, 17, 24, 31, 38]


def test_reset_within_a_week_splits_it(spark):
    w = spark.createDataFrame([(1, 0, 7), (1, 7, 14)], "k long, start long, end long")
    r = spark.createDataFrame([(1, 7, 7, 3)], "k long, old_end long, new_end long, effective long")
    assert rows(weeks.apply_resets(w, r, ["k"]), "start") == [(1, 0, 3), (1, 3, 7), (1, 7, 14)]
    r = spark.createDataFrame([(1, 7, 14, 5)], "k long, old_end long, new_end long, effective long")
    assert rows(weeks.apply_resets(w, r, ["k"]), "start") == [(1, 0, 5), (1, 5, 14)]


def test_floor_drops_what_came_before(spark):
    s = spark.createDataFrame([(1, 5, 46.0), (1, 9, 31.0), (2, 1, 9.0), (3, None, 4.0), (3, 99, None)], "k long, ts long, percent double")
    f = spark.createDataFrame([(1, 7), (2, 5), (3, 50)], "k long, floor long")
    assert rows(weeks.floored_max(s, f, ["k"]), "k") == [(1, 31.0), (3, 4.0)]


def test_spend_needs_one_account(spark):
    e = spark.createDataFrame([(1, 0, 50), (2, 0, 150), (3, 0, 500), (4, 1, 50)], "entry_id long, root long, ts long")
    w = spark.createDataFrame([(0, 0, 100, "a"), (0, 40, 200, None), (0, 120, 300, "a"), (0, 120, 300, "b")], "root long, start long, end long, account string")
    assert rows(attribution.adopt_spend(e, w, 60), "entry_id") == [(1, "a")]


def test_assertions(spark):
    g = spark.createDataFrame([("g1", "x", [1, 2], True, None), ("g2", "x", [3], True, "n"), ("g3", "x", [4, 5], False, None), ("g4", "x", [5], True, None)], "group_id string, axes string, resets array<int>, in_scope boolean, native string")
    a = spark.createDataFrame([(1, "x", [2], "a"), (2, "x", [3], "a"), (3, "x", [4], "a"), (4, "x", [5], "a"), (5, "y", [1], "a"), (6, "x", [1], "b")], "op_id int, axes string, resets array<int>, account string")
    assert [r["outcome"] for r in attribution.resolve_assertions(a, g).orderBy("op_id").collect()] == ["conflict", "native", "model_scoped", "split", "dormant", "conflict"]


def test_labels_never_shadow_a_literal(spark):
    i = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a (2)")], "identity int, label string")
    shown = [r["shown"] for r in attribution.collision_safe_labels(i).orderBy("identity").collect()]
    assert len(set(shown)) == 3 and shown[0] == "a" and shown[2] == "a (2)"


def test_forecast_without_a_rate_is_null(spark):
    s = spark.createDataFrame([(10.0, None, None, 10.0, 90.0, None), (100.0, 90.0, 24.0, 10.0, 90.0, 1.0)], "percent double, percent_24h double, hours_24h double, elapsed double, remaining double, usd_per_pct double")
    a, b = forecasts.weekly_forecast(s, [90]).orderBy("percent").collect()
    assert a["final_low"] == a["final_high"] == 100.0 and a["rate_recent"] is None and a["usd_per_day_90"] is None and a["reaches_cap"] and a["hours_to_cap"] is None
    assert b["reaches_cap"] and b["usd_per_day_90"] is None


def test_rollout_accounting_and_quota(spark, tmp_path):
    def event(total, last, **more):
        return {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": last}, **({"total_token_usage": {"total_tokens": total}} if total is not None else {})}, **more}}

    limits = {"primary": {"used_percent": 12.5, "window_minutes": 299, "resets_at": 5}, "broken": {"used_percent": 120, "window_minutes": 1, "resets_at": 5}}
    lines = [{"type": "session_meta", "payload": {"id": "s"}}, event(5, 1), {"type": "turn_context", "payload": {"model": "m"}}, event(5, 2), event(9, 3), event(None, 4), event(8, 5), event(20, 6, rate_limits=limits)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{torn")
    r = logs.read_rollouts(spark, str(tmp_path))
    assert [(x["model"], x["input_tokens"]) for x in logs.accounting(r).orderBy("pos").collect()] == [("unknown", 1), ("m", 3), ("m", 4), ("m", 6)]
    assert [(x["slot"], x["used_percent"], x["window_minutes"]) for x in logs.quota_observations(r).collect()] == [("primary", 12.5, 300)]


def test_journal_round_trip(spark, tmp_path):
    j = spark.createDataFrame([(1, "obs", "a", "2024-01-05T00:00:00Z"), (1, "evt", "b", "2024-02-05T00:00:00Z")], "v int, t string, id string, at string")
    logs.append_journal(j, str(tmp_path / "j"))
    logs.append_journal(j.where("id = 'a'"), str(tmp_path / "j"))
    assert sorted((r["id"], r["month"]) for r in logs.read_journal(spark, str(tmp_path / "j" / "*")).collect()) == [("a", "2024-01"), ("a", "2024-01"), ("b", "2024-02")]


def test_messages_and_envelope(spark):
    m = lambda **x: json.dumps(x)
    text = m(type="user", message={"role": "user", "content": "hello"})
    block = m(type="assistant", message={"content": json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}])})
    result = m(type="user", message={"content": json.dumps([{"type": "tool_result"}])})
    df = spark.createDataFrame([("p", x) for x in (text, block, result, m(type="summary"), m(type="user", isMeta=True, message={"content": "x"}))], "source_path string, line string")
    assert sorted((r["kind"], r["text"]) for r in logs.message_rows(df).collect()) == [("assistant", "a\nb"), ("human", "hello"), ("meta", "x"), ("tool_result", "")]
    one = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert logs.envelope(one).first()[0] == '{"schemaVersion":1,"a":1}'


def test_segments_keep_to_the_budget(spark):
    t = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 4, 3, 20, 1])], "k long, turn int, c long")
    assert [r["segment"] for r in forecasts.segments(t, ["k"], "turn", "c", 10).orderBy("turn").collect()] == [0, 0, 1, 2, 3]


def test_unambiguous_and_owners(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, r string")
    assert rows(attribution.unambiguous(a, b, "k"), "k") == [(1, "x", "p")]
    o = spark.createDataFrame([(1, "c", 3), (1, "c", 1), (1, None, 0)], "s int, call string, p int")
    assert rows(attribution.fold_owners(o, ["s"], "call", "p"), "s") == [(1, "c", 1, 1)]
    assert forecasts.cache_rebuilds(spark.createDataFrame([(1, 1, 130, 0), (1, 2, 0, 134)], "s int, t int, cache_read_tokens long, cache_create_tokens long"), ["s"], ["t"]).select(F.col("tokens_recreated")).first()[0] == 130
