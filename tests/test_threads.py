"""Subagents, bounded JSON and segments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import text
from meterlake.operators import conversations
from meterlake.operators.segments import Segmenter, segments


def test_buckets_of_chains_orphans_and_circles(spark):
    chain = [(1, i, i - 1 if i else None, "a" if i == 3 else "b" if i == 700 else None) for i in range(1000)]
    odd = [(2, 0, 99, None), (2, 1, 0, None), (3, 0, 1, None), (3, 1, 0, None), (3, 2, 1, None), (3, 3, 3, None), (3, 4, 3, "c"), (3, 5, 4, None)]
    df = spark.createDataFrame(chain + odd, "conv_id long, turn long, parent long, agent string")
    got = {(r["conv_id"], r["turn"]): (r["bucket"], r["circular"]) for r in conversations.buckets(df).collect()}
    assert all(got[1, i] == (None if i < 3 else "a" if i < 700 else "b", False) for i in range(1000))
    assert {k: v for k, v in got.items() if k[0] > 1} == {(2, 0): (None, False), (2, 1): (None, False), (3, 0): (None, True), (3, 1): (None, True), (3, 2): (None, True), (3, 3): (None, True), (3, 4): ("c", False), (3, 5): ("c", False)}
    assert conversations.buckets(df.where("false")).count() == 0


def test_costs_count_once(spark):
    rows = [(1, 0, None, None, "m0", 5, ["x"], "0/2"), (1, 1, 0, "a", "m1", 7, ["x", "y"], None), (1, 2, 1, None, "m1", 7, ["y"], "1/2"), (1, 3, 2, None, None, 1, None, None), (1, 4, 3, None, None, 1, None, "2/2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, parent long, agent string, message string, cost long, files array<string>, tasks string")
    assert sorted((r["bucket"] or "", r["turns"], r["cost"], r["files"], r["tasks"]) for r in conversations.bucket_outline(df).collect()) == [("", 1, 5, 1, "0/2"), ("a", 4, 9, 2, "2/2")]


def test_small_documents_stay():
    for d in ({}, {"a": 1}, {"a": [1, 2.5, -3e10, True, None, "x", {"b": []}]}, {"é\n": "日本\"\\"}, {"k": {"k": {"k": {}}}}):
        out, cut = text._bounded(json.dumps(d))
        assert json.loads(out) == d and not cut and out == json.dumps(d, separators=(",", ":"))
    assert text._bounded('{"n": 1.10, "m": 12345678901234567890123}') == ('{"n":1.10,"m":12345678901234567890123}', False)
    assert [text._bounded(x) for x in (None, "", "[1]", '"s"', "{", "7")] == [(None, False)] * 6


def hostile():
    rng = random.Random(5)
    yield {"a": "x" * 8000} and {"a": "x" * 8001}
    yield {str(i): "y" * 3000 for i in range(30)}
    yield {"a": "日" * 7999, "b": "é" * 100}
    yield {"a": "\U0001f642" * 4000, "b": "z"}
    yield {"a": '"\\\n' * 2600 + "\x00" * 1000}
    yield {"k" * 600: 1, "q" * 40_000: {"z": "w" * 40_000}}
    yield {"é" * 512 + str(i): i for i in range(60)}
    yield {"a": list(range(3000))}
    yield {"a": [[i] * 30 for i in range(500)]}
    yield {"a": ["日本" * 40] * 900}
    deep = {"end": 1}
    for _ in range(40):
        deep = {"d": [deep]}
    yield deep
    for _ in range(30):
        yield {"".join(rng.choices("ab\"é日\U0001f642", k=rng.randrange(1, 700))): rng.choice(["x", "é", "\n"]) * rng.randrange(0, 9000) for _ in range(rng.randrange(1, 60))}


def test_hostile_documents_are_cut_within_the_budget():
    for d in hostile():
        raw = json.dumps(d, separators=(",", ":"))
        out, cut = text._bounded(raw)
        back = json.loads(out)
        assert len(out) <= 32_000 and cut and out.isascii() and isinstance(back, dict)

        def begins(a, b):  # what is kept begins what was there, but for what stands for the rest
            if isinstance(a, dict) and isinstance(b, dict):
                return all(begins(x, y) for x, y in zip(a.values(), b.values())) and all(k2.startswith(k1) for k1, k2 in zip(a, b))
            if isinstance(a, list) and isinstance(b, list):
                return all(begins(x, y) for x, y in zip(a, b))
            return a == text.ELIDED or a == "" or a == b or isinstance(a, str) and isinstance(b, str) and b.startswith(a) and len(a) <= 8000

        assert begins(back, d)
        if len(raw) > 40_000 and max(map(len, d)) <= 512:
            assert len(out) > 5_000
    assert text._bounded('{"a":' * 100_000 + "1" + "}" * 100_000) == (None, True)
    assert text._bounded('{"a": ' + "9" * 50_000 + ', "b": 2}') == ('{"a":"","b":2}', True)


def test_bounded_json_column(spark):
    df = spark.createDataFrame([('{"a": "' + "x" * 9000 + '"}',), ("nope",), (None,), ('{"b": 1}',)], "d string")
    assert [(len(r[0]["text"] or ""), r[0]["truncated"]) for r in df.select(text.bounded_json(F.col("d"))).collect()] == [(8008, True), (0, False), (0, False), (7, False)]


def brute_segments(groups, budget, lookback):
    """Over the whole list, from the definition."""
    floor, start, out = budget - int(budget * lookback), 0, []
    while start < len(groups):
        fits = [e for e in range(start + 1, len(groups) + 1) if e == start + 1 or all(sum(g[0] for g in groups[start:x]) <= budget for x in range(start + 2, e + 1)) and sum(g[0] for g in groups[start:e]) <= budget]
        end = max(fits)
        cuts = sorted((groups[c][1], c) for c in range(start + 1, end) if groups[c][1] < 2 and sum(g[0] for g in groups[start:c]) >= floor)
        end = cuts[0][1] if cuts else end
        while end < len(groups) and any(g[3] is not None for g in groups[start:end]) and groups[end][2] is not None and groups[end][2] <= max(g[3] for g in groups[start:end] if g[3] is not None):
            end += 1
        out.append(end - start)
        start = end
    return out


def random_groups(rng, n, spans):
    return [(rng.choice([1, 1, 2, 3, 9, 30]), rng.choice([0, 1, 2, 2, 2, 2]), i * 3 if spans else None, i * 3 + rng.choice([0, 1, 2, 2, 7, 20]) if spans and rng.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize("spans", [False, True])
def test_segments_equal_the_definition_and_stay_when_turns_are_appended(spans):
    rng = random.Random(8)
    for _ in range(120):
        groups, budget, back = random_groups(rng, rng.randrange(0, 40), spans), rng.choice([1, 5, 12, 40]), rng.choice([0.0, 0.25, 0.6])
        s = Segmenter(budget, back)
        got = [n for g in groups for n in s.feed(g)]
        settled = list(got)
        got += s.finish()
        assert got == brute_segments(groups, budget, back) and sum(got) == len(groups)
        more = random_groups(rng, 10, False)
        assert brute_segments(groups + more, budget, back)[: len(settled)] == settled
    for bad in ((0, 0.1), (5, 1.0), (5, -0.1)):
        with pytest.raises(ValueError):
            Segmenter(*bad)


def test_segments_of_many_keys(spark):
    rng = random.Random(9)
    keys = {k: random_groups(rng, rng.randrange(1, 60), k % 2 == 0) for k in range(30)}
    df = spark.createDataFrame([(k, i, *g) for k, gs in keys.items() for i, g in enumerate(gs)], "k long, at long, blocks int, rank int, first long, last long").repartition(5)
    got = {(r["k"], r["at"]): r["segment"] for r in segments(df, ["k"], "at", 12, 0.5).collect()}
    want = {}
    for k, gs in keys.items():
        at = 0
        for n, size in enumerate(brute_segments(gs, 12, 0.5)):
            want |= {(k, at + i): n for i in range(size)}
            at += size
    assert got == want and segments(df.where("false"), ["k"], "at").count() == 0


def test_what_a_person_did_not_write(spark):
    cases = [
        ("<command-name>a</command-name>", "marker"), ("<command-name>a</command-name> x", None), ("<command-name>a</command-args>", None), (" <command-name>a</command-name>\n<command-args></command-args> ", "marker"),
        ("<command-name>a</command-name>b</command-name>", None), ("<task-notification>x</task-notification> more", "notification"), ("<task-notification>x</bash-notification>", None), ("<bash-stdout>" + "y" * 200_000 + "</bash-stdout>", "echo"),
        ("<command-args>" + "z " * 100_000 + "</command-args>", "marker"), ("<bash-input>", None), ("  This session is being continued from a previous conversation.", "compaction"), ("say <bash-input>x</bash-input>", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.wrapper_kind(F.col("t"))).collect()] == [k for _, k in cases]
    stripped = spark.createDataFrame([("\x1b[1;31mred\x1b[0m [31m \x1b]8;;http://x\x1b\\link\x1b]0;t",), ("a\x1b",), (None,)], "t string").select(text.strip_ansi(F.col("t"))).collect()
    assert [r[0] for r in stripped] == ["red [31m link", "a", None]
    sent = spark.createDataFrame([(" <system-reminder>Message sent at Mon UTC.</system-reminder>\n hi",), ("x <system-reminder>Message sent at Mon UTC.</system-reminder>",)], "t string").select(text.strip_sent(F.col("t"))).collect()
    assert [r[0] for r in sent] == ["hi", "x <system-reminder>Message sent at Mon UTC.</system-reminder>"]


def test_canonical_documents(spark):
    docs = ['{"b":1,"a":{"d":[1,{"z":0,"y":"é"}],"c":null}}', ' {"a" : {"c":null, "d":[1, {"y":"é","z":0}]}, "b" : 1 }', "[3, {}]", "no", '{"a":1,"a":2}', None, '{"é":1,"z":2,"Z":3}']
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i").select(text.canonical_document(F.col("d"))).collect()]
    assert got == ['{"a":{"c":null,"d":[1,{"y":"é","z":0}]},"b":1}'] * 2 + ["[3,{}]", None, None, None, '{"Z":3,"z":2,"é":1}']


def test_headings_and_diffs(spark):
    df = spark.createDataFrame([(["**a**\n**b c**", "**d**\nx", None, " ", "**", "****", "***e***", "**f**\n<!-- -->"],), ([],), (None,)], "e array<string>")
    got = [r[0] for r in df.select(text.reasoning_headings(F.col("e"))).collect()]
    assert got == [["a", "b c", "**d**\nx", "**", "****", "*e*", "f"], [], None]
    diffs = ["@@ -1 +1 @@\n-a\n+b", "@@ -1,2 +1,1 @@\n--- x\n same\n+ after", "no hunk\n+x", "", None, "@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline\n@@ -5,1 +6,0 @@\n-z"]
    counts = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(i, d) for i, d in enumerate(diffs)], "i int, d string").orderBy("i").select(text.diff_counts(F.col("d"))).collect()]
    assert counts == [(1, 1), (0, 1), None, None, None, (2, 1)]


def test_the_innermost_root_above_a_directory(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b/",), ("/a/b/c",), ("/",), ("rel/x",), (None,)], "root string")
    cases = {"/a": "/a", "/a/": "/a", "/a/b": "/a/b", "/a/bc": "/a", "/a/b/c/d/e": "/a/b/c", "/z": "/", "rel/x/y": "rel/x", "rel": None, None: None, "": None, "/": "/"}
    rows = spark.createDataFrame([(c, 1) for c in cases] * 2, "cwd string, n int")
    got = conversations.nearest_root(rows, roots)
    assert {r["cwd"]: r["root"] for r in got.collect()} == cases and got.count() == 2 * len(cases) and got.columns == ["cwd", "n", "root"]
    bare = conversations.nearest_root(rows, roots.where("root <> '/'")).where("cwd in ('/', '/z')").collect()
    assert all(r["root"] is None for r in bare)
