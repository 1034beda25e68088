"""Shaping, text and conversation helpers on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from meterlake.functions import text
from meterlake.operators import conversations, quota, reports


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_text_helpers(spark):
    assert one(spark, text.strip_ansi, "\x1b[1;31mred\x1b[0m") == "red"
    assert tuple(one(spark, text.command_of, "/do:it  now\nplease")) == ("do:it", "now\nplease") and one(spark, text.command_of, "do") is None
    assert one(spark, text.basename, "/a/b.tar.gz") == "b.tar.gz" and one(spark, text.stem, "/a/b.py") == "b"
    assert one(spark, lambda t: text.decode_identity(text.encode_identity(t, F.lit("x"))), "é/+?~") == ["é/+?~", "x"]
    assert one(spark, text.preview, "  first\nsecond") == "first" and len(one(spark, text.preview, "x" * 200)) == 80
    assert [tuple(r) for r in one(spark, lambda t: text.ranges(t, "a.b"), "A.b xa.ba.b a_b")] == [(0, 3), (5, 8), (8, 11)]
    assert one(spark, lambda t: text.ranges(t, ""), "x") == [] and one(spark, lambda t: text.ranges(t, "x"), None) == []
    assert one(spark, lambda t: text.content_hash(t), "a") == one(spark, lambda t: text.content_hash(t), "a")
    assert one(spark, lambda t: text.humanise(t.cast("long")), "1234") == "1.2K" and one(spark, text.short_model, "anthropic/m-x-20250101") == "m-x"


def test_tables_for_sharing(spark):
    rows = spark.createDataFrame([("a|b", None)], "x string, y int").collect()
    assert text.markdown_table(rows, ["x", "y"]).splitlines()[2] == "| a\\|b |  |"
    assert text.html_table(rows, ["x", "y"]) == "<table><tr><th>x</th><th>y</th></tr><tr><td>a|b</td><td></td></tr></table>"


def test_failures(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, True, None, None), (3, None, "Failed", None), (4, None, "odd", None), (5, None, None, False)], "id int, is_error boolean, status string, patch_success boolean")
    assert [r["id"] for r in conversations.tool_failures(df).where("failed").orderBy("id").collect()] == [2, 3, 5]


def test_browse_names_projects_and_models(spark):
    t = spark.createDataFrame([(1, 1, "/a", "x", "m2", False), (1, 2, "/a", None, "m9", True), (2, 1, None, None, None, True)], "conv_id long, ts long, cwd string, branch string, model string, main boolean")
    got = {r["conv_id"]: r for r in conversations.browse(t, spark.createDataFrame([("/a", "root")], "cwd string, root string")).collect()}
    assert (got[1]["branch"], got[1]["project"], got[1]["models"]) == ("x", "root", ["m9", "m2"]) and (got[2]["project"], got[2]["models"]) == ("", None)


def test_titles_and_files(spark):
    t = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 3, ""), (2, 1, None)], "conv_id long, turn long, title string")
    assert [tuple(r) for r in conversations.titles(t).collect()] == [(1, "new")]
    f = spark.createDataFrame([(1, "src/A.py", 1, 3), (1, "src/A.py", 1, 7), (2, "b.ts", 1, 1)], "conv_id long, path string, touches long, last_turn long")
    assert [tuple(r) for r in conversations.file_search(f, "a.P").collect()] == [(1, "src/A.py", 7)]


def test_sorting_and_providers(spark):
    df = spark.createDataFrame([("b", 1.0), ("A", 1.0), ("c", None)], "n string, v double")
    for down in (True, False):
        assert [r["n"] for r in reports.sorted_by(df, "v", "n", down).collect()] == ["A", "b", "c"]
    with pytest.raises(ValueError):
        reports.combine_providers([("a", None)], "n", ["v"])


def test_thresholds():
    assert quota.validate_thresholds([50, 90]) == [50, 90]
    for bad in ([], [90, 50], [50, 50], [0, 5]):
        with pytest.raises(ValueError):
            quota.validate_thresholds(bad)
