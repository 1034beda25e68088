"""Exactly rounded sums."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from meterlake.operators.exact import exact_sum


def cases():
    rng = random.Random(1)
    wild = [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randrange(-1074, 1000)) for _ in range(400)]
    return {
        "cents": [0.1] * 10 + [0.01 * i for i in range(100)], "cancelling": [1e16, 1.0, -1e16, 1e-16, 3.0, -3.0], "wild": wild, "undone": wild + [-x for x in wild] + [5e-324],
        "small": [5e-324] * 3 + [2.2250738585072014e-308, -2.2250738585072014e-308], "large": [1.7e308, -1.7e308, 1.7e308, 1.0], "powers": [math.ldexp(1.0, i) for i in range(-1074, 900, 7)] + [math.nextafter(math.ldexp(1.0, i), 0) for i in range(-1000, 900, 11)],
        "ties": [1.0, 2.0**-53], "ties up": [1.0, 2.0**-53, 2.0**-90], "zero": [0.0, -0.0], "one": [-3.25]}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_fsum(spark, parts):
    rows = [(k, x, 1) for k, xs in cases().items() for x in xs] + [("cents", None, 1), ("none", None, 1), (None, 2.5, 1), (None, 0.5, 1)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double, n int").repartition(parts)
    got = {r["k"]: (r["s"], r["n"]) for r in exact_sum(df, ["k"], F.col("x"), "s").collect()}
    assert got == {k: (math.fsum(xs), len(xs)) for k, xs in cases().items()} | {"none": (None, 0), None: (3.0, 2)}
    assert got["wild"][0] == float(sum(map(Fraction, cases()["wild"])))


def test_no_finite_sum(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("over", 1.7e308), ("over", 1.7e308), ("under", -1.7e308), ("under", -1.7e308), ("inf", inf), ("inf", 1.0), ("minus", -inf), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 1.0), ("nan", inf)]
    got = {r["k"]: r["s"] for r in exact_sum(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x"), "s").collect()}
    assert got["over"] == got["inf"] == inf and got["under"] == got["minus"] == -inf and math.isnan(got["both"]) and math.isnan(got["nan"])


def test_without_keys_or_rows(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert [tuple(r) for r in exact_sum(df, [], F.col("x"), "s").collect()] == [(math.fsum([0.1, 0.2, 0.3]), 3)]
    assert exact_sum(df.where("false").withColumn("k", F.lit(1)), ["k"], F.col("x"), "s").count() == 0
