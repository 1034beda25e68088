"""Sums of doubles that are rounded once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the parts of a number that are added up as whole numbers; so many rows as 2 ** (63 - PART) don't overflow a sum.
PART = 19
#: Bins of what is no finite number.
INF, MINUS_INF, NAN = 9001, 9002, 9003


def exact_sum(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """(*by, name, n): the sum of a double per key as if added with no rounding and rounded once, ties to the even neighbour; the same for any order
    and partitioning. ``n`` counts known values; with none the sum is null.

    A double is a whole number times a power of two. Values of one power make a bin, of which there are some dozens in practice and
    2,100 at most, whatever the rows; a bin's whole numbers are cut in three parts, which add up in ordinary partial sums. Only then are
    a key's bins put together and rounded. A sum beyond the doubles is infinite; infinities of both signs, or a value that is not a
    number, give NaN."""
    x = value.cast("double")
    a = F.abs(x)
    kind = F.when(F.isnan(x), NAN).when(x == float("inf"), INF).when(x == float("-inf"), MINUS_INF)
    # the exponent may be off by one, for which there is a bit to spare
    q = F.greatest(F.floor(F.log2(F.when(kind.isNull() & (a > 0), a).otherwise(1.0))) - 53, F.lit(-1074)).cast("int")
    two = lambda n: F.pow(F.lit(2.0), n)
    half = F.floor(-F.col("_q") / 2)
    cut = rows.where(value.isNotNull()).select(*by, x.alias("_x"), kind.alias("_kind"), q.alias("_q"))
    # in two steps, as a power beyond the doubles is no factor
    m = F.when(F.col("_kind").isNull(), F.abs(F.col("_x") * two(half) * two(-F.col("_q") - half))).otherwise(0.0).cast("long")
    cut = cut.select(*by, F.coalesce("_kind", "_q").alias("_q"), F.signum("_x").alias("_s"), m.alias("_m"))
    sign = F.when(F.isnan("_s"), 0.0).otherwise(F.col("_s")).cast("long")
    part = lambda i: (F.shiftright("_m", i * PART).bitwiseAND(F.lit((1 << PART) - 1)) * sign)
    bins = cut.groupBy(*by, "_q").agg(F.sum(part(0)).alias("a"), F.sum(part(1)).alias("b"), F.sum(part(2)).alias("c"), F.count("*").alias("_n"))
    whole = bins.groupBy(*by).agg(F.collect_list(F.struct("_q", "a", "b", "c")).alias("_bins"), F.sum("_n").alias("n"))
    has = lambda q: F.exists("_bins", lambda b: b["_q"] == q)
    total = F.when(has(NAN) | (has(INF) & has(MINUS_INF)), F.lit(float("nan"))).when(has(INF), F.lit(float("inf"))).when(has(MINUS_INF), F.lit(float("-inf")))
    known = whole.select(*by, total.otherwise(F.pandas_udf(_round_once, "double")("_bins")).alias(name), "n")
    if not by:
        return known
    keys = rows.select(*by).distinct()
    same = [keys[c].eqNullSafe(known[c]) for c in by]
    return keys.join(known, same, "left").select(*[keys[c] for c in by], name, F.coalesce("n", F.lit(0)).alias("n"))


def _round_once(bins: pd.Series) -> pd.Series:
    def one(parts) -> float:
        total = sum((int(p["a"]) + (int(p["b"]) << PART) + (int(p["c"]) << 2 * PART)) << int(p["_q"]) + 1074 for p in parts if p["_q"] <= 1024)
        try:
            return total / (1 << 1074)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return bins.map(one)
