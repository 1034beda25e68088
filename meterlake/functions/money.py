"""Prices and costs as column expressions over a joined price dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TIER = 200_000
CUMULATIVE_TIER = 272_000
#: A cache write kept for an hour costs this many times the input rate.
HOUR_WRITE_FACTOR = 2.0
PRICE_COLUMNS = "model string, input_rate double, output_rate double, create_rate double, read_rate double, input_hi double, output_hi double, create_hi double, read_hi double, fast_factor double"

#: Prices used with the driver's tables, by event type (USD per token; ``_hi`` beyond the tier).
SAMPLE_PRICES = [
    ("click", 3e-6, 1.5e-5, 3.75e-6, 3e-7, 6e-6, 2.25e-5, 7.5e-6, 6e-7, 2.0),
    ("purchase", 1.5e-5, 7.5e-5, 1.875e-5, 1.5e-6, None, None, None, None, 6.0),
    ("signup", 8e-7, 4e-6, 1e-6, 8e-8, None, None, None, None, None),
    ("view", 1.25e-6, 1e-5, 0.0, 1.25e-7, 2.5e-6, 1.5e-5, None, 2.5e-7, None),
    ("error", 1e-6, 5e-6, 1.25e-6, 1e-7, None, None, None, None, None),
]


def sample_prices(spark: SparkSession) -> DataFrame:
    cell = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else f"double('{x!r}')"
    rows = ", ".join(f"({', '.join(map(cell, r))})" for r in SAMPLE_PRICES)
    return spark.sql(f"select * from values {rows} as t({', '.join(c.split()[0] for c in PRICE_COLUMNS.split(', '))})")


def bare_model(model: Column, prefixes: tuple[str, ...]) -> Column:
    bare = model
    for p in prefixes:
        bare = F.when(model.startswith(p), F.substring(model, len(p) + 1, 1000)).otherwise(bare)
    return bare


def with_prices_or_fallback(entries: DataFrame, prices: DataFrame, aliases: DataFrame, fallback: str, prefixes: tuple[str, ...] = ("anthropic/", "anthropic.", "openai/")) -> DataFrame:
    """``with_prices`` for a vendor whose unknown models are charged like the model ``fallback``: the name as it is, else without a vendor
    prefix, else the one that ``aliases`` (alias, model) gives it, else the fallback, which ``is_fallback`` tells. Spark
    broadcasts both lists, as it knows how small they are."""
    known = prices.select(F.col("model").alias("known")).distinct()
    e = entries.withColumn("_bare", bare_model(F.col("model"), prefixes))
    e = e.join(aliases.select(F.col("alias").alias("_bare"), F.col("model").alias("_alias")), "_bare", "left")
    for name, key in (("_k0", "model"), ("_k1", "_bare"), ("_k2", "_alias")):
        e = e.join(known.withColumnRenamed("known", name), F.col(key) == F.col(name), "left")
    e = e.withColumn("price_key", F.coalesce("_k0", "_k1", "_k2", F.lit(fallback))).withColumn("is_fallback", F.coalesce("_k0", "_k1", "_k2").isNull()).drop("_bare", "_alias", "_k0", "_k1", "_k2")
    return e.join(prices.withColumnRenamed("model", "price_key"), "price_key", "left")


def with_prices(entries: DataFrame, prices: DataFrame, prefixes: tuple[str, ...] = ("anthropic/", "anthropic.", "openai/")) -> DataFrame:
    """A left join on the model's name, or on the name without a vendor prefix; a miss leaves the rates null.

    The price list has one row per model. Given as values or a small table, Spark knows its size and broadcasts it, and otherwise sees it at run
    time; entries have few distinct models, so a shuffle on them would put most of a log in one task.
    """
    return entries.withColumn("price_key", bare_model(F.col("model"), prefixes)).join(prices.withColumnRenamed("model", "price_key"), "price_key", "left").drop("price_key")


def tiered(tokens: Column, rate: Column, hi: Column, threshold: int = TIER) -> Column:
    """Tokens up to the threshold at the base rate and the rest at the higher one, if there is one."""
    return F.when(tokens <= 0, 0.0).when((tokens > threshold) & hi.isNotNull(), F.lit(threshold) * rate + (tokens - threshold) * hi).otherwise(tokens * rate)


def cache_create_cost(flat: Column, hour: Column) -> Column:
    """Cache writes by lifetime: the part kept for an hour at twice the input rate, the remainder at the write rate, both
    split at the tier in the same proportion. No known hour part: plain tiered price."""
    h = F.greatest(F.lit(0), F.least(F.coalesce(hour, F.lit(0)), flat))
    below, above, part = F.least(flat, F.lit(TIER)), F.greatest(F.lit(0), flat - TIER), h / flat
    rate, hi = F.col("create_rate"), F.coalesce("create_hi", "create_rate")
    long_rate, long_hi = F.col("input_rate") * HOUR_WRITE_FACTOR, F.coalesce("input_hi", "input_rate") * HOUR_WRITE_FACTOR
    split = (below * part) * long_rate + (above * part) * long_hi + (below * (1 - part)) * rate + (above * (1 - part)) * hi
    return F.when((flat <= 0) | (h <= 0), tiered(flat, rate, F.col("create_hi"))).otherwise(split)


def _tiered(tokens: str, rate: str, hi: str) -> str:
    return f"CASE WHEN {tokens} <= 0 THEN 0D WHEN {tokens} > {TIER} AND {hi} IS NOT NULL THEN {TIER} * {rate} + ({tokens} - {TIER}) * {hi} ELSE {tokens} * {rate} END"


def _create(hour: str) -> str:
    """Cache writes as ``cache_create_cost`` prices them."""
    flat = "cache_create_tokens"
    plain = _tiered(flat, "create_rate", "create_hi")
    if not hour:
        return plain
    h = f"greatest(0, least(coalesce({hour}, 0), {flat}))"
    below, above, part = f"least({flat}, {TIER})", f"greatest(0, {flat} - {TIER})", f"({h} / {flat})"
    split = (f"({below} * {part}) * (input_rate * {HOUR_WRITE_FACTOR}D) + ({above} * {part}) * (coalesce(input_hi, input_rate) * {HOUR_WRITE_FACTOR}D)"
             f" + ({below} * (1 - {part})) * create_rate + ({above} * (1 - {part})) * coalesce(create_hi, create_rate)")
    return f"CASE WHEN {flat} <= 0 OR {h} <= 0 THEN {plain} ELSE {split} END"


def entry_cost(mode: str = "auto", hour_split: bool = True) -> Column:
    """The cost of an entry with its prices joined. ``display``: the recorded cost or 0; ``auto``: the recorded cost if there is
    one; ``calculate``: from tokens. Unknown models cost 0. Fast entries are multiplied."""
    if mode not in ("auto", "calculate", "display"):
        raise ValueError(f"unknown cost mode {mode!r}")
    if mode == "display":
        return F.coalesce("cost_usd_raw", F.lit(0.0))
    # one expression as text is built far faster than the same as nested columns
    total = " + ".join(f"({x})" for x in (_tiered("input_tokens", "input_rate", "input_hi"), _tiered("output_tokens", "output_rate", "output_hi"), _create("cache_1h_tokens" if hour_split else ""), _tiered("cache_read_tokens", "read_rate", "read_hi")))
    total = f"CASE WHEN input_rate IS NULL THEN 0D ELSE ({total}) * CASE WHEN speed = 'fast' THEN coalesce(fast_factor, 1D) ELSE 1D END END"
    return F.expr(f"coalesce(cost_usd_raw, {total})" if mode == "auto" else total)


def cumulative_entry_cost(input_tokens: Column, cached: Column, output: Column) -> Column:
    """Input that includes cached tokens, output that includes reasoning: only what is not cached costs the input rate."""
    def part(tokens: Column, rate: Column, hi: Column) -> Column:
        return F.when((tokens <= 0) | (F.coalesce(rate, F.lit(0.0)) == 0), 0.0).otherwise(tiered(tokens, rate, hi, CUMULATIVE_TIER))

    total = part(F.greatest(F.lit(0), input_tokens - cached), F.col("input_rate"), F.col("input_hi")) + part(cached, F.col("read_rate"), F.col("read_hi")) + part(output, F.col("output_rate"), F.col("output_hi"))
    return F.when(F.col("speed") == "fast", total * F.coalesce("fast_factor", F.lit(2.0))).otherwise(total)


def cache_dollars() -> Column:
    """struct(saved, wasted): what reads saved against input, what writes cost beyond input, at each call's blended tier rate."""
    def blended(tokens: Column, rate: Column, hi: Column) -> Column:
        return F.when(tokens <= 0, 0.0).when((tokens > TIER) & hi.isNotNull(), (F.lit(TIER) * rate + (tokens - TIER) * hi) / tokens).otherwise(rate)

    create, read = F.col("cache_create_tokens"), F.col("cache_read_tokens")
    fast = F.when(F.col("speed") == "fast", F.coalesce("fast_factor", F.lit(1.0))).otherwise(1.0)
    base_read, read_rate = blended(read, F.col("input_rate"), F.col("input_hi")) * fast, blended(read, F.col("read_rate"), F.col("read_hi")) * fast
    base_create, create_rate = blended(create, F.col("input_rate"), F.col("input_hi")) * fast, blended(create, F.col("create_rate"), F.col("create_hi")) * fast
    h = F.greatest(F.lit(0), F.least(F.coalesce("cache_1h_tokens", F.lit(0)), create))
    extra = F.greatest(F.lit(0.0), create_rate - base_create)
    wasted = F.when(h <= 0, create * extra).otherwise(h * F.greatest(F.lit(0.0), base_create * HOUR_WRITE_FACTOR - base_create) + (create - h) * extra)
    saved = read * F.greatest(F.lit(0.0), base_read - read_rate)
    known = F.col("input_rate").isNotNull()
    return F.struct(F.when(known, saved).otherwise(0.0).alias("saved"), F.when(known, wasted).otherwise(0.0).alias("wasted"))


def nano(cost: Column) -> Column:
    """A cost in whole billionths of a dollar: sums of these don't depend on the order of rows or partitions."""
    return F.floor(cost * 1e9 + 0.5).cast("long")


def stable_sum(cost: Column) -> Column:
    """The sum of a cost in dollars, the same for any partitioning. Each cost is rounded to a billionth of a dollar first, so the sum
    is exact in billionths and not the exactly rounded sum of the doubles: they differ by at most half a billionth an entry."""
    return F.sum(nano(cost)) / F.lit(1e9)


def hit_percent(input_tokens: Column, create: Column, read: Column) -> Column:
    """Cache reads in percent of all input; 0 if there was none."""
    total = input_tokens + create + read
    return F.when(total == 0, 0.0).otherwise(read / total * 100)


def severity(threshold: Column) -> Column:
    return F.when(threshold >= 100, "critical").when(threshold >= 90, "warn").otherwise("info")


def whole_percent(x: Column) -> Column:
    """The whole percent that x has reached, robust to a last binary digit."""
    return F.floor(x + 1e-9)
