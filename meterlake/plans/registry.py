"""Registration of queries with the SQL that tells what they must return, and SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import SAMPLE_PRICES, entry_cost, sample_prices, with_prices
from ..sources.tables import usage_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The driver's error events stand for entries of a synthetic model.
SYNTHETIC = "error"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return usage_from_events(spark, sf_dir)


def priced(spark: SparkSession, sf_dir: str, mode: str = "auto", hour_split: bool = False) -> DataFrame:
    """Usage without synthetic entries, with prices and ``cost``."""
    u = usage(spark, sf_dir).where(F.col("model") != SYNTHETIC)
    return with_prices(u, sample_prices(spark)).withColumn("cost", entry_cost(mode, hour_split))


USAGE_SQL = """u AS (
  SELECT event_id AS entry_id, ts, user_id AS session_id, event_type AS model, user_id % 7 AS project, user_id % 3 AS account, k, value,
    k * 4000 AS input_tokens, k * 50 AS output_tokens, k * 20 AS cache_create_tokens, k * 200 AS cache_read_tokens,
    CASE WHEN event_id % 3 = 0 THEN k * 8 END AS cache_1h_tokens, CASE WHEN event_id % 2 = 0 THEN value END AS cost_usd_raw,
    CASE WHEN event_id % 5 = 0 THEN 'fast' END AS speed
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
)"""


def _literal(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE"


PRICES_SQL = (
    "prices AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_literal, r))})" for r in SAMPLE_PRICES)
    + ") t(model, input_rate, output_rate, create_rate, read_rate, input_hi, output_hi, create_hi, read_hi, fast_factor))"
)


def tier_sql(tokens: str, rate: str, hi: str, threshold: int = 200_000) -> str:
    return f"CASE WHEN {tokens} <= 0 THEN 0.0::DOUBLE WHEN {tokens} > {threshold} AND {hi} IS NOT NULL THEN {threshold} * {rate} + ({tokens} - {threshold}) * {hi} ELSE {tokens} * {rate} END"


CREATE_SQL = tier_sql("cache_create_tokens", "create_rate", "create_hi")
_H = "greatest(0, least(coalesce(cache_1h_tokens, 0), cache_create_tokens))"
_PART = f"({_H} / cache_create_tokens)"
_BELOW, _ABOVE = "least(cache_create_tokens, 200000)", "greatest(0, cache_create_tokens - 200000)"
CREATE_SPLIT_SQL = (
    f"CASE WHEN cache_create_tokens <= 0 OR {_H} <= 0 THEN {CREATE_SQL} ELSE ({_BELOW} * {_PART}) * (input_rate * 2.0::DOUBLE) + ({_ABOVE} * {_PART}) * (coalesce(input_hi, input_rate) * 2.0::DOUBLE)"
    f" + ({_BELOW} * (1 - {_PART})) * create_rate + ({_ABOVE} * (1 - {_PART})) * coalesce(create_hi, create_rate) END"
)


def calculated_sql(create: str = CREATE_SQL) -> str:
    total = f"({tier_sql('input_tokens', 'input_rate', 'input_hi')}) + ({tier_sql('output_tokens', 'output_rate', 'output_hi')}) + ({create}) + ({tier_sql('cache_read_tokens', 'read_rate', 'read_hi')})"
    return f"CASE WHEN input_rate IS NULL THEN 0.0::DOUBLE WHEN speed = 'fast' THEN ({total}) * coalesce(fast_factor, 1.0::DOUBLE) ELSE {total} END"


COST_SQL = {"auto": f"coalesce(cost_usd_raw, {calculated_sql()})", "calculate": calculated_sql(), "display": "coalesce(cost_usd_raw, 0.0::DOUBLE)"}


def priced_sql(mode: str = "auto") -> str:
    """The start of a query: CTEs u, prices and e, usage without synthetic entries with ``cost``."""
    return f"WITH {USAGE_SQL}, {PRICES_SQL}, e AS (SELECT u.*, input_rate, output_rate, create_rate, read_rate, input_hi, output_hi, create_hi, read_hi, fast_factor, {COST_SQL[mode]} AS cost FROM u LEFT JOIN prices USING (model) WHERE model <> '{SYNTHETIC}')"


def nano_sql(x: str) -> str:
    return f"floor(({x}) * 1e9 + 0.5::DOUBLE)::BIGINT"


def sum_sql(x: str = "cost") -> str:
    return f"sum({nano_sql(x)})::DOUBLE / 1e9"


TOKEN_SUMS_SQL = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_create_tokens)::BIGINT AS cache_create_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens"
ROLLUP_SQL = f"{TOKEN_SUMS_SQL}, {sum_sql()} AS cost_usd, count(*) AS entries"
