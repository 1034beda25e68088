"""Rollups and high-water marks kept up to date by streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reports import merge_partials


def partials_sink(path: str, rollup: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: stores each batch's partial sums under its number, in place of what an earlier try left there, so every
    entry counts once whatever is run again. Late rows go to their own buckets; no watermark drops them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_partials(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The rollup over all batches: partial sums are added up, entries are not read again."""
    return merge_partials([spark.read.parquet(path)], keys, sums)


def compact_partials(spark: SparkSession, path: str, to: str, keys: list[str], sums: list[str]) -> None:
    """All batches as one, in a new place."""
    read_partials(spark, path, keys, sums).write.mode("overwrite").parquet(f"{to}/batch=0")


def touched_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose results a batch changes; joined to a stored table they tell what to compute anew."""
    return batch.select(*keys).distinct()


def refresh(stored: DataFrame, entries: DataFrame, batch: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored`` with the rows of the keys that ``batch`` touches computed anew from ``entries``; for results that don't add up, such as medians."""
    dirty = touched_keys(batch, keys)
    return stored.join(dirty, keys, "left_anti").unionByName(compute(entries.join(dirty, keys, "left_semi")))


def dirty_groups(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The groups that a change feed (before, after: structs of a row, null where there is none) dirties: those of the old images and those of the new, as a row that moves changes two."""
    old, new = (feed.where(F.col(side).isNotNull()).select(*[F.col(f"{side}.{k}").alias(k) for k in keys]) for side in ("before", "after"))
    return old.union(new).distinct()


def apply_feed(rows: DataFrame, feed: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a feed's changes made: rows whose id has an old image go, new images come. One change an id."""
    gone = feed.where("before is not null").select(F.col(f"before.{id_col}").alias(id_col))
    return rows.join(gone, id_col, "left_anti").select(*rows.columns).unionByName(feed.where("after is not null").select("after.*").select(*rows.columns))


def refresh_groups(stored: DataFrame, rows: DataFrame, feed: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored`` brought up to date after a feed: groups that it dirties are computed anew from ``rows``, which have the changes, all others stay. A group without rows goes. Null keys are groups."""
    dirty = dirty_groups(feed, keys)

    def semi(df: DataFrame, how: str) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}"))
        return df.alias("r").join(dirty.alias("d"), same, how)

    return semi(stored, "left_anti").unionByName(compute(semi(rows, "left_semi")))


def high_water(samples: DataFrame, by: str) -> DataFrame:
    """(key, ts, seq, clamped) of a stream of samples (key, ts, seq, percent): the percent to a tenth, never below an earlier one of its
    key. State per key: the highest so far."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        high = state.get[0] if state.exists else float("-inf")
        clamped = ((rows["percent"] * 10 + 0.5) // 1).div(10).cummax().clip(lower=high)
        state.update((float(clamped.iloc[-1]),))
        yield pd.DataFrame({by: key[0], "ts": rows["ts"].to_numpy(), "seq": rows["seq"].to_numpy(), "clamped": clamped.to_numpy()})

    return samples.groupBy(by).applyInPandasWithState(step, f"{by} long, ts timestamp, seq long, clamped double", "high double", "append", GroupStateTimeout.NoTimeout)


def alert_scope(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys whose state is new, gone or different since the last evaluation: what alerts must look at."""
    b, a = before.select(*keys, F.col(digest).alias("_b")), after.select(*keys, F.col(digest).alias("_a"))
    return a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
