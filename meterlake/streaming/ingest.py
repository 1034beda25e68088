"""Structured Streaming: log ingest, incremental rollups, stateful quota logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.money import nano
from ..sources.tables import classify_usage_lines


def stream_usage(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Usage entries of JSONL files as they arrive; the checkpoint of the query remembers which files were read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("line"))
    return classify_usage_lines(lines).where("skip_reason is null").drop("skip_reason")


def windowed_cost(entries: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Cost and entries per time window and model; the watermark only bounds the state, as late as ``late`` rows still count."""
    g = entries.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "model")
    return g.agg((F.sum(nano(F.col("cost"))) / F.lit(1e9)).alias("cost_usd"), F.count("*").alias("entries")).select(F.col("w.start").alias("start"), "model", "cost_usd", "entries")


def insert_absent_sink(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends rows whose key the table at ``path`` lacks, so a batch that is run again adds nothing. The table lies in
    ``buckets`` folders by a hash of the key (column ``_bucket``), and a batch reads the keys of those folders only that its own rows fall in."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.limit(0).write.mode("append").partitionBy("_bucket").parquet(path)  # there is a table from the first batch on
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        seen = batch.sparkSession.read.schema(rows.schema).parquet(path).where(F.col("_bucket").isin(touched or [-1])).select(*keys)
        rows.join(seen, keys, "left_anti").write.mode("append").partitionBy("_bucket").parquet(path)

    return write


def debounce(samples: DataFrame, by: str, drop: float = 25.0, floor: float = 1.0, floor_drop: float = 3.0) -> DataFrame:
    """(key, ts, action) for samples (key, ts, seq, percent), streaming or not: fire on a fall of ``drop`` or more; arm on the first
    fall to about zero; then confirm if the next is at most half of the percent before the fall, else clear.

    State per key: the last percent and the armed baseline.
    """
    out, state_type = f"{by} long, ts timestamp, seq long, action string", "last double, baseline double"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, baseline = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        found = []
        for ts, seq, percent in zip(rows["ts"], rows["seq"], rows["percent"]):
            action = decide(last, percent, baseline, drop, floor, floor_drop)
            if action == "arm":
                baseline = last
            elif action is not None:
                baseline = None
            if action:
                found.append((key[0], ts, seq, action))
            last = percent
        state.update((last, baseline))
        yield pd.DataFrame(found, columns=[by, "ts", "seq", "action"])

    return samples.groupBy(by).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)


def decide(last: float | None, percent: float, baseline: float | None, drop: float, floor: float, floor_drop: float) -> str | None:
    """One step of the debounce."""
    if last is None:
        return None
    fell = last - percent
    if fell >= drop:
        return "fire"
    if baseline is not None:
        return "confirm" if percent <= baseline / 2 else "clear"
    return "arm" if percent <= floor and fell >= floor_drop else None
