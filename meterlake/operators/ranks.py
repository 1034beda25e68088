"""Places in a global order and medians of sliding windows, without a task that sees all rows."""

from __future__ import annotations

import tempfile
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the folder that ``spark.checkpoint.dir`` names, so that what follows reads one and the same result however often.
    Where none is named, a local folder will do while driver and executors are one process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()


#: Bits of a place within a partition in Spark's increasing ids.
WITHIN = (1 << 33) - 1


def placed(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Adds ``place``, from 1, in a total order of all rows: they are dealt by range and sorted, and each partition's places start after the
    rows of those before it, of which a row each is added up. Rows that ``order`` doesn't tell apart have places next to each other. Sorted rows are
    stored, as two passes must see them dealt alike."""
    dealt = checkpointed(rows.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33).alias("_p")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))
    return dealt.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("place", F.col("_before") + F.col("_i").bitwiseAND(F.lit(WITHIN)) + 1).drop("_p", "_i", "_before")


def _slide(window: int):
    """Sorted (key, unit, n, own, values) -> (key, n, samples, middle) of rows of their own unit, for the values of the ``window`` steps of n before
    them. What is held are the values of one window."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("samples", pa.int64()), ("middle", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, order = None, deque(), []
        for b in batches:
            rows = []
            for key, unit, n, own, values in zip(*(b.column(c).to_pylist() for c in ("key", "unit", "n", "own", "values"))):
                if (key, unit) != at:
                    at, held, order = (key, unit), deque(), []
                while held and held[0][0] < n - window:
                    for v in held.popleft()[1]:
                        del order[bisect_left(order, v)]
                if own:
                    m = len(order)
                    rows.append((key, n, m, (order[(m - 1) // 2] + order[m // 2]) / 2 if m else None))
                held.append((n, values))
                for v in values:
                    insort(order, v)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def sliding_median(rows: DataFrame, by: list[str], n: str, value: str, window: int, least: int) -> DataFrame:
    """Adds ``baseline``, the median of ``value`` over the ``window`` whole steps of ``n`` before a row, rows at its own step left out, and ``samples``; null
    if there are fewer than ``least``. For many rows a window: time is cut into units of a window, a unit is slid over by
    itself with the unit before it ahead, and each step adds and takes away its own values only. Values that aren't known don't count; a row
    without ``n`` has no samples."""
    key = F.to_json(F.struct(*by))
    unit = F.floor(F.col(n) / window)
    steps = rows.where(F.col(n).isNotNull()).groupBy(key.alias("key"), F.col(n).cast("long").alias("n"), unit.alias("_u")).agg(F.collect_list(F.col(value).cast("double")).alias("values"))
    spread = steps.select("key", "n", "values", F.explode(F.array(F.struct(F.col("_u").alias("unit"), F.lit(True).alias("own")), F.struct((F.col("_u") + 1).alias("unit"), F.lit(False).alias("own")))).alias("s"))
    ordered = spread.select("key", "s.unit", "n", "s.own", "values").repartition("key", "unit").sortWithinPartitions("key", "unit", "n")
    found = ordered.mapInArrow(_slide(window), "key string, n long, samples long, middle double")
    told = found.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("samples").alias("_s"), "middle")
    j = rows.withColumn("_key", key).withColumn("_n", F.col(n).cast("long")).join(told, ["_key", "_n"], "left")
    return j.withColumn("samples", F.coalesce("_s", F.lit(0)).cast("long")).withColumn("baseline", F.when(F.col("samples") >= least, F.col("middle"))).drop("_key", "_n", "_s", "middle")
