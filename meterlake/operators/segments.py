"""Turns cut into segments of bounded size at the best boundary within reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a group as a boundary: a title, a change to tools, none.
TITLE, TOOLS, NONE = 0, 1, 2


class Segmenter:
    """Takes groups (blocks, rank, first, last) in order and gives the sizes of segments as soon as they are settled.

    A segment takes groups while they fit in the ``budget``, one at least, and ends ahead of the best boundary that leaves it no less than
    ``budget`` less the ``lookback`` share of it, the earliest of the best. It then goes on until no later group begins (``first``) before one of its
    own ends (``last``). As only groups up to the budget and such spans are looked at, what is appended later changes no earlier segment
    but the last.
    """

    def __init__(self, budget: int, lookback: float):
        if budget <= 0 or not 0 <= lookback < 1:
            raise ValueError("a budget is positive and a share from 0 to less than 1")
        self.budget, self.floor = budget, budget - int(budget * lookback)
        self.groups: list[tuple] = []

    def feed(self, group: tuple) -> list[int]:
        self.groups.append(group)
        return self._settle(False)

    def finish(self) -> list[int]:
        out = self._settle(True)
        return out + [len(self.groups)] * bool(self.groups)

    def _settle(self, last: bool) -> list[int]:
        out = []
        while self.groups and (n := self._next(last)):
            out.append(n)
            del self.groups[:n]
        return out

    def _next(self, last: bool) -> int:
        """How many groups the next segment has; 0 while that is open."""
        g, used, end = self.groups, 0, 0
        best = (NONE, 0)
        while end < len(g) and (end == 0 or used + g[end][0] <= self.budget):
            if end and used >= self.floor and g[end][1] < best[0]:
                best = (g[end][1], end)
            used += g[end][0]
            end += 1
        if end == len(g) and not last:
            return 0
        end = best[1] or end
        upto = max((x[3] for x in g[:end] if x[3] is not None), default=None)
        while upto is not None and end < len(g) and g[end][2] is not None and g[end][2] <= upto:
            upto = max(upto, g[end][3] if g[end][3] is not None else upto)
            end += 1
        return 0 if end == len(g) and not last and upto is not None else end


def segments(groups: DataFrame, by: list[str], position: str, budget: int = 40, lookback: float = 0.25) -> DataFrame:
    """Adds ``segment``, from 0 in each key, to ``groups`` (*by, position, blocks, rank, first, last). Keys are dealt over tasks and sorted; a task holds the groups of one open segment."""
    key = F.to_json(F.struct(*by))
    schema = pa.schema([("_key", pa.string()), ("_at", pa.int64()), ("segment", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, number, cutter = None, [], 0, None
        rows: list[tuple] = []

        def close(sizes: list[int]) -> None:
            nonlocal number
            for n in sizes:
                rows.extend((at, p, number) for p in open_[:n])
                del open_[:n]
                number += 1

        for b in batches:
            for k, p, *group in zip(*(b.column(c).to_pylist() for c in ("_key", "_at", "blocks", "rank", "first", "last"))):
                if k != at:
                    if cutter:
                        close(cutter.finish())
                    at, open_, number, cutter = k, [], 0, Segmenter(budget, lookback)
                open_.append(p)
                close(cutter.feed(tuple(group)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows.clear()
        if cutter:
            close(cutter.finish())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ordered = groups.select(key.alias("_key"), F.col(position).cast("long").alias("_at"), F.col("blocks").cast("int").alias("blocks"), F.col("rank").cast("int").alias("rank"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    found = ordered.repartition("_key").sortWithinPartitions("_key", "_at").mapInArrow(run, "_key string, _at long, segment int")
    return groups.withColumn("_key", key).withColumn("_at", F.col(position).cast("long")).join(found, ["_key", "_at"]).drop("_key", "_at")
