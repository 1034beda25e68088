"""Alert evaluations as they fall due: timers wake a root that has no new rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "root long, at timestamp, reason string, percent double, crossed int"


def new_root() -> dict:
    """What is kept of a root: changes whose instant has not come, boundaries armed, gate, rule, the latest capture that counts and those ahead."""
    return {"waiting": [], "armed": [], "gate": "closed", "rule": None, "latest": None, "ahead": []}


def advance(s: dict, until: int) -> list[tuple]:
    """Takes all changes and boundaries of a root up to ``until`` (microseconds) in order; returns (at, reason, percent, crossed)."""
    out = []

    def evaluate(at: int, reason: str) -> None:
        percent = s["latest"] and s["latest"][3]
        crossed = sum(float(t) <= percent for t in s["rule"].split(",")) if s["rule"] and percent is not None else 0
        out.append((at, reason, percent, crossed))

    s["waiting"].sort(key=lambda c: (c["at"], c["seq"]))
    while True:
        # a capture ahead comes to count at its instant, whether or not the gate is open
        due = [("row", s["waiting"][0]["at"], 0)] if s["waiting"] else []
        due += [("capture", min(a[0] for a in s["ahead"]), 1)] if s["ahead"] else []
        due = [d for d in due if d[1] <= until]
        if not due:
            return out
        what, at, _ = min(due, key=lambda d: d[1:])
        if what == "capture":
            s["latest"] = max([a for a in s["ahead"] if a[0] == at] + ([s["latest"]] if s["latest"] else []))
            s["ahead"] = [a for a in s["ahead"] if a[0] != at]
            if at in s["armed"]:
                s["armed"].remove(at)
                evaluate(at, "scheduled")
            continue
        c = s["waiting"].pop(0)
        if c["kind"] == "gate":
            before, s["gate"] = s["gate"], c["value"]
            if s["gate"] != "open":
                s["armed"] = []
                if before == "open":
                    out.append((at, "gate_disabled", None, None))
            elif before != "open":
                s["armed"] = sorted({a[0] for a in s["ahead"]})
                evaluate(at, "gate_enabled")
        elif c["kind"] == "rule":
            before, s["rule"] = s["rule"], c["value"] if c["value"] is not None else s["rule"]
            if s["gate"] == "open" and before != s["rule"]:
                s["armed"] = sorted({a[0] for a in s["ahead"]})
                evaluate(at, "rule_changed")
        elif c["kind"] == "observation":
            capture = [c["capture_at"], at, c["seq"], c["percent"]]
            if c["capture_at"] is not None and c["capture_at"] > at:
                s["ahead"].append(capture)
                if s["gate"] == "open" and c["capture_at"] not in s["armed"]:
                    s["armed"].append(c["capture_at"])
            elif c["capture_at"] is not None:
                s["latest"] = max(s["latest"], capture) if s["latest"] else capture
            if s["gate"] == "open":
                evaluate(at, "window_dirty")


class Evaluator(StatefulProcessor):
    """A change is taken when the watermark passes its instant, so results don't depend on how rows fall into batches; the next instant of a
    root, a change's or a boundary's, has a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("root", "json string")

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else new_root()

    def _store(self, s: dict, after_ms: int) -> None:
        self.state.update((json.dumps(s),))
        times = [c["at"] for c in s["waiting"]] + [a[0] for a in s["ahead"]]
        if times:
            self.handle.registerTimer(max(-(-min(times) // 1000), after_ms + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        us = lambda t: None if pd.isna(t) else pd.Timestamp(t).value // 1000
        for part in rows:
            for at, seq, kind, value, percent, capture in zip(part["at"], part["seq"], part["kind"], part["value"], part["percent"], part["capture_at"]):
                s["waiting"].append({"at": us(at), "seq": int(seq), "kind": kind, "value": value, "percent": None if pd.isna(percent) else float(percent), "capture_at": us(capture)})
        yield self._step(key, s, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._step(key, self._load(), timerValues.getCurrentWatermarkInMs())

    def _step(self, key: tuple, s: dict, watermark_ms: int) -> pd.DataFrame:
        found = advance(s, watermark_ms * 1000)
        self._store(s, watermark_ms)
        rows = [(key[0], pd.Timestamp(at, unit="us"), reason, percent, crossed) for at, reason, percent, crossed in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"percent": "float64", "crossed": "Int32"})

    def close(self) -> None:
        pass


def stream_evaluations(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What ``operators.alerts.evaluations`` gives up to the watermark, for a stream of changes; rows later than ``delay`` are lost, as for any
    watermark. Needs the RocksDB state store."""
    return changes.withWatermark("at", delay).groupBy("root").transformWithStateInPandas(Evaluator(), OUT, "append", "eventTime")
