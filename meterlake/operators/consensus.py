"""Which reading of a quota is published: a lower value waits until every source of its window has confirmed it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``kind``: reading (token, received_at, percent, window_key, raw), the latest of its token; published (percent, window_key, raw, generation), what is public now; tombstone
#: (state inflight, committed or none, through), which shuts readings out; tick, at whose instant ``at`` is decided.
TRACE = "axis long, seq long, at long, kind string, token string, received_at long, percent double, window_key long, raw long, generation long, state string, through long"
DECISION = "axis long, seq long, action string, percent double, window_key long, raw long, stage string, tries int"

# Seconds for which a reading counts, and by how many it may be ahead of the clock.
ACTIVE, AHEAD = 90, 5


def new_axis() -> dict:
    """``waiting``: the drop that waits, if any: its window, target, stage, tries and what was tried, and by token when it was first seen and whether it has been confirmed since."""
    return {"readings": {}, "published": None, "tombstone": None, "waiting": None}


def counted(s: dict, now: int) -> list[tuple[str, dict]]:
    """Readings inside the activity window that no tombstone shuts out."""
    stone = s["tombstone"] or {"state": "none", "through": None}

    def shut(r: dict) -> bool:
        return stone["state"] == "inflight" or stone["state"] == "committed" and stone["through"] is not None and r["received_at"] <= stone["through"]

    return [(t, r) for t, r in s["readings"].items() if -AHEAD <= now - r["received_at"] < ACTIVE and not shut(r)]


def decide(s: dict, now: int) -> tuple:
    """(action, percent, window_key, raw, stage, tries) at an instant; changes ``s["waiting"]``.

    The newest window counts, and in it the highest percent. It is published if nothing is, if its window is newer or its percent higher. One as high ends a
    wait. A lower one begins a wait in which each reading's token must come again; a correction upward, still lower, begins another. A confirmed drop
    is handed on twice at most, until the reading or what is published changes."""
    live, public, waiting = counted(s, now), s["published"], s["waiting"]
    quiet = lambda changed: ("write" if changed else "none", None, None, None)

    def told(head: tuple, keep: dict | None) -> tuple:
        s["waiting"] = keep
        return (*head, keep["stage"] if keep else None, keep["tries"] if keep else None)

    if not live:
        return told(quiet(waiting is not None), None)
    window = max(r["window_key"] for _, r in live)
    members = [(t, r) for t, r in live if r["window_key"] == window]
    top = max(r["percent"] for _, r in members)
    same = public is not None and public["window_key"] == window
    raw = public["raw"] if same else min(r["raw"] for _, r in members if r["percent"] == top)
    publish = ("publish", top, window, raw)
    if public is None or window > public["window_key"]:
        return told(publish, None)
    if window < public["window_key"]:
        return told(quiet(False), waiting)
    if top > public["percent"]:
        return told(publish, None)
    if top == public["percent"]:
        return told(quiet(waiting is not None), None)
    if waiting is None or waiting["window_key"] != window or top > waiting["target"]:
        fresh = {"window_key": window, "target": top, "stage": "settling", "tries": 0, "tried": None, "seen": {t: [r["received_at"], False] for t, r in members}}
        return told(quiet(True), fresh)
    seen = {}
    for t, r in members:
        first, confirmed = waiting["seen"].get(t, (r["received_at"], False))
        seen[t] = [first, confirmed or r["received_at"] > first]
    after = waiting | {"seen": seen}
    attempt = [window, top, public["window_key"], public["percent"], public["generation"]]
    again = waiting["tried"] == attempt and waiting["stage"] != "settling"
    if not all(confirmed for _, confirmed in seen.values()) or again and waiting["stage"] == "suppressed":
        return told(quiet(after != waiting), after)
    stage, tries = ("suppressed", 2) if again else ("zero" if top == 0 else "ready", 1)
    return told(publish, after | {"stage": stage, "tries": tries, "tried": attempt})


def take(s: dict, row: dict) -> tuple | None:
    """Takes one row of a trace; a tick gives a decision."""
    kind = row["kind"]
    if kind == "reading":
        s["readings"][row["token"]] = {k: row[k] for k in ("received_at", "percent", "window_key", "raw")}
    elif kind == "published":
        s["published"] = {k: row[k] for k in ("percent", "window_key", "raw", "generation")}
    elif kind == "tombstone":
        s["tombstone"] = {"state": row["state"], "through": row["through"]}
    elif kind == "tick":
        found = decide(s, row["at"])
        # what is long past never counts again
        s["readings"] = {t: r for t, r in s["readings"].items() if row["at"] - r["received_at"] < 10 * ACTIVE}
        return found
    return None


_NAMES = [c.split()[0] for c in TRACE.split(", ")]
_OUT = pa.schema([("axis", pa.int64()), ("seq", pa.int64()), ("action", pa.string()), ("percent", pa.float64()), ("window_key", pa.int64()), ("raw", pa.int64()), ("stage", pa.string()), ("tries", pa.int32())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    axis, s = None, new_axis()
    for b in batches:
        rows = []
        for row in b.to_pylist():
            if row["axis"] != axis:
                axis, s = row["axis"], new_axis()
            found = take(s, row)
            if found:
                rows.append((axis, row["seq"], *found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def decisions(trace: DataFrame) -> DataFrame:
    """(``DECISION``) of a ``TRACE``, by axis in order of ``seq``. Axes are dealt over tasks and sorted; a task holds one axis's state, which is its recent readings. Rows without an axis are left out."""
    return trace.where("axis is not null").select(*_NAMES).repartition("axis").sortWithinPartitions("axis", "seq").mapInArrow(_fold, DECISION)


class Consensus(StatefulProcessor):
    """The state of an axis from batch to batch; the rows of a batch are taken in order of ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("axis", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = json.loads(self.state.get()[0]) if self.state.exists() else new_axis()
        whole = lambda x: None if pd.isna(x) else int(x)
        numbers = ("seq", "at", "received_at", "window_key", "raw", "generation", "through")
        found = []
        for row in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            row = {k: whole(v) if k in numbers else (None if k == "percent" and pd.isna(v) else v) for k, v in row.items()}
            decision = take(s, row)
            if decision:
                found.append((int(key[0]), row["seq"], *decision))
        self.state.update((json.dumps(s),))
        out = pd.DataFrame(found, columns=[c.split()[0] for c in DECISION.split(", ")])
        yield out.astype({"percent": "float64", "window_key": "Int64", "raw": "Int64", "tries": "Int32"})

    def close(self) -> None:
        pass


def stream_decisions(trace: DataFrame) -> DataFrame:
    """``decisions`` of a stream whose rows of an axis come in order. Needs the RocksDB state store."""
    return trace.groupBy("axis").transformWithStateInPandas(Consensus(), DECISION, "append", "none")
