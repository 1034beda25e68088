"""Logs that are still being written: what is new of each file is read, and a parser's state is carried from batch to batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class GrowingFiles(DataSource):
    """Stream source ``growing_files``: (source_path, at, piece), the new bytes of the files under ``path`` that end in ``suffix``. Its
    offset is how far each file has been read, so the query's checkpoint knows, and a batch that is run again reads the same bytes. At most ``piece``
    bytes make a row and ``most`` bytes of a file a batch."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "source_path string, at long, piece binary"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return GrowingFilesReader(self.options)


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.piece, self.most = int(options.get("piece", 1 << 20)), int(options.get("most", 1 << 30))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Never further than ``most`` bytes past what was told before, so a backlog is read in several batches."""
        store, root = fs.FileSystem.from_uri(self.path)
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and f.path.endswith(self.suffix):
                self.seen[f.path] = max(self.seen.get(f.path, 0), min(f.size, self.seen.get(f.path, 0) + self.most))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        for path, at in start.items():  # after a restart
            self.seen[path] = max(self.seen.get(path, 0), at)
        return [Stretch(p, start.get(p, 0), e) for p, e in sorted(end.items()) if e > start.get(p, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.end, self.piece):
                f.seek(at)
                yield partition.path, at, bytes(f.read(min(self.piece, partition.end - at)))


def growing_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """New bytes of all files under ``path``, as they grow."""
    spark.dataSource.register(GrowingFiles)
    uri = path if "://" in path else f"file://{path}"
    return spark.readStream.format("growing_files").option("path", uri).options(**options).load()


COUNTS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
LINES = "source_path string, line_offset long, line string"
ENTRIES = f"source_path string, line_offset long, timestamp string, session_id string, model string, {', '.join(f'{c} long' for c in COUNTS)}"


def _number(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


class Reader(StatefulProcessor):
    """State per file: the offset up to which lines are done, the torn last line, and what the parser knows: session, model, whether the thread is a fork, and the
    cumulative total that an entry must exceed."""

    def __init__(self, parse: bool):
        self.parse = parse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "done long, torn binary, session string, model string, fork boolean, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, torn, session, model, fork, total = self.state.get() if self.state.exists() else (0, b"", None, None, False, 0)
        parts = pd.concat(list(rows)).sort_values("at")
        found = []
        for at, piece in zip(parts["at"], parts["piece"]):
            at, piece = int(at), bytes(piece)
            have = done + len(torn)
            if at + len(piece) <= have:
                continue  # read before
            if at > have:
                raise ValueError(f"bytes {have} to {at} of {key[0]} are missing")
            *lines, torn = (bytes(torn) + piece[have - at :]).split(b"\n")
            for raw in lines:
                line = raw.decode("utf-8", "replace")
                if not self.parse:
                    if line.strip():
                        found.append((key[0], done, line))
                else:
                    session, model, fork, total, entry = step(line, session, model, fork, total)
                    if entry:
                        found.append((key[0], done, *entry))
                done += len(raw) + 1
        self.state.update((done, torn, session, model, fork, total))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in (ENTRIES if self.parse else LINES).split(", ")])

    def close(self) -> None:
        pass


def step(line: str, session: str | None, model: str | None, fork: bool, total: int) -> tuple:
    """One line of a rollout: (session, model, fork, total, entry or None). An entry counts if its cumulative total, where it names one, exceeds
    the highest so far; lines that a forked thread copied before it named a model don't."""
    try:
        j = json.loads(line)
    except ValueError:
        return session, model, fork, total, None
    p = j.get("payload") if isinstance(j, dict) else None
    if not isinstance(p, dict):
        return session, model, fork, total, None
    if j.get("type") == "session_meta":
        session = p.get("id") or session
        fork = fork or p.get("parent_thread_id") is not None
    elif j.get("type") == "turn_context":
        model = p.get("model") or model
    elif j.get("type") == "event_msg" and p.get("type") == "token_count":
        info = p.get("info") if isinstance(p.get("info"), dict) else {}
        use = info.get("last_token_usage")
        known = info.get("total_token_usage") if isinstance(info.get("total_token_usage"), dict) else {}
        now = _number(known.get("total_tokens"))
        if isinstance(use, dict) and not (model is None and fork) and (now is None or now > total):
            total = total if now is None else now
            if session is not None and j.get("timestamp"):
                return session, model, fork, total, (j["timestamp"], session, model or "unknown", *[_number(use.get(c)) or 0 for c in COUNTS])
    return session, model, fork, total, None


def _with_state(pieces: DataFrame, parse: bool, schema: str) -> DataFrame:
    return pieces.groupBy("source_path").transformWithStateInPandas(Reader(parse), schema, "append", "none")


def tail_lines(pieces: DataFrame) -> DataFrame:
    """(source_path, line_offset, line): whole lines, each once; the last line of a file waits until its line feed is there. Needs the RocksDB state store."""
    return _with_state(pieces, False, LINES)


def tail_entries(pieces: DataFrame) -> DataFrame:
    """Token counts of rollouts with (source_path, line_offset), which name a row for good, as ``sources.logs.accounting`` gives them for whole files."""
    e = _with_state(pieces, True, ENTRIES)
    return e.select("source_path", "line_offset", F.try_to_timestamp("timestamp").alias("ts"), "session_id", "model", *COUNTS).where("ts is not null")
