"""Files that grow while they are read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterlake.sources import logs
from meterlake.streaming import tail


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def rollout(rng, session):
    lines, total = [json.dumps({"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": session} | ({"parent_thread_id": "p"} if rng.random() < 0.4 else {})})], 0
    for i in range(60):
        kind = rng.random()
        if kind < 0.15:
            lines.append(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": f"m{i % 3}"}}))
        elif kind < 0.25:
            lines.append(rng.choice(["not json", "", "  ", "[1, 2]", '{"type": "event_msg"}', "größe 日本"]))
        else:
            n = rng.randrange(1, 50)
            total += rng.choice([n, n, 0, -5])
            info = {"last_token_usage": {"input_tokens": n, "output_tokens": i, "total_tokens": n + i}} | ({"total_token_usage": {"total_tokens": total}} if rng.random() < 0.9 else {})
            lines.append(json.dumps({"timestamp": f"2024-01-01T00:00:{i % 60:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}))
    return "".join(x + rng.choice(["\n", "\n", "\r\n"]) for x in lines).encode()


def run(spark, src, out, cp, make, **options):
    q = make(tail.growing_files(spark, str(src), **options)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_file_in_random_pieces_gives_the_rows_of_one_read(spark, tmp_path):
    rng = random.Random(4)
    files = {f"f{i}.jsonl": rollout(rng, f"s{i}") for i in range(4)}
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    written = dict.fromkeys(files, 0)
    rounds = 0
    while any(written[f] < len(b) for f, b in files.items()):
        for f, b in files.items():
            to = len(b) if rounds == 4 else min(len(b), written[f] + rng.choice([0, 1, 7, 900, 3000]))
            with open(src / f, "ab") as h:
                h.write(b[written[f] : to])
            written[f] = to
        run(spark, src, out, cp, tail.tail_entries, piece=rng.choice([5, 1000]))  # each a restart
        rounds += 1
    cols = ["ts", "session_id", "model", *tail.COUNTS]
    name = F.regexp_extract("source_path", r"([^/]+)$", 1).alias("f")
    got = spark.read.parquet(str(out)).select(name, "line_offset", *cols).collect()
    whole = logs.accounting(logs.read_rollouts(spark, str(src))).select(name, *cols).collect()
    assert sorted((r["f"], *[r[c] for c in cols]) for r in got) == sorted(map(tuple, whole)) and len(whole) > 60
    assert len({(r["f"], r["line_offset"]) for r in got}) == len(got)
    for r in got:  # an offset is where the row's line begins
        b = files[r["f"]]
        assert r["line_offset"] == 0 or b[r["line_offset"] - 1 : r["line_offset"]] == b"\n"
        assert json.loads(b[r["line_offset"] :].split(b"\n")[0])["payload"]["info"]["last_token_usage"]["output_tokens"] == r["output_tokens"]


def test_a_torn_line_waits(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    lines = lambda: sorted((r["line_offset"], r["line"]) for r in spark.read.schema(tail.LINES).parquet(str(out)).collect())
    for part, want in (("one\ntw", [(0, "one")]), ("", [(0, "one")]), ("o", [(0, "one")]), ("\n\nthree\nfo", [(0, "one"), (4, "two"), (9, "three")])):
        with open(src / "a.jsonl", "a") as f:
            f.write(part)
        run(spark, src, out, cp, tail.tail_lines)
        assert lines() == want
    (src / "b.txt").write_text("no log\n")
    (src / "c.jsonl").write_text("new\n")
    run(spark, src, out, cp, tail.tail_lines)
    assert (0, "new") in lines() and len(lines()) == 4


def test_lines_read_before_are_left_alone():
    """A piece that comes again, whole or in part, adds nothing."""
    import pandas as pd

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    r = tail.Reader(False)
    r.state = Held()
    feed = lambda *parts: [x for d in r.handleInputRows(("f",), iter([pd.DataFrame(parts, columns=["at", "piece"])]), None) for x in d["line"]]
    assert feed((3, b"\nb"), (0, b"aaa")) == ["aaa"] and feed((0, b"aaa\nb")) == [] and feed((2, b"a\nbb\ncc")) == ["bb"] and feed((9, b"\n")) == ["cc"]
    with pytest.raises(ValueError):
        feed((99, b"x"))
