"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where the session names none, a local one, which will do
    only while driver and executors are one process; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


#: Rows of long texts that travel between Spark and Python at once; Spark's default is for short rows.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python in smaller batches, unless it already sends less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


_OPEN: list[list[Workspace]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Deletes at its end all tables of workspaces made inside it: for a step whose result has been stored elsewhere by then."""
    made: list[Workspace] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for ws in made:
            ws.close()


class Workspace:
    """Tables that cut lineage: each is written once to ``spark.checkpoint.dir`` and read from there,
    so that a lost executor costs a reread and not a recomputation.

    ``drop`` deletes tables that nothing reads any more. What a lazy result still reads stays until the
    Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        text_batches(spark)
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._paths: dict[int, str] = {}
        for held in _OPEN:
            held.append(self)
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self._paths.pop(id(t)))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
            if jvm is None or jsc is None:
                return
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  a context that has ended cannot clean up
            return
