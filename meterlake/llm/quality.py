"""Quality grades by ordinal (cumulative-link) regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_batches


@dataclass(frozen=True)
class Quality:
    """``sample``: about how many rated documents the model is fitted on, those with the smallest hashes of
    their id. ``keep``: the grade that a kept document reaches with a probability of ``least`` or more."""

    buckets: int = 1 << 14
    sample: int = 6000
    steps: int = 250
    ridge: float = 2e-6
    keep: int = 1
    least: float = 0.5


class Tokens(dict):
    """word -> its word bucket and its shape bucket, packed; holds at most ``limit`` words."""

    def __init__(self, buckets: int, limit: int = 200_000):
        super().__init__()
        self.half, self.limit = buckets // 2, limit

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        marks = "".join(c for c in raw if not c.isalnum())
        core = "".join(c for c in raw if c.isalnum())
        case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core else "0"
        digits = "d" if any(map(str.isdigit, core)) else ""
        word = xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "surrogatepass")) % self.half
        shape = self.half + xxhash.xxh3_64_intdigest(f"{case}{digits}{marks}".encode("utf-8", "surrogatepass")) % (self.half - 64)
        v = self[raw] = word << 32 | shape
        return v


def features(text: str | None, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of words and of shapes (case and marks), and how often a word
    repeats the one before and how varied the words are, in steps. A text without words has no features."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    packed = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    ids, counts = np.unique(packed >> 32, return_counts=True)
    shapes, shape_counts = np.unique(packed & 0xFFFFFFFF, return_counts=True)
    n, last = len(words), 2 * tokens.half
    repeats = int(8 * (packed[1:] == packed[:-1]).mean()) if n > 1 else 0
    varied = int(8 * len(ids) / n**0.9) if n > 1 else 8
    extra = [last - 1 - min(repeats, 8), last - 17 - min(varied, 8), last - 33 - min(n.bit_length(), 16)]
    return (np.concatenate([ids, shapes, extra]).astype(np.int32),
            np.concatenate([np.sqrt(counts / n), np.sqrt(shape_counts / n), [0.5, 0.5, 0.5]]).astype(np.float32))


@dataclass(frozen=True)
class Model:
    """P(grade <= j) = logistic(thresholds[j] - weights . x), one threshold between any two grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        z = float(self.weights[ids] @ values)
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -50, 50)))


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], p: Quality) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds are ordered by construction."""
    grades = np.array([g for g, _, _ in rows])
    top = int(grades.max()) if len(rows) else 0
    if top == 0:
        return Model(np.zeros(p.buckets), np.full(max(top, 1), -50.0))
    ids, values = np.concatenate([i for _, i, _ in rows]), np.concatenate([v for _, _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
    below = np.array([(grades <= j).mean() for j in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(top))
    x = np.concatenate([np.zeros(p.buckets), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    logistic = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, p.steps + 1):
        w, gaps = x[: p.buckets], np.exp(x[p.buckets + 1 :])
        th = np.concatenate([[-np.inf], x[p.buckets] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(row, values * w[ids], minlength=len(rows))
        hi, lo = logistic(th[grades + 1] - z), logistic(th[grades] - z)
        hi, lo = np.where(grades == top, 1.0, hi), np.where(grades == 0, 0.0, lo)
        prob = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / prob / len(rows), lo * (1 - lo) / prob / len(rows)
        g = np.zeros_like(x)
        g[: p.buckets] = np.bincount(ids, values * (d_hi - d_lo)[row], minlength=p.buckets) + p.ridge * w
        d_th = np.array([d_lo[grades == j + 1].sum() - d_hi[grades == j].sum() for j in range(top)])
        g[p.buckets] = d_th.sum()
        g[p.buckets + 1 :] = [gaps[j] * d_th[j + 1 :].sum() for j in range(top - 1)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.3 * (1 - step / (p.steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(x[p.buckets + 1 :])
    return Model(x[: p.buckets], x[p.buckets] + np.concatenate([[0], np.cumsum(gaps)]))


def fit(docs: DataFrame, ratings: DataFrame, p: Quality = Quality()) -> Model:
    """``ratings`` (doc_id, grade): whole numbers from 0; null ids and grades are left out. Of an id rated several times the lowest
    grade counts, and of several texts with one id one is read.

    The ids of the sample, a bounded number, are broadcast, so only the sample's texts are shuffled. Their features
    reach the driver, where the weights are fitted.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    share = min(1.0, p.sample / max(n, 1))
    taken = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id").select("doc_id", "grade", "text")
    # of rows that share an id, one text teaches, so the sample stays within its bound
    texts = texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("ids", pa.binary()), ("vals", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(p.buckets)
        for b in batches:
            got = [features(t.as_py(), tokens) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], schema=schema)

    found = texts.mapInArrow(run, "doc_id long, grade int, ids binary, vals binary").toPandas().sort_values(["doc_id", "grade", "ids"])
    return fit_ordinal([(int(g), np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for g, i, v in zip(found["grade"], found["ids"], found["vals"])], p)


def grade(docs: DataFrame, model: Model, p: Quality = Quality(), keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, expected_grade, tail, top, kept) for every row of ``docs``: the mean of the grade, the probability of grade
    ``p.keep`` or more, that of the highest grade, and whether ``tail`` is ``p.least`` or more. Null and wordless texts are judged on the
    thresholds alone, as a text without evidence. Rows stay where they are; nothing is shuffled."""
    text_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(p.buckets)
        for b in batches:
            tails = [shared.value.tails(*features(t.as_py(), tokens)) for t in b.column(len(carried))]
            tail = [float(t[min(p.keep, len(t)) - 1]) for t in tails]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(tail, pa.float64()), pa.array([float(t[-1]) for t in tails], pa.float64()), pa.array([t >= p.least for t in tail], pa.bool_())], names=[*carried, "expected_grade", "tail", "top", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, expected_grade double, tail double, top double, kept boolean")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of ``labels`` (doc_id, quality, toxic): 0 poor, 1 good but toxic, 2 good; null quality is no rating."""
    good = F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") > 0, good).otherwise(0).alias("grade"))
