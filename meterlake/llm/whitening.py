"""Whitening of vectors: a compensated covariance of the distinct ones, its leading components, and all rows projected on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Rows of a block at most; products of slices of SLICE bits add up exactly over as many.
ROWS = 1 << 12
SLICE = 20
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``scale``: entries become floor(scale * c); ``components``: how many leading components are returned at most."""

    scale: int = 256
    components: int = 4


# double-double arithmetic on arrays

def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles (high part, low part)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x minus a double-double mean, as a double-double."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def slices(c: np.ndarray, n: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Cuts the entries of a column at common places, ``SLICE`` bits each: c is exactly the sum of the parts and the rest."""
    parts, most = [], np.abs(c).max(axis=0, initial=0)
    unit = np.exp2(np.ceil(np.log2(np.where(most > 0, most, 1.0))))
    for _ in range(n):
        sigma = unit * 2.0 ** (53 - SLICE)
        s = (c + sigma) - sigma
        parts.append(s)
        c, unit = c - s, unit * 2.0**-SLICE
    return parts, c


def gram(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of the rows hi + lo, as a double-double.

    An error-free transformation: rows are cut in slices so short that a matrix product of two of them is exact
    in doubles, in whatever order it adds. The large products are added with what their sums lose; the rest is a low part.
    """
    (a, b, c), rest = slices(hi)
    zero = np.zeros((hi.shape[1],) * 2)
    ab, ac, bc = a.T @ b, a.T @ c, b.T @ c
    out = (a.T @ a, zero)
    for exact in (ab, ab.T, b.T @ b, ac, ac.T, bc, bc.T, c.T @ c):
        out = add(out, (exact, zero))
    cross = hi.T @ (lo + rest)
    return add(add(out, (cross, zero)), (cross.T, zero))


# Spark side

def whole_vectors(vectors: DataFrame, p: Whitening, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, x array<long>): rows but those with a null or empty vector or a null or non-finite entry, as whole numbers, which saturate at 64 bits."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).where("e is not null and size(e) > 0")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(fine).select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda c: F.floor(c.cast("double") * p.scale)).alias("x"))


_BLOCK = pa.schema([("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.int64()))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows -> blocks of up to ``ROWS`` rows of one length."""
    held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
    n = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        for dim, parts in sorted(held.items()):
            ids, x = pa.concat_arrays([i for i, _ in parts]), np.concatenate([v for _, v in parts])
            for at in range(0, len(ids), ROWS):
                cut = slice(at * dim, (at + ROWS) * dim)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[at : at + ROWS].to_pylist()], pa.list_(pa.int64())), pa.array([x[cut]], pa.list_(pa.int64()))], schema=_BLOCK)

    for b in batches:
        lengths, lists = b.column("dim").to_numpy(), b.column("x")
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            held.setdefault(int(dim), []).append((b.column("vec_id").take(pa.array(at)), flat[ends[at][:, None] + np.arange(dim)].reshape(-1)))
        n += b.num_rows
        if n >= ROWS:
            yield from blocks()
            held, n = {}, 0
    yield from blocks()


def _matrix(b: pa.RecordBatch, name: str, i: int, dim: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (dim, at, n, hi, lo): rows and exact sums of each place, a sum being hi * 2**32 + lo."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, dim in enumerate(b.column("dim").to_pylist()):
            x = _matrix(b, "x", i, dim)
            small = np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0**62
            s = (x if small else x.astype(object)).sum(axis=0).astype(object)
            n[dim], sums[dim] = n.get(dim, 0) + len(x), sums.get(dim, 0) + s
    schema = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
    for dim, s in sums.items():
        s = [int(v) for v in s]
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()), pa.array([v >> 32 for v in s], pa.int64()), pa.array([v & 0xFFFFFFFF for v in s], pa.int64())], schema=schema)


class Moments:
    """n, the exact sums S of a vector length, and S / n as a double-double."""

    def __init__(self, n: int, hi: list[int], lo: list[int]):
        self.n, self.sums = n, [(h << 32) + v for h, v in zip(hi, lo)]
        means = [Fraction(s, n) for s in self.sums]
        high = [float(m) for m in means]
        self.mean = np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(means, high)])

    @staticmethod
    def of(b: pa.RecordBatch, i: int) -> Moments:
        return Moments(b.column("n")[i].as_py(), b.column("s_hi")[i].as_py(), b.column("s_lo")[i].as_py())


_PARTS = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("hi", pa.list_(pa.float64())), ("lo", pa.list_(pa.float64()))])
_PARTS_DDL = "dim int, at int, hi array<double>, lo array<double>"


def _parts(dim: int, total: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    hi, lo = total
    return pa.RecordBatch.from_arrays([pa.array([dim] * len(hi), pa.int32()), pa.array(range(len(hi)), pa.int32()), pa.array(list(hi), pa.list_(pa.float64())), pa.array(list(lo), pa.list_(pa.float64()))], schema=_PARTS)


def _covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with moments -> (dim, at, hi, lo): rows of the matrix of centred products that the task has added up."""
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    moments: dict[int, Moments] = {}
    for b in batches:
        for i, dim in enumerate(b.column("dim").to_pylist()):
            if dim not in moments:
                moments[dim] = Moments.of(b, i)
            g = gram(*centred(_matrix(b, "x", i, dim).astype(float), moments[dim].mean))
            totals[dim] = add(totals[dim], g) if dim in totals else g
    for dim, total in totals.items():
        yield _parts(dim, total)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of all tasks -> one double-double row for each (dim, at)."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x], pa.list_(pa.float64())) for x in total)], schema=_PARTS)

    for b in batches:
        his, los = b.column("hi"), b.column("lo")
        for i, k in enumerate(zip(b.column("dim").to_pylist(), b.column("at").to_pylist())):
            part = his[i].values.to_numpy(), los[i].values.to_numpy()
            if k == key:
                total = add(total, part)
            else:
                if key is not None:
                    yield row()
                key, total = k, part
    if key is not None:
        yield row()


def merged(parts: DataFrame) -> DataFrame:
    """Parts of one row of a matrix stream through one task in a fixed order, so memory does not grow with the number of tasks."""
    return parts.repartition("dim", "at").sortWithinPartitions("dim", "at", "hi", "lo").mapInArrow(_merge, _PARTS_DDL)


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, the largest first, ``most`` at most, each with its largest entry positive.
    Householder reduction to a tridiagonal matrix and divide and conquer, which is LAPACK's syevd. Values that rounding cannot tell from zero are left out."""
    scale = np.abs(v).max(initial=0)
    if not scale > 0:
        return np.empty(0), np.empty((0, len(v)))
    values, vectors = np.linalg.eigh(v / scale)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    real = values > 4 * len(v) * np.finfo(float).eps * values[0]
    values, vectors = values[real] * scale, vectors[real]
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values, vectors * np.sign(largest)[:, None]


def _solve(p: Whitening):
    """Rows of the merged matrix of one length -> its model."""
    schema = pa.schema([("dim", pa.int32()), ("n_values", pa.int32()), ("trace", pa.float64()), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n = t.column("n")[0].as_py()
        hi, lo = (np.array(t.column(c).to_pylist()) / n for c in ("hi", "lo"))
        v = hi + lo
        values, vectors = components((v + v.T) / 2, p.components)
        row = [[t.column("dim")[0].as_py()], [len(values)], [float(np.trace(v))], [values], [vectors.reshape(-1)]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def projected(x: np.ndarray, m: Moments, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    hi, lo = centred(x.astype(float), m.mean)
    return (hi @ vectors.T + lo @ vectors.T) / np.sqrt(values)


def _model(b: pa.RecordBatch, i: int, dim: int) -> tuple[Moments, np.ndarray, np.ndarray]:
    values = np.array(b.column("values")[i].as_py(), float)
    return Moments.of(b, i), values, np.array(b.column("vectors")[i].as_py(), float).reshape(len(values), dim)


def _white_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with models -> per length, the products of whitened values and, as a last row, their sums."""
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    models: dict[int, tuple[Moments, np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, dim in enumerate(b.column("dim").to_pylist()):
            if dim not in models:
                models[dim] = _model(b, i, dim)
            w = projected(_matrix(b, "x", i, dim), *models[dim])
            g = np.vstack([w.T @ w, w.sum(axis=0)])
            totals[dim] = add(totals.get(dim, (np.zeros_like(g),) * 2), (g, np.zeros_like(g)))
    for dim, total in totals.items():
        yield _parts(dim, total)


def _identity(t: pa.Table) -> pa.Table:
    t = t.sort_by("at")
    n = t.column("n")[0].as_py()
    g = (np.array(t.column("hi").to_pylist()) + np.array(t.column("lo").to_pylist())) / n
    c, mean = g[:-1], g[-1]
    error = np.abs(c - np.outer(mean, mean) - np.eye(len(c))).max(initial=0)
    return pa.Table.from_arrays([pa.array([t.column("dim")[0].as_py()], pa.int32()), pa.array([float(error)])], names=["dim", "identity_error"])


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """The sum over places of (n x - S)^2, exactly; null beyond 64 bits."""
    far = m.n * np.abs(x.astype(float)).max(initial=0) + max((abs(s) for s in m.sums), default=0)
    if far * far * max(1, x.shape[1]) < 2.0**62:
        y = m.n * x - np.array(m.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = m.n * x.astype(object) - np.array(m.sums, object)
    return [int(d) if d <= LONGEST else None for d in (y * y).sum(axis=1)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models: dict[int, tuple[Moments, np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, dim in enumerate(b.column("dim").to_pylist()):
            if dim not in models:
                models[dim] = _model(b, i, dim)
            m, values, vectors = models[dim]
            x, k = _matrix(b, "x", i, dim), len(values)
            w = projected(x, m, values, vectors)
            at = np.repeat(np.arange(len(x)), k)
            ids, far = b.column("ids")[i].values.take(pa.array(at)), pa.array(deviations(x, m), pa.int64()).take(pa.array(at))
            many = len(at)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, m.n, np.int64)), far, pa.array(w.reshape(-1)),
                pa.array(np.tile(values / b.column("trace")[i].as_py(), len(x))), pa.array(np.full(many, b.column("identity_error")[i].as_py(), float))], schema=_OUT)


def whiten(vectors: DataFrame, p: Whitening = Whitening(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every row projected on the leading ``components`` of the
    covariance of the distinct vectors, each scaled to variance one.

    Distinct vectors are stored in blocks. One pass adds up exact sums; a second centres each block by the mean, which is a
    double-double, and adds up outer products with all that rounding loses. Tasks emit high and low parts of a matrix row,
    which are merged as double-doubles, a row of the matrix at a time, so that neither the number of rows nor of tasks
    costs precision or memory. The eigenproblem of a length is one task, of the size of the vectors squared. A third pass measures
    how far the covariance of the whitened distinct vectors is from the identity. Models reach blocks by a join on
    the length; nothing passes through the driver.

    Vectors of each length are a fit of their own (n, S, components, errors). A null vector and one with a null or non-finite entry is left out; an
    empty vector has no components, hence no rows. Repeated rows and ids, and null ids, return rows each. Entries saturate at 64
    bits after scaling; a deviation beyond 64 bits is null. Components without variance are left out, so vectors that are all alike return no rows.
    Empty tables give no rows.
    """
    ws = Workspace(vectors.sparkSession, "whitening")
    rows = whole_vectors(vectors, p, id_col, vec_col)
    blocks = "dim int, ids array<long>, x array<long>"
    fit = rows.select(F.lit(0).cast("long").alias("vec_id"), "dim", "x").distinct()
    fit = ws.save(fit.mapInArrow(_pack, blocks).select("dim", "x"), "fit")

    sums = fit.mapInArrow(_sums, "dim int, at int, n long, hi long, lo long").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    listed = F.sort_array(F.collect_list(F.struct("at", "hi", "lo")))
    told = sums.groupBy("dim").agg(F.max("n").alias("n"), listed.alias("s"))
    moments = ws.save(told.select("dim", "n", F.col("s.hi").alias("s_hi"), F.col("s.lo").alias("s_lo")), "moments")

    matrix = merged(fit.join(moments, "dim").mapInArrow(_covariance, _PARTS_DDL)).join(moments.select("dim", "n"), "dim")
    solved = matrix.groupBy("dim").applyInArrow(_solve(p), "dim int, n_values int, trace double, values array<double>, vectors array<double>")
    models = ws.save(solved.join(moments, "dim").where("n_values > 0"), "models")

    white = merged(fit.join(models, "dim").mapInArrow(_white_products, _PARTS_DDL)).join(moments.select("dim", "n"), "dim")
    errors = white.groupBy("dim").applyInArrow(_identity, "dim int, identity_error double")
    models = ws.save(models.join(errors, "dim"), "measured")
    return rows.mapInArrow(_pack, blocks).join(models, "dim").mapInArrow(_rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
