"""Exact top-k inner products: a stored pivot table bounds what is evaluated, and in which order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Below this product of norms, sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 52)
LEAST = -(1 << 63)
#: Components saturate here, so that squares stay finite.
WIDEST = 1e140


@dataclass(frozen=True)
class TopK:
    """``pivots`` a vector length; ``block``: vectors in one block, of queries or candidates; ``group``: candidates bounded and
    evaluated at once; ``lengths``: how many vector lengths, the commonest, have pivots drawn from the data."""

    k: int = 20
    scale: int = 64
    pivots: int = 32
    block: int = 4096
    group: int = 256
    lengths: int = 16


def integer_vectors(vectors: DataFrame, queries: Column, p: TopK, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, asked, v array<double>): floor(scale * x) as whole numbers. Null vectors, empty ones and those with a null or
    non-finite component are left out."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asked"), F.col(vec_col).alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c: Column) -> Column:
        y = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), c.cast("double") * p.scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # beyond, every double is whole

    return x.where(fine).select("vec_id", F.size("e").alias("dim"), "asked", F.transform("e", whole).alias("v"))


def draw_pivots(v: DataFrame, p: TopK) -> dict[int, np.ndarray]:
    """Per vector length, up to ``pivots`` distinct vectors of the table, those with the smallest hashes."""
    dims = [r["dim"] for r in v.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(p.lengths).collect()]
    by = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "v"))
    rows = v.where(F.col("dim").isin(dims or [0])).withColumn("n", F.row_number().over(by)).where(F.col("n") <= p.pivots).select("dim", "v").collect()
    return {d: np.unique(np.array([r["v"] for r in rows if r["dim"] == d]), axis=0) for d in dims}


def pivots_of(dim: int, drawn: dict[int, np.ndarray], p: TopK) -> np.ndarray:
    """Exactly ``p.pivots`` rows: drawn ones, filled up with fixed random directions of their length."""
    have = drawn.get(dim, np.empty((0, dim)))
    x = np.random.default_rng(7).standard_normal((p.pivots - len(have), dim))
    far = np.sqrt((have * have).sum(1).mean()) if len(have) else float(p.scale)
    return np.concatenate([have, x * (far / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    scale = max(np.abs(x).max(initial=0), np.abs(pivots).max(initial=0), 1.0)
    a, b = x / scale, pivots / scale
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)) * scale


def _place(drawn: dict[int, np.ndarray], p: TopK):
    """Adds to each vector its distances to the pivots, the nearest of them (its home) and whether its products are wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("dim").to_numpy()
            flat, ends = b.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
            home, wide, d = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), bool), np.zeros((len(lengths), p.pivots))
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = flat[ends[at][:, None] + np.arange(dim)]
                d[at] = distances(x, pivots_of(int(dim), drawn, p))
                home[at], wide[at] = d[at].argmin(1), (x * x).sum(1) >= EXACT
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * p.pivots, pa.int32()), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(wide), lists], names=[*b.schema.names, "home", "wide", "d"])

    return run


def _matrix(lists: pa.ListArray, i: int, width: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _pack(p: TopK, names: list[str]):
    """Rows (*names, dim, rows) -> one row a block: ids, vectors, distances, and per group of ``p.group`` rows the least and largest
    distance to each pivot and the largest squared norm; the last three also of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("rids", "ids", "v", "d", "tops", "los", "his", "top", "lo", "hi")}
            for i, dim in enumerate(b.column("dim").to_pylist()):
                rows = b.column("rows")[i].values
                d = rows.field("d").flatten().to_numpy().reshape(-1, p.pivots)
                v = rows.field("v").flatten().to_numpy().reshape(-1, dim)
                # rows of a group lie alike to the pivots
                order = np.lexsort((rows.field("rid").to_numpy(), d[:, np.argsort(-d.var(0))[0]]))
                d, v, norms = d[order], v[order], (v * v).sum(1)[order]
                cuts = np.arange(0, len(d), p.group)
                lo, hi, top = np.minimum.reduceat(d, cuts), np.maximum.reduceat(d, cuts), np.maximum.reduceat(norms, cuts)
                for k, x in dict(rids=rows.field("rid").to_numpy()[order], ids=rows.field("vec_id").to_numpy()[order], v=v, d=d, tops=top, los=lo, his=hi, lo=lo.min(0), hi=hi.max(0)).items():
                    out[k].append(x.reshape(-1))
                out["top"].append(top.max())
            types = {"rids": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "top": pa.float64()}
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in [*names, "dim"]), *(pa.array(x, types.get(k, pa.list_(pa.float64()))) for k, x in out.items())], names=[*names, "dim", *out])

    return run


_PACKED = "rids array<long>, ids array<long>, v array<double>, d array<double>, tops array<double>, los array<double>, his array<double>, top double, lo array<double>, hi array<double>"


class Best:
    """The k best candidates so far of each query of a block; ``kth`` is what a candidate must reach."""

    def __init__(self, rids: np.ndarray, q: np.ndarray, d: np.ndarray, kth: np.ndarray | None, p: TopK):
        self.p, self.rids, self.q, self.d = p, rids, q, d
        self.qq = (q * q).sum(1)
        self.kth = np.full(len(rids), LEAST, np.int64) if kth is None else kth.copy()
        self.at, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.evaluated = 0

    def search(self, rids: np.ndarray, ids: np.ndarray, c: np.ndarray, tops: np.ndarray, los: np.ndarray, his: np.ndarray) -> None:
        """Takes a block of candidates into account.

        With d the distance of query and candidate, 2 <q, c> = |q|^2 + |c|^2 - d^2, and every pivot bounds d from below by the
        difference of its distances to both; the largest of these lower bounds counts. It is taken for a group of candidates
        at once (a bound for each would cost as much as its product). Groups are evaluated in order of their upper bound,
        each for the queries whose k-th score it can still reach, until it can reach none.
        """
        p = self.p
        low = np.maximum(self.d[:, None] - his, los - self.d[:, None]).max(2)
        low = np.maximum(low - 1e-7 * (self.d.max() + his.max()), 0)
        bound = (self.qq[:, None] + tops - low * low) / 2
        bound += 1 + 1e-9 * (self.qq[:, None] + tops)  # rounding; scores are whole numbers
        most = bound.max(0)
        own, theirs = np.intersect1d(self.rids, rids, return_indices=True)[1:]
        for g in np.argsort(-most):
            if most[g] < self.kth.min():
                break
            active = np.flatnonzero(bound[:, g] >= self.kth)
            part = slice(g * p.group, (g + 1) * p.group)
            scores = self._products(self.q[active], c[part], self.qq[active].max(initial=0) * tops[g])
            self.evaluated += scores.size
            mine = np.isin(own, active) & (theirs >= part.start) & (theirs < part.stop)
            scores[np.searchsorted(active, own[mine]), theirs[mine] - part.start] = LEAST
            need = self.kth[active]
            if scores.shape[1] > p.k:
                need = np.maximum(need, np.partition(scores, -p.k, axis=1)[:, -p.k])
            row, col = np.nonzero((scores >= need[:, None]) & (scores > LEAST))
            self._merge(active[row], ids[part][col], scores[row, col].astype(np.int64))

    @staticmethod
    def _products(q: np.ndarray, c: np.ndarray, squares: float) -> np.ndarray:
        if squares < EXACT * EXACT:
            return q @ c.T
        exact = np.array([[int(x) for x in r] for r in q.tolist()], object) @ np.array([[int(x) for x in r] for r in c.tolist()], object).T
        return np.clip(exact, LEAST + 1, (1 << 63) - 1).astype(np.int64)

    def _merge(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        last = rank == self.p.k - 1
        self.kth[at[last]] = np.maximum(self.kth[at[last]], scores[last])
        kept = rank < self.p.k
        self.at, self.ids, self.scores = at[kept], ids[kept], scores[kept]

    def rows(self) -> dict[str, np.ndarray]:
        return {"query": self.rids[self.at], "vec_id": self.ids, "score": self.scores}


def _search(p: TopK):
    """Query blocks with candidate blocks, in order of query blocks -> what each task found of a query block, and the least k-th score."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("q_block", pa.int64()), ("query", longs), ("vec_id", longs), ("score", longs), ("kth", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x], longs) for x in best.rows().values()), pa.array([best.kth], longs)], schema=schema)

        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            dims, tops = col["dim"].to_pylist(), col["tops"]
            for i, q_block in enumerate(col["q_block"].to_pylist()):
                if q_block != key:
                    if best:
                        yield done()
                    kth = col["q_kth"][i].values
                    key, best = q_block, Best(col["q_rids"][i].values.to_numpy(), _matrix(col["q_v"], i, dims[i]), _matrix(col["q_d"], i, p.pivots), None if kth is None else kth.to_numpy(), p)
                best.search(col["rids"][i].values.to_numpy(), col["ids"][i].values.to_numpy(), _matrix(col["v"], i, dims[i]), tops[i].values.to_numpy(), _matrix(col["los"], i, p.pivots), _matrix(col["his"], i, p.pivots))
        if best:
            yield done()

    return run


_FOUND = "q_block long, query array<long>, vec_id array<long>, score array<long>, kth array<long>"


def top_inner_products(vectors: DataFrame, queries: Column, p: TopK = TopK(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` where ``queries`` holds, the ``k``
    highest integer inner products with all other rows, ties to the smaller id; all, if there are fewer.

    The distances of all vectors to the pivots are computed once and stored. Vectors nearest to one pivot share blocks
    of bounded size. A query block first meets a block of its own home, which gives a k-th score to beat; it is then sent to
    those other blocks only whose bound can reach it, and inside them groups are bounded again (``Best.search``).
    Where vectors lie alike to all pivots, as evenly spread directions do, nothing can be ruled out and every
    query meets every vector, which no exact method avoids; the work is then a matrix product.

    Only vectors of one length are compared. Scores are exact; beyond 64 bits they saturate. Each row is a candidate and,
    where asked, a query of its own: rows with a repeated id are answered each, and meet each other. A null id, a null vector, an
    empty one or one with a null or non-finite component takes no part. Empty tables give no rows.
    """
    ws = Workspace(vectors.sparkSession, "topk")
    whole = integer_vectors(vectors, queries, p, id_col, vec_col)
    drawn = draw_pivots(whole, p)  # a bounded number of vectors
    placed = ws.save(whole.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_place(drawn, p), "vec_id long, dim int, asked boolean, v array<double>, rid long, home int, wide boolean, d array<double>"), "placed")
    homes = placed.groupBy("dim", "wide", "home").agg(F.ceil(F.count("*") / p.block).alias("n"), F.ceil(F.count(F.when(F.col("asked"), 1)) / p.block).alias("q_n"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("wide", "home").rowsBetween(Window.unboundedPreceding, -1))
    homes = ws.save(homes.withColumn("first", F.coalesce(before, F.lit(0))), "homes")
    at_home = placed.join(homes, ["dim", "wide", "home"])
    pack = F.collect_list(F.struct("rid", "vec_id", "v", "d")).alias("rows")
    chunk = F.pmod(F.xxhash64("rid"), F.col("n"))
    blocks = at_home.withColumn("block", F.col("first") + chunk).groupBy("block", "dim").agg(pack)
    blocks = ws.save(blocks.select("block", "dim", "rows").mapInArrow(_pack(p, ["block"]), f"block long, dim int, {_PACKED}"), "blocks").drop("d")
    asked = at_home.where("asked").groupBy("first", "n", "home", F.pmod(F.xxhash64("rid"), F.col("q_n")).alias("chunk"), "dim").agg(pack)
    # the block of its home that a query block meets first: different ones meet different blocks
    seed = F.col("first") + F.pmod(F.xxhash64("first", "chunk"), F.col("n"))
    asked = ws.save(asked.select(seed.alias("seed"), "dim", "rows").mapInArrow(_pack(p, ["seed"]), f"seed long, dim int, {_PACKED}").withColumn("q_block", F.monotonically_increasing_id()), "queries")
    q = asked.select("q_block", "dim", "seed", *[F.col(c).alias(f"q_{c}") for c in ("rids", "v", "d", "top", "lo", "hi")])

    side = ["q_block", "dim", "q_rids", "q_v", "q_d", "q_kth", "rids", "ids", "v", "tops", "los", "his"]
    home = q.withColumn("q_kth", F.lit(None).cast("array<long>")).withColumn("block", F.col("seed")).join(blocks, ["dim", "block"]).select(*side)
    seeds = ws.save(home.sortWithinPartitions("q_block").mapInArrow(_search(p), _FOUND), "seeds")

    told = q.join(seeds.select("q_block", F.col("kth").alias("q_kth")), "q_block")
    spots = blocks.select("dim", "block", "top", "lo", "hi")
    sent = told.select("q_block", "dim", "seed", "q_top", "q_lo", "q_hi", F.array_min("q_kth").alias("least"))
    numbers = homes.groupBy("dim").agg(F.sum("n").alias("all"))
    sent = sent.join(numbers, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1))).where("block <> seed")
    apart = F.greatest(F.array_max(F.zip_with("q_lo", "hi", lambda a, b: a - b)), F.array_max(F.zip_with("lo", "q_hi", lambda a, b: a - b)), F.lit(0.0))
    apart = F.greatest(apart - 1e-7 * (F.array_max("q_hi") + F.array_max("hi")), F.lit(0.0))
    reach = (F.col("q_top") + F.col("top") - apart * apart) / 2 + 1 + 1e-9 * (F.col("q_top") + F.col("top"))
    pairs = ws.save(sent.join(spots, ["dim", "block"]).where(reach >= F.col("least")).select("q_block", "dim", "block"), "pairs")
    n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.repartition(n, "block", "q_block").join(told, ["q_block", "dim"]).join(blocks, ["dim", "block"]).select(*side)
    found = met.sortWithinPartitions("q_block").mapInArrow(_search(p), _FOUND)

    rows = seeds.unionByName(found).select(F.explode(F.arrays_zip("query", "vec_id", "score")).alias("r")).select("r.*")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= p.k)
    ids = asked.select(F.explode(F.arrays_zip(F.col("rids").alias("query"), F.col("ids").alias("query_id"))).alias("r")).select("r.*")
    return ranked.join(ids, "query").select("query_id", "rank", "vec_id", "score")
