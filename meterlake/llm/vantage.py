"""Approximate nearest neighbours: vantage-point trees, one a shard, with triangle-inequality pruning relaxed by a factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Components saturate here, so that squares stay finite.
WIDEST = 1e140


@dataclass(frozen=True)
class VantageTrees:
    """``factor``: a branch is left out if its lower bound, stretched by ``factor``, exceeds the k-th distance so far; 1 is exact search, more is
    faster and may miss neighbours. ``shard``: about how many vectors a shard has; ``leaf``: vectors of a leaf at most.
    ``sample``, ``depth``, ``lengths``: regions come from a tree of ``2 ** depth`` leaves over a sample of at most
    ``sample`` vectors of each of the ``lengths`` commonest lengths; vectors of other lengths are one region a length. ``most``: shards that a task holds at once at most."""

    k: int = 10
    factor: float = 1.5
    shard: int = 2048
    leaf: int = 64
    sample: int = 8192
    depth: int = 5
    lengths: int = 16
    most: int = 32


def real_vectors(vectors: DataFrame, queries: Column, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, asked, dim, v array<double>): vectors that are not null, empty or zero and have no null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asked"), F.col(vec_col).alias("e")).where("vec_id is not null and e is not null")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists("e", lambda c: c != 0)
    bounded = F.transform("e", lambda c: F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), c.cast("double"))))
    return rows.where(fine).select("vec_id", "asked", F.size("e").alias("dim"), bounded.alias("v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of ``a`` to one vector each, or to a row of ``b`` each, by their differences."""
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


def rough_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distances by one matrix product, and by how much each may be off."""
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)
    square = np.maximum(aa + bb - 2 * a @ b.T, 0)
    off = (aa + bb) * (a.shape[1] + 4) * 4 * np.finfo(float).eps
    return np.sqrt(square), np.sqrt(off)


def choose_vantage(x: np.ndarray, seed: int) -> np.ndarray:
    """Of a few members the one whose distances to some members spread most."""
    rng = np.random.default_rng(seed)
    some, few = x[rng.choice(len(x), min(len(x), 64), replace=False)], x[rng.choice(len(x), min(len(x), 6), replace=False)]
    return few[rough_distances(few, some)[0].var(axis=1).argmax()]


class Tree:
    """A balanced vantage-point tree in level order. Inner node i has children 2 i + 1, within ``radius[i]`` of its vantage point, and 2 i + 2, beyond;
    ``lo``, ``hi`` of a child are the least and largest distance of its members to its parent's point. Leaves hold slices of the rows."""

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, ends: np.ndarray):
        self.points, self.lo, self.hi, self.ends = points, lo, hi, ends
        self.depth = len(ends).bit_length() - 1
        self.first = (1 << self.depth) - 1  # number of the first leaf

    @staticmethod
    def build(x: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of rows in which each leaf is a slice."""
        inner, all_nodes = (1 << depth) - 1, (2 << depth) - 1
        points, lo, hi = np.zeros((inner, x.shape[1])), np.zeros(all_nodes), np.full(all_nodes, np.inf)
        members = {0: np.arange(len(x))}
        for i in range(inner):
            at = members.pop(i)
            if len(at):
                points[i] = choose_vantage(x[at], i)
            d = distances(x[at], points[i])
            half = len(at) // 2
            order = np.argpartition(d, half - 1) if 0 < half < len(at) else np.arange(len(at))
            for child, part in ((2 * i + 1, order[:half]), (2 * i + 2, order[half:])):
                members[child] = at[part]
                lo[child], hi[child] = (d[part].min(), d[part].max()) if len(part) else (np.inf, np.inf)
        leaves = [members[i] for i in range(inner, all_nodes)]
        return Tree(points, lo, hi, np.cumsum([len(m) for m in leaves])), np.concatenate(leaves)

    def children_bounds(self, nodes: np.ndarray, d: np.ndarray, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(child, bound) for both children of nodes whose points are at distances ``d``: the lower bound of the triangle inequality, stretched by ``factor``, but by no more
        than 2 d, as what lies at the bound's edge is no further than that from it; a query near a node's point has tight bounds already."""
        out = []
        for c in (2 * nodes + 1, 2 * nodes + 2):
            least = np.maximum(np.maximum(self.lo[c] - d, d - self.hi[c]) - 1e-13 * d, 0)
            out.append((c, np.minimum(least * factor, least + 2 * d)))
        return out


class Nearest:
    """The k nearest so far of each query of a batch; ``kth`` is what a candidate must not exceed."""

    def __init__(self, rids: np.ndarray, q: np.ndarray, kth: np.ndarray, p: VantageTrees):
        self.p, self.rids, self.q, self.kth = p, rids, q, kth.copy()
        self.at, self.ids, self.found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.evaluated = 0

    def search(self, everyone: np.ndarray, tree: Tree, rids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes a shard into account for the queries at ``everyone``: each first goes down to one leaf, which gives it a k-th distance; then all go down level by
        level into the branches that they can't rule out, and leaves are read in order of their bound."""
        p, n, inner = self.p, len(everyone), tree.first
        seeds = np.zeros(len(self.q), np.int64)
        for _ in range(tree.depth):
            d = distances(self.q, tree.points[seeds])
            (near, a), (far, b) = tree.children_bounds(seeds, d, p.factor)
            seeds = np.where(a <= b, near, far)
        for leaf in np.unique(seeds[everyone]):
            self._read(tree, leaf - inner, everyone[seeds[everyone] == leaf], rids, ids, x)
        who, node, bound = everyone, np.zeros(n, np.int64), np.zeros(n)
        for _ in range(tree.depth):
            d = np.empty(len(who))
            for i in np.unique(node):
                part = node == i
                d[part] = distances(self.q[who[part]], tree.points[i])
            down = [(who, child, np.maximum(bound, b)) for child, b in tree.children_bounds(node, d, p.factor)]
            who, node, bound = (np.concatenate(c) for c in zip(*down))
            keep = bound <= self.kth[who] * (1 + 1e-12)
            who, node, bound = who[keep], node[keep], bound[keep]
        rest = node != seeds[who]
        who, node, bound = who[rest], node[rest], bound[rest]
        leaves, inverse = np.unique(node, return_inverse=True)
        least = np.full(len(leaves), np.inf)
        np.minimum.at(least, inverse, bound)
        for j in np.argsort(least, kind="stable"):
            mine = inverse == j
            mine = who[mine][bound[mine] <= self.kth[who[mine]] * (1 + 1e-12)]
            if len(mine):
                self._read(tree, leaves[j] - inner, mine, rids, ids, x)

    def _read(self, tree: Tree, leaf: int, who: np.ndarray, rids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        part = slice(tree.ends[leaf - 1] if leaf else 0, tree.ends[leaf])
        c, q = x[part], self.q[who]
        if not len(c):
            return
        self.evaluated += len(c) * len(q)
        rough, off = rough_distances(q, c)
        need = self.kth[who][:, None]
        if rough.shape[1] > self.p.k + 1:  # one may be the query itself
            need = np.minimum(need, np.partition(rough + off, self.p.k, axis=1)[:, self.p.k :][:, :1])
        row, col = np.nonzero((rough - off <= need) & (self.rids[who][:, None] != rids[part]))
        self._merge(who[row], ids[part][col], distances(q[row], c[col]))

    def _merge(self, at: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        at, ids, found = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.found, found])
        order = np.lexsort((ids, found, at))
        at, ids, found = at[order], ids[order], found[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        last = rank == self.p.k - 1
        self.kth[at[last]] = np.minimum(self.kth[at[last]], found[last])
        kept = rank < self.p.k
        self.at, self.ids, self.found = at[kept], ids[kept], found[kept]


def draw_regions(v: DataFrame, p: VantageTrees) -> dict[int, Tree]:
    """Per common vector length, a tree over the sample with the smallest hashes; its leaves are the regions."""
    dims = [r["dim"] for r in v.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(p.lengths).collect()]
    out = {}
    for d in dims:
        rows = v.where(F.col("dim") == d).orderBy(F.xxhash64("v", "vec_id")).limit(p.sample).select("v").collect()
        x = np.array([r["v"] for r in rows])
        tree, _ = Tree.build(x, p.depth)
        # vectors outside the sample: a region is what lies within, or beyond, the largest inner distance
        for i in range(tree.first):
            radius = max(tree.hi[2 * i + 1], 0) if np.isfinite(tree.hi[2 * i + 1]) else 0.0
            tree.lo[2 * i + 1], tree.hi[2 * i + 1], tree.lo[2 * i + 2], tree.hi[2 * i + 2] = 0, radius, radius, np.inf
        out[d] = tree
    return out


def _rows_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, matrix) of each vector length."""
    lengths = b.column("dim").to_numpy()
    flat, ends = b.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, flat[ends[at][:, None] + np.arange(dim)]


def _place(regions: dict[int, Tree]):
    """Adds the region of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = np.zeros(b.num_rows, np.int32)
            for dim, at, x in _rows_of(b):
                if tree := regions.get(dim):
                    node = np.zeros(len(x), np.int64)
                    for _ in range(tree.depth):
                        inside = distances(x, tree.points[node]) <= tree.hi[2 * node + 1]
                        node = 2 * node + 2 - inside
                    region[at] = node - tree.first
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    return run


def _route(regions: dict[int, Tree], p: VantageTrees):
    """Adds to each query the regions that its k-th distance can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kth = b.column("kth").to_numpy()
            open_: list[list[int]] = [[0]] * b.num_rows
            for dim, at, x in _rows_of(b):
                if tree := regions.get(dim):
                    bound = np.zeros((len(x), 1))
                    for level in range(tree.depth):
                        nodes = np.arange((1 << level) - 1, (2 << level) - 1)
                        d = np.stack([distances(x, tree.points[i]) for i in nodes], axis=1)
                        (_, inner), (_, outer) = tree.children_bounds(nodes, d, p.factor)
                        bound = np.maximum(np.repeat(bound, 2, axis=1), np.stack([inner, outer], axis=2).reshape(len(x), -1))
                    for i, mine in zip(at, bound <= kth[at][:, None] * (1 + 1e-9)):
                        open_[i] = np.flatnonzero(mine).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(open_, pa.list_(pa.int32()))], names=[*b.schema.names, "regions"])

    return run


_INDEX = pa.schema([("shard", pa.int64()), ("grp", pa.int64()), ("dim", pa.int32()), ("rids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), *((n, pa.list_(pa.float64())) for n in ("v", "points", "lo", "hi")), ("ends", pa.list_(pa.int64()))])
_INDEX_DDL = "shard long, grp long, dim int, rids array<long>, ids array<long>, v array<double>, points array<double>, lo array<double>, hi array<double>, ends array<long>"


def _plant(p: VantageTrees):
    """Shards -> their trees, rows in the order of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, dim in enumerate(b.column("dim").to_pylist()):
                rows = b.column("rows")[i].values
                x = rows.field("v").flatten().to_numpy().reshape(-1, dim)
                depth = max(0, (-(-len(x) // p.leaf) - 1).bit_length())
                by_id = np.argsort(rows.field("rid").to_numpy())
                x = x[by_id]
                tree, order = Tree.build(x, depth)
                rids, ids = (rows.field(c).to_numpy()[by_id][order] for c in ("rid", "vec_id"))
                cells = [b.column("shard")[i].as_py(), b.column("grp")[i].as_py(), dim, rids, ids, x[order].reshape(-1), tree.points.reshape(-1), tree.lo, tree.hi, tree.ends]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _INDEX)], schema=_INDEX)

    return run


_FOUND = pa.schema([("rid", pa.int64()), ("kth", pa.float64()), ("ids", pa.list_(pa.int64())), ("found", pa.list_(pa.float64()))])
_FOUND_DDL = "rid long, kth double, ids array<long>, found array<double>"


def _search(p: VantageTrees, at_home: bool):
    """Sorted by group, shards before queries: a task holds the trees of one group and answers queries as they stream by, either ``at_home``, in their
    own shard alone, or in all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees = None, {}
        for b in batches:
            groups = b.column("grp").to_numpy()
            is_query = b.column("rid").is_valid().to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                if g != group:
                    group, trees = g, {}
                for i in np.flatnonzero((groups == g) & ~is_query).tolist():
                    dim = b.column("dim")[i].as_py()
                    of = {n: b.column(n)[i].values.to_numpy() for n in ("rids", "ids", "v", "points", "lo", "hi", "ends")}
                    trees[b.column("shard")[i].as_py()] = (dim, Tree(of["points"].reshape(-1, dim), of["lo"], of["hi"], of["ends"]), of["rids"], of["ids"], of["v"].reshape(-1, dim))
                asked = np.flatnonzero((groups == g) & is_query)
                if not len(asked):
                    continue
                part = b.take(pa.array(asked))
                rids, kth, home = (part.column(c).to_numpy() for c in ("rid", "kth", "shard"))
                for dim, at, q in _rows_of(part):
                    best = Nearest(rids[at], q, kth[at], p)
                    for shard, (d, *tree) in trees.items():
                        who = np.flatnonzero((home[at] == shard) == at_home)
                        if d == dim and len(who):
                            best.search(who, *tree)
                    cut = np.searchsorted(best.at, np.arange(len(at) + 1))
                    lists = [pa.array([x[s:e] for s, e in zip(cut, cut[1:])], pa.list_(t)) for x, t in ((best.ids, pa.int64()), (best.found, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(best.rids), pa.array(best.kth), *lists], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, queries: Column, p: VantageTrees = VantageTrees(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` where ``queries`` holds, the ``k`` nearest of all other rows by Euclidean distance,
    ties to the smaller id; all, if there are fewer. With ``factor`` 1 these are the nearest; above, some may be missed.

    Every row is indexed. A shallow tree over a bounded sample splits space into regions, and regions are cut into shards of
    bounded size, each with a tree of its own, stored. Neighbouring shards form groups. A query first meets its own shard, which
    gives a k-th distance to beat, and is then sent to those groups only whose regions it can't rule out; a task holds one
    group's trees while queries stream by, so nothing is paired out and no side is broadcast. Where vectors lie alike to
    all points, as evenly spread directions do, nothing is ruled out and each query meets each vector in a matrix product. Final distances are
    computed from differences of the original vectors in doubles.

    Only vectors of one length are compared. A null id, a null, empty or zero vector, or one with a null or non-finite component takes no part.
    Rows with a repeated id are answered each, and meet each other. Components beyond 1e140 count as that. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "vantage")
    rows = real_vectors(vectors, queries, id_col, vec_col)
    regions = draw_regions(rows, p)
    placed = ws.save(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_place(regions), "vec_id long, asked boolean, dim int, v array<double>, rid long, region int"), "placed")

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / p.shard).alias("n"))
    before = F.sum("n").over(Window.orderBy("dim", "region").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counts.withColumn("first", F.coalesce(before, F.lit(0)))  # a row a region
    shards = ws.save(numbered, "shards")
    total = shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    per_group = max(1, min(p.most, total // n))
    at_home = placed.join(shards, ["dim", "region"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("rid"), F.col("n"))).withColumn("grp", F.floor(F.col("shard") / per_group))
    packed = at_home.groupBy("shard", "grp", "dim").agg(F.collect_list(F.struct("rid", "vec_id", "v")).alias("rows"))
    tasks = max(n, -(-total // per_group))
    index = ws.save(packed.mapInArrow(_plant(p), _INDEX_DDL), "index")

    def answers(asked: DataFrame, at_home: bool) -> DataFrame:
        """``asked``: rid, kth, shard (their home), grp, dim, v."""
        null = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name not in asked.columns]
        both = index.select("*", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("double").alias("kth")).unionByName(asked.select("*", *null))
        return both.repartition(tasks, "grp").sortWithinPartitions("grp", F.col("rid").isNotNull()).mapInArrow(_search(p, at_home), _FOUND_DDL)

    asked = ws.save(at_home.where("asked").select("rid", "vec_id", "dim", "v", "shard", "grp"), "queries")
    seeds = ws.save(answers(asked.drop("vec_id").withColumn("kth", F.lit(float("inf"))), True), "seeds")

    sent = asked.select("rid", "dim", "v", "shard").join(seeds.select("rid", "kth"), "rid").mapInArrow(_route(regions, p), "rid long, dim int, v array<double>, shard long, kth double, regions array<int>")
    spans = shards.groupBy("dim").agg(F.collect_list(F.struct("region", F.floor(F.col("first") / per_group).alias("a"), F.floor((F.col("first") + F.col("n") - 1) / per_group).alias("b"))).alias("spans"))
    groups = F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda s: F.array_contains("regions", s["region"])), lambda s: F.sequence(s["a"], s["b"]))))
    met = answers(sent.join(spans, "dim").select("rid", "dim", "v", "shard", "kth", F.explode(groups).alias("grp")), False)

    best = seeds.unionByName(met).select("rid", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("found").alias("score"))).alias("r")).select("rid", "r.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy("score", "vec_id"))).where(F.col("rank") <= p.k)
    return ranked.join(asked.select("rid", F.col("vec_id").alias("query_id")), "rid").select("query_id", "rank", "vec_id", "score")
