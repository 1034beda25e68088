import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import vantage as V
from meterlake.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, dim int, n long, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], VECTORS)


# whitening

def exact_covariance(x):
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    d = len(s)
    return n, s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("far", [0, 10**6, 2**45])
def test_gram_keeps_what_doubles_lose(far):
    rng = random.Random(far)
    x = [[far * (j + 1) + rng.randrange(-(10**(j + 1)), 10**(j + 1)) for j in range(5)] for _ in range(700)]
    n, s, v = exact_covariance(x)
    m = W.Moments(n, [a >> 32 for a in s], [a & 0xFFFFFFFF for a in s])
    a = np.array(x, np.int64)
    total = None
    for part in np.array_split(a, 7):  # tasks
        g = W.gram(*W.centred(part.astype(float), m.mean))
        total = W.add(total, g) if total else g
    for i in range(5):
        for j in range(5):
            got, want = (Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j]))) / n, v[i][j]
            assert abs(got - want) <= Fraction(1, 10**25) * Fraction(math.sqrt(v[i][i] * v[j][j]))


def brute_whitening(rows, scale=256, components=4):
    good = [(i, [math.floor(float(np.float32(c)) * scale) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in good if x}:
        mine = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in mine})
        n, s, v = exact_covariance(fit)
        values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
        order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
        for i, x in mine:
            y = [n * a - b for a, b in zip(x, s)]
            for c, k in enumerate(order):
                out.append((d, i, c + 1, n, sum(a * a for a in y), abs(float(np.array([a / n for a in y]) @ vectors[:, k]) / math.sqrt(values[k])), values[k] / float(sum(v[j][j] for j in range(d)))))
    return out


def test_whitening_equals_exact_fractions(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(3, 0.3 * (j + 1)) for j in range(6)]) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(200)] + rows[:5]  # copies count once in the fit
    rows += [(800, None), (801, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (804, []), (None, [1.0] * 6)]
    rows += [(900 + i, [rng.gauss(0, 1), rng.gauss(0, 2)]) for i in range(40)] + [(950, [1.0, 2.0, 3.0])]  # other lengths; one alone has no variance
    got = [tuple(r) for r in W.whiten(table(spark, rows)).collect()]
    want = brute_whitening(rows)
    assert len(got) == len(want) == 4 * 506 + 2 * 40
    for g, w in zip(sorted(((i, c, n, far, abs(x), share) for i, c, n, far, x, share, _ in got), key=lambda r: (str(r[0]), r[1], r[2], r[4])), sorted((w[1:] for w in want), key=lambda r: (str(r[0]), r[1], r[2], r[4]))):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-12)
    assert max(r[6] for r in got) < 1e-10
    # one sign for all rows: components are uncorrelated and of variance one over the fit list
    one = {r[0]: r[4] for r in got if r[1] == 1 and r[0] is not None and r[0] < 300}
    assert min(one.values()) < 0 < max(one.values())


def test_whitening_of_extremes(spark):
    rows = [(i, [1e30 * (i % 3), float(i), 0.0]) for i in range(9)]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) % 9 == 0 and all(r["deviation"] is None for r in got) and all(math.isfinite(r["whitened"]) for r in got)
    assert W.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert W.whiten(table(spark, [])).count() == 0 and W.whiten(table(spark, [(1, None), (2, [])])).count() == 0


# vantage-point trees

def brute_nearest(rows, k, every=10):
    good = [(at, i, np.array(v, np.float32).astype(float)) for at, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for at, q, a in good:
        if q % every == 0:
            near = sorted((math.sqrt(((a - b) ** 2).sum()), i) for other, i, b in good if other != at and len(a) == len(b))
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def clustered(rng, n, dim=8, clusters=40):
    centres = [[rng.gauss(0, 4) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, 1) for c in centres[i * 7 % clusters]]) for i in range(n)]


@pytest.mark.parametrize("p", [V.VantageTrees(factor=1.0, shard=60, leaf=8, sample=50, depth=3), V.VantageTrees(factor=1.0, k=400, leaf=4, lengths=1), V.VantageTrees(factor=1.0, k=3, shard=1, leaf=1, depth=1, most=2)])
def test_factor_one_is_exact(spark, p):
    rng = random.Random(3)
    rows = clustered(rng, 400) + [(1000 + i, [0.5] * 8) for i in range(70)]  # copies, beyond a shard and a leaf
    rows += [(1, [0.25] * 8), (10, [rng.gauss(0, 1) for _ in range(8)]), (10, [0.5] * 8), (1010, [0.5] * 7 + [0.5000001])]  # repeated ids
    rows += [(2000, None), (2010, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, []), (2050, [0.0] * 8), (None, [1.0] * 8), (2060, [1.0, 2.0]), (2070, [3.0, 1.0]), (2080, [1.0])]
    rows += [(2100, [1e30] * 8), (2101, [1.1e30] * 8)]
    got = sorted(tuple(r) for r in V.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, p).select("query_id", "rank", "vec_id", "score").collect())
    want = brute_nearest(rows, p.k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-15) for g, w in zip(got, want))


def test_recall_of_relaxed_pruning(spark):
    rows = clustered(random.Random(4), 3000)
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 10)}
    for factor, least in ((1.5, 0.97), (3.0, 0.8)):
        got = {(r["query_id"], r["vec_id"]) for r in V.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, V.VantageTrees(factor=factor, shard=500, leaf=16)).collect()}
        assert len(got) == len(want) and len(got & want) >= least * len(want)


def test_trees_rule_out_branches():
    """On clustered vectors most products are never evaluated, fewer the larger the factor; factor one loses nothing."""
    x = np.array([v for _, v in clustered(random.Random(5), 8000)])
    rids = np.arange(len(x))
    read = []
    for factor in (1.0, 1.5, 3.0):
        p = V.VantageTrees(factor=factor, leaf=16)
        tree, order = V.Tree.build(x, 9)
        best = V.Nearest(rids[::80], x[::80], np.full(100, np.inf), p)
        best.search(np.arange(100), tree, rids[order], rids[order], x[order])
        read.append(best.evaluated / (100 * len(x)))
        if factor == 1:
            d = np.sqrt(((x[::80, None] - x) ** 2).sum(2))
            d[np.arange(100), rids[::80]] = np.inf
            assert best.ids.reshape(100, 10).tolist() == np.argsort(d, axis=1, kind="stable")[:, :10].tolist()
    assert read[0] < 0.5 and read[0] > read[1] > read[2]


def test_queries_that_are_vantage_points_lose_nothing():
    """Their bounds are exact, so that stretching them must not rule out what they search."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24))
    tree, order = V.Tree.build(x, 3)
    at = np.array([int(np.flatnonzero((x == point).all(axis=1))[0]) for point in tree.points])
    best = V.Nearest(at, x[at], np.full(len(at), np.inf), V.VantageTrees(factor=2.0))
    best.search(np.arange(len(at)), tree, np.arange(600)[order], np.arange(600)[order], x[order])
    d = np.sqrt(((x[at, None] - x) ** 2).sum(2))
    d[np.arange(len(at)), at] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    got = best.ids.reshape(len(at), 10)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist())]) >= 9.5


def test_nearest_of_nothing(spark):
    assert V.nearest(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert V.nearest(table(spark, [(10, [1.0, 2.0])]), F.col("vec_id") % 10 == 0).count() == 0
