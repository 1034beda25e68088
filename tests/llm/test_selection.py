import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import mixing as M
from meterlake.llm import topk, url_filters


# exact top-k

def brute_topk(rows, k, scale=64):
    """Every row is told apart by its place, so rows with one id answer each and meet each other."""
    good = [(at, i, [math.floor(float(np.float32(c)) * scale) for c in v]) for at, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, q, a in good:
        if q % 5 == 0:
            scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for other, i, b in good if other != at and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("p", [topk.TopK(k=7, block=40, group=8), topk.TopK(k=500, block=10_000), topk.TopK(k=3, pivots=2, block=16, group=1, lengths=1)])
def test_topk_equals_all_scores(spark, p):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(12)]
    rows += [(300, None), (305, [1.0, None] + [0.0] * 6), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (320, []), (325, [1.0, 2.0]), (330, [3.0, 1.0]), (None, [1.0] * 8)]
    rows += [(200, [0.5] * 8), (5, [rng.gauss(0, 0.2) for _ in range(8)]), (5, [rng.gauss(0, 0.2) for _ in range(8)])]  # repeated rows and ids
    # components beyond 2**24, 2**53 and 2**63 after scaling
    rows += [(400 + i, [rng.choice([1, -1]) * rng.uniform(1, 9) * m for _ in range(8)]) for i, m in enumerate([1e5, 1e6, 1e8, 1e15, 1e20, 1e37] * 2)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, dim int")
    assert sorted(tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 5 == 0, p).collect()) == brute_topk(rows, p.k)


def test_pivots_rule_out_far_groups():
    """Clustered vectors: the nearest pivots' groups are evaluated and most others never are."""
    rng = np.random.default_rng(5)
    p = topk.TopK(k=5, pivots=16, group=50)
    centres = rng.standard_normal((16, 12)).round(1) * 1000
    c = np.floor(np.repeat(centres, 500, axis=0) + rng.standard_normal((8000, 12)) * 20)
    ids = np.arange(8000)
    d = topk.distances(c, centres)
    cuts = np.arange(0, 8000, p.group)
    best = topk.Best(ids[::400] + 10_000, c[::400], d[::400], None, p)
    best.search(ids, ids, c, np.maximum.reduceat((c * c).sum(1), cuts), np.minimum.reduceat(d, cuts), np.maximum.reduceat(d, cuts))
    scores = c[::400] @ c.T
    expected = [np.lexsort((ids, -s))[: p.k].tolist() for s in scores]
    assert best.ids.reshape(20, p.k).tolist() == expected
    assert best.evaluated < 0.35 * scores.size


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(df, F.col("vec_id") % 20 == 0).count() == 0


# URL filters

def brute_rule(url, at, entries):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    if not m or at is None:
        return False, None
    host = m[1].lower().rstrip(".")
    path = re.match(r"^[^:]*://[^/?#]*([^?#]*)", url)[1] or "/"
    best = None
    for d, p, a, t in entries:
        if a == "remove" or t > at or not (host == d or host.endswith("." + d)) or not path.startswith(p):
            continue
        if any(d2 == d and p2 == p and t < t2 <= at for d2, p2, _, t2 in entries):
            continue
        best = max(best, (len(d), len(p), d, p, a)) if best else (len(d), len(p), d, p, a)
    return bool(best and best[4] == "block"), best and best[4]


def test_urls_meet_the_entries_of_their_day(spark):
    rng = random.Random(7)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    hosts = ["a.b.c.org", "b.c.org", "c.org", "x.net", "xc.org"]
    entries = list({(rng.choice(hosts), rng.choice(["/", "/p/", "/p/q"]), n): (rng.choice(["block", "allow", "remove"])) for n in rng.sample(range(100), 40)}.items())
    entries = [(d, p, a, day(n)) for (d, p, n), a in entries]
    urls = [f"https://{rng.choice(['', 'me@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p/z', '/p/q?x=/', '?p#y'])}" for _ in range(300)] + [None, "", "no url", "http:///x", "HTTP://C.ORG./P/"]
    rows = [(i, u, day(rng.randrange(-5, 110))) for i, u in enumerate(urls)] + [(0, urls[0], day(50)), (900, urls[1], None), (None, urls[2], day(50))]
    c = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, fetched_at date, host string")
    e = spark.createDataFrame(entries, "domain string, prefix string, action string, listed_at date")
    got = sorted(repr((r["page_id"], r["fetched_at"], r["blocked"], r["action"])) for r in url_filters.filter_urls(c, e).collect())
    assert got == sorted(repr((i, t, *brute_rule(u, t, entries))) for i, u, t in rows)
    # two actions on one date, IPv6, long paths
    e2 = spark.createDataFrame([("[::1]", "/", "block", day(0)), ("t.org", "/", "block", day(0)), ("t.org", "/", "allow", day(0)), ("t.org", "/" + "a" * 5000, "remove", day(1))], e.schema)
    c2 = spark.createDataFrame([(1, "http://[::1]:8080/x", day(1), ""), (2, "http://t.org/y", day(2), ""), (3, "http://t.org/" + "a" * 100_000, day(3), "")], c.schema)
    assert sorted((r["page_id"], r["host"], r["blocked"]) for r in url_filters.filter_urls(c2, e2).collect()) == [(1, "[::1]", True), (2, "t.org", True), (3, "t.org", True)]
    assert not any(r["blocked"] for r in url_filters.filter_urls(c, e.where("false")).collect()) and url_filters.filter_urls(c.where("false"), e).count() == 0


def test_a_host_with_very_many_rules(spark):
    e = spark.range(100_000).select(F.lit("big.org").alias("domain"), F.concat(F.lit("/p"), F.col("id")).alias("prefix"), F.lit("block").alias("action"), F.lit(dt.date(2024, 1, 1)).alias("listed_at"))
    urls = [(i, f"https://big.org/p{i}", dt.date(2024, 1, i % 2 + 1)) for i in range(99_990, 100_010)] + [(1, "https://big.org/q", dt.date(2024, 2, 1)), (2, "https://a.big.org/p7/x", dt.date(2023, 2, 1))]
    got = {r["page_id"]: (r["blocked"], r["prefix"]) for r in url_filters.filter_urls(spark.createDataFrame(urls, "page_id long, url string, fetched_at date"), e).collect()}
    # p100001 begins with p10000
    assert got == {i: (True, f"/p{i if i < 100_000 else str(i)[:5]}") for i in range(99_990, 100_010)} | {1: (False, None), 2: (False, None)}


# mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id long, size int, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "c") for i, t, s in rows], DOCS)


def shares(rows, weights=(3, 1, 2), budget=1.5, most=2):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target, free, left = {}, set(order), budget * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(most * size[s]) for s in full}
        left -= sum(most * size[s] for s in full)
        free -= full
    return size, target


def corpus(seed=0):
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), f"s{min(rng.randrange(12), 5)}") for i in range(900)]
    return rows + [(2000 + i, "same text", "s0") for i in range(1200)] + [(5000, None, None), (5001, "a b", None), (5002, "", "empty"), (None, "x y z", "s1"), (9000, "again", "s2"), (9000, "again", "s2")]


def test_mix_meets_its_targets(spark):
    rows = corpus()
    size, target = shares(rows)
    got = M.mix_sizes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {}
    for i, t, s in rows:
        source[i] = s
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1, s
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix_sizes(docs(spark, rows).repartition(7)).collect()))


def test_mix_rows_are_those_that_the_sizes_tell(spark):
    rows = corpus(1)
    copies = Counter()
    for r in M.mix_sizes(docs(spark, rows)).collect():
        copies[r["doc_id"]] += r["copies"]
    out = M.mix(docs(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r["doc_id"] for r in out.collect()) == +copies


def test_mix_of_nothing(spark):
    assert M.mix_sizes(docs(spark, [])).count() == 0 and M.mix(docs(spark, [])).count() == 0
    assert [(r["target"], r["taken"]) for r in M.mix_sizes(docs(spark, [(1, None, "a")])).collect()] == [(0.0, 0)]


def test_groups_do_not_change_the_ranks(spark):
    rows = corpus(2)
    key = lambda p: sorted(map(repr, M.mix_sizes(docs(spark, rows), p).collect()))
    assert key(M.Mixing(group=5)) == key(M.Mixing(group=100_000))
