"""Batches of journal records that count as a whole or not at all."""

import hashlib
import random


from meterlake.operators import events

BATCHED = "batch long, kind string, n int, seq long, id long, rev long, status string, digest string, manifest string, count long"
LOOSE = "id long, rev long, seq long, status string, digest string"


def manifest(digests):
    return hashlib.sha256("\n".join(digests).encode()).hexdigest()


def batch(b, seqs, actions, count=None, m=None):
    """begin, actions (id, rev, digest) and commit at the given sequence numbers."""
    count, m = len(actions) if count is None else count, m or manifest([d for *_, d in actions])
    mark = lambda kind, s: (b, kind, -1, s, None, None, None, "mark", m, count)
    return [mark("begin", seqs[0]), *[(b, "action", n, s, i, r, "active", d, None, None) for n, (s, (i, r, d)) in enumerate(zip(seqs[1:], actions))], mark("commit", seqs[-1])]


def verdicts(spark, rows):
    s = events.batch_state(spark.createDataFrame(rows, BATCHED))
    return {r["batch"]: (r["verdict"], r["violations"]) for r in events.batch_verdicts(s).collect()}


def test_each_violation_taints(spark):
    acts = [(1, 5, "a"), (2, 5, "b")]
    good = batch(1, [1, 2, 3, 4], acts)
    rows = good + good  # said twice is no conflict
    rows += [(2, *r[1:]) for r in good[:-1]] + [(3, *r[1:]) for r in good[1:]]
    rows += batch(4, [1, 2, 3, 4], acts, count=3) + batch(5, [1, 2, 3, 4], acts, m="other")
    rows += batch(6, [1, 3, 2, 4], acts) + batch(7, [4, 2, 3, 1], acts) + batch(8, [1, 2, 5, 4], acts)
    rows += [(9, *r[1:]) for r in good] + [(9, "action", 1, 9, 2, 5, "active", "z", None, None)]
    rows += [(10, *r[1:]) for r in good[:-1]] + [(10, "commit", -1, 4, None, None, None, "mark", good[-1][8], 7)]
    rows += [(11, *r[1:]) for r in good] + [(11, "begin", -1, 0, None, None, None, "other mark", good[0][8], 2)]
    rows += batch(12, [1, 2], []) + [(13, *good[1][1:])]
    order = "record_order_violation"
    assert verdicts(spark, rows) == {
        1: ("completed", ""), 2: ("open", ""), 3: ("tainted", "commit_without_begin"), 4: ("tainted", "manifest_action_sequence_mismatch"), 5: ("tainted", "manifest_actions_hash_mismatch"), 6: ("tainted", order), 7: ("tainted", order), 8: ("tainted", order),
        9: ("tainted", "action_sequence_conflict"), 10: ("tainted", "marker_manifest_mismatch"), 11: ("tainted", "marker_conflict"), 12: ("completed", ""), 13: ("open", "")}


def test_a_late_commit_counts_and_a_late_conflict_withdraws(spark):
    loose = spark.createDataFrame([(1, 0, 1, "active", "old"), (1, 1, 2, "active", "new")], LOOSE)
    b = batch(1, [3, 4, 6], [(1, 2, "newest")])
    rows = lambda r: spark.createDataFrame(r, BATCHED)
    now = lambda s: [(r["rev"], r["digest"]) for r in events.effective_with_batches(events.loose_state(loose), s).collect()]
    s = events.batch_state(rows(b[:-1]))
    assert now(s) == [(1, "new")]
    s = events.batch_state(rows(b[-1:]), s)
    assert now(s) == [(2, "newest")]
    s = events.batch_state(rows([(1, "action", 0, 8, 1, 2, "active", "forged", None, None)]), s)
    assert now(s) == [(1, "new")]


def test_increments_equal_a_full_read(spark):
    rng = random.Random(3)
    rows, seq = [], 0
    for b in range(40):
        acts = [(rng.randrange(12), rng.randrange(4), rng.choice("abc")) for _ in range(rng.randrange(0, 4))]
        made = batch(b, list(range(seq, seq + len(acts) + 2)), acts, count=None if rng.random() < 0.8 else 2)
        seq += len(acts) + 2
        rows += rng.sample(made, len(made) - 1) if rng.random() < 0.2 else made
        if rng.random() < 0.15 and acts:
            rows.append((b, "action", 0, seq, 1, 1, "active", "other", None, None))
            seq += 1
    loose = [(rng.randrange(12), rng.randrange(4), 1000 + i, rng.choice(["active", "active", "tombstone"]), rng.choice("abc")) for i in range(60)]
    deal = [rng.randrange(4) for _ in rows]
    a = b = None
    for n in range(4):
        a = events.loose_state(spark.createDataFrame([r for i, r in enumerate(loose) if i % 4 == n], LOOSE), a)
        b = events.batch_state(spark.createDataFrame([r for r, d in zip(rows, deal) if d == n], BATCHED), b)
    full = events.effective_with_batches(events.loose_state(spark.createDataFrame(loose, LOOSE)), events.batch_state(spark.createDataFrame(rows, BATCHED)))
    got = sorted(map(tuple, events.effective_with_batches(a, b).collect()))
    assert got == sorted(map(tuple, full.collect())) and len(got) > 5
    # against plain records of completed batches
    done = {k for k, (v, _) in verdicts(spark, rows).items() if v == "completed"}
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[7])):
        if r[1] == "action" and r[0] in done:
            first.setdefault((r[0], r[2]), r)
    plain = [(r[4], r[5], r[3], r[6], r[7]) for r in first.values()] + loose
    want = events.effective_events(spark.createDataFrame(plain, LOOSE)).select(*full.columns)
    assert got == sorted(map(tuple, want.collect()))
