"""Near-duplicate documents by HyperMinHash registers, banding and verified links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import WordHashes, mix, shingle_set
from .store import Workspace

MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: Words' hashes in one block of a family; bounds what one row holds.
BLOCK_HASHES = 1 << 16


@dataclass(frozen=True)
class NearDedup:
    """Parameters. 25 bands of 5 registers find a pair of similarity 0.8 with probability 0.9999.

    ``slack``: a pair is dropped unverified if its estimate is lower than the threshold by more than this,
    six standard deviations of an estimate from 125 registers; sets of fewer than ``small`` shingles
    are always verified.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    slack: float = 0.22
    small: int = 64

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def starts(self) -> np.ndarray:
        return np.array([i * 2**64 // self.registers for i in range(self.registers)], np.uint64)

    def probes(self) -> np.ndarray:
        """For each bucket, the order in which others lend it their register if it is empty."""
        rng = np.random.default_rng(20_240_101)
        return np.array([rng.permutation(self.registers) for _ in range(self.registers)])


def registers(sets: np.ndarray, starts: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Per bucket of the hash space, the least hash as leading zeros (6 bits) and mantissa (10 bits).

    An empty bucket takes the register of the first bucket of its probe order that has one, so that
    each register still agrees between two sets with the probability of their similarity.
    """
    m = len(starts)
    at = np.searchsorted(sets, starts)
    ends = np.append(at[1:], len(sets))
    full = at < ends
    low = (sets[at[full]] - starts[full]).astype(np.float64) * (m / 2.0**64)
    mantissa, exponent = np.frexp(np.maximum(low, 2.0**-62))
    out = np.full(m, EMPTY, np.uint16)
    zeros = np.clip(-exponent, 0, 62).astype(np.uint16)
    out[full] = (zeros << np.uint16(MANTISSA_BITS)) | ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.uint16)
    if not full.all() and full.any():
        lender = probes[np.arange(m), full[probes].argmax(axis=1)]
        out = np.where(full, out, out[lender])
    return out


def band_hashes(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for col in regs.reshape(bands, rows).astype(np.uint64).T:
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + col)
    return acc.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from equal registers, less the share of unequal least hashes that agree in
    exponent and mantissa by chance (0.17 of one in 2**MANTISSA_BITS, for sets of like size)."""
    chance = 0.17 / (1 << MANTISSA_BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(p: NearDedup):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, starts, probes = WordHashes(), p.starts(), p.probes()

        def rows():
            for b in batches:
                for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    s = shingle_set(t.as_py(), p.shingle, hashes)
                    if len(s):
                        yield i, h, len(s), _key(s), band_hashes(registers(s, starts, probes), p.bands, p.rows)
                    else:
                        yield i, h, 0, None, None

        return _batches(rows(), schema)

    return run


def _payloads(p: NearDedup):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, starts, probes = WordHashes(), p.starts(), p.probes()

        def rows():
            for b in batches:
                for t in b.column(0):
                    s = shingle_set(t.as_py(), p.shingle, hashes)
                    if len(s):
                        yield _key(s), len(s), s.tobytes(), registers(s, starts, probes).tobytes()

        return _batches(rows(), schema, 128)

    return run


def _verify(p: NearDedup):
    """Rows (hub, key, n, hashes, regs, hub_n, hub_hashes, hub_regs) -> (hub, key, n, sim, exact, link)."""
    schema = pa.schema([("hub", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sim", pa.float64()), ("exact", pa.bool_()), ("link", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for hub, key, n, hs, rg, hn, hhs, hrg in zip(*b.columns):
                    n, hn = n.as_py(), hn.as_py()
                    sim = estimate(np.frombuffer(rg.as_py(), np.uint16), np.frombuffer(hrg.as_py(), np.uint16))
                    if min(n, hn) >= p.small and sim * 100 < p.percent - 100 * p.slack:
                        yield hub.as_py(), key.as_py(), n, sim, False, False
                        continue
                    common = len(np.intersect1d(np.frombuffer(hs.as_py(), np.uint64), np.frombuffer(hhs.as_py(), np.uint64), assume_unique=True))
                    union = n + hn - common
                    yield hub.as_py(), key.as_py(), n, common / union, True, 100 * common >= p.percent * union

        return _batches(rows(), schema)

    return run


def _across(p: NearDedup):
    """Rows (strays, members), each a block of (key, root, n, sim, exact, hashes, regs) -> links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    far = 1 - p.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for strays, members in zip(*b.columns):
                    strays, members = strays.as_py(), members.as_py()
                    sets = [np.frombuffer(m["hashes"], np.uint64) for m in members]
                    sizes = np.array([len(s) for s in sets])
                    regs = np.array([np.frombuffer(m["regs"], np.uint16) for m in members])
                    sims, exact = np.array([m["sim"] for m in members]), np.array([m["exact"] for m in members])
                    for y in strays:
                        n = y["n"]
                        slack = np.where(exact & y["exact"], 1e-9, 2 * p.slack)
                        fit = (np.minimum(sizes, n) * 100 >= p.percent * np.maximum(sizes, n)) & (1 - sims >= 1 - y["sim"] - far - slack)
                        fit = np.flatnonzero(fit)
                        alike = (regs[fit] == np.frombuffer(y["regs"], np.uint16)).mean(1)
                        fit = fit[(np.minimum(sizes[fit], n) < p.small) | (alike * 100 >= p.percent - 100 * p.slack)]
                        if not len(fit):
                            continue
                        s = np.frombuffer(y["hashes"], np.uint64)
                        told = {y["root"]}
                        for i in fit:
                            if (root := members[i]["root"]) in told:  # one link to a component is as good as all
                                continue
                            common = int((s[np.minimum(np.searchsorted(s, sets[i]), n - 1)] == sets[i]).sum())
                            if 100 * common >= p.percent * (sizes[i] + n - common):
                                told.add(root)
                                yield y["key"], members[i]["key"]

        return _batches(rows(), schema)

    return run


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id that can be
    reached by links of similarity ``percent`` or more, its own included) and kept.

    Equal sets collapse to one class before anything is compared, so a group of exact copies costs one
    row. Bands then bring classes together in buckets. A bucket is not paired out: its most widely
    matched member is the hub, every other is verified against the hub on its full set, and only those
    that miss the hub, the strays, are compared, block by block, with the family's members of other components, as
    far as the triangle inequality from the hub allows a link at all (``_links_past_hubs``).

    Null and wordless texts have an empty set, no link and themselves as component. Repeated rows and
    rows sharing an id are separate rows of one component if their sets are linked. A null id never
    names a component unless all ids in it are null. An empty table gives an empty result. ``detail`` adds
    text_hash and root, which tell rows without a usable id apart.
    """
    p, ws = params, Workspace(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = ws.save(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_signatures(p), "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>"), "signatures")
    classes = sigs.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # numbered once: whole numbers are joined and aggregated by hash
    classes = ws.save(classes.withColumnRenamed("key", "digest").withColumn("key", F.monotonically_increasing_id()), "classes")

    rows = ws.save(sigs.drop("bands"), "rows")
    ws.drop(sigs)
    # a smaller set reaches the threshold with its equal only, which is in its class already
    banded = classes.where(F.col("n_shingles") * 100 >= p.percent * (F.col("n_shingles") + 1)).select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    multi = ws.save(banded.join(shared, "band"), "buckets")
    spread = multi.groupBy("key").agg(F.sum("members").alias("spread"))
    # a tie of ranks between members of one bucket may go either way; any hub leads to the same components
    rank = F.col("spread") + F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    hubs = ws.save(multi.join(spread, "key").groupBy("band").agg(F.max_by("key", rank).alias("hub")), "hubs")
    stars = ws.save(multi.select("band", "key").join(hubs, "band").where("key <> hub").select("hub", "key").distinct(), "stars")
    named = ws.save(classes.select("key", "digest", "rep"), "named")
    ws.drop(multi, hubs, classes)

    compared = stars.select("key").union(stars.select(F.col("hub").alias("key"))).distinct()
    met = ws.save(named.join(compared, "key", "left_semi"), "compared")
    ids = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    told = texts.mapInArrow(_payloads(p), "digest binary, n long, hashes binary, regs binary")
    payload = ws.save(told.join(met.select("key", "digest"), "digest").drop("digest").dropDuplicates(["key"]), "sets")
    hub_side = payload.select(F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("hashes").alias("hub_hashes"), F.col("regs").alias("hub_regs"))
    pairs = stars.join(payload, "key").join(hub_side, "hub").select("hub", "key", "n", "hashes", "regs", "hub_n", "hub_hashes", "hub_regs")
    tried = ws.save(pairs.mapInArrow(_verify(p), "hub long, key long, n long, sim double, exact boolean, link boolean"), "tried")
    links = ws.save(tried.where("link").select(F.col("hub").alias("a"), F.col("key").alias("b")), "links")
    more = _links_past_hubs(tried, payload, components(links, ws), p, ws)
    ws.drop(stars, met, payload, tried)
    roots = components(links.unionByName(more), ws)

    named = named.join(roots.withColumnRenamed("node", "key"), "key", "left").select("digest", "rep", F.coalesce("root", "key").alias("root"))
    named = ws.save(named, "named")
    least = ws.save(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    ofkey = ws.save(named.join(least, "root").select(F.col("digest").alias("key"), "component_id", "root"), "components")
    out = rows.join(ofkey, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_hash", "root"] if detail else []))


def _links_past_hubs(tried: DataFrame, payload: DataFrame, roots: DataFrame, p: NearDedup, ws: Workspace) -> DataFrame:
    """Links between members of one hub's family that the hub itself doesn't join.

    Strays meet the others of their family in blocks of bounded size. A pair's registers are compared first, which is a few
    nanoseconds, so that full sets are compared only where the estimate allows a link; still, pairs of strays and others grow
    with the square of a family whose members look alike and are not linked.
    """
    root_of = roots.withColumnRenamed("node", "key")
    hub_root = root_of.select(F.col("key").alias("hub"), F.col("root").alias("hub_root"))
    astray = ws.save(tried.where("not link").select("hub").distinct(), "astray")
    rooted = ws.save(tried.join(astray, "hub").join(root_of, "key", "left").select("hub", "key", "n", "sim", "exact", F.coalesce("root", "key").alias("root")), "rooted")
    marked = ws.save(rooted.join(hub_root, "hub", "left").withColumn("stray", F.col("root") != F.coalesce("hub_root", "hub")), "marked")
    sizes = ws.save(marked.groupBy("hub", "stray").agg(F.ceil(F.sum("n") / BLOCK_HASHES).alias("blocks")), "sizes")
    one = F.struct("key", "root", "n", "sim", "exact", "hashes", "regs")
    # a member as far from the hub as the nearest stray allows; the rest cannot be linked to a stray
    slack = F.when(F.col("exact"), F.lit(1e-9)).otherwise(F.lit(2 * p.slack))
    reach = ws.save(marked.where("stray").groupBy("hub").agg(F.max(F.col("sim") + slack).alias("near")), "reach")
    fringe = marked.join(reach, "hub").where(F.col("stray") | (1 - F.col("sim") >= 1 - F.col("near") - (1 - p.percent / 100) - slack)).drop("near")
    placed = fringe.join(sizes, ["hub", "stray"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).select("hub", "stray", "block", "key", "root", "n", "sim", "exact")
    full = ws.save(placed.join(payload.select("key", "hashes", "regs"), "key"), "placed")
    blocks = ws.save(full.groupBy("hub", "stray", "block").agg(F.collect_list(one).alias("rows")), "blocks")
    strays = blocks.where("stray").select("hub", F.col("rows").alias("strays"))
    met = strays.join(blocks.select("hub", F.col("rows").alias("members")), "hub").select("strays", "members")
    found = ws.save(met.mapInArrow(_across(p), "a long, b long"), "links")
    ws.drop(astray, rooted, marked, sizes, reach, full, blocks)
    return found
