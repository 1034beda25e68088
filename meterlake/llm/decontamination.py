"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import WordHashes, mix, rolling
from .store import Workspace

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Windows looked at at a time.
SPAN = 1 << 12


@dataclass(frozen=True)
class Decontamination:
    """``radius``: bits in which the fingerprints of a window and an item may differ at most; ``blocks``: into how many blocks they are cut. ``exact``: windows
    and items are met by the rarest shingles of items instead of fingerprints, which loses no match. ``filter_bits``: log2 of the most bits that each of the two shingle filters may take (8 MB); they take 16 a shingle of the
    benchmark if that is less. Fuller filters let more windows pass, and lose none. ``small_index``, ``small_bytes``: rows of the
    index and bytes of the items' shingles up to which both are broadcast."""

    shingle: int = 5
    percent: int = 80
    radius: int = 19
    blocks: int = 6
    exact: bool = False
    filter_bits: int = 26
    small_index: int = 200_000
    small_bytes: int = 16 << 20


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits (and of characters beyond ASCII), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def simhash(shingles: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` shingles: per bit, whether most shingles of the run have it, repeats counted."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    return np.packbits(2 * (ones[width:] - ones[:-width]) > width, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def hamming_blocks(radius: int, blocks: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each block. The radii and one each add up to ``radius + 1``, so two fingerprints that differ in
    more than its radius in every block differ in more than ``radius`` bits altogether; the widest blocks have the larger radii."""
    edges = [round(bits * i / blocks) for i in range(blocks + 1)]
    if not blocks <= radius + 1:
        raise ValueError("more blocks than the radius can use")
    each, more = divmod(radius + 1 - blocks, blocks)
    widest = sorted(range(blocks), key=lambda i: (edges[i] - edges[i + 1], i))[:more]
    return [(lo, hi - lo, each + (i in widest)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def within(bits: int, radius: int) -> np.ndarray:
    """All patterns of ``bits`` bits of which ``radius`` are set at most, in order."""
    return np.array(sorted(sum(1 << j for j in c) for n in range(radius + 1) for c in combinations(range(bits), n)), np.uint64)


def _index(p: Decontamination):
    """Items -> (length, no, block, uid, item_fp): all values of each block within its radius."""
    schema = pa.schema([("length", pa.int32()), ("no", pa.int32()), ("block", pa.int64()), ("uid", pa.int64()), ("item_fp", pa.int64())])
    cuts = [(np.uint64(lo), np.uint64((1 << bits) - 1), within(bits, r)) for lo, bits, r in hamming_blocks(p.radius, p.blocks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for no, (lo, mask, near) in enumerate(cuts):
                step = max(1, (1 << 16) // len(near))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    values = (fps[at : at + step, None] >> lo & mask) ^ near
                    repeated = pa.array(np.repeat(np.arange(part.num_rows), len(near)))
                    yield pa.RecordBatch.from_arrays([part.column("length").take(repeated), pa.array(np.full(values.size, no, np.int32)), pa.array(values.reshape(-1).view(np.int64)), part.column("uid").take(repeated), part.column("fp").take(repeated)], schema=schema)

    return run


def keys_of(shingles: np.ndarray, length: int) -> np.ndarray:
    """Shingles as keys of the index, which differ by the length of the item."""
    return mix(shingles + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Weighted Jaccard similarity of shingles, weights being counts, as (sum of minima, sum of maxima)."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common, len(a) + len(b) - common


def _items(p: Decontamination):
    schema = pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = tokens(t.as_py())
                if words:
                    s = rolling(words, p.shingle, hashes)
                    rows.append((i, len(words), int(simhash(s, len(s)).view(np.int64)[0]), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _keys(p: Decontamination):
    """(uid, width, key, n): distinct shingles of items with their counts; ``width`` counts all."""
    schema = pa.schema([("uid", pa.int64()), ("width", pa.int32()), ("key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for uid, length, x in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    s = np.frombuffer(x, np.uint64)
                    keys, n = np.unique(keys_of(s, length).view(np.int64), return_counts=True)
                    rows += zip([uid] * len(keys), [len(s)] * len(keys), keys.tolist(), n.tolist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _windows(p: Decontamination, lengths: list[int], seen: np.ndarray, indexed: np.ndarray | None, log2: int):
    """(doc_id, text_hash, start, length, item_length, fp, keys, shingles): windows of items' lengths, and whole documents for the longer
    items to which they can be similar enough, in which the share of shingles that
    pass the filter allows the asked similarity; no other window can be similar enough. With ``indexed`` those that hold no key go as well."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("item_length", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])
    mask = np.uint64((1 << log2) - 1)

    def of(words: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, int, int, int | None, np.ndarray | None, bytes]]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in lengths:
            k = min(p.shingle, length)
            # of the item and of the window
            whole, width = length - k + 1, min(len(words), length) - k + 1
            if width < 1 or 100 * width < p.percent * whole:
                break  # nor will longer items do
            if k not in held:
                s = rolling(words, k, hashes)
                hit = seen[s & mask]
                held[k] = s, np.concatenate([[0], np.cumsum(hit)])
            s, hits = held[k]
            # common / (whole + width - common) >= percent / 100
            need = -(-(whole + width) * p.percent // (100 + p.percent))
            if hits[-1] < need:
                if k == p.shingle:
                    break  # longer items need more
                continue
            starts = np.flatnonzero(hits[width:] - hits[:-width] >= need)
            cut = np.flatnonzero((np.diff(starts) > width)) + 1
            for run_ in np.split(starts, cut) if len(starts) else []:
                for at in range(0, len(run_), SPAN):
                    part = run_[at : at + SPAN]
                    if indexed is None:
                        for x, fp in zip(part.tolist(), simhash(s[part[0] : part[-1] + width], width).view(np.int64)[part - part[0]].tolist()):
                            yield x, min(len(words), length), length, fp, None, s[x : x + width].tobytes()
                        continue
                    keys = keys_of(s[part[0] : part[-1] + width], length)
                    on = np.flatnonzero(indexed[keys & mask])
                    keys = keys[on].view(np.int64)
                    lo, hi = np.searchsorted(on, part - part[0]), np.searchsorted(on, part - part[0] + width)
                    for i in np.flatnonzero(lo < hi):
                        yield int(part[i]), min(len(words), length), length, None, np.unique(keys[lo[i] : hi[i]]), s[part[i] : part[i] + width].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), []
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for w in of(tokens(t.as_py()), hashes):
                    rows.append((i, h, *w))
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _verify(p: Decontamination):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, item, start, length, mine, its in zip(*(c.to_pylist() for c in b.columns)):
                common, union = similarity(np.frombuffer(mine, np.uint64), np.frombuffer(its, np.uint64))
                if 100 * common >= p.percent * union:
                    rows.append((i, h, item, start, length, common / union))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _filter_bits(log2: int):
    """Places in a filter: of hashes, or of all hashes in binary rows."""
    schema = pa.schema([("bit", pa.int32())])
    mask = np.uint64((1 << log2) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(0)
            hashes = c.to_numpy().view(np.uint64) if pa.types.is_integer(c.type) else np.concatenate([np.frombuffer(s.as_py(), np.uint64) for s in c] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes & mask).astype(np.int32))], schema=schema)

    return run


def _filter(hashes: DataFrame, log2: int) -> np.ndarray:
    """A filter of ``1 << log2`` bits, packed; its words are put together on Spark, so that its own size is all that the driver gets."""
    bits = hashes.mapInArrow(_filter_bits(log2), "bit int").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("bits")).toPandas()
    words = np.zeros(1 << log2 - 5, "<u4")
    words[bits["word"].to_numpy(int)] = bits["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def _rarest(items: DataFrame, p: Decontamination) -> DataFrame:
    """(uid, key): of each item as many of its rarest shingles as one in a similar window is sure to hold."""
    held = items.select("uid", "length", "shingles").mapInArrow(_keys(p), "uid long, width int, key long, n int")
    ranked = held.join(held.groupBy("key").agg(F.count("*").alias("held_by")), "key")
    before = F.sum("n").over(Window.partitionBy("uid").orderBy("held_by", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    # a window, the shortest document that will do at worst, may lack width - need shingles, so the rarest width - need + 1 are enough
    need = F.ceil(F.col("width") * p.percent / 100)
    return ranked.withColumn("before", before).where(F.col("before") <= F.col("width") - need).select("uid", "key")


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, text_hash, item_id, start, length, similarity): for each document row and benchmark item, the best window of
    the item's length whose weighted five-word shingle similarity to the item is ``percent`` or more. A document
    shorter than the item is one window, of its own length.

    Windows and items have SimHash fingerprints, which are cut in ``blocks`` blocks; the index holds, for each block of an item, all values within the
    block's share of ``radius``, so that fingerprints within the radius agree with it in one block at least: none of them is
    missed. Pairs met are held to the radius and then verified on all their shingles. Two similar texts can have
    fingerprints further apart; how rarely is measured in the README and a test. With ``exact`` nothing is missed: a window that is similar enough
    lacks few of an item's shingles, so it holds one at least of any few more, and windows and items are joined on those that are
    rarest among items of their length.

    Windows that share too few shingles with the whole benchmark never leave their task: a filter of fixed size, sent to all
    tasks, tells them, and no match is lost by it. The index is broadcast if it has at most ``small_index`` rows and the items at most ``small_bytes``, and
    joined by a shuffle otherwise.

    Null, empty and wordless texts on either side match nothing. An item of fewer than five words is one
    shingle. Repeated documents give a row each once per (doc_id, text); repeated items one per id. Of equal
    windows the first counts. Empty tables give no rows.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "decontamination")
    told = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items(p), "item_id long, length int, fp long, shingles binary")
    items = ws.save(told.distinct().withColumn("uid", F.xxhash64("item_id", "shingles")), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    size = items.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0)).alias("bytes")).first()["bytes"]
    log2 = min(p.filter_bits, max(16, (16 * (size // 8)).bit_length()))
    if p.exact:
        index = ws.save(_rarest(items, p), "index")
    else:
        index = ws.save(items.select("length", "uid", "fp").mapInArrow(_index(p), "length int, no int, block long, uid long, item_fp long"), "index")
    packed = spark.sparkContext.broadcast((_filter(items.select("shingles"), log2), _filter(index.select("key"), log2) if p.exact else None))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _windows(p, lengths, *(x if x is None else np.unpackbits(x, bitorder="little") for x in packed.value), log2)(batches)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # stored, so that no task needs two Python workers at once
    found = ws.save(source.mapInArrow(windows, "doc_id long, text_hash long, start int, length int, item_length int, fp long, keys array<long>, shingles binary"), "windows")

    small = index.count() <= p.small_index and size <= p.small_bytes
    payload = items.select("uid", "item_id", F.col("shingles").alias("its"))
    if p.exact:
        index = index.join(index.groupBy("uid").agg(F.collect_list("key").alias("item_keys")), "uid")
        # a pair is taken in the first key in which it agrees
        first = F.element_at(F.array_intersect("item_keys", "keys"), 1) == F.col("key")
        candidates = found.select("*", F.explode("keys").alias("key")).join(F.broadcast(index) if small else index, "key").where(first)
    else:
        cut = hamming_blocks(p.radius, p.blocks)
        apart = F.col("fp").bitwiseXOR(F.col("item_fp"))

        def block(x: str | Column, lo: int, bits: int) -> Column:
            return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << bits) - 1))

        # a pair is taken in the first block in which it is near enough
        first = F.array_position(F.array(*[F.bit_count(block(apart, lo, bits)) <= r for lo, bits, r in cut]), F.lit(True)) == F.col("no") + 1
        probe = found.drop("keys").select("*", F.posexplode(F.array(*[block("fp", lo, bits) for lo, bits, _ in cut])).alias("no", "block"))
        index = index.withColumnRenamed("length", "item_length")
        candidates = probe.join(F.broadcast(index) if small else index, ["item_length", "no", "block"]).where((F.bit_count(apart) <= p.radius) & first)
    if small:
        payload = F.broadcast(payload)
    checked = candidates.join(payload, "uid").select("doc_id", "text_hash", "item_id", "start", "length", F.col("shingles").alias("mine"), "its")
    leaks = checked.mapInArrow(_verify(p), "doc_id long, text_hash long, item_id long, start int, length int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "length")).alias("best")
    return leaks.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), F.col("best.similarity").alias("similarity"))
