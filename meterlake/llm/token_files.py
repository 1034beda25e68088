"""Token ids of a corpus in files of frequency-ranked, byte-aligned, variable-length codes."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

MAGIC = b"FRVB"
HEADER = struct.Struct("<4sIQIQ")
#: Bytes of the code of a rank, by its two control bits; four ids share a control byte.
CODE_LENGTHS = np.array([[1 + (c >> 2 * j & 3) for j in range(4)] for c in range(256)], np.uint8)

#: Ids below this are counted in an array of that many places.
DENSE = 1 << 22


@dataclass(frozen=True)
class TokenFiles:
    """``tokenizer``: path of a tokenizers JSON file. ``end_id`` closes each document. ``file_ids``: ids after which a file ends
    with the document that it is in. ``known``: pieces that a Python worker keeps, at about 150 bytes each; fewer take longer."""

    tokenizer: str
    end_id: int = 2
    file_ids: int = 2_000_000
    known: int = 900_000


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(ids by descending frequency, control bytes, code bytes). Ties in frequency go to the smaller id."""
    if len(ids) and int(ids.max()) < DENSE:
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        place, counts = ids, counts[known]
        rank = np.empty(int(ids.max()) + 1, np.uint32)
    else:
        known, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.uint32)
    order = np.lexsort((known, -counts))
    rank[known[order] if place is ids else order] = np.arange(len(known), dtype=np.uint32)
    ranks = rank[place]
    most = 1 + (len(known) > 1 << 8) + (len(known) > 1 << 16) + (len(known) > 1 << 24)
    size = np.ones(len(ids), np.uint8)
    for j in range(1, most):
        size += ranks >= 1 << 8 * j
    bits = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    bits[: len(ids)] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    codes, start = np.zeros(int(ends[-1]) if len(ids) else 0, np.uint8), ends - size
    codes[start] = ranks
    for j in range(1, most):
        longer = np.flatnonzero(size > j)
        codes[start[longer] + j] = ranks[longer] >> 8 * j
    return known[order].astype("<u4"), control, codes.tobytes()


def decode_ids(table: np.ndarray, control: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """The ids again: code lengths by table lookup of the control bytes, then one gather per code byte."""
    size = CODE_LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate([codes, np.zeros(4, np.uint8)])
    ranks = padded[start].astype(np.uint32)
    for j in range(1, 4):
        longer = np.flatnonzero(size > j)
        if len(longer):
            ranks[longer] |= padded[start[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return table[ranks]


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """One file: header (magic, documents, ids, ranked ids, ids before it in its part), ranked ids, document ids with their
    null flags and lengths, control bytes, code bytes. All numbers are little-endian."""
    table, control, codes = encode_ids(ids)
    present = np.array([i is not None for i in doc_ids], np.uint8)
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), len(ids), len(table), before), table.tobytes(), present.tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(), control.tobytes(), codes])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(document ids, lengths, ids, ids before it in its part)."""
    magic, docs, n, ranked, before = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, dtype, count, at)
        at += x.nbytes
        return x

    table, present, doc_ids, lengths, control = take("<u4", ranked), take("u1", docs), take("<i8", docs), take("<u4", docs), take("u1", -(-n // 4))
    return [int(i) if p else None for i, p in zip(doc_ids, present)], lengths, decode_ids(table, control, np.frombuffer(data, np.uint8, offset=at), n), before


class Pieces(dict):
    """piece -> its number; numbers new ones in order."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """The tokenizer, with the ids of pieces met before.

    A byte-level BPE tokenizer cuts a text in pieces by a fixed pattern and encodes each alone, so each distinct piece need be
    encoded once. New pieces are encoded together, a line feed between any two, which is a piece and an id of its own. The
    pattern is applied here only to texts of characters on whose classes all implementations agree (ASCII and Latin
    letters); other texts go to the tokenizer whole, as do texts that hold an added token such as <|endoftext|>, which has an
    id of its own, and all texts of a tokenizer of another kind. Beyond ``limit`` pieces
    those go that were met once.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
    #: Fixed value: the pattern by which byte-level BPE of this family cuts texts, for these letters.
    CUT = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
    OTHER = re.compile(f"[^\t\n\r -~{LETTERS}]")

    def __init__(self, path: str, end_id: int, limit: int = 900_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # no piece: the tokenizer takes these out of a text before it cuts
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and (spec.get("model") or {}).get("type") == "BPE"
        self.feed = self._encode("\n")
        self.cuts = self.cuts and len(self.feed) == 1 and not any("\n" in x for x in added)
        self.pieces = Pieces()
        self.pieces[""] = 0  # stands for the end of a text; no text has an empty piece
        # the ids of all pieces in one array, and where each piece's are
        self.flat, self.n_flat = np.array([end_id], np.uint32), 1
        self.starts, self.sizes, self.n = np.zeros(1, np.int64), np.ones(1, np.int64), 1
        self.uses = np.ones(1, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of further pieces; arrays grow to twice their length when they are full."""
        def put(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
            if n + len(new) > len(held):
                held = np.concatenate([held[:n], np.empty(n + 2 * len(new), held.dtype)])
            held[n : n + len(new)] = new
            return held

        self.starts = put(self.starts, self.n, starts + self.n_flat)
        self.sizes = put(self.sizes, self.n, sizes)
        self.flat = put(self.flat, self.n_flat, ids)
        self.n, self.n_flat = self.n + len(starts), self.n_flat + len(ids)

    def _forget(self) -> None:
        """Keeps the pieces met more than once, half of the limit at most, and lets them start anew."""
        least = max(1, int(np.partition(self.uses, -(self.limit // 2))[-(self.limit // 2)]))
        kept = np.flatnonzero(self.uses > least)
        kept = np.concatenate([[0], kept[kept > 0]])
        names = list(self.pieces)
        self.pieces = Pieces()
        for i in kept.tolist():
            self.pieces[names[i]]  # noqa: B018  numbers it
        self.pieces.new = []
        sizes, starts = self.sizes[kept], self.starts[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
        self.sizes, self.starts, self.uses = sizes, ends - sizes, np.ones(len(kept), np.int64)
        self.n, self.n_flat = len(kept), len(self.flat)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces of white space are encoded one by one, all others as lines of one text; line feeds stay in the array of ids."""
        spaces = [i for i, x in enumerate(pieces) if x.isspace()]
        plain = [i for i, x in enumerate(pieces) if not x.isspace()]
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        ids = self._encode("\n".join([pieces[i] for i in plain])) if plain else np.empty(0, np.uint32)
        feeds = np.flatnonzero(ids == self.feed[0])
        if plain:
            if len(feeds) != len(plain) - 1:
                raise ValueError("the tokenizer does not keep lines apart")
            starts[plain] = np.concatenate([[0], feeds + 1])
            sizes[plain] = np.append(feeds, len(ids)) - starts[plain]
        alone = [self._encode(pieces[i]) for i in spaces]
        sizes[spaces] = [len(x) for x in alone]
        starts[spaces] = len(ids) + np.cumsum(sizes[spaces]) - sizes[spaces]
        self._add(np.concatenate([ids, *alone]), starts, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of ids of each)."""
        numbers, whole = [], []
        for t in texts:
            if self.cuts and not self.OTHER.search(t) and not self.added.search(t):
                cut = self.CUT.findall(t)
                n = np.fromiter(map(self.pieces.__getitem__, cut), np.int64, len(cut))
            else:
                n = np.array([-1 - len(whole)])
                whole.append(self._encode(t))
            numbers += [n, _END]
        if self.pieces.new:
            self._learn(self.pieces.new)
        pieces, pieces_flat = self.n, self.n_flat
        for x in whole:
            self._add(x, np.zeros(1, np.int64), np.array([len(x)]))
        number = np.concatenate(numbers)
        if whole:
            number = np.where(number < 0, pieces - 1 - number, number)
        taken = self.sizes[number]
        ends = np.cumsum(taken)
        ids = self.flat[np.repeat(self.starts[number] - ends + taken, taken) + np.arange(ends[-1])]
        lengths = np.array([len(n) for n in numbers]).reshape(-1, 2).sum(axis=1)
        per_text = np.add.reduceat(taken, np.cumsum(lengths) - lengths)
        self.n, self.n_flat, self.pieces.new = pieces, pieces_flat, []
        uses = np.bincount(number, minlength=pieces)[:pieces]
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        if pieces > self.limit:
            self._forget()
        return ids, per_text


_END = np.zeros(1, np.int64)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int, known: int) -> Encoder:
    """A Python worker keeps its encoder, and the pieces that it knows, from task to task."""
    return Encoder(path, end_id, known)


def _slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 19) -> Iterator[tuple[list[int | None], list[str]]]:
    """Documents in runs of about ``chars`` characters."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            n += len(t)
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(docs: DataFrame, p: TokenFiles, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` in ascending id order and writes files: (part, seq, payload), in order of part and seq.

    Each task writes the files of one range of ids, the ids ranked by their frequency in the file, so that
    a file is read by itself and no count of the corpus has to come first. Files are stored as rows of a Parquet table,
    which any store that Spark reaches can hold. A null id comes first; rows of one id are ordered by a hash of their text; a null text
    is an empty one and makes a document of its end id alone.
    """
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, total = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            payload = pack_file(doc_ids, np.concatenate(lengths), np.concatenate(held), before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([payload], pa.binary())], schema=schema)

        for ids_in, texts in _slices(batches):
            ids, per_text = encoder(p.tokenizer, p.end_id, p.known).encode(texts)
            doc_ids += ids_in
            lengths.append(per_text)
            held.append(ids)
            total += len(ids)
            if total >= p.file_ids:
                yield file()
                seq, before, total = seq + 1, before + total, 0
                doc_ids, lengths, held = [], [], []
        if doc_ids:
            yield file()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    # by id and then by text, so that rows of one id don't all fall in one range
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ws.save(ordered.mapInArrow(run, "part long, seq long, payload binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in ``files``: the ids of all documents before it, its own, and the
    CRC of its ids as little-endian unsigned 32-bit numbers."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, payload in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids, lengths, ids, before = unpack_file(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw, starts = ids.astype("<u4").tobytes(), ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(before + starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    rows = files.select("part", "payload").mapInArrow(run, "part long, doc_id long, within long, n_tokens long, ids_crc32 long")
    # the number of ids stands in a file's header; parts are as many as shuffle partitions
    sizes = files.select("part", _little_endian("payload", 9).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.select("part", offset.alias("offset"))), "part").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _little_endian(column: str, at: int):
    """Seven bytes from ``at`` (from 1) of a binary column, as a whole number."""
    return sum(F.conv(F.hex(F.substring(column, at + j, 1)), 16, 10).cast("long") * (1 << 8 * j) for j in range(7))


def token_index(docs: DataFrame, p: TokenFiles) -> DataFrame:
    """Writes ``docs`` to token files and reads them back; see ``write_token_files`` and ``read_token_files``.
    An empty table makes no files and no rows."""
    return read_token_files(write_token_files(docs, p, Workspace(docs.sparkSession, "tokens")))
