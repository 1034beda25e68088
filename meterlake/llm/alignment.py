"""Alignment of two tokenizers' tokens over a corpus: packed bitsets of token ends, shared cuts, links between overlapping tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Fixed value: the character by which piece tokenizers write a space.
MARK = "▁"


@dataclass(frozen=True)
class Alignment:
    """``byte_level``: path of a tokenizers JSON file of a byte-level BPE (A); ``pieces``: path of a sentencepiece model with byte fallback (B).
    ``block_links``: links after which a block ends with the few documents that it is in; ``known``, ``known_chars``: units that a Python worker
    keeps, at about 500 bytes each, and their bytes."""

    byte_level: str
    pieces: str
    block_links: int = 500_000
    known: int = 150_000
    known_chars: int = 1 << 26


# bitsets

class Bits:
    """Marks at byte places, packed in 64-bit words, with the number of marks before each word."""

    def __init__(self, n: int, places: np.ndarray | None = None, words: np.ndarray | None = None):
        self.n = n
        if words is None:
            marks = np.zeros(-(-n // 64) * 64, np.uint8)
            marks[places] = 1
            words = np.packbits(marks, bitorder="little").view("<u8")
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.n, words=self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.n, words=self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        partial = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1)) if len(self.words) else np.zeros(len(at), np.uint64)
        return self.before[word] + np.bitwise_count(partial).astype(np.int64)

    def select(self) -> np.ndarray:
        """The places of all marks, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE writes bytes: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Units encoded as one text.
RUN = 1000


class Units(dict):
    """unit -> its number; numbers new ones in order."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Aligner:
    """Aligns texts unit by unit.

    A space that follows a character other than white space starts a token in both tokenizers: the byte-level one cuts there by
    its pattern, and the piece one has no piece with its mark inside after another character (looked up in its vocabulary). So a text with its
    leading space is cut there into units, each is encoded once a worker, and a text's tokens are those of its units in order. Where the
    vocabulary or the tokenizer's kind does not allow that, a text is one unit.
    """

    CUT = re.compile(r"(?<=\S) ")

    def __init__(self, p: Alignment):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.limit, self.most_chars = p.known, p.known_chars
        self.a = Tokenizer.from_file(p.byte_level)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=p.pieces)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # what a digest has of a token of A inside a group and at its end, and of one of B
        self.written = [f"{i}{end}" for ids, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(ids))]
        self.written_size = np.array([len(x) for x in self.written], np.int64)
        with open(p.byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        by_pattern = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and all(t["special"] for t in spec.get("added_tokens", []))
        self.cuts = by_pattern and not any(re.search(f"[^{MARK}]{MARK}", t) for i, t in enumerate(pieces) if not self.b.is_control(i))
        self.space = self.b.piece_to_id(MARK)
        self._clear()

    def full(self) -> bool:
        return len(self.units) > self.limit or self.chars > self.most_chars

    def _clear(self) -> None:
        self.units, self.chars = Units(), 0
        #: per unit: tokens of both, groups, links; digest text; and its links in one array
        self.counts = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.digests: list[str] = []
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """Units of a text, each with its leading space."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        parts = self.CUT.split(whole)
        return [parts[0], *(" " + x for x in parts[1:])]

    def _encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of A, ids of B, bytes of each unit, whether it is spelt), once for units that can be encoded as one text and turn out to be, else once a unit."""
        text = "".join(units)
        raw = text.encode("utf-8", "surrogatepass")
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        # it adds the space, but not to nothing
        b = np.array(self.b.encode(text[1:], num_threads=1) if text != " " else [self.space], np.int64)
        spelt = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        size = np.array([len(u) for u in units] if len(raw) == len(text) else [len(u.encode("utf-8", "surrogatepass")) for u in units], np.int64)
        if len(units) == 1:
            return [(a, b, size, np.ones(1, bool))] if spelt else [(a[:0], b[:0], size * 0, np.zeros(1, bool))]
        ends = np.cumsum(size)
        if spelt and np.isin(ends, np.cumsum(self.a_size[a])).all() and np.isin(ends, np.cumsum(self.b_size[b])).all():
            return [(a, b, size, np.ones(len(units), bool))]
        return [x for u in units for x in self._encode([u])]

    def learn(self) -> None:
        """Aligns the new units, all at once: their bytes lie end to end, and so do the marks of both tokenizers."""
        new, self.units.new = self.units.new, []
        if not new:
            return
        parts, run = [], []
        for u in new:
            if not self.cuts or u[-1].isspace():  # white space before the next unit's could be one token with it
                if run:
                    parts += self._encode(run)
                parts += self._encode([u])
                run = []
            else:
                run.append(u)
                if len(run) == RUN:
                    parts += self._encode(run)
                    run = []
        if run:
            parts += self._encode(run)
        ids_a, ids_b, size, good = (np.concatenate(x) for x in zip(*parts))
        self.chars += int(size.sum())
        ends = np.cumsum(size)
        total = int(ends[-1])
        at_a, at_b = np.cumsum(self.a_size[ids_a]) - 1, np.cumsum(self.b_size[ids_b]) - 1
        in_a, in_b = Bits(total, at_a), Bits(total, at_b)
        shared, any_end = in_a & in_b, in_a | in_b
        # a stretch between two ends lies in one token of each: that is a link
        links = any_end.select()
        keys = ids_a[in_a.rank(links)] << 32 | ids_b[in_b.rank(links)] if len(links) else np.zeros(0, np.int64)
        # tokens up to each shared cut, and the group of each token
        cuts = shared.select()
        upto_a, upto_b = np.append(in_a.rank(cuts + 1), 0), np.append(in_b.rank(cuts + 1), 0)
        group_a, group_b = shared.rank(at_a), shared.rank(at_b)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        # groups one after the other, in each the tokens of A and then those of B
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + upto_b[group_a - 1]] = ids_a + n_a * last_a
        order[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * n_a + ids_b + n_b * last_b
        digest = "".join(map(self.written.__getitem__, order.tolist()))
        upto = np.stack([in_a.rank(ends), in_b.rank(ends), shared.rank(ends), any_end.rank(ends)], axis=1)
        chars = np.concatenate([[0], np.cumsum(self.written_size[order])])[upto[:, 0] + upto[:, 1]].tolist()
        self.digests += [digest[s:e] for s, e in zip([0, *chars], chars)]
        self.counts = np.concatenate([self.counts, np.diff(upto, axis=0, prepend=0)])
        self.good = np.concatenate([self.good, good])
        self.starts = np.concatenate([self.starts, self.starts[-1] + upto[:, 3]])
        self.links = np.concatenate([self.links, keys])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(per text: tokens of A, of B, groups, links), digests, and the links of all texts as A id << 32 | B id; a text without tokens has none."""
        if self.full():
            self._clear()
        numbers = []
        for t in texts:
            units = self.cut(t) if t and MARK not in t else []
            numbers.append(np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)))
        self.learn()
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        for i, n in enumerate(numbers):
            if len(n) and self.good[n].all():
                counts[i] = self.counts[n].sum(axis=0)
                digests[i] = hashlib.sha256("".join(map(self.digests.__getitem__, n.tolist()))[:-1].encode()).hexdigest()
            else:
                numbers[i] = n[:0]
        n = np.concatenate(numbers)
        size = self.counts[n, 3]
        ends = np.cumsum(size)
        return counts, digests, self.links[np.repeat(self.starts[n] - ends + size, size) + np.arange(size.sum())]


@lru_cache(maxsize=1)
def aligner(p: Alignment) -> Aligner:
    """A Python worker keeps its tokenizers, and the units that it knows, from task to task."""
    return Aligner(p)


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([("doc_ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("digests", pa.list_(pa.string())), ("links", pa.binary()), ("keys", _LONGS), ("uses", _LONGS)])
_BLOCK_DDL = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, links binary, keys array<long>, uses array<long>"


def _narrow(keys: int) -> str:
    """The type in which links are written, as places among so many keys."""
    return "<u2" if keys <= 1 << 16 else "<u4"


def _blocks(p: Alignment):
    """Documents -> blocks: per document its counts and digest; all their links, one document after the other, as places in ``keys``; and how many
    links of the block each key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(p)
        held: list[tuple] = []
        n = 0

        def block() -> pa.RecordBatch:
            ids, counts, digests, links = zip(*held)
            keys, places, uses = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            cells = [[i for x in ids for i in x], *np.concatenate(counts).T, [d for x in digests for d in x], places.astype(_narrow(len(keys))).tobytes(), keys, uses]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _BLOCK)], schema=_BLOCK)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < len(ids):
                # a few documents at a time, by their length
                to, chars = at, 0
                while to < len(ids) and chars < 1 << 18:
                    chars += len(texts[to].as_buffer()) if texts[to].is_valid else 0
                    to += 1
                counts, digests, links = worker.align([t.as_py() for t in texts[at:to]])
                held.append((ids[at:to], counts, digests, links))
                n, at = n + len(links), to
                if n >= p.block_links:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus counts of their keys -> a row a document."""
    for b in batches:
        for i in range(b.num_rows):
            of = {n: b.column(n)[i].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "told")}
            told, n_links = of["told"], of["n_links"].to_numpy()
            upto = np.zeros((1, 2), np.int64)
            if told is not None and len(told):
                order = np.argsort(told.field("at").to_numpy())
                links = np.frombuffer(b.column("links")[i].as_buffer(), _narrow(len(told)))
                worth = np.column_stack([told.field("best").to_numpy(zero_copy_only=False), told.field("total").to_numpy()]).astype(np.int64)[order]
                upto = np.concatenate([upto, np.cumsum(worth[links], axis=0)])
            ends = np.cumsum(n_links)
            per_doc = upto[ends] - upto[ends - n_links]
            yield pa.RecordBatch.from_arrays([of["doc_ids"], of["n_a"], of["n_b"], of["n_groups"], of["n_links"], *(pa.array(c) for c in per_doc.T), of["digests"]], schema=_OUT)


def align(docs: DataFrame, p: Alignment, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how the tokens of two tokenizers lie over each text.

    Token ends are marked in packed bitsets over the bytes; their AND gives the cuts that both share, popcounts before a place say which tokens
    lie between two cuts, and every stretch between two marks of the OR is a link of one token each. Links are counted by
    id pair over the corpus: blocks of documents hold each of their pairs once, so a pair that every text has is one row a block
    on either side of the shuffle, and the counts go back to a block's pairs the same way. Blocks are stored, so that texts are encoded once.
    An id pair's count is all its links; a link is best if no other pair of its B id has a higher count.

    A null or empty text has no tokens, nor has one whose tokens do not spell the text with its leading space (one that holds the piece
    tokenizer's mark, for instance): zeros and an empty digest. Repeated rows and ids return a row each and count each. Empty tables give no rows.
    """
    ws = Workspace(docs.sparkSession, "alignment")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = ws.save(source.mapInArrow(_blocks(p), _BLOCK_DDL).withColumn("block", F.monotonically_increasing_id()), "blocks")
    pairs = blocks.select(F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("uses").alias("uses"))).alias("r")).select("r.*")
    counts = pairs.groupBy("key").agg(F.sum("uses").alias("total")).withColumn("b", F.expr("key & 4294967295L"))
    counts = ws.save(counts, "counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    judged = counts.join(most, "b").select("key", "total", (F.col("total") == F.col("most")).alias("best"))
    places = blocks.select("block", F.posexplode("keys").alias("at", "key"))
    told = places.join(judged, "key").groupBy("block").agg(F.collect_list(F.struct("at", "total", "best")).alias("told"))
    whole = blocks.drop("keys", "uses").join(told, "block", "left")
    return whole.mapInArrow(_rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
