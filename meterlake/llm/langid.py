"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_batches

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)
#: Characters of one text looked at at a time; a longer text comes in spans.
SPAN = 1 << 16


@dataclass(frozen=True)
class LangId:
    """``per_lang``: about how many labelled documents of a language the model is fitted on. ``most_langs``: how many languages,
    those with most documents, it tells apart; None is all of them. ``most_bytes``: of the log-probability matrix, which every task gets;
    languages that need more are an error and never left out. ``cells``: n-grams times languages scored at a time."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    alpha: float = 0.05
    per_lang: int = 4000
    most_langs: int | None = None
    most_bytes: int = 512 << 20
    unknown: str = "und"
    cells: int = 1 << 21


def _spans(texts: Iterable[str], p: LangId, chars: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Code points of lower-cased texts, in spans that share what an n-gram needs, about ``chars`` at a time: (text numbers, spans)."""
    rows, spans, n = [], [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), SPAN):
            rows.append(i)
            spans.append(codes[at : at + SPAN + max(p.orders) - 1])
            n += len(spans[-1])
            if n >= chars:
                yield rows, spans
                rows, spans, n = [], [], 0
    if rows:
        yield rows, spans


def grams(texts: Iterable[str], p: LangId, chars: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of texts by buckets, in parts, one for each order: (text numbers, where each one's entries begin, buckets). Every
    n-gram of the lower-cased texts is one entry; one text can be in several parts, and in one part several times."""
    for rows, spans in _spans(texts, p, chars):
        sizes = np.array([len(x) for x in spans])
        codes = np.concatenate(spans).astype(np.uint64)
        span = np.repeat(np.arange(len(spans)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for n in p.orders:
            count = len(codes) - n + 1
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : j + count]) * _MULTIPLIERS[j]
                h ^= h >> np.uint64(15)
            inside = (span[:count] == span[n - 1 :]) & (place[:count] < SPAN)
            of = span[:count][inside]
            if len(of):
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                yield np.array(rows)[of[starts]], starts, (h[inside] % np.uint64(p.buckets)).astype(np.int64)


def _counts(p: LangId):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for rows, starts, found in grams((t.as_py() for t in b.column(1)), p):
                for row, part in zip(rows, np.split(found, starts[1:])):
                    at = totals.setdefault(langs[row], np.zeros(p.buckets, np.int64))
                    at += np.bincount(part, minlength=p.buckets)
        for lang, at in totals.items():
            full = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full, pa.int32()), pa.array(at[full])], schema=schema)

    return run


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_probs: np.ndarray  # buckets x langs
    priors: np.ndarray


def fit(docs: DataFrame, p: LangId = LangId()) -> Model:
    """``docs`` (doc_id, text, lang). Rows with a null or empty text or null lang teach nothing.

    Of a language with more than ``per_lang`` rows, those with the smallest hashes of their id are used, so one whose rows all share an id
    is learned from all of them or, if there are more than that, perhaps from none: then only its share of the rows speaks for it, and every n-gram alike. A column of more
    values than ``most_bytes`` has room for, 256 KB each, raises an error unless ``most_langs`` says how many of the commonest to learn. What reaches the driver is one count per language
    and bucket.
    """
    rows = docs.select("doc_id", "text", "lang").where("text is not null and text <> '' and lang is not null")
    room = p.most_bytes // (8 * p.buckets)
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(room + 1 if p.most_langs is None else p.most_langs).collect()
    if len(found) > room:
        raise ValueError(f"more languages than {p.most_bytes} bytes hold; set most_langs or most_bytes")
    sizes = {r["lang"]: r["n"] for r in found}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((p.buckets, 0)), np.zeros(0))
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, p.per_lang / n) * (1 << 20))) for k, n in sizes.items()], "lang string, below long")
    taken = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("below"))
    found = taken.select("lang", "text").mapInArrow(_counts(p), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((p.buckets, len(langs)), p.alpha)
    place = {k: i for i, k in enumerate(langs)}
    counts[found["bucket"].to_numpy(int), [place[x] for x in found["lang"]]] += found["n"].to_numpy(float)
    priors = np.log([sizes[k] for k in langs]) - np.log(sum(sizes.values()))
    return Model(langs, np.log(counts / counts.sum(axis=0)), priors)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def classify(texts: list[str | None], model: Model, p: LangId) -> tuple[list[str], np.ndarray]:
    """Languages and posterior probabilities of a batch: its sparse matrix of n-grams times the log-probability matrix. Ties go to
    the first language by name."""
    names, scores = [p.unknown] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    if not known:
        return names, scores
    totals = np.tile(model.priors, (len(known), 1))
    for rows, starts, found in grams((texts[i] for i in known), p, max(1024, p.cells // (len(p.orders) * len(model.langs)))):
        np.add.at(totals, rows, np.add.reduceat(model.log_probs[found], starts, axis=0))
    odds = np.exp(totals - totals.max(axis=1, keepdims=True))
    best = totals.argmax(axis=1)
    scores[known] = odds[np.arange(len(known)), best] / odds.sum(axis=1)
    for i, k in zip(known, best):
        names[i] = model.langs[k]
    return names, scores


def predict(docs: DataFrame, model: Model, p: LangId = LangId(), keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) for every row of ``docs``; ``keep`` are boolean columns.

    ``und`` with score 0 where the text is null, empty or without a letter, or where nothing was learned.
    The score is the posterior probability of the language, which nears 1 as a text gets longer. Whole texts are read, in spans.
    """
    text_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", *keep)
    names = source.columns[2:]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus
    schema = pa.schema([("doc_id", pa.int64()), *[(k, pa.bool_()) for k in names], ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = classify(b.column(1).to_pylist(), shared.value, p)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(langs, pa.string()), pa.array(scores)], schema=schema)

    return source.mapInArrow(run, ", ".join(["doc_id long", *[f"`{k}` boolean" for k in names], "lang_pred string", "score double"]))


def held_out_predictions(docs: DataFrame, p: LangId = LangId()) -> DataFrame:
    """Learns from rows whose crc32 of the id, as text, leaves 0 or 2 modulo 3; predicts every row.

    A null id has no remainder: such a row teaches nothing and counts as not held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return predict(docs, fit(docs.where(part != 1), p), p, (F.coalesce(part == 1, F.lit(False)).alias("held_out"),))
