import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import alignment as A

P = A.Alignment(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, block long, key long, told string, total int"


def brute(rows):
    """Both tokenizers on whole texts, tokens walked one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(P.byte_level), SentencePieceProcessor(model_file=P.pieces), A.byte_letters()
    a.encode_special_tokens = True

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for i, x in parts:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    found, counts = [], Counter()
    for i, t in rows:
        x = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        y = [(k, of_b(k)) for k in b.encode(t)] if t else []
        if not t or not b"".join(v for _, v in x) == b"".join(v for _, v in y) == (" " + t).encode():
            found.append((i, 0, 0, [], []))
            continue
        x, y = spans(x), spans(y)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, before = [], 0
        for c in cuts:
            groups.append(",".join(str(k) for k, s, e in x if before <= s and e <= c) + "|" + ",".join(str(k) for k, s, e in y if before <= s and e <= c))
            before = c
        links = [(k, m) for k, s, e in x for m, u, v in y if s < v and u < e]
        counts.update(links)
        found.append((i, len(x), len(y), groups, links))
    most = {}
    for (_, m), n in counts.items():
        most[m] = max(most.get(m, 0), n)
    return [(i, n, m, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for i, n, m, g, ls in found]


ODD = ["", " ", "  ", "a ", " a", "a  b   c", "\n", "a\n\n b\t c \n", "don't they'll 's x", "<|endoftext|> a <s> </s> <unk> <0x0A>", "a▁b", "▁", "ﬁ ① ａ é é", "日本語 テキスト、です。", "🙂🙃 x🙂y", "\x00a\x00 b", "\x1c a\x85 b\xa0c  d　e", "12345 6.78e9 $%^&*( ) --> <-- ", "Ünïcödé Straße İstanbul", "\r\n \r\n", "﻿bom", "x" * 5000, "ab" * 700 + " " + "日" * 300]
WORDS = ["the", "of", "tokenizer", "misaligned", "antidisestablishment", "Größe", "l'été", "naïve", "x=1;", "foo_bar", "http://a.b/c?d=e", "HTML", "...", "2024-01-02", "don't", "日本", "\n", "\t\t", "  "]


def test_alignment_equals_a_walk_over_whole_texts(spark):
    rng = random.Random(2)
    texts = [None, *ODD] + [rng.choice([" ", " ", "  ", "\n"]).join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "one two"), (3, "one two"), (3, "one two")]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], SCHEMA)
    want = sorted(brute(rows), key=str)
    assert sum(r[1] > 0 for r in want) > 160
    for p in (P, A.Alignment(P.byte_level, P.pieces, block_links=90, known=50)):
        got = A.align(df, p).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_alignment_of_nothing(spark):
    assert A.align(spark.createDataFrame([], SCHEMA), P).count() == 0
    got = A.align(spark.createDataFrame([(1, None, 0, 0, "", 0), (2, "", 0, 0, "", 0)], SCHEMA), P).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


WORKER = A.Aligner(P)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sT1.é日🙂"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_units_give_the_tokens_of_whole_texts(t):
    """Cutting at spaces changes no token of either tokenizer."""
    parts = WORKER.cut(t)
    assert "".join(parts) == " " + t
    assert [i for u in parts for i in WORKER.a.encode(u, add_special_tokens=False).ids] == WORKER.a.encode(" " + t, add_special_tokens=False).ids
    if t and A.MARK not in t:
        assert [i for u in parts for i in (WORKER.b.encode(u[1:]) if u != " " else [WORKER.space])] == WORKER.b.encode(t)


def test_tokens_of_real_texts_cut_alike():
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.is_file():
        return
    import pyarrow.parquet as pq

    for t in filter(None, pq.read_table(path).column("text").to_pylist()):
        parts = WORKER.cut(t)
        assert [i for u in parts for i in WORKER.b.encode(u[1:])] == WORKER.b.encode(t) and [i for u in parts for i in WORKER.a.encode(u, add_special_tokens=False).ids] == WORKER.a.encode(" " + t, add_special_tokens=False).ids


def test_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000):
        x, y = (np.flatnonzero(rng.random(n) < 0.3) for _ in range(2))
        a, b = A.Bits(n, x), A.Bits(n, y)
        assert (a & b).select().tolist() == sorted({*x.tolist()} & {*y.tolist()}) and (a | b).select().tolist() == sorted({*x.tolist()} | {*y.tolist()})
        assert a.rank(np.arange(n + 1)).tolist() == [int((x < i).sum()) for i in range(n + 1)]
