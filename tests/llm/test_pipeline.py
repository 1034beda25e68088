"""Stages and the whole against plain Python, and queries against SQL, on the smallest tables."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from meterlake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_names():
    names = list(__spark_entry__.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    text = lambda rows, names: sorted(tuple(repr(round(x, 6) if isinstance(x, float) else x) for _, x in sorted(zip(names, r))) for r in rows)
    assert text(df.collect(), df.columns) == text(want.fetchall(), want.columns)


def test_stages_by_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    from .test_near_dedup import brute
    from .test_selection import shares

    read = lambda df: sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r["item_id"]: b" ".join(corpus_pipeline.find_leaks.__globals__["tokens"](r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    tokens = corpus_pipeline.find_leaks.__globals__["tokens"]
    poor = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert after.columns == docs.columns
        old, new = read(before), read(after) if name != "tokens" else None
        if name == "quality":
            assert set(new) <= set(old) and not {i for i, _, _ in new} & poor and len(new) > 0.6 * len(old)
        elif name == "near_dedup":
            groups = brute([(i, t) for i, t, _ in old], 5)
            assert [i for i, _, _ in new] == sorted({c for _, _, c in groups})
        elif name == "decontamination":
            clean = [x for x in old if not any(b" " + b + b" " in b" " + b" ".join(tokens(x[1])) + b" " for b in bench.values())]
            assert new == clean
        elif name == "mixing":
            size, target = shares(old)
            for s in size:
                words = [len(t.split()) for _, t, x in new if x == s]
                assert abs(sum(words) - target[s]) <= 2 * max((len(t.split()) for _, t, x in old if x == s), default=0) + 1
        else:
            tok, start = Tokenizer.from_file(queries.default_tokenizer()), 0
            got = sorted(map(tuple, after.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
            for (i, t, _), g in zip(old, got, strict=True):
                ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
                assert g == (start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                start += len(ids)
        before = after
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, before.collect()))


ROWS = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "null id text that is good", "en", "a", 1), (3, "copy of a text with enough words here", "en", "b", 1), (3, "copy of a text with enough words here", "en", "b", 1),
        (4, "copy of a text with enough words here", "en", None, 1), (5, "long " + " ".join(f"w{i}" for i in range(50_000)), "en", "a", 1)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_bear_odd_rows(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `doc` string, kept boolean, text_hash int")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "near_dedup" and rows:
            ids = sorted(str(r["doc_id"]) for r in out.collect())
            assert ids.count("3") == 1 and "4" not in ids and "1" in ids
        df = out
    assert rows or df.count() == 0


def test_nothing_but_the_entry_point_guards_imports():
    for f in ("corpus_pipeline.py", *(f"meterlake/llm/{x}" for x in os.listdir(os.path.dirname(queries.__file__)) if x.endswith(".py"))):
        text = open(os.path.join(os.path.dirname(__spark_entry__.__file__), f), encoding="utf-8").read()
        assert "ImportError" not in text and "ModuleNotFoundError" not in text


def test_op6_keeps_good_rows(spark):
    got = queries.QUERIES["op6_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert got.where(F.col("kept") != (F.col("quality") > 0)).count() == 0


def test_what_a_step_stored_goes_with_it(spark, tmp_path):
    import os

    from meterlake.llm.store import Workspace, passing, shared_dir

    outer = Workspace(spark, "outer")
    with passing():
        inner = Workspace(spark, "inner")
        kept = outer.save(inner.save(spark.range(5), "a"), "b")
        assert os.path.isdir(inner.root)
    assert not os.path.exists(inner.root) and kept.count() == 5 and outer.root.startswith(shared_dir(spark))
