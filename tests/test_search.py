"""The inverted index against scans of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import search_index as S

WORDS = ["the", "of", "Of", "cat", "concatenate", "cat_1", "naïve", "Größe", "日本語", "x9", "a", "%", "_", "it's", "a.b", "--", "\n", "don't"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["prompts", "assistant", "tools", "thinking"]), rng.choice([" ", " ", ", ", "-"]).join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for c in range(25) for t in range(8)]
    turns += [(90, 0, "prompts", None), (91, 0, "assistant", ""), (92, 0, "tools", "cat " * 5000)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, kind string, text string")
    titles = spark.createDataFrame([(c, 0, f"The cat of {c}") for c in range(0, 25, 3)], "conv_id long, turn long, title string")
    files = spark.createDataFrame([(c, c % 8, p) for c in range(25) for p in ("src/cat.py", f"docs/of_{c}.md", "src/cat.py")], "conv_id long, turn long, path string")
    items = S.searchable(t, titles, files).cache()
    path = str(tmp_path_factory.mktemp("index") / "i")
    S.build_index(items, path, buckets=16, most=40)
    return S.Index(spark, path, items, buckets=16)


def keys(df):
    return sorted(tuple(r) for r in df.select(*S.KEY).collect())


@pytest.mark.parametrize("kind", ["all", "prompts", "files", "title"])
def test_literals_equal_a_scan(index, kind):
    for q in ("cat", "CAT", "of the", "at of", "e, c", "a", "%", "_", "--", "it's a", "e\n", "ö", "本", ".b-", " the ", "cat_1 ", "src/c", "/", "nothing like it", "", "cat cat"):
        assert keys(index.literal(q, kind)) == keys(S.scan(index.items, q, kind)), q
    with pytest.raises(ValueError):
        index.literal("cat", "nosuch")


def test_words_and_phrases(index):
    import regex

    rows = [tuple(r) for r in index.items.collect()]
    split = lambda t: regex.findall(S.WORD, t.lower())
    for q in ("the cat", "a cat_1 of", "Größe", "absent the", "the the", "--"):
        want = split(q)
        assert keys(index.all_terms(q)) == sorted(r[:4] for r in rows if want and set(want) <= set(split(r[4])))
        runs = lambda t: any(t[i : i + len(want)] == want for i in range(len(t)))
        assert keys(index.phrase(q)) == sorted(r[:4] for r in rows if want and runs(split(r[4])))


def test_a_term_reads_its_folder_only(spark, index):
    """Of 16 folders one is read, and a very common term lies in several files of it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = index.of_term("cat").select("conv_id")
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = leaf.metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = [f for f in index.postings.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]]
    folder = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.of_term("cat").select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(folder) == 1 and 1 < read < len(files) and read == sum(f"bucket={next(iter(folder))}/" in f for f in files)


def test_by_conversation(index):
    got = {r["conv_id"]: r for r in S.by_conversation(index.literal("cat"), "cat").collect()}
    rows = [r for r in index.items.collect() if "cat" in r["text"].lower()]
    assert {c: (r["items"], r["hits"], r["anchor"], r["total"]) for c, r in got.items()} == {
        c: (len(m), sum(r["text"].lower().count("cat") for r in m), min(r["turn"] for r in m), len(got)) for c in got for m in [[r for r in rows if r["conv_id"] == c]]}
    assert len(got) == len({r["conv_id"] for r in rows}) and got[92]["snippet"].startswith("cat cat") and "cat" in got[3]["snippet"]


def test_no_items(spark, index, tmp_path):
    none = index.items.where("false")
    S.build_index(none, str(tmp_path / "e"))
    e = S.Index(spark, str(tmp_path / "e"), none)
    assert e.literal("cat").count() == e.phrase("the cat").count() == e.all_terms("cat").count() == 0 and S.by_conversation(e.literal("cat"), "cat").count() == 0
