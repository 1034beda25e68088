"""A training corpus in five stages, each by one of the operators of meterlake.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns a DataFrame, which ``run``
writes as Parquet and reads again. All stages but the last return the columns of ``docs``, whatever further columns these
have. Rows with null ids or texts, empty and very long texts, repeated rows and empty tables go through every stage; the
docstrings say what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.decontamination import find_leaks
from meterlake.llm.mixing import mix
from meterlake.llm.near_dedup import NearDedup, near_duplicates
from meterlake.llm.quality import Quality, fit, grade, ratings_of
from meterlake.llm.queries import default_tokenizer, table
from meterlake.llm.store import Workspace, passing
from meterlake.llm.token_files import TokenFiles, token_index


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no name of theirs clashes with an operator's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of a good grade is under one half. A null, empty or wordless text has no evidence and
    is judged by the share of good ratings; with no ratings at all everything stays. Repeated rows fare alike."""
    p = Quality()
    model = fit(docs, ratings_of(table(spark, sf_dir, "labels")), p)
    return grade(_packed(docs), model, p, ("doc",)).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; 0.8 on five-word shingles. Wordless texts
    are in no group and stay. Rows of one id and text are one document and collapse."""
    found = near_duplicates(docs, NearDedup(), detail=True).where("kept")
    one = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    stay = one.unionByName(found.where("root is null").select("doc_id", "text_hash")).distinct()
    rows = _packed(docs).withColumn("text_hash", F.xxhash64("text"))
    same = rows.doc_id.eqNullSafe(stay.doc_id) & (rows.text_hash == stay.text_hash)
    kept = rows.join(stay, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item. Null and empty texts stay; repeated rows fare alike."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    rows = _packed(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.join(leaks, rows.doc_id.eqNullSafe(leaks.doc_id) & (rows.text_hash == leaks.text_hash), "left_anti").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as their source's target asks, some repeatedly; null and wordless texts have no size and are not taken."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix to token files and returns what they hold of each document; a repeated document is written repeatedly.
    Workers that have served the other stages keep fewer pieces in memory."""
    return token_index(docs, TokenFiles(default_tokenizer(), file_ids=1_000_000, known=200_000))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no expression for the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; what the stage itself stored goes then, and so does its input."""
    ws = Workspace(spark, "pipeline")
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with passing():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
