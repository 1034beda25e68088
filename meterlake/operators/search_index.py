"""An inverted index over conversations, and searches that join its postings."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import occurrences

#: What a word is: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: An item is one searchable text: a turn's prose, a tool's input, a thought, a title, a path.
KEY = ["kind", "conv_id", "turn", "item"]
KINDS = ("prompts", "assistant", "tools", "thinking", "title", "files")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def searchable(turns: DataFrame, titles: DataFrame, files: DataFrame) -> DataFrame:
    """Items of all kinds: ``turns`` (conv_id, turn, kind, text), ``titles`` (conv_id, turn, title), anchored to a conversation's first turn, and
    ``files`` (conv_id, turn, path), each path of a turn an item."""
    of = lambda df, kind, text, item: df.select(kind.alias("kind"), "conv_id", "turn", item.cast("int").alias("item"), F.col(text).alias("text"))
    paths = files.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("path")).alias("paths")).select("conv_id", "turn", F.posexplode("paths").alias("item", "path"))
    return of(turns, F.col("kind"), "text", F.lit(0)).unionByName(of(titles, F.lit("title"), "title", F.lit(0))).unionByName(of(paths, F.lit("files"), "path", F.col("item"))).where("text is not null")


TERMS = "term string, bucket int, n long"


def _key_ddl(items: DataFrame) -> str:
    return ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in KEY)


def build_index(items: DataFrame, path: str, buckets: int = 64, most: int = 1_000_000) -> None:
    """Writes the index of ``items`` (*KEY, text; a key names one item): postings (term, *KEY, positions), in one folder a ``bucket`` of terms and
    sorted by term, and the terms with how many items each is in.

    A term in more than ``most`` items is split over several files, so that no task writes, and none has to read, a very
    common term alone."""
    placed = items.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    held = placed.groupBy("term", *KEY).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    held.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int")).write.parquet(f"{path}/unsorted")
    spark = items.sparkSession
    raw = spark.read.schema(f"term string, {_key_ddl(items)}, positions array<int>, bucket int").parquet(f"{path}/unsorted")
    terms = raw.groupBy("term", "bucket").agg(F.count("*").alias("n"))
    terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    long = spark.read.schema(TERMS).parquet(f"{path}/terms").where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).alias("_parts"))
    dealt = raw.join(long, "term", "left").withColumn("_part", F.pmod(F.xxhash64("conv_id"), F.coalesce("_parts", F.lit(1))))
    dealt.repartition("bucket", "_part").sortWithinPartitions("bucket", "term").drop("_parts", "_part").write.option("maxRecordsPerFile", most).partitionBy("bucket").parquet(f"{path}/postings")


class Index:
    """A written index, and the items that it is of, which hits are verified on and cut from."""

    def __init__(self, spark: SparkSession, path: str, items: DataFrame, buckets: int = 64):
        self.spark, self.items, self.buckets = spark, items, buckets
        self.postings = spark.read.schema(f"term string, {_key_ddl(items)}, positions array<int>, bucket int").parquet(f"{path}/postings")
        self.terms = spark.read.schema(TERMS).parquet(f"{path}/terms")

    def of_kind(self, rows: DataFrame, kind: str) -> DataFrame:
        if kind == "all":
            return rows
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return rows.where(F.col("kind") == kind)

    def of_term(self, term: str) -> DataFrame:
        """Postings of one term: one folder is read, and in it the row groups that may hold the term."""
        bucket = zlib.crc32(term.encode()) % self.buckets
        return self.postings.where((F.col("bucket") == bucket) & (F.col("term") == term))

    def _like(self, condition: Column) -> DataFrame:
        """Postings of all terms of a condition, met on their folder first."""
        return self.postings.join(self.terms.where(condition).select("bucket", "term"), ["bucket", "term"])

    def query_words(self, query: str) -> list[str]:
        return self.spark.range(1).select(words(F.lit(query))).first()[0]

    def all_terms(self, query: str, kind: str = "all") -> DataFrame:
        """Items (*KEY, text) that hold every word of a query, anywhere: a join of the postings of each, the rarest term first."""
        terms = sorted(set(self.query_words(query)))
        if not terms:
            return self.items.where(F.lit(False))
        seen = {r["term"]: r["n"] for r in self.terms.where(F.col("term").isin(terms)).collect()}
        sides = [self.of_kind(self.of_term(t), kind).select(*KEY) for t in sorted(terms, key=lambda t: (seen.get(t, 0), t))]
        return self.items.join(reduce(lambda a, b: a.join(b, KEY), sides), KEY, "left_semi")

    def phrase(self, query: str, kind: str = "all") -> DataFrame:
        """Items that hold the words of a query one after the other, whatever lies between them: postings met on item and place."""
        terms = self.query_words(query)
        if not terms:
            return self.items.where(F.lit(False))
        sides = [self.of_kind(self.of_term(t), kind).select(*KEY, F.explode("positions").alias("_p")).withColumn("_p", F.col("_p") - i) for i, t in enumerate(terms)]
        return self.items.join(reduce(lambda a, b: a.join(b, [*KEY, "_p"]), sides), KEY, "left_semi")

    def literal(self, query: str, kind: str = "all") -> DataFrame:
        """Items that hold a literal, ignoring case: the same as a scan of all texts.

        The words of the literal lie one after the other in such an item, the first at the end of a word and the last at the start
        of one; items where terms do so are looked up and verified on their text. A literal without a word is scanned for."""
        holds = F.contains(F.lower("text"), F.lit(query.lower()))
        if not query:
            return self.items.where(F.lit(False))
        parts = self.query_words(query)
        if not parts:
            return self.of_kind(self.items, kind).where(holds)
        term = F.col("term")
        if len(parts) == 1:
            met = self.of_kind(self._like(F.contains(term, F.lit(parts[0]))), kind).select(*KEY)
        else:
            sides = [self._like(term.endswith(parts[0])), *map(self.of_term, parts[1:-1]), self._like(term.startswith(parts[-1]))]
            sides = [self.of_kind(s, kind).select(*KEY, F.explode("positions").alias("_p")).withColumn("_p", F.col("_p") - i) for i, s in enumerate(sides)]
            met = reduce(lambda a, b: a.join(b, [*KEY, "_p"]), sides)
        return self.items.join(met, KEY, "left_semi").where(holds)


def scan(items: DataFrame, query: str, kind: str = "all") -> DataFrame:
    """What ``Index.literal`` returns, by reading all texts; for rows that have no index yet."""
    rows = items if kind == "all" else items.where(F.col("kind") == kind)
    return rows.where(F.contains(F.lower("text"), F.lit(query.lower())) if query else F.lit(False))


def by_conversation(hits: DataFrame, query: str, around: int = 40) -> DataFrame:
    """(conv_id, items, hits, kinds, anchor, snippet, total): a row a conversation with a hit: its items with one, how often the query occurs in them, their
    kinds, the first turn and, from it, a snippet with ``around`` characters on either side, or the whole title; and how many conversations there are."""
    q = query.lower()
    at = F.instr(F.lower("text"), q)
    low = F.greatest(F.lit(1), at - around)
    cut = F.when(F.col("kind") == "title", F.col("text")).otherwise(F.substring(F.col("text"), low, at - low + len(q) + around))
    rows = hits.select("kind", "conv_id", "turn", "item", occurrences(F.col("text"), query).alias("n"), cut.alias("snippet"))
    g = rows.groupBy("conv_id").agg(
        F.count("*").alias("items"), F.sum("n").cast("long").alias("hits"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("turn").alias("anchor"),
        F.min_by("snippet", F.struct("turn", "kind", "item")).alias("snippet"))
    return g.withColumn("total", g.select(F.count("*")).scalar())
