"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace


@dataclass(frozen=True)
class Mixing:
    """``weights`` go to the sources in code point order, null last, and repeat. ``budget``: words of the mix, as a share of all.
    ``most``: how often a source's words may be taken. ``group``: about how many documents are ranked in one group."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most: int = 2
    group: int = 512
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, p: Mixing) -> DataFrame:
    """``sizes`` (source, source_size), a row per source -> with weight and target added.

    What sharing by weight and resharing the excess of full sources ends in: every source gets the same level times its
    weight, or ``most`` times its size if that is less. In order of size by weight the sources that are full come
    first, so the level is the largest of the levels that leave out the first 0, 1, 2, ... sources.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rest = Window.orderBy("full_at", "number")
    s = sizes.withColumn("number", F.row_number().over(named))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), F.pmod(F.col("number") - 1, len(p.weights)) + 1))
    s = s.withColumn("cap", p.most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum("cap").over(rest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(rest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", F.max((p.budget * F.col("total") - before) / after).over(Window.partitionBy()))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, p: Mixing, ws: Workspace) -> DataFrame:
    """(row_id, doc_id, source, size, source_size, target, copies) for each row of ``docs`` (row_id, doc_id, source, size).

    All documents of a source have the same expected copies, target / source size. They are ordered by size and then by
    a hash of the id, the expected copies are summed up in that order from an offset that a hash of the
    source draws, and a document is emitted once per whole number that the sum passes: within one of the
    expectation for every stretch of the order, so for every range of sizes.

    The running sum needs a rank, not a pass: groups of about ``group`` documents of one source and size, cut by the hash,
    are counted, the counts are summed up in order, first by size and then by group, and only ranks within a group are sorted
    out. No task sees a whole source, however large; the one window over a source has a row for each size of its texts.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    counts = ws.save(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    by_source = ws.save(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), p), "targets")
    rows = docs.withColumn("h", _unit32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    parts = counts.where("size > 0").select("source", "size", F.ceil(F.col("n") / p.group).alias("groups"))
    cut = rows.alias("r").join(parts.alias("c"), same("r", "c") & (F.col("r.size") == F.col("c.size"))).select("r.*", F.floor(F.col("h") * F.col("groups") / F.lit(float(1 << 32))).alias("group"))
    cut = ws.save(cut, "groups")
    grouped = cut.groupBy("source", "size", "group").agg(F.count("*").alias("n"))
    # two levels: the sizes of a source, of which there are as many as texts differ in length, then the groups of a size
    above = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    smaller = counts.where("size > 0").select("source", "size", F.coalesce(F.sum("n").over(above("source").orderBy("size")), F.lit(0)).alias("smaller"))
    within = grouped.select("source", "size", "group", F.coalesce(F.sum("n").over(above("source", "size").orderBy("group")), F.lit(0)).alias("within"))
    first = within.alias("w").join(smaller.alias("s"), same("w", "s") & (F.col("w.size") == F.col("s.size"))).select("w.source", "w.size", "w.group", (F.col("smaller") + F.col("within")).alias("first"))
    first = ws.save(first, "ranks")
    inside = cut.withColumn("inside", F.row_number().over(Window.partitionBy("source", "size", "group").orderBy("h", "doc_id", "row_id")) - 1)
    ranked = inside.alias("i").join(first.alias("f"), same("i", "f") & (F.col("i.size") == F.col("f.size")) & (F.col("i.group") == F.col("f.group"))).select("i.row_id", (F.col("first") + F.col("inside")).alias("rank"))
    told = by_source.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    small = told["n"] <= 10_000 and told["bytes"] <= 1 << 20
    known = docs.alias("d").join((F.broadcast(by_source) if small else by_source).alias("t"), same("d", "t")).select("d.*", "source_size", "target")
    expected = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    offset = _unit32(F.concat(F.lit(f"{p.seed}:"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << 32))
    passed = F.floor(offset + (F.col("rank") + 1) * expected) - F.floor(offset + F.col("rank") * expected)
    return known.join(ranked, "row_id", "left").withColumn("copies", F.coalesce(passed, F.lit(0)).cast("long")).drop("rank")


def numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with a stored row_id, so that rows without an id or with the same id can be told apart."""
    return ws.save(docs.withColumn("row_id", F.monotonically_increasing_id()), "rows")


def mix_sizes(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) for each row of ``docs``.

    Null and wordless texts have size 0 and are never taken; a source of such texts alone has target 0. A null source
    is a source of its own. Repeated rows are rows. Reruns agree. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    sized = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), ws)
    return copies(sized, p, ws).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with all columns: some not at all, some repeatedly."""
    ws = Workspace(docs.sparkSession, "mixing")
    names = docs.columns
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")), ws)
    sized = ws.save(rows.select("row_id", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.source", word_count(F.col("doc.text")).alias("size")), "sized")
    taken = ws.save(copies(sized, p, ws).where("copies > 0").select("row_id", "copies"), "taken")
    return rows.join(taken, "row_id").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
