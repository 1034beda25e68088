"""Searches through the inverted index, each against a scan in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations
from ..operators.search_index import Index, build_index, by_conversation, scan, searchable
from ..sources.scratch import scratch
from ..sources.tables import table
from .registry import query

_ITEMS = r"""t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'prompts' WHEN role = 'assistant' AND turn % 4 = 3 THEN 'thinking' WHEN role = 'assistant' THEN 'assistant' ELSE 'tools' END AS kind, text FROM conversations),
f AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY path) - 1)::INTEGER AS item, path FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS path FROM conversations WHERE role = 'assistant')),
items AS (SELECT kind, conv_id, turn, 0 AS item, text FROM t WHERE text IS NOT NULL
  UNION ALL SELECT 'title', conv_id, min(turn), 0, arg_min(text[1:80], turn) FILTER (WHERE role = 'user') FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0
  UNION ALL SELECT 'files', conv_id, turn, item, path FROM f)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with all kinds of items: every fourth reply counts as a thought, a system turn as a tool's text, long words of replies as paths."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "prompts").when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "thinking").when(F.col("role") == "assistant", "assistant").otherwise("tools")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    titles = conversations.outline(c).select("conv_id", "title").where("title is not null").join(first, "conv_id")
    paths = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))).alias("path"))
    return searchable(c.select("conv_id", "turn", kind.alias("kind"), "text"), titles, paths)


def _index(spark: SparkSession, sf_dir: str) -> Index:
    items, path = _items(spark, sf_dir), scratch(spark, "search-index")
    build_index(items, path)
    return Index(spark, path, items)


#: Literals, in words and across them, and the kind searched.
_LITERALS = [("of the", "all"), ("tion", "prompts"), ("E, l", "assistant"), ("the", "title"), ("ment", "files"), (". en", "thinking"), ("sch", "tools"), ("nosuchword", "all"), (", ", "tools")]


def _grouped_sql(source: str, name: str = "q") -> str:
    return f"""(SELECT *, count(*) OVER () AS total FROM (SELECT {name} AS query, conv_id, count(*) AS items, sum((len(lower(text)) - len(replace(lower(text), lower({name}), ''))) // len({name}))::BIGINT AS hits, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, min(turn) AS anchor,
  arg_min(CASE WHEN kind = 'title' THEN text ELSE substring(text, greatest(1, p - 40), p - greatest(1, p - 40) + len({name}) + 40) END, (turn, kind, item)) AS snippet FROM (SELECT *, instr(lower(text), lower({name})) AS p FROM {source}) GROUP BY ALL))"""


_SEARCH_SQL = " UNION ALL ".join(_grouped_sql(f"(SELECT *, '{q}' AS q FROM items WHERE contains(lower(text), lower('{q}')) AND ('{k}' = 'all' OR kind = '{k}'))") for q, k in _LITERALS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_ITEMS} {_SEARCH_SQL}")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals found through the index, by conversation, with kinds, totals and snippets."""
    index = _index(spark, sf_dir)
    return _union([by_conversation(index.literal(q, k), q).withColumn("query", F.lit(q)) for q, k in _LITERALS])


@query(f"WITH {_ITEMS} {_SEARCH_SQL}")
def scanned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a scan of all texts."""
    items = _items(spark, sf_dir)
    return _union([by_conversation(scan(items, q, k), q).withColumn("query", F.lit(q)) for q, k in _LITERALS])


@query(rf"""WITH {_ITEMS}, w AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM items),
p AS (SELECT kind, conv_id, turn, item, unnest(ws) AS a, unnest(list_append(ws[2:], '')) AS b FROM w)
SELECT 'all' AS mode, kind, conv_id, turn, item FROM w WHERE list_has_all(ws, ['the', 'of', 'is']) UNION ALL SELECT 'all', kind, conv_id, turn, item FROM w WHERE kind = 'assistant' AND list_has_all(ws, ['la', 'de'])
UNION ALL SELECT DISTINCT 'phrase', kind, conv_id, turn, item FROM p WHERE a = 'of' AND b = 'the' UNION ALL SELECT DISTINCT 'phrase', kind, conv_id, turn, item FROM p WHERE a = 'in' AND b = 'die' AND kind = 'prompts'""")
def indexed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold all of some words, and items that hold words one after the other, by joins of postings."""
    index = _index(spark, sf_dir)
    key = ["kind", "conv_id", "turn", "item"]
    found = [("all", index.all_terms("of IS the")), ("all", index.all_terms("la de", "assistant")), ("phrase", index.phrase("of the")), ("phrase", index.phrase("In, die", "prompts"))]
    return _union([d.select(F.lit(mode).alias("mode"), *key) for mode, d in found])
