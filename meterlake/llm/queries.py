"""The registered queries of the corpus operators, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import Alignment, align
from .decontamination import find_leaks
from .html_text import extract_text
from .langid import held_out_predictions
from .licenses import LicenseScan, scan_licenses
from .mixing import mix_sizes
from .near_dedup import NearDedup, near_duplicates
from .quality import fit, grade, ratings_of
from .token_files import TokenFiles, token_index
from .topk import top_inner_products
from .url_filters import filter_urls
from .vantage import nearest
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDedup(shingle=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_predictions(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, ratings_of(table(spark, sf_dir, "labels"))))


#: The filter list of op7: (domain, path prefix, action, date from which it holds).
URL_LIST = [
    ("tionsh.example.net", "/", "block", "2024-02-01"),
    ("tionsh.example.net", "/", "remove", "2024-05-01"),
    ("tionsh.example.net", "/de/", "block", "2024-03-15"),
    ("tionsh.example.net", "/", "block", "2024-08-01"),
    ("example.org", "/", "block", "2024-04-01"),
    ("blog.ththth.example.org", "/", "allow", "2024-06-01"),
    ("blog.ththth.example.org", "/", "remove", "2024-09-15"),
    ("m.ththin.example.org", "/en/", "allow", "2024-04-10"),
    ("tionble.example.com", "/", "block", "2024-01-20"),
    ("tionble.example.com", "/fr/", "allow", "2024-01-20"),
    ("tionble.example.com", "/", "remove", "2024-11-01"),
    ("ththon.example.com", "/", "block", "2024-07-01"),
    ("ththon.example.com", "/", "allow", "2024-10-01"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` carries no fetch time: page n counts as fetched n mod 366 days after the first of 2024."""
    entries = spark.createDataFrame(URL_LIST, "domain string, prefix string, action string, day string").select("domain", "prefix", "action", F.to_date("day").alias("listed_at"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_at"))
    return filter_urls(captures, entries)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), TokenFiles(default_tokenizer()))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), Alignment(default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model")))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_language_id, op3_topk_search, op4_html_text, op5_license_scan, op6_quality, op7_url_filter, op8_decontamination, op9_token_files, op10_mixing, op11_alignment, op12_nearest, op13_whitening)
}

_TEMPLATES = ", ".join(f"('{t.name}', '{t.label}', {str(t.whole).lower()}, {1.0 if t.whole else t.share}::DOUBLE, {t.k}, {t.words!r})" for t in LicenseScan().templates)
_VALUES = ", ".join(f"('{d}', '{p}', '{a}', DATE '{t}')" for d, p, a, t in URL_LIST)

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_license_scan": f"""
WITH t(template, label, whole, least, k, ws) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template, k, len(ws) AS length, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS t_pos FROM t),
tg AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM tw WINDOW o AS (PARTITION BY template ORDER BY t_pos)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), dw AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
dg AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM dw WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (
  SELECT rid, template, k, length, pos - t_pos AS diagonal, min(t_pos) AS first_t, max(t_pos) AS last_t, list_distinct(flatten(list(range(t_pos, t_pos + k)))) AS in_place
  FROM dg JOIN tg ON dg.w = tg.w AND dg.w1 = tg.w1 AND (k = 2 OR dg.w2 = tg.w2 AND dg.w3 = tg.w3) GROUP BY ALL HAVING count(*) > 1 OR k = 2
), n AS (
  SELECT *, diagonal + first_t AS start, diagonal + last_t + k AS stop FROM g
), b AS (
  SELECT n.*, label, whole, least, coalesce(whole OR abs(diagonal - lag(diagonal) OVER o) > 3 OR start - lag(stop) OVER o > length OR first_t <= lag(last_t) OVER o, true)::INTEGER AS new
  FROM n JOIN t USING (template, k) WINDOW o AS (PARTITION BY rid, template ORDER BY start, diagonal)
), s AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY start, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM b),
f AS (
  SELECT rid, label, whole, least, min(diagonal) AS diagonal, len(list_distinct(flatten(list(in_place))))::DOUBLE / greatest(max(length), max(stop) - min(start)) AS share
  FROM s GROUP BY rid, template, label, whole, least, span
), r AS (
  SELECT rid, count(*) FILTER (WHERE whole) AS n_base, min(diagonal) FILTER (WHERE whole) AS first_word, max(diagonal) FILTER (WHERE whole) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE whole))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM f WHERE share >= least GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (rid)""",
    "op7_url_filter": f"""
WITH listed(domain, prefix, action, listed_at) AS (VALUES {_VALUES}),
valid AS (SELECT domain, prefix, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY domain, prefix ORDER BY listed_at) AS valid_to FROM listed),
c AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path,
    (DATE '2024-01-01' + (page_id % 366)::INTEGER) AS fetched_at FROM pages
), m AS (
  SELECT c.*, v.action, v.domain, v.prefix, v.valid_from,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.domain) DESC NULLS LAST, length(v.prefix) DESC) AS n
  FROM c LEFT JOIN valid v ON v.action <> 'remove' AND (c.host = v.domain OR ends_with(c.host, '.' || v.domain))
    AND v.valid_from <= c.fetched_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to)
    AND starts_with(CASE WHEN path = '' THEN '/' ELSE path END, v.prefix)
)
SELECT page_id, host, fetched_at, coalesce(action = 'block', false) AS blocked, action, domain, prefix, valid_from FROM m WHERE n = 1""",
    "op10_mixing": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS number FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((number - 1) % 3 + 1)::INTEGER] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, cap / weight AS full_at FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY full_at, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR)[1:8], doc_id) - 1 AS rank FROM d WHERE size > 0
), e AS (
  SELECT source, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS expected,
    ('0x' || md5('mix:' || coalesce(source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS start FROM t
)
SELECT d.doc_id, d.size, e.source_size, e.target,
  (d.size * coalesce(floor(e.start + (r.rank + 1) * e.expected) - floor(e.start + r.rank * e.expected), 0))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN r ON d.doc_id = r.doc_id AND d.source IS NOT DISTINCT FROM r.source""",
}
