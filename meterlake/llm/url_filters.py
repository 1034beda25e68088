"""URL filters whose lists change over time: validity intervals and an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and a final dot; an IPv6 address in its brackets; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def validity(entries: DataFrame) -> DataFrame:
    """``entries`` (domain, prefix, action, listed_at) -> the same with valid_to, the time of the next
    entry for the same domain and prefix, null for the last. ``action``: block, allow or remove; a removal
    ends the one before and holds nothing itself. Of entries of one time, the last by action counts."""
    e = entries.select(F.lower("domain").alias("domain"), F.coalesce("prefix", F.lit("/")).alias("prefix"), "action", "listed_at").where("domain is not null and listed_at is not null and action is not null")
    e = e.groupBy("domain", "prefix", "listed_at").agg(F.max("action").alias("action"))
    by = Window.partitionBy("domain", "prefix").orderBy("listed_at")
    return e.withColumn("valid_to", F.lead("listed_at").over(by)).where("action <> 'remove'").withColumnRenamed("listed_at", "valid_from")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) -> page_id, host, fetched_at, blocked, action, domain, prefix, valid_from.

    A capture is tested against the entries in force when it was fetched (``valid_from <= fetched_at <
    valid_to``) for its host or a parent domain and a prefix of its path. The longest domain decides, then
    the longest prefix; one that allows overrides shorter ones that block.

    The join is an equality on domain and prefix with the interval as its residual. Which domains of the list a host ends in and
    how long their prefixes are is found once for each host; a capture then asks for the prefixes of its path of
    these lengths, a few rows however many entries a domain has, and an entry is met by those captures only whose path
    it begins. Matches are reduced by partial aggregation, so that one very common host, domain or prefix is spread; which side of a
    join is broadcast is left to Spark and the sizes of stored tables. No list of entries is ever one row.

    No entry in force, a URL without a host, a null URL or a null time: not blocked. Repeated rows give
    repeated results; an empty list blocks nothing.
    """
    ws = Workspace(captures.sparkSession, "url-filters")
    c = captures.select("page_id", "url", "fetched_at").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    valid = ws.save(validity(entries), "validity")
    reaches = valid.select("domain", F.length("prefix").alias("reach")).distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = c.select("host").where("host is not null").distinct().select("host", F.explode(suffix).alias("domain"))
    # as many numbers as prefixes of its domains differ in length
    asks = ws.save(hosts.join(reaches, "domain").groupBy("host").agg(F.collect_set(F.struct("domain", "reach")).alias("asks")), "asks")
    rows = ws.save(c.drop("url").withColumn("rid", F.monotonically_increasing_id()), "captures")
    asked = rows.where("fetched_at is not null").join(asks, "host").select("rid", "fetched_at", "path", F.explode("asks").alias("ask")).select("rid", "fetched_at", F.col("ask.domain").alias("domain"), F.expr("substring(path, 1, ask.reach)").alias("prefix"))
    met = asked.join(valid, ["domain", "prefix"]).where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    best = met.groupBy("rid").agg(F.max(F.struct(F.length("domain").alias("depth"), F.length("prefix").alias("reach"), "domain", "prefix", "valid_from", "action")).alias("rule"))
    out = rows.join(ws.save(best, "rules"), "rid", "left")
    return out.select("page_id", "host", "fetched_at", F.coalesce(F.col("rule.action") == "block", F.lit(False)).alias("blocked"), F.col("rule.action").alias("action"), F.col("rule.domain").alias("domain"), F.col("rule.prefix").alias("prefix"), F.col("rule.valid_from").alias("valid_from"))
