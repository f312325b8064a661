"""URL filter lists as of the fetch time, in DataFrame functions only.

A list is a log of dated entries: a pattern is added, removed, added again. Each addition
becomes a validity interval up to the pattern's next entry, and every capture is joined to
the intervals that were open when it was fetched.

How it scales: a capture turns into the few keys that can match it (its host, the host's
parent domains, its path's directories), so the join is an equality on the key with a range
on the time, never a scan of the list for each capture. Captures that repeat are one row
until the end. A host that holds a third of the captures is a skewed key of a plain sort-merge
join, which the planner splits; a list whose size is known to be small is broadcast by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.session import shared_table

KINDS = ("host", "domain", "prefix")


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if the text is no absolute URL."""
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def directories_of(url: Column) -> Column:
    """The path's leading segments: of ``/a/b/c`` these are ``/a``, ``/a/b`` and ``/a/b/c``."""
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    spots = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def domains_of(host: Column) -> Column:
    """The host and its parent domains: ``a.b.c`` gives itself, ``b.c`` and ``c``."""
    labels = F.filter(F.split(host, r"\."), lambda p: p != "")
    spots = F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def keys_of(url: Column) -> Column:
    """Distinct keys ``kind:pattern`` that an entry can match a URL by."""
    host = host_of(url)
    found = F.concat(
        F.array(F.concat(F.lit("host:"), host)),
        F.transform(domains_of(host), lambda d: F.concat(F.lit("domain:"), d)),
        F.transform(directories_of(url), lambda p: F.concat(F.lit("prefix:"), host, p)),
    )
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, category, valid_from, valid_to)`` from ``entries(kind, pattern, category, action, at)``.

    ``action`` is ``add`` or ``remove``; an interval is half open and has no end (null) while the
    pattern stays listed. Of entries of one pattern and category at the same time the removal
    is the last. Entries with a null in kind, pattern, action or time are left out.
    """
    e = entries.filter("kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    pattern = F.regexp_replace(F.regexp_replace(F.lower(F.trim("pattern")), r"^\*?\.", ""), r"[/.]$", "")
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace(F.trim("pattern"), "/+$", "")).otherwise(pattern)
    e = e.select(F.concat_ws(":", "kind", pattern).alias("key"), F.coalesce("category", F.lit("")).alias("category"), "action", "at").distinct()
    order = W.partitionBy("key", "category").orderBy("at", "action")
    e = e.withColumn("valid_to", F.lead("at").over(order))
    return e.filter("action = 'add' AND (valid_to IS NULL OR valid_to > at)").select("key", "category", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``n_entries`` and ``categories`` (distinct, sorted) of the entries open at the fetch time.

    Rows whose URL is null or no absolute URL, or whose time is null, match nothing; repeated rows
    come back repeated; an empty list blocks nothing. Columns of ``captures`` that have
    one of the new names are an error.
    """
    clash = {"blocked", "n_entries", "categories"} & set(captures.columns)
    if clash:
        raise ValueError(f"captures has columns {sorted(clash)} already")
    open_when = shared_table(validity(entries)).withColumnRenamed("key", "key_")
    row = F.struct(*captures.columns).alias("row")
    each = captures.groupBy(row).agg(F.count("*").alias("copies"))
    each = each.select("row", "copies", F.col("row")[url_col].alias("url_"), F.col("row")[time_col].alias("time_"))
    keyed = each.select("row", "copies", "time_", F.explode_outer(keys_of(F.col("url_"))).alias("key"))
    hit = (F.col("key") == F.col("key_")) & (F.col("time_") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("time_") < F.col("valid_to")))
    met = keyed.join(open_when, hit, "left").groupBy("row", "copies")
    judged = met.agg(F.count("key_").alias("n_entries"), F.array_sort(F.collect_set(F.when(F.col("key_").isNotNull(), F.col("category")))).alias("categories"))
    again = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("row.*", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "categories")
