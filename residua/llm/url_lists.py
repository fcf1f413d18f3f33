"""URL filtering against lists that change: a temporal join.

Dated additions and removals become validity intervals of each entry. Every capture is evaluated, as of
its fetch time, against the entries active then: by its host and every parent domain (``domain``), by
its very host (``host``), or by its address without scheme, query and fragment (``url``). A list of any
size is joined by key; the few keys that very many captures share, such as a large site or a common
ending, are broadcast with their intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import join_counted, join_skewed, materialize

def validity(events: DataFrame) -> DataFrame:
    """list_name, key and ``spans``: the intervals [valid_from, valid_to) in which an entry is listed.

    ``events`` has list_name, kind (domain, host or url), entry, action (add or remove) and listed_at.
    Of events of an entry at one time, a removal counts last. Adding a listed entry again changes
    nothing of what is listed. Case counts in the path of a ``url`` entry only. Rows with a null in any of these columns are left out.
    """
    entry = F.trim("entry")
    host = F.regexp_extract(entry, r"^[^/?#]*", 0)
    entry = F.when(F.col("kind") == "url", F.concat(F.lower(host), F.substr(entry, F.length(host) + 1))).otherwise(F.lower(entry))
    names = ["list_name", "kind", "entry", "action", "listed_at"]
    rows = events.select(*names).dropna().filter(F.col("action").isin("add", "remove"))
    rows = rows.withColumn("key", F.concat_ws(":", "kind", entry)).drop("kind", "entry").distinct()
    order = Window.partitionBy("list_name", "key").orderBy("listed_at", "action")
    until = rows.withColumn("valid_to", F.lead("listed_at").over(order)).filter("action = 'add' and (valid_to is null or valid_to > listed_at)")
    span = F.struct(F.col("listed_at").alias("valid_from"), "valid_to")
    return until.groupBy("list_name", "key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def url_keys(url: Column, host: Column) -> Column:
    """All list keys that an address answers to."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(domains, F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("url:"), host, path)))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Each capture (page_id, url, fetched_at) with host, n_entries, lists and ``blocked``.

    ``n_entries`` counts the entries active at the fetch time, ``lists`` names their lists in order,
    joined with commas. A null url, one without host, or a null time meets no entry. Repeated rows are
    answered each. Addresses may be of any length. Other columns are left out, so that none can clash. An
    empty list blocks nothing, and an empty table gives no rows. All intervals of one entry are a single
    array: they are the history of an entry, not of its captures.
    """
    each = F.struct("list_name", "spans")
    facts = materialize(validity(events).groupBy("key").agg(F.collect_list(each).alias("listed")), "entries")
    host = url_host(F.col("url"))
    rows = captures.select("page_id", "url", "fetched_at").withColumn("host", host)
    asked = rows.select("url", "fetched_at", "host").dropna().groupBy("url", "fetched_at").agg(F.first("host").alias("host"), F.count("*").alias("n"))
    asked = materialize(asked, "asked")
    keys = asked.select("url", "fetched_at", "n", F.explode(url_keys(F.col("url"), F.col("host"))).alias("key"))
    met = join_skewed(keys, facts, "key")
    as_of = lambda s: (s.valid_from <= F.col("fetched_at")) & (s.valid_to.isNull() | (F.col("fetched_at") < s.valid_to))
    active = met.withColumn("names", F.transform(F.filter("listed", lambda e: F.exists(e.spans, as_of)), lambda e: e.list_name)).filter(F.size("names") > 0)
    found = active.groupBy("url", "fetched_at").agg(F.first("n").alias("n"), F.sum(F.size("names")).alias("n_entries"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    found = found.select("url", "fetched_at", "n", "n_entries", F.array_join(F.sort_array("names"), ",").alias("lists"))
    able = F.col("host").isNotNull() & F.col("fetched_at").isNotNull()
    both = join_counted(rows.filter(able), found, ["url", "fetched_at"], "n", rows.count(), "left").drop("n")
    none = rows.filter(~able).withColumns({"n_entries": F.lit(None).cast("bigint"), "lists": F.lit(None).cast("string")})
    out = both.unionByName(none)
    return out.select("page_id", "host", F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_entries").isNotNull().alias("blocked"))
