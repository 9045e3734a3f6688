"""URL filters over time: dated list entries against captures, as of their fetch.

Entries add a domain to a list or remove it. Per list and domain they become
validity intervals [valid_from, valid_to). A capture is on a list when, at its
time, an interval of its host or of a parent domain holds. Hosts are matched
once each: distinct hosts meet the domains above them, which gives each host
its intervals; captures then take their host's and test them in place. So no
capture is multiplied. The hosts of a thousandth of all captures or more, a
thousand at most, are broadcast with their intervals; the others meet their
captures by shuffle. Domains with many hosts are met in the same way.

Cases: null or malformed urls have no host and are on no list; upper case,
ports, credentials and a final dot don't matter; entries at one time for one
list and domain: a removal wins; repeated entries and removals of what is not
on a list change nothing; null dates of captures match nothing, entries with
null fields are ignored; empty tables give empty results, no entries empty
lists; very long urls are urls like others; columns of captures named host or
lists are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismark.llm.store import keyed_join, scratch, written


def host_of(url: Column) -> Column:
    """The host of an absolute url, in lower case; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame, at: str = "at") -> DataFrame:
    """list, domain, valid_from, valid_to (null: still valid) of entries (list, domain, action add or remove, `at`)."""
    known = entries.select("list", F.lower("domain").alias("domain"), "action", F.col(at).alias("at")).dropna().filter(F.col("action").isin("add", "remove"))
    state = known.groupBy("list", "domain", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    in_time = W.partitionBy("list", "domain").orderBy("at")
    changes = state.withColumn("before", F.coalesce(F.lag("removed").over(in_time), F.lit(True))).filter("removed <> before")
    return changes.withColumn("valid_to", F.lead("at").over(in_time)).filter(~F.col("removed")).select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def _domains(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def evaluate(captures: DataFrame, valid: DataFrame, at: str, url: str = "url") -> DataFrame:
    """`captures` with host and lists: sorted names of the lists that it is on at time `at`."""
    plain = captures.drop("host", "lists").withColumn("host", host_of(F.col(url)))
    spark = captures.sparkSession
    hosts = written(plain.filter("host is not null").groupBy("host").agg(F.count("*").alias("captures")), scratch(spark, "url-hosts"))
    facts = hosts.agg(F.sum("captures"), F.sum(F.size(F.split("host", r"\."))).alias("domains")).first()
    domains = hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain"))
    # A row for each listed domain, with its history.
    history = valid.groupBy("domain").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("history")).join(domains.groupBy("domain").agg(F.count("*").alias("hosts")), "domain")
    met = keyed_join(domains, history, ["domain"], "hosts", facts[1] or 0)
    # As many intervals as the histories of one host's few domains have.
    by_host = met.groupBy("host").agg(F.flatten(F.collect_list("history")).alias("_intervals")).join(hosts, "host")
    by_host = written(by_host, scratch(spark, "url-intervals"))
    now = F.col(at)
    holds = F.filter("_intervals", lambda i: (i["valid_from"] <= now) & (i["valid_to"].isNull() | (now < i["valid_to"])))
    names = F.array_sort(F.array_distinct(F.transform(holds, lambda i: i["list"])))
    joined = keyed_join(plain, by_host, ["host"], "captures", facts[0] or 0, "left").select(*plain.columns, "_intervals")
    return joined.withColumn("lists", F.coalesce(names, F.array().cast("array<string>"))).drop("_intervals")
