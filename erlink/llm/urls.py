"""URL filters with dated lists: entries become validity intervals, captures meet those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a last dot; empty if there is none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(rest, r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from dated entries (pattern, listed_on, action).

    An entry holds from its date until the next entry of its pattern, that date excluded. Of entries with one date the last
    action by name counts ("block" after "allow"). Entries with a null pattern, date or action are left out.
    """
    daily = entries.where("pattern IS NOT NULL AND listed_on IS NOT NULL AND action IS NOT NULL").groupBy(F.lower("pattern").alias("pattern"), F.col("listed_on").alias("valid_from")).agg(F.max("action").alias("action"))
    return daily.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("pattern").orderBy("valid_from")))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """All columns of ``captures`` and ``host``, ``rule``, ``action``, ``allowed`` (columns of these names are replaced).

    A capture is held against the entries for its host and each parent domain that were active at its time; the longest
    pattern decides. Without one it is allowed, so are null URLs and null times. Every row comes out once, repeated or not;
    an empty table gives none, an empty list allows all.

    Captures are reduced to distinct hosts and times, these to distinct names and times, and those meet the list, with the
    interval as a further condition of the join on the pattern. So a top-level domain costs a row a time, however many
    captures it has, and captures themselves move once, to meet their host's decision; hot hosts are split by the engine's
    skew handling.
    """
    columns = [c for c in captures.columns if c not in ("host", "rule", "action", "allowed")]
    rows = captures.select(*columns).withColumn("host", host(F.col(url_col)))
    hosts = rows.where(F.col("host") != "").select(F.col("host").alias("_host"), F.col(time_col).alias("_at")).where("_at IS NOT NULL").distinct()
    labels = F.split("_host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = hosts.select("_host", "_at", F.explode(names).alias("_name")).where("_name <> ''")
    active = intervals(entries)
    asked = probes.select("_name", "_at").distinct().join(active.select(F.col("pattern").alias("_name")).distinct(), "_name", "left_semi")
    hits = asked.join(active, (F.col("_name") == F.col("pattern")) & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    hits = hits.select("_name", "_at", F.struct(F.char_length("pattern").alias("n"), F.col("pattern"), F.col("action")).alias("hit"))
    decided = probes.join(hits, ["_name", "_at"]).groupBy("_host", "_at").agg(F.max("hit").alias("_hit"))
    out = rows.join(decided, (F.col("host") == F.col("_host")) & (F.col(time_col) == F.col("_at")), "left")
    action = F.coalesce(F.col("_hit.action"), F.lit("allow"))
    return out.select(*columns, "host", F.col("_hit.pattern").alias("rule"), action.alias("action"), (action != "block").alias("allowed"))
