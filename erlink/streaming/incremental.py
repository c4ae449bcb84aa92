"""Incremental linkage: a stream of noisy records meets the stored clean source by exact keys.

The linkage itself is batch only; this applies its stateless parts to a stream, and collects matches with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_addresses, canon_names


def link_stream(records: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1, mid, house_eq) as records arrive: canonicalised, joined with the prepared entities on country and compact name."""
    ready = canon_addresses(canon_names(records))
    keys = s1.where("char_length(n_compact) >= 4").select(F.col("entity_id").alias("s1"), "country", "n_compact", F.col("a_house").alias("_h"))
    return ready.join(keys, ["country", "n_compact"]).select("s1", F.col("entity_id").alias("mid"), ((F.col("a_house") == F.col("_h")) & (F.col("_h") != "")).cast("int").alias("house_eq"), *(["ts"] if "ts" in records.columns else []))


def matches_per_window(links: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, matches) of event-time windows; rows later than ``late`` are dropped by the watermark."""
    return links.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("matches")).select(F.col("w.start").alias("start"), "matches")
