"""Helpers shared by the corpus operators: reading tables, shared intermediate storage, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize, settled, shared_dir

__all__ = ["connected_components", "materialize", "read", "settled", "shared_dir", "small_batches"]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One table of the data directory, by Spark's own reader, pruned to ``columns`` if given."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let at most ``rows`` rows go to a Python worker at a time: texts are long, and a batch is in memory on both sides.

    The bound on a batch's bytes is the engine's own, spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default). The
    setting stays, as DataFrames are computed later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each round written to the shared
    folder. The number of rounds is logarithmic in practice. Nothing but a count and a checksum
    reaches the driver. Self loops and nulls are ignored.
    """
    if dict(edges.dtypes)["a"] != dict(edges.dtypes)["b"]:
        raise ValueError("both ends of an edge must have one type")
    edges = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = materialize(edges, "edges")
    seen = None
    while True:  # every round but the last joins something
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        state = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
