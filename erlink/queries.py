"""All linkage queries by name, their SQL, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import block_queries, decide_queries, text_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score by country of a whole linkage: canonicalise, block, compare, fit, assign."""
    return QUERIES["flagship"](spark, sf_dir)
