"""Mixing sources to target weights with balanced samples by the cube method."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def flight(pi: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Move fractional probabilities along the null space of their constraints until at most as many stay as there are constraints.

    ``balance[j, i]`` is what unit i adds to constraint j at probability 1. Sums are kept up to rounding; the direction is
    taken each way with the probabilities that keep every expectation.
    """
    pi = pi.copy()
    rng = np.random.default_rng(len(pi))
    p = balance.shape[0]
    scale = np.abs(balance).max(1, keepdims=True)
    balance = balance / np.where(scale > 0, scale, 1)
    waiting = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE)).tolist()[::-1]
    window: list[int] = []
    while True:
        while waiting and len(window) < p + 1:
            window.append(waiting.pop())
        if len(window) < 2:
            break
        a = balance[:, window]
        _, s, vt = np.linalg.svd(a)
        rank = int((s > 1e-10 * max(1.0, s[0])).sum())
        if rank >= len(window):
            break
        u = vt[-1]
        now = pi[window]
        big = np.abs(u) > 1e-12
        up = np.min(np.where(u > 0, (1 - now) / np.where(big, u, 1), np.where(big, -now / np.where(big, u, 1), np.inf))[big])
        down = np.min(np.where(u > 0, now / np.where(big, u, 1), np.where(big, (now - 1) / np.where(big, u, 1), np.inf))[big])
        step = up if rng.random() * (up + down) < down else -down
        moved = np.clip(now + step * u, 0, 1)
        moved[moved < EDGE] = 0
        moved[moved > 1 - EDGE] = 1
        pi[window] = moved
        window = [i for i in window if 0 < pi[i] < 1]
    return pi


def land(pi: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Settle the few probabilities that the flight leaves: the 0/1 choice nearest to the balance, the first constraint first."""
    pi = pi.copy()
    left = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE))
    if len(left) > 12:
        raise ValueError("the landing problem is not small")
    want = balance[:, left] @ pi[left]
    pi[left] = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: tuple(np.abs(balance[:, left] @ np.array(x) - want).round(9)))
    return pi.round()


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size): weights 1, 2, 3 repeating by code point with null last.

    Sources share all words by weight, none above 3 times its size; the excess goes to the others by weight until none is above.
    That is the water level at which the shares min(3 x size, level x weight) add up. One row a source is all this sorts.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = W.partitionBy(F.lit(0))
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    by = by.withColumn("weight", ((F.row_number().over(everywhere.orderBy(*order)) - 1) % 3 + 1).cast("double")).withColumn("cap", 3.0 * F.col("source_size"))
    rank = everywhere.orderBy(F.col("cap") / F.col("weight"), *order)
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    by = (
        by.withColumn("level", (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    )
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everywhere)
    by = by.withColumn("_l", first.getField("l"))
    return by.select("source", "source_size", F.when(F.col("_l").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_l") * F.col("weight"))).alias("target"))


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "_key", "_row"], ascending=[False, True, True], kind="stable")
    balance = np.stack([group["size"].to_numpy(float), np.ones(len(group))])
    return group.assign(pi=flight(group["pi"].to_numpy(float), balance))


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    group = _fly(group)
    balance = np.stack([group["size"].to_numpy(float), np.ones(len(group))])
    return group.assign(pi=land(group["pi"].to_numpy(float), balance))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 2048) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, _row) for each row: how often each text is taken.

    ``size`` counts words; null texts have none and are taken as whole copies of nothing. A source whose target is r times
    its size takes every text floor(r) times, and the fraction of r is the inclusion probability of one more copy, balanced
    on words and on texts. Sources are cut into blocks of about ``block`` texts; what the flight leaves of a block (two texts
    at most) flies again with the leavings of others, larger texts first, until one block a source is left, and that lands.
    A source of any size is so spread over all tasks. Texts never travel; equal rows are told apart by ``_row``, their place in
    the scan of a stored table. Same table, same result. Null ids and sources are values like others.
    """
    placed = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row"))
    sized = materialize(placed, "sizes")
    goals = targets(sized).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = materialize(goals, "goals")
    counts = sized.groupBy("source").agg(F.count("*").alias("_n"))
    rows = sized.alias("s").join(goals.join(counts.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s").alias("g"), F.expr("s.source <=> g.source"))
    rows = rows.select("s._id", "s.source", "s.size", "s._row", "g.source_size", "g.target", F.floor("g.ratio").alias("whole"), (F.col("g.ratio") - F.floor("g.ratio")).alias("pi"), F.col("g._n"), F.xxhash64("s._id", "s.size").alias("_key"))
    rows = rows.select("*", F.pmod(F.xxhash64("_key", F.lit(1)), F.ceil(F.col("_n") / block)).alias("_block"), F.ceil(F.col("_n") / block).alias("_blocks")).drop("_n")
    schema, done = rows.schema, []
    largest = counts.agg(F.max("_n")).first()[0] or 0
    state = rows
    while largest > block:
        state = materialize(state.groupBy("source", "_block").applyInPandas(_fly, schema), "flight")
        still = F.expr(f"pi > {EDGE} AND pi < {1 - EDGE}")
        done.append(state.where(~still))
        largest = 2 * -(-largest // block)
        fewer = F.ceil(2 * F.col("_blocks") / block)
        state = state.where(still).withColumn("_blocks", fewer).withColumn("_block", F.pmod(F.col("_block"), fewer))
        state = state.select(*schema.names)
    state = state.withColumn("_block", F.lit(0).cast("long")).select(*schema.names).groupBy("source").applyInPandas(_settle, schema)
    for part in done:
        state = state.unionByName(part)
    copies = (F.col("whole") + F.round("pi")).cast("long")
    return state.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_row")


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, a stored table, as often as :func:`mix` takes them, all columns as they were.

    Null texts have no words and are taken by their source's ratio of words like others; an empty table gives none.
    """
    taken = mix(docs, **options).where("copies > 0").select("_row", "copies")
    placed = docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    return placed.join(taken, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
