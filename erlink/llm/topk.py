"""Exact top-k search by inner product: tiles of queries times shards, selection in each tile, merging in a tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of one side of a tile.
TILE_BYTES = 32 << 20
LEAST, MOST = -(2**63) + 1, 2**63 - 1
FAN_IN = 32


def quantized(vectors: DataFrame, id_col: str, vec_col: str, factor: float = 256.0) -> DataFrame:
    """(id, v array<double>): factor * x, of which a tile takes the floor; a product too large for a double is its largest number.

    Rows with a null id, a null vector or a null or non-finite component are left out; so the empty table gives none.
    """
    finite = f"`{id_col}` IS NOT NULL AND `{vec_col}` IS NOT NULL AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('inf'))"
    most = "1.7976931348623157E308D"
    scaled = f"transform(`{vec_col}`, x -> greatest(-{most}, least({most}, CAST(x AS DOUBLE) * {factor}D)))"
    return vectors.where(finite).select(F.col(id_col).alias("id"), F.expr(scaled).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(out)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k first of each query by score descending, id ascending."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return pd.DataFrame({"query_id": query[keep], "vec_id": vec[keep], "score": score[keep]})


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those that 64 bits cannot hold are the nearest number they can.

    In floating point where that is exact, else in 64 bits; rows too large for either by whole numbers of any length.
    """
    width = max(a.shape[1], 1)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2**53:
        return (a @ b.T).astype(np.int64)
    fits = math.isqrt((2**63 - 1) // width)
    small_a, small_b = np.abs(a).max(1, initial=0) < fits, np.abs(b).max(1, initial=0) < fits
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(small_a, small_b)] = a[small_a].astype(np.int64) @ b[small_b].astype(np.int64).T

    def whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rows = [[int(c) for c in r] for r in y]
        return np.array([[min(MOST, max(LEAST, sum(map(int.__mul__, map(int, r), c)))) for c in rows] for r in x], np.int64).reshape(len(x), len(y))

    if not small_a.all():
        out[~small_a] = whole(a[~small_a], b)
    if not small_b.all():
        out[np.ix_(small_a, ~small_b)] = whole(a[small_a], b[~small_b])
    return out


def _tile(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a shard for each query, some rows of the product at a time; ties at the k-th score stay until ids decide."""
    width = max([len(r) for r in queries["v"]] + [len(r) for r in shard["v"]], default=0)
    a, b = _matrix(queries["v"], width), _matrix(shard["v"], width)
    ids, others = queries["id"].to_numpy(), shard["id"].to_numpy()
    step, found = max(1, (1 << 22) // max(1, len(b))), []
    for first in range(0, len(a), step):
        s = _scores(a[first : first + step], b)
        own = ids[first : first + step, None] == others[None, :]
        s[own] = np.iinfo(np.int64).min
        at = max(0, s.shape[1] - k)
        floor = np.partition(s, at, axis=1)[:, at]
        q, v = np.nonzero((s >= floor[:, None]) & ~own)
        found.append(_best(ids[first + q], others[v], s[q, v], k))
    return pd.concat(found, ignore_index=True)


def top_k(queries: DataFrame, base: DataFrame, k: int = 5, tile: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of ``base`` with the largest inner product, exactly.

    Both sides are (id, v), as :func:`quantized` gives them. A row is never a result of a query with its own id. Ties go to the
    smaller id; of rows with the same id and score each counts. Shorter vectors count as ending in zeros. Scores beyond 64 bits
    count as the nearest number of 64 bits. Either side may be empty: no result.

    Queries form blocks and the base forms shards by hashes of their ids, so large (``tile`` rows, by default as many as fill
    32 MB) that either side is copied as seldom as memory allows, once for each tile of the other; while the base has few
    tiles it is cut finer, down to 2,048 rows, so that all cores have work. Each pair of block and shard is one task's product,
    so no side is broadcast or collected. Each tile keeps k rows a query; 32 shards merge at a time until 32 or fewer are left.
    """
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    (n_q, wide_q), (n_b, wide_b) = count(queries), count(base)
    rows = tile or max(2048, TILE_BYTES // (8 * max(wide_q, wide_b, 1)))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks, shards = max(1, -(-n_q // rows)), max(1, -(-n_b // rows), 0 if tile else min(-(-n_b // 2048), 2 * cores))
    numbered = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in ("id", "v", "block", "shard")))  # noqa: E731  both sides may be one table
    left = fresh(numbered(queries, blocks).withColumnRenamed("part", "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = fresh(numbered(base, shards).withColumnRenamed("part", "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    names = ("query_id", "vec_id", "score")

    def product(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _tile(a, b, k) if len(a) and len(b) else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        return found.assign(shard=key[1])

    merged = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(product, "query_id long, vec_id long, score long, shard int")
    while shards > FAN_IN:
        merged = _first(merged.withColumn("shard", F.expr(f"shard DIV {FAN_IN}").cast("int")), ["query_id", "shard"], k).drop("rank")
        shards = -(-shards // FAN_IN)
    return _first(merged, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, by a bounded aggregate that merges before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
