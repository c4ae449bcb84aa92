"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its nearest reference points in order, the prefix of a permutation, and listed under the first of
these. For two vectors on one list the reference points that both descriptions hold are counted; with enough of them, their
cosine is computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize


def _unit(rows: list) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    m = np.array([np.asarray(r, np.float64) for r in rows])
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _valid(vec_col: str) -> str:
    return f"`{vec_col}` IS NOT NULL AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('inf')) AND exists(`{vec_col}`, x -> x <> 0)"


def _spread(vectors: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first ``most`` of the vectors, in their order, that have a cosine below ``apart`` to all taken before."""
    best, taken = np.full(len(vectors), -np.inf), []
    for i in range(len(vectors)):
        if len(taken) < most and best[i] < apart:
            taken.append(i)
            best = np.maximum(best, vectors @ vectors[i])
    return vectors[taken]


def _bits(lists: list[np.ndarray], place: dict[int, int], words: int) -> np.ndarray:
    """Each list of reference points as a set of bits."""
    out = np.zeros((len(lists), words), np.uint64)
    for i, points in enumerate(lists):
        for p in points.tolist():
            k = place[p]
            out[i, k >> 6] |= np.uint64(1 << (k & 63))
    return out


def _sweep(rows: pd.DataFrame, own: int, least: float, shared: int, lead: int) -> pd.DataFrame:
    """Links of one tile of the inverted list of ``own``: for each vector its number of linked rows, and its root in the tile's graph.

    Shared reference points are counted first; only pairs with enough of them are verified. A pair belongs to the first list
    that both are on, so that no other list counts it again.
    """
    lists = [np.asarray(x) for x in rows["lists"]]
    place = {p: k for k, p in enumerate(np.unique(np.concatenate(lists)).tolist())}
    words = -(-len(place) // 64)
    marks, keys = _bits(lists, place, words), _bits([x[:lead] for x in lists], place, words)
    before = np.array([(1 << max(0, min(64, place[own] - 64 * w))) - 1 for w in range(words)], np.uint64)
    keys &= before
    need = np.minimum(shared, [len(x) for x in lists])
    vectors = _unit(rows["v"].tolist())
    side, copies = rows["side"].to_numpy(), rows["copies"].to_numpy()
    one_tile = (side == 0).all()
    a_at, b_at = (np.arange(len(rows)),) * 2 if one_tile else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    links, edges = np.zeros(len(rows), np.int64), []
    step = max(1, (1 << 20) // max(1, len(b_at)))
    for k in range(0, len(a_at), step):
        a = a_at[k : k + step]
        count, earlier = np.zeros((len(a), len(b_at)), np.uint8), np.zeros((len(a), len(b_at)), bool)
        for w in range(words):
            count += np.bitwise_count(marks[a, w][:, None] & marks[b_at, w][None, :])
            if before[w]:
                earlier |= (keys[a, w][:, None] & keys[b_at, w][None, :]) != 0
        i, j = np.nonzero((count >= need[a][:, None]) & ~earlier)
        near = vectors[a] @ vectors[b_at].T if 4 * len(i) > count.size else None  # as a whole where most pairs are verified
        x, y = a[i], b_at[j]
        if near is not None:
            good = near[i, j] >= least
        else:
            good = np.zeros(len(i), bool)
            for part in range(0, len(i), 50_000):
                s = slice(part, part + 50_000)
                good[s] = np.einsum("ij,ij->i", vectors[x[s]], vectors[y[s]]) >= least
        if one_tile:
            good &= x < y
        x, y = x[good], y[good]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        edges.append(np.stack([x, y]))
    root = np.arange(len(rows))
    if edges:
        x, y = np.concatenate(edges, 1)
        while True:
            low = np.minimum(root[x], root[y])
            last = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root == last).all():
                break
    ids, on = rows["node"].to_numpy(), links > 0
    return pd.DataFrame({"node": ids[on], "links": links[on], "root": ids[root][on]})


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, references: int = 256,
    nearest: int = 12, lead: int = 6, shared: int = 3, tile: int = 4096, seed: int = 3, apart: float = 0.9, lengths: int = 16,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Rows are compared if their labels are equal and not null, and their vectors of one length; null, zero and non-finite
    vectors and rows with a null id link with nothing. Equal vectors of one label are one node with a count (they link with
    each other); rows that share an id count and join by their vectors. An empty table gives none.

    The references of a length are ``references`` vectors, or the square root of its number of distinct vectors where that is
    more, taken in the order of their hash from the first eight times as many (the documented sample that the index is fitted
    on), no two with a cosine of ``apart`` or more: points inside one group of near copies would come in another order for each
    of its members, which would then share too few. A vector is described by its ``nearest`` references in order and listed
    under the first ``lead`` of them. Two vectors on one list that share ``shared`` of their nearest references are verified.
    Every row is indexed. Lengths beyond the ``lengths`` most frequent, and those with no more references than ``nearest``,
    have one list, in which every pair is verified. Long lists are cut into tiles of about ``tile`` rows; each pair of tiles
    is a task of its own and gives two numbers a vector.
    """
    ids = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), F.col(label_col).alias("_l"))
    rows = ids.where(f"_l IS NOT NULL AND _id IS NOT NULL AND {_valid('_v')}")
    reps = rows.groupBy("_l", "_v").agg(F.min("_id").alias("least"), F.count("*").alias("copies"))
    reps = materialize(reps.select("*", F.size("_v").alias("_n"), F.xxhash64("_l", "_v").alias("_h")), "vectors")
    points: dict[int, np.ndarray] = {}
    for r in reps.groupBy("_n").count().orderBy(F.desc("count"), "_n").limit(lengths).collect():
        wanted = max(references, int(r["count"] ** 0.5))
        sample = reps.where(F.col("_n") == r["_n"]).select("_v").orderBy(F.xxhash64("_v", F.lit(seed)), "_v").limit(8 * wanted).collect()
        found = _spread(_unit([x["_v"] for x in sample]), wanted, apart)
        if len(found) > nearest:
            points[r["_n"]] = found
    shared_points = vectors.sparkSession.sparkContext.broadcast(points)

    @F.pandas_udf("array<int>")
    def describe(v: pd.Series) -> pd.Series:
        out = pd.Series([np.zeros(1, np.int32)] * len(v), index=v.index)
        size = v.map(len)
        for n, at in shared_points.value.items():
            own = v[size == n]
            for k in range(0, len(own), 1000):
                part = own.iloc[k : k + 1000]
                order = np.argsort(-(_unit(part.tolist()) @ at.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                out.loc[part.index] = pd.Series(list(order), index=part.index)
        return out

    # nodes are numbered by their place in a stored table, as ids may repeat
    nodes = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
    listed = materialize(nodes.withColumn("lists", describe("_v")), "lists")
    keys = ["_l", "_n", "pivot"]
    entries = listed.withColumn("pivot", F.explode(F.slice("lists", 1, lead)))
    sizes = entries.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = entries.join(sizes, keys).withColumn("t", F.pmod("_h", F.col("tiles")).cast("int"))
    pairs = F.expr("transform(sequence(0, tiles - 1), o -> named_struct('a', least(t, o), 'b', greatest(t, o), 'side', IF(o = t, 0, IF(t < o, 1, 2))))")
    tiles = placed.withColumn("p", F.explode(pairs)).select(*keys, "p.a", "p.b", "p.side", "node", "copies", "lists", F.col("_v").alias("v"))
    sweep = lambda key, g: _sweep(g, int(key[2]), least, shared, lead)
    found = materialize(tiles.groupBy(*keys, "a", "b").applyInPandas(sweep, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("_root"))
    result = labelled.join(smallest, "root").select("_l", "_v", "_root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = ids.join(result, ["_l", "_v"], "left")
    usable = F.col("_id").isNotNull() & F.col("_root").isNotNull()
    out = out.select(F.col("_id").alias(id_col), F.when(usable, F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(usable, F.col("_root")).otherwise(F.col("_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
