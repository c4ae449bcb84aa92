"""Candidate generation: top-k searches by the cosine of TF-IDF vectors inside blocks.

All passes of a block come from one search. Weights are fitted once a block and field and stored as sparse vectors; the
block's two sides are cut into tiles, and one task multiplies a tile of entities with a tile of pool rows. A tile gives, for
each pass, its own best rows with both cosines; the best of all tiles follow from a window over those. What is shuffled is
vectors and results, never the pairs that share a term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..sources.storage import materialize

#: Bits of the passes in ``hit``.
NAME, ADDRESS, FALLBACK, EXACT, COMBINED, LEAK, REVERSE = 1, 2, 4, 8, 16, 32, 64
#: Most numbers of a dense part of a tile's product.
CELLS = 1 << 22


def char_grams(column: str, n: int = 3) -> F.Column:
    """All runs of n characters; shorter strings have none."""
    s = F.coalesce(F.col(column), F.lit(""))
    runs = F.transform(F.sequence(F.lit(1), F.char_length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(F.char_length(s) >= n, runs).otherwise(F.array().cast("array<string>"))


def words(column: str) -> F.Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda t: t != "")


def _weighted(
    docs: DataFrame, block: Sequence[str], key: Sequence[str], terms: F.Column, max_df: float, max_df_above: int, times: str | None = None
) -> DataFrame:
    """(block, key, terms array<struct<t, term, w>>) of rows that have a term; ``t`` numbers a block's term.

    ``times``: the column that says for how many rows of a fit a row stands.
    """
    rows = docs.select(*block, *key, (F.col(times) if times else F.lit(1)).cast("long").alias("_times"), terms.alias("_terms"))
    sizes = rows.groupBy(*block).agg(F.sum("_times").alias("_n"))
    tf = rows.select(*block, *key, "_times", F.explode("_terms").alias("term")).groupBy(*block, *key, "_times", "term").agg(F.count("*").alias("_tf"))
    df = tf.groupBy(*block, "term").agg(F.sum("_times").alias("_df")).join(sizes, list(block))
    df = df.where((F.col("_n") <= max_df_above) | (F.col("_df") <= max_df * F.col("_n")))
    idf = (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf")
    numbered = materialize(df.select(*block, "term", idf, F.monotonically_increasing_id().alias("_t")), "terms")
    raw = tf.join(numbered, [*block, "term"]).withColumn("_x", (1 + F.ln("_tf")) * F.col("_idf"))
    listed = raw.groupBy(*block, *key).agg(F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), "term", F.col("_x").alias("x")))).alias("_l"))
    listed = listed.withColumn("_norm", F.sqrt(F.aggregate("_l", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])))
    unit = F.transform("_l", lambda e: F.struct(e["t"].alias("t"), e["term"].alias("term"), (e["x"] / F.col("_norm")).alias("w")))
    return listed.select(*block, *key, unit.alias("terms"))


def weights(
    docs: DataFrame, block: Sequence[str], key: Sequence[str], terms: F.Column, max_df: float = 0.05, max_df_above: int = 20_000
) -> DataFrame:
    """(block, key, term, w): L2-normalised (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), fitted in each block.

    In blocks of more than ``max_df_above`` rows, terms of more than ``max_df`` of them drop out. Both are parameters of the
    method, not of this engine.
    """
    listed = _weighted(docs, block, key, terms, max_df, max_df_above)
    return listed.select(*block, *key, F.explode("terms").alias("e")).select(*block, *key, "e.term", "e.w")


@dataclass(frozen=True)
class Pass:
    """The ``k`` best pairs of each entity (or record: ``by`` "mid") by a score of at least ``least``; they get ``hit``.

    Scores: "name" and "address" cosine, "combined" (their mean), "held" (share of the record's squared address weight that
    the entity holds). Ties go to the smaller id.
    """

    score: str
    k: int
    hit: int
    by: str = "s1"
    least: float = 0.05


#: Bits of a tile's selections.
_SLOTS = {("name", "s1"): 1, ("address", "s1"): 2, ("combined", "s1"): 4, ("held", "mid"): 8, ("name", "mid"): 16}
_SCORES = {"name": "name_cos", "address": "addr_cos", "combined": "both", "held": "held"}
_FIELDS = {"n": ("n_compact", char_grams), "a": ("a_tokens", words)}


class _Sparse:
    """Vectors of a tile's rows, entry by entry, and by term."""

    def __init__(self, terms: pd.Series, weights: pd.Series):
        sizes = np.fromiter((0 if x is None else len(x) for x in terms), np.int64, len(terms))
        join = lambda rows, kind: np.concatenate([np.asarray(x, kind) for x in rows if x is not None] or [np.zeros(0, kind)])
        self.term, self.w = join(terms, np.int64), join(weights, np.float64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.ends = np.cumsum(sizes)

    def postings(self) -> _Sparse:
        order = np.argsort(self.term, kind="stable")
        self.term, self.w, self.row = self.term[order], self.w[order], self.row[order]
        return self


def _products(q: _Sparse, p: _Sparse, n: int, rows: int, held: bool) -> Callable[[int, int], tuple[np.ndarray, np.ndarray | None]]:
    """Dense products of the entity rows first to last with all ``n`` pool rows, by the postings of ``p``."""
    lo, hi = np.searchsorted(p.term, q.term, "left"), np.searchsorted(p.term, q.term, "right")
    begins = np.append(0, q.ends)

    def run(first: int, last: int) -> tuple[np.ndarray, np.ndarray | None]:
        dots, shares = np.zeros((last - first) * n), np.zeros((last - first) * n) if held else None
        a, z = int(begins[first]), int(begins[last])
        while a < z:  # as many entries at a time as have some millions of products
            b = max(a + 1, int(np.searchsorted(np.cumsum(hi[a:z] - lo[a:z]), CELLS, "right")) + a)
            count = hi[a:b] - lo[a:b]
            at = np.repeat(lo[a:b] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
            cell = np.repeat((q.row[a:b] - first) * n, count) + p.row[at]
            w = p.w[at]
            dots += np.bincount(cell, np.repeat(q.w[a:b], count) * w, len(dots))
            if held:
                shares += np.bincount(cell, w * w, len(dots))
            a = b
        return dots.reshape(-1, n), None if shares is None else shares.reshape(-1, n)

    return run


def _largest(values: np.ndarray, k: int, least: float) -> np.ndarray:
    """Mask of each row's k largest values of at least ``least``; of equal ones the first."""
    n = values.shape[1]
    floor = np.partition(values, n - k, axis=1)[:, n - k] if n > k else np.full(len(values), -np.inf)
    over = values > floor[:, None]
    tied = values == floor[:, None]
    room = k - over.sum(1) if n > k else np.full(len(values), n)
    return (over | (tied & (np.cumsum(tied, 1) <= room[:, None]))) & (values >= least)


def _tile(a: pd.DataFrame, b: pd.DataFrame, passes: Sequence[Pass]) -> pd.DataFrame:
    """Pairs of a tile that one of the passes may want: both cosines, the scores and the bits of those passes."""
    a, b = a.sort_values("id", kind="stable", ignore_index=True), b.sort_values("id", kind="stable", ignore_index=True)
    n, held = len(b), any(p.score == "held" for p in passes)
    sparse = lambda df, f, on: _Sparse(df[f"{f}_t"], df[f"{f}_w"]) if on else None
    fields = [f for f in _FIELDS if f"{f}_t" in a.columns]
    products = {f: _products(sparse(a, f, True), sparse(b, f, True).postings(), n, len(a), held and f == "a") for f in fields}
    step, found = max(1, CELLS // max(1, n)), []
    for first in range(0, len(a), step):
        last = min(len(a), first + step)
        zero = np.zeros((last - first, n))
        name, _ = products["n"](first, last) if "n" in products else (zero, None)
        addr, share = products["a"](first, last) if "a" in products else (zero, None)
        scores = {"name": name.round(6), "address": addr.round(6), "combined": ((name + addr) / 2).round(6)}
        scores["held"] = share.round(6) if held else zero
        bits = np.zeros(zero.shape, np.int32)
        for p in passes:
            s = scores[p.score]
            mask = _largest(s, p.k, p.least) if p.by == "s1" else _largest(s.T, p.k, p.least).T
            bits |= np.where(mask, _SLOTS[p.score, p.by], 0).astype(np.int32)
        i, j = np.nonzero(bits)
        part = {_SCORES[k]: v[i, j] for k, v in scores.items()}
        found.append(pd.DataFrame({"s1": a["id"].to_numpy()[first + i], "mid": b["id"].to_numpy()[j], "bits": bits[i, j], **part}))
    return pd.concat(found, ignore_index=True)


def search(searches: Sequence[tuple[DataFrame, DataFrame, Sequence[str], Sequence[Pass]]], fields: str = "na", tile: int = 4096) -> DataFrame:
    """(s1, mid, name_cos, addr_cos, both, held, hit) of all pairs that a pass takes in a block, one row a block.

    Each search is (entities, pool, block columns, passes). A block of either side alone has no pairs and is left out before
    weights are fitted. Cosines are of the block's own weights, rounded to 6 places, and are there for every pair whatever
    pass took it. ``fields``: n for names (character 3-grams), a for addresses (words).
    """
    docs = None
    for i, (s1, pool, block, _) in enumerate(searches):
        code = F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in block]))
        pick = lambda df, side: df.select(F.lit(i).alias("kind"), code.alias("block"), F.lit(side).alias("side"), F.col("entity_id").alias("id"), *[_FIELDS[f][0] for f in fields])  # noqa: B023, E731
        left, right = pick(s1, 0), pick(pool, 1)
        right = right.join(left.select("block").distinct(), "block", "left_semi").select(left.columns)
        left = left.join(right.select("block").distinct(), "block", "left_semi").select(right.columns)
        both = left.unionByName(right)
        docs = both if docs is None else docs.unionByName(both)
    docs, passes = materialize(docs, "docs"), [list(s[3]) for s in searches]
    joint = [i for i, ps in enumerate(passes) if any(p.score == "combined" for p in ps)]
    single = [i for i in range(len(passes)) if i not in joint]
    of = lambda kinds: docs.where(F.col("kind").isin(kinds))
    found = [run(of(kinds), passes, fields, tile) for kinds, run in ((joint, _by_row), (single, _by_text)) if kinds]
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def _by_row(docs: DataFrame, passes: Sequence[Sequence[Pass]], fields: str, tile: int) -> DataFrame:
    """The search of passes by both fields: products of all rows."""
    rows = docs.select("kind", "block", "side", "id")
    for f in fields:
        column, terms = _FIELDS[f]
        listed = _weighted(docs, ["kind", "block"], ["side", "id"], terms(column), 0.05, 20_000)
        rows = rows.join(listed.select("kind", "block", "side", "id", F.col("terms.t").alias(f"{f}_t"), F.col("terms.w").alias(f"{f}_w")), ["kind", "block", "side", "id"], "left")
    rows = materialize(rows.where(" OR ".join(f"{f}_t IS NOT NULL" for f in fields)), "vectors")
    return _selected(_tiled(rows, passes, tile), passes)


def _by_text(docs: DataFrame, passes: Sequence[Sequence[Pass]], fields: str, tile: int) -> DataFrame:
    """The search of passes by one field: products of distinct texts, each under the smallest id of its rows on a side.

    A key's k best rows, ties to the smaller id, are among the k smallest ids of its k best texts, ties to the smaller such
    id: each text before theirs has a row before theirs. So k texts and k rows of each are enough, whatever stands how often.
    """
    on, pairs, vectors = ["kind", "block"], None, {}
    docs = docs.select(*on, "side", "id", *[F.coalesce(_FIELDS[f][0], F.lit("")).alias(_FIELDS[f][0]) for f in fields])
    rows = docs
    for f in fields:
        column, terms = _FIELDS[f]
        texts = docs.groupBy(*on, F.col(column).alias("text")).agg(F.count("*").alias("_m"))
        listed = _weighted(texts, on, ["text"], terms("text"), 0.05, 20_000, "_m").withColumn("terms", F.transform("terms", lambda e: F.struct(e["t"].alias("t"), e["w"].alias("w"))))
        vectors[f] = materialize(listed.withColumn("no", F.monotonically_increasing_id()), "texts")
        rows = rows.join(vectors[f].select(*on, F.col("text").alias(column), F.col("no").alias(f)), [*on, column], "left")
    rows = materialize(rows.select(*on, "side", "id", *fields), "numbered")
    ends = [f"{f}{n}" for f in fields for n in (0, 1)]
    for f in fields:
        mine = [[p for p in ps if (p.score == "name") == (f == "n")] for ps in passes]
        wanted = [i for i, ps in enumerate(mine) if ps]
        w = W.partitionBy(*on, f, "side").orderBy("id")
        placed = rows.where(F.col(f).isNotNull() & F.col("kind").isin(wanted)).withColumns({"_r": F.row_number().over(w), "rep": F.first("id").over(w)})
        placed = materialize(placed, "placed")
        heads = placed.where(F.col("_r") == 1).select(*on, "side", "id", F.col(f).alias("no")).join(vectors[f].select("no", "terms"), "no")
        heads = heads.select(*on, "side", "id", F.col("terms.t").alias(f"{f}_t"), F.col("terms.w").alias(f"{f}_w"))
        tiles = materialize(_tiled(heads, mine, tile), "tiles")
        for score, by in sorted({(p.score, p.by) for ps in mine for p in ps}):
            chosen = {i: p for i, ps in enumerate(mine) for p in ps if (p.score, p.by) == (score, by)}
            of = lambda x: F.create_map(*[F.lit(y) for i, p in chosen.items() for y in (i, getattr(p, x))])[F.col("kind")]  # noqa: B023, E731
            other = "mid" if by == "s1" else "s1"
            numbers = lambda c: [f"{x}{int(c == 'mid')}" for x in fields]
            members = lambda c: placed.where(F.col("side") == int(c == "mid")).select(*on, F.col("rep").alias(c), F.col("id").alias("_id"), "_r", *[F.col(x).alias(y) for x, y in zip(fields, numbers(c), strict=True)])  # noqa: B023, E731
            order = lambda c: W.partitionBy(*on, by).orderBy(F.desc("_x"), c)  # noqa: B023, E731
            best = tiles.where(F.col("bits").bitwiseAND(F.lit(_SLOTS[score, by])) > 0).select(*on, by, other, F.col(_SCORES[score]).alias("_x"))
            best = best.withColumn("_t", F.row_number().over(order(other))).where(F.col("_t") <= of("k"))
            best = best.join(members(other).where(F.col("_r") <= of("k")), [*on, other]).where(F.col("_t") + F.col("_r") - 1 <= of("k")).select(*on, by, F.col("_id").alias(other), "_x", *numbers(other))
            best = best.withColumn("_t", F.row_number().over(order(other))).where(F.col("_t") <= of("k")).select(*on, by, other, *numbers(other))
            best = best.join(members(by), [*on, by]).select(*on, F.col("_id").alias(by), other, of("hit").alias("hit"), *ends)
            pairs = best if pairs is None else pairs.unionByName(best)
    pairs = materialize(pairs, "chosen")
    held = any(p.score == "held" for ps in passes for p in ps) and "a" in fields
    for f in fields:
        pairs = pairs.join(_text_products(pairs, vectors[f], f, held and f == "a"), [f"{f}0", f"{f}1"], "left")
    value = lambda c: F.coalesce(F.max(c) if c in pairs.columns else F.lit(None), F.lit(0.0)).alias(c)
    # By the pair alone, so that what groups the blocks' rows of a pair moves nothing.
    pairs = pairs.repartition("s1", "mid").groupBy(*on, "s1", "mid").agg(F.bit_or("hit").alias("hit"), value("_n"), value("_a"), value("_h"))
    return pairs.select("s1", "mid", rounded("_n").alias("name_cos"), rounded("_a").alias("addr_cos"), rounded((F.col("_n") + F.col("_a")) / 2).alias("both"), rounded("_h").alias("held"), "hit")


def _text_products(pairs: DataFrame, vectors: DataFrame, f: str, held: bool) -> DataFrame:
    """The cosine of each two texts of field ``f`` that meet in ``pairs``, once however many pairs they stand in; with ``held`` also the share."""
    met = pairs.where(F.col(f"{f}0").isNotNull() & F.col(f"{f}1").isNotNull()).select(f"{f}0", f"{f}1").distinct()
    met = met.join(vectors.select(F.col("no").alias(f"{f}0"), F.col("terms").alias("_p")), f"{f}0")
    met = met.join(vectors.select(F.col("no").alias(f"{f}1"), F.map_from_entries("terms").alias("_q")), f"{f}1")
    over = lambda x: F.aggregate("_p", F.lit(0.0), lambda s, e: s + F.coalesce(x(e, F.try_element_at("_q", e["t"])), F.lit(0.0)))
    values = [over(lambda e, w: e["w"] * w).alias(f"_{f}")] + ([over(lambda e, w: w * w).alias("_h")] if held else [])
    return materialize(met.select(f"{f}0", f"{f}1", *values), "products")


def tiled(rows: DataFrame, keys: Sequence[str], tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``rows`` (keys, side 0 or 1, id) once for each tile of the other side, with tile numbers ``ta``, ``tb``.

    Sides are cut into tiles of about ``tile`` rows by a hash of the id; keys with one side only are left out.
    """
    size = rows.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"))
    size = size.where("_a > 0 AND _b > 0").withColumns({c: F.ceil(F.col(c) / tile).cast("int") for c in ("_a", "_b")})
    placed = rows.join(size, list(keys))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("side = 0").withColumn("ta", own("_a")).withColumn("tb", every("_b"))
    right = placed.where("side = 1").withColumn("tb", own("_b")).withColumn("ta", every("_a"))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("side", "_a", "_b")])
    return fresh(left), fresh(right)


def _tiled(rows: DataFrame, passes: Sequence[Sequence[Pass]], tile: int) -> DataFrame:
    left, right = tiled(rows, ["kind", "block"], tile)
    schema = "kind int, block string, s1 string, mid string, bits int, name_cos double, addr_cos double, both double, held double"

    def product(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _tile(a, b, passes[key[0]]) if len(a) and len(b) else ()
        if not len(found):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)
        return found.assign(kind=key[0], block=key[1])

    on = ["kind", "block", "ta", "tb"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(product, schema)


def _selected(found: DataFrame, passes: Sequence[Sequence[Pass]]) -> DataFrame:
    """Of the tiles' selections those that are the best of the whole block; one window a score, all of a key together."""
    used = sorted({(p.score, p.by) for ps in passes for p in ps}, key=lambda x: (x[1] == "mid", x[0]))
    has = lambda slot: F.col("bits").bitwiseAND(F.lit(_SLOTS[slot])) > 0
    for score, by in used:
        w = W.partitionBy("kind", "block", by).orderBy(has((score, by)).desc(), F.desc(_SCORES[score]), "mid" if by == "s1" else "s1")
        found = found.withColumn(f"_{score}_{by}", F.row_number().over(w))
    hit = F.lit(0)
    for i, ps in enumerate(passes):
        for p in ps:
            taken = (F.col("kind") == i) & has((p.score, p.by)) & (F.col(f"_{p.score}_{p.by}") <= p.k)
            hit = hit.bitwiseOR(F.when(taken, F.lit(p.hit)).otherwise(F.lit(0)))
    return found.withColumn("hit", hit).where("hit > 0").select("s1", "mid", *_SCORES.values(), "hit")


def text_pass(s1: DataFrame, pool: DataFrame, field: str, k: int = 25, bit: int = NAME, block: Sequence[str] = ("country", "region"), least: float = 0.05) -> DataFrame:
    """(s1, mid, cos, hit): the k nearest pool rows of each entity in its block by name (character 3-grams) or address (words)."""
    name = field == "n_compact"
    found = search([(s1, pool, block, [Pass("name" if name else "address", k, bit, least=least)])], "n" if name else "a")
    return found.select("s1", "mid", F.col("name_cos" if name else "addr_cos").alias("cos"), "hit")


def combined_pass(s1: DataFrame, pool: DataFrame, k: int = 25, block: Sequence[str] = ("country", "region"), least: float = 0.05) -> DataFrame:
    """The k nearest by the mean of name and address cosine."""
    return search([(s1, pool, block, [Pass("combined", k, COMBINED, least=least)])]).select("s1", "mid", F.col("both").alias("cos"), "hit")


def fallback_pass(s1: DataFrame, pool: DataFrame, k: int = 20, least: float = 0.05) -> DataFrame:
    """Pool rows without a region, by name, within the country."""
    return text_pass(s1, pool.where("region = ''"), "n_compact", k, FALLBACK, ("country",), least)


def regionless_pass(s1: DataFrame, pool: DataFrame, field: str, k: int = 25, bit: int = NAME) -> DataFrame:
    """Entities without a region, against the whole country."""
    return text_pass(s1.where("region = ''"), pool, field, k, bit, ("country",))


def _leak_sides(s1: DataFrame, pool: DataFrame, leaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    pairs = leaks.select("country", "region", "m_region").distinct()
    targets = pool.withColumnRenamed("region", "m_region").join(pairs, ["country", "m_region"])
    return s1.join(pairs, ["country", "region"]), targets


def leak_pass(s1: DataFrame, pool: DataFrame, leaks: DataFrame, field: str, k: int = 25, bit: int = NAME) -> DataFrame:
    """Entities of a region against the regions its matches leak to; each (region, leak) is a block of its own."""
    return text_pass(*_leak_sides(s1, pool, leaks), field, k, bit | LEAK, ("country", "region", "m_region"))


def exact_key_pass(s1: DataFrame, pool: DataFrame, key: str = "n_compact", least_length: int = 4, most_pool: int = 30, most_s1: int = 10) -> DataFrame:
    """(s1, mid, key, hit): equal names in a country, if they are long enough and rare enough on both sides."""
    cols = ["country", key]
    long = f"char_length({key}) >= {least_length}"
    rare_p = pool.where(long).groupBy(*cols).count().where(F.col("count") <= most_pool).select(*cols)
    rare_s = s1.where(long).groupBy(*cols).count().where(F.col("count") <= most_s1).select(*cols)
    a = s1.where(long).select(*cols, F.col("entity_id").alias("s1")).join(rare_s, cols, "left_semi").join(rare_p, cols, "left_semi")
    b = pool.where(long).select(*cols, F.col("entity_id").alias("mid")).join(rare_p, cols, "left_semi")
    return a.join(b, cols).select("s1", "mid", key, F.lit(EXACT).alias("hit"))


def pair_cosine(pairs: DataFrame, field: str = "a_tokens", block: Sequence[str] = ("country",)) -> DataFrame:
    """(s1, mid, cos) of pairs (block, s1, mid, field_s, field_c), 0 if they share no term.

    Weights are fitted in each block on the texts of these very pairs, a text as often as it stands in one; no term drops out.
    """
    side = lambda end, n: pairs.select(*block, "s1", "mid", F.lit(n).alias("side"), F.col(field + end).alias("_x"))
    terms = char_grams("_x") if field == "n_compact" else words("_x")
    w = weights(side("_s", 0).unionByName(side("_c", 1)), block, ["s1", "mid", "side"], terms, 1.0)
    dots = w.groupBy(*block, "s1", "mid", "term").agg(F.count("*").alias("n"), F.product("w").alias("x")).where("n = 2")
    cos = dots.groupBy("s1", "mid").agg(rounded(F.sum("x")).alias("cos"))
    return pairs.select("s1", "mid").join(cos, ["s1", "mid"], "left").select("s1", "mid", F.coalesce("cos", F.lit(0.0)).alias("cos"))


def containment_pass(s1: DataFrame, pool: DataFrame, k: int = 5, least: float = 0.4, block: Sequence[str] = ("country", "region")) -> DataFrame:
    """For each pool row the k entities that hold most of its squared address weight."""
    found = search([(s1, pool, block, [Pass("held", k, REVERSE, "mid", least)])], "a")
    return found.select("s1", "mid", F.col("held").alias("cos"), "hit")


def reverse_pass(s1: DataFrame, pool: DataFrame, k: int = 5, least: float = 0.05) -> DataFrame:
    """For each pool row without a region the k nearest entities of its country by name."""
    found = search([(s1, pool.where("region = ''"), ("country",), [Pass("name", k, REVERSE | FALLBACK, "mid", least)])], "n")
    return found.select("s1", "mid", F.col("name_cos").alias("cos"), "hit")


def generate(
    s1: DataFrame, pool: DataFrame, k_name: int = 25, k_addr: int = 25, k_fallback: int = 20, k_combined: int = 0, k_held: int = 0,
    k_reverse: int = 0, leaks: DataFrame | None = None, exact: bool = False, least_held: float = 0.4,
) -> DataFrame:
    """(s1, mid, name_cos, addr_cos, hit): the union of all passes, with both cosines of every candidate.

    Entities meet the pool of their region (name, address, combined, held), of the regions theirs leaks to, the country's
    records without a region (name; the reverse search too), and, if they have no region, the whole country. A pair's cosines
    are the largest of its blocks'. A pass with k = 0 is off. Exact names count as a name cosine of 1; their address cosine is
    of weights fitted on such pairs.
    """
    region = ("country", "region")
    by_text = lambda more=0: [Pass("name", k_name, NAME | more), Pass("address", k_addr, ADDRESS | more), Pass("combined", k_combined, COMBINED | more)]
    searches = [
        (s1.where("region <> ''"), pool.where("region <> ''"), region, [*by_text(), Pass("held", k_held, REVERSE, "mid", least_held)]),
        (s1, pool.where("region = ''"), ("country",), [Pass("name", k_fallback, FALLBACK), Pass("name", k_reverse, REVERSE | FALLBACK, "mid")]),
        (s1.where("region = ''"), pool, ("country",), by_text()),
    ]
    if leaks is not None:
        searches.append((*_leak_sides(s1, pool, leaks), (*region, "m_region"), by_text(LEAK)))
    searches = [(a, b, block, [p for p in ps if p.k > 0]) for a, b, block, ps in searches]
    rows = search([x for x in searches if x[3]]).select("s1", "mid", "name_cos", "addr_cos", "hit")
    if exact:
        pairs = exact_key_pass(s1, pool).select("s1", "mid", "hit")
        texts = pairs.join(s1.select(F.col("entity_id").alias("s1"), "country", F.col("a_tokens").alias("a_tokens_s")), "s1")
        texts = texts.join(pool.select(F.col("entity_id").alias("mid"), F.col("a_tokens").alias("a_tokens_c")), "mid")
        cos = pair_cosine(texts).withColumnRenamed("cos", "addr_cos")
        rows = rows.unionByName(cos.select("s1", "mid", F.lit(1.0).alias("name_cos"), "addr_cos", F.lit(EXACT).alias("hit")))
    return rows.groupBy("s1", "mid").agg(F.max("name_cos").alias("name_cos"), F.max("addr_cos").alias("addr_cos"), F.bit_or("hit").alias("hit"))


def best(pairs: DataFrame, k: int, by: Sequence[str] = ("s1",), score: str = "cos", tie: str = "mid") -> DataFrame:
    """The k rows with the largest score of each key; ties to the smaller id. Planned with a limit on both sides of the shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return pairs.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def merge(*passes: DataFrame) -> DataFrame:
    """(s1, mid, hit) of several passes: their bits together."""
    every = None
    for df in passes:
        part = df.select("s1", "mid", "hit")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("s1", "mid").agg(F.bit_or("hit").alias("hit"))


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(pass, pairs, found, recall): all passes together (pass 0) and each bit."""
    bits = [0, NAME, ADDRESS, FALLBACK, EXACT, COMBINED, LEAK, REVERSE]
    hits = truth.select("s1", "mid").distinct().join(candidates.select("s1", "mid", "hit"), ["s1", "mid"], "left")
    rows = hits.select(F.explode(F.array(*map(F.lit, bits))).alias("pass"), "hit")
    found = F.col("hit").isNotNull() & ((F.col("pass") == 0) | (F.col("hit").bitwiseAND(F.col("pass")) > 0))
    return rows.groupBy("pass").agg(F.count("*").alias("pairs"), F.count_if(found).alias("found"), F.avg(found.cast("double")).alias("recall"))


def recall_at(pairs: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, recall): share of true pairs among each entity's k best by ``cos``."""
    ranked = pairs.withColumn("rk", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("cos"), "mid"))).select("s1", "mid", "rk")
    marked = truth.select("s1", "mid").distinct().join(ranked, ["s1", "mid"], "left")
    at = marked.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rk")
    return at.groupBy("k").agg(F.avg(F.coalesce(F.col("rk") <= F.col("k"), F.lit(False)).cast("double")).alias("recall"))


def missed(truth: DataFrame, candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(relation, n): true pairs that are no candidates, by how their regions relate."""
    lost = truth.select("s1", "mid").distinct().join(candidates, ["s1", "mid"], "left_anti")
    a = s1.select(F.col("entity_id").alias("s1"), F.col("region").alias("r1"))
    b = pool.select(F.col("entity_id").alias("mid"), F.col("region").alias("r2"))
    relation = F.when((F.col("r1") == "") | (F.col("r2") == ""), "no region").when(F.col("r1") == F.col("r2"), "same region").otherwise("other region")
    return lost.join(a, "s1").join(b, "mid").groupBy(relation.alias("relation")).agg(F.count("*").alias("n"))


def _nearest(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k rows of ``b`` with the largest cosine to each row of ``a``, itself left out."""
    b = b.sort_values("id", kind="stable", ignore_index=True)
    unit = lambda df: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.array([np.asarray(x, float) for x in df["v"]]))
    left, right, found = unit(a), unit(b), []
    ids, others = a["id"].to_numpy(), b["id"].to_numpy()
    step = max(1, CELLS // len(b))
    for first in range(0, len(a), step):
        cos = (left[first : first + step] @ right.T).round(6)
        cos[ids[first : first + step, None] == others[None, :]] = -np.inf
        i, j = np.nonzero(_largest(cos, k, -1.5))
        found.append(pd.DataFrame({"s1": ids[first + i], "mid": others[j], "cos": cos[i, j]}))
    return pd.concat(found, ignore_index=True)


def dense_top_k(vectors: DataFrame, k: int, block: str = "label", id_col: str = "vec_id", vec_col: str = "embedding", tile: int = 4096) -> DataFrame:
    """(block, s1, mid, cos): the k nearest rows of the same block by the cosine of dense vectors, in tiles of matrix products.

    Rows without a block or vector and zero vectors have no neighbours; vectors of one block have one length.
    """
    rows = vectors.select(block, F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(f"`{block}` IS NOT NULL AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    left, right = tiled(rows, [block], tile)
    kinds = dict(vectors.dtypes)
    schema = f"{block} {kinds[block]}, s1 {kinds[id_col]}, mid {kinds[id_col]}, cos double"

    def product(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)
        return _nearest(a, b, k).assign(**{block: key[0]})

    on = [block, "ta", "tb"]
    return best(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(product, schema), k)
