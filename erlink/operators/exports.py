"""Pairs for training and judging."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import raw_text
from .decide import winners


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A pseudo-random order that every engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def hard_negatives(pairs: DataFrame, k: int = 12, score: str = "p") -> DataFrame:
    """Positives and each entity's k negatives with the largest score."""
    neg = F.row_number().over(W.partitionBy("s1", "y").orderBy(F.desc(score), "mid"))
    return pairs.withColumn("_r", neg).where((F.col("y") == 1) | (F.col("_r") <= k)).drop("_r")


def wide_hard_negatives(pairs: DataFrame, k: int, new_bits: int, most_new: int = 2, share: float = 1.0, seed: int = 5) -> DataFrame:
    """Of a hash share of entities: positives, the k hardest negatives, and up to ``most_new`` only found by the passes in ``new_bits``."""
    some = pairs.where(F.conv(F.substring(hash_order("s1", seed=seed), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF) < share)
    only_new = F.col("hit").bitwiseAND(F.lit(~new_bits)) == 0
    w = W.partitionBy("s1", "y", only_new).orderBy(F.desc("p"), "mid")
    ranked = some.withColumns({"_r": F.row_number().over(W.partitionBy("s1", "y").orderBy(F.desc("p"), "mid")), "_n": F.row_number().over(w), "_o": only_new})
    return ranked.where((F.col("y") == 1) | (F.col("_r") <= k) | (F.col("_o") & (F.col("_n") <= most_new))).drop("_r", "_n", "_o")


def attach_canonical(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds text_a and text_b: canonical name ; address."""
    text = lambda df, key, name: df.select(F.col("entity_id").alias(key), F.concat(F.coalesce("n_canon", F.lit("")), F.lit(" ; "), F.coalesce("a_tokens", F.lit(""))).alias(name))
    return pairs.join(text(s1, "s1", "text_a"), "s1").join(text(pool, "mid", "text_b"), "mid")


def attach_raw(pairs: DataFrame, s1: DataFrame, pool: DataFrame, name: str = "name", address: str = "address") -> DataFrame:
    """Adds text_a and text_b: name | address as they came."""
    text = lambda df, key, to: df.select(F.col("entity_id").alias(key), raw_text(name, address).alias(to))
    return pairs.join(text(s1, "s1", "text_a"), "s1").join(text(pool, "mid", "text_b"), "mid")


def incremental(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs without a score yet."""
    return pairs.join(known.select("s1", "mid"), ["s1", "mid"], "left_anti")


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """All scores; where both have one the old stays."""
    return old.unionByName(incremental(new, old))


def bucketise(x: Column, edges: list[float]) -> Column:
    """Right-closed intervals: (-inf, e0], (e0, e1], ..."""
    names = [f"(-inf, {edges[0]:g}]", *(f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:]))]
    out = F.lit(f"({edges[-1]:g}, inf)")
    for edge, name in zip(reversed(edges), reversed(names)):
        out = F.when(x <= F.lit(float(edge)), name).otherwise(out)
    return out


def stratified(df: DataFrame, by: list[str], n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Up to n rows of each stratum, in hash order."""
    w = W.partitionBy(*by).orderBy(hash_order(*keys, seed=seed), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def judge_sample(scored: DataFrame, n: int, edges: list[float], seed: int = 0) -> DataFrame:
    """Best claims on records, up to n for each country and score bucket."""
    best = winners(scored).withColumn("bucket", bucketise(F.col("p"), edges))
    return stratified(best, ["country", "bucket"], n, ["s1", "mid"], seed)


def synthetic_pairs(s1: DataFrame, seed: int = 0, kinds: tuple[str, ...] = ("pos", "addr", "name", "word", "decoy")) -> DataFrame:
    """(text_a, text_b, y, kind): noisy copies as positives, and four kinds of negatives.

    ``addr``: another entity of the same address block; ``name``: one of the same name elsewhere; ``word``: the same address with
    one word of the name exchanged; ``decoy``: the next house number. The noise of a row is seeded by its id, so reruns agree.
    """

    @F.pandas_udf("struct<name:string,address:string,word:string,decoy:string>")
    def noisy(ids: pd.Series, names: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        rows = []
        for i, name, address in zip(ids, names, addresses, strict=True):
            rnd = random.Random(hashlib.sha256(f"{seed}:{i}".encode()).digest())
            words = (name or "").split()
            op = rnd.choice(["legal", "drop", "extra", "web", "case", "typo"])
            out = list(words)
            if op == "legal":
                out.append(rnd.choice(["Inc", "LLC", "Ltd", "SARL"]))
            elif op == "drop" and len(out) > 1:
                out.pop(rnd.randrange(len(out)))
            elif op == "extra":
                out.insert(rnd.randrange(len(out) + 1), rnd.choice(["Group", "Services", "International"]))
            elif op == "typo" and out:
                k = rnd.randrange(len(out))
                w = out[k]
                j = rnd.randrange(max(1, len(w) - 1))
                out[k] = w[:j] + w[j + 1 : j + 2] + w[j : j + 1] + w[j + 2 :]
            noisy_name = "".join(out).lower() + ".com" if op == "web" else " ".join(out).upper() if op == "case" else " ".join(out)
            parts = [p.strip() for p in (address or "").split(",")]
            if rnd.random() < 0.5:
                rnd.shuffle(parts)
            noisy_address = ", ".join(parts).replace("Street", rnd.choice(["Street", "St", "St."]))
            other = list(words) or [""]
            other[rnd.randrange(len(other))] = rnd.choice(["Nova", "Delta", "Orion", "Kappa"])
            number = next((t for t in (address or "").split() if t.isdigit()), None)
            decoy = (address or "").replace(number, str(int(number) + rnd.randint(1, 9)), 1) if number else (address or "") + " 2"
            rows.append((noisy_name, noisy_address, " ".join(other), decoy))
        return pd.DataFrame(rows, columns=["name", "address", "word", "decoy"])

    text = lambda n, a: F.concat(F.coalesce(n, F.lit("")), F.lit(" | "), F.coalesce(a, F.lit("")))
    df = s1.select("entity_id", "country", "region", "name", "address").withColumn("x", noisy("entity_id", "name", "address")).withColumn("text_a", text("name", "address"))
    parts = {
        "pos": df.select("text_a", text("x.name", "x.address").alias("text_b"), F.lit(1).alias("y"), F.lit("pos").alias("kind")),
        "word": df.select("text_a", text("x.word", "address").alias("text_b"), F.lit(0).alias("y"), F.lit("word").alias("kind")),
        "decoy": df.select("text_a", text("name", "x.decoy").alias("text_b"), F.lit(0).alias("y"), F.lit("decoy").alias("kind")),
    }
    for kind, keys in (("addr", ["country", "region"]), ("name", ["country", "name"])):
        nxt = F.lead(F.struct("name", "address")).over(W.partitionBy(*keys).orderBy(hash_order("entity_id", seed=seed), "entity_id"))
        differs = "NOT (o.name <=> name)" if kind == "addr" else "NOT (o.address <=> address)"
        parts[kind] = df.withColumn("o", nxt).where(f"o IS NOT NULL AND {differs}").select("text_a", text("o.name", "o.address").alias("text_b"), F.lit(0).alias("y"), F.lit(kind).alias("kind"))
    out = None
    for kind in kinds:
        out = parts[kind] if out is None else out.unionByName(parts[kind])
    return out
