"""Features of candidate pairs: text, tokens, house numbers, frequencies, competition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import tokens

#: Columns of a record that pair features read.
RECORD = ("name", "n_canon", "n_core", "n_compact", "n_legal", "n_native", "n_alias", "n_web", "n_upper", "a_tokens", "a_nums", "a_house", "region", "region_src", "a_null", "country")


def attach(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Record columns of both sides, with suffixes ``_s`` and ``_c``."""
    side = lambda df, key, end: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(c + end) for c in columns if c in df.columns])
    return pairs.join(side(s1, "s1", "_s"), "s1").join(side(pool, "mid", "_c"), "mid")


def owned(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """``pool`` with ``owners``, the entities that ``truth`` (s1, mid) names, so that a pair is labelled where its record is attached (see owner)."""
    owners = truth.groupBy(F.col("mid").alias("entity_id")).agg(F.collect_set("s1").alias("owners"))
    return pool.join(owners, "entity_id", "left")


def owner() -> Column:
    """1 if the entity of a pair is among its record's owners (attached as ``owners_c``), else 0."""
    return _flag(F.array_contains("owners_c", F.col("s1")))


#: Similarity -> its kernel and the fields it compares.
FUZZY = {
    "nm_ratio": ("ratio", "n_core"), "nm_tset": ("token_set", "n_core"), "nm_tsort": ("token_sort", "n_core"), "nm_partial": ("partial", "n_core"),
    "nm_jw": ("jaro_winkler", "n_compact"), "nm_cpartial": ("partial", "n_compact"), "nm_canon_ratio": ("ratio", "n_canon"),
    "ad_ratio": ("ratio", "a_tokens"), "ad_tset": ("token_set", "a_tokens"), "ad_partial": ("partial", "a_tokens"), "ad_tsort": ("token_sort", "a_tokens"),
}


def fuzzy(df: DataFrame) -> DataFrame:
    """Adds the string similarities of names and addresses (0 to 100; nm_jw and nm_lev 0 to 1), all from one Arrow pass."""
    both = lambda c: (F.coalesce(f"{c}_s", F.lit("")), F.coalesce(f"{c}_c", F.lit("")))
    fields = {c: both(c) for c in ("n_core", "n_compact", "n_canon", "a_tokens")}
    df = df.withColumn("nm_lev", K.lev_sim(*fields["n_compact"])).withColumn("_f", K.similarities(FUZZY, fields))
    return df.select("*", *[F.col(f"_f.{c}").alias(c) for c in FUZZY]).drop("_f")


#: Columns whose word sets pair features compare.
WORDED = ("n_core", "a_tokens", "a_nums")


def word_sets(records: DataFrame) -> DataFrame:
    """Adds the word sets of WORDED columns as ``<column>_set``, so that they are made once a record and not once a pair."""
    return records.withColumns({f"{c}_set": F.array_distinct(tokens(F.col(c))) for c in WORDED if c in records.columns})


def token_overlap(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds prefix_jacc, _c_in_s, _s_in_c, _n1, _n2 of the word sets of both sides; empty denominators count as 1.

    Sets that are attached (see word_sets) are taken as they are.
    """
    made = f"{column}_set_s" in df.columns
    a, b = (F.col(f"{column}_set{end}") if made else F.array_distinct(tokens(F.col(column + end))) for end in ("_s", "_c"))
    df = df.withColumns({"_a": a, "_b": b}).withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    n1, n2 = F.size("_a"), F.size("_b")
    one = lambda n: F.greatest(n, F.lit(1))
    return df.withColumns({f"{prefix}_jacc": F.col("_i") / one(n1 + n2 - F.col("_i")), f"{prefix}_c_in_s": F.col("_i") / one(n2), f"{prefix}_s_in_c": F.col("_i") / one(n1), f"{prefix}_n1": n1, f"{prefix}_n2": n2}).drop("_a", "_b", "_i")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def flags(df: DataFrame) -> DataFrame:
    """Adds exact, substring and record flags and name lengths."""
    s, c = (lambda x: F.col(f"{x}_s")), (lambda x: F.col(f"{x}_c"))
    return df.withColumns(
        {
            "nm_compact_eq": _flag(s("n_compact") == c("n_compact")),
            "nm_canon_eq": _flag(s("n_canon") == c("n_canon")),
            "legal_eq": _flag(s("n_legal") == c("n_legal")),
            "legal_both": _flag((s("n_legal") != "") & (c("n_legal") != "")),
            "region_eq": _flag(s("region") == c("region")),
            "nm_s_sub_c": _flag(c("n_compact").contains(s("n_compact"))),
            "nm_c_sub_s": _flag(s("n_compact").contains(c("n_compact"))),
            "c_native": c("n_native"),
            "c_alias": c("n_alias"),
            "c_web": c("n_web"),
            "c_upper": c("n_upper"),
            "c_addr_null": c("a_null"),
            "c_is_s3": _flag(F.col("mid").startswith("S3")),
            "region_src_cand": c("region_src"),
            "nm_len1": F.char_length(s("n_compact")),
            "nm_len2": F.char_length(c("n_compact")),
        }
    )


def house(df: DataFrame) -> DataFrame:
    """Adds how the two house numbers relate, their gap as ln(1 + |difference|) (-1 if one is missing), and whether each is among the other side's numbers.

    A missing number is among no numbers at all, as an empty string is the only part of an empty one.
    """
    h1, h2 = F.coalesce("a_house_s", F.lit("")), F.coalesce("a_house_c", F.lit(""))
    both = (h1 != "") & (h2 != "")
    digits = lambda h: F.array_join(F.array_sort(F.split(h, "")), "")
    number = lambda h: F.expr("try_cast(substring({}, 1, 9) AS BIGINT)".format(h))
    gap = F.log1p(F.abs(number("a_house_s") - number("a_house_c")).cast("double"))
    return df.withColumns(
        {
            "house_both": _flag(both),
            "house_eq": _flag(both & (h1 == h2)),
            "house_len_eq": _flag(both & (F.char_length(h1) == F.char_length(h2))),
            "house_perm": _flag(both & (digits(h1) == digits(h2))),
            "house_sub": _flag(both & (h1.contains(h2) | h2.contains(h1))),
            "house_last_eq": _flag(both & (F.substring(h1, -1, 1) == F.substring(h2, -1, 1))),
            "house_gap": F.when(both, F.coalesce(gap, F.lit(-1.0))).otherwise(F.lit(-1.0)),
            "house_c_in_snums": _flag(F.array_contains(F.split(F.coalesce("a_nums_s", F.lit("")), " "), h2)),
            "house_s_in_cnums": _flag(F.array_contains(F.split(F.coalesce("a_nums_c", F.lit("")), " "), h1)),
        }
    )


def ambiguity(df: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds how many entities and pool rows share a compact name in the country (and region); empty names count in the pool as 0."""

    def count(side: DataFrame, keys: list[str], names: list[str], out: str, to: DataFrame) -> DataFrame:
        n = side.groupBy(*keys).agg(F.count("*").alias(out)).select(*[F.col(k).alias(v) for k, v in zip(keys, names, strict=True)], out)
        return to.join(n, names, "left").withColumn(out, F.coalesce(out, F.lit(0)))

    named = pool.where("n_compact <> ''")
    df = count(s1, ["country", "n_compact"], ["country_s", "n_compact_s"], "s1_cnt", df)
    df = count(s1, ["country", "region", "n_compact"], ["country_s", "region_s", "n_compact_s"], "s1_cnt_region", df)
    df = count(named, ["country", "n_compact"], ["country_c", "n_compact_c"], "pool_cnt_c", df)
    return count(named, ["country", "n_compact"], ["country_s", "n_compact_s"], "pool_cnt_s", df)


def name_idf(s1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country, tok, idf = ln(N / df)) over distinct core words of entities, and (country, max_idf = ln N)."""
    sizes = s1.groupBy("country").agg(F.count("*").alias("_n"))
    df = s1.select("country", F.explode(F.array_distinct(tokens(F.col("n_core")))).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("_df"))
    return df.join(sizes, "country").select("country", "tok", F.ln(F.col("_n") / F.col("_df")).alias("idf")), sizes.select("country", F.ln("_n").alias("max_idf"))


def idf_containment(df: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1, mid, nm_idf_s_in_c, nm_idf_c_in_s, nm_idf_total1, nm_extra_tok_idf, rare_tok_hit, rare_tok_sub, rare_tok_idf).

    Words that no entity has weigh ln N. nm_extra_tok_idf is the largest weight of a word that only the record has. The rarest word is the entity's word of largest weight, ties to the larger word.
    """
    idf, most = name_idf(s1)
    a, b = F.array_distinct(tokens(F.col("n_core_s"))), F.array_distinct(tokens(F.col("n_core_c")))
    rows = df.select("s1", "mid", F.col("country_s").alias("country"), F.coalesce("n_compact_c", F.lit("")).alias("_cc"), a.alias("_a"), b.alias("_b"))
    long = rows.select("s1", "mid", "country", "_cc", "_a", "_b", F.explode_outer(F.array_union("_a", "_b")).alias("tok"))
    long = long.join(idf, ["country", "tok"], "left").join(most, "country", "left").select("s1", "mid", "_cc", "tok", F.array_contains("_a", F.col("tok")).alias("in_a"), F.array_contains("_b", F.col("tok")).alias("in_b"), F.coalesce("idf", "max_idf").alias("w"))
    on = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    small = F.lit(1e-6)
    both = on(F.col("in_a") & F.col("in_b"))
    rank = F.when(F.col("in_a"), F.struct("w", "tok"))
    out = long.groupBy("s1", "mid").agg(
        (both / F.greatest(on(F.col("in_a")), small)).alias("nm_idf_s_in_c"),
        (both / F.greatest(on(F.col("in_b")), small)).alias("nm_idf_c_in_s"),
        on(F.col("in_a")).alias("nm_idf_total1"),
        F.coalesce(F.max(F.when(F.col("in_b") & ~F.col("in_a"), F.col("w"))), F.lit(0.0)).alias("nm_extra_tok_idf"),
        F.max_by(F.struct(F.col("in_b").cast("int").alias("hit"), F.col("_cc").contains(F.col("tok")).cast("int").alias("sub"), "w"), rank).alias("_r"),
    )
    return out.select("s1", "mid", "nm_idf_s_in_c", "nm_idf_c_in_s", "nm_idf_total1", "nm_extra_tok_idf", F.coalesce("_r.hit", F.lit(0)).alias("rare_tok_hit"), F.coalesce("_r.sub", F.lit(0)).alias("rare_tok_sub"), F.coalesce("_r.w", F.lit(0.0)).alias("rare_tok_idf"))


def competition(cands: DataFrame, score: str = "pre") -> DataFrame:
    """Adds ranks, gaps to the best and counts within each entity and each record, over all candidates at once.

    All windows of a key follow each other, so each key costs one shuffle.
    """
    if score == "pre" and "pre" not in cands.columns:
        cands = cands.withColumn("pre", F.col("name_cos") + F.col("addr_cos"))
    by_s, by_m = W.partitionBy("s1"), W.partitionBy("mid")
    names = [c for c in (score, "name_cos", "addr_cos") if c in cands.columns]
    out = cands.withColumns({f"{c}_rank_s1": F.row_number().over(by_s.orderBy(F.desc(c), "mid")) for c in names} | {f"{c}_gap_s1": F.max(c).over(by_s) - F.col(c) for c in names} | {"n_cand_s1": F.count("*").over(by_s)})
    return out.withColumns({f"{score}_rank_mid": F.row_number().over(by_m.orderBy(F.desc(score), "s1")), f"{score}_gap_mid": F.max(score).over(by_m) - F.col(score), "n_s1_for_mid": F.count("*").over(by_m)})


#: Ordered features of the pair model.
FEATURES = (
    "name_cos", "addr_cos", "nm_ratio", "nm_tset", "nm_tsort", "nm_partial", "nm_jw", "nm_lev", "nm_cpartial", "nm_canon_ratio", "ad_ratio", "ad_tset",
    "ad_partial", "ad_tsort", "nt_jacc", "nt_c_in_s", "nt_s_in_c", "nt_n1", "nt_n2", "at_jacc", "at_c_in_s", "at_s_in_c", "at_n1", "at_n2", "num_jacc",
    "num_c_in_s", "num_s_in_c", "num_n1", "num_n2", "nm_compact_eq", "nm_canon_eq", "legal_eq", "legal_both", "region_eq", "nm_s_sub_c", "nm_c_sub_s",
    "c_native", "c_alias", "c_web", "c_upper", "c_addr_null", "c_is_s3", "region_src_cand", "nm_len1", "nm_len2", "house_both", "house_eq", "house_len_eq",
    "house_perm", "house_sub", "house_last_eq", "house_gap", "house_c_in_snums", "house_s_in_cnums", "s1_cnt", "s1_cnt_region", "pool_cnt_c", "pool_cnt_s",
    "nm_idf_s_in_c", "nm_idf_c_in_s", "nm_idf_total1", "nm_extra_tok_idf", "rare_tok_hit", "rare_tok_sub", "rare_tok_idf", "pre_rank_s1", "name_cos_rank_s1",
    "addr_cos_rank_s1", "pre_gap_s1", "n_cand_s1", "pre_rank_mid", "pre_gap_mid", "n_s1_for_mid",
)
#: Features whose scale follows the size of the data set, which a model may be asked to leave out.
COUNT_FEATURES = ("s1_cnt", "s1_cnt_region", "pool_cnt_c", "pool_cnt_s", "rare_tok_idf", "nm_idf_total1", "nm_extra_tok_idf")


def build(cands: DataFrame, s1: DataFrame, pool: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(s1, mid, hit, FEATURES as floats) of all candidates (s1, mid, name_cos, addr_cos, hit)."""
    df = attach(competition(cands), s1, pool)
    idf = idf_containment(df, s1)
    df = house(flags(fuzzy(df)))
    for column, prefix in (("n_core", "nt"), ("a_tokens", "at"), ("a_nums", "num")):
        df = token_overlap(df, column, prefix)
    df = ambiguity(df, s1, pool).join(idf, ["s1", "mid"])
    return df.select("s1", "mid", "hit", *[F.col(c).cast("float").alias(c) for c in FEATURES if c not in drop])


def simple_features(df: DataFrame, *more: Column | str) -> DataFrame:
    """A small set for quick looks: overlap, edit similarity, equality; and ``more`` columns of ``df``."""
    df = token_overlap(token_overlap(df, "n_core", "nt"), "a_tokens", "at")
    return df.select("s1", "mid", "nt_jacc", "at_jacc", K.lev_sim(F.coalesce("n_compact_s", F.lit("")), F.coalesce("n_compact_c", F.lit(""))).alias("nm_lev"), _flag(F.col("a_house_s") == F.col("a_house_c")).alias("house_same"), *more)
