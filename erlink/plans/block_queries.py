"""Queries of blocking and pair features over the derived linkage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import tables as T
from ..operators import audit, exports, models, pairs
from ..operators import blocking as B
from ..sources.storage import materialize
from .fixtures import Views
from .registry import CANON, duck_list, duck_sims, duck_tokens, prepared, query


def sides(v: Views) -> tuple[DataFrame, DataFrame]:
    """Prepared entities and pool, stored once since every pass reads them."""
    return materialize(prepared(v, "lk_ref"), "s1"), materialize(prepared(v, "lk_pool"), "pool")


def _top(name: str, k: int, by: str = "s1", tie: str = "mid", hit: int | None = None) -> str:
    bits = f", CAST({hit} AS BIGINT) AS hit" if hit is not None else ""
    return f"SELECT s1, mid, cos{bits} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cos DESC, {tie}) AS r FROM {name}) WHERE r <= {k}"


_NAME = duck_sims("country, region", "n_compact", "nm")
_ADDR = duck_sims("country, region", "a_tokens", "ad")
_BLOCK = ("country", "region")


@query(CANON + _ADDR + "\nSELECT side, entity_id, term, w FROM ad_w", longs="side", doubles="w")
def tfidf_weights_word(v: Views) -> DataFrame:
    a, b = (df.withColumn("side", F.lit(i)) for i, df in enumerate(sides(v)))
    return B.weights(a.unionByName(b), _BLOCK, ("side", "entity_id"), B.words("a_tokens")).select("side", "entity_id", "term", "w")


@query(CANON + _NAME + "\nSELECT side, entity_id, term, w FROM nm_w", longs="side", doubles="w")
def tfidf_weights_char3(v: Views) -> DataFrame:
    a, b = (df.withColumn("side", F.lit(i)) for i, df in enumerate(sides(v)))
    return B.weights(a.unionByName(b), _BLOCK, ("side", "entity_id"), B.char_grams("n_compact")).select("side", "entity_id", "term", "w")


@query(CANON + _NAME + "\n" + _top("nm", 5, hit=1))
def knn_name(v: Views) -> DataFrame:
    return B.text_pass(*sides(v), "n_compact", 5)


@query(CANON + _ADDR + "\n" + _top("ad", 5, hit=2))
def knn_addr(v: Views) -> DataFrame:
    return B.text_pass(*sides(v), "a_tokens", 5, B.ADDRESS)


_COMB = duck_sims("country, region", "n_compact", "nm", least=0.0) + duck_sims("country, region", "a_tokens", "ad", least=0.0) + """,
cb AS (SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.mid, b.mid) AS mid, round((coalesce(a.raw, 0) + coalesce(b.raw, 0)) / 2, 6) AS cos FROM nm a FULL JOIN ad b ON a.s1 = b.s1 AND a.mid = b.mid)"""


@query(CANON + _COMB + "\n" + _top("(SELECT * FROM cb WHERE cos >= 0.05)", 5, hit=16), doubles="cos")
def knn_combined(v: Views) -> DataFrame:
    return B.combined_pass(*sides(v), 5)


@query(CANON + duck_sims("country", "n_compact", "fb", where_pool="region = ''") + "\n" + _top("fb", 5, hit=4))
def knn_fallback(v: Views) -> DataFrame:
    return B.fallback_pass(*sides(v), 5)


@query(CANON + ", r0 AS (SELECT * REPLACE (CASE WHEN CAST(substr(entity_id, 4) AS BIGINT) % 7 = 0 THEN '' ELSE region END AS region) FROM s1p)" + duck_sims("country", "n_compact", "rl", s1="r0", where_s1="region = ''") + "\n" + _top("rl", 5, hit=1))
def knn_regionless(v: Views) -> DataFrame:
    s1, pool = sides(v)
    lost = s1.withColumn("region", F.expr("CASE WHEN CAST(substr(entity_id, 4) AS BIGINT) % 7 = 0 THEN '' ELSE region END"))
    return B.regionless_pass(lost, pool, "n_compact", 5)


_LEAKS = ", lk AS (SELECT * FROM (VALUES ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#4')) AS t(region, m_region)), ls AS (SELECT s.* EXCLUDE (region), s.region, k.m_region FROM s1p s JOIN lk k USING (region)), lp AS (SELECT p.* EXCLUDE (region), k.region, k.m_region FROM poolp p JOIN lk k ON p.region = k.m_region)"


@query(CANON + _LEAKS + duck_sims("country, region, m_region", "n_compact", "le", s1="ls", pool="lp") + "\n" + _top("le", 5, hit=33))
def knn_leak_expansion(v: Views) -> DataFrame:
    s1, pool = sides(v)
    leaks = s1.select("country").distinct().crossJoin(v.spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "Brand#4")], "region string, m_region string"))
    return B.leak_pass(s1, pool, leaks, "n_compact", 5)


_HELD = _ADDR + ", ct AS (SELECT b.country, b.region, a.entity_id AS s1, b.entity_id AS mid, round(sum(b.w * b.w), 6) AS cos FROM ad_w a JOIN ad_w b USING (country, region, term) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL HAVING round(sum(b.w * b.w), 6) >= 0.4)"


@query(CANON + _HELD + "\n" + _top("ct", 3, by="mid", tie="s1", hit=64))
def containment_topk(v: Views) -> DataFrame:
    return B.containment_pass(*sides(v), k=3)


@query(CANON + duck_sims("country", "n_compact", "rv", where_pool="region = ''") + "\n" + _top("rv", 3, by="mid", tie="s1", hit=68))
def reverse_topk(v: Views) -> DataFrame:
    return B.reverse_pass(*sides(v), k=3)


_EXACT = """, ep AS (SELECT country, n_compact FROM poolp WHERE length(n_compact) >= 4 GROUP BY ALL HAVING count(*) <= 30), es AS (SELECT country, n_compact FROM s1p WHERE length(n_compact) >= 4 GROUP BY ALL HAVING count(*) <= 10)"""


@query(CANON + _EXACT + "\nSELECT a.entity_id AS s1, b.entity_id AS mid, a.n_compact AS n_compact, CAST(8 AS BIGINT) AS hit FROM s1p a JOIN poolp b USING (country, n_compact) WHERE (a.country, a.n_compact) IN (SELECT (country, n_compact) FROM ep) AND (a.country, a.n_compact) IN (SELECT (country, n_compact) FROM es)")
def exact_key_join(v: Views) -> DataFrame:
    return B.exact_key_pass(*sides(v))


def _gen_kind(name: str, block: str, passes: list[tuple[str, int, str, str, int]], **sides_: str) -> str:
    """CTEs of one search: sims ``{name}n`` and ``{name}a`` of all pairs that share a term, the passes' tops, and both cosines.

    A pass is (score, k, key, tie, hit).
    """
    sql = duck_sims(block, "n_compact", f"{name}n", least=0.0, **sides_) + duck_sims(block, "a_tokens", f"{name}a", least=0.0, **sides_)
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in f"{block}, s1, mid".split(","))
    keys = ", ".join(f"coalesce(a.{c.strip()}, b.{c.strip()}) AS {c.strip()}" for c in f"{block}, s1, mid".split(","))
    sql += f""",
{name}b AS (SELECT {keys}, coalesce(a.cos, 0) AS name, coalesce(b.cos, 0) AS address, round((coalesce(a.raw, 0) + coalesce(b.raw, 0)) / 2, 6) AS combined FROM {name}n a FULL JOIN {name}a b ON {on}),
{name}h AS (SELECT {block}, a.entity_id AS s1, b.entity_id AS mid, round(sum(b.w * b.w), 6) AS held FROM {name}a_w a JOIN {name}a_w b USING ({block}, term) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
{name}s AS (SELECT *, coalesce(x.held, 0) AS held_ FROM {name}b LEFT JOIN {name}h x USING ({block}, s1, mid))"""
    tops = " UNION ALL ".join(
        f"SELECT {block}, s1, mid, name, address, {hit} AS hit FROM (SELECT *, row_number() OVER (PARTITION BY {block}, {key} ORDER BY {score} DESC, {tie}) AS r FROM {name}s WHERE {score} >= {0.4 if score == 'held_' else 0.05}) WHERE r <= {k}"
        for score, k, key, tie, hit in passes
    )
    return sql + f",\n{name}t AS ({tops})"


def _union(*names: str, more: str = "") -> str:
    tops = " UNION ALL ".join(f"SELECT s1, mid, name, address, hit FROM {n}t" for n in names)
    return f",\nu AS ({tops}{more}),\ncand AS (SELECT s1, mid, max(name) AS name_cos, max(address) AS addr_cos, CAST(bit_or(hit) AS BIGINT) AS hit FROM u GROUP BY ALL)"


def _gen(k_name: int, k_addr: int, k_fallback: int) -> str:
    by_text = [("name", k_name, "s1", "mid", 1), ("address", k_addr, "s1", "mid", 2)]
    return (
        _gen_kind("kg", "country, region", by_text, where_s1="region <> ''", where_pool="region <> ''")
        + _gen_kind("kf", "country", [("name", k_fallback, "s1", "mid", 4)], where_pool="region = ''")
        + _gen_kind("kw", "country", by_text, where_s1="region = ''")
        + _union("kg", "kf", "kw")
    )


_GEN_PARTS = _gen(25, 25, 20)


def candidates(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, pool and their candidates by the default passes, all stored."""
    s1, pool = sides(v)
    return s1, pool, materialize(B.generate(s1, pool), "candidates")


#: Every pass, small numbers of neighbours so that the passes differ, and a part of the entities without a region.
_ALL_TEXT = [("name", 3, "s1", "mid", 1), ("address", 3, "s1", "mid", 2), ("combined", 3, "s1", "mid", 16)]
_EVERY_PASS = (
    ", r0 AS (SELECT * REPLACE (CASE WHEN length(n_compact) % 7 = 0 THEN '' ELSE region END AS region) FROM s1p)"
    ", ls AS (SELECT s.*, k.m_region FROM r0 s JOIN lk k USING (region)), lp AS (SELECT p.* EXCLUDE (region), k.region, k.m_region FROM poolp p JOIN lk k ON p.region = k.m_region)"
    + _gen_kind("kg", "country, region", [*_ALL_TEXT, ("held_", 2, "mid", "s1", 64)], s1="r0", where_s1="region <> ''", where_pool="region <> ''")
    + _gen_kind("kf", "country", [("name", 2, "s1", "mid", 4), ("name", 2, "mid", "s1", 68)], s1="r0", where_pool="region = ''")
    + _gen_kind("kw", "country", _ALL_TEXT, s1="r0", where_s1="region = ''")
    + _gen_kind("kl", "country, region, m_region", [(a, b, c, d, e | 32) for a, b, c, d, e in _ALL_TEXT], s1="ls", pool="lp")
    + _EXACT
    + """, ex AS (SELECT a.entity_id AS s1, b.entity_id AS mid, country, a.a_tokens AS x, b.a_tokens AS y FROM s1p a JOIN poolp b USING (country, n_compact) WHERE (a.country, a.n_compact) IN (SELECT (country, n_compact) FROM ep) AND (a.country, a.n_compact) IN (SELECT (country, n_compact) FROM es)),
exd AS (SELECT country, s1, mid, 0 AS side, x AS t FROM ex UNION ALL SELECT country, s1, mid, 1, y FROM ex), exn AS (SELECT country, count(*) AS n FROM exd GROUP BY ALL),
ext AS (SELECT country, s1, mid, side, term, count(*) AS tf FROM (SELECT * EXCLUDE (t), unnest(list_filter(string_split(t, ' '), lambda z: z <> '')) AS term FROM exd) GROUP BY ALL), exf AS (SELECT country, term, count(*) AS df FROM ext GROUP BY ALL),
exx AS (SELECT country, s1, mid, side, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM ext JOIN exf USING (country, term) JOIN exn USING (country)), exw AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY s1, mid, side)) AS w FROM exx),
exc AS (SELECT a.s1, a.mid, round(sum(a.w * b.w), 6) AS cos FROM exw a JOIN exw b USING (s1, mid, term) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)"""
    + _union("kg", "kf", "kw", "kl", more=" UNION ALL SELECT ex.s1, ex.mid, 1.0, coalesce(cos, 0), 8 FROM ex LEFT JOIN exc USING (s1, mid)")
)


@query(CANON + ", lk AS (SELECT * FROM (VALUES ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#4')) AS t(region, m_region))" + _EVERY_PASS + "\nSELECT s1, mid, name_cos, addr_cos, hit FROM cand", doubles="name_cos addr_cos")
def candidate_union_all(v: Views) -> DataFrame:
    s1, pool = sides(v)
    lost = s1.withColumn("region", F.expr("IF(char_length(n_compact) % 7 = 0, '', region)"))
    leaks = s1.select("country").distinct().withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("region"), F.lit(b).alias("m_region")) for a, b in (("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"))]))).select("country", "p.*")
    return B.generate(lost, pool, 3, 3, 2, 3, 2, 2, leaks, True)


@query(CANON + _GEN_PARTS + "\nSELECT s1, mid, name_cos, addr_cos, hit FROM cand", doubles="name_cos addr_cos")
def candidate_union_bits(v: Views) -> DataFrame:
    return candidates(v)[2]


@query(CANON + _GEN_PARTS + """, h AS (SELECT c.hit FROM (SELECT DISTINCT s1, mid FROM lk_truth) t LEFT JOIN cand c USING (s1, mid))
SELECT b AS "pass", count(*) AS pairs, count(*) FILTER (WHERE hit IS NOT NULL AND (b = 0 OR hit & b > 0)) AS found, count(*) FILTER (WHERE hit IS NOT NULL AND (b = 0 OR hit & b > 0)) / count(*) AS recall FROM h, (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64]) AS b) GROUP BY b""".replace('AS "pass"', "AS pass_"), longs="pass_", doubles="recall")
def blocking_recall(v: Views) -> DataFrame:
    return B.recall(candidates(v)[2], v("lk_truth")).withColumnRenamed("pass", "pass_")


@query(CANON + _NAME + ", k AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, mid) AS rk FROM nm), t AS (SELECT k.rk FROM (SELECT DISTINCT s1, mid FROM lk_truth) x LEFT JOIN k USING (s1, mid))\nSELECT n AS k, avg(CAST(coalesce(rk <= n, false) AS INTEGER)) AS recall FROM t, (SELECT unnest([1, 3, 5, 10]) AS n) GROUP BY n", longs="k", doubles="recall")
def knn_recall_at_k(v: Views) -> DataFrame:
    return B.recall_at(B.text_pass(*sides(v), "n_compact", 10), v("lk_truth"), [1, 3, 5, 10])


@query(CANON + _gen(1, 1, 1) + ", m AS (SELECT DISTINCT s1, mid FROM lk_truth WHERE (s1, mid) NOT IN (SELECT (s1, mid) FROM cand))\nSELECT CASE WHEN a.region = '' OR b.region = '' THEN 'no region' WHEN a.region = b.region THEN 'same region' ELSE 'other region' END AS relation, count(*) AS n FROM m JOIN s1p a ON a.entity_id = s1 JOIN poolp b ON b.entity_id = mid GROUP BY 1")
def blocking_misses(v: Views) -> DataFrame:
    s1, pool = sides(v)
    return B.missed(v("lk_truth"), B.generate(s1, pool, 1, 1, 1), s1, pool)


@query("""SELECT label, s1, mid, cos FROM (SELECT a.label, a.vec_id AS s1, b.vec_id AS mid, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE r <= 3""", longs="label")
def knn_embeddings(v: Views) -> DataFrame:
    return B.dense_top_k(v("embeddings"), 3)


# Pair features.

#: The candidates with the columns of both sides, as CTEs of an oracle.
_SIDE = ("name", "address", "country", "region", "n_canon", "n_core", "n_compact", "n_legal", "n_native", "n_alias", "n_web", "n_upper", "a_tokens", "a_nums", "a_house", "a_null")
_PAIRS = _GEN_PARTS + ", atx AS (SELECT s1, mid, " + ", ".join(f"a.{c} AS {c}_s, b.{c} AS {c}_c" for c in _SIDE) + " FROM cand JOIN s1p a ON a.entity_id = s1 JOIN poolp b ON b.entity_id = mid)"
FEATURES_SQL = _PAIRS


def feature_pairs(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, pool, and all candidates with the columns of both sides."""
    s1, pool, cand = candidates(v)
    return s1, pool, pairs.attach(cand.select("s1", "mid"), s1, pool, (*pairs.RECORD, "address"))


def _overlap(column: str, p: str) -> str:
    a, b = (f"list_distinct({duck_tokens(column + e)})" for e in ("_s", "_c"))
    i = f"len(list_intersect({a}, {b}))"
    return f"{i} / greatest(len({a}) + len({b}) - {i}, 1) AS {p}_jacc, {i} / greatest(len({b}), 1) AS {p}_c_in_s, {i} / greatest(len({a}), 1) AS {p}_s_in_c, len({a}) AS {p}_n1, len({b}) AS {p}_n2"


_SETS = (("n_core", "nt"), ("a_tokens", "at"), ("a_nums", "num"))


@query(CANON + _PAIRS + "\nSELECT s1, mid, " + ", ".join(_overlap(c, p) for c, p in _SETS) + " FROM atx", longs=" ".join(f"{p}_n1 {p}_n2" for _, p in _SETS), doubles=" ".join(f"{p}_jacc {p}_c_in_s {p}_s_in_c" for _, p in _SETS))
def feat_token_sets(v: Views) -> DataFrame:
    df = feature_pairs(v)[2]
    for c, p in _SETS:
        df = pairs.token_overlap(df, c, p)
    return df.select("s1", "mid", *[f"{p}_{x}" for _, p in _SETS for x in ("jacc", "c_in_s", "s_in_c", "n1", "n2")])


_FLAGS = {
    "nm_compact_eq": "n_compact_s = n_compact_c", "nm_canon_eq": "n_canon_s = n_canon_c", "legal_eq": "n_legal_s = n_legal_c", "legal_both": "n_legal_s <> '' AND n_legal_c <> ''", "region_eq": "region_s = region_c",
    "c_is_s3": "starts_with(mid, 'S3')", "c_alias": "n_alias_c = 1", "c_web": "n_web_c = 1", "c_upper": "n_upper_c = 1", "c_addr_null": "a_null_c = 1",
}


@query(CANON + _PAIRS + "\nSELECT s1, mid, " + ", ".join(f"CAST({e} AS INTEGER) AS {k}" for k, e in _FLAGS.items()) + ", length(n_compact_s) AS nm_len1, length(n_compact_c) AS nm_len2 FROM atx", longs=" ".join(_FLAGS) + " nm_len1 nm_len2")
def feat_flags(v: Views) -> DataFrame:
    return pairs.flags(feature_pairs(v)[2].withColumn("region_src_c", F.lit(0))).select("s1", "mid", *_FLAGS, "nm_len1", "nm_len2")


@query(CANON + _PAIRS + "\nSELECT s1, mid, CAST(contains(n_compact_c, n_compact_s) AS INTEGER) AS nm_s_sub_c, CAST(contains(n_compact_s, n_compact_c) AS INTEGER) AS nm_c_sub_s FROM atx", longs="nm_s_sub_c nm_c_sub_s")
def feat_substring(v: Views) -> DataFrame:
    return pairs.flags(feature_pairs(v)[2].withColumn("region_src_c", F.lit(0))).select("s1", "mid", "nm_s_sub_c", "nm_c_sub_s")


_B = "a_house_s <> '' AND a_house_c <> ''"
_SORTED = "array_to_string(list_sort(string_split({0}, '')), '')"
_HOUSE = {
    "house_both": _B, "house_eq": f"{_B} AND a_house_s = a_house_c", "house_len_eq": f"{_B} AND length(a_house_s) = length(a_house_c)", "house_perm": f"{_B} AND {_SORTED.format('a_house_s')} = {_SORTED.format('a_house_c')}",
    "house_sub": f"{_B} AND (contains(a_house_s, a_house_c) OR contains(a_house_c, a_house_s))", "house_last_eq": f"{_B} AND right(a_house_s, 1) = right(a_house_c, 1)",
    "house_c_in_snums": "list_contains(string_split(a_nums_s, ' '), a_house_c)", "house_s_in_cnums": "list_contains(string_split(a_nums_c, ' '), a_house_s)",
}


@query(CANON + _PAIRS + "\nSELECT s1, mid, " + ", ".join(f"CAST({e} AS INTEGER) AS {k}" for k, e in _HOUSE.items()) + f", CASE WHEN {_B} THEN ln(1 + abs(CAST(left(a_house_s, 9) AS BIGINT) - CAST(left(a_house_c, 9) AS BIGINT))) ELSE -1 END AS house_gap FROM atx", longs=" ".join(_HOUSE), doubles="house_gap")
def feat_house(v: Views) -> DataFrame:
    return pairs.house(feature_pairs(v)[2]).select("s1", "mid", *_HOUSE, "house_gap")


@query(CANON + _PAIRS + "\nSELECT s1, mid, 1 - levenshtein(n_compact_s, n_compact_c) / greatest(length(n_compact_s), length(n_compact_c), 1) AS nm_lev FROM atx", doubles="nm_lev")
def feat_lev(v: Views) -> DataFrame:
    return feature_pairs(v)[2].select("s1", "mid", K.lev_sim(F.col("n_compact_s"), F.col("n_compact_c")).alias("nm_lev"))


@query(None)
def feat_fuzzy_ratios(v: Views) -> DataFrame:
    return pairs.fuzzy(feature_pairs(v)[2]).select("s1", "mid", "nm_ratio", "nm_tset", "nm_tsort", "nm_partial", "nm_jw", "nm_cpartial", "nm_canon_ratio", "ad_ratio", "ad_tset", "ad_partial", "ad_tsort")


@query(CANON + _PAIRS + """, k1 AS (SELECT country, n_compact, count(*) AS n FROM s1p GROUP BY ALL), k2 AS (SELECT country, region, n_compact, count(*) AS n FROM s1p GROUP BY ALL), k3 AS (SELECT country, n_compact, count(*) AS n FROM poolp WHERE n_compact <> '' GROUP BY ALL)
SELECT s1, mid, coalesce(k1.n, 0) AS s1_cnt, coalesce(k2.n, 0) AS s1_cnt_region, coalesce(k3.n, 0) AS pool_cnt_c, coalesce(k4.n, 0) AS pool_cnt_s FROM atx LEFT JOIN k1 ON k1.country = country_s AND k1.n_compact = n_compact_s LEFT JOIN k2 ON k2.country = country_s AND k2.region = region_s AND k2.n_compact = n_compact_s
LEFT JOIN k3 ON k3.country = country_c AND k3.n_compact = n_compact_c LEFT JOIN k3 k4 ON k4.country = country_s AND k4.n_compact = n_compact_s""")
def feat_ambiguity(v: Views) -> DataFrame:
    s1, pool, df = feature_pairs(v)
    return pairs.ambiguity(df, s1, pool).select("s1", "mid", "s1_cnt", "s1_cnt_region", "pool_cnt_c", "pool_cnt_s")


_IDF = f""", sz AS (SELECT country, count(*) AS n FROM s1p GROUP BY ALL), idf AS (SELECT country, tok, ln(n / df) AS idf FROM (SELECT country, tok, count(*) AS df FROM (SELECT country, unnest(list_distinct({duck_tokens('n_core')})) AS tok FROM s1p) GROUP BY ALL) JOIN sz USING (country)),
tk AS (SELECT s1, mid, country_s AS country, n_compact_c AS cc, list_distinct({duck_tokens('n_core_s')}) AS a, list_distinct({duck_tokens('n_core_c')}) AS b FROM atx),
lg AS (SELECT s1, mid, cc, country, a, b, unnest(list_distinct(list_concat(a, b))) AS tok FROM tk),
wt AS (SELECT s1, mid, cc, lg.tok, list_contains(a, lg.tok) AS in_a, list_contains(b, lg.tok) AS in_b, coalesce(idf, ln(n)) AS w FROM lg LEFT JOIN idf ON idf.country = lg.country AND idf.tok = lg.tok JOIN sz ON sz.country = lg.country)"""


@query(CANON + _PAIRS + _IDF + """
SELECT s1, mid, coalesce(sum(w) FILTER (WHERE in_a AND in_b), 0) / greatest(coalesce(sum(w) FILTER (WHERE in_a), 0), 1e-6) AS nm_idf_s_in_c, coalesce(sum(w) FILTER (WHERE in_a AND in_b), 0) / greatest(coalesce(sum(w) FILTER (WHERE in_b), 0), 1e-6) AS nm_idf_c_in_s,
  coalesce(sum(w) FILTER (WHERE in_a), 0) AS nm_idf_total1, coalesce(max(w) FILTER (WHERE in_b AND NOT in_a), 0) AS nm_extra_tok_idf FROM wt GROUP BY s1, mid""", doubles="nm_idf_s_in_c nm_idf_c_in_s nm_idf_total1 nm_extra_tok_idf")
def feat_idf_containment(v: Views) -> DataFrame:
    s1, _, df = feature_pairs(v)
    return pairs.idf_containment(df, s1).select("s1", "mid", "nm_idf_s_in_c", "nm_idf_c_in_s", "nm_idf_total1", "nm_extra_tok_idf")


@query(CANON + _PAIRS + _IDF + ", rk AS (SELECT *, row_number() OVER (PARTITION BY s1, mid ORDER BY w DESC, tok DESC) AS r FROM wt WHERE in_a)\nSELECT s1, mid, CAST(in_b AS INTEGER) AS rare_tok_hit, CAST(contains(cc, tok) AS INTEGER) AS rare_tok_sub, w AS rare_tok_idf FROM rk WHERE r = 1", longs="rare_tok_hit rare_tok_sub", doubles="rare_tok_idf")
def feat_rare_token(v: Views) -> DataFrame:
    s1, _, df = feature_pairs(v)
    return pairs.idf_containment(df, s1).select("s1", "mid", "rare_tok_hit", "rare_tok_sub", "rare_tok_idf")


def _jacc(column: str) -> str:
    a, b = (f"list_distinct({duck_tokens(column + e)})" for e in ("_s", "_c"))
    return f"len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}) - len(list_intersect({a}, {b})), 1)"


@query(CANON + _PAIRS + f"\nSELECT s1, mid, {_jacc('n_core')} AS nt_jacc, {_jacc('a_tokens')} AS at_jacc, 1 - levenshtein(n_compact_s, n_compact_c) / greatest(length(n_compact_s), length(n_compact_c), 1) AS nm_lev, CAST(a_house_s = a_house_c AS INTEGER) AS house_same FROM atx", longs="house_same", doubles="nt_jacc at_jacc nm_lev")
def feat_simple(v: Views) -> DataFrame:
    return pairs.simple_features(feature_pairs(v)[2])


@query(None)
def feat_all(v: Views) -> DataFrame:
    s1, pool, cand = candidates(v)
    return pairs.build(cand, s1.withColumn("region_src", F.lit(2)), pool.withColumn("region_src", F.lit(2)))


@query("""SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, mid) AS p_rank_s1, max(p) OVER (PARTITION BY s1) - p AS p_gap_s1, count(*) OVER (PARTITION BY s1) AS n_cand_s1, row_number() OVER (PARTITION BY mid ORDER BY p DESC, s1) AS p_rank_mid, max(p) OVER (PARTITION BY mid) - p AS p_gap_mid, count(*) OVER (PARTITION BY mid) AS n_s1_for_mid FROM cs_pairs""", doubles="p_gap_s1 p_gap_mid")
def ctx_competition(v: Views) -> DataFrame:
    return pairs.competition(v("cs_pairs"), "p").drop("country", "region", "p")


# Looks at linkage without a model.


def duck_lev(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


_S, _R = f"list_distinct({duck_tokens('n_core_s')})", f"list_distinct({duck_tokens('n_core_c')})"
_NOISE = duck_list(T.NOISE_WORDS)
_AD = f"100 * {duck_lev('a_tokens_s', 'a_tokens_c')}"
_CELLS = _PAIRS + f""", rl AS (SELECT *, {_S} AS s_, {_R} AS r_ FROM atx), rm AS (SELECT *, list_filter(r_, lambda x: NOT list_contains(s_, x)) AS new_, list_filter(s_, lambda x: NOT list_contains(r_, x)) AS rem FROM rl),
ro AS (SELECT *, list_filter(new_, lambda x: NOT list_contains({_NOISE}, x)) AS other FROM rm),
cl AS (SELECT s1, mid, CASE WHEN a_null_c = 1 THEN 'no_addr' WHEN {_B} AND a_house_s = a_house_c AND {_AD} >= 90 THEN 'exact' WHEN {_B} AND a_house_s <> a_house_c AND {_AD} >= 80 THEN 'other_house' WHEN {_AD} >= 70 THEN 'close' ELSE 'far' END AS address,
  CASE WHEN len(r_) = 0 THEN 'empty' WHEN len(new_) = 0 AND len(rem) = 0 THEN 'same' WHEN len(new_) = 0 THEN 'drop' WHEN len(other) = 0 THEN 'drop_noise' WHEN len(list_intersect(s_, r_)) = 0 THEN 'no_shared'
    WHEN len(list_filter(other, lambda w: len(list_filter(rem, lambda x: {duck_lev('w', 'x')} >= 0.75)) = 0)) = 0 THEN 'typo' ELSE 'added' END AS name FROM ro),
cells AS (SELECT address, name, count(*) AS n, count(t.s1) AS "true", 1000 * count(*) / (SELECT count(DISTINCT s1) FROM cl) AS per_1k FROM cl LEFT JOIN (SELECT DISTINCT s1, mid FROM lk_truth) t USING (s1, mid) GROUP BY address, name)"""


def _texts(v: Views) -> DataFrame:
    from ..operators.decide import attach_texts

    s1, pool, df = feature_pairs(v)
    return attach_texts(df.select("s1", "mid"), s1, pool, "levenshtein")


@query(CANON + _CELLS + '\nSELECT address, name, n, "true" AS trues, per_1k FROM cells', doubles="per_1k")
def pattern_cells(v: Views) -> DataFrame:
    return audit.pattern_cells(_texts(v), v("lk_truth"), "levenshtein").withColumnRenamed("true", "trues")


@query(CANON + _CELLS + "\nSELECT address, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE name = '{k}'), 0) AS {k}" for k in audit.NAME_RELATIONS) + " FROM cells GROUP BY address", longs=" ".join(audit.NAME_RELATIONS))
def pattern_pivot(v: Views) -> DataFrame:
    return audit.pattern_pivot(audit.pattern_cells(_texts(v), v("lk_truth"), "levenshtein"))


@query(CANON + _PAIRS + f""", hk AS (SELECT country, a_tokens, a_house, count(*) AS k FROM s1p GROUP BY ALL HAVING count(*) >= 2),
hb AS (SELECT s1, mid, k, len(list_intersect(r, list_distinct({duck_tokens('h.n_core')}))) AS both_, len(r) AS n FROM (SELECT s1, mid, list_filter({_R}, lambda x: NOT list_contains({_NOISE}, x)) AS r FROM atx) JOIN s1p o ON o.entity_id = s1 JOIN hk USING (country, a_tokens, a_house) JOIN s1p h USING (country, a_tokens, a_house))
SELECT s1, mid, any_value(k) AS at_address, CASE WHEN max(both_) = 0 THEN any_value(k) ELSE count(*) FILTER (WHERE both_ = n OR both_ >= greatest(1, n - 1)) END AS compatible FROM hb GROUP BY s1, mid""")
def hub_ambiguity(v: Views) -> DataFrame:
    s1, _, df = feature_pairs(v)
    return audit.hub_ambiguity(df.select("s1", "mid", F.col("n_core_c").alias("c2")), s1)


@query(CANON + _PAIRS + f""", ck AS (SELECT country, n_compact, count(*) AS k FROM s1p GROUP BY ALL HAVING count(*) BETWEEN 2 AND 300), cm AS (SELECT s1p.*, k FROM s1p JOIN ck USING (country, n_compact) WHERE a_null = 0),
nc AS (SELECT atx.s1, atx.mid, h.k, h.entity_id AS e, 100 * {duck_lev('h.a_tokens', 'a_tokens_c')} + CASE WHEN h.a_house = a_house_c AND a_house_c <> '' THEN 5 ELSE 0 END AS x FROM atx JOIN cm o ON o.entity_id = atx.s1 JOIN cm h ON h.country = o.country AND h.n_compact = o.n_compact WHERE a_null_c = 0)
SELECT s1, mid, max(k) AS members, max(x) FILTER (WHERE e = s1) AS own, max(x) FILTER (WHERE e <> s1) AS best_other, max(x) FILTER (WHERE e <> s1) - max(x) FILTER (WHERE e = s1) AS gap FROM nc GROUP BY s1, mid HAVING count(*) FILTER (WHERE e <> s1) > 0""", doubles="own best_other gap")
def name_class(v: Views) -> DataFrame:
    s1, _, df = feature_pairs(v)
    return audit.name_class(df.select("s1", "mid", F.col("a_tokens_c").alias("a2"), F.col("a_house_c").alias("h2"), F.col("a_null_c").alias("null2")), s1, "levenshtein")


@query(CANON + _GEN_PARTS + """, one AS (SELECT country, n_compact, a_tokens, a_house, min(entity_id) AS s1 FROM s1p WHERE a_null = 0 GROUP BY ALL HAVING count(*) = 1), cp AS (SELECT p.entity_id AS mid, s1 FROM poolp p JOIN one USING (country, n_compact, a_tokens, a_house) WHERE a_null = 0)
SELECT CASE WHEN t.s1 IS NOT NULL THEN 'accepted' WHEN c.s1 IS NOT NULL THEN 'candidate' ELSE 'missed' END AS fate, count(*) AS n FROM cp LEFT JOIN cand c USING (s1, mid) LEFT JOIN (SELECT DISTINCT s1, mid FROM lk_truth WHERE starts_with(mid, 'S2')) t USING (s1, mid) GROUP BY 1""")
def obvious_copies(v: Views) -> DataFrame:
    s1, pool, cand = candidates(v)
    return audit.obvious_copies(s1, pool, cand, v("lk_truth").where("mid LIKE 'S2%'"))


_W = "unnest(list_distinct(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ')))"


@query(f""", pw AS (SELECT * FROM (SELECT entity_id, country, {_W.format('name')} AS t FROM lk_pool) WHERE length(t) >= 4), sw AS (SELECT DISTINCT country, t FROM (SELECT country, {_W.format("name || ' ' || address")} AS t FROM lk_ref)),
nz AS (SELECT * FROM pw WHERE (country, t) NOT IN (SELECT (country, t) FROM sw)), rr AS (SELECT country, t, count(*) AS df FROM nz GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60), rw AS (SELECT nz.*, df, o.s1 AS owner FROM nz JOIN rr USING (country, t) LEFT JOIN lk_truth o ON o.mid = nz.entity_id),
pr AS (SELECT a.entity_id AS a, b.entity_id AS b, min(a.df) AS df, min(a.owner) AS oa, min(b.owner) AS ob FROM rw a JOIN rw b USING (country, t) WHERE a.entity_id < b.entity_id GROUP BY 1, 2)
SELECT df, count(*) AS pairs, count(*) FILTER (WHERE oa IS NOT NULL AND ob IS NOT NULL) AS owned, count(*) FILTER (WHERE oa = ob) AS same_owner FROM pr GROUP BY df""")
def shared_noise(v: Views) -> DataFrame:
    return audit.shared_noise(v("lk_pool"), v("lk_ref"), v("lk_truth"), most=60)


@query("SELECT s1, min(mid) AS mid FROM lk_truth GROUP BY s1 HAVING count(*) = 1")
def single_match(v: Views) -> DataFrame:
    return audit.single_match(v("lk_truth"))


@query(CANON + _PAIRS + """
SELECT substr(mid, 1, 2) AS source, count(*) AS n, """ + ", ".join(f"round(avg(CAST(coalesce({e}, false) AS INTEGER)), 6) AS {k}" for k, e in {
    "same_name": "name_s = name_c", "case_only": "lower(name_s) = lower(name_c) AND name_s <> name_c", "upper": "upper(name_c) = name_c AND upper(name_s) <> name_s", "alias": "n_alias_c = 1", "web": "n_web_c = 1", "legal_added": "n_legal_s = '' AND n_legal_c <> ''",
    "same_compact": "n_compact_s = n_compact_c", "null_address": "address_c IS NULL", "same_address": "coalesce(address_s, '') = coalesce(address_c, '')", "null_word": "regexp_matches(coalesce(address_c, ''), '(?i)<null>|n/a')", "same_house": "a_house_s = a_house_c", "same_tokens": "a_tokens_s = a_tokens_c",
    "reordered": f"list_sort({duck_tokens('a_tokens_s')}) = list_sort({duck_tokens('a_tokens_c')}) AND a_tokens_s <> a_tokens_c",
}.items()) + " FROM atx GROUP BY 1")
def noise_catalogue(v: Views) -> DataFrame:
    return audit.noise_catalogue(feature_pairs(v)[2])


@query(None)
def typo_swaps(v: Views) -> DataFrame:
    from ..operators.decide import attach_texts

    s1, swaps = sides(v)[0], materialize(prepared(v, "lk_swaps"), "swaps")
    return audit.typo_swaps(attach_texts(v("lk_swap_pairs"), s1, swaps), s1, 5)


@query(None)
def synthetic_pairs(v: Views) -> DataFrame:
    return exports.synthetic_pairs(v("lk_ref"))


@query("SELECT t.s1, t.mid, a.name || ' | ' || a.address AS text_a, b.name || ' | ' || coalesce(b.address, '') AS text_b FROM lk_truth t JOIN lk_ref a ON a.entity_id = t.s1 JOIN lk_pool b ON b.entity_id = t.mid")
def text_attach(v: Views) -> DataFrame:
    return exports.attach_raw(v("lk_truth"), v("lk_ref"), v("lk_pool"))


@query(CANON + "\nSELECT t.s1, t.mid, a.n_canon || ' ; ' || a.a_tokens AS text_a, b.n_canon || ' ; ' || b.a_tokens AS text_b FROM lk_truth t JOIN s1p a ON a.entity_id = t.s1 JOIN poolp b ON b.entity_id = t.mid")
def text_attach_canonical(v: Views) -> DataFrame:
    s1, pool = sides(v)
    return exports.attach_canonical(v("lk_truth"), s1, pool)


@query(None)
def plugin_scores(v: Views) -> DataFrame:
    return models.score_texts(exports.attach_raw(v("lk_truth"), v("lk_ref"), v("lk_pool")), models.HashedOverlapScorer())
