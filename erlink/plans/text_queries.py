"""Queries of canonicalisation, profiles, learned tables and relational basics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import tables as T
from ..functions import text as X
from ..functions.rounding import rounded
from ..operators import audit, exports, learn
from .fixtures import Views
from .registry import CANON, duck_basic, duck_list, duck_map, duck_tokens, prepared, query

_FOLD = "replace(replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th')"


@query(f"SELECT doc_id, {duck_basic(_FOLD.format('text'))} AS basic FROM documents")
def norm_basic(v: Views) -> DataFrame:
    return v("documents").select("doc_id", X.basic(F.col("text")).alias("basic"))


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def norm_fold_accents(v: Views) -> DataFrame:
    return v("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query(CANON + "\nSELECT entity_id, n_legal FROM poolp")
def norm_legal(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").select("entity_id", "n_legal")


@query(CANON + "\nSELECT entity_id, n_canon, n_core FROM poolp UNION ALL SELECT entity_id, n_canon, n_core FROM s1p")
def norm_core_name(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").unionByName(prepared(v, "lk_ref")).select("entity_id", "n_canon", "n_core")


@query(CANON + "\nSELECT entity_id, n_compact, n_native, n_alias, n_web, n_upper FROM poolp", longs="n_native n_alias n_web n_upper")
def norm_compact(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").select("entity_id", "n_compact", "n_native", "n_alias", "n_web", "n_upper")


@query(f"SELECT entity_id, CASE WHEN regexp_matches(name, '{T.ALIAS}') THEN regexp_extract(name, '{T.ALIAS}', 2) ELSE name END AS resolved, CAST(regexp_matches(name, '{T.ALIAS}') AS BIGINT) AS is_alias FROM lk_pool")
def norm_alias(v: Views) -> DataFrame:
    return v("lk_pool").select("entity_id", X.resolve_alias(F.col("name")).alias("resolved"), X.is_alias(F.col("name")).cast("int").alias("is_alias"))


_SITE = "regexp_extract(url, '^(https?://[^/]+)', 1)"


@query(f"SELECT page_id, CASE WHEN regexp_matches({_SITE}, '{T.URL_NAME}') THEN replace(replace(regexp_extract({_SITE}, '{T.URL_NAME}', 1), '-', ''), '.', ' ') ELSE {_SITE} END AS stem FROM pages")
def norm_url_stem(v: Views) -> DataFrame:
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return v("pages").select("page_id", X.url_stem(site).alias("stem"))


@query(", x AS (SELECT entity_id, name || ' | www.' || replace(name, ' ', '') || '.com' AS s, name FROM lk_ref)\nSELECT entity_id, name AS segment FROM x")
def norm_pipe(v: Views) -> DataFrame:
    s = F.concat("name", F.lit(" | www."), F.replace("name", F.lit(" "), F.lit("")), F.lit(".com"))
    return v("lk_ref").select("entity_id", X.pipe_segment(s).alias("segment"))


_LEET = f"CASE WHEN length(regexp_replace(x, '[^a-z]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN translate(x, '{T.LEET_DIGITS}', '{T.LEET_LETTERS}') ELSE x END"


@query(f"SELECT entity_id, array_to_string(list_transform({duck_tokens(duck_basic('name'))}, lambda x: {_LEET}), ' ') AS fixed FROM lk_pool")
def norm_leet(v: Views) -> DataFrame:
    return v("lk_pool").select("entity_id", F.array_join(F.transform(X.tokens(X.basic(F.col("name"))), X.fix_leet), " ").alias("fixed"))


@query("SELECT entity_id, 'abc ' || lower(name) || ' 1 de' AS joined FROM lk_ref")
def norm_initials(v: Views) -> DataFrame:
    return v("lk_ref").select("entity_id", X.collapse_initials(F.concat(F.lit("a b c "), F.lower("name"), F.lit(" 1 d e"))).alias("joined"))


@query(CANON + "\nSELECT entity_id, a_tokens, a_null FROM poolp", longs="a_null")
def addr_tokens(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").select("entity_id", "a_tokens", "a_null")


@query(CANON + "\nSELECT entity_id, a_nums FROM poolp")
def addr_numbers(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").select("entity_id", "a_nums")


@query(CANON + "\nSELECT entity_id, a_house FROM poolp UNION ALL SELECT entity_id, a_house FROM s1p")
def addr_house(v: Views) -> DataFrame:
    return prepared(v, "lk_pool").unionByName(prepared(v, "lk_ref")).select("entity_id", "a_house")


#: The fixture's regions under the aliases that its addresses use.
BRANDS = {"*": {f"brand {i}": f"Brand#{i}" for i in range(1, 26)}}
_HITS = f"list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda p: {duck_map(BRANDS['*'])}[{duck_basic('p')}]), lambda r: r IS NOT NULL)"


@query(f"SELECT entity_id, coalesce({_HITS}[1], '') AS region, CASE WHEN len({_HITS}) > 0 THEN 2 ELSE 0 END AS region_src FROM lk_pool", longs="region_src")
def addr_region(v: Views) -> DataFrame:
    return X.canon_addresses(v("lk_pool").drop("region"), regions=BRANDS).select("entity_id", "region", "region_src")


_LAST = f"list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda p: {duck_basic('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '[0-9]'))"


@query(f"SELECT entity_id, {_LAST}[-1] AS place FROM lk_pool")
def addr_last_place(v: Views) -> DataFrame:
    return v("lk_pool").select("entity_id", X.last_place(F.col("address")).alias("place"))


@query(f", c AS (SELECT DISTINCT c_name FROM customer)\nSELECT c_name, array_to_string(list_transform(list_filter({duck_tokens(duck_basic('c_name'))}, lambda x: NOT list_contains({duck_list(T.PLACE_STOP_WORDS)}, x)), lambda x: coalesce({duck_map(T.STREET)}[x], x)), ' ') AS key FROM c")
def place_keys(v: Views) -> DataFrame:
    return v("customer").select("c_name").distinct().select("c_name", X.place_key(F.col("c_name")).alias("key"))


_PROFILE = X.PATTERNS | {k: f"[{s}]" for k, s in X.SCRIPTS.items()}


@query("SELECT lang, count(*) AS n, " + ", ".join(f"round(avg(CAST(coalesce(regexp_matches(text, '{rx.replace(chr(39), chr(39) * 2)}'), false) AS INTEGER)), 6) AS \"{k}\"" for k, rx in _PROFILE.items()) + " FROM documents GROUP BY lang")
def profile_patterns(v: Views) -> DataFrame:
    return X.profile(v("documents"), "text", "lang")


@query("SELECT 'o_custkey' AS \"column\", count(*) AS rows, count(*) - count(o_custkey) AS nulls, count(DISTINCT o_custkey) AS \"distinct\" FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders")
def structure_overview(v: Views) -> DataFrame:
    return audit.structure(v("orders"), ["o_custkey", "o_orderpriority"])


@query(", c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)\nSELECT least(n, 15) AS k, count(*) AS n FROM c GROUP BY 1")
def cardinality_hist(v: Views) -> DataFrame:
    return learn.count_histogram(v("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", 16)


@query("SELECT corr(CAST(o_orderkey AS DOUBLE), CAST(o_custkey AS DOUBLE)) AS r_key, corr(CAST(o_orderkey AS DOUBLE), o_totalprice) AS r_price FROM orders", doubles="r_key r_price")
def id_correlation(v: Views) -> DataFrame:
    return v("orders").agg(F.corr("o_orderkey", "o_custkey").alias("r_key"), F.corr("o_orderkey", "o_totalprice").alias("r_price"))


@query(", x AS (SELECT name, region, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS t FROM lk_pool GROUP BY name, region), r AS (SELECT *, n / t AS share, row_number() OVER (PARTITION BY name ORDER BY n DESC, region) AS k FROM x)\nSELECT name, region, n, share FROM r WHERE k = 1 AND n >= 2", doubles="share")
def dict_argmax(v: Views) -> DataFrame:
    return learn.most_frequent(v("lk_pool"), ["name"], "region", 2)


_NAMED = f"list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda p: {duck_map(BRANDS['*'])}[{duck_basic('p')}]), lambda r: r IS NOT NULL)[1]"


@query(
    f""", n AS (SELECT country, {_NAMED} AS region, string_split(address, ',') AS parts FROM lk_ref WHERE {_NAMED} IS NOT NULL),
p AS (SELECT country, region, unnest(list_filter(list_transform(parts, lambda p: {duck_basic('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '[0-9]'))) AS city FROM n),
c0 AS (SELECT country, city, region, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT *, n / sum(n) OVER (PARTITION BY country, city) AS share FROM c0),
r AS (SELECT *, row_number() OVER (PARTITION BY country, city ORDER BY n DESC, region) AS k FROM c)
SELECT country, city, region, n, share FROM r WHERE k = 1 AND n >= 3""",
    doubles="share",
)
def dict_city_region(v: Views) -> DataFrame:
    return learn.city_regions(v("lk_ref"), BRANDS, least=3, purity=0.0)


@query(", p AS (SELECT r.country, r.region, l.region AS m_region FROM lk_truth t JOIN lk_ref r ON r.entity_id = t.s1 JOIN lk_leaky l ON l.entity_id = t.mid WHERE r.region <> '' AND l.region <> ''), t AS (SELECT country, region, count(*) AS total FROM p GROUP BY ALL), x AS (SELECT country, region, m_region, count(*) AS n FROM p WHERE region <> m_region GROUP BY ALL)\nSELECT country, region, m_region, n, total, n / total AS rate FROM x JOIN t USING (country, region) WHERE n / total >= 0.02 AND n >= 2".replace(", p AS", ", lk_leaky AS (SELECT entity_id, CASE WHEN region = 'Brand#1' AND CAST(substr(entity_id, 4) AS BIGINT) % 2 = 0 THEN 'Brand#2' ELSE region END AS region FROM lk_pool), p AS", 1), doubles="rate")
def region_leaks(v: Views) -> DataFrame:
    leaky = v("lk_pool").withColumn("region", F.expr("CASE WHEN region = 'Brand#1' AND CAST(substr(entity_id, 4) AS BIGINT) % 2 = 0 THEN 'Brand#2' ELSE region END"))
    return learn.region_leaks(v("lk_truth"), v("lk_ref"), leaky, ((0.02, 2),))


_VOC = CANON + """,
v1 AS (SELECT country, t, count(*) AS df1 FROM (SELECT country, unnest(list_distinct(string_split(n_core, ' '))) AS t FROM s1p) WHERE t <> '' GROUP BY ALL),
v2 AS (SELECT country, t, count(*) AS df2 FROM (SELECT country, unnest(list_distinct(string_split(n_core, ' '))) AS t FROM poolp) WHERE t <> '' GROUP BY ALL),
n1 AS (SELECT country, count(*) AS n FROM s1p GROUP BY ALL), n2 AS (SELECT country, count(*) AS n FROM poolp GROUP BY ALL),
voc AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.t, b.t) AS t, coalesce(a.df1, 0) AS df1, coalesce(a.f1, 0) AS f1, coalesce(b.f2, 0) AS f2
  FROM (SELECT country, t, df1, df1 / n * 1000 AS f1 FROM v1 JOIN n1 USING (country)) a FULL JOIN (SELECT country, t, df2 / n * 1000 AS f2 FROM v2 JOIN n2 USING (country)) b ON a.country = b.country AND a.t = b.t)"""


def _vocabulary(v: Views) -> DataFrame:
    return learn.vocabulary(prepared(v, "lk_ref"), prepared(v, "lk_pool"))


@query(_VOC + "\nSELECT country, t, df1, f1, f2 FROM voc WHERE f2 >= 0.5 AND f2 / (f1 + 0.05) >= 1.1", longs="df1", doubles="f1 f2")
def noise_vocab(v: Views) -> DataFrame:
    return learn.noise_vocabulary(_vocabulary(v))


@query(_VOC + "\nSELECT country, t, df1, f1, f2 FROM voc WHERE df1 >= 5", longs="df1", doubles="f1 f2")
def real_vocab(v: Views) -> DataFrame:
    return learn.real_vocabulary(_vocabulary(v), 5)


@query(_VOC + "\nSELECT b.country, count(*) AS tokens, count(a.t) AS seen, count(a.t) / count(*) AS share FROM v2 b LEFT JOIN v1 a ON a.country = b.country AND a.t = b.t GROUP BY b.country", doubles="share")
def vocab_coverage(v: Views) -> DataFrame:
    return learn.vocabulary_coverage(prepared(v, "lk_ref"), prepared(v, "lk_pool"))


@query(", c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), h AS (SELECT r.k, 1 + count(c.n) AS n FROM (SELECT unnest(range(16)) AS k) r LEFT JOIN c ON c.n = r.k GROUP BY r.k)\nSELECT a.k AS k, ln(b.n / a.n) AS llr FROM h a JOIN h b ON b.k = a.k + 1", doubles="llr")
def count_prior(v: Views) -> DataFrame:
    return learn.count_prior(v("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n")


@query(None)
def spelling_groups(v: Views) -> DataFrame:
    words = v("part").select(F.col("p_brand").alias("native"), F.explode(F.split("p_name", " ")).alias("en")).groupBy("native", "en").agg(F.count("*").alias("n"))
    return learn.spelling_variants(words, least=2, share=0.05, top=20, alike=50.0)


@query(", x AS (SELECT p_brand AS native, w AS en, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL), p AS (SELECT native, sum(n) AS n, max(n) AS top FROM x GROUP BY native)\nSELECT count(*) AS words, sum(n) AS occurrences, sum(top) / sum(n) AS purity FROM p", longs="occurrences", doubles="purity")
def translit_purity(v: Views) -> DataFrame:
    words = v("part").select(F.col("p_brand").alias("native"), F.explode(F.split("p_name", " ")).alias("en")).groupBy("native", "en").agg(F.count("*").alias("n"))
    return learn.purity_report(words)


# Relational basics, on the star schema.


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(v: Views) -> DataFrame:
    return v("customer").join(v("orders").where("o_totalprice > 300000"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(v: Views) -> DataFrame:
    return v("customer").join(v("orders").where("o_totalprice > 300000"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(", c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY ALL), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL)\nSELECT coalesce(c.k, s.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.k = s.k", longs="k")
def join_full_coalesce(v: Views) -> DataFrame:
    c = v("customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = v("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full").na.fill(0, ["customers", "suppliers"])


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderpriority = '1-URGENT'")
def join_inner_left(v: Views) -> DataFrame:
    o = v("orders").where("o_orderpriority = '1-URGENT'").join(v("customer"), F.expr("c_custkey = o_custkey"))
    return o.join(v("nation"), F.expr("n_nationkey = c_nationkey"), "left").join(v("region"), F.expr("r_regionkey = n_regionkey"), "left").select("o_orderkey", "n_name", "r_name")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def self_join_pairs(v: Views) -> DataFrame:
    key = ["p_name", "p_brand", "p_type"]
    a, b = v("part").select(F.col("p_partkey").alias("a"), *key), v("part").select(F.col("p_partkey").alias("b"), *key)
    return a.join(b, key).where("a < b").select("a", "b")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_discount) AS disc, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.05) AS taxed, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY ALL", doubles="qty revenue disc med p90")
def agg_overview(v: Views) -> DataFrame:
    return v("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), rounded(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.avg("l_discount").alias("disc"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"), F.median("l_quantity").alias("med"), F.percentile("l_extendedprice", 0.9).alias("p90"),
    )


@query("SELECT event_type, count(*) FILTER (WHERE dow = 0) AS d0, count(*) FILTER (WHERE dow = 1) AS d1, count(*) FILTER (WHERE dow = 2) AS d2 FROM (SELECT event_type, user_id % 3 AS dow FROM events) GROUP BY event_type")
def agg_pivot(v: Views) -> DataFrame:
    return v("events").withColumn("d", F.concat(F.lit("d"), F.expr("user_id % 3"))).groupBy("event_type").pivot("d", ["d0", "d1", "d2"]).count().na.fill(0)


@query("SELECT event_type, metric, CASE metric WHEN 'n' THEN CAST(n AS DOUBLE) ELSE total END AS value FROM (SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL), (VALUES ('n'), ('total')) m(metric)", doubles="value")
def agg_unpivot(v: Views) -> DataFrame:
    by = v("events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total"))
    return by.unpivot("event_type", ["n", "total"], "metric", "value")


@query("SELECT user_id, bit_or(CAST(event_id % 64 AS BIGINT)) AS bits, max_by(event_type, event_id) AS last_type, (SELECT NULL) IS NULL AS ok FROM events GROUP BY user_id")
def agg_bits_argmax(v: Views) -> DataFrame:
    return v("events").groupBy("user_id").agg(F.bit_or(F.col("event_id") % 64).alias("bits"), F.max_by("event_type", "event_id").alias("last_type"), F.lit(True).alias("ok"))


@query("SELECT o_orderkey, row_number() OVER w AS rk, max(o_totalprice) OVER p - o_totalprice AS gap, count(*) OVER p AS n, sum(o_totalprice) OVER p - o_totalprice AS others, coalesce(nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second FROM orders WINDOW p AS (PARTITION BY o_custkey), w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", doubles="gap others second")
def window_overview(v: Views) -> DataFrame:
    p = W.partitionBy("o_custkey")
    w = p.orderBy(F.desc("o_totalprice"), "o_orderkey")
    price = F.col("o_totalprice")
    return v("orders").select("o_orderkey", F.row_number().over(w).alias("rk"), (F.max(price).over(p) - price).alias("gap"), F.count("*").over(p).alias("n"), (F.sum(price).over(p) - price).alias("others"), F.coalesce(F.nth_value(price, 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0)).alias("second"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def sort_limit(v: Views) -> DataFrame:
    return v("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_k_per_group(v: Views) -> DataFrame:
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return v("customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_mktsegment", "c_custkey")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", longs="k")
def union_all(v: Views) -> DataFrame:
    return v("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).unionByName(v("supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@query("SELECT * FROM ((SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT -n_nationkey - 1 FROM nation EXCEPT SELECT -c_nationkey - 1 FROM customer WHERE c_acctbal > 9000))", longs="k")
def set_operations(v: Views) -> DataFrame:
    c = v("customer")
    both = c.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k")).intersect(v("supplier").select(F.col("s_nationkey").alias("k")))
    less = v("nation").select(F.expr("-n_nationkey - 1").alias("k")).exceptAll(c.where("c_acctbal > 9000").select(F.expr("-c_nationkey - 1").alias("k")).distinct())
    return both.unionByName(less)


@query("SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5('3|' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295 < 0.1")
def hash_sample(v: Views) -> DataFrame:
    u = F.conv(F.substring(exports.hash_order(F.col("event_id").cast("string"), seed=3), 1, 8), 16, 10).cast("double") / 4294967295.0
    return v("events").where(u < 0.1).select("event_id", "user_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('0|' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) WHERE r <= 20")
def stratified_sample(v: Views) -> DataFrame:
    return exports.stratified(v("events"), ["event_type"], 20, ["event_id"]).select("event_type", "event_id")


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN value <= 5 THEN '(-inf, 5]' WHEN value <= 20 THEN '(5, 20]' WHEN value <= 50 THEN '(20, 50]' ELSE '(50, inf)' END AS bucket FROM events) GROUP BY bucket")
def bucketize(v: Views) -> DataFrame:
    return v("events").groupBy(exports.bucketise(F.col("value"), [5, 20, 50]).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT a.p_name AS a, b.p_name AS b, jaro_winkler_similarity(a.p_name, b.p_name) AS jw, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS lev FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON substr(a.p_name, 1, 1) = substr(b.p_name, 1, 1)", doubles="jw lev")
def feat_jaro_winkler(v: Views) -> DataFrame:
    n = v("part").select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("a"), F.substring("p_name", 1, 1).alias("k")), n.select(F.col("p_name").alias("b"), F.substring("p_name", 1, 1).alias("k"))
    return a.join(b, "k").select("a", "b", K.jaro_winkler_udf("a", "b").alias("jw"), K.lev_sim(F.col("a"), F.col("b")).alias("lev"))


# Native scripts, regions and learned tables.


_AL = ", aw AS (SELECT string_split(name1, ' ') AS a, string_split(name2, ' ') AS b FROM lk_native), al AS (SELECT native, en, count(*) AS n FROM (SELECT b[i] AS native, a[i] AS en FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM aw WHERE len(a) = len(b))) GROUP BY ALL)"
_NW = _AL + ", nw AS (SELECT native, en FROM (SELECT *, row_number() OVER (PARTITION BY native ORDER BY n DESC, en) AS r FROM al) WHERE r = 1)"
_NAMED = ", nd AS (SELECT *, trim(string_split(a1, ',')[3]) AS region FROM lk_native)"
_NR = _NAMED + ", nr AS (SELECT part, region FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, region) AS r, n / sum(n) OVER (PARTITION BY part) AS share FROM (SELECT trim(string_split(a2, ',')[2]) AS part, region, count(*) AS n FROM nd GROUP BY ALL)) WHERE r = 1 AND n >= 3 AND share >= 0.9)"
_CY = ", cy AS (SELECT country, city, region FROM (SELECT *, row_number() OVER (PARTITION BY country, city ORDER BY n DESC, region) AS r, n / sum(n) OVER (PARTITION BY country, city) AS share FROM (SELECT country, trim(string_split(a1, ',')[2]) AS city, region, count(*) AS n FROM nd GROUP BY ALL)) WHERE r = 1 AND n >= 3 AND share >= 0.9)"


def _aligned(v: Views) -> DataFrame:
    return learn.align_tokens(v("lk_native"), F.col("name1"), F.col("name2"))


@query(_AL + "\nSELECT native, en, n FROM al")
def native_alignment(v: Views) -> DataFrame:
    return _aligned(v)


@query(_NW + "\nSELECT native, en FROM nw")
def native_dictionary(v: Views) -> DataFrame:
    return learn.native_words(_aligned(v))


@query("SELECT mid, 1 AS n_native, name1 AS n_core FROM lk_native", longs="n_native")
def norm_native(v: Views) -> DataFrame:
    words = {r["native"]: r["en"] for r in learn.native_words(_aligned(v)).collect()}  # a dictionary is a parameter
    return X.canon_names(v("lk_native"), "name2", words).select("mid", "n_native", "n_core")


@query(_NR + "\nSELECT part, region FROM nr")
def native_region_table(v: Views) -> DataFrame:
    return learn.native_regions(v("lk_native"), T.REGIONS, 3).select("part", "region")


@query(_NR + "\nSELECT mid, coalesce(nr.region, '') AS region, CASE WHEN nr.region IS NULL THEN 0 ELSE 2 END AS region_src FROM lk_native LEFT JOIN nr ON nr.part = trim(string_split(a2, ',')[2])", longs="region_src")
def addr_native_region(v: Views) -> DataFrame:
    parts = {r["part"]: r["region"] for r in learn.native_regions(v("lk_native"), T.REGIONS, 3).collect()}
    return X.canon_addresses(v("lk_native"), "a2", native_parts=parts).select("mid", "region", "region_src")


@query(_NAMED + _CY + "\nSELECT mid, coalesce(cy.region, '') AS region, CASE WHEN cy.region IS NULL THEN 0 ELSE 1 END AS region_src FROM lk_native n LEFT JOIN cy ON cy.country = n.country AND cy.city = trim(string_split(a1, ',')[2])", longs="region_src")
def addr_inferred_region(v: Views) -> DataFrame:
    found = learn.city_regions(v("lk_native").withColumnRenamed("a1", "address"), T.REGIONS).collect()
    cities = {"India": {r["city"]: r["region"] for r in found}}
    nameless = v("lk_native").withColumn("a1", F.regexp_replace("a1", ", [a-z]+$", ""))
    return X.canon_addresses(nameless, "a1", cities=cities).select("mid", "region", "region_src")


@query(_NW + _NR + _CY + ", rs AS (SELECT 'native_word' AS kind, '*' AS country, native AS key, en AS value FROM nw UNION ALL SELECT 'native_region', '*', part, region FROM nr UNION ALL SELECT 'city', country, city, region FROM cy)\nSELECT kind, country, key, value FROM rs")
def resources_all(v: Views) -> DataFrame:
    return learn.build_resources(v("lk_native"), T.REGIONS)


@query(_NAMED + ", dp AS (SELECT region AS dept, trim(string_split(a1, ',')[2]) AS city FROM nd), fq AS (SELECT dept FROM dp GROUP BY dept HAVING count(*) >= 10), dc AS (SELECT city, dept, count(*) AS n FROM dp WHERE dept IN (SELECT dept FROM fq) GROUP BY ALL)\nSELECT city, dept FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, dept) AS r FROM dc) WHERE r = 1 AND n >= 2")
def dict_departments(v: Views) -> DataFrame:
    return learn.departments(v("lk_native").withColumnRenamed("a1", "address"), 10, 2)
