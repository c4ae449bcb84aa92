"""Lookup tables learned by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import tables as T
from ..functions.text import basic, lookup, place_key, tokens
from ..sources.storage import materialize


def most_frequent(df: DataFrame, keys: list[str], value: str, least: int = 1, purity: float = 0.0) -> DataFrame:
    """(keys, value, n, share): each key's most frequent value if it is frequent and pure enough; ties to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return ranked.where((F.col("_r") == 1) & (F.col("n") >= least) & (F.col("share") >= purity)).drop("_r")


def explicit_region(address: F.Column, country: F.Column, regions: dict[str, dict[str, str]]) -> F.Column:
    """Region of the first comma part that is one of the country's aliases; null if none is."""
    flat = {f"{k}\t{a}": r for k, m in regions.items() for a, r in m.items()}
    found = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.coalesce(lookup(flat, F.concat(country, F.lit("\t"), basic(p))), lookup(flat, F.concat(F.lit("*\t"), basic(p)))))
    return F.get(F.filter(found, lambda r: r.isNotNull()), F.lit(0))


def align_tokens(pairs: DataFrame, plain: str, native: str) -> DataFrame:
    """(native, en, n): how often words stand at one place in names with as many words, all of the native name in a native script."""
    a, b = F.split(F.trim(plain), r"\s+"), F.split(F.trim(native), r"\s+")
    rows = pairs.select(a.alias("a"), b.alias("b")).where((F.size("a") == F.size("b")) & F.forall("b", lambda t: t.rlike(T.INDIC)))
    words = rows.select(F.explode(F.arrays_zip("b", "a")).alias("z")).select(F.col("z.b").alias("native"), F.replace(basic(F.col("z.a")), F.lit(" "), F.lit("")).alias("en"))
    return words.where("en <> ''").groupBy("native", "en").agg(F.count("*").alias("n"))


def native_words(aligned: DataFrame) -> DataFrame:
    """(native, en): the most common plain word of each native word; ties to the smaller."""
    w = W.partitionBy("native").orderBy(F.desc("n"), "en")
    return aligned.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("native", "en")


def purity_report(aligned: DataFrame) -> DataFrame:
    """One row: words, occurrences, and the share of occurrences that the most common plain word explains."""
    per = aligned.groupBy("native").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return per.agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"), (F.sum("top") / F.sum("n")).alias("purity"))


def spelling_variants(aligned: DataFrame, least: int = 20, share: float = 0.15, top: int = 5, alike: float = 60.0) -> DataFrame:
    """(variant, canonical): spellings of one native word that look alike, grouped, the most frequent first.

    Of a native word's ``top`` plain words those with enough counts are candidates; each is linked with the first if their
    ratio is ``alike`` or more, or if they start alike and are short. Groups are connected components by repeated smallest
    labels; the graph has at most ``top`` edges a native word and short paths.
    """
    w = W.partitionBy("native")
    ranked = aligned.withColumn("_t", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "en"))).where((F.col("_r") <= top) & (F.col("n") / F.col("_t") >= share) & (F.col("n") >= least))
    freq = ranked.groupBy(F.col("en").alias("node")).agg(F.sum("n").alias("freq"))
    first = ranked.withColumn("_k", F.row_number().over(w.orderBy("_r"))).select("native", "en", "_k")
    links = first.where("_k = 1").select("native", F.col("en").alias("a")).join(first.where("_k > 1").select("native", F.col("en").alias("b")), "native").select("a", "b").distinct()
    near = (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.char_length("a") <= 6) & (F.char_length("b") <= 6)
    links = links.where(near | (kernels.ratio_udf(F.col("a"), F.col("b")) >= alike))
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "spellings")
    labels = freq.select("node", F.col("node").alias("label"))
    seen = None
    while True:  # paths between spellings are a few words long
        lower = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        labels = materialize(labels.join(lower, labels.node == lower.a, "left").select("node", F.least("label", "low").alias("label")), "labels")
        mark = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if mark == seen:
            break
        seen = mark
    words = labels.join(freq, "node").where("char_length(node) >= 3 AND NOT node RLIKE '[^a-z]'")
    g = W.partitionBy("label")
    named = words.withColumn("canonical", F.first("node").over(g.orderBy(F.desc("freq"), "node")))
    return named.where("node <> canonical").select(F.col("node").alias("variant"), "canonical")


def native_regions(pairs: DataFrame, regions: dict[str, dict[str, str]], least: int = 10, purity: float = 0.9) -> DataFrame:
    """(part, region): native address parts whose pairs name one region; pairs have a1, a2, country."""
    named = pairs.withColumn("region", explicit_region(F.col("a1"), F.col("country"), regions)).where("region IS NOT NULL")
    parts = named.select(F.explode(F.transform(F.split("a2", ","), lambda p: F.trim(p))).alias("part"), "region").where(F.col("part").rlike(T.INDIC))
    return most_frequent(parts, ["part"], "region", least, purity)


def city_regions(records: DataFrame, regions: dict[str, dict[str, str]], least: int = 3, purity: float = 0.9) -> DataFrame:
    """(country, city, region, n, share): place keys of address parts whose records name one region."""
    flat = {f"{k}\t{a}": r for k, m in regions.items() for a, r in m.items()}
    named = records.withColumn("region", explicit_region(F.col("address"), F.col("country"), regions)).where("region IS NOT NULL")
    parts = named.select("country", "region", F.explode(F.split("address", ",")).alias("raw")).withColumn("_b", basic(F.col("raw")))
    alias = F.coalesce(lookup(flat, F.concat("country", F.lit("\t"), "_b")), lookup(flat, F.concat(F.lit("*\t"), F.col("_b"))))
    plain = parts.where((F.col("_b") != "") & ~F.col("_b").rlike("[0-9]") & alias.isNull()).select("country", place_key(F.col("raw")).alias("city"), "region")
    return most_frequent(plain, ["country", "city"], "region", least, purity)


def region_leaks(truth: DataFrame, s1: DataFrame, pool: DataFrame, rules: tuple[tuple[float, int], ...] = ((0.02, 30), (0.005, 500))) -> DataFrame:
    """(country, region, m_region, n, total, rate): where the matches of a region's entities lie outside it, by rate and number."""
    pairs = truth.join(s1.select(F.col("entity_id").alias("s1"), "country", "region"), "s1").join(pool.select(F.col("entity_id").alias("mid"), F.col("region").alias("m_region")), "mid").where("region <> '' AND m_region <> ''")
    totals = pairs.groupBy("country", "region").agg(F.count("*").alias("total"))
    leaks = pairs.where("region <> m_region").groupBy("country", "region", "m_region").agg(F.count("*").alias("n")).join(totals, ["country", "region"]).withColumn("rate", F.col("n") / F.col("total"))
    keep = F.lit(False)
    for rate, n in rules:
        keep = keep | ((F.col("rate") >= rate) & (F.col("n") >= n))
    return leaks.where(keep)


def vocabulary(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(country, t, df1, f1, f2): in how many clean names a word is, and how often in a thousand names of either side."""

    def side(df: DataFrame, df_name: str, f_name: str) -> DataFrame:
        words = df.select("country", F.explode(F.array_distinct(tokens(F.col("n_core")))).alias("t")).groupBy("country", "t").agg(F.count("*").alias(df_name))
        sizes = df.groupBy("country").agg(F.count("*").alias("_n"))
        return words.join(sizes, "country").select("country", "t", df_name, (F.col(df_name) / F.col("_n") * 1000).alias(f_name))

    both = side(s1, "df1", "f1").join(side(pool, "df2", "f2").drop("df2"), ["country", "t"], "full")
    return both.select("country", "t", F.coalesce("df1", F.lit(0)).alias("df1"), F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("f2", F.lit(0.0)).alias("f2"))


def noise_vocabulary(voc: DataFrame, least: float = 0.5, factor: float = 1.1) -> DataFrame:
    """Words that noisy names have more often than clean names."""
    return voc.where((F.col("f2") >= least) & (F.col("f2") / (F.col("f1") + 0.05) >= factor))


def real_vocabulary(voc: DataFrame, least: int = 20) -> DataFrame:
    """Words of enough clean names."""
    return voc.where(F.col("df1") >= least)


def vocabulary_coverage(known: DataFrame, new: DataFrame) -> DataFrame:
    """(country, tokens, seen, share): how many distinct words of ``new`` are in ``known``."""
    words = lambda df: df.select("country", F.explode(tokens(F.col("n_core"))).alias("t")).distinct()
    marked = words(new).join(words(known).withColumn("_k", F.lit(1)), ["country", "t"], "left")
    return marked.groupBy("country").agg(F.count("*").alias("tokens"), F.count("_k").alias("seen"), F.avg(F.coalesce("_k", F.lit(0)).cast("double")).alias("share"))


def departments(records: DataFrame, least_part: int = 2000, least_city: int = 50) -> DataFrame:
    """(city, dept): most frequent last address part among frequent ones, for each city before it."""
    parts = records.select(F.transform(F.split("address", ","), basic).alias("p")).where("size(p) >= 2").select(F.element_at("p", -1).alias("dept"), F.element_at("p", -2).alias("city")).where("dept <> '' AND city <> ''")
    frequent = parts.groupBy("dept").count().where(F.col("count") >= least_part).select("dept")
    return most_frequent(parts.join(frequent, "dept", "left_semi"), ["city"], "dept", least_city).select("city", "dept")


def count_histogram(counts: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(k, n): how many rows have a value of k, the last bin open."""
    return counts.groupBy(F.least(F.col(column), F.lit(bins - 1)).cast("int").alias("k")).agg(F.count("*").alias("n"))


def count_prior(counts: DataFrame, column: str, bins: int = 16) -> DataFrame:
    """(k, llr): log P(k+1)/P(k) with one added to every bin, for k = 0 .. bins - 2."""
    spark = counts.sparkSession
    hist = spark.range(bins).select(F.col("id").cast("int").alias("k")).join(counts.where(F.col(column) < bins).groupBy(F.col(column).cast("int").alias("k")).agg(F.count("*").alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    nxt = hist.select((F.col("k") - 1).alias("k"), F.col("n").alias("m"))
    return hist.join(nxt, "k").select("k", F.ln(F.col("m") / F.col("n")).alias("llr"))


def build_resources(pairs: DataFrame, regions: dict[str, dict[str, str]], least: int = 3, purity: float = 0.9) -> DataFrame:
    """(kind, country, key, value): all learned tables of matched pairs (country, name1, name2, a1, a2), in the order in which they need each other.

    ``native_word``: words of native names by place; ``spelling``: variants of one native word; ``native_region``: native
    address parts that name a region; ``city``: places whose records name one. Tables of a country come with its name, those
    for all with "*".
    """
    aligned = materialize(align_tokens(pairs, F.col("name1"), F.col("name2")), "aligned")
    row = lambda df, kind, country, key, value: df.select(F.lit(kind).alias("kind"), country.alias("country"), F.col(key).alias("key"), F.col(value).alias("value"))
    every = F.lit("*")
    tables = [
        row(native_words(aligned), "native_word", every, "native", "en"),
        row(spelling_variants(aligned, least), "spelling", every, "variant", "canonical"),
        row(native_regions(pairs, regions, least, purity), "native_region", every, "part", "region"),
        row(city_regions(pairs.withColumnRenamed("a1", "address"), regions, least, purity), "city", F.col("country"), "city", "region"),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
