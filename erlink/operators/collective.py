"""Features of a scored pair among the other pairs of its entity and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import tokens
from ..sources.storage import materialize

CONFIDENT, LOW, HIGH = 0.75, 0.02, 0.99
_ALL = (W.unboundedPreceding, W.unboundedFollowing)


def _by(key: str) -> W:
    return W.partitionBy(key)


def second(column: str, w: W, tie: str) -> Column:
    """Second largest value of the group, 0 if there is none."""
    return F.coalesce(F.nth_value(column, 2).over(w.orderBy(F.desc(column), tie).rowsBetween(*_ALL)), F.lit(0.0))


def band(scored: DataFrame, low: float = LOW, high: float = HIGH, column: str = "p") -> DataFrame:
    """Uncertain pairs: low <= p < high, compared in the column's own width."""
    kind = scored.schema[column].dataType
    return scored.where((F.col(column) >= F.lit(low).cast(kind)) & (F.col(column) < F.lit(high).cast(kind)))


def group_features(scored: DataFrame, confident: float = CONFIDENT, low: float = LOW) -> DataFrame:
    """(s1, mid, p, g_*): support by the entity's other pairs and rivalry for the record, over pairs with p >= low."""
    df = scored.where(F.col("p") >= low)
    sure = (F.col("p") >= confident).cast("int")
    s3 = F.col("mid").startswith("S3").cast("int")
    other = lambda x: F.sum(x).over(_by("s1")) - x
    df = df.withColumns({"g_conf": other(sure), "g_conf_s3": other(sure * s3), "g_conf_s2": other(sure * (1 - s3)), "g_sum_p": F.sum("p").over(_by("s1")) - F.col("p"), "g_rank_s1": F.row_number().over(_by("s1").orderBy(F.desc("p"), "mid")), "g_n_cand": F.count("*").over(_by("s1"))})
    df = df.withColumns({"g_rank_mid": F.row_number().over(_by("mid").orderBy(F.desc("p"), "s1")), "g_n_claim": F.count("*").over(_by("mid")), "g_max_mid": F.max("p").over(_by("mid")), "_second": second("p", _by("mid"), "s1")})
    return df.withColumn("g_rival", F.when(F.col("g_rank_mid") == 1, F.col("_second")).otherwise(F.col("g_max_mid"))).withColumn("g_margin", F.col("p") - F.col("g_rival")).drop("_second")


def sibling_support(target: DataFrame, scored: DataFrame, records: DataFrame, similarity: str = "token_set", confident: float = CONFIDENT) -> DataFrame:
    """(s1, mid, sib_n, sib_name_max, sib_name_mean, sib_addr_max, sib_addr_mean, sib_house_n, sib_house_share) for each target pair.

    Siblings are the entity's other pairs with p >= confident. Without one sib_n is 0 and the rest -1.
    """
    kernel = {"token_set": K.token_set_udf, "levenshtein": K.lev_sim}[similarity]
    rec = records.select(F.col("entity_id").alias("mid"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("n_core", "a_tokens", "a_house")])
    sure = scored.where(F.col("p") >= confident).select("s1", F.col("mid").alias("other"))
    both = target.select("s1", "mid").join(sure, "s1").where("mid <> other").join(rec, "mid").join(rec.select(*[F.col(c).alias({"mid": "other"}.get(c, c + "_o")) for c in rec.columns]), "other")
    house = ((F.col("a_house") != "") & (F.col("a_house") == F.col("a_house_o"))).cast("int")
    both = both.withColumns({"_n": kernel(F.col("n_core"), F.col("n_core_o")), "_a": kernel(F.col("a_tokens"), F.col("a_tokens_o")), "_h": house})
    agg = both.groupBy("s1", "mid").agg(F.count("*").alias("sib_n"), F.max("_n").alias("sib_name_max"), F.avg("_n").alias("sib_name_mean"), F.max("_a").alias("sib_addr_max"), F.avg("_a").alias("sib_addr_mean"), F.sum("_h").alias("sib_house_n"), F.avg("_h").alias("sib_house_share"))
    out = target.select("s1", "mid").join(agg, ["s1", "mid"], "left")
    return out.na.fill(0, ["sib_n"]).na.fill(-1, ["sib_house_n"]).na.fill(-1.0, ["sib_name_max", "sib_name_mean", "sib_addr_max", "sib_addr_mean", "sib_house_share"])


def direct_checks(pairs: DataFrame, similarity: str = "fuzzy") -> DataFrame:
    """(s1, mid, pf_*) of attached pairs: nine checks made once more for the uncertain ones.

    ``similarity`` "levenshtein" takes the edit similarity in place of all four kernels, which SQL can express.
    """
    fields = {c: (F.coalesce(f"{c}_s", F.lit("")), F.coalesce(f"{c}_c", F.lit(""))) for c in ("n_core", "n_compact", "a_tokens", "a_house", "region")}
    kernels = {"pf_name_tset": ("token_set", "n_core"), "pf_name_ratio": ("ratio", "n_compact"), "pf_addr_tset": ("token_set", "a_tokens"), "pf_addr_partial": ("partial", "a_tokens")}
    if similarity == "fuzzy":
        found = K.similarities(kernels, {c: fields[c] for c in ("n_core", "n_compact", "a_tokens")})
    else:
        found = F.struct(*[(100 * K.lev_sim(*fields[c])).alias(out) for out, (_, c) in kernels.items()])
    (h1, h2), eq = fields["a_house"], lambda c: (fields[c][0] == fields[c][1]).cast("int")
    return pairs.select(
        "s1", "mid", found.alias("_f"), ((h1 == h2) & (h1 != "")).cast("int").alias("pf_house_eq"), ((h1 != "") & (h2 != "")).cast("int").alias("pf_house_both"),
        F.coalesce("a_null_c", F.lit(1)).cast("int").alias("pf_c_addr_null"), eq("region").alias("pf_region_eq"), eq("n_compact").alias("pf_name_exact"),
    ).select("s1", "mid", "_f.*", "pf_house_eq", "pf_house_both", "pf_c_addr_null", "pf_region_eq", "pf_name_exact")


def logit(p: Column, clip: float = 1e-7) -> Column:
    p = F.greatest(F.least(p.cast("double"), F.lit(1 - clip)), F.lit(clip))
    return F.ln(p / (1 - p))


def encoder_competition(scores: DataFrame, prefix: str = "ce", clip: float = 1e-6) -> DataFrame:
    """(s1, mid, p_ce, prefix_*): competition by an encoder's score. Leaders that tie see each other, so their margin is 0.

    A pair scored more than once counts once, with its largest score. ``_conf_other`` and ``_mid_conf_other`` count the
    entity's and the record's other pairs of at least 0.5.
    """
    p, sure = F.col("p_ce"), (F.col("p_ce") >= 0.5).cast("int")
    df = scores.groupBy("s1", "mid").agg(F.max("p_ce").alias("p_ce"))
    df = df.withColumns({"_best_s": F.max("p_ce").over(_by("s1")), "_sec_s": second("p_ce", _by("s1"), "mid"), f"{prefix}_conf_other": F.sum(sure).over(_by("s1")) - sure, f"{prefix}_rank_s1": F.row_number().over(_by("s1").orderBy(F.desc("p_ce"), "mid"))})
    df = df.withColumns({"_best_m": F.max("p_ce").over(_by("mid")), "_sec_m": second("p_ce", _by("mid"), "s1"), f"{prefix}_mid_conf_other": F.sum(sure).over(_by("mid")) - sure})
    df = df.withColumns({f"{prefix}_logit": logit(p, clip), f"{prefix}_rival": F.when(p == F.col("_best_m"), F.col("_sec_m")).otherwise(F.col("_best_m")), f"{prefix}_best_other": F.when(p == F.col("_best_s"), F.col("_sec_s")).otherwise(F.col("_best_s"))})
    return df.withColumn(f"{prefix}_margin", p - F.col(f"{prefix}_rival")).drop("_best_s", "_sec_s", "_best_m", "_sec_m")


def band_encoder(scored: DataFrame, scores: DataFrame, name: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Encoder competition over all pairs with p >= low: sure pairs count as 1, unscored ones drop out; columns carry ``name``."""
    full = scored.where(F.col("p") >= low).select("s1", "mid", "p").join(scores.groupBy("s1", "mid").agg(F.max("p_ce").alias("p_ce")), ["s1", "mid"], "left")
    full = full.withColumn("p_ce", F.when(F.col("p") >= high, F.lit(1.0)).otherwise(F.col("p_ce"))).where("p_ce IS NOT NULL").drop("p")
    return encoder_competition(full, name).withColumnRenamed("p_ce", f"p_{name}")


def address_neighbours(pairs: DataFrame, s1: DataFrame, similarity: str = "token_set") -> DataFrame:
    """(s1, mid, nb_n, nb_best, nb_margin, nm_nocity): other entities at the entity's very address, and how well the record's name fits them.

    ``pairs`` is attached. An address is (country, words, house number), both there. nb_best is the best name similarity of the
    record with a neighbour (0 without one), nb_margin the similarity with the entity less that, nm_nocity the similarity of
    both names without the words of the entity's address (a name of such words only stays). Entities at one address are
    aggregated to their distinct names first, so that a hub costs its names, not its members, for each pair.
    """
    kernel = K.token_set_udf if similarity == "token_set" else lambda a, b: 100 * K.lev_sim(a, b)
    key = ["country", "a_tokens", "a_house"]
    home = s1.where("a_tokens <> '' AND a_house <> ''").select(F.col("entity_id").alias("s1"), *key, F.coalesce("n_core", F.lit("")).alias("_own"))
    names = home.groupBy(*key, F.col("_own").alias("_name")).agg(F.count("*").alias("_k"))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = pairs.select("s1", "mid", text("n_core_s").alias("_s"), text("n_core_c").alias("_c"), tokens(F.col("a_tokens_s")).alias("_a"))
    near = rows.select("s1", "mid", "_c").join(home, "s1").join(names, key)
    near = near.withColumn("_k", F.col("_k") - (F.col("_name") == F.col("_own")).cast("int")).where("_k > 0")
    agg = near.withColumn("_x", kernel(F.col("_name"), F.col("_c"))).groupBy("s1", "mid").agg(F.sum("_k").alias("nb_n"), F.max("_x").alias("nb_best"))
    bare = lambda c: F.array_join(F.filter(tokens(F.col(c)), lambda t: ~F.array_contains("_a", t)), " ")
    rows = rows.withColumns({"_bs": F.when(bare("_s") == "", F.col("_s")).otherwise(bare("_s")), "_bc": F.when(bare("_c") == "", F.col("_c")).otherwise(bare("_c"))})
    rows = rows.withColumns({"_self": kernel(F.col("_s"), F.col("_c")), "nm_nocity": kernel(F.col("_bs"), F.col("_bc"))})
    out = rows.join(agg, ["s1", "mid"], "left").withColumn("nb_best", F.coalesce("nb_best", F.lit(0.0)))
    return out.select("s1", "mid", F.coalesce("nb_n", F.lit(0)).alias("nb_n"), "nb_best", (F.col("_self") - F.col("nb_best")).alias("nb_margin"), "nm_nocity")


def assemble(scored: DataFrame, features: DataFrame, *more: DataFrame, low: float = LOW, high: float = HIGH, drop: tuple[str, ...] = (), prior: DataFrame | None = None) -> DataFrame:
    """Second-stage rows of the band: group features, first-stage features but ``drop`` as ``f1_*``, ln p and ln(1 - p), and whatever else is keyed by pair.

    ``prior`` (mid, rp) adds how likely a record is to belong to anybody.
    """
    out = band(scored, low, high).select("s1", "mid").join(group_features(scored, low=low), ["s1", "mid"])
    clipped = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumns({"logp": F.ln(clipped), "log1mp": F.ln(1 - clipped)})
    out = out.join(features.select("s1", "mid", *[F.col(c).alias(f"f1_{c}") for c in features.columns if c not in ("s1", "mid", "hit", *drop)]), ["s1", "mid"], "left")
    if prior is not None:
        out = out.join(prior.select("mid", "rp"), "mid", "left")
    for df in more:
        out = out.join(df, ["s1", "mid"], "left")
    return out


def round_two(scored: DataFrame, threshold: float, prior: DataFrame | None = None) -> DataFrame:
    """(s1, mid, q, r2_*): who rivals for the record, and how many other records of each source both sides have accepted.

    ``scored`` is (s1, mid, q). ``prior`` (src, k, llr) adds the log odds of one more record of that source.
    """
    df = scored.select("s1", "mid", "q", F.substring("mid", 1, 2).alias("src"))
    first = _by("mid").orderBy(F.desc("q"), "s1")
    whole = first.rowsBetween(*_ALL)
    df = df.withColumns({"r2_rk": F.row_number().over(first), "_s1": F.first("s1").over(whole), "_q1": F.first("q").over(whole), "_s2": F.nth_value("s1", 2).over(whole), "_q2": F.nth_value("q", 2).over(whole)})
    lead = F.col("r2_rk") == 1
    df = df.withColumns({"rival": F.when(lead, F.col("_s2")).otherwise(F.col("_s1")), "r2_rival_q": F.coalesce(F.when(lead, F.col("_q2")).otherwise(F.col("_q1")), F.lit(0.0)), "a": (lead & (F.col("q") >= threshold)).cast("int"), "a_riv": (~lead & (F.col("_q1") >= threshold)).cast("int")})
    accepted = df.where("a = 1")
    by = accepted.groupBy("s1", "src").agg(F.count("*").alias("n_src"))
    every = accepted.groupBy("s1").agg(F.count("*").alias("n_all"))
    df = df.join(by, ["s1", "src"], "left").join(every, "s1", "left").join(by.select(F.col("s1").alias("rival"), "src", F.col("n_src").alias("rn_src")), ["rival", "src"], "left").join(every.select(F.col("s1").alias("rival"), F.col("n_all").alias("rn_all")), "rival", "left").na.fill(0, ["n_src", "n_all", "rn_src", "rn_all"])
    has = F.col("rival").isNotNull()
    out = df.select("s1", "mid", "q", "src", "r2_rk", "rival", "r2_rival_q", (F.col("q") - F.col("r2_rival_q")).alias("r2_margin"), (F.col("n_src") - F.col("a")).alias("r2_n_own_same"), (F.col("n_all") - F.col("n_src")).alias("r2_n_own_othsrc"), (F.col("n_all") - F.col("a")).alias("r2_n_own_all"), F.when(has, F.col("rn_src") - F.col("a_riv")).alias("r2_n_riv_same"), F.when(has, F.col("rn_all") - F.col("a_riv")).alias("r2_n_riv_all"))
    if prior is not None:
        for side in ("own", "riv"):
            p = prior.select("src", F.col("k").cast("long").alias("_k"), F.col("llr").alias(f"r2_llr_{side}"))
            n = F.col(f"r2_n_{side}_same")
            out = out.withColumn("_k", F.when(n > 14, 14).otherwise(n).cast("long")).join(p, ["src", "_k"], "left").drop("_k")
        out = out.withColumn("r2_llr_d", F.col("r2_llr_own") - F.col("r2_llr_riv"))
    return out


def twins(scored: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """(s1, mid, tw_n, tw_own, tw_oth, tw_qsum): records with the same name, address and house, accepted by this entity or others.

    The pair's own acceptance is taken off, also where the record has no twin: tw_own is then minus that, tw_oth minus a rival's.
    """
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("n_compact", "a_tokens", "a_house")])
    same = records.where("a_null = 0").groupBy(key.alias("key")).agg(F.collect_list("entity_id").alias("mids"), F.count("*").alias("tw_size")).where("tw_size >= 2")
    same = same.withColumn("key", F.monotonically_increasing_id())  # before the explode: one number for all records of a key
    tw = materialize(same.select(F.explode("mids").alias("mid"), "key", "tw_size"), "twins")
    df = scored.select("s1", "mid", "q").withColumn("_r", F.row_number().over(_by("mid").orderBy(F.desc("q"), "s1"))).withColumn("a", ((F.col("_r") == 1) & (F.col("q") >= threshold)).cast("int"))
    df = materialize(df.withColumn("held", F.max("a").over(_by("mid"))).drop("_r").join(tw, "mid", "left"), "claimed")
    # Those of an entity lie together among those of a key, so that one exchange and one sort give both sums.
    mine, named = W.partitionBy("key", "s1"), F.col("s1").isNotNull()
    k = df.where("key IS NOT NULL").repartition("key").withColumns({"k_own": F.when(named, F.sum("a").over(mine)), "k_q": F.when(named, F.sum("q").over(mine)), "k_all": F.sum("a").over(W.partitionBy("key"))})
    none = F.lit(None)
    df = k.unionByName(df.where("key IS NULL").withColumns({"k_own": none.cast("long"), "k_q": none.cast("double"), "k_all": none.cast("long")})).na.fill(0, ["k_own", "k_all"])
    own = F.col("k_own") - F.col("a")
    return df.select("s1", "mid", (F.coalesce("tw_size", F.lit(1)) - 1).alias("tw_n"), own.alias("tw_own"), (F.col("k_all") - F.col("held") - own).alias("tw_oth"), (F.coalesce("k_q", "q") - F.col("q")).alias("tw_qsum"))


def record_features(records: DataFrame, s1: DataFrame) -> DataFrame:
    """(entity_id, 16 features) of records alone: unknown words, lengths, marks and flags."""
    known = s1.select(F.explode(tokens(F.col("n_core"))).alias("t")).distinct()
    word = records.select("entity_id", F.explode(tokens(F.col("n_core"))).alias("t")).join(known.withColumn("_k", F.lit(1)), "t", "left")
    oov = word.groupBy("entity_id").agg(F.avg(F.when(F.col("_k").isNull(), 1.0).otherwise(0.0)).alias("oov_share"))
    name, addr = F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))
    upper = lambda s: (s == F.upper(s)).cast("int")
    return records.join(oov, "entity_id", "left").select(
        "entity_id", F.coalesce("oov_share", F.lit(1.0)).alias("oov_share"), F.size(F.split("n_core", " ")).alias("name_tokens"), F.char_length(name).alias("name_len"), F.char_length(addr).alias("addr_len"),
        F.regexp_count(addr, F.lit(",")).alias("addr_commas"), (F.col("n_legal") != "").cast("int").alias("has_legal"), (F.col("a_house") != "").cast("int").alias("has_house"), upper(name).alias("name_upper"), upper(addr).alias("addr_upper"),
        name.rlike("[0-9]").cast("int").alias("name_digit"), F.regexp_count(name, F.lit(r"[&+\-.()\[\]/]")).alias("name_punct"), F.col("n_native").alias("native"), F.col("n_alias").alias("alias"), F.col("n_web").alias("web"), F.col("a_null").alias("addr_null"), F.col("entity_id").startswith("S2").cast("int").alias("is_s2"),
    )


def record_competition(df: DataFrame, column: str, prefix: str, absent: float = 0.0) -> DataFrame:
    """Adds best, second, rival and margin of ``column`` within each record; tied leaders have margin 0."""
    df = df.withColumns({f"{prefix}_best": F.max(column).over(_by("mid")), "_two": F.nth_value(column, 2).over(_by("mid").orderBy(F.desc(column), "s1").rowsBetween(*_ALL))})
    df = df.withColumn(f"{prefix}_second", F.coalesce("_two", F.lit(absent))).drop("_two")
    rival = F.when(F.col(column) == F.col(f"{prefix}_best"), F.col(f"{prefix}_second")).otherwise(F.col(f"{prefix}_best"))
    return df.withColumn(f"{prefix}_rival", rival).withColumn(f"{prefix}_margin", F.col(column) - F.col(f"{prefix}_rival"))


def correction_groups(scored: DataFrame, high: float = HIGH) -> DataFrame:
    """All claims on every record that some entity claims with p >= high, with the competition for it, as :func:`record_competition` has it.

    The two best scores come from two aggregates, so that claims that lie together and sorted by record neither move nor are sorted.
    """
    p, best = F.col("p"), F.col("_best")
    top = materialize(scored.groupBy("mid").agg(F.max("p").alias("_best")).where(best >= high), "best")
    tied = scored.join(top, "mid").groupBy("mid", "_best").agg(F.count_if(p == best).alias("_n"), F.max(F.when(p < best, p)).alias("_below"))
    second_best = F.when(F.col("_n") > 1, best).otherwise(F.coalesce("_below", F.lit(0.0)))
    rivals = materialize(tied.select("mid", "_best", second_best.alias("_second")), "rivals")
    rival = F.when(p == best, F.col("_second")).otherwise(best)
    return scored.join(rivals, "mid").select(*scored.columns, best.alias("p1_best"), F.col("_second").alias("p1_second"), rival.alias("p1_rival"), (p - rival).alias("p1_margin"))
