"""Scores of assignments, held-out universes, and where errors come from."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .decide import assign, f05, leaders, marked, winners


def entity_counts(assigned: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, t, n, tp) of every entity: true, predicted and correct records."""
    true = truth.select("s1", "mid").distinct()
    pred = assigned.select("s1", "mid").distinct()
    t = true.groupBy("s1").agg(F.count("*").alias("t"))
    n = pred.groupBy("s1").agg(F.count("*").alias("n"))
    tp = pred.join(true, ["s1", "mid"], "left_semi").groupBy("s1").agg(F.count("*").alias("tp"))
    out = entities.select("s1").distinct()
    for df in (t, n, tp):
        out = out.join(df, "s1", "left")
    return out.na.fill(0, ["t", "n", "tp"])


def macro_f05(assigned: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row (entities, macro_f05): mean F0.5 over all entities, those without true records included."""
    per = entity_counts(assigned, truth, entities)
    return per.agg(F.count("*").alias("entities"), F.avg(f05(F.col("tp"), F.col("t"), F.col("n"))).alias("macro_f05"))


def f05_by(assigned: DataFrame, truth: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """(by, entities, macro_f05) for each value of a column of ``entities``."""
    per = entity_counts(assigned, truth, entities).join(entities.select("s1", by).distinct(), "s1")
    return per.groupBy(by).agg(F.count("*").alias("entities"), F.avg(f05(F.col("tp"), F.col("t"), F.col("n"))).alias("macro_f05"))


def blocking_oracle(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """The score of an assignment that takes every true candidate and nothing else."""
    found = marked(candidates.select("s1", "mid"), truth, "y").where("y").select("s1", "mid")
    return macro_f05(materialize(found, "found"), truth, entities)


def md5_unit(text: Column) -> Column:
    """A number from 0 to 1: the first 8 hex digits of the md5 over 2**32 - 1."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)


def universes(s1: DataFrame, shares: Mapping[str, float] | None = None, slack: float = 1.5, query_share: float = 0.81, seed: int = 42) -> DataFrame:
    """(entity_id, universe, is_query): whole blocks (country, region) dealt to universes.

    Blocks come in order of a hash; each joins the first universe that is not full and that it does not overfill by more than
    ``slack``; the rest is ``unused``. Only block counts, one row a region, are dealt in one group a country.
    """
    shares = dict(shares or {"val": 0.08, "train": 0.10})
    blocks = s1.groupBy("country", "region").agg(F.count("*").alias("n")).withColumn("u", md5_unit(F.concat(F.lit(f"{seed}:"), "country", F.lit("|"), "region")))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "region"])
        total, filled, out = rows["n"].sum(), dict.fromkeys(shares, 0), []
        for n in rows["n"]:
            name = next((k for k, share in shares.items() if filled[k] < share * total and filled[k] + n <= slack * share * total), "unused")
            if name != "unused":
                filled[name] += n
            out.append(name)
        return rows[["country", "region"]].assign(universe=out)

    dealt = blocks.groupBy("country").applyInPandas(deal, "country string, region string, universe string")
    return s1.join(dealt, ["country", "region"]).select("entity_id", "universe", (md5_unit(F.concat(F.lit(f"{seed + 1}:"), "entity_id")) < query_share).alias("is_query"))


def wide_regions(s1: DataFrame, share: float = 0.25, seed: int = 44) -> DataFrame:
    """(country, region, n): regions in hash order as long as those before hold less than ``share`` of the country."""
    blocks = s1.groupBy("country", "region").agg(F.count("*").alias("n"))
    u = F.md5(F.concat(F.lit(f"{seed}:"), "country", F.lit("|"), "region"))
    w = W.partitionBy("country")
    before = F.sum("n").over(w.orderBy(u, "region").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_t", F.sum("n").over(w)).where(F.col("_b") < share * F.col("_t")).select("country", "region", "n")


def testlike_thinning(pool: DataFrame, truth: DataFrame, universe: DataFrame, keep: Mapping[str, float], default: float = 1.0, seed: int = 45) -> DataFrame:
    """Pool rows less those owned outside the universe; rows owned by its non-query entities stay with the country's chance, by hash."""
    owner = truth.select("mid", F.col("s1").alias("owner")).distinct()
    inside = universe.select(F.col("entity_id").alias("owner"), "is_query")
    rows = pool.join(owner, pool.entity_id == owner.mid, "left").join(inside, "owner", "left")
    rates = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in keep.items() for x in (k, float(v))]), F.col("country")), F.lit(default)) if keep else F.lit(default)
    chance = md5_unit(F.concat(F.lit(f"{seed}:"), "entity_id")) < rates
    return rows.where(F.col("owner").isNull() | (F.col("is_query").isNotNull() & (F.col("is_query") | chance))).select(*pool.columns)


def error_categories(assigned: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(category, n): six outcomes of entities."""
    per = entity_counts(assigned, truth, entities)
    t, n, tp = F.col("t"), F.col("n"), F.col("tp")
    name = F.when((t == 0) & (n == 0), "empty right").when(t == 0, "empty wrong").when(n == 0, "all missed").when((tp == t) & (n == t), "exact").when(tp == 0, "all wrong").otherwise("partial")
    return per.groupBy(name.alias("category")).agg(F.count("*").alias("n"))


def fn_reasons(assigned: DataFrame, truth: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """(reason, n): why true pairs are not assigned: no candidate, lost to another entity, or below the threshold."""
    lost = truth.select("s1", "mid").distinct().join(assigned.select("s1", "mid"), ["s1", "mid"], "left_anti")
    won = winners(scored).select("mid", F.col("s1").alias("w"), F.col("p").alias("wp"))
    df = lost.join(scored.select("s1", "mid", "p"), ["s1", "mid"], "left").join(won, "mid", "left")
    reason = F.when(F.col("p").isNull(), "no candidate").when((F.col("w") != F.col("s1")) & (F.col("wp") >= threshold), "taken by another").when(F.col("w") != F.col("s1"), "outranked").otherwise("below threshold")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def fp_kinds(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, n): wrong assignments of records that another entity owns, or nobody."""
    true = truth.select("s1", "mid").distinct()
    wrong = assigned.select("s1", "mid").join(true, ["s1", "mid"], "left_anti")
    owned = wrong.join(true.select("mid").distinct().withColumn("_o", F.lit(1)), "mid", "left")
    return owned.groupBy(F.when(F.col("_o").isNull(), "orphan").otherwise("other owner").alias("kind")).agg(F.count("*").alias("n"))


def score_bins(scored: DataFrame, assigned: DataFrame, truth: DataFrame, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """(bin, pairs, true, tp, fp, fn) of pairs below, in and above the uncertain band."""
    kind = scored.schema["p"].dataType
    name = F.when(F.col("p") < F.lit(low).cast(kind), "low").when(F.col("p") < F.lit(high).cast(kind), "band").otherwise("high")
    df = marked(marked(scored.select("s1", "mid", name.alias("bin")), truth, "_y"), assigned, "_a")
    y, a = F.col("_y"), F.col("_a")
    return df.groupBy("bin").agg(F.count("*").alias("pairs"), F.count_if(y).alias("true"), F.count_if(y & a).alias("tp"), F.count_if(~y & a).alias("fp"), F.count_if(y & ~a).alias("fn"))


def repair_oracle(assigned: DataFrame, truth: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """The score if all claims on the given records were right: their wrong assignments go, their true owners get them."""
    eligible = records.select("mid").distinct()
    kept = assigned.select("s1", "mid").join(eligible, "mid", "left_anti")
    return macro_f05(kept.unionByName(truth.select("s1", "mid").distinct().join(eligible, "mid", "left_semi")), truth, entities)


def error_budget(assigned: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(fix, macro_f05): the score as it is, without wrong pairs, and with all missed pairs."""
    true = truth.select("s1", "mid").distinct()
    pred = assigned.select("s1", "mid").distinct()
    cases = {"none": pred, "false positives": pred.join(true, ["s1", "mid"], "left_semi"), "false negatives": pred.unionByName(true).distinct()}
    out = None
    for name, df in cases.items():
        row = macro_f05(df, truth, entities).withColumn("fix", F.lit(name)).select("fix", "macro_f05")
        out = row if out is None else out.unionByName(row)
    return out


def audit(scored: DataFrame, final: DataFrame, truth: DataFrame, entities: DataFrame, threshold: float) -> dict:
    """Checked inputs and the whole report as a dictionary of small tables."""
    validate(scored, truth, entities)
    truth = materialize(truth, "truth")
    assigned = materialize(assign(leaders(final), threshold), "assigned")
    rows = lambda df: [r.asDict() for r in df.collect()]
    if final is scored:  # only a pair without a key is not among itself
        missing = scored.where("s1 IS NULL OR mid IS NULL").count()
    else:
        missing = scored.join(final.select("s1", "mid"), ["s1", "mid"], "left_anti").count()
    true = truth.select("s1", "mid").distinct()
    owner = true.select("mid", F.col("s1").alias("o"))
    wrong = assigned.join(owner, "mid", "left")
    sums = entity_counts(assigned, truth, entities).agg(F.sum("tp"), F.sum("n"), F.sum("t")).first()
    return {
        "score": rows(macro_f05(assigned, truth, entities)), "bins": rows(score_bins(scored, assigned, truth)), "kinds": rows(fp_kinds(assigned, truth)), "categories": rows(error_categories(assigned, truth, entities)),
        "tp": sums[0], "fp": sums[1] - sums[0], "fn": sums[2] - sums[0], "unscored": missing, "wrong_owner": wrong.where("o IS NOT NULL AND o <> s1").count(), "no_owner": wrong.where("o IS NULL").count(),
    }


def validate(scored: DataFrame, truth: DataFrame, entities: DataFrame) -> None:
    """Fails on repeated entities or pairs, records with two owners, and probabilities that are none."""
    problems = {
        "repeated entities": entities.groupBy("s1").count().where("count > 1"),
        "records with two owners": truth.groupBy("mid").agg(F.count_distinct("s1").alias("n")).where("n > 1"),
        "repeated pairs": scored.groupBy("mid").agg(F.count("*").alias("n"), F.count_if(F.col("s1").isNull()).alias("none"), F.size(F.collect_set("s1")).alias("k")).where("k + IF(none > 0, 1, 0) < n"),
        "bad probabilities": scored.where("p IS NULL OR isnan(p) OR p < 0 OR p > 1"),
    }
    conf, name = scored.sparkSession.conf, "spark.sql.execution.useObjectHashAggregateExec"
    before = conf.get(name)
    conf.set(name, "false")  # a record's entities are collected in order, as claims come sorted by record, and only one list is held
    try:
        for what, df in problems.items():
            if not df.isEmpty():
                raise ValueError(what)
    finally:
        conf.set(name, before)


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row (expected, found, missing, extra, repeated): whether two key sets are the same."""
    e, f = expected.select(*keys).distinct(), found.select(*keys)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(e, "expected").crossJoin(n(f, "found"))
    out = out.crossJoin(n(e.join(f, keys, "left_anti"), "missing")).crossJoin(n(f.join(e, keys, "left_anti"), "extra"))
    return out.crossJoin(n(f.groupBy(*keys).count().where("count > 1"), "repeated"))


def compare_stages(old: DataFrame, new: DataFrame, truth: DataFrame, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """(stage, kept, true_kept, confident, confident_true): what two first stages keep and are sure of."""
    true = truth.select("s1", "mid").distinct().withColumn("_y", F.lit(1))
    both = old.select("s1", "mid", "p", F.lit("old").alias("stage")).unionByName(new.select("s1", "mid", "p", F.lit("new").alias("stage"))).join(true, ["s1", "mid"], "left")
    y = F.col("_y").isNotNull()
    return both.groupBy("stage").agg(F.count_if(F.col("p") >= low).alias("kept"), F.count_if((F.col("p") >= low) & y).alias("true_kept"), F.count_if(F.col("p") >= high).alias("confident"), F.count_if((F.col("p") >= high) & y).alias("confident_true"))


def auc_log_loss(scored: DataFrame, score: str = "p", label: str = "y", clip: float = 1e-7) -> DataFrame:
    """One row (n, auc, log_loss). AUC from ranks, ties shared; the window runs over distinct scores, not rows."""
    per = scored.groupBy(F.col(score).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(label)).cast("double").alias("pos"))
    w = W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ranked = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    p = F.greatest(F.least(F.col("p"), F.lit(1 - clip)), F.lit(clip))
    return ranked.agg(F.sum("n").alias("n"), (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"), (-F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)) / F.sum("n")).alias("log_loss"))
