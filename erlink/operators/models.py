"""Pair models: sampling and weights, boosted trees, folds, stacking, and the plug-in boundary for external scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .collective import logit
from .evaluate import auc_log_loss, md5_unit


def presample(pairs: DataFrame, top: int = 15, rate: float = 0.25, seed: int = 7) -> DataFrame:
    """Positives, each entity's ``top`` pairs by ``pre``, and a hash share of the rest with the inverse weight as ``w``."""
    df = pairs.withColumn("_r", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("pre"), "mid")))
    sure = (F.col("y") == 1) | (F.col("_r") <= top)
    picked = md5_unit(F.concat(F.lit(f"{seed}:"), "s1", F.lit("|"), "mid")) < rate
    return df.where(sure | picked).withColumn("w", F.when(sure, 1.0).otherwise(1 / rate)).drop("_r")


def testlike_weights(pairs: DataFrame, owners: DataFrame, keep: Mapping[str, float], outside: float = 0.05) -> DataFrame:
    """Multiplies ``w``: records owned by entities left out count as often as the test keeps them, those owned elsewhere little.

    ``owners`` is (mid, owner_state) with "query", "dropped" or "outside"; records without one are orphans and keep their weight.
    """
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in keep.items() for x in (k, float(v))]), F.col("country")), F.lit(1.0)) if keep else F.lit(1.0)
    factor = F.when(F.col("owner_state") == "dropped", rate).when(F.col("owner_state") == "outside", outside).otherwise(1.0)
    return pairs.join(owners, "mid", "left").withColumn("w", F.col("w") * factor).drop("owner_state")


def hash_holdout(key: Column, share: float, seed: int) -> Column:
    """Whether a key belongs to the held-out share, by hash."""
    return md5_unit(F.concat(F.lit(f"{seed}:"), key)) < share


#: Parts of the rows with the same features and label, so that a tree's sample leaves out some of them and not all.
PARTS = 16


def _together(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with the same features, label and part as one, with the sum of their weights; stored, as fitting goes through rows many times."""
    part = F.pmod(F.xxhash64(*[c for c in ("s1", "mid") if c in df.columns]), F.lit(PARTS)).alias("_part")
    keys = [*features, "y", "_valid", "_part"]
    rows = df.select(*keys[:-1], part, "w").groupBy(*keys).agg(F.sum("w").alias("w"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(n, *keys).sortWithinPartitions(*keys), "together")


def fit_gbt(train: DataFrame, features: Sequence[str], rounds: int = 60, depth: int = 5, rate: float = 0.1, seed: int = 0, holdout: float = 0.1) -> PipelineModel:
    """Boosted trees on (features, y, w); a tenth of the entities stops them early. Nulls are -1, as trees need a number.

    Equal rows are fitted as one with the sum of their weights, which is the same loss (see _together).
    """
    df = train.na.fill(-1.0, list(features)).withColumn("_valid", hash_holdout(F.col("s1"), holdout, 90 + seed)).withColumn("y", F.col("y").cast("double"))
    if "w" not in df.columns:
        df = df.withColumn("w", F.lit(1.0))
    gbt = GBTClassifier(featuresCol="_x", labelCol="y", weightCol="w", validationIndicatorCol="_valid", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), gbt]).fit(_together(df, features))


def score_gbt(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Adds the probability of a match."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}")
    return model.transform(df.na.fill(-1.0, list(features))).withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fit_bag(train: DataFrame, features: Sequence[str], seeds: Sequence[int], **options: object) -> list[PipelineModel]:
    """One model for each seed."""
    return [fit_gbt(train, features, seed=s, **options) for s in seeds]


def score_bag(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Adds the mean probability of several models."""
    for i, m in enumerate(models):
        df = score_gbt(m, df, features, f"_p{i}")
    return df.withColumn(name, sum(F.col(f"_p{i}") for i in range(len(models))) / len(models)).drop(*[f"_p{i}" for i in range(len(models))])


def save_bag(models: Sequence[PipelineModel], path: str) -> None:
    """One folder a model, in storage that a later session can read."""
    for i, m in enumerate(models):
        m.save(f"{path.rstrip('/')}/{i}")


def load_bag(path: str, n: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path.rstrip('/')}/{i}") for i in range(n)]


#: What a record alone tells about itself (see collective.record_features).
RECORD_FEATURES = (
    "oov_share", "name_tokens", "name_len", "addr_len", "addr_commas", "has_legal", "has_house", "name_upper", "addr_upper",
    "name_digit", "name_punct", "native", "alias", "web", "addr_null", "is_s2",
)


def record_prior(records: DataFrame, truth: DataFrame, regions: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """(mid, rp) for every record, how likely it is that any entity owns it, and one row (n, auc, log_loss) of the records outside.

    ``records`` has RECORD_FEATURES, entity_id, country and region. Only those of ``regions`` (country, region) train the model.
    """
    owned = truth.select(F.col("mid").alias("entity_id")).distinct().withColumn("_t", F.lit(1))
    rows = records.join(owned, "entity_id", "left").withColumn("y", F.coalesce("_t", F.lit(0))).drop("_t").withColumn("s1", F.col("entity_id"))
    inside = regions.select("country", "region").distinct()
    model = fit_gbt(rows.join(inside, ["country", "region"], "left_semi"), RECORD_FEATURES, **options)
    scored = score_gbt(model, rows, RECORD_FEATURES, "rp")
    held = auc_log_loss(scored.join(inside, ["country", "region"], "left_anti").withColumnRenamed("rp", "p"))
    return scored.select(F.col("entity_id").alias("mid"), "rp"), held


def region_folds(entities: DataFrame, folds: int) -> DataFrame:
    """(country, region, fold): whole regions, the largest first, each to the emptiest fold. One row a region is dealt."""
    blocks = entities.groupBy("country", "region").agg(F.count("*").alias("n"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "country", "region"], ascending=[False, True, True])
        filled, out = np.zeros(folds), []
        for n in rows["n"]:
            out.append(int(filled.argmin()))
            filled[out[-1]] += n
        return rows[["country", "region"]].assign(fold=out)

    return blocks.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(deal, "country string, region string, fold int")


def record_group_folds(scored: DataFrame, regions: DataFrame, folds: int) -> DataFrame:
    """(s1, mid, fold): all claims on a record in the fold of its best claimant's region."""
    w = W.partitionBy("mid").orderBy(F.desc("p"), "s1")
    owner = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("mid", "country", "region")
    return scored.select("s1", "mid").join(owner.join(region_folds(regions, folds), ["country", "region"]).select("mid", "fold"), "mid").select("s1", "mid", "fold")


def purged(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows without the entities and records of the test rows."""
    return train.join(test.select("s1").distinct(), "s1", "left_anti").join(test.select("mid").distinct(), "mid", "left_anti")


def out_of_fold(df: DataFrame, features: Sequence[str], folds: int, fit: Callable[..., PipelineModel] = fit_gbt, **options: object) -> DataFrame:
    """Rows with p2 from a model that has not seen their fold."""
    out = None
    for k in range(folds):
        part = score_gbt(fit(df.where(F.col("fold") != k), features, **options), df.where(F.col("fold") == k), features, "p2")
        out = part if out is None else out.unionByName(part)
    return out


def leave_country_out(df: DataFrame, features: Sequence[str], country: str, **options: object) -> DataFrame:
    """The country's rows scored by a model of the others."""
    return score_gbt(fit_gbt(df.where(F.col("country") != country), features, **options), df.where(F.col("country") == country), features)


def rescore(scored: DataFrame, second: DataFrame) -> DataFrame:
    """p2 where there is one, else p."""
    return scored.join(second.select("s1", "mid", "p2"), ["s1", "mid"], "left").withColumn("p", F.coalesce("p2", "p")).drop("p2")


def sweep(df: DataFrame, test: DataFrame, features: Sequence[str], configs: Mapping[str, Mapping[str, object]], metric: Callable[[DataFrame], float]) -> dict[str, float]:
    """A metric of each configuration's scores on ``test``."""
    return {name: metric(score_gbt(fit_gbt(df, features, **options), test, features)) for name, options in configs.items()}


def stack(df: DataFrame, a: str = "p", b: str = "q", label: str = "y") -> DataFrame:
    """Adds ``stacked``: logistic regression on two log odds and their product.

    It is fitted on the distinct rows of scores and label, each with its number as weight, which is the same loss, so that
    rows are neither cached nor turned into vectors; they are scored by an expression.
    """
    terms = lambda: (logit(F.col(a)), logit(F.col(b)), logit(F.col(a)) * logit(F.col(b)))
    rows = df.groupBy(F.col(a), F.col(b), F.col(label).cast("double").alias("_y")).agg(F.count("*").cast("double").alias("_w"))
    rows = rows.select("_y", "_w", *[x.alias(n) for n, x in zip(("_a", "_b", "_ab"), terms(), strict=True)])
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-4)
    model = Pipeline(stages=[VectorAssembler(inputCols=["_a", "_b", "_ab"], outputCol="_x"), lr]).fit(rows).stages[-1]
    z = sum((F.lit(float(c)) * x for c, x in zip(model.coefficients, terms(), strict=True)), F.lit(float(model.intercept)))
    return df.withColumn("stacked", 1 / (1 + F.exp(-z)))


class PairScorer(Protocol):
    """An external scorer: gives a log odds for each pair of texts. It must be picklable; it is called with whole batches."""

    def logits(self, text_a: Sequence[str], text_b: Sequence[str]) -> np.ndarray: ...


class HashedOverlapScorer:
    """A scorer without training: weighted overlap of character 3-grams. It stands in where no encoder is installed."""

    def __init__(self, slope: float = 12.0, middle: float = 0.55):
        self.slope, self.middle = slope, middle

    def logits(self, text_a: Sequence[str], text_b: Sequence[str]) -> np.ndarray:
        grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
        out = []
        for a, b in zip(text_a, text_b, strict=True):
            x, y = grams(a.lower()), grams(b.lower())
            out.append(self.slope * (2 * len(x & y) / (len(x) + len(y)) - self.middle))
        return np.array(out)


def score_texts(pairs: DataFrame, scorer: PairScorer) -> DataFrame:
    """(s1, mid, p_ce, ce_logit) of (s1, mid, text_a, text_b); fails on scores that are not finite."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.asarray(scorer.logits(b["text_a"].tolist(), b["text_b"].tolist()), float)
            if not np.isfinite(z).all():
                raise ValueError("a score is not finite")
            yield pd.DataFrame({"s1": b["s1"], "mid": b["mid"], "p_ce": 1 / (1 + np.exp(-z)), "ce_logit": z})

    return pairs.select("s1", "mid", F.coalesce("text_a", F.lit("")).alias("text_a"), F.coalesce("text_b", F.lit("")).alias("text_b")).mapInPandas(run, "s1 string, mid string, p_ce double, ce_logit double")


def score_new(pairs: DataFrame, known: DataFrame, scorer: PairScorer) -> DataFrame:
    """Known scores and those of pairs without one."""
    new = score_texts(pairs.join(known.select("s1", "mid"), ["s1", "mid"], "left_anti"), scorer)
    return known.select("s1", "mid", "p_ce", "ce_logit").unionByName(new)


def pairs_per_second(pairs: DataFrame, scorer: PairScorer, n: int) -> float:
    """Throughput of a scorer on ``n`` pairs."""
    import time

    rows = pairs.limit(n)
    began = time.time()
    done = score_texts(rows, scorer).count()
    return done / max(time.time() - began, 1e-9)
