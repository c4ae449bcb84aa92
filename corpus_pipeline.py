"""A corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens. Each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from erlink.llm import bpe, langid, mixing, secrets, simhash
from erlink.llm.common import materialize, read, small_batches
from erlink.llm.queries import RANK_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go. The predicted language replaces the given one."""
    small_batches(spark)
    scored = langid.predict(docs.select(*COLUMNS), langid.train(docs)).where(f"lang_pred <> '{langid.UNKNOWN}'")
    return scored.select("doc_id", "text", scored.lang_pred.alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    small_batches(spark)
    return simhash.deduplicate(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark."""
    small_batches(spark)
    net = secrets.train(secrets.corpus_findings(docs, held_out=None))
    return secrets.redact(docs.select(*COLUMNS), net)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times."""
    small_batches(spark)
    return mixing.apply_mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text decoded from its tokens, with their number."""
    small_batches(spark)
    return bpe.round_trip(docs.select(*COLUMNS), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", mix), ("tokens", tokens)]

#: Trained and iterative stages have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
