"""Language identification: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
#: Odd multipliers of the n-gram hash, one for each place of a character.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Log-probabilities less their mean over languages: ``weights[language, order, slot]``, and log priors."""

    languages: tuple[str, ...]
    priors: np.ndarray
    weights: np.ndarray
    bits: int


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts and ends of the texts in one array of folded characters, slots by order, and which characters are letters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 2) - 2 + 1
    starts = ends - lengths
    folded = _fold()[np.frombuffer((" " + "".join([t + "  " for t in texts]) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = int(ends[-1]) + 1 if len(texts) else 1
    h = np.zeros(n, np.uint32)
    slots = []
    for k in ORDERS:  # grams begin one character early, so that word starts at the text's start count
        h = h * np.uint32(31) + folded[k - 1 : k - 1 + n] * np.uint32(MULTIPLIERS[k - 1])
        slots.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))
    return starts, ends, slots, folded[:n] != 32


def _blocks(texts: list[str], size: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters; a longer text has a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _labelled(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return docs.where(f"`{text_col}` IS NOT NULL AND `{label_col}` IS NOT NULL AND crc32(CAST(`{id_col}` AS STRING)) % 4 <> 2")


#: Most labels whose sampling rates are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000


def _training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, labels: int) -> DataFrame:
    labelled = _labelled(docs, id_col, text_col, label_col)
    rates = labelled.groupBy(F.col(label_col).alias("_label")).agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("_rate"))
    rates = F.broadcast(rates) if labels <= FEW_LABELS else rates
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return labelled.select(F.col(label_col).alias("_label"), F.col(text_col).alias("_text"), chance.alias("_chance")).join(rates, "_label").where("_chance < _rate").select("_label", "_text")


#: Most bytes of the broadcast matrix.
MATRIX_BYTES = 768 << 20


def slot_bits(languages: int, bits: int) -> int:
    """``bits``, or fewer where the matrix of that many languages would be larger than MATRIX_BYTES."""
    return min(bits, max(4, (MATRIX_BYTES // (8 * len(ORDERS) * max(1, languages))).bit_length() - 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 2000, bits: int = 16, alpha: float = 0.1) -> Model:
    """Fit on about ``per_language`` whole texts of each language, chosen by a hash of the id (the documented bound).

    Rows with null text, null label, or an id whose crc32 modulo 4 is 2 are never used; repeated rows count as often as they
    are chosen. Only sums reach the driver, languages x orders x 2**bits at most; from 489 languages on, slots get fewer so
    that these stay within MATRIX_BYTES. With no usable row the model has no language and everything is ``und``.
    """
    labels = _labelled(docs, id_col, text_col, label_col).select(label_col).distinct().count()
    bits = slot_bits(labels, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                starts, ends, slots, _ = _grams(texts[a:b], bits)
                for i in range(b - a):
                    into = sums.setdefault(labels[a + i], np.zeros((len(ORDERS), 1 << bits), np.int64))
                    docs_of[labels[a + i]] = docs_of.get(labels[a + i], 0) + 1
                    for k in range(len(ORDERS)):
                        into[k] += np.bincount(slots[k][starts[i] - 1 : ends[i]], minlength=1 << bits)
        for label, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(into.ravel()[at], docs_of[label]))], ["label", "slot", "n"])

    rows = _training_rows(docs, id_col, text_col, label_col, per_language, labels).mapInArrow(count, "label string, slot long, n long")
    table = rows.groupBy("label", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(table["label"].unique()))
    counts = np.zeros((len(names), len(ORDERS) << bits))
    priors = np.zeros(len(names))
    for i, name in enumerate(names):
        own = table[table["label"] == name]
        cells = own[own["slot"] >= 0]
        counts[i, cells["slot"].to_numpy()] = cells["n"].to_numpy()
        priors[i] = own.loc[own["slot"] < 0, "n"].sum()
    counts = counts.reshape(len(names), len(ORDERS), 1 << bits)
    if not names:
        return Model((), priors, counts, bits)
    logs = np.log(counts + alpha) - np.log((counts + alpha).sum(2, keepdims=True))
    logs -= logs.mean(0, keepdims=True)
    logs[:, counts.sum(0) == 0] = 0  # slots of an order that nobody has seen say nothing
    return Model(names, np.log(priors / priors.sum()), np.ascontiguousarray(logs), bits)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text."""
    best: list[str] = []
    sure = np.zeros(len(texts))
    whole = [t or "" for t in texts]
    for a, b in _blocks(whole):
        starts, ends, slots, letters = _grams(whole[a:b], model.bits)
        cuts = np.stack([starts - 1, ends], 1).ravel()
        has = np.add.reduceat(letters.astype(np.int64), np.minimum(cuts, len(letters) - 1))[::2] > 0
        has &= ends > starts
        total = np.tile(model.priors, (b - a, 1))
        for i in range(len(model.languages)):
            for k in range(len(ORDERS)):
                total[:, i] += np.add.reduceat(np.append(model.weights[i, k][slots[k]], 0.0), cuts)[::2]
        if model.languages:
            total -= total.max(1, keepdims=True)
            p = np.exp(total)
            sure[a:b] = np.where(has, p.max(1) / p.sum(1), 0.0)
            best += [model.languages[j] if h else UNKNOWN for j, h in zip(total.argmax(1), has, strict=True)]
        else:
            best += [UNKNOWN] * (b - a)
    return best, sure


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (columns of these names are replaced); a map without shuffle.

    The label, source and id columns are not looked at. Null and letterless texts give ``und`` and 0.0. Equal texts give equal
    results, ties go to the first language by name. The matrix is broadcast: languages x 3 x 2**bits numbers, whatever the input.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = score(shared.value, batch.column(names.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(sure)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
