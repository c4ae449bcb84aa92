"""SimHash near-duplicates: fingerprints, a segment-popcount grid that bounds their distance, exact verification.

A fingerprint is embedded as the vector of its 32 two-bit segments' popcounts. Flipping a bit moves one coordinate by one,
so the Manhattan distance of two vectors is at most the Hamming distance of the fingerprints. Vectors at distance 2 or less
agree on one half of their coordinates, or differ by exactly one step in each half. The grid's cells are therefore the unit
cells of a half: every fingerprint is stored in the cells of its two halves and looks into the cells one step down in the
first half; whoever is one step up finds it from the other side. Pairs that meet are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SEED = 42
#: byte value -> eight 8-bit counters, one for each of its bits, in one 64-bit word
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, words joined by one space; the whole text if it has fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(line, SEED)], np.uint64)
    starts = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    ends = (starts - 1)[words - 1 :].tolist()
    begins = [0, *starts[: len(tokens) - words].tolist()]
    return np.fromiter([h(line[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64, len(begins))


def fold(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as an unsigned number; 0 for no hash."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    lanes = _LANES[hashes.view(np.uint8)].reshape(n, 8)
    for part in np.add.reduceat(lanes, np.arange(0, n, 255), axis=0):  # a counter holds 255
        counts += part.view(np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """All columns but the text, and ``fp`` (the 64 bits as a signed long, replaced if there); null and blank texts have 0. A map without shuffle."""
    names = [n for n in docs.columns if n not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fold(shingle_hashes(t.as_py(), words)) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*names, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*names, text_col).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "fp long"]))


def _half(fp: str, half: int, down: int | None = None) -> F.Column:
    """Popcounts of the 16 two-bit segments of a half, two bits each; ``down``: with one less in that coordinate."""
    bits = F.expr(f"shiftrightunsigned({fp}, {32 * half}) & 4294967295L")
    counts = (bits.bitwiseAND(F.lit(0x55555555))) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))
    return counts if down is None else counts - F.lit(1 << (2 * down))


def _unary(fp: str) -> F.Column:
    """The 32 popcounts as 64 bits, 0 as 00, 1 as 01 and 2 as 11: the Manhattan distance of two is the number of bits that differ."""
    return F.expr(f"shiftleft({fp} & shiftrightunsigned({fp}, 1) & 6148914691236517205L, 1) | (({fp} | shiftrightunsigned({fp}, 1)) & 6148914691236517205L)")


def linked(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``) that differ in at most 2 bits, from the grid join.

    Pairs that meet in a cell are first held against the distance of their embeddings, over all 32 segments, and then
    verified. An empty table gives none; no fingerprint may be null. A cell fixes 16 of the 32 counts, some 24 bits of
    information: up to about 10**8 distinct fingerprints a cell holds a handful, beyond that pairs that only meet grow with
    the square of the input.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the grid finds pairs of up to 2 differing bits")
    store = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("h"), _half("fp", 0).alias("c")), F.struct(F.lit(1).alias("h"), _half("fp", 1).alias("c")))).alias("k")).select("fp", "k.h", "k.c")
    steps = F.expr("filter(transform(sequence(0, 15), i -> named_struct('i', i, 'n', shiftright(_c, 2 * i) & 3L)), s -> s.n > 0)")
    down = fps.withColumn("_c", _half("fp", 0)).select("fp", F.explode(steps).alias("s"), "_c").select("fp", F.lit(0).alias("h"), F.expr("_c - shiftleft(1L, 2 * s.i)").alias("c"))
    manhattan, hamming = f"bit_count(s.u ^ p.u) <= {bits}", f"bit_count(s.fp ^ p.fp) <= {bits}"
    probe = store.select("fp", "h", "c", F.lit(True).alias("same")).unionByName(down.select("fp", "h", "c", F.lit(False).alias("same")))
    store, probe = (df.withColumn("u", _unary("fp")) for df in (store, probe))
    pairs = store.alias("s").join(probe.alias("p"), F.expr(f"s.h = p.h AND s.c = p.c AND (NOT p.same OR s.fp < p.fp) AND {manhattan} AND {hamming}"))
    return pairs.select(F.expr("least(s.fp, p.fp)").alias("a"), F.expr("greatest(s.fp, p.fp)").alias("b")).distinct()


def groups(prints: DataFrame, id_col: str = "doc_id", bits: int = 2) -> DataFrame:
    """All rows of ``prints`` (from :func:`fingerprints`, stored) and ``component_id``, the smallest id reachable by links.

    Equal fingerprints are one node of the graph, so that copies of any number cost one row. Null ids are not the smallest
    unless a component has no other. Empty input gives an empty result.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "fps")
    roots = connected_components(linked(nodes, bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_root", F.coalesce("root", "fp")).select("fp", "_least", "_root")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    labels = materialize(rooted.join(least, "_root").select("fp", "component_id"), "labels")
    return prints.drop("component_id").join(labels, "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row of ``docs``, a stored table, for each group of near-duplicates: the one with the smallest id, of equal ids the first row.

    Rows are told apart by their place in the scan, which is the same in every run over one stored table.
    """
    placed = docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    prints = materialize(fingerprints(placed.select(F.col("_doc")[id_col].alias("_id"), F.col("_doc")[text_col].alias("_text"), "_row"), "_text"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("_first")), "fps")
    roots = connected_components(linked(nodes, bits))
    kept = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("_root")).agg(F.min("_first").alias("_first")).select(F.col("_first.r").alias("_row"))
    return placed.join(kept, "_row", "left_semi").select("_doc.*")
