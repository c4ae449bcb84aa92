"""SimHash, suffix and embedding duplicates against brute force, and their edges."""

import hashlib
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from erlink.llm import common, pivots, queries, simhash, suffix


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _components(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        a, b = _root(parent, a), _root(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _root(parent, n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    want = _components({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in common.connected_components(df).collect()}
    assert got == {n: r for n, r in want.items() if n in got}
    assert all(n == r for n, r in want.items() if n not in got)
    assert common.connected_components(df.limit(0)).count() == 0


def _slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d", "x " * 1000, "É à b c d e", "w\x0bx\x0cy\x1cz q r"])
def test_fingerprint(text):
    assert simhash.fold(simhash.shingle_hashes(text)) == _slow_print(text)


def test_fingerprint_hash_is_the_engines(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("über uns"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("über uns".encode(), 42)


def test_grid_join_loses_nothing(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 60)] + [0, 2**64 - 1]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))] + [b ^ 7 for b in base]
    prints = sorted({np.uint64(x).astype(np.int64).item() for x in base + near})
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2}
    rows = simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want) > 500


def test_simhash_groups_and_edges(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here " * 20
    docs = spark.createDataFrame([(5, text, "z", 1), (3, text.upper(), "z", 1), (9, "other words entirely " * 30, "z", 1), (7, None, "z", 1), (8, " ", "z", 1), (None, text, "z", 1), (5, text, "z", 1)], "doc_id long, text string, fp string, _row int")
    prints = common.materialize(simhash.fingerprints(docs.withColumn("component_id", F.lit("c"))), "t")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.groups(prints).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 9), ("7", 7), ("8", 7), ("None", 3), ("5", 3)])
    kept = simhash.deduplicate(common.materialize(docs, "d"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9] and kept.columns == docs.columns
    assert simhash.groups(prints.limit(0)).count() == 0
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_op6_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: _slow_print(r.text) for r in docs}
    ids = sorted(fp)
    want = _components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def _slow_cut(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out.append((str(i), len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("pack", [150, 300, 1500, 1 << 20])
def test_suffix_against_brute_force(spark, pack):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, other = word(400), word(260)
    rows = [(i, word(int(rng.integers(0, 500))) + (shared[int(rng.integers(0, 150)) :] if i % 3 == 0 else "") + word(int(rng.integers(0, 99))) + (other if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100, "x" * 900), (101, None), (102, ""), (103, word(199)), (None, shared), (104, shared[:200]), (105, shared[:199]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit(1)).withColumn("data", F.lit("x")).repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, pack_bytes=pack, range_bytes=4000).collect())
    assert got == _slow_cut(rows, 200)


def test_suffix_edges(spark):
    df = spark.createDataFrame([(1, "ab" * 150), (2, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix.remove_repeats(df, texts=True).collect()}
    assert rows[1].n_removed == 300 and rows[1].kept == b"" and rows[2].kept == b"short"
    assert suffix.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, length=50)


def test_difference_cover_is_perfect():
    found = Counter((a - b) % suffix.COVER_MOD for a in suffix.COVER for b in suffix.COVER if a != b)
    assert set(found) == set(range(1, suffix.COVER_MOD)) and set(found.values()) == {1}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 16))
    vecs = np.concatenate([centers, centers + rng.normal(scale=0.03, size=centers.shape), centers + rng.normal(scale=0.09, size=centers.shape), np.tile(centers[0], (5, 1))])
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [1.0] * 16, None), (504, [None] + [1.0] * 15, 1), (505, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("pivot", F.lit("a"))
    got = {r.vec_id: r for r in pivots.near_duplicates(df, references=24, nearest=12, lead=8, shared=2, tile=16).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(len(vecs)) for j in range(i) if i % 3 == j % 3 and unit[i] @ unit[j] >= 0.98]
    links = Counter(x for p in pairs for x in p)
    want = _components(range(len(vecs)), pairs)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(pairs) > 40
    assert all(got[i].n_links <= links[i] for i in range(len(vecs)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(vecs))]) >= 0.9
    for i in range(500, 506):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) and got[None].n_links == 0
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_embedding_copies_count_each_other(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, 1.0], 1) for i in range(9)] + [(20, [1.0, 0.0, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect()}
    assert got == {i: (8, 0, i == 0) for i in range(9)} | {20: (0, 20, True)}


def test_embeddings_of_any_length_and_size(spark):
    rows = [(1, [1.0, 1.0, 1.0], 1), (2, [1.0, 1.0, 1.001], 1), *[(10 + i, [float(i + 1), 1.0, 0.0, float(-i)], 1) for i in range(6)]]
    rows += [(30, [1e200, 1e200], 1), (31, [1e200, 1.0001e200], 1), (32, [1e-200, 1e-200], 1), (33, [1e-200, 1e-201], 1), (34, [1e-320, 1e-320], 1), (35, [1.0, 1.0], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1)
    assert [got[i] for i in (30, 31, 32, 34)] == [(3, 30)] * 4 and got[33] == (0, 33) and got[35] == (0, 35)


def test_embeddings_with_a_third_in_one_group(spark):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(2400, 64))
    vecs[:800] = vecs[0] / np.linalg.norm(vecs[0]) + 0.1 * rng.normal(size=(800, 64)) / 8
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    assert links[:800].mean() > 500
    assert sum(r.n_links for r in got.values()) >= 0.99 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(2400))
    assert all(got[i].component_id == 0 for i in range(800))


def test_suffix_false_first_names_remove_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    rows = [(1, word(500)), (2, word(500)), (3, word(300)), (5, "x" * 450)]
    rows.append((4, rows[2][1][:250] + word(50)))
    real = suffix.remove_repeats.__globals__["_open"]

    def poor(data, lengths):  # names of two bits: most places have false company
        pack = real(data, lengths)
        names = pack.names
        pack.names = lambda at, width: names(at, width) & np.uint64(3 << 62)
        return pack

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix)
    monkeypatch.setattr(suffix, "_open", poor)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(suffix)
    assert got == _slow_cut(rows, 200)


def test_stored_results_leave_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    jvm, was = spark.sparkContext._jvm, spark.conf.get(setting)

    def files():
        dirs = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {str(p) for d in dirs for p in Path(d).rglob("shuffle_*")}

    before = files()
    df = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    end = time.time() + 10
    while files() - before and time.time() < end:  # they are deleted beside the work
        time.sleep(0.1)
    assert not files() - before
    assert df.count() == 7 and spark.conf.get(setting) == was
