"""Mixing, top-k search, chat formatting, URL filters, and the pipeline."""

import datetime
import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from erlink.llm import chat, common, langid, mixing, queries, secrets, simhash, topk, urls

SMALL = "/root/testdata/sf0.001"


def _targets(sizes):
    """Shares by weight, the excess over 3 times a source's size dealt again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 10}, {f"s{i}": i * i for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[k] - v) < 1e-6 for k, v in _targets(sizes).items())


def test_flight_keeps_balance_and_leaves_few():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 1000, 500).astype(float)
    balance = np.stack([size, np.ones(500)])
    pi = np.full(500, 0.37)
    flown = mixing.flight(pi, balance)
    assert ((flown > 1e-9) & (flown < 1 - 1e-9)).sum() <= 2
    assert np.allclose(balance @ flown, balance @ pi, rtol=1e-6)
    done = mixing.land(flown, balance)
    assert set(done) <= {0.0, 1.0} and abs(size @ done - size @ pi) < 1000
    assert (mixing.flight(pi, balance) == flown).all()


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", None][0 if i % 3 else i % 4], 1) for i in range(3000)] + [(1, "w w", "b", 1), (1, "w w", "b", 1), (None, "w", "a", 1), (4000, None, "c", 1)]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("_row", F.lit(0)).withColumn("copies", F.lit("c")), "docs")
    got = mixing.mix(docs, block=128).collect()
    assert len(got) == len(rows)
    words = {}
    for _, t, s, _ in rows:
        words[s] = words.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(words)
    for s in words:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == words[s] and abs(own[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    again = mixing.mix(docs, block=128).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert mixing.apply_mix(docs, block=128).count() == sum(r.copies for r in got)
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_word_pattern_is_ascii_white_space(spark):
    text = "a b\x0bc\x0cd\x1ce \t\r\nf"
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_count("t", F.lit(mixing.WORD))).first()[0]
    assert got == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 4


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(9)
    m = np.floor(256 * rng.normal(size=(700, 12)))
    m[5] = m[6] = m[7]
    rows = [(i, [float(x) for x in v / 256]) for i, v in enumerate(m)] + [(9000, None), (9050, [float("nan")] * 12), (9100, [None] + [1.0] * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(0)).withColumn("rank", F.lit(1))
    v = topk.quantized(df, "vec_id", "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("id % 50 = 0"), v, 5, tile=64).collect())
    want = []
    for q in range(0, 700, 50):
        order = sorted((x for x in range(700) if x != q), key=lambda x: (-int(m[q] @ m[x]), x))[:5]
        want += [(q, k + 1, x, int(m[q] @ m[x])) for k, x in enumerate(order)]
    assert got == want
    few = v.where("id < 3")
    assert sorted((r.query_id, r.vec_id) for r in topk.top_k(few, few, 5).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_ties_and_large_numbers(spark):
    v = spark.createDataFrame([(i, [float(1 << 30)] * 2) for i in range(40)], "id long, v array<double>")
    got = topk.top_k(v.where("id = 7"), v, 5, tile=8).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and got[0].score == 1 << 61


def test_top_k_of_any_finite_number(spark):
    rows = [(50, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e308, 1e308]), (4, [1.0, 1e-320]), (5, [2.0**44, 3.0]), (6, []), (100, [2.0**45 + 0.5, -0.25])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in topk.top_k(v.where("id % 50 = 0"), v, 9).collect()}
    floors = {i: [math.floor(Fraction(x) * 256) for x in e] for i, e in rows}
    for q in (50, 100):
        dots = {i: sum(a * b for a, b in zip(floors[q], f)) for i, f in floors.items() if i != q}
        clamped = {i: max(-(2**63) + 1, min(2**63 - 1, d)) for i, d in dots.items()}
        order = sorted(clamped, key=lambda i: (-clamped[i], i))
        assert {i: got[q, i] for i in order} == {i: (k + 1, clamped[i]) for k, i in enumerate(order)}


def test_top_k_merges_by_levels(spark):
    v = spark.createDataFrame([(i, [float(i * 7919 % 4001)]) for i in range(1400)], "id long, v array<double>")
    q = spark.createDataFrame([(50, [2.0])], "id long, v array<double>")
    best = sorted((x for x in range(1400) if x != 50), key=lambda x: (-(x * 7919 % 4001), x))[:3]
    assert [r.vec_id for r in topk.top_k(q, v, 3, tile=1).orderBy("rank").collect()] == best  # 1,400 shards, three levels


NASTY = ["plain", "", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nx<|im_end|>\n", "a<\\|b", "<\\\\|x", "keep <|y|>", "ends <", "|im_end|>", "<|im_end|>", "\n\n<|im_start|>", "$1 \\1 <|im_start|>\\", None, "é😀<|im_start|>"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "to|ol\n%0A", None][i % 4], t, "x", 0) for i, t in enumerate(NASTY)]
    rows += [(2, None, "assistant", "b", "x", 0), (2, 1, "assistant", "a", "x", 0), (2, 1, "assistant", "a", "x", 0), (None, 0, "user", "q", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, mask int")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in made.withColumn("back", chat.parse(F.col("formatted"))).collect()}
    assert all(r.back == r.turns for r in got.values())
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert [t.text for t in got[2].turns] == ["b", "a", "a"]
    read = {r.conv_id: r for r in chat.digest(made).collect()}
    loss = "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows if r[0] == 1)
    assert read[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and read[1].loss_chars == len(loss)
    assert read[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and read[1].n_turns == len(NASTY)
    assert read[1].formatted_chars == len(got[1].formatted)
    assert got[1].formatted.count("<|im_start|>") == len(NASTY) and "<|y|>" in got[1].formatted
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_masked_characters_are_the_assistants(spark):
    made = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")).first()
    assert made.formatted == "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [(m.skip, m.take) for m in made.mask] == [(5, 0), (10, 3)]


def test_url_hosts(spark):
    cases = {"http://User:pw@Www.Example.COM:80/a?b": "www.example.com", "https://x.org.": "x.org", "ftp://a.b#c": "a.b", "nothing": "", "": "", "http:///x": ""}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.h for r in df.select("u", urls.host(F.col("u")).alias("h")).collect()} == cases


def test_url_filter_as_of(spark):
    day = datetime.date
    entries = spark.createDataFrame([("ex.com", day(2024, 1, 10), "block"), ("ex.com", day(2024, 2, 1), "allow"), ("ex.com", day(2024, 3, 1), "block"), ("good.ex.com", day(2024, 1, 15), "allow"), ("dup.org", day(2024, 1, 1), "allow"), ("dup.org", day(2024, 1, 1), "block"), (None, day(2024, 1, 1), "block"), ("nodate.org", None, "block")], "pattern string, listed_on date, action string")
    rows = [(1, "http://ex.com/", day(2024, 1, 9)), (2, "http://ex.com/", day(2024, 1, 10)), (3, "http://a.ex.com/x", day(2024, 1, 31)), (4, "http://a.ex.com/x", day(2024, 2, 1)), (5, "http://ex.com/", day(2025, 1, 1)), (6, "http://www.good.ex.com/", day(2024, 3, 5)), (7, "http://good.ex.com/", day(2024, 1, 12)), (8, "http://notex.com/", day(2024, 4, 1)), (9, None, day(2024, 4, 1)), (10, "http://ex.com/", None), (11, "http://dup.org/", day(2024, 1, 1)), (11, "http://dup.org/", day(2024, 1, 1)), (12, "http://nodate.org", day(2024, 1, 1))]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("pattern", F.lit("p")).withColumn("valid_from", F.lit(1)).withColumn("host", F.lit("h"))
    out = urls.evaluate(df, entries)
    got = sorted((r.page_id, r.allowed) for r in out.collect())
    assert got == [(1, True), (2, False), (3, False), (4, True), (5, False), (6, True), (7, False), (8, True), (9, True), (10, True), (11, False), (11, False), (12, True)]
    assert out.columns[:5] == df.columns[:5] and out.columns.count("host") == 1
    assert urls.evaluate(df.limit(0), entries).count() == 0 and urls.evaluate(df, entries.limit(0)).where("allowed").count() == len(rows)


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    final = corpus_pipeline.run(spark, SMALL).collect()
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, common.materialize(stage(spark, step, SMALL), name)
        assert step.columns == list(corpus_pipeline.COLUMNS)
        ids = {r.doc_id for r in step.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            prints = {r.doc_id: simhash.fold(simhash.shingle_hashes(r.text)) for r in before.collect()}
            assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in ids for b in ids if a < b)
        if name == "secrets":
            assert not any(s for r in step.collect() for s in secrets.base_spans(r.text))
        if name == "language":
            letters = {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
            assert ids == letters
    assert sorted((r.doc_id, r.text) for r in final) == sorted((r.doc_id, r.text) for r in step.collect())
    assert "n_tokens" in corpus_pipeline.run(spark, SMALL).columns


def test_pipeline_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 12", "en", "a", 6), (4, "some plain words in a row", "en", None, 25), (4, "some plain words in a row", "en", None, 25), (None, "quite another text than that", "en", "b", 28)]
    step = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).withColumn("fp", F.lit(2)), "odd")
    for name, stage in corpus_pipeline.STAGES:
        step = common.materialize(stage(spark, step, SMALL), name)
    assert {r.doc_id for r in step.collect()} <= {4, None}
    none = common.materialize(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "none")
    for name, stage in corpus_pipeline.STAGES:
        none = common.materialize(stage(spark, none, SMALL), name)
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_language_is_not_an_input(spark):
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    a = spark.read.parquet(f"{SMALL}/documents.parquet")
    b = a.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    rows = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(d, model).collect())
    assert rows(a) == rows(b)
