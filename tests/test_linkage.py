"""Blocking, features, decisions and evaluation on inline frames."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from erlink.functions import kernels
from erlink.operators import audit, collective, decide, evaluate, exports, models, pairs
from erlink.operators import blocking as B
from erlink.plans import decide_queries, fixtures

REC = "entity_id string, country string, region string, n_core string, n_compact string, a_tokens string, a_house string, a_null int"


def rec(spark, *rows):
    return spark.createDataFrame([(i, c, r, n, n.replace(" ", ""), a, h, int(not a)) for i, c, r, n, a, h in rows], REC)


def scored(spark, *rows):
    return spark.createDataFrame([(a, b, float(p)) for a, b, p in rows], "s1 string, mid string, p double")


def _grams(s):
    return [s[i : i + 3] for i in range(len(s) - 2)]


def test_tfidf_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcde"), int(rng.integers(1, 9))))
    s1 = rec(spark, *[(f"S1-{i}", "c", f"r{i % 2}", word(), "x", "") for i in range(20)])
    pool = rec(spark, *[(f"S2-{i}", "c", f"r{i % 2}", word(), "x", "") for i in range(30)])
    got = {(r.s1, r.mid): r.cos for r in B.text_pass(s1, pool, "n_compact", 4).collect()}
    want = {}
    for block in ("r0", "r1"):
        q = {r.entity_id: _grams(r.n_compact) for r in s1.where(F.col("region") == block).collect()}
        p = {r.entity_id: _grams(r.n_compact) for r in pool.where(F.col("region") == block).collect()}
        docs = [*q.values(), *p.values()]
        df = {t: sum(t in d for d in docs) for d in docs for t in d}

        def unit(d, n=len(docs), df=df):
            w = {t: (1 + math.log(d.count(t))) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(d)}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / norm for t, x in w.items()}

        for a, ga in q.items():
            ua = unit(ga)
            sims = sorted(((round(sum(x * unit(gb).get(t, 0) for t, x in ua.items()), 6), b) for b, gb in p.items()), key=lambda x: (-x[0], x[1]))
            want |= {(a, b): c for c, b in sims[:4] if c >= 0.05}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_blocking_passes(spark):
    s1 = rec(spark, ("S1-1", "c", "r", "red fox", "1 main st", "1"), ("S1-2", "c", "", "blue owl", "2 oak rd", "2"), ("S1-3", "c", "q", "ab", "", ""))
    pool = rec(spark, ("S2-1", "c", "r", "red fox", "1 main st", "1"), ("S2-2", "c", "", "red fox", "", ""), ("S3-3", "c", "z", "blue owl", "2 oak rd", "2"), ("S3-4", "d", "r", "red fox", "1 main st", "1"))
    leaks = spark.createDataFrame([("c", "r", "z")], "country string, region string, m_region string")
    got = {(r.s1, r.mid): (r.name_cos, r.addr_cos, r.hit) for r in B.generate(s1, pool, 5, 5, 5, 5, 5, 5, leaks, True).collect()}
    assert got["S1-1", "S2-1"] == (1.0, 1.0, B.NAME | B.ADDRESS | B.COMBINED | B.EXACT | B.REVERSE)
    assert got["S1-1", "S2-2"] == (1.0, 0.0, B.FALLBACK | B.EXACT | B.REVERSE)
    assert got["S1-2", "S3-3"][2] & (B.NAME | B.ADDRESS) == B.NAME | B.ADDRESS
    assert not any(m == "S3-4" or s == "S1-3" for s, m in got)
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-3", "S2-2")], "s1 string, mid string")
    rows = {r["pass"]: (r.pairs, r.found) for r in B.recall(B.generate(s1, pool, 5, 5, 5), truth).collect()}
    assert rows[0] == (2, 1) and rows[B.FALLBACK] == (2, 0)
    assert [(r.relation, r.n) for r in B.missed(truth, B.generate(s1, pool, 5, 5, 5), s1, pool).collect()] == [("no region", 1)]
    assert {(r.s1, r.mid) for r in B.containment_pass(s1, pool).collect()} == {("S1-1", "S2-1")}
    assert {(r.s1, r.mid) for r in B.reverse_pass(s1, pool).collect()} == {("S1-1", "S2-2")}


def test_every_candidate_has_both_cosines(spark):
    s1 = rec(spark, ("S1-1", "c", "r", "red fox", "1 main st", "1"))
    pool = rec(spark, ("S2-1", "c", "r", "red fox", "9 elm st", "9"), ("S2-2", "c", "r", "red owl", "1 main st", "1"), ("S2-3", "c", "", "red fox", "1 main st", ""))
    one = {r.mid: r for r in B.generate(s1, pool, 1, 0, 1).collect()}
    assert set(one) == {"S2-1", "S2-3"} and one["S2-1"].hit == B.NAME and 0 < one["S2-1"].addr_cos < 1 and one["S2-3"].addr_cos == 1.0
    by_address = {r.mid: r for r in B.generate(s1, pool, 0, 1, 0).collect()}
    assert set(by_address) == {"S2-2"} and 0 < by_address["S2-2"].name_cos < 1 and by_address["S2-2"].addr_cos == 1.0


@pytest.mark.parametrize("tile", [3, 4096])
def test_tiles_do_not_change_a_search(spark, tile):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abc"), int(rng.integers(3, 9))))
    s1 = rec(spark, *[(f"S1-{i}", "c", "r", word(), f"{i % 3} {word()}", "") for i in range(12)])
    pool = rec(spark, *[(f"S2-{i}", "c", "r", word(), f"{i % 3} {word()}", "") for i in range(17)])
    passes = [B.Pass("name", 3, 1), B.Pass("address", 3, 2), B.Pass("combined", 3, 4), B.Pass("held", 2, 8, "mid"), B.Pass("name", 2, 16, "mid")]
    got = {(r.s1, r.mid): r for r in B.search([(s1, pool, ["country"], passes)], tile=tile).collect()}
    whole = [B.Pass(p.score, 999, p.hit, p.by, p.least) for p in passes]
    every = [r for r in B.search([(s1, pool, ["country"], whole)]).collect()]
    want = {}
    for p, col in zip(passes, ("name_cos", "addr_cos", "both", "held", "name_cos"), strict=True):
        for key in {r[p.by] for r in every}:
            rows = sorted((r for r in every if r[p.by] == key and r[col] >= p.least), key=lambda r: (-r[col], r.mid if p.by == "s1" else r.s1))
            for r in rows[: p.k]:
                want[r.s1, r.mid] = want.get((r.s1, r.mid), 0) | p.hit
    assert {k: r.hit for k, r in got.items()} == want


@pytest.mark.parametrize("tile", [2, 4096])
def test_repeated_texts_do_not_change_a_search(spark, tile, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("ab"), int(rng.integers(2, 6))))
    side = lambda p, n: rec(spark, *[(f"{p}-{i}", "c", "r", word(), f"{i % 2} {word()[:3]}" if i % 5 else "", "") for i in range(n)])
    s1, pool = side("S1", 40), side("S2", 60)
    passes = [B.Pass("name", 4, 1), B.Pass("address", 3, 2), B.Pass("held", 2, 8, "mid", 0.4), B.Pass("name", 3, 16, "mid")]
    joint = {(r.s1, r.mid): r for r in B.search([(s1, pool, ["country"], [*passes, B.Pass("combined", 3, 32)])]).collect()}
    shapes = []
    monkeypatch.setattr(B, "_tiled", lambda rows, *a, t=B._tiled: (shapes.append(rows.groupBy("side").count().collect()), t(rows, *a))[1])
    got = {(r.s1, r.mid): r for r in B.search([(s1, pool, ["country"], passes)], tile=tile).collect()}
    assert {k: r.hit for k, r in got.items()} == {k: r.hit & 31 for k, r in joint.items() if r.hit & 31}
    for k, r in got.items():
        assert [r.name_cos, r.addr_cos, r.both, r.held] == pytest.approx([joint[k].name_cos, joint[k].addr_cos, joint[k].both, joint[k].held], abs=2e-6)
    names = {r.side: r["count"] for r in shapes[0]}  # products are of distinct texts, not of rows
    assert names[0] <= s1.select("n_compact").distinct().count() < 40 and names[1] <= pool.select("n_compact").distinct().count() < 60


def test_two_texts_are_multiplied_once(spark, monkeypatch):
    """Cosines belong to texts: 40 copies of a record add pairs, not products."""
    names, streets = ["red ring", "blue bolt", "red bolt"], ["1 main street", "2 side street"]
    row = lambda p, i: (f"{p}{i:04}", "X", "r", names[i % 3].replace(" ", ""), streets[i % 2])
    columns = "entity_id string, country string, region string, n_compact string, a_tokens string"
    side = lambda p, n: spark.createDataFrame([row(p, i) for i in range(n)], columns)
    kept = []
    store = B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name: kept.append((name, store(df, name))) or kept[-1][1])
    pairs = B.generate(side("a", 6), side("b", 240), 300, 300, 0).collect()
    assert len(pairs) == 6 * 240 and all(r.addr_cos == 1 for r in pairs if int(r.s1[1:]) % 2 == int(r.mid[1:]) % 2)
    assert sorted(df.count() for name, df in kept if name == "products") == [4, 9]


def test_exact_keys_are_capped(spark):
    s1 = rec(spark, *[(f"S1-{i}", "c", "r", "same name", "x", "") for i in range(3)])
    pool = rec(spark, *[(f"S2-{i}", "c", "r", "same name", "x", "") for i in range(4)])
    assert B.exact_key_pass(s1, pool).count() == 12 and B.exact_key_pass(s1, pool, most_pool=3).count() == 0 and B.exact_key_pass(s1, pool, most_s1=2).count() == 0


def test_frequent_terms_drop_in_large_blocks(spark):
    df = rec(spark, *[(f"S1-{i}", "c", "r", "x", f"common w{i}", "") for i in range(30)])
    terms = B.weights(df, ["country"], ["entity_id"], B.words("a_tokens"), max_df=0.5, max_df_above=20)
    assert terms.where("term = 'common'").count() == 0 and terms.count() == 30


def test_house_and_token_features(spark):
    df = spark.createDataFrame([("a", "S3-1", "12", "21", "12 5", "21 12", "x y", "y z"), ("b", "S2-1", "", "3", "", "3", "", "q"), ("c", "S2-2", "100", "10", "100", "10", "a a", "a")], "s1 string, mid string, a_house_s string, a_house_c string, a_nums_s string, a_nums_c string, n_core_s string, n_core_c string")
    got = {r.s1: r for r in pairs.token_overlap(pairs.house(df), "n_core", "nt").collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.house_both, a.house_eq, a.house_len_eq, a.house_perm, a.house_s_in_cnums, a.house_c_in_snums) == (1, 0, 1, 1, 1, 0)
    assert b.house_c_in_snums == 0 and pairs.house(df.withColumns({"a_house_s": F.lit("7"), "a_house_c": F.lit("7")})).where("house_perm = 1 AND house_eq = 1").count() == 3
    assert pairs.house(df.where("s1 = 'b'").withColumn("a_house_c", F.lit(""))).first().house_c_in_snums == 1
    assert abs(a.house_gap - math.log1p(9)) < 1e-9 and b.house_gap == -1 and b.house_both == 0 and (c.house_sub, c.house_last_eq) == (1, 1)
    assert (round(a.nt_jacc, 6), a.nt_s_in_c, a.nt_n1) == (round(1 / 3, 6), 0.5, 2) and b.nt_jacc == 0 and b.nt_s_in_c == 0 and c.nt_jacc == 1


def test_idf_containment(spark):
    s1 = rec(spark, ("S1-1", "c", "r", "red fox", "x", ""), ("S1-2", "c", "r", "red owl", "x", ""), ("S1-3", "c", "r", "", "x", ""))
    df = spark.createDataFrame([("S1-1", "m", "c", "red fox", "red new", "rednew"), ("S1-3", "m", "c", "", "", ""), ("S1-2", "m", "c", "red owl", "fox new red", "foxnewred")], "s1 string, mid string, country_s string, n_core_s string, n_core_c string, n_compact_c string")
    got = {r.s1: r for r in pairs.idf_containment(df, s1).collect()}
    red, fox = math.log(3 / 2), math.log(3)
    assert abs(got["S1-1"].nm_idf_s_in_c - red / (red + fox)) < 1e-9 and abs(got["S1-1"].nm_extra_tok_idf - fox) < 1e-9
    assert (got["S1-1"].rare_tok_hit, got["S1-1"].rare_tok_sub) == (0, 0) and abs(got["S1-1"].rare_tok_idf - fox) < 1e-9 and got["S1-3"].nm_idf_total1 == 0
    assert abs(got["S1-2"].nm_extra_tok_idf - fox) < 1e-9  # the larger of two new words, not their sum


def test_direct_checks_and_neighbours(spark):
    cols = "s1 string, mid string, n_core_s string, n_core_c string, n_compact_s string, n_compact_c string, a_tokens_s string, a_tokens_c string, a_house_s string, a_house_c string, region_s string, region_c string, a_null_c int"
    df = spark.createDataFrame([("S1-1", "S2-1", "red fox lille", "fox lille", "redfoxlille", "foxlille", "1 rue lille", "1 rue", "1", "1", "r", "r", 0), ("S1-2", "S2-2", "owl", "", "owl", "", "", "", "", "", "", "", 1)], cols)
    got = {r.s1: r for r in collective.direct_checks(df).collect()}
    a, b = got["S1-1"], got["S1-2"]
    assert (a.pf_name_tset, a.pf_house_eq, a.pf_house_both, a.pf_c_addr_null, a.pf_region_eq, a.pf_name_exact) == (100, 1, 1, 0, 1, 0)
    assert abs(a.pf_name_ratio - 200 * 8 / 19) < 1e-9 and (b.pf_house_eq, b.pf_c_addr_null, b.pf_region_eq) == (0, 1, 1)
    s1 = rec(spark, ("S1-1", "c", "r", "red fox lille", "1 rue lille", "1"), ("S1-3", "c", "r", "fox lille", "1 rue lille", "1"), ("S1-4", "c", "r", "red fox lille", "1 rue lille", "1"), ("S1-2", "c", "r", "owl", "", ""))
    near = {r.s1: r for r in collective.address_neighbours(df, s1).collect()}
    assert (near["S1-1"].nb_n, near["S1-1"].nb_best, near["S1-1"].nb_margin) == (2, 100, 0) and near["S1-1"].nm_nocity == 100
    assert (near["S1-2"].nb_n, near["S1-2"].nb_best, near["S1-2"].nb_margin) == (0, 0, 0)


def test_hubs_name_classes_and_typo_swaps(spark):
    s1 = rec(spark, ("S1-1", "c", "r", "red fox", "1 main st", "1"), ("S1-2", "c", "r", "blue owl", "1 main st", "1"), ("S1-3", "c", "r", "red fox", "2 main st", "2"), ("S1-4", "c", "r", "red fox", "", ""), *[(f"S1-{i}", "c", "r", "culture club", f"{i} elm", str(i)) for i in range(10, 15)])
    pairs_ = spark.createDataFrame([("S1-1", "a", "red"), ("S1-1", "b", "group"), ("S1-1", "e", "zzz"), ("S1-3", "a", "red")], "s1 string, mid string, c2 string")
    assert {(r.s1, r.mid): (r.at_address, r.compatible) for r in audit.hub_ambiguity(pairs_, s1).collect()} == {("S1-1", "a"): (2, 1), ("S1-1", "b"): (2, 2), ("S1-1", "e"): (2, 2)}
    recs = spark.createDataFrame([("S1-1", "m", "2 main st", "2", 0), ("S1-2", "m", "2 main st", "2", 0), ("S1-3", "n", "", "", 1)], "s1 string, mid string, a2 string, h2 string, null2 int")
    (r,) = audit.name_class(recs, s1).collect()
    assert (r.s1, r.members, r.best_other) == ("S1-1", 3, 105) and r.own < 100 and r.gap == 105 - r.own
    assert audit.name_class(recs, s1, most=2).count() == 0
    pool = rec(spark, ("S2-1", "c", "r", "red cultuere", "1 main st", "1"), ("S2-2", "c", "r", "red foxx", "1 main st", "1"), ("S2-3", "c", "r", "red culture", "1 main st", "1"), ("S2-4", "c", "r", "red cultuere", "9 oak", "9"))
    text = decide.attach_texts(spark.createDataFrame([("S1-1", f"S2-{i}") for i in range(1, 5)], "s1 string, mid string"), s1, pool)
    assert [(r.s1, r.mid) for r in audit.typo_swaps(text, s1, 5).collect()] == [("S1-1", "S2-1")]
    rel = spark.createDataFrame([("red fox", x) for x in ("", "fox red", "red", "red group", "blue owl", "red foxx", "red wolf")], "c1 string, c2 string")
    assert [r[0] for r in rel.select(audit.name_relation()).collect()] == ["empty", "same", "drop", "drop_noise", "no_shared", "typo", "added"]


def test_nearest_words_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abc"), int(rng.integers(4, 9))))
    words_, voc = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    got = {r.w: (r.near, r.similarity) for r in audit.nearest_words(spark.createDataFrame([("c", w) for w in words_], "country string, w string"), spark.createDataFrame([("c", w) for w in voc], "country string, t string")).collect()}
    want = {}
    for w in words_:
        best = min(((-kernels.ratio(w, v), v) for v in voc))
        if best[0] <= -80:
            want[w] = (best[1], -best[0])
    assert got == want and len(want) > 20


def test_batch_kernels_equal_plain_ones():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(0, 8))))
    text = lambda: " ".join(word() for _ in range(int(rng.integers(0, 14))))
    a = [text() for _ in range(600)] + ["", "a", "", "x" * 64, "x" * 65, "ab" * 32]
    b = [x[: int(rng.integers(0, 30))] + text() for x in a[:600]] + ["", "", "b", "x" * 64, "x" * 64, "ba" * 32]
    for plain, batch in ((kernels.ratio, kernels.ratios), (kernels.token_sort_ratio, kernels.token_sort_ratios), (kernels.token_set_ratio, kernels.token_set_ratios), (kernels.partial_ratio, kernels.partial_ratios), (kernels.jaro_winkler, kernels.jaro_winklers)):
        assert batch(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_kernels_compare_a_pair_once(monkeypatch):
    asked, memo = [], {}
    count = lambda a, b: (asked.extend(zip(a, b, strict=True)), kernels.ratios(a, b))[1]
    a, b = ["ab", "ab", "x", ""] * 50, ["abc", "abc", "y", ""] * 50
    for _ in range(3):
        got = kernels.remembered(memo, a, b, [count, kernels.partial_ratios])
        assert got.tolist() == [[kernels.ratio(x, y), kernels.partial_ratio(x, y)] for x, y in zip(a, b, strict=True)]
    assert len(asked) == 3
    monkeypatch.setattr(kernels, "MEMO", 2)
    assert kernels.remembered(memo, ["q"], ["q"], [count, count]).tolist() == [[100.0, 100.0]] and len(memo) == 1


def test_competition_ties_and_margins(spark):
    df = scored(spark, ("A", "x", 0.8), ("B", "x", 0.8), ("B", "y", 0.3), ("C", "z", 1.0)).withColumnRenamed("p", "p_ce")
    got = {(r.s1, r.mid): r for r in collective.encoder_competition(df).collect()}
    assert got["A", "x"].ce_margin == got["B", "x"].ce_margin == 0 and got["C", "z"].ce_margin == 1 and got["B", "y"].ce_best_other == 0.8
    assert abs(got["C", "z"].ce_logit - math.log((1 - 1e-6) / 1e-6)) < 1e-6
    rec_c = {(r.s1, r.mid): r.q_margin for r in collective.record_competition(df, "p_ce", "q").collect()}
    assert rec_c["A", "x"] == 0 and rec_c["C", "z"] == 1


def test_group_features(spark):
    got = {(r.s1, r.mid): r for r in collective.group_features(scored(spark, ("A", "S2-x", 0.9), ("A", "S3-y", 0.8), ("B", "S2-x", 0.5), ("B", "S2-w", 0.01))).collect()}
    assert len(got) == 3
    ax, bx = got["A", "S2-x"], got["B", "S2-x"]
    assert (ax.g_conf, ax.g_conf_s3, ax.g_rank_mid, ax.g_rival) == (1, 1, 1, 0.5) and (bx.g_rank_mid, bx.g_rival, bx.g_n_cand) == (2, 0.9, 1)


def test_float_boundaries_keep_their_width(spark):
    df = scored(spark, ("A", "x", 0.02), ("A", "y", 0.99), ("A", "z", 0.5)).withColumn("p", F.col("p").cast("float"))
    assert sorted(r.mid for r in collective.band(df).collect()) == ["x", "z"]
    truth = spark.createDataFrame([("A", "x")], "s1 string, mid string")
    assert {r.bin: r.pairs for r in evaluate.score_bins(df, df.limit(0), truth).collect()} == {"band": 2, "high": 1}


def test_siblings_twins_and_rounds(spark):
    recs = rec(spark, ("S2-1", "c", "r", "red fox", "1 main", "1"), ("S2-2", "c", "r", "red fox", "1 main", "1"), ("S2-3", "c", "r", "owl", "9 elm", "9"))
    sc = scored(spark, ("A", "S2-1", 0.9), ("A", "S2-2", 0.5), ("B", "S2-2", 0.4), ("B", "S2-3", 0.3))
    sib = {(r.s1, r.mid): r for r in collective.sibling_support(sc.where("p < 0.75"), sc, recs).collect()}
    assert (sib["A", "S2-2"].sib_n, sib["A", "S2-2"].sib_name_max, sib["A", "S2-2"].sib_house_n) == (1, 100, 1) and (sib["B", "S2-3"].sib_n, sib["B", "S2-3"].sib_name_max, sib["B", "S2-3"].sib_house_n) == (0, -1, -1)
    tw = {(r.s1, r.mid): r for r in collective.twins(sc.withColumnRenamed("p", "q"), recs, 0.75).collect()}
    assert (tw["A", "S2-2"].tw_n, tw["A", "S2-2"].tw_own, tw["B", "S2-2"].tw_oth) == (1, 1, 1)
    prior = spark.createDataFrame([("S2", k, -float(k)) for k in range(15)], "src string, k int, llr double")
    r2 = {(r.s1, r.mid): r for r in collective.round_two(sc.withColumnRenamed("p", "q"), 0.45, prior).collect()}
    assert (r2["A", "S2-1"].r2_n_own_same, r2["B", "S2-2"].rival, r2["B", "S2-2"].r2_n_riv_same, r2["A", "S2-1"].rival) == (1, "A", 1, None)
    assert r2["A", "S2-1"].r2_llr_own == -1 and r2["A", "S2-1"].r2_llr_d is None


def test_twins_meet_in_one_exchange(spark):
    recs = rec(spark, *[(f"S2-{i}", "c", "r", f"n{i % 5}", "1 main", "1") for i in range(20)])
    pairs = [(f"S1-{e}", f"S2-{i}", ((e * 7 + i * 3) % 11) / 10) for e in range(6) for i in range(22)]
    out = collective.twins(spark.createDataFrame(pairs, "s1 string, mid string, q double"), recs, 0.75)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    lead = {m: min((-q, s) for s, x, q in pairs if x == m) for _, m, _ in pairs}
    a = {(s, m): int(lead[m] == (-q, s) and q >= 0.75) for s, m, q in pairs}
    twins = lambda m: [f"S2-{j}" for j in range(20) if j % 5 == int(m[3:]) % 5] if int(m[3:]) < 20 else []
    got = {(r.s1, r.mid): (r.tw_n, r.tw_own, r.tw_oth, round(r.tw_qsum, 6)) for r in out.collect()}
    for s, m, q in pairs:
        own = sum(a[s, x] for x in twins(m)) - a[s, m]
        others = sum(a[e, x] for x in twins(m) for e in {e for e, _, _ in pairs}) - max(a[e, m] for e in {e for e, _, _ in pairs}) - own
        assert got[s, m] == (max(len(twins(m)), 1) - 1, own, others, round(sum(p for e, x, p in pairs if e == s and x in twins(m)) - q, 6) if twins(m) else 0)


# Decisions.


def test_assign_cards(spark):
    sc = scored(spark, ("B", "x", 0.8), ("A", "x", 0.8), ("A", "y", 0.7), ("C", "y", 0.5)).withColumn("country", F.when(F.col("s1") == "A", "US").otherwise("IN"))
    assert sorted((r.s1, r.mid) for r in decide.assign(sc, 0.75).collect()) == [("A", "x")]
    assert sorted((r.s1, r.mid) for r in decide.assign(sc, 0.6, {"US": 0.75}).collect()) == [("A", "x")]
    bucketed = decide.assign_bucketed(sc, 0.9, {"US": 0.9}, {("US", "2-3"): 0.7})
    assert sorted((r.s1, r.mid, r.bucket) for r in bucketed.collect()) == [("A", "x", "2-3"), ("A", "y", "2-3")]


def _expected(p, k):
    total = 0.0
    for bits in itertools.product((0, 1), repeat=len(p)):
        chance = math.prod(x if b else 1 - x for x, b in zip(p, bits, strict=True))
        tp, t = sum(bits[:k]), sum(bits)
        total += chance * ((t == 0) if k == 0 else 1.25 * tp / (0.25 * t + k))
    return total


def test_expected_f_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(40):
        p = np.sort(rng.random(int(rng.integers(1, 8))))[::-1]
        values = [_expected(p, k) for k in range(len(p) + 1)]
        assert abs(values[decide.expected_f(p)] - max(values)) < 1e-9


def test_expected_f_select(spark):
    got = decide.expected_f_select(scored(spark, ("A", "x", 0.95), ("A", "y", 0.1), ("B", "x", 0.2), ("C", "z", 0.3))).collect()
    assert [(r.s1, r.mid) for r in got] == [("A", "x")]


def test_rules(spark):
    s1 = rec(spark, ("S1-1", "c", "r", "red fox", "1 main st", "1"), ("S1-2", "c", "r", "manuel benkadi amicale", "2 oak rd", "2"))
    pool = rec(spark, ("S2-1", "c", "r", "red wolf", "1 main st", "1"), ("S2-2", "c", "r", "red foxx", "1 main st", "1"), ("S2-3", "c", "r", "red group", "1 main st", "1"), ("S2-4", "c", "r", "mba", "2 oak rd", "2"), ("S2-5", "c", "r", "red wolf", "", ""))
    voc = spark.createDataFrame([("c", "wolf"), ("c", "foxx")], "country string, t string")
    pairs_ = spark.createDataFrame([("S1-1", f"S2-{i}") for i in (1, 2, 3, 5)] + [("S1-2", "S2-4")], "s1 string, mid string")
    text = decide.attach_texts(pairs_, s1, pool)
    assert [(r.s1, r.mid) for r in decide.swap_pairs(text, voc.limit(0), voc).collect()] == [("S1-1", "S2-1")]
    assert decide.swap_pairs(text, voc, voc).count() == 0
    assert [r.mid for r in decide.drop_noise_pairs(text).collect()] == ["S2-3"]
    assert [r.mid for r in decide.acronym_pairs(text).collect()] == ["S2-4"]
    sc = scored(spark, ("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.9), ("S1-1", "S2-3", 0.2), ("S1-2", "S2-4", 0.1), ("S1-2", "S2-5", 0.6)).withColumn("country", F.lit("c"))
    config = decide.Config(0.75, swap_veto=("c",), swap_veto_final=decide.EVERYWHERE, add_drop_noise=("c",), add_acronym=("c",), empty_rescue=0.5)
    got = sorted((r.s1, r.mid) for r in decide.decide(sc, s1, pool, config, voc.limit(0), voc).collect())
    assert got == [("S1-1", "S2-2"), ("S1-1", "S2-3"), ("S1-2", "S2-4")]
    rescued = decide.empty_rescue(sc, scored(spark, ("S1-1", "S2-1", 1)), 0.05).collect()
    assert [(r.s1, r.mid) for r in rescued] == [("S1-2", "S2-5")]


def test_blends_and_overrides(spark):
    a, b = scored(spark, ("A", "x", 0.4), ("A", "y", 0.2)), scored(spark, ("A", "x", 0.8), ("B", "z", 0.6))
    assert {(r.s1, r.mid): round(r.p, 6) for r in decide.blend(a, b).collect()} == {("A", "x"): 0.6, ("A", "y"): 0.2, ("B", "z"): 0.6}
    assert abs(decide.logit_blend(a, b).first().p - 1 / (1 + math.exp(-(math.log(0.4 / 0.6) + math.log(4)) / 2))) < 1e-9
    assert abs(spark.range(1).select(decide.align_threshold(F.lit(0.8), 0.8, 0.7)).first()[0] - 0.7) < 1e-9
    moved = {(r.s1, r.mid): r.p for r in decide.two_score_rules(a, b.withColumnRenamed("p", "q"), decide.JudgeRules((0.3, 0.7), (0.3, 0.9))).collect()}
    assert moved == {("A", "x"): 0.99, ("A", "y"): 0.2}
    here = a.withColumn("country", F.lit("US"))
    vetoed = decide.two_score_rules(here, b.withColumnRenamed("p", "q"), decide.JudgeRules((0.3, 0.7), (0.5, 0.8), ("US",)))
    assert {(r.s1, r.mid): r.p for r in vetoed.collect()} == {("A", "x"): 0.0, ("A", "y"): 0.2}
    assert decide.two_score_rules(here, b.withColumnRenamed("p", "q"), decide.JudgeRules((0.3, 0.7), (0.5, 0.8), ("IN",))).where("p = 0.4").count() == 1


# Evaluation.


@pytest.fixture
def audit_frames(spark):
    queries = spark.createDataFrame([("A", "US", "east"), ("B", "US", "east"), ("C", "IN", "west"), ("D", "IN", "west")], "s1 string, country string, region string")
    truth = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z"), ("outside", "orphan")], "s1 string, mid string")
    stage = scored(spark, ("A", "x", 0.995), ("B", "x", 0.5), ("A", "y", 0.01), ("B", "z", 0.99), ("C", "bad", 0.999), ("A", "orphan", 0.02))
    final = scored(spark, ("A", "x", 0.8), ("B", "x", 0.9), ("B", "z", 0.7), ("C", "bad", 0.999), ("A", "orphan", 0.725))
    return queries, truth, stage, final


def test_audit_suite(spark, audit_frames):
    queries, truth, stage, final = audit_frames
    accepted = decide.assign(final, 0.725)
    assert sorted((r.s1, r.mid) for r in accepted.collect()) == [("A", "orphan"), ("B", "x"), ("C", "bad")]
    report = evaluate.audit(stage, final, truth, queries, 0.725)
    assert (report["tp"], report["fp"], report["fn"], report["no_owner"]) == (0, 3, 3, 1)
    assert {b["bin"]: b["pairs"] for b in report["bins"]} == {"low": 1, "band": 2, "high": 3}
    repaired = evaluate.repair_oracle(accepted, truth, queries, stage.where("mid in ('x', 'bad')")).first().macro_f05
    same = evaluate.macro_f05(scored(spark, ("A", "x", 1), ("A", "orphan", 1)), truth, queries).first().macro_f05
    assert repaired == same
    assert evaluate.macro_f05(stage.limit(0), truth, queries).first().macro_f05 == 0.5
    assert {r.category: r.n for r in evaluate.error_categories(accepted, truth, queries).collect()} == {"all wrong": 2, "empty wrong": 1, "empty right": 1}
    assert {r.kind: r.n for r in evaluate.fp_kinds(accepted, truth).collect()} == {"other owner": 2, "orphan": 1}


@pytest.mark.parametrize("bad", ["entity", "owners", "pair", "nan", "inf", "neg", "over", "null"])
def test_audit_refuses_bad_input(spark, audit_frames, bad):
    queries, truth, stage, final = audit_frames
    if bad == "entity":
        queries = queries.unionByName(queries.limit(1))
    elif bad == "owners":
        truth = truth.unionByName(spark.createDataFrame([("B", "x")], "s1 string, mid string"))
    elif bad == "pair":
        stage = stage.unionByName(stage.limit(1))
    else:
        p = {"nan": float("nan"), "inf": float("inf"), "neg": -0.1, "over": 1.1, "null": None}[bad]
        stage = stage.unionByName(spark.createDataFrame([("D", "q", p)], "s1 string, mid string, p double"))
    with pytest.raises(ValueError):
        evaluate.audit(stage, final, truth, queries, 0.7)


def test_universes(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "c", f"r{i % 25}") for i in range(500)], "entity_id string, country string, region string")
    got = evaluate.universes(s1).collect()
    size = {u: sum(r.universe == u for r in got) for u in ("val", "train", "unused")}
    assert len(got) == 500 and 40 <= size["val"] <= 60 and 50 <= size["train"] <= 75
    assert 0.7 < np.mean([r.is_query for r in got]) < 0.9
    assert len({(r.universe) for r in got}) == 3


def test_auc_and_log_loss(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    r = evaluate.auc_log_loss(df).first()
    assert r.auc == 0.875 and abs(r.log_loss + (math.log(0.9) + math.log(0.2) + math.log(0.8) + math.log(0.9)) / 4) < 1e-9


def test_estimators():
    population = np.array([50, 100, 80, 40, 20, 10, 5, 2, 1], float)
    k = np.arange(9)
    true, other = k * population / (k * population).sum(), np.append(0, population[:-1]) / population[:-1].sum()
    assert abs(audit.size_bias(0.7 * true + 0.3 * other, population) - 0.3) < 1e-6
    prior = np.array([0.1, 0.3, 0.3, 0.2, 0.1] + [0] * 7)
    n, c = np.arange(12)[:, None], np.arange(12)[None, :]
    thin = np.array([[math.comb(a, b) * 0.8**b * 0.2 ** (a - b) if b <= a else 0 for b in range(12)] for a in range(12)])
    extra = np.array([math.exp(-0.25) * 0.25**i / math.factorial(i) for i in range(12)])
    observed = np.convolve(prior @ thin, extra)[:12] * 1e5
    r, e = audit.fit_counts(observed, prior)
    assert abs(r - 0.8) < 0.01 and abs(e - 0.25) < 0.02 and n.shape and c.shape
    assert audit.group_share(observed, observed, prior, 0) == 0


def test_exports(spark):
    sc = scored(spark, ("A", "x", 0.9), ("A", "y", 0.8), ("A", "z", 0.7), ("B", "x", 0.1)).withColumn("y", F.when((F.col("mid") == "x") & (F.col("s1") == "A"), 1).otherwise(0))
    assert sorted((r.s1, r.mid) for r in exports.hard_negatives(sc, 1).collect()) == [("A", "x"), ("A", "y"), ("B", "x")]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "x double").select(exports.bucketise(F.col("x"), [1, 2])).collect()] == ["(-inf, 1]", "(1, 2]", "(2, inf)"]
    merged = exports.merge_scores(scored(spark, ("A", "x", 0.1)), sc.select("s1", "mid", "p"))
    assert {(r.s1, r.mid): r.p for r in merged.collect()}["A", "x"] == 0.1 and merged.count() == 4
    s1 = spark.createDataFrame([(f"S1-{i}", "c", "r", f"name {i % 3} shop", f"{i} Main Street, Town") for i in range(12)], "entity_id string, country string, region string, name string, address string")
    syn = exports.synthetic_pairs(s1)
    assert {r.kind for r in syn.collect()} == {"pos", "addr", "name", "word", "decoy"} and sorted(map(tuple, syn.collect())) == sorted(map(tuple, exports.synthetic_pairs(s1).collect()))


def test_trees_fit_equal_rows_as_one(spark, monkeypatch):
    df = spark.range(6000).select(F.format_string("S1-%d", F.expr("id div 3")).alias("s1"), F.format_string("S2-%d", "id").alias("mid"), (F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 7 < 6, (F.col("id") % 2).cast("double")).alias("b"), ((F.col("id") % 5 > 2) & (F.col("id") % 11 < 9)).cast("int").alias("y"))
    fit, seen = models.Pipeline.fit, []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, rows: (seen.append(rows), fit(self, rows))[1])
    m = models.fit_gbt(df, ["a", "b"], rounds=20, depth=3, rate=0.3)
    assert seen[0].agg(F.sum("w")).first()[0] == 6000 and seen[0].count() <= 5 * 3 * 2 * 2 * models.PARTS
    out = models.score_gbt(m, df, ["a", "b"])
    assert out.count() == 6000
    for r in out.groupBy("a").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).collect():
        assert abs(r.p - r.y) < 0.08
    doubled = models.fit_gbt(df.withColumn("w", F.lit(2.0)), ["a", "b"], rounds=2, depth=2)
    assert seen[-1].agg(F.sum("w")).first()[0] == 12000 and doubled is not None


def test_models(spark):
    rows = [(f"S1-{i}", f"S2-{i}", float(i % 10), float(i % 7), int(i % 10 > 5), i % 2, "US" if i % 3 else "IN") for i in range(300)]
    df = spark.createDataFrame(rows, "s1 string, mid string, a double, b double, y int, fold int, country string")
    m = models.fit_gbt(df, ["a", "b"], rounds=5, depth=3)
    out = models.score_gbt(m, df, ["a", "b"]).collect()
    assert all((r.p > 0.5) == bool(r.y) for r in out)
    assert models.out_of_fold(df, ["a", "b"], 2, rounds=3, depth=2).count() == 300
    with pytest.raises(ValueError):
        models.score_gbt(m, df.drop("a"), ["a", "b"])
    assert models.leave_country_out(df, ["a", "b"], "IN", rounds=3, depth=2).count() == 100
    bag = models.score_bag(models.fit_bag(df, ["a", "b"], [1, 2], rounds=2, depth=2), df, ["a", "b"])
    assert bag.columns[-1] == "p" and bag.count() == 300
    second = df.limit(1).select("s1", "mid", F.lit(0.5).alias("p2"))
    assert models.rescore(df.select("s1", "mid", F.lit(0.1).alias("p")), second).where("p = 0.5").count() == 1
    assert models.purged(df, df.where("s1 = 'S1-3'")).count() == 299
    folds = models.region_folds(spark.createDataFrame([("c", f"r{i}") for i in range(9) for _ in range(i + 1)], "country string, region string"), 3).collect()
    assert {r.fold for r in folds} == {0, 1, 2}


def test_plug_in_scorer(spark):
    texts = spark.createDataFrame([("A", "x", "Red Fox | 1 Main", "red fox | 1 main"), ("A", "y", "Red Fox", None), ("B", "z", "", "")], "s1 string, mid string, text_a string, text_b string")
    got = {r.mid: r for r in models.score_texts(texts, models.HashedOverlapScorer()).collect()}
    assert got["x"].p_ce > 0.9 and got["y"].p_ce < 0.1 and all(abs(r.p_ce - 1 / (1 + math.exp(-r.ce_logit))) < 1e-12 for r in got.values())
    known = models.score_texts(texts.limit(1), models.HashedOverlapScorer())
    assert models.score_new(texts, known, models.HashedOverlapScorer()).count() == 3
    assert models.pairs_per_second(texts, models.HashedOverlapScorer(), 3) > 0


def test_pairs_of_a_record_neither_move_nor_are_sorted(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    v = fixtures.Views(spark, "/root/testdata/sf0.01")
    best = plan(decide.leaders(v("cs_pairs")))
    assert "Sort [" not in best and "Exchange hashpartitioning" not in best
    marked = plan(decide.marked(v("cs_pairs"), v("cs_truth"), "y"))
    assert marked.count("Sort [") <= 1 and "Exchange hashpartitioning" not in marked  # the lists of owners, one a record
    for name in ("cs_pairs", "cs_truth"):
        ours, sql = v(name), v.sql(f"\nSELECT * FROM {name}")
        assert ours.dtypes == sql.dtypes and ours.count() == sql.count() and ours.exceptAll(sql).isEmpty()


def test_leaders_are_the_winners(spark):
    nan = float("nan")
    rows = [("B", "x", 0.5), ("A", "x", 0.5), ("C", "x", 0.4), ("A", "y", None), ("B", "y", -0.0), (None, "z", 0.0), ("A", "z", -0.0), ("A", "w", 1.0), ("B", "w", nan), ("D", None, 0.1), ("C", None, 0.2), ("B", "u", None), ("A", "u", None)]
    df = spark.createDataFrame(rows, "s1 string, mid string, p double")
    want = sorted(map(str, decide.winners(df).collect()))
    assert decide.leaders(df).columns == df.columns and sorted(map(str, decide.leaders(df).collect())) == want and len(want) == 6
    truth = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "x"), ("A", "q"), (None, "z"), ("D", None)], "s1 string, mid string")
    got = {(r.s1, r.mid) for r in decide.marked(df, truth, "y").where("y").collect()}
    assert got == {("A", "x"), ("B", "x")} and decide.marked(df, truth, "y").count() == len(rows)


def test_audits_join_pairs_by_record_alone(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    v = fixtures.Views(spark, "/root/testdata/sf0.01")
    best, truth = decide.leaders(v("cs_pairs")), v("cs_truth")
    assert "hashpartitioning(s1" not in plan(evaluate.score_bins(v("cs_pairs"), best, truth))
    sure = v("cs_pairs").where("p >= 0.9")
    plain = evaluate.macro_f05(truth.join(sure.select("s1", "mid").distinct(), ["s1", "mid"], "left_semi"), truth, v("cs_s1")).collect()
    assert evaluate.blocking_oracle(sure, truth, v("cs_s1")).collect() == plain
    name = "spark.sql.execution.useObjectHashAggregateExec"
    was = spark.conf.get(name)
    entities = spark.createDataFrame([("A",), ("B",)], "s1 string")
    owned = spark.createDataFrame([("A", "x")], "s1 string, mid string")
    rows = lambda *r: spark.createDataFrame(list(r), "s1 string, mid string, p double")
    evaluate.validate(rows(("A", "x", 0.5), ("B", "x", 0.5), (None, "x", 0.5)), owned, entities)
    for repeated in (("A", "x", 0.1), (None, "x", 0.1)):
        with pytest.raises(ValueError, match="repeated pairs"):
            evaluate.validate(rows(("A", "x", 0.5), (None, "x", 0.5), repeated), owned, entities)
    assert spark.conf.get(name) == was


@pytest.mark.parametrize("full", [True, False])
def test_twice_scored_is_the_join_of_the_pairs(spark, tmp_path, full):
    """Also with repeated and null ids, as often as the join has them, and without moving a pair."""
    from pathlib import Path

    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        df = spark.read.parquet(str(f))
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}.get(f.stem)
        if key:
            nation = key[:2] + "nationkey"
            some = df.limit(8).withColumn(nation, F.lit(1).cast(dict(df.dtypes)[nation]))
            df = df.unionByName(some).unionByName(df.limit(2)).unionByName(some.limit(1).withColumn(key, F.lit(None).cast(dict(df.dtypes)[key])))
        df.coalesce(1).write.parquet(str(tmp_path / f.name))
    v = fixtures.Views(spark, str(tmp_path))
    got = v.twice_scored(full)
    want = v.sql(f"\nSELECT s1, mid, a.p, p_ce FROM cs_pairs a {'FULL' if full else ''} JOIN cs_scores USING (s1, mid)")
    assert got.count() > 100 and not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_stack_is_fitted_on_distinct_rows(spark, monkeypatch):
    """The same scores as by all rows, from one weighted row of each kind."""
    rnd = np.random.default_rng(3)
    p, q = rnd.integers(1, 9, 2000) / 10, rnd.integers(1, 5, 2000) / 5.5
    y = (rnd.random(2000) < p * q).astype(int)
    df = spark.createDataFrame([(str(i), float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(p, q, y, strict=True))], "mid string, p double, q double, y int")
    seen, plain = [], models.LogisticRegression

    class Counted(plain):
        def _fit(self, rows):
            seen.append((rows.count(), rows.selectExpr(f"sum({self.getWeightCol()})").first()[0] if self.isDefined("weightCol") else None))
            return super()._fit(rows)

    monkeypatch.setattr(models, "LogisticRegression", Counted)
    got = {r.mid: r.stacked for r in models.stack(df).collect()}
    kinds = len(set(zip(p, q, y, strict=True)))
    assert seen == [(kinds, 2000)] and kinds <= 64
    x = models.VectorAssembler(inputCols=["a", "b", "ab"], outputCol="x").transform(df.withColumns({"a": collective.logit(F.col("p")), "b": collective.logit(F.col("q"))}).withColumn("ab", F.col("a") * F.col("b")))
    model = plain(featuresCol="x", labelCol="y", regParam=1e-4).fit(x)
    want = {r.mid: r.probability[1] for r in model.transform(x).select("mid", "probability").collect()}
    assert len(got) == 2000 and max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_correction_groups_sort_no_claims(spark):
    rows = [("a", "m", 0.99), ("b", "m", 0.99), ("c", "m", 0.5), ("a", "n", 1.0), ("b", "n", 0.3), ("c", "n", 0.2), ("a", "o", 0.995), ("a", "q", 0.9), ("b", "q", 0.8), ("a", "r", 0.99), ("b", "r", None)]
    df = spark.createDataFrame(rows, "s1 string, mid string, p double")
    got = collective.correction_groups(df)
    want = collective.record_competition(df.where("mid <> 'q'"), "p", "p1")
    assert got.columns == want.columns and got.count() == 9
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def _small_candidates(spark):
    record = lambda i, name, house, country: (i, name, name, f"{house} main street", str(house), country)
    schema = "entity_id string, n_core string, n_compact string, a_tokens string, a_house string, country string"
    s1 = spark.createDataFrame([record("S1-1", "blue ring", 4, "A"), record("S1-2", "red bolt", 5, "B"), record("S1-2", "red bolt", 6, "B")], schema)
    pool = spark.createDataFrame([record("S2-1", "blue rings", 4, "A"), record("S2-2", "red bolt", 5, "B"), record("S3-1", "cold plate", 7, "B")], schema)
    met = [(a, b, 0.5, 0.25, 1) for a in ("S1-1", "S1-2") for b in ("S2-1", "S2-2", "S3-1")]
    return s1, pool, spark.createDataFrame(met, "s1 string, mid string, name_cos double, addr_cos double, hit int")


def test_model_rows_are_labelled_and_kept_without_a_join_by_pair(spark):
    s1, pool, cand = _small_candidates(spark)
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-9", "S2-1"), ("S1-2", "S2-2"), (None, "S3-1"), ("S1-1", None)], "s1 string, mid string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = decide_queries._model_rows(s1, pool, cand, truth, F.col("country_s").alias("country"), "name_cos", "addr_cos")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.s1, r.mid, r.y, r.country, r.name_cos, r.addr_cos) for r in rows.collect())
        plain = pairs.simple_features(pairs.attach(cand, s1, pool)).join(truth.distinct().withColumn("y", F.lit(1)), ["s1", "mid"], "left").na.fill(0, ["y"])
        assert sorted(map(tuple, rows.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Join") == 3 and not re.search(r"hashpartitioning\(s1#\d+, mid#", plan)
    want = [("S1-1", m, int(m == "S2-1"), "A") for m in ("S2-1", "S2-2", "S3-1")] + [("S1-2", m, int(m == "S2-2"), "B") for m in ("S2-1", "S2-2", "S3-1") for _ in range(2)]
    assert got == sorted((*w, 0.5, 0.25) for w in want)


def test_word_sets_are_made_once_a_record(spark):
    rows = [("b a b", "1 2"), ("", "x"), (None, None), ("a  c", "2 1 2")]
    s1, pool = (spark.createDataFrame([(f"{k}{i}", *r, n) for i, r in enumerate(rows) for n in ("3",)], "entity_id string, n_core string, a_tokens string, a_nums string") for k in "sm")
    met = spark.createDataFrame([(f"s{i}", f"m{j}") for i in range(4) for j in range(4)], "s1 string, mid string")
    made = pairs.attach(met, pairs.word_sets(s1), pairs.word_sets(pool), ("n_core_set", "a_tokens_set", "a_nums_set"))
    plain = pairs.attach(met, s1, pool, pairs.WORDED)
    assert not {"n_core_s", "a_tokens_s"} & set(made.columns)
    for c in pairs.WORDED:
        a, b = (sorted(map(tuple, pairs.token_overlap(df, c, "x").select("s1", "mid", "x_jacc", "x_c_in_s", "x_s_in_c", "x_n1", "x_n2").collect())) for df in (made, plain))
        assert a == b and len(a) == 16
    s1, pool, cand = _small_candidates(spark)
    model = decide_queries._model_rows(s1, pool, cand, cand.select("s1", "mid"))
    above = model._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "array_intersect" in above and "array_distinct" not in above


def test_twins_take_pairs_as_they_are_attached(spark, monkeypatch):
    s1, pool, cand = _small_candidates(spark)
    pool = pool.unionByName(pool.where("entity_id = 'S2-2'").withColumn("entity_id", F.lit("S2-3"))).withColumn("a_null", F.lit(0))
    cand = cand.unionByName(cand.where("mid = 'S2-2'").withColumn("mid", F.lit("S2-3")))
    monkeypatch.setattr(decide_queries, "feature_pairs", lambda v: (s1.dropDuplicates(["entity_id"]), pool, pairs.attach(cand.select("s1", "mid"), s1.dropDuplicates(["entity_id"]), pool)))
    monkeypatch.setattr(decide_queries, "materialize", lambda df, name: pytest.fail(f"{name} is stored"))
    got = {(r.s1, r.mid): r.tw_n for r in decide_queries.r2_twins(None).collect()}
    assert got == {(a, b): int(b in ("S2-2", "S2-3")) for a in ("S1-1", "S1-2") for b in ("S2-1", "S2-2", "S2-3", "S3-1")}
