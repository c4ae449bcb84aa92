"""Canonicalisation, kernels and learned tables on inline frames."""

import random

import pytest
from pyspark.sql import functions as F

from erlink.functions import kernels as K
from erlink.functions import tables as T
from erlink.functions import text as X
from erlink.operators import learn


def names(spark, *raw, **options):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(raw)], "i int, name string")
    return X.canon_names(df, **options).orderBy("i").collect()


def addresses(spark, *raw, country="US", **options):
    df = spark.createDataFrame([(i, a, country) for i, a in enumerate(raw)], "i int, address string, country string")
    return X.canon_addresses(df, **options).orderBy("i").collect()


def test_names(spark):
    got = names(spark, "The Café & Söhne L.L.C.", "Xylo formerly: Real Name Inc", "www.blue-bird.co.in", "ACME | www.acme.com", "#My_Shop", "Ca1lahan Bros 24", "Private Limited", None, "", "Q d/b/a Red Fox", "Straße Œuvre", "A", "M D Plumbing")
    assert [r.n_core for r in got] == ["cafe sohne", "real name", "bluebird", "acme", "my shop", "callahan bros 24", "pvt ltd", "", "", "red fox", "strasse oeuvre", "a", "md plumbing"]
    assert got[0].n_canon == "the cafe and sohne llc" and got[0].n_legal == "llc" and got[0].n_compact == "cafesohne"
    assert [r.n_alias for r in got] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert [r.n_web for r in got] == [0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [r.n_upper for r in got] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0] and got[6].n_legal == "ltd pvt"


def test_native_names_and_variants(spark):
    got = names(spark, "लक्ष्मी. स्टोर", "Sri Laxmi Store", native_words={"लक्ष्मी": "laxmi", "स्टोर": "store"}, variants={"laxmi": "lakshmi", "sri": "shri"})
    assert [(r.n_core, r.n_native) for r in got] == [("lakshmi store", 1), ("shri lakshmi store", 0)]


@pytest.mark.parametrize(("word", "fixed"), [("ca1lahan", "callahan"), ("24", "24"), ("abc", "abc"), ("a1", "a1"), ("ab123", "ab123"), ("m0b1le", "moblle"), ("b4nk", "bank"), ("", "")])
def test_leet(spark, word, fixed):
    assert spark.range(1).select(X.fix_leet(F.lit(word))).first()[0] == fixed


def test_initials(spark):
    cases = {"a b c llc": "abc llc", "1 a b": "1 ab", "a": "a", "ab c de": "ab c de", "x y 2 z": "xy 2 z", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.j for r in df.select("s", X.collapse_initials(F.col("s")).alias("j")).collect()} == cases


def test_addresses(spark):
    got = addresses(spark, "0012 North Main Street, Suite 5, Springfield, Texas", "P.O. Box 12, <NULL>", None, " ", "5 South Oak Ave, TX, ohio", "Saint Paul, 007 Rd, 0")
    assert [r.a_tokens for r in got] == ["12 main st 5 springfield", "", "", "", "5 s oak ave", "st paul 7 rd 0"]
    assert [(r.region, r.region_src) for r in got] == [("tx", 2), ("", 0), ("", 0), ("", 0), ("tx", 2), ("", 0)]
    assert [(r.a_nums, r.a_house, r.a_null) for r in got] == [("12 5", "12", 0), ("", "", 1), ("", "", 1), ("", "", 1), ("5", "5", 0), ("7 0", "7", 0)]


def test_address_regions(spark):
    assert [r.region for r in addresses(spark, "3 Rue X, Gironde", "Hauts-de-France", country="France")] == ["nouvelle aquitaine", "hauts de france"]
    assert [r.region for r in addresses(spark, "MG Road, Orissa", "New Delhi", country="India")] == ["odisha", "delhi"]
    inferred = addresses(spark, "1 Main St, City of Springfield", "1 Main St, Ohio, Springfield", cities={"US": {"springfield": "il"}})
    assert [(r.region, r.region_src) for r in inferred] == [("il", 1), ("oh", 2)]
    native = addresses(spark, "12 X, महाराष्ट्र", country="India", native_parts={"महाराष्ट्र": "maharashtra"})
    assert native[0].region == "maharashtra"


def test_tables_are_consistent():
    assert len(T.LEGAL) == 33 and len(T.HONORIFICS) == 16 and set(T.LEGAL) >= set(T.LEGAL_FORMS)
    assert T.STREET["north"] == "n" and "n" in T.ADDRESS_STOP_WORDS and T.STREET["ngr"] == "nagar"
    assert len(set(T.US_STATES.values())) == 52 and T.REGIONS["India"]["uttaranchal"] == "uttarakhand"


def test_place_and_profile(spark):
    df = spark.createDataFrame([("ST.-NAZAIRE",), ("Saint-Nazaire",), ("City of Fort Worth",)], "p string")
    assert [r[0] for r in df.select(X.place_key(F.col("p"))).collect()] == ["st nazaire", "st nazaire", "ft worth"]
    prof = X.profile(spark.createDataFrame([("A&B 1", "x"), (None, "x")], "t string, g string"), "t", "g").first()
    assert prof.n == 2 and prof.ampersand == 0.5 and prof.devanagari == 0
    assert spark.range(1).select(X.last_place(F.lit("12 Main, Springfield, TX 75001, Texas"))).first()[0] == "springfield"


def _lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_kernels():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))) for _ in "xy")
        assert K.common_subsequence(a, b) == _lcs(a, b)
        for k in (K.ratio, K.token_sort_ratio, K.token_set_ratio, K.partial_ratio):
            assert 0 <= k(a, b) <= 100.0001 and abs(k(a, b) - k(b, a)) < 1e-9
        if a and b:
            x, y = sorted((a, b), key=len)
            n = len(x)
            windows = [y[max(0, i) : i + n] for i in range(1 - n, len(y))]
            want = max(K.ratio(x, w) for w in windows)
            if len(a) == len(b):
                want = max(want, *(K.ratio(y, x[max(0, i) : i + n]) for i in range(1 - n, n)))
            assert abs(K.partial_ratio(a, b) - want) < 1e-9
    assert K.ratio("", "") == 100 and K.ratio("ab", "") == 0 and K.ratio("abcd", "abxd") == 75
    assert K.token_set_ratio("", "a") == 0 and K.token_set_ratio("a b c", "c a") == 100 and K.token_sort_ratio("b a", "a b") == 100
    assert K.token_set_ratio("fuzzy was a bear", "fuzzy was a dog") == max(K.ratio("a fuzzy was bear", "a fuzzy was dog"), K.ratio("a fuzzy was", "a fuzzy was bear"), K.ratio("a fuzzy was", "a fuzzy was dog"))
    assert K.partial_ratio("abcd", "xxabcdyy") == 100 and K.partial_ratio("", "a") == 0
    assert abs(K.jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6 and abs(K.jaro_winkler("dixon", "dicksonx") - 0.8133333) < 1e-6
    assert K.jaro_winkler("", "") == 1 and K.jaro_winkler("a", "") == 0 and K.is_subsequence("ace", "abcde") and not K.is_subsequence("aec", "abcde")


def test_kernel_columns(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "a"), ("", ""), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(K.ratio_udf("a", "b")).collect()] == [100.0, None, 100.0, 100.0]
    assert [r[0] for r in df.select(K.lev_sim(F.col("a"), F.col("b"))).collect()] == [1.0, None, 1.0, 1.0]


def test_learned_tables(spark):
    pairs = spark.createDataFrame([("Laxmi Store", "लक्ष्मी स्टोर")] * 30 + [("Lakshmi Store", "लक्ष्मी स्टोर")] * 20 + [("Laxmi Big Store", "लक्ष्मी स्टोर"), ("Plain", "Latin")], "a string, b string")
    aligned = learn.align_tokens(pairs, "a", "b")
    assert {(r.native, r.en, r.n) for r in aligned.collect()} == {("लक्ष्मी", "laxmi", 30), ("लक्ष्मी", "lakshmi", 20), ("स्टोर", "store", 50)}
    assert {r.native: r.en for r in learn.native_words(aligned).collect()} == {"लक्ष्मी": "laxmi", "स्टोर": "store"}
    assert [(r.variant, r.canonical) for r in learn.spelling_variants(aligned).collect()] == [("lakshmi", "laxmi")]
    assert learn.purity_report(aligned).first().purity == 0.8
    regions = {"India": {"maharashtra": "maharashtra", "goa": "goa"}}
    rows = spark.createDataFrame([("x, Maharashtra", "y, महाराष्ट्र", "India")] * 10 + [("x, Goa", "गोवा", "India")] * 3, "a1 string, a2 string, country string")
    assert [(r.part, r.region, r.n) for r in learn.native_regions(rows, regions).collect()] == [("महाराष्ट्र", "maharashtra", 10)]


def test_leaks_and_departments(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "IN", "a") for i in range(40)], "entity_id string, country string, region string")
    pool = spark.createDataFrame([(f"S2-{i}", "IN", "b" if i < 31 else "a") for i in range(40)], "entity_id string, country string, region string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(40)], "s1 string, mid string")
    leak = learn.region_leaks(truth, s1, pool).first()
    assert (leak.region, leak.m_region, leak.n, leak.total, leak.rate) == ("a", "b", 31, 40, 31 / 40)
    recs = spark.createDataFrame([("1 Rue, Lens, Nord",)] * 3 + [("2 Rue, Lens, Aisne",), ("x",)], "address string")
    assert [(r.city, r.dept) for r in learn.departments(recs, 1, 1).collect()] == [("lens", "nord")]
