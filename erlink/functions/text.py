"""Canonicalisation of names and addresses as column expressions (no UDF)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .rounding import rounded

#: Letters that fold to two.
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters they decompose to."""
    found = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ð": "d"}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp).lower()
        base = unicodedata.normalize("NFKD", c)[0]
        if len(c) == 1 and base.isascii() and base.isalpha():
            found.setdefault(c, base)
    return "".join(found), "".join(found.values())


def lookup(table: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """table[key], else ``default`` (null if not given). For tables of bounded size."""
    if not table:
        return default if default is not None else F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, default)


def fold(s: Column) -> Column:
    """Lower case without accents and ligatures."""
    s = F.translate(F.lower(s), *_folds())
    for a, b in PAIRS.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def basic(s: Column) -> Column:
    """Folded, ``&`` as a word, all but a-z and 0-9 as single spaces; null gives an empty string."""
    s = F.replace(fold(F.coalesce(s, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    """Words between spaces, empty ones dropped; null gives none."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), " "), lambda t: t != "")


def place_key(s: Column) -> Column:
    """Key of a place name: street words in short form, filling words dropped."""
    kept = F.filter(tokens(basic(s)), lambda t: ~t.isin(T.PLACE_STOP_WORDS))
    return F.array_join(F.transform(kept, lambda t: lookup(T.STREET, t, t)), " ")


def collapse_initials(s: Column) -> Column:
    """Neighbouring one-letter words become one word."""
    return F.regexp_replace(s, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def fix_leet(t: Column) -> Column:
    """Digits as letters in words of at least two letters and one or two digits."""
    letters, digits = F.regexp_count(t, F.lit("[a-z]")), F.regexp_count(t, F.lit("[0-9]"))
    return F.when((letters >= 2) & digits.between(1, 2), F.translate(t, T.LEET_DIGITS, T.LEET_LETTERS)).otherwise(t)


def pipe_segment(s: Column) -> Column:
    """The first segment between pipes that is no URL, else the first; strings without a pipe as they are."""
    parts = F.filter(F.transform(F.split(s, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    keep = F.filter(parts, lambda p: ~p.rlike(T.URL_NAME) & ~F.lower(p).contains("www."))
    return F.when(s.contains("|"), F.coalesce(F.get(keep, F.lit(0)), F.get(parts, F.lit(0)), F.lit(""))).otherwise(s)


def is_alias(s: Column) -> Column:
    return s.rlike(T.ALIAS)


def resolve_alias(s: Column) -> Column:
    """``X formerly Y``, ``X dba Y`` and the like give Y."""
    return F.when(is_alias(s), F.regexp_extract(s, T.ALIAS, 2)).otherwise(s)


def is_web(s: Column) -> Column:
    return s.rlike(T.URL_NAME) | s.rlike(T.HANDLE)


def url_stem(s: Column) -> Column:
    """Name part of a URL or handle, dots as spaces; other strings as they are."""
    stem = F.when(s.rlike(T.URL_NAME), F.regexp_extract(s, T.URL_NAME, 1)).otherwise(F.regexp_extract(s, T.HANDLE, 1))
    return F.when(is_web(s), F.translate(stem, ".-", " ")).otherwise(s)


def translate_native(s: Column, words: Mapping[str, str]) -> Column:
    """Words by dictionary, tried again without a last dot."""
    return F.array_join(F.transform(tokens(s), lambda t: F.coalesce(lookup(words, t), lookup(words, F.regexp_replace(t, r"\.+$", "")), t)), " ")


def strip_zeros(t: Column) -> Column:
    """Leading zeros gone, one zero kept."""
    return F.regexp_replace(t, "^0+(?!$)", "")


def digit_runs(s: Column) -> Column:
    """All numbers in order, without leading zeros."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), strip_zeros)


def _steps(df: DataFrame, steps: list[tuple[str, Callable[[], Column]]]) -> DataFrame:
    for name, make in steps:
        df = df.withColumn(name, make())
    return df


def canon_names(df: DataFrame, name: str = "name", native_words: Mapping[str, str] | None = None, variants: Mapping[str, str] | None = None) -> DataFrame:
    """Adds n_canon, n_core, n_compact, n_legal, n_native, n_alias, n_web, n_upper. A name of legal and filling words only keeps all."""
    c = F.col
    legal = list(T.LEGAL_FORMS)
    df = _steps(
        df,
        [
            ("_s", lambda: pipe_segment(F.trim(F.coalesce(c(name), F.lit(""))))),
            ("n_alias", lambda: is_alias(c("_s")).cast("int")),
            ("_s", lambda: resolve_alias(c("_s"))),
            ("n_native", lambda: c("_s").rlike(T.INDIC).cast("int")),
            ("_s", lambda: F.when(c("n_native") == 1, translate_native(c("_s"), native_words or {})).otherwise(c("_s"))),
            ("n_web", lambda: is_web(c("_s")).cast("int")),
            ("_t", lambda: tokens(collapse_initials(F.array_join(F.transform(tokens(basic(url_stem(c("_s")))), fix_leet), " ")))),
            ("_t", lambda: F.transform("_t", lambda t: lookup(variants or {}, t, t))),
            ("_t", lambda: F.transform("_t", lambda t: lookup(T.LEGAL, t, t))),
            ("n_canon", lambda: F.array_join("_t", " ")),
            ("n_legal", lambda: F.array_join(F.array_sort(F.array_distinct(F.filter("_t", lambda t: t.isin(legal)))), " ")),
            ("_c", lambda: F.filter("_t", lambda t: ~t.isin(legal + T.HONORIFICS))),
            ("_c", lambda: F.when(F.size("_c") > 0, c("_c")).otherwise(c("_t"))),
            ("n_core", lambda: F.array_join("_c", " ")),
            ("n_compact", lambda: F.array_join("_c", "")),
            ("n_upper", lambda: ((F.upper(c(name)) == c(name)) & (F.lower(c(name)) != c(name))).cast("int")),
        ],
    )
    return df.withColumn("n_upper", F.coalesce("n_upper", F.lit(0))).drop("_s", "_t", "_c")


def canon_addresses(
    df: DataFrame, address: str = "address", country: str = "country", regions: Mapping[str, Mapping[str, str]] | None = None,
    cities: Mapping[str, Mapping[str, str]] | None = None, native_parts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds a_tokens, a_nums, a_house, region, region_src (2 named, 1 inferred, 0 none), a_null.

    ``regions``: country -> alias -> region (a region named in a whole comma part); ``"*"`` holds for every country.
    ``cities``: country -> place key -> region, asked in order of the parts if no region is named.
    """
    flat = lambda by: {f"{k}\t{a}": r for k, m in (by or {}).items() for a, r in m.items()}
    named, learned = flat(T.REGIONS if regions is None else regions), flat(cities)
    c = F.col

    def find(table: Mapping[str, str], key: Column) -> Column:
        if not table:
            return F.lit(None).cast("string")
        return F.coalesce(lookup(table, F.concat(F.coalesce(c(country), F.lit("")), F.lit("\t"), key)), lookup(table, F.concat(F.lit("*\t"), key)))

    norm = lambda p: F.coalesce(lookup(native_parts or {}, F.trim(p)), basic(p))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c(address), F.lit("")), T.NULL_TOKEN, " "), T.PO_BOX, " ")
    df = _steps(
        df,
        [
            ("_p", lambda: F.filter(F.transform(F.split(clean, ","), lambda p: F.struct(p.alias("raw"), norm(p).alias("norm"))), lambda p: p["norm"] != "")),
            ("_p", lambda: F.transform("_p", lambda p: F.struct(p["raw"].alias("raw"), p["norm"].alias("norm"), find(named, p["norm"]).alias("named")))),
            ("_k", lambda: F.filter("_p", lambda p: p["named"].isNull())),
            ("_r", lambda: F.get(F.transform(F.filter("_p", lambda p: p["named"].isNotNull()), lambda p: p["named"]), F.lit(0))),
            ("_i", lambda: F.get(F.filter(F.transform("_k", lambda p: find(learned, place_key(p["norm"]))), lambda r: r.isNotNull()), F.lit(0)) if learned else F.lit(None).cast("string")),
            ("region_src", lambda: F.when(c("_r").isNotNull(), 2).when(c("_i").isNotNull(), 1).otherwise(0)),
            ("region", lambda: F.coalesce("_r", "_i", F.lit(""))),
            ("_n", lambda: F.flatten(F.transform("_k", lambda p: digit_runs(p["raw"])))),
            ("a_nums", lambda: F.array_join("_n", " ")),
            ("a_house", lambda: F.coalesce(F.get("_n", F.lit(0)), F.lit(""))),
            ("_w", lambda: F.filter(F.transform(F.flatten(F.transform("_k", lambda p: F.split(p["norm"], " "))), lambda t: lookup(T.STREET, t, t)), lambda t: ~t.isin(T.ADDRESS_STOP_WORDS))),
            ("a_tokens", lambda: F.array_join(F.transform("_w", lambda t: F.when(t.rlike("^[0-9]+$"), strip_zeros(t)).otherwise(t)), " ")),
            ("a_null", lambda: (F.size("_w") == 0).cast("int")),
        ],
    )
    return df.drop("_p", "_k", "_r", "_i", "_n", "_w")


#: Names of writing systems and their code blocks.
SCRIPTS = {"devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "gurmukhi": "਀-੿", "gujarati": "઀-૿", "odia": "଀-୿", "tamil": "஀-௿", "telugu": "ఀ-౿", "kannada": "ಀ-೿", "malayalam": "ഀ-ൿ"}
#: Names of patterns of names and addresses and what they look for.
PATTERNS = {
    "digit": "[0-9]", "upper_only": "^[^a-z]*[A-Z][^a-z]*$", "ampersand": "&", "apostrophe": "'", "dot": r"\.", "comma": ",", "hyphen": "-",
    "slash": "/", "paren": r"[()]", "pipe": r"\|", "at": "@", "hash": "#", "web": r"(?i)www\.|https?://|\.com", "accent": "[À-ɏ]",
    "double_space": "  ", "edge_space": r"^\s|\s$", "legal": r"(?i)\b(inc|llc|ltd|corp|pvt|sarl|sas)\b", "null_word": T.NULL_TOKEN, "po_box": T.PO_BOX,
}


def profile(df: DataFrame, text: str, by: str) -> DataFrame:
    """Share of rows of each group in which each pattern and writing system occurs, with the number of rows."""
    wanted = PATTERNS | {k: f"[{v}]" for k, v in SCRIPTS.items()}
    rates = [rounded(F.avg(F.coalesce(F.col(text).rlike(rx), F.lit(False)).cast("double"))).alias(k) for k, rx in wanted.items()]
    return df.groupBy(by).agg(F.count("*").alias("n"), *rates)


def last_place(address: Column) -> Column:
    """Last comma part that has no digit and is no US state; null if there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), basic), lambda p: (p != "") & ~p.rlike("[0-9]") & lookup(T.REGIONS["US"], p).isNull())
    return F.try_element_at(parts, F.lit(-1))
