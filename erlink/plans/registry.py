"""How queries are registered: a function of the views, and the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.rounding import rounded
from .fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def final(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places and whole numbers as long, as both engines then agree on them."""
    casts = {"double": lambda c: rounded(c) + F.lit(0.0), "float": lambda c: rounded(c.cast("double")) + F.lit(0.0), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*[casts.get(t, lambda c: c)(F.col(n)).alias(n) for n, t in df.dtypes])


def query(sql: str | None = None, longs: str = "", doubles: str = "") -> Callable:
    """Register a query. ``sql`` follows the views' WITH list; ``longs`` and ``doubles`` name the columns that it casts or rounds."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: final(f(Views(spark, sf_dir)))
        if sql:
            body = sql.strip()
            casts = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"round(CAST({c} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles.split()]
            if casts:
                head, _, last = body.rpartition("\nSELECT ") if "\nSELECT " in body and body.startswith(",") else ("", "", body.removeprefix("SELECT "))
                sep = "\n" if head else ""
                body = f"{head}{sep}{',' if head else ','} result AS (\nSELECT {last})\nSELECT * REPLACE ({', '.join(casts)}) FROM result"
            ORACLES[f.__name__] = with_views(body if body.startswith(",") else "\n" + body)
        return f

    return register


def duck_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def duck_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def duck_basic(s: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({s}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def duck_tokens(s: str) -> str:
    return f"list_filter(string_split(coalesce({s}, ''), ' '), lambda x: x <> '')"


def duck_canon(source: str, out: str) -> str:
    """CTEs that canonicalise ASCII names and addresses of ``source`` into ``out``; no regions are named."""
    leet = f"CASE WHEN length(regexp_replace(x, '[^a-z]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN translate(x, '{T.LEET_DIGITS}', '{T.LEET_LETTERS}') ELSE x END"
    legal, street = duck_map(T.LEGAL), duck_map(T.STREET)
    strip = "regexp_replace(regexp_replace(x, '^0+', ''), '^$', '0')"
    return f""",
{out}_a AS (SELECT *, CASE WHEN regexp_matches(trim(coalesce(name, '')), '{T.ALIAS}') THEN regexp_extract(trim(coalesce(name, '')), '{T.ALIAS}', 2) ELSE trim(coalesce(name, '')) END AS s0,
  CAST(regexp_matches(trim(coalesce(name, '')), '{T.ALIAS}') AS INTEGER) AS n_alias FROM {source}),
{out}_b AS (SELECT *, CAST(regexp_matches(s0, '{T.URL_NAME}') AS INTEGER) AS n_web, CASE WHEN regexp_matches(s0, '{T.URL_NAME}') THEN replace(replace(regexp_extract(s0, '{T.URL_NAME}', 1), '-', ''), '.', ' ') ELSE s0 END AS s1 FROM {out}_a),
{out}_c AS (SELECT *, list_transform(list_transform({duck_tokens(duck_basic("s1"))}, lambda x: {leet}), lambda x: coalesce({legal}[x], x)) AS t FROM {out}_b),
{out}_d AS (SELECT *, list_filter(t, lambda x: NOT list_contains({duck_list(list(T.LEGAL_FORMS) + T.HONORIFICS)}, x)) AS c0 FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE t END AS c,
  list_filter(string_split(regexp_replace(regexp_replace(coalesce(address, ''), '{T.NULL_TOKEN}', ' ', 'g'), '{T.PO_BOX}', ' ', 'g'), ','), lambda p: {duck_basic("p")} <> '') AS parts FROM {out}_d),
{out}_f AS (SELECT *, list_transform(flatten(list_transform(parts, lambda p: regexp_extract_all(p, '[0-9]+'))), lambda x: {strip}) AS nums,
  list_transform(list_filter(list_transform(flatten(list_transform(parts, lambda p: string_split({duck_basic("p")}, ' '))), lambda x: coalesce({street}[x], x)), lambda x: NOT list_contains({duck_list(T.ADDRESS_STOP_WORDS)}, x)),
    lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN {strip} ELSE x END) AS w FROM {out}_e),
{out} AS (SELECT entity_id, country, region, name, address, array_to_string(t, ' ') AS n_canon, array_to_string(c, ' ') AS n_core, array_to_string(c, '') AS n_compact,
  array_to_string(list_sort(list_distinct(list_filter(t, lambda x: list_contains({duck_list(list(T.LEGAL_FORMS))}, x)))), ' ') AS n_legal, 0 AS n_native, n_alias, n_web,
  CAST(coalesce(upper(name) = name AND lower(name) <> name, false) AS INTEGER) AS n_upper, array_to_string(w, ' ') AS a_tokens, array_to_string(nums, ' ') AS a_nums, coalesce(nums[1], '') AS a_house, CAST(len(w) = 0 AS INTEGER) AS a_null FROM {out}_f)"""


CANON = duck_canon("lk_ref", "s1p") + duck_canon("lk_pool", "poolp")


def duck_sims(block: str, field: str, name: str, s1: str = "s1p", pool: str = "poolp", where_s1: str = "true", where_pool: str = "true", least: float = 0.05) -> str:
    """CTEs ``{name}_q``, ``{name}_p`` (weights) and ``{name}`` (block, s1, mid, cos) of TF-IDF cosines."""
    terms = f"CASE WHEN length({field}) >= 3 THEN list_transform(range(1, length({field}) - 1), lambda i: substr({field}, CAST(i AS INTEGER), 3)) ELSE CAST([] AS VARCHAR[]) END" if field == "n_compact" else f"list_filter(regexp_split_to_array(coalesce({field}, ''), '\\s+'), lambda x: x <> '')"
    return f""",
{name}_d AS (SELECT 0 AS side, {block}, entity_id, {terms} AS terms FROM {s1} WHERE {where_s1} UNION ALL SELECT 1, {block}, entity_id, {terms} FROM {pool} WHERE {where_pool}),
{name}_n AS (SELECT {block}, count(*) AS n FROM {name}_d GROUP BY ALL),
{name}_tf AS (SELECT side, {block}, entity_id, term, count(*) AS tf FROM (SELECT side, {block}, entity_id, unnest(terms) AS term FROM {name}_d) GROUP BY ALL),
{name}_df AS (SELECT {block}, term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_x AS (SELECT side, {block}, entity_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM {name}_tf JOIN {name}_df USING ({block}, term) JOIN {name}_n USING ({block}) WHERE n <= 20000 OR df <= 0.05 * n),
{name}_w AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY side, {block}, entity_id)) AS w FROM {name}_x),
{name} AS (SELECT {", ".join("a." + b.strip() for b in block.split(","))}, a.entity_id AS s1, b.entity_id AS mid, sum(a.w * b.w) AS raw, round(sum(a.w * b.w), 6) AS cos FROM {name}_w a JOIN {name}_w b USING ({block}, term) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= {least})"""


def prepared(v: Views, view: str) -> DataFrame:
    """A linkage view with canonical columns; its own region stays.

    Rows are dealt out first: a table of one small file would be canonicalised by one task.
    """
    from ..functions.text import canon_addresses, canon_names

    dealt = v(view).repartition(2 * v.spark.sparkContext.defaultParallelism, "entity_id")
    df = canon_addresses(canon_names(dealt.withColumnRenamed("region", "_region")), regions={})
    return df.drop("region").withColumnRenamed("_region", "region")
