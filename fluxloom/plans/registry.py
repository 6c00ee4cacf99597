"""Registered queries, and the bindings of the domain's tables to the given ones."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Domain tables as SQL over the given tables or over other bindings, in braces. Written once for
#: both engines; SAY holds what they spell differently (Spark, DuckDB).
BINDINGS: dict[str, str] = {}
SAY = {
    "EPOCH(ts)": ("unix_timestamp(ts)", "CAST(floor(epoch(ts)) AS BIGINT)"),
    "KEY(props)": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "STAMP(hh * 1800)": ("timestamp_seconds(hh * 1800)", "make_timestamp(hh * 1800000000)"),
    "datediff('day',": ("datediff(day,", "datediff('day',"),
}


def _spelled(text: str, engine: int) -> str:
    for name, said in SAY.items():
        text = text.replace(name, said[engine])
    return text


def query(*bindings: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL over the bindings named."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ctes(*bindings) + sql
        return f

    return register


def _needs(name: str, given: dict[str, str], seen: list[str]) -> list[str]:
    for _, ref, _, _ in string.Formatter().parse(given[name]):
        if ref and ref in given and ref not in seen:
            _needs(ref, given, seen)
    if name not in seen:
        seen.append(name)
    return seen


class _Names(dict):
    def __missing__(self, key):
        return key


def ctes(*names: str) -> str:
    """WITH clause for DuckDB that defines the bindings and what they need."""
    order: list[str] = []
    for n in names:
        _needs(n, BINDINGS, order)
    parts = [f"{n} AS ({_spelled(BINDINGS[n].format_map(_Names()), 1)})" for n in order]
    return ("WITH " + ", ".join(parts) + "\n") if parts else ""


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding, or one of the given tables, as a DataFrame."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = BINDINGS[name]
    refs = {ref for _, ref, _, _ in string.Formatter().parse(text) if ref}
    return spark.sql(_spelled(text, 0), **{r: bind(spark, sf_dir, r) for r in refs})


BINDINGS["px_obs"] = """
SELECT l_partkey % 20 AS x, l_suppkey % 10 AS y, CAST(l_shipdate AS TIMESTAMP) AS scene_ts, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln,
       0.2e0 + l_quantity / 125e0 AS nir, l_discount AS red, l_tax AS blue, 0.05e0 + l_linenumber * 0.03e0 AS swir, 0.1e0 + l_quantity / 250e0 AS red_edge,
       8 + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN l_orderkey % 19 = 0 THEN 4 ELSE 0 END
         + CASE WHEN l_orderkey % 23 = 0 THEN 256 ELSE 0 END + CASE WHEN l_orderkey % 29 = 0 THEN 8192 ELSE 0 END
         + CASE WHEN l_orderkey % 7 = 0 THEN 4096 ELSE 0 END AS state_qa,
       (l_orderkey + l_linenumber) % 12 AS scl,
       (l_orderkey * 2654435761 + l_linenumber * 97) % 4294967296 AS qc_500m,
       (l_orderkey * 31 + l_linenumber) % 256 AS fmask, l_orderkey % 256 AS qf1, l_partkey % 256 AS qf2, (l_suppkey * 7) % 64 AS qf6,
       1 + l_orderkey % 365 AS obs_doy
FROM {lineitem}"""

# Hourly weather on the same pixels; day counts from 1995-01-01.
BINDINGS["met_obs"] = """
SELECT x, y, hour, CAST(floor(hour / 24e0) AS BIGINT) AS day, t2m, ssrd, ok FROM (
  SELECT o_custkey % 20 AS x, CAST(floor(o_custkey / 20e0) AS BIGINT) % 10 AS y, o_orderkey AS ok,
         (CAST(floor(EPOCH(ts) / 86400e0) AS BIGINT) - 9131) * 24 + o_orderkey % 24 AS hour,
         268.15e0 + o_totalprice % 35 AS t2m,
         CASE WHEN o_orderkey % 24 BETWEEN 6 AND 18 THEN (o_orderkey % 24 - 6) * (18 - o_orderkey % 24) * 60000e0 ELSE 0e0 END AS ssrd
  FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS ts FROM {orders}) o) m"""

# Half-hourly rows of twelve sites in January 2024.
BINDINGS["tower_obs"] = """
SELECT site, hh, STAMP(hh * 1800) AS t, hh - 19723 * 48 AS step, CAST(floor(hh / 48e0) AS BIGINT) - 19723 AS day, nee, p_mm, qc, k, n,
       5e0 + (hh % 48) * 0.3e0 + nee / 10e0 AS t2m,
       CASE WHEN hh % 48 BETWEEN 14 AND 34 THEN (hh % 48 - 13) * (35 - hh % 48) * 3e0 ELSE 0e0 END AS ssrd
FROM (SELECT user_id % 12 AS site, CAST(floor(EPOCH(ts) / 1800e0) AS BIGINT) AS hh, avg(value / 25e0 - 10e0) AS nee,
             sum(CASE WHEN event_type = 'error' THEN value / 200e0 ELSE 0e0 END) AS p_mm, min(KEY(props) % 4) AS qc, max(KEY(props)) AS k, count(*) AS n
      FROM (SELECT user_id, event_type, value, props, CAST(ts AS TIMESTAMP) AS ts FROM {events}) e GROUP BY 1, 2) b"""

BINDINGS["land_cover"] = """
SELECT p_partkey % 60 AS fx, CAST(floor(p_partkey / 60e0) AS BIGINT) AS fy, CAST(p_size AS BIGINT) AS code, p_retailprice / 1000e0 AS height FROM {part}"""

BINDINGS["granules"] = """
SELECT concat('MOD09A1.A', CAST(2020 + o_orderkey % 3 AS VARCHAR(4)), CAST(100 + o_orderkey % 97 AS VARCHAR(3)), '.h', CAST(10 + o_custkey % 9 AS VARCHAR(2)), 'v0', CAST(o_custkey % 7 AS VARCHAR(1)),
              '.061.', CAST(20220000000 + o_orderkey AS VARCHAR(11)), '.hdf') AS name, o_orderkey AS ok FROM {orders}"""

# Masked indices of px_obs, then one row per pixel and day, its statistics. Means are sums of whole
# units of 2**-50 as in expr.exact_mean, so that the order of rows decides no comparison.
BINDINGS["masked"] = """
SELECT x, y, scene_ts, snow AND NOT hidden AS is_snow, CASE WHEN NOT hidden AND NOT snow AND e BETWEEN 0 AND 1 THEN e END AS evi, CASE WHEN NOT hidden AND NOT snow THEN w END AS lswi FROM (
  SELECT x, y, scene_ts, 2.5e0 * (nir - red) / (nir + 6 * red - 7.5e0 * blue + 1) AS e, (nir - swir) / (nir + swir) AS w,
         ok % 7 = 0 AS snow, ok % 17 = 0 OR ok % 19 = 0 OR ok % 23 = 0 OR ok % 29 = 0 AS hidden FROM {px_obs}) p"""

BINDINGS["stack"] = """
SELECT x, y, day, is_snow, CASE WHEN NOT is_snow THEN evi END AS evi, CASE WHEN NOT is_snow THEN lswi END AS lswi FROM (
  SELECT x, y, CAST(datediff('day', CAST((SELECT min(scene_ts) FROM {masked}) AS DATE), CAST(scene_ts AS DATE)) AS BIGINT) AS day,
         bool_or(is_snow) AS is_snow, CAST(sum(CAST(floor(evi * 1125899906842624e0 + 0.5e0) AS BIGINT)) AS DOUBLE) / count(evi) / 1125899906842624e0 AS evi,
         CAST(sum(CAST(floor(lswi * 1125899906842624e0 + 0.5e0) AS BIGINT)) AS DOUBLE) / count(lswi) / 1125899906842624e0 AS lswi FROM {masked} GROUP BY 1, 2, 3) d"""

BINDINGS["stats"] = """
SELECT s.x, s.y, max(m.lo) AS min_evi, max(m.hi) AS max_evi, max(m.th) AS th, min(CASE WHEN s.evi > m.th THEN s.lswi END) AS min_lswi, max(CASE WHEN s.evi > m.th THEN s.lswi END) AS max_lswi
FROM {stack} s JOIN (SELECT x, y, min(evi) AS lo, max(evi) AS hi, min(evi) + 0.55e0 * (max(evi) - min(evi)) AS th FROM {stack} GROUP BY x, y) m ON s.x = m.x AND s.y = m.y GROUP BY s.x, s.y"""

BINDINGS["coefficients"] = """
SELECT * FROM (VALUES (1, -4e0, 15e0, 38e0, -3e0), (2, 1e0, 21e0, 37e0, 0e0), (3, -1e0, 18e0, 38e0, 0e0), (4, -1e0, 19e0, 44e0, 2e0), (5, 0e0, 20e0, 40e0, 0e0), (6, -3e0, 16e0, 50e0, -3e0), (7, -2e0, 17e0, 36e0, -2e0), (8, 2e0, 18e0, 40e0, -2e0), (9, -2e0, 26e0, 40e0, 0e0)) c(veg_class, tmin, topt, tmax, tlow)"""

BINDINGS["params"] = """
SELECT veg_class, 0.05e0 + veg_class * 0.02e0 AS lamb, 200e0 + 40 * veg_class AS par0, 0.1e0 + 0.02e0 * veg_class AS alpha, 0.3e0 * veg_class AS beta FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) p(veg_class)"""

# Fractions of two classes for each pixel.
BINDINGS["fractions"] = """
SELECT x, y, veg_class, CASE WHEN k = 0 THEN 0.625e0 ELSE 0.375e0 END AS frac FROM (
  SELECT x, y, k, CAST(1 + (x + 3 * y + 4 * k) % 9 AS INT) AS veg_class FROM (SELECT DISTINCT x, y FROM {px_obs}) p, (VALUES (0), (1)) v(k)) f"""
