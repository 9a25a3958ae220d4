"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Doubles are rounded to six places on both sides, as the order of sums differs between engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.distributions import _QUANTILES, CENTRAL, MIDDLE, TAIL
from tidewater.sources.tables import STEP, TIMESTEP_NS

BLOCKS, BLOCK = 100, 20
BLOCK_NS = BLOCK * STEP * TIMESTEP_NS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def shown(df: DataFrame, *columns: str, **places: int) -> DataFrame:
    """The columns with doubles rounded to six places, or to those given (and no negative zero), whole numbers as long."""
    types = dict(df.dtypes)
    kinds = {"double": lambda c: (F.round(c, places.get(c, 6)) + 0.0), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long")}
    return df.select(*(kinds.get(types[c], F.col)(c).alias(c) for c in columns or df.columns))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


RAW = f"""raw AS (
  SELECT CAST(CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 0.125 WHEN 'purchase' THEN 0.25 WHEN 'signup' THEN 0.5 WHEN 'view' THEN 1.0 END AS DOUBLE) AS lam,
         CAST(user_id % 5 + 1 AS BIGINT) AS run, value AS grad,
         row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) - 1 AS i
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') AND user_id IS NOT NULL)"""
SAMPLES = f"samples AS (SELECT lam, run, i, CAST((i + 1) * {STEP} AS BIGINT) AS step, grad, count(*) OVER (PARTITION BY lam, run) AS n FROM raw)"
#: The samples of runs that end with the shortest of their window.
EVEN = f"shortest AS (SELECT lam, min(c) AS n FROM (SELECT lam, run, count(*) AS c FROM raw GROUP BY lam, run) GROUP BY lam), samples AS (SELECT raw.lam, run, i, CAST((i + 1) * {STEP} AS BIGINT) AS step, grad, n FROM raw JOIN shortest USING (lam) WHERE i < n)"
WEIGHTS = """weights AS (
  SELECT lam, CAST(row_number() OVER (ORDER BY lam) - 1 AS BIGINT) AS lam_index,
         0.5 * (coalesce(lead(lam) OVER (ORDER BY lam), lam) - coalesce(lag(lam) OVER (ORDER BY lam), lam)) AS weight
  FROM (SELECT DISTINCT lam FROM samples))"""
R = lambda x, name: f"round({x}, 6) + 0 AS {name}"
#: 0.975 quantiles of Student's t by degrees of freedom from 1.
T975 = "[" + ", ".join(repr(q) for q in _QUANTILES) + "]"


def with_samples(body: str, *more: str) -> str:
    return "WITH " + ", ".join([RAW, SAMPLES, WEIGHTS, *more]) + " " + body


def with_even(body: str, *more: str) -> str:
    return "WITH " + ", ".join([RAW, EVEN, WEIGHTS, *more]) + " " + body


def normal_quantile_sql(p: str) -> str:
    """The rational approximation of the normal quantile as SQL."""

    def poly(c: tuple[float, ...], x: str) -> str:
        return "(" + " + ".join([repr(c[0]), *(f"{v!r} * pow({x}, {k}.0)" for k, v in enumerate(c[1:], 1))]) + ")"

    ratio = lambda table, x: f"{poly(table[0], x)} / {poly(table[1], x)}"
    q, s = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(CENTRAL, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * CASE WHEN {s} <= 5 THEN {ratio(MIDDLE, f'({s} - 1.6)')} ELSE {ratio(TAIL, f'({s} - 5.0)')} END END"


def _simpson(f: str, end: str, steps: int = 4000) -> str:
    """The integral of f, a text with {x}, from 0 to end by Simpson's rule."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum({weight} * {f.format(x=f'({end} * k / {steps}.0)')}) FROM range(0, {steps + 1}) s(k)) * {end} / {3 * steps}.0"


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t, from the angle atan(t / sqrt(df)), whose density is a power of its cosine."""
    inside = _simpson(f"pow(cos({{x}}), {df} - 1)", f"atan(abs({t}) / sqrt({df}))")
    return f"(1 - 2 * {inside} * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / {math.sqrt(math.pi)!r})"


def upper_normal_sql(z: str) -> str:
    """The normal distribution's upper tail."""
    return f"(0.5 - {_simpson('exp(-0.5 * {x} * {x})', z)} / {math.sqrt(2 * math.pi)!r})"
