"""Where queries register, and SQL fragments that the DuckDB twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function, with the SQL that gives the same rows where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not matter."""
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, CAST(ts AS DATE) AS trading_date, value AS price, user_id AS size FROM events
)"""
QUOTES = (
    TICKS
    + """, quotes AS (
  SELECT *, sum(size) OVER (PARTITION BY symbol, trading_date ORDER BY ts, seq) AS cum_volume,
    """
    + ", ".join(f"floor(price / 10) * 10.0 - {i} AS b{i}, ceil(price / 10) * 10.0 + {i} AS a{i}, (seq * {7 + i}) % 50 AS b{i}_v, (seq * {11 + i}) % 50 AS a{i}_v" for i in range(1, 6))
    + """ FROM ticks
)"""
)
BARS = (
    TICKS
    + """, signed AS (
  SELECT *, CASE WHEN price >= coalesce(lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq), price) THEN size ELSE 0 END AS buy FROM ticks
), bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume, sum(price * size) AS vwap_pv, CAST(sum(size) AS BIGINT) AS vwap_v,
    count(*) AS n_ticks, CAST(sum(buy) AS BIGINT) AS buy_vol, CAST(sum(size) - sum(buy) AS BIGINT) AS sell_vol,
    CAST(2 * sum(buy) - sum(size) AS BIGINT) AS delta, CAST(date_trunc('hour', min(ts)) AS DATE) AS trading_date
  FROM signed GROUP BY symbol, date_trunc('hour', ts)
)"""
)


def W(n: int | None = None, lead: bool = False) -> str:
    """Window over one symbol: all rows in order, or the last n."""
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"(PARTITION BY symbol ORDER BY ts{frame})"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {W(n)} >= {n if least is None else least} THEN {f.replace('$', x) if '$' in f else f'{f}({x})'} OVER {W(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W()}"


def ret(x: str, k: int = 1) -> str:
    return f"({x} / nullif({lag(x, k)}::DOUBLE, 0) - 1)"


def both(f: str, x: str, y: str, n: int) -> str:
    """Two-column aggregate, such as corr or covar_samp, over rows where both are there."""
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {W(n)} >= {n} THEN {f}({x}, {y}) OVER {W(n)} END"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def layered(base: str, layers: list[dict[str, str]], columns: list[str], final: str = "symbol, ts", digits: int = 6, start: str = "bars") -> str:
    """Layers of named expressions, one CTE each, then the rounded columns."""
    ctes, at = [base], start
    for k, layer in enumerate(layers):
        ctes.append(f"l{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in layer.items())} FROM {at})")
        at = f"l{k}"
    picked = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)
    return f"WITH {', '.join(ctes)} SELECT {final}, {picked} FROM {at}"
