"""Cleaning of bar and factor tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, finite


def to_number(x: str | Column) -> Column:
    """Number in a string, NULL for junk."""
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def fill(df: DataFrame, columns: Sequence[str], series: Series, forward: bool = True, backward: bool = False) -> DataFrame:
    """Fill gaps from before, then (it looks ahead) from after."""
    out = df
    if forward:
        out = out.withColumns({c: series.ffill(c) for c in columns})
    if backward:
        out = out.withColumns({c: series.bfill(c) for c in columns})
    return out


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without columns that hold no value; one aggregate over the table."""
    if not columns:
        return df
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if counts[c] == 0))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return finite_columns(df, [c for c, kind in df.dtypes if c in set(columns) and kind in ("double", "float")]).dropna("any", subset=list(columns))


def project(df: DataFrame, prefix: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Columns by prefix and name, in order and once; names that are absent are left out."""
    wanted = [c for c in df.columns if prefix is not None and c.startswith(prefix)] + [n for n in names if n in df.columns]
    return df.select(*dict.fromkeys(wanted))


def prefixed(df: DataFrame, names: Mapping[str, str], prefix: str = "x_", keep: Sequence[str] = ()) -> DataFrame:
    """Columns renamed by ``names``; all others but ``keep`` get ``prefix`` unless they have it."""
    new = {c: names.get(c, c if c in keep or c.startswith(prefix) else prefix + c) for c in df.columns}
    return df.withColumnsRenamed(new)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose names hold a match of ``pattern``."""
    return df.drop(*(c for c in df.columns if re.search(pattern, c)))


def lag_expand(df: DataFrame, columns: Sequence[str], series: Series, lag: int | None = None, per_column: Mapping[str, int] | None = None) -> DataFrame:
    """Add c_1 .. c_{L-1} per column and drop the first rows that lack them."""
    deep = {c: (per_column or {}).get(c, lag or 1) for c in columns}
    out = df.withColumns({f"{c}_{k}": series.lag(c, k) for c, most in deep.items() for k in range(1, most)})
    return out.withColumn("_rn", series.rn()).where(F.col("_rn") >= max(deep.values(), default=1) - 1).drop("_rn")


def deltas(df: DataFrame, columns: Sequence[str], series: Series) -> DataFrame:
    """Add {c}_delta and drop each key's first row."""
    out = df.withColumns({f"{c}_delta": series.diff(c) for c in columns})
    return out.withColumn("_rn", series.rn()).where("_rn > 0").drop("_rn")


def contract_switch(contract: str, series: Series) -> Column:
    """True where the contract differs from the row before; first rows are False."""
    return F.coalesce(F.col(contract) != series.lag(contract), F.lit(False))


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, failing at run time on NULL or repeated keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.withColumn("_n", n).where(F.assert_true((F.col("_n") == 1) & ok, F.lit("repeated or missing key")).isNull()).drop("_n")


def session_features(ts: str | Column) -> dict[str, Column]:
    """is_night, progress and session_sin from the time of day; times outside sessions sit at one half."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    minute = F.hour(ts) * 60 + F.minute(ts)
    night = (minute >= 1260) & (minute < 1380)
    day = (minute >= 540) & (minute <= 900)
    progress = F.when(night, (minute - 1260) / 120).when(day, (minute - 540) / 360).otherwise(0.5)
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return {"is_night": night.cast("int"), "progress": progress, "session_sin": F.sin(F.pi() * progress)}


def with_sessions(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with ``session_features``; where no row has a time of day, is_night and session_sin are 0."""
    has_time = F.coalesce(F.bool_or(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) > 0), F.lit(False))
    made = df.withColumns(session_features(ts)).crossJoin(F.broadcast(df.agg(has_time.alias("_timed"))))  # one row
    return made.withColumns({"is_night": F.when(F.col("_timed"), F.col("is_night")).otherwise(0), "session_sin": F.when(F.col("_timed"), F.col("session_sin")).otherwise(0.0)}).drop("_timed")


def carried(df: DataFrame, key: str, day: str, order: Sequence[str], x: str) -> DataFrame:
    """``df`` with last (``x`` filled forward), first (of the key), running_mean and mean of ``x`` per key.

    In two steps, so that no task takes a whole key: rows are scanned by key and day, and what
    earlier days leave behind comes from a table of one row a key and day.
    """
    there = F.when(F.col(x).isNotNull(), F.struct(*order))
    days = df.groupBy(F.col(key).alias("_key"), F.col(day).alias("_day")).agg(
        F.min_by(x, there).alias("_first"), F.max_by(x, there).alias("_last"), F.sum(x).alias("_sum"), F.count(x).alias("_n")
    )
    by_day = Window.partitionBy("_key").orderBy("_day")
    before, whole = by_day.rowsBetween(Window.unboundedPreceding, -1), by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = days.select(
        "_key",
        "_day",
        F.last("_last", True).over(before).alias("_last"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.first("_first", True).over(whole).alias("first"),
        F.try_divide(F.sum("_sum").over(whole), F.sum("_n").over(whole)).alias("mean"),
    )
    own = Window.partitionBy(key, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = df.join(left, F.col(key).eqNullSafe(F.col("_key")) & F.col(day).eqNullSafe(F.col("_day"))).withColumns({
        "last": F.coalesce(F.last(x, True).over(own), F.col("_last")),
        "running_mean": F.try_divide(F.col("_sum") + F.coalesce(F.sum(x).over(own), F.lit(0.0)), F.col("_n") + F.count(x).over(own)),
    })
    return made.drop("_key", "_day", "_last", "_sum", "_n")


def carried_value(df: DataFrame, by: Sequence[str], day: str, order: Sequence[str], x: str, into: str, strict: bool = False, ahead: bool = False) -> DataFrame:
    """``df`` with ``into``: the last ``x`` that is not NULL at or before each row (``strict``: before it).

    ``ahead`` looks the other way, for the first one at or after it.  ``order`` is within ``day``,
    which is in order too.  In two steps, so that no task takes a whole key: rows are scanned by
    key and day, and what other days leave comes from a table of one row a key and day.
    """
    there = F.when(F.col(x).isNotNull(), F.struct(*order))
    days = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*by, day)))).agg((F.min_by if ahead else F.max_by)(x, there).alias("_edge"))
    keys = [f"_k{i}" for i in range(len(by) + 1)]
    # To look ahead is to go backwards: a frame that grows is added to row by row, one that shrinks is summed anew for each.
    turned = (lambda c: F.col(c).desc_nulls_last()) if ahead else F.col
    others, own = Window.partitionBy(*keys[:-1]).orderBy(turned(keys[-1])), Window.partitionBy(*by, day).orderBy(*(turned(c) for c in order))
    others, own = others.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, -int(strict))
    days = days.select(*keys, F.last("_edge", True).over(others).alias("_carry"))
    same = F.lit(True)
    for k, name in zip(keys, (*by, day), strict=True):
        same = same & F.col(name).eqNullSafe(F.col(k))
    return df.withColumn(into, F.last(x, True).over(own)).join(days, same).withColumn(into, F.coalesce(into, "_carry")).drop("_carry", *keys)
