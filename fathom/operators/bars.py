"""Ticks to bars: increments, order-flow pressure, interval assignment and roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, ratio

DAY = Series(("symbol", "trading_date"), ("ts", "seq"))


def increments(ticks: DataFrame, column: str = "cum_volume", into: str = "dv", series: Series = DAY) -> DataFrame:
    """Cumulative to increment within a day: never negative, the first tick counts whole."""
    value = F.col(column) - F.coalesce(series.lag(column), F.lit(0))
    return ticks.withColumn(into, F.greatest(value, F.lit(0)))


def pressure(ticks: DataFrame, levels: Sequence[int] = (1,), series: Series = DAY) -> DataFrame:
    """Depleted queue volume per level: sell_raw_{i} from bids, buy_raw_{i} from asks.

    A bid that falls gives up its whole previous queue; one that stands gives up what its
    queue lost.  Asks mirror this.  A level that is absent or zero all day gives NULL.
    """
    out = {}
    for i in levels:
        for side, q, name in (("sell", "b", f"sell_raw_{i}"), ("buy", "a", f"buy_raw_{i}")):
            price, size = F.col(f"{q}{i}"), F.col(f"{q}{i}_v")
            before, queue = series.lag(price), series.lag(size)
            worse = price < before if side == "sell" else price > before
            raw = F.when(worse, queue).when((price == before) & (size < queue), queue - size).otherwise(0)
            there = F.bool_or(F.coalesce(price, F.lit(0.0)) != 0).over(Window.partitionBy(*series.keys))
            out[name] = F.when(there, F.coalesce(raw, F.lit(0)))
    return ticks.withColumns(out)


def allocate(ticks: DataFrame, levels: Sequence[int] = (1,), volume: str = "dv", suffix: str = "") -> DataFrame:
    """Split each increment by the pressure of the summed levels: buy, sell and delta columns."""
    buy = sum((F.coalesce(F.col(f"buy_raw_{i}"), F.lit(0)) for i in levels), F.lit(0))
    sell = sum((F.coalesce(F.col(f"sell_raw_{i}"), F.lit(0)) for i in levels), F.lit(0))
    total = buy + sell
    share = lambda x: F.when(total > 0, F.col(volume) * x / total).otherwise(0.0)
    return ticks.withColumns({f"buy{suffix}": share(buy), f"sell{suffix}": share(sell), f"delta{suffix}": share(buy) - share(sell)})


def opening_direction(last: Column, bid: Column, ask: Column, volume: Column) -> tuple[Column, Column]:
    """(buy, sell) of a day's first tick: by the side of the mid price, half each at it."""
    mid = (bid + ask) / 2
    buy = F.when(last > mid, volume * 1.0).when(last < mid, 0.0).otherwise(volume / 2)
    return buy, volume - buy


#: Trading sessions as minutes after midnight (fixed values): night of the previous day, day parts.
SESSIONS = ((1260, 1380), (540, 615), (630, 690), (810, 900))


def trading_minute(ts: Column, sessions: Sequence[tuple[int, int]] = SESSIONS) -> Column:
    """Trading minutes since the first session began, breaks left out; NULL outside sessions."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    out, before = F.lit(None).cast("int"), 0
    for begin, end in sessions:
        out = F.when((minute >= begin) & (minute < end), minute - begin + before).otherwise(out)
        before += end - begin
    return out


def with_trading_date(ticks: DataFrame, ts: str = "ts", into: str = "trading_date", evening: int = SESSIONS[0][0]) -> DataFrame:
    """``ticks`` with the trading date of each: night ticks belong to the next day that trades.

    Days that trade are those with ticks before ``evening``, so Friday night is Monday's; the
    night after the last of them gets the next calendar day.  The calendar has one row a day.
    """
    day, night = F.to_date(F.col(ts)), F.hour(ts) * 60 + F.minute(ts) >= evening
    days = ticks.groupBy(day.alias("_day")).agg(F.max(F.when(~night, day)).alias("_trades"))
    later = Window.orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("_day", F.coalesce(F.first("_trades", True).over(later), F.date_add("_day", 1)).alias("_next"))
    dated = ticks.drop(into).withColumn("_date", day).join(F.broadcast(days), F.col("_date").eqNullSafe(F.col("_day")))
    return dated.withColumn(into, F.when(night, F.col("_next")).otherwise(F.col("_date"))).drop("_day", "_next", "_date")


def trading_periods(freq: int, sessions: Sequence[tuple[int, int]] = SESSIONS) -> list[tuple[int, int, int]]:
    """(period, first, end) in trading minutes for bars of ``freq`` trading minutes."""
    total = sum(b - a for a, b in sessions)
    return [(k, a, min(a + freq, total)) for k, a in enumerate(range(0, total, freq))]


def ohlcv(ticks: DataFrame, by: Sequence[str | Column], price: str = "price", size: str = "size", order: Sequence[str] = ("ts", "seq"), extra: Sequence[Column] = ()) -> DataFrame:
    """Open, high, low, close, volume and VWAP parts per group; ties in time end at ``seq``."""
    at = F.struct(*order)
    return ticks.groupBy(*by).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(size).alias("volume"),
        F.sum(F.col(price) * F.col(size)).alias("vwap_pv"),
        F.sum(size).alias("vwap_v"),
        F.count("*").alias("n_ticks"),
        *extra,
    )


def roll_up(bars: DataFrame, by: Sequence[str | Column], order: str = "ts") -> DataFrame:
    """Larger bars from smaller ones: first open, extremes, last close, sums."""
    sums = [F.sum(x).alias(x) for x in ("volume", "vwap_pv", "vwap_v", "n_ticks", "delta", "buy_vol", "sell_vol") if x in bars.columns]
    return bars.groupBy(*by).agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), *sums)


def efficiency_ratio(ticks: DataFrame, by: Sequence[str], mid: str = "mid", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Net over total movement of the mid price per bar: NULL under two ticks, 0 without movement."""
    series = Series(tuple(by), tuple(order))
    moved = ticks.withColumn("_step", F.abs(series.diff(mid)))
    at = F.struct(*order)
    net = F.abs(F.max_by(mid, at) - F.min_by(mid, at))
    total = F.sum("_step")
    return moved.groupBy(*by).agg(F.when(F.count(mid) >= 2, F.when(total > 0, net / total).otherwise(0.0)).alias("efficiency_ratio"))


def order_flow_imbalance(delta: str | Column, volume: str | Column) -> Column:
    return F.coalesce(ratio(delta, volume), F.lit(0.0))
