"""From positions to bar results, cash accounts and daily metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, ratio

YEAR = 252


def results(df: DataFrame, series: Series, position: str = "position", price: str = "price", switch: Column | None = None) -> DataFrame:
    """Bar results: the position of the bar before earns this bar's return; switch bars earn nothing."""
    held = F.coalesce(series.lag(position), F.lit(0.0))
    out = df.withColumn("held", held).withColumn("actual_return", F.coalesce(series.ret(price), F.lit(0.0)))
    earned = F.col("held") * F.col("actual_return")
    out = out.withColumn("strategy_return", earned if switch is None else F.when(switch, 0.0).otherwise(earned))
    out = out.withColumn("traded", (F.col("held") != F.coalesce(series.lag("held"), F.lit(0.0))).cast("int"))
    return out.withColumn("cumulative_value", 1 + series.cumsum("strategy_return"))


def cash_account(df: DataFrame, series: Series, position: str = "held", price: str = "price", multiplier: float = 10.0, rate: float = 1e-4, capital: float = 3000.0, fee_price: float = 3500.0) -> DataFrame:
    """Points account of one lot: gross by price change, a fee whenever flat turns held or back."""
    before = F.coalesce(series.lag(position), F.lit(0.0))
    out = df.withColumns({
        "gross": F.coalesce(F.col(position) * series.diff(price) * multiplier, F.lit(0.0)),
        "fee": F.when((before == 0) != (F.col(position) == 0), fee_price * rate * multiplier).otherwise(0.0),
    })
    out = out.withColumn("net", F.col("gross") - F.col("fee"))
    return out.withColumn("equity", capital + series.cumsum("net"))


def daily(df: DataFrame, keys: Sequence[str], ts: str = "ts", switch: str | None = None) -> DataFrame:
    """Sums by calendar date; days with a switch bar are left out."""
    made = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.sum("strategy_return").alias("r"), F.sum("actual_return").alias("b"), F.bool_or(F.col("held") != 0).alias("active"), F.sum("traded").alias("trades"), *([F.bool_or(switch).alias("switched")] if switch else [])
    )
    return made.where("not switched").drop("switched") if switch else made


def metrics(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: returns, risk, drawdown (of additive equity), ratios and counts.

    Deviations are those of the population.  A drawdown's peak starts at the first equity
    value.  Ratios over nothing are NULL, a Sharpe ratio over no deviation is 0.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = days.withColumn("equity", 1 + F.sum("r").over(w)).withColumn("peak", F.max("equity").over(w)).withColumn("fall", F.col("equity") / F.col("peak") - 1)
    win, loss = (F.col("r") > 0) & F.col("active"), (F.col("r") < 0) & F.col("active")
    count = lambda x: F.count(F.when(x, 1))
    found = grown.groupBy(*keys).agg(
        F.count("*").alias("days"), (F.avg("r") * YEAR).alias("annual_return"), (F.stddev_pop("r") * YEAR**0.5).alias("annual_vol"), F.min("fall").alias("max_drawdown"),
        ratio(F.avg("r"), F.stddev_pop(F.when(F.col("r") < 0, F.col("r")))).alias("_sortino"), ratio(count(win), count(win) + count(loss)).alias("win_rate"),
        ratio(F.avg(F.when(win, F.col("r"))), F.abs(F.avg(F.when(loss, F.col("r"))))).alias("profit_loss"), (F.avg("b") * YEAR).alias("benchmark_return"), (F.stddev_pop("b") * YEAR**0.5).alias("_bvol"),
        (F.stddev_pop(F.col("r") - F.col("b")) * YEAR**0.5).alias("_track"), F.max_by("equity", "date").alias("_last"), F.sum("trades").alias("trade_count"),
    )
    return found.select(
        *keys,
        "days",
        "annual_return",
        "annual_vol",
        F.coalesce(ratio("annual_return", "annual_vol"), F.lit(0.0)).alias("sharpe"),
        "max_drawdown",
        ratio("annual_return", F.abs("max_drawdown")).alias("calmar"),
        (F.col("_sortino") * YEAR**0.5).alias("sortino"),
        "win_rate",
        "profit_loss",
        "benchmark_return",
        ratio("benchmark_return", "_bvol").alias("benchmark_sharpe"),
        ratio(F.col("annual_return") - F.col("benchmark_return"), F.col("_track")).alias("information_ratio"),
        (F.col("_last") - 1).alias("total_return"),
        "trade_count",
    )


def windowed_sharpe(days: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Sharpe with guards: -999 under ``least`` days, 0 without deviation."""
    made = days.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return made.select(*keys, F.when(F.col("n") < least, -999.0).when(F.col("s") < 1e-9, 0.0).otherwise(F.col("m") / F.nullif("s", F.lit(0.0)) * YEAR**0.5).alias("sharpe"))
