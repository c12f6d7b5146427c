"""The tables that the registered queries work on, derived from the given ones by Spark.

``events`` are ticks: event_type is the symbol, value the price, user_id the size.  Quotes
are derived from each tick: a bid and an ask around its price, and queue sizes from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.windows import Series
from fathom.operators.bars import ohlcv
from fathom.operators.clean import carried_value


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.to_date("ts").alias("trading_date"), F.col("value").alias("price"), F.col("user_id").alias("size"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with five bid and ask levels, their queues and a cumulative day volume."""
    base = ticks(spark, sf_dir)
    out = base.withColumn("cum_volume", F.sum("size").over(Series(("symbol", "trading_date"), ("ts", "seq")).so_far))
    for i in range(1, 6):
        out = out.withColumns({
            f"b{i}": F.floor(F.col("price") / 10) * 10.0 - i,
            f"a{i}": F.ceil(F.col("price") / 10) * 10.0 + i,
            f"b{i}_v": (F.col("seq") * (7 + i)) % 50,
            f"a{i}_v": (F.col("seq") * (11 + i)) % 50,
        })
    return out


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per symbol with signed volume: size counts as bought at or above the previous price."""
    flow = carried_value(ticks(spark, sf_dir), ["symbol"], "trading_date", ["ts", "seq"], "price", "before", strict=True)
    signed = flow.withColumn("buy", F.when(F.col("price") >= F.coalesce("before", "price"), F.col("size")).otherwise(0))
    sides = [F.sum("buy").alias("buy_vol"), (F.sum("size") - F.sum("buy")).alias("sell_vol"), (2 * F.sum("buy") - F.sum("size")).alias("delta")]
    made = ohlcv(signed, ["symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")], extra=sides)
    return made.withColumnRenamed("bar", "ts").withColumn("trading_date", F.to_date("ts"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag from lineitem, whose rows of one day carry no order: averages, extremes and sums."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    grouped = items.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return grouped.agg(F.round(F.avg(price), 8).alias("close"), F.round(F.max(price), 8).alias("high"), F.round(F.min(price), 8).alias("low"), F.sum("l_quantity").alias("volume"))
