"""Streaming queries: the tick table goes through a stream, and what it wrote is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.registry import TICKS, query
from fathom.streaming import bars as N
from fathom.streaming import keyed as K


@query(
    "n2_streaming_tumbling_bars",
    f"""WITH {TICKS}, b AS (SELECT symbol, date_trunc('hour', ts) AS bar_start, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM ticks GROUP BY 1, 2)
    SELECT * FROM b WHERE bar_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM ticks)""",
)
def tumbling(spark, sf_dir) -> DataFrame:
    """Every bar whose window the watermark has passed."""
    made = N.run_once(N.tumbling_bars(N.tick_stream(spark, sf_dir)), N.shared_folder(spark))
    return made.drop("bar_end").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query(
    "n3_streaming_sliding_vwap",
    f"""WITH {TICKS}, s AS (SELECT symbol, price, size, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL (15 * k) MINUTES AS start_ts FROM ticks, (SELECT unnest(range(0, 4)) AS k))
    SELECT symbol, start_ts, round(sum(price * size) / nullif(sum(size), 0), 9) AS vwap FROM s GROUP BY 1, 2 HAVING start_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM ticks)""",
)
def sliding(spark, sf_dir) -> DataFrame:
    made = N.run_once(N.sliding_vwap(N.tick_stream(spark, sf_dir)), N.shared_folder(spark))
    return made.select("symbol", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.round("vwap", 9).alias("vwap"))


@query(
    "n4_streaming_session_bars",
    f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM ticks), i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, seq) AS run FROM g)
    SELECT symbol, min(ts) AS start_ts, arg_min(price, (ts, seq)) AS open, arg_max(price, (ts, seq)) AS close, count(*) AS n_ticks FROM i GROUP BY symbol, run HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM ticks)""",
)
def by_session(spark, sf_dir) -> DataFrame:
    made = N.run_once(N.session_bars(N.tick_stream(spark, sf_dir)), N.shared_folder(spark))
    return made.select("symbol", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "open", "close", "n_ticks")


@query(
    "n5_streaming_ema",
    f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, ts, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks), e AS (
      SELECT symbol, ts, seq, k, price, NULL::DOUBLE AS change, price AS ema FROM n WHERE k = 1 UNION ALL
      SELECT n.symbol, n.ts, n.seq, n.k, n.price, n.price - e.price, e.ema + 0.1 * (n.price - e.ema) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
    SELECT symbol, seq, round(change, 6) AS change, round(ema, 6) AS ema FROM e WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM ticks)""",
)
def keyed(spark, sf_dir) -> DataFrame:
    """Increments and the exponential mean as keyed state, each hour once the watermark has passed it."""
    with K.rocksdb(spark):
        made = N.run_once(K.keyed_ticks(N.tick_stream(spark, sf_dir)), N.shared_folder(spark))
    return made.select("symbol", "seq", F.round("change", 6).alias("change"), F.round("ema", 6).alias("ema"))


@query(
    "n6_streaming_calendar",
    f"""WITH {TICKS}, p AS (SELECT CAST(ts AS DATE) AS period, min(ts) AS start_ts, max(ts) AS end_ts FROM ticks WHERE symbol = 'purchase' GROUP BY 1)
    SELECT t.symbol, t.seq, p.period FROM ticks t JOIN p ON t.ts > p.start_ts AND t.ts <= p.end_ts""",
)
def calendar(spark, sf_dir) -> DataFrame:
    """Ticks with the period of a table that holds them, the table read anew for every micro-batch."""
    folder = N.shared_folder(spark)
    sold = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    sold.groupBy(F.to_date("ts").alias("period")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).write.parquet(f"{folder}/calendar")
    return N.with_calendar(N.tick_stream(spark, sf_dir), f"{folder}/calendar", folder).select("symbol", "seq", "period")


@query(
    "n6_streaming_matched",
    f"WITH {TICKS} SELECT a.seq AS seq_a, b.seq AS seq_b, round(a.price - b.price, 6) AS apart FROM ticks a JOIN ticks b ON a.symbol = 'purchase' AND b.symbol = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 5 MINUTES",
)
def matched(spark, sf_dir) -> DataFrame:
    """Purchases with the views of the five minutes before them, a join of two streams."""
    side = lambda s: N.tick_stream(spark, sf_dir).where(F.col("symbol") == s)
    made = N.run_once(N.matched(side("purchase"), side("view")), N.shared_folder(spark))
    return made.select("seq_a", "seq_b", F.round(F.col("price_a") - F.col("price_b"), 6).alias("apart"))
