"""Sources, cleaning, joins and tick-to-bar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, clipped, normal_cdf, ratio
from fathom.operators import bars as B
from fathom.operators import clean, joins, scan
from fathom.operators.blocks import block_ema
from fathom.operators.frames import daily_bars, hourly_bars, quotes, ticks
from fathom.operators.quantiles import exact_quantiles
from fathom.plans.registry import BARS, QUOTES, TICKS, W, lag, query, roll, rounded

S = Series()


@query("a1_projected_scan", "SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def projected_scan(spark, sf_dir) -> DataFrame:
    """Three columns and a time slice, both of which reach the scan."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    picked = orders.where("o_orderdate >= timestamp'1997-01-01' and o_orderdate < timestamp'1999-01-01'")
    return picked.select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("price"))


@query("a5_symbols", "SELECT event_type AS symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def symbols(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("a10_numeric_coercion", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(props AS DOUBLE) AS junk FROM events")
def numeric_coercion(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", clean.to_number(F.get_json_object("props", "$.k")).alias("k"), clean.to_number("props").alias("junk"))


@query("a12_tail_rows", "SELECT event_id, ts, value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000)")
def tail_rows(spark, sf_dir) -> DataFrame:
    """The last 10000 rows, as the CSV tail writes them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10_000).select("event_id", "ts", "value")


GAPPY = f"WITH {TICKS}, gappy AS (SELECT symbol, ts, seq, price, size, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 11 = 0 THEN 'inf'::DOUBLE ELSE price END AS x FROM ticks)"


def _gappy(spark, sf_dir) -> DataFrame:
    hole = F.when(F.col("seq") % 7 == 0, None).when(F.col("seq") % 11 == 0, float("inf")).otherwise(F.col("price"))
    return ticks(spark, sf_dir).withColumn("x", hole)


@query(
    "b8_fill",
    GAPPY
    + """, fin AS (SELECT *, CASE WHEN isinf(x) THEN NULL ELSE x END AS y FROM gappy), f AS (
    SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq) AS g FROM fin)
    SELECT symbol, seq, round(y, 10) AS finite, round(g, 10) AS forward,
      round(coalesce(g, first_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS both_ways,
      round(coalesce(y, avg(y) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), avg(y) OVER (PARTITION BY symbol)), 10) AS fallback FROM f""",
)
def fills(spark, sf_dir) -> DataFrame:
    """Infinities to NULL, forward and backward fill, expanding and whole-sample fallback."""
    df = clean.carried(clean.finite_columns(_gappy(spark, sf_dir), ["x"]), "symbol", "trading_date", ["ts", "seq"], "x")
    return rounded(
        df.select("symbol", "seq", F.col("x").alias("finite"), F.col("last").alias("forward"), F.coalesce("last", "first").alias("both_ways"), F.coalesce("x", "running_mean", "mean").alias("fallback")), 10
    )


@query("b12_complete_rows", GAPPY + " SELECT symbol, seq, round(x, 4) AS x FROM gappy WHERE x IS NOT NULL AND NOT isinf(x)")
def complete(spark, sf_dir) -> DataFrame:
    return rounded(clean.complete_rows(_gappy(spark, sf_dir), ["x"]).select("symbol", "seq", "x"), 4)


@query(
    "b14_clip_winsor",
    f"""WITH {TICKS}, q AS (SELECT symbol, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM ticks GROUP BY 1)
    SELECT symbol, seq, round(least(greatest(price, lo), hi), 4) AS winsor, round(least(greatest(price, 10), 90), 4) AS clipped FROM ticks JOIN q USING (symbol)""",
)
def winsor(spark, sf_dir) -> DataFrame:
    """Fixed bounds, and per-symbol 1st and 99th percentiles."""
    df = ticks(spark, sf_dir)
    bounds = exact_quantiles(df, ["symbol"], "price", (0.01, 0.99)).groupBy("symbol").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = df.join(bounds, "symbol")
    return rounded(joined.select("symbol", "seq", clipped("price", F.col("lo"), F.col("hi")).alias("winsor"), clipped("price", 10.0, 90.0).alias("clipped")), 4)


@query(
    "b17_session_features",
    """WITH m AS (SELECT event_id, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM events), p AS (
    SELECT event_id, CASE WHEN m >= 1260 AND m < 1380 THEN 1 ELSE 0 END AS is_night,
      CASE WHEN m >= 1260 AND m < 1380 THEN (m - 1260) / 120.0 WHEN m >= 540 AND m <= 900 THEN (m - 540) / 360.0 ELSE 0.5 END AS progress FROM m)
    SELECT event_id, is_night, round(progress::DOUBLE, 6) AS progress, round(sin(pi() * progress), 6) AS session_sin FROM p""",
)
def sessions(spark, sf_dir) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns(clean.session_features("ts"))
    return rounded(df.select("event_id", "is_night", "progress", "session_sin"))


@query(
    "b17_days_without_times",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'days' ELSE 'times' END AS kind FROM orders),
    u AS (SELECT o_orderkey, kind, CASE WHEN kind = 'times' THEN ts + INTERVAL (o_orderkey % 1440) MINUTE ELSE ts END AS ts FROM t),
    m AS (SELECT *, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m, bool_or(extract(hour FROM ts) * 60 + extract(minute FROM ts) > 0) OVER (PARTITION BY kind) AS timed FROM u)
    SELECT o_orderkey, CASE WHEN timed AND m >= 1260 AND m < 1380 THEN 1 ELSE 0 END AS is_night,
      CASE WHEN NOT timed THEN 0 ELSE round(sin(pi() * CASE WHEN m >= 1260 AND m < 1380 THEN (m - 1260) / 120.0 WHEN m >= 540 AND m <= 900 THEN (m - 540) / 360.0 ELSE 0.5 END), 6) END AS session_sin FROM m""",
)
def midnights(spark, sf_dir) -> DataFrame:
    """Tables whose times are all midnight have no sessions."""
    minutes = F.expr("make_dt_interval(0, 0, cast(o_orderkey % 1440 as int), 0)")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    days, times = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1").withColumn("ts", F.col("ts") + minutes)
    both = clean.with_sessions(days, "ts").unionByName(clean.with_sessions(times, "ts"))
    return rounded(both.select("o_orderkey", "is_night", "session_sin"))


@query(
    "b20_lags_and_deltas",
    f"""WITH {BARS}, l AS (SELECT symbol, ts, close, row_number() OVER {W()} - 1 AS rn, {lag('close', 1)} AS close_1, {lag('close', 2)} AS close_2,
      CAST(hour(ts) % 6 AS VARCHAR) AS contract, close - {lag('close')} AS close_delta FROM bars)
    SELECT symbol, ts, close, close_1, close_2, round(close_delta, 6) AS close_delta, coalesce(contract <> {lag('contract')}, false) AS is_switch FROM l QUALIFY rn >= 2""",
)
def lags(spark, sf_dir) -> DataFrame:
    """Contract switches, differences, lag expansion."""
    df = hourly_bars(spark, sf_dir).select("symbol", "ts", "close", (F.hour("ts") % 6).cast("string").alias("contract"))
    df = df.withColumn("is_switch", clean.contract_switch("contract", S)).withColumn("close_delta", F.round(S.diff("close"), 6))
    return clean.lag_expand(df, ["close"], S, 3).drop("contract")


T21 = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2)))"
POLY = f"{T21} * (0.254829592 + {T21} * (-0.284496736 + {T21} * (1.421413741 + {T21} * (-1.453152027 + {T21} * 1.061405429))))"
#: The normal distribution function of ``z``, by the formula of ``normal_cdf``.
PHI = f"((1 + sign(z) * (1 - {POLY} * exp(-z * z / 2))) / 2)"


@query("b21_normal_cdf", f"WITH {TICKS}, m AS (SELECT symbol AS s, avg(price) AS mean, stddev_samp(price) AS std FROM ticks GROUP BY 1), z AS (SELECT symbol, seq, (price - mean) / nullif(std, 0) AS z FROM ticks JOIN m ON symbol = s) SELECT symbol, seq, round({PHI}, 6) AS p FROM z")
def phi(spark, sf_dir) -> DataFrame:
    """Standardised tick prices through the normal distribution function."""
    df = ticks(spark, sf_dir)
    whole = df.groupBy("symbol").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"))
    df = df.join(F.broadcast(whole.withColumnRenamed("symbol", "_symbol")), F.col("symbol").eqNullSafe(F.col("_symbol")))  # one row a symbol
    z = ratio(F.col("price") - F.col("mean"), F.col("std"))
    return df.select("symbol", "seq", F.round(normal_cdf(z), 6).alias("p"))


def _slots(spark, sf_dir) -> DataFrame:
    """Six-hour slots of every day that has ticks."""
    days = ticks(spark, sf_dir).select("trading_date").distinct()
    each = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    start = F.expr("cast(trading_date as timestamp_ntz) + make_interval(0, 0, 0, 0, 6 * slot)")
    return each.select("slot", start.alias("start_ts"), (start + F.expr("interval 5 hours")).alias("end_ts"))


SLOTS = f"{TICKS}, slots AS (SELECT slot, d + to_hours(6 * slot) AS start_ts, d + to_hours(6 * slot + 5) AS end_ts FROM (SELECT DISTINCT trading_date::TIMESTAMP AS d FROM ticks), (SELECT unnest(range(0, 4))::INT AS slot))"


@query("c1_interval_join_right", f"WITH {SLOTS} SELECT symbol, seq, slot, start_ts FROM ticks JOIN slots ON ts > start_ts AND ts <= end_ts")
def interval_right(spark, sf_dir) -> DataFrame:
    return joins.interval_join(ticks(spark, sf_dir), _slots(spark, sf_dir)).select("symbol", "seq", "slot", "start_ts")


@query("c2_interval_join_left", f"WITH {SLOTS} SELECT symbol, seq, slot, start_ts FROM ticks JOIN slots ON ts >= start_ts AND ts < end_ts")
def interval_left(spark, sf_dir) -> DataFrame:
    return joins.interval_join(ticks(spark, sf_dir), _slots(spark, sf_dir), closed="left").select("symbol", "seq", "slot", "start_ts")


UPPER = "upper AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts) + INTERVAL 4 HOURS AS ts, max(high) AS up_high, arg_max(close, ts) AS up_close FROM bars GROUP BY 1, time_bucket(INTERVAL 4 HOURS, ts))"


@query("c4_asof_backward", f"WITH {BARS}, {UPPER} SELECT b.symbol, b.ts, b.close, up_high, up_close FROM bars b ASOF LEFT JOIN upper u ON b.symbol = u.symbol AND b.ts >= u.ts")
def asof(spark, sf_dir) -> DataFrame:
    """Four-hour bars from hourly ones, attached once they have ended."""
    small = hourly_bars(spark, sf_dir)
    up = B.roll_up(small, ["symbol", F.window("ts", "4 hours").end.alias("ts")]).select("symbol", "ts", F.col("high").alias("up_high"), F.col("close").alias("up_close"))
    return joins.asof_backward(small.select("symbol", "ts", "close"), up, ["symbol"], columns=["up_high", "up_close"])


HOURS = (1, 2, 4, 6, 8, 12, 20)


@query(
    "c5_asof_offsets",
    f"WITH {BARS} SELECT b.symbol, b.ts, {', '.join(f'a{h}.price AS ago_{h}' for h in HOURS)} FROM bars b "
    + " ".join(f"ASOF LEFT JOIN (SELECT symbol, ts, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2) a{h} ON b.symbol = a{h}.symbol AND b.ts - INTERVAL {h} HOURS >= a{h}.ts" for h in HOURS),
)
def offsets(spark, sf_dir) -> DataFrame:
    """The price at or before each bar's time less 1 to 20 hours, from the tick tape."""
    return joins.asof_offsets(hourly_bars(spark, sf_dir).select("symbol", "ts"), ticks(spark, sf_dir), ["symbol"], "price", HOURS, tie="seq")


@query(
    "c6_irregular_intervals",
    f"""WITH {BARS}, ends AS (SELECT DISTINCT symbol, ts FROM bars WHERE hour(ts) % 5 = 0), dealt AS (
      SELECT t.*, e.ts AS bar_end FROM ticks t ASOF JOIN ends e ON t.symbol = e.symbol AND t.ts <= e.ts), g AS (
      SELECT symbol, bar_end, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS n FROM dealt GROUP BY 1, 2)
    SELECT e.symbol, e.ts AS bar_end, CASE WHEN f THEN close ELSE open END AS open, CASE WHEN f THEN close ELSE high END AS high,
      CASE WHEN f THEN close ELSE low END AS low, close, CASE WHEN f AND n > 0 THEN 1 ELSE coalesce(n, 0) END AS n
    FROM (SELECT *, ts = min(ts) OVER (PARTITION BY symbol) AS f FROM ends) e LEFT JOIN g ON e.symbol = g.symbol AND e.ts = g.bar_end""",
)
def irregular(spark, sf_dir) -> DataFrame:
    ends = hourly_bars(spark, sf_dir).where(F.hour("ts") % 5 == 0).select("symbol", "ts")
    return joins.interval_ohlc(ends, ticks(spark, sf_dir), ["symbol"], "price")


@query(
    "c7_one_to_one_left",
    f"WITH {BARS}, d AS (SELECT symbol, ts, high - low AS spread FROM bars WHERE hour(ts) < 12) SELECT b.symbol, b.ts, b.close, round(d.spread, 6) AS spread FROM bars b LEFT JOIN d USING (symbol, ts)",
)
def one_to_one(spark, sf_dir) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    other = bars.where(F.hour("ts") < 12).select("symbol", "ts", F.round(F.col("high") - F.col("low"), 6).alias("spread"))
    return joins.one_to_one(bars.select("symbol", "ts", "close"), other, ["symbol", "ts"])


@query(
    "c8_session_returns",
    f"""WITH {TICKS}, m AS (SELECT *, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ticks), r AS (SELECT symbol, trading_date,
      CASE WHEN count(*) FILTER (m >= 690 AND m < 810) >= 2 THEN arg_max(price, (ts, seq)) FILTER (m >= 690 AND m < 810) / arg_min(price, (ts, seq)) FILTER (m >= 690 AND m < 810) - 1 END AS midday,
      CASE WHEN count(*) FILTER (m >= 900 AND m < 1080) >= 2 THEN arg_max(price, (ts, seq)) FILTER (m >= 900 AND m < 1080) / arg_min(price, (ts, seq)) FILTER (m >= 900 AND m < 1080) - 1 END AS afternoon
      FROM m GROUP BY 1, 2)
    SELECT a.symbol, CAST(a.trading_date AS VARCHAR) AS trading_date, round(a.midday, 6) AS midday, round(a.afternoon, 6) AS afternoon, round(b.afternoon, 6) AS previous_afternoon
    FROM r a ASOF LEFT JOIN r b ON a.symbol = b.symbol AND a.trading_date > b.trading_date""",
)
def session_returns(spark, sf_dir) -> DataFrame:
    """Returns inside two parts of the day, and that of the last earlier day."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    df = ticks(spark, sf_dir).withColumn("m", minute)

    def part(a: int, b: int):
        inside = (F.col("m") >= a) & (F.col("m") < b)
        at = F.when(inside, F.struct("ts", "seq"))
        last, first = F.max_by("price", at), F.min_by("price", at)
        return F.when(F.count(F.when(inside, 1)) >= 2, F.round(ratio(last, first) - 1, 6))

    days = df.groupBy("symbol", "trading_date").agg(part(690, 810).alias("midday"), part(900, 1080).alias("afternoon"))
    before = days.select("symbol", "trading_date", F.col("afternoon").alias("previous_afternoon"))
    return joins.asof_backward(days, before, ["symbol"], ts="trading_date", columns=["previous_afternoon"], strict=True).withColumn("trading_date", F.col("trading_date").cast("string"))


@query("c11_index_intersection", f"WITH {BARS} SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = 5")
def intersection(spark, sf_dir) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    return joins.index_intersection([bars.where(F.col("symbol") == s) for s in ("click", "error", "purchase", "signup", "view")], ["ts"])


@query("c12_membership", f"WITH {BARS}, big AS (SELECT DISTINCT ts FROM bars WHERE high > 200) SELECT symbol, ts, close, ts IN (SELECT ts FROM big) AS is_big FROM bars")
def membership(spark, sf_dir) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    big = bars.where("high > 200").select("ts").distinct().withColumn("is_big", F.lit(True))
    return bars.select("symbol", "ts", "close").join(big, "ts", "left").withColumn("is_big", F.coalesce("is_big", F.lit(False)))


@query(
    "d1_increments_and_pressure",
    f"""WITH {QUOTES}, p AS (SELECT *, lag(cum_volume) OVER w AS pv, lag(b1) OVER w AS pb, lag(b1_v) OVER w AS pbv, lag(a1) OVER w AS pa, lag(a1_v) OVER w AS pav FROM quotes
      WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY ts, seq)), r AS (SELECT *, greatest(cum_volume - coalesce(pv, 0), 0) AS dv,
      coalesce(CASE WHEN b1 < pb THEN pbv WHEN b1 = pb AND b1_v < pbv THEN pbv - b1_v ELSE 0 END, 0) AS s, coalesce(CASE WHEN a1 > pa THEN pav WHEN a1 = pa AND a1_v < pav THEN pav - a1_v ELSE 0 END, 0) AS b FROM p)
    SELECT symbol, seq, CAST(dv AS BIGINT) AS dv, CAST(s AS BIGINT) AS sell_raw_1, CAST(b AS BIGINT) AS buy_raw_1, round(CASE WHEN b + s > 0 THEN dv * b / (b + s)::DOUBLE ELSE 0 END, 6) AS buy,
      round(CASE WHEN b + s > 0 THEN dv * s / (b + s)::DOUBLE ELSE 0 END, 6) AS sell FROM r""",
)
def increments(spark, sf_dir) -> DataFrame:
    """Day increments, level-1 queue pressure and volume allocation."""
    df = B.allocate(B.pressure(B.increments(quotes(spark, sf_dir))))
    return rounded(df.select("symbol", "seq", "dv", "sell_raw_1", "buy_raw_1", "buy", "sell"))


def _raw(i: int) -> str:
    w = "OVER (PARTITION BY symbol, trading_date ORDER BY ts, seq)"
    sell = f"coalesce(CASE WHEN b{i} < lag(b{i}) {w} THEN lag(b{i}_v) {w} WHEN b{i} = lag(b{i}) {w} AND b{i}_v < lag(b{i}_v) {w} THEN lag(b{i}_v) {w} - b{i}_v ELSE 0 END, 0) AS s{i}"
    buy = f"coalesce(CASE WHEN a{i} > lag(a{i}) {w} THEN lag(a{i}_v) {w} WHEN a{i} = lag(a{i}) {w} AND a{i}_v < lag(a{i}_v) {w} THEN lag(a{i}_v) {w} - a{i}_v ELSE 0 END, 0) AS t{i}"
    return f"{sell}, {buy}"


@query(
    "d4_depth_flow_bars",
    f"""WITH {QUOTES}, r AS (SELECT *, {', '.join(map(_raw, (1, 2, 3)))} FROM quotes), x AS (SELECT *, (t1 + t2 + t3) AS b, (s1 + s2 + s3) AS s FROM r)
    SELECT symbol, date_trunc('hour', ts) AS bar, round(sum(CASE WHEN b + s > 0 THEN size * (b - s) / (b + s)::DOUBLE ELSE 0 END), 4) AS delta,
      round(coalesce(sum(CASE WHEN b + s > 0 THEN size * (b - s) / (b + s)::DOUBLE ELSE 0 END) / nullif(sum(size), 0), 0), 6) AS ofi,
      round(sum(CASE WHEN b1 > 0 AND b1_v > 0 THEN b1 * b1_v ELSE 0 END + CASE WHEN a1 > 0 AND a1_v > 0 THEN a1 * a1_v ELSE 0 END), 4) AS bvwap_pv,
      CAST(sum(CASE WHEN b1 > 0 AND b1_v > 0 THEN b1_v ELSE 0 END + CASE WHEN a1 > 0 AND a1_v > 0 THEN a1_v ELSE 0 END) AS BIGINT) AS bvwap_v
    FROM x GROUP BY 1, 2""",
)
def depth_flow(spark, sf_dir) -> DataFrame:
    """Three-level pressure, flow imbalance and book VWAP parts per hour."""
    df = B.allocate(B.pressure(B.increments(quotes(spark, sf_dir)), (1, 2, 3)), (1, 2, 3))
    book = lambda q, x: F.when((F.col(q) > 0) & (F.col(f"{q}_v") > 0), x).otherwise(0)
    made = df.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.sum("delta").alias("delta"),
        B.order_flow_imbalance(F.sum("delta"), F.sum("dv")).alias("ofi"),
        F.sum(book("b1", F.col("b1") * F.col("b1_v")) + book("a1", F.col("a1") * F.col("a1_v"))).alias("bvwap_pv"),
        F.sum(book("b1", F.col("b1_v")) + book("a1", F.col("a1_v"))).alias("bvwap_v"),
    )
    return made.select("symbol", "bar", F.round("delta", 4).alias("delta"), F.round("ofi", 6).alias("ofi"), F.round("bvwap_pv", 4).alias("bvwap_pv"), "bvwap_v")


@query(
    "d4_five_level_pressure",
    f"""WITH {QUOTES}, r AS (SELECT *, {', '.join(map(_raw, range(1, 6)))} FROM quotes), x AS (SELECT *, t1 + t2 + t3 + t4 + t5 AS b, s1 + s2 + s3 + s4 + s5 AS s FROM r)
    SELECT symbol, date_trunc('hour', ts) AS bar, {', '.join(f"CAST(sum(t{i}) AS BIGINT) AS buy_{i}, CAST(sum(s{i}) AS BIGINT) AS sell_{i}" for i in range(1, 6))},
      round(sum(CASE WHEN b + s > 0 THEN size * (b - s) / (b + s)::DOUBLE ELSE 0 END), 4) AS delta FROM x GROUP BY 1, 2""",
)
def five_levels(spark, sf_dir) -> DataFrame:
    """Queue pressure of all five levels, each by itself and allocated together."""
    levels = range(1, 6)
    df = B.allocate(B.pressure(B.increments(quotes(spark, sf_dir)), levels), levels)
    sides = [F.sum(f"{side}_raw_{i}").cast("long").alias(f"{side}_{i}") for i in levels for side in ("buy", "sell")]
    return df.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(*sides, F.round(F.sum("delta"), 4).alias("delta"))


@query(
    "d7_opening_direction",
    f"""WITH {QUOTES}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, trading_date ORDER BY ts, seq) AS k FROM quotes)
    SELECT symbol, CAST(trading_date AS VARCHAR) AS trading_date, seq, round(CASE WHEN price > (b1 + a1) / 2 THEN size WHEN price < (b1 + a1) / 2 THEN 0 ELSE size / 2.0 END, 6) AS buy,
      round(size - CASE WHEN price > (b1 + a1) / 2 THEN size WHEN price < (b1 + a1) / 2 THEN 0 ELSE size / 2.0 END, 6) AS sell FROM f WHERE k = 1""",
)
def opening(spark, sf_dir) -> DataFrame:
    df = quotes(spark, sf_dir).withColumn("k", F.row_number().over(B.DAY.w)).where("k = 1")
    buy, sell = B.opening_direction(F.col("price"), F.col("b1"), F.col("a1"), F.col("size"))
    return df.select("symbol", F.col("trading_date").cast("string").alias("trading_date"), "seq", F.round(buy.cast("double"), 6).alias("buy"), F.round(sell.cast("double"), 6).alias("sell"))


@query(
    "d10_hourly_bars",
    f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, n_ticks, buy_vol, sell_vol, delta, round(vwap_pv / nullif(vwap_v, 0), 6) AS vwap FROM bars",
)
def bars(spark, sf_dir) -> DataFrame:
    made = hourly_bars(spark, sf_dir)
    return made.select("symbol", "ts", "open", "high", "low", "close", "volume", "n_ticks", "buy_vol", "sell_vol", "delta", F.round(ratio("vwap_pv", "vwap_v"), 6).alias("vwap"))


MINUTE = "CASE " + " ".join(f"WHEN m >= {a} AND m < {b} THEN m - {a} + {before}" for (a, b), before in zip(B.SESSIONS, (0, 120, 195, 255), strict=True)) + " END"


@query(
    "d0_trading_time_bars",
    f"""WITH {TICKS}, m AS (SELECT * EXCLUDE (trading_date), trading_date AS day, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ticks), days AS (SELECT DISTINCT day AS open_day FROM m WHERE m < 1260),
    nights AS (SELECT day AS night, coalesce((SELECT min(open_day) FROM days WHERE open_day > day), day + 1) AS next FROM (SELECT DISTINCT day FROM m)),
    p AS (SELECT m.*, CASE WHEN m >= 1260 THEN next ELSE day END AS trading_date, {MINUTE} // 60 AS period FROM m JOIN nights ON day = night)
    SELECT symbol, CAST(CAST(trading_date AS DATE) AS VARCHAR) AS trading_date, CAST(period AS INT) AS period, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume
    FROM p WHERE period IS NOT NULL GROUP BY symbol, p.trading_date, p.period""",
)
def trading_time(spark, sf_dir) -> DataFrame:
    """Bars of 60 trading minutes of a trading date, which begins the evening before; breaks are left out."""
    df = B.with_trading_date(ticks(spark, sf_dir)).withColumn("period", F.floor(B.trading_minute(F.col("ts")) / 60).cast("int")).where("period is not null")
    return B.ohlcv(df, ["symbol", "trading_date", "period"]).select("symbol", F.col("trading_date").cast("string").alias("trading_date"), "period", "open", "high", "low", "close", "volume")


@query(
    "d12_slot_day_vwap",
    f"""WITH {BARS} SELECT symbol, ts, round(sum(vwap_pv) OVER w / nullif((sum(vwap_v) OVER w)::DOUBLE, 0), 6) AS day_vwap,
      round(close / (sum(vwap_pv) OVER w / nullif((sum(vwap_v) OVER w)::DOUBLE, 0)) - 1, 6) AS deviation FROM bars WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY ts)""",
)
def day_vwap(spark, sf_dir) -> DataFrame:
    day = Series(("symbol", "trading_date"))
    df = hourly_bars(spark, sf_dir).withColumn("day_vwap", ratio(day.cumsum("vwap_pv"), day.cumsum("vwap_v")))
    return rounded(df.select("symbol", "ts", "day_vwap", (ratio("close", "day_vwap") - 1).alias("deviation")))


@query(
    "d13_efficiency_ratio",
    f"""WITH {QUOTES}, s AS (SELECT symbol, date_trunc('hour', ts) AS bar, ts, seq, (b1 + a1) / 2 AS mid, abs((b1 + a1) / 2 - lag((b1 + a1) / 2) OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts, seq)) AS step FROM quotes)
    SELECT symbol, bar, round(CASE WHEN count(*) >= 2 THEN CASE WHEN sum(step) > 0 THEN abs(arg_max(mid, (ts, seq)) - arg_min(mid, (ts, seq))) / sum(step) ELSE 0 END END, 6) AS efficiency_ratio FROM s GROUP BY 1, 2""",
)
def efficiency(spark, sf_dir) -> DataFrame:
    df = quotes(spark, sf_dir).withColumn("bar", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("mid", (F.col("b1") + F.col("a1")) / 2)
    return rounded(B.efficiency_ratio(df, ["symbol", "bar"]))


@query(
    "d14_daily_from_items",
    """WITH d AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem), b AS (
      SELECT symbol, ts, round(avg(p), 8) AS close, round(max(p), 8) AS high, round(min(p), 8) AS low, sum(q) AS volume FROM d GROUP BY 1, 2)
    SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_min(close, ts) AS first_close, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2""",
)
def monthly(spark, sf_dir) -> DataFrame:
    """Two-stage roll-up: items to days to months."""
    df = daily_bars(spark, sf_dir)
    return df.groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(
        F.min_by("close", "ts").alias("first_close"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


# --- ranking and sets


@query(
    "f1_rolling_quantiles",
    f"""WITH {BARS} SELECT symbol, ts, round({roll('quantile_cont(abs($), 0.7)', 'delta', 50, 30)}, 6) AS rolling_q,
      round(quantile_cont(abs(delta), 0.7) OVER {W()}, 6) AS expanding_q FROM bars""",
)
def rolling_quantiles(spark, sf_dir) -> DataFrame:
    df = hourly_bars(spark, sf_dir).withColumn("size", F.abs("delta"))
    made = scan.ordered_scan(df, ["symbol"], ["ts"], {"rolling_q": (lambda: scan.rolling_quantile(50, 0.7, 30), ["size"]), "expanding_q": (lambda: scan.expanding_quantile(0.7), ["size"])})
    return rounded(made.select("symbol", "ts", "rolling_q", "expanding_q"))


@query(
    "f6_top_bars",
    f"""WITH {BARS}, r AS (SELECT symbol, ts, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, ts) AS place, count(*) OVER (PARTITION BY symbol) AS n,
      row_number() OVER {W()} - 1 AS rn FROM bars) SELECT symbol, ts, volume, place, CAST(least(floor(rn / (n // 4)), 3) AS INT) AS quartile FROM r WHERE place <= 10""",
)
def top_bars(spark, sf_dir) -> DataFrame:
    """Per-symbol top ten by volume, with the quartile of time in which each falls."""
    whole = Window.partitionBy("symbol")
    df = hourly_bars(spark, sf_dir).withColumns({"n": F.count("*").over(whole), "rn": S.rn(), "place": F.row_number().over(whole.orderBy(F.desc("volume"), "ts"))})
    quartile = F.least(F.floor(F.col("rn") / F.floor(F.col("n") / 4)), F.lit(3)).cast("int")
    return df.where("place <= 10").select("symbol", "ts", "volume", F.col("place").cast("long").alias("place"), quartile.alias("quartile"))


@query(
    "g1_set_operations",
    f"""WITH {BARS}, a AS (SELECT DISTINCT ts FROM bars WHERE symbol = 'click'), b AS (SELECT DISTINCT ts FROM bars WHERE symbol = 'view')
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def set_operations(spark, sf_dir) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    a, b = (bars.where(F.col("symbol") == s).select("ts").distinct() for s in ("click", "view"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "all": a.unionByName(b)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "g2_distinct_keep_best",
    "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def keep_best(spark, sf_dir) -> DataFrame:
    """One row per key: the best, as an aggregate, which unlike a window combines before it shuffles."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    best = orders.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), F.round("b.o_totalprice", 2).alias("best"))


@query(
    "h1_tick_ema",
    f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks), e AS (
      SELECT symbol, seq, k, price AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.seq, n.k, e.ema + 0.05 * (n.price - e.ema) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
    SELECT symbol, seq, round(ema, 6) AS ema FROM e""",
)
def tick_ema(spark, sf_dir) -> DataFrame:
    """H1: exponential mean over all ticks of a symbol, its days worked on side by side."""
    made = block_ema(ticks(spark, sf_dir), ["symbol"], "trading_date", ["ts", "seq"], "price", 0.05, "ema")
    return rounded(made.select("symbol", "seq", "ema"))
