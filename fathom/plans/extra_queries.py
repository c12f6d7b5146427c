"""Book VWAP, cross-asset horizons, alignment, sampling, coefficient and grid reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.windows import Series, ratio
from fathom.operators import clean, joins
from fathom.operators import labels as L
from fathom.operators import moments as M
from fathom.operators import performance as P
from fathom.operators.frames import hourly_bars, quotes, ticks
from fathom.plans.model_queries import MATRIX, RESULTS, WIDE, _matrix, _results
from fathom.plans.registry import BARS, ORACLE_SQL, QUOTES, W, div, query, roll, rounded
from fathom.sources import writers

S = Series()

BOOK = "CASE WHEN {q} > 0 AND {q}_v > 0 THEN {x} ELSE 0 END"
BOOK_PV = " + ".join(BOOK.format(q=q, x=f"{q} * {q}_v") for q in ("b1", "a1"))
BOOK_V = " + ".join(BOOK.format(q=q, x=f"{q}_v") for q in ("b1", "a1"))


@query(
    "e2_book_vwap",
    f"""WITH {QUOTES}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, (ts, seq)) AS close, sum({BOOK_PV}) AS pv, sum({BOOK_V}) AS v FROM quotes GROUP BY 1, date_trunc('hour', ts)),
    d AS (SELECT *, row_number() OVER {W()} - 1 AS rn, sum(pv) OVER q / nullif((sum(v) OVER q)::DOUBLE, 0) AS bvwap FROM h WINDOW q AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts))
    SELECT symbol, ts, round(bvwap, 6) AS bvwap, round({div(f"close - ({roll('avg', 'bvwap', 20)})", roll('avg', 'bvwap', 20))}, 6) AS bvwap_dev,
      round(CASE WHEN count(bvwap) OVER {W(5)} >= 5 THEN regr_slope(bvwap, rn) OVER {W(5)} END, 6) AS bvwap_slope FROM d""",
)
def book_vwap(spark, sf_dir) -> DataFrame:
    """Mean quote price of the day so far, weighted by queues; its distance from the close and its slope."""
    there = lambda q, x: F.when((F.col(q) > 0) & (F.col(f"{q}_v") > 0), x).otherwise(0)
    hours = quotes(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"),
        F.sum(sum(there(q, F.col(q) * F.col(f"{q}_v")) for q in ("b1", "a1"))).alias("pv"),
        F.sum(sum(there(q, F.col(f"{q}_v")) for q in ("b1", "a1"))).alias("v"),
    )
    hours = hours.withColumnRenamed("bar", "ts").withColumn("day", F.to_date("ts"))
    day = Series(("symbol", "day"))
    made = hours.withColumn("bvwap", ratio(day.cumsum("pv"), day.cumsum("v"))).withColumn("rn", S.rn())
    mean = S.mean("bvwap", 20)
    return rounded(made.select("symbol", "ts", "bvwap", ratio(F.col("close") - mean, mean).alias("bvwap_dev"), S.slope("bvwap", 5).alias("bvwap_slope")))


HORIZONS = (1, 2, 4, 6, 8, 12, 20)


@query(
    "e6_cross_asset_horizons",
    f"""WITH {BARS}, a AS (SELECT ts, close FROM bars WHERE symbol = 'click'), b AS (SELECT ts, close FROM bars WHERE symbol = 'view')
    SELECT a.ts, {', '.join(f"round(a.close / nullif(a{h}.close, 0) - 1, 6) AS own_ret_{h}, round(b0.close / nullif(b{h}.close, 0) - 1, 6) AS other_ret_{h}, round((b0.close / nullif(b{h}.close, 0) - 1) - (a.close / nullif(a{h}.close, 0) - 1), 6) AS spread_{h}" for h in HORIZONS)}
    FROM a ASOF LEFT JOIN b b0 ON a.ts >= b0.ts {' '.join(f"ASOF LEFT JOIN a a{h} ON a.ts - INTERVAL {h} HOURS >= a{h}.ts ASOF LEFT JOIN b b{h} ON a.ts - INTERVAL {h} HOURS >= b{h}.ts" for h in HORIZONS)}""",
)
def horizons(spark, sf_dir) -> DataFrame:
    """Own and other return over seven horizons, and their spread."""
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", "close")
    own, other = bars.where("symbol = 'click'"), bars.where("symbol = 'view'").withColumn("symbol", F.lit("click"))
    made = joins.asof_offsets(joins.asof_offsets(own, own, ["symbol"], "close", HORIZONS, prefix="own"), other, ["symbol"], "close", (0, *HORIZONS), prefix="other")
    out = []
    for h in HORIZONS:
        ours, theirs = ratio("close", f"own_{h}") - 1, ratio("other_0", f"other_{h}") - 1
        out += [ours.alias(f"own_ret_{h}"), theirs.alias(f"other_ret_{h}"), (theirs - ours).alias(f"spread_{h}")]
    return rounded(made.select("ts", *out))


@query(
    "c8_attached_session_returns",
    f"""WITH {BARS}, m AS (SELECT *, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ticks WHERE symbol = 'view'), r AS (SELECT trading_date AS d,
      CASE WHEN count(*) FILTER (m >= 690 AND m < 810) >= 2 THEN arg_max(price, (ts, seq)) FILTER (m >= 690 AND m < 810) / nullif(arg_min(price, (ts, seq)) FILTER (m >= 690 AND m < 810), 0) - 1 END AS midday,
      CASE WHEN count(*) FILTER (m >= 900 AND m < 1080) >= 2 THEN arg_max(price, (ts, seq)) FILTER (m >= 900 AND m < 1080) / nullif(arg_min(price, (ts, seq)) FILTER (m >= 900 AND m < 1080), 0) - 1 END AS afternoon FROM m GROUP BY 1),
    e AS (SELECT ts + INTERVAL 1 HOUR AS bar_end FROM bars WHERE symbol = 'click'), t AS (SELECT bar_end, CAST(bar_end AS DATE) AS day, extract(hour FROM bar_end) * 60 + extract(minute FROM bar_end) AS m FROM e)
    SELECT t.bar_end, round(CASE WHEN m BETWEEN 810 AND 895 THEN same.midday END, 6) AS midday, round(CASE WHEN m >= 1260 THEN same.afternoon WHEN m <= 695 THEN before.afternoon END, 6) AS afternoon
    FROM t LEFT JOIN r same ON same.d = t.day ASOF LEFT JOIN r before ON t.day > before.d""",
)
def attached(spark, sf_dir) -> DataFrame:
    """Another series' session returns at bar ends: midday's after lunch, the afternoon's at night and next morning."""
    minute = lambda c: F.hour(c) * 60 + F.minute(c)
    df = ticks(spark, sf_dir).where("symbol = 'view'").withColumn("m", minute("ts"))

    def part(a: int, b: int):
        inside = (F.col("m") >= a) & (F.col("m") < b)
        at = F.when(inside, F.struct("ts", "seq"))
        return F.when(F.count(F.when(inside, 1)) >= 2, ratio(F.max_by("price", at), F.min_by("price", at)) - 1)

    days = df.groupBy(F.col("trading_date").alias("day")).agg(part(690, 810).alias("midday"), part(900, 1080).alias("afternoon"))
    ends = hourly_bars(spark, sf_dir).where("symbol = 'click'").select((F.col("ts") + F.expr("interval 1 hour")).alias("bar_end"))
    ends = ends.withColumns({"day": F.to_date("bar_end"), "m": minute("bar_end"), "all": F.lit(0)})
    before = days.select("day", F.col("afternoon").alias("previous"), F.lit(0).alias("all"))
    made = joins.asof_backward(ends.join(days, "day", "left"), before, ["all"], ts="day", columns=["previous"], strict=True)
    midday = F.when(F.col("m").between(810, 895), F.col("midday"))
    afternoon = F.when(F.col("m") >= 1260, F.col("afternoon")).when(F.col("m") <= 695, F.col("previous"))
    return rounded(made.select("bar_end", midday.alias("midday"), afternoon.alias("afternoon")))


@query("c10_aligned_concat", f"WITH {BARS}, a AS (SELECT ts, close AS click FROM bars WHERE symbol = 'click'), b AS (SELECT ts, close AS view FROM bars WHERE symbol = 'view') SELECT ts, click, view FROM a FULL JOIN b USING (ts)")
def aligned(spark, sf_dir) -> DataFrame:
    """Columns of two series side by side, on every time that either has."""
    bars = hourly_bars(spark, sf_dir)
    return joins.aligned([bars.where(F.col("symbol") == s).select("ts", F.col("close").alias(s)) for s in ("click", "view")], ["ts"])


@query("c11_reindexed", f"WITH {BARS}, a AS (SELECT ts FROM bars WHERE symbol = 'click'), b AS (SELECT ts, delta FROM bars WHERE symbol = 'signup') SELECT ts, coalesce(delta, 0) AS delta FROM a LEFT JOIN b USING (ts)")
def reindexed(spark, sf_dir) -> DataFrame:
    """C11: one series on the times of another, 0 where it has none."""
    bars = hourly_bars(spark, sf_dir)
    return joins.reindexed(bars.where("symbol = 'signup'").select("ts", "delta"), bars.where("symbol = 'click'").select("ts"), ["ts"], {"delta": 0})


@query("f9_every_kth_bar", f"WITH {BARS} SELECT symbol, ts, close FROM bars QUALIFY (row_number() OVER {W()} - 1) % 7 = 0")
def every_kth(spark, sf_dir) -> DataFrame:
    """every seventh bar of a symbol."""
    return hourly_bars(spark, sf_dir).withColumn("rn", S.rn()).where("rn % 7 = 0").select("symbol", "ts", "close")


@query(
    "l14_coefficients",
    f"""WITH {WIDE}, s AS (SELECT avg(ret) AS mr, avg(cp) AS mc, avg(label) AS ml FROM full_rows), g AS (SELECT sum((ret - mr) * (ret - mr)) AS a, sum((ret - mr) * (cp - mc)) AS b, sum((cp - mc) * (cp - mc)) AS d, sum((ret - mr) * (label - ml)) AS p, sum((cp - mc) * (label - ml)) AS q FROM full_rows, s),
    k AS (SELECT 'ret' AS factor, (d * p - b * q) / (a * d - b * b) AS coefficient FROM g UNION ALL SELECT 'cp', (a * q - b * p) / (a * d - b * b) FROM g) SELECT factor, round(coefficient, 6) AS coefficient, CAST(row_number() OVER (ORDER BY abs(coefficient) DESC) AS INT) AS place FROM k""",
)
def coefficients(spark, sf_dir) -> DataFrame:
    """Coefficients of a linear model by size."""
    rows = _matrix(spark, sf_dir).withColumn("cp", F.col("close_position") - 0.5)
    found = L.coefficients(rows, ["ret", "cp"], "label")
    ranked = sorted(found.items(), key=lambda kv: -abs(kv[1]))
    return rounded(spark.createDataFrame([(f, c, k + 1) for k, (f, c) in enumerate(ranked)], "factor string, coefficient double, place int"))


GRID = ((150, 50), (150, 100), (200, 50), (200, 100))


def _grid_sql() -> str:
    out = []
    for train, every in GRID:
        out.append(f"""(WITH f AS (SELECT symbol, total, unnest(range({train}, total, {every})) AS begin FROM t),
      c AS (SELECT f.symbol, f.begin, any_value(least(f.begin + {every}, f.total)) AS fin, regr_slope(label, ret) AS b, regr_intercept(label, ret) AS a, count(*) AS n FROM f JOIN g ON g.symbol = f.symbol AND g.rn >= greatest(f.begin - 8 - {train}, 0) AND g.rn < f.begin - 8 WHERE ret IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50)
      SELECT {train} AS train, {every} AS every, count(*) AS rows, round(avg((label - a - b * ret) ** 2), 6) AS error FROM g JOIN c ON g.symbol = c.symbol AND g.rn >= c.begin AND g.rn < c.fin WHERE ret IS NOT NULL AND label IS NOT NULL)""")
    return f"WITH {MATRIX}, g AS (SELECT symbol, ts, rn, ret, label FROM x), t AS (SELECT symbol, max(rn) + 1 AS total FROM g GROUP BY 1) " + " UNION ALL ".join(out)


@query("i22_walk_forward_grid", _grid_sql())
def grid(spark, sf_dir) -> DataFrame:
    """Out-of-sample error of every combination of a grid, each over its own folds."""
    rows = _matrix(spark, sf_dir)
    made = M.walk_forward_grid(rows, ["symbol"], "ts", ["ret"], "label", GRID, 3)
    both = made.join(rows.select("symbol", "ts", "label"), ["symbol", "ts"]).where("prediction is not null and label is not null")
    errors = both.groupBy("train", "every").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("label") - F.col("prediction")) ** 2), 6).alias("error"))
    every = spark.createDataFrame(list(GRID), "train int, every int")
    return every.join(errors, ["train", "every"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query(
    "a19_equity_data",
    f"WITH {RESULTS} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(arg_max(cumulative_value, ts), 6) AS equity, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 'in' ELSE 'out' END AS part FROM rr GROUP BY symbol, CAST(ts AS DATE)",
)
def equity_curve(spark, sf_dir) -> DataFrame:
    """What an equity plot shows, with the part of the sample that each day is in."""
    made = writers.equity_data(_results(spark, sf_dir), ("symbol",), "2024-01-16")
    return rounded(made.select("symbol", F.col("date").cast("string").alias("date"), "equity", "part"))


SWITCH = "(hour(ts) = 9 AND day(ts) % 5 = 0)"


@query(
    "l1_days_without_switch",
    f"""WITH {RESULTS} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(strategy_return), 6) AS r, round(sum(actual_return), 6) AS b, bool_or(held <> 0) AS active, CAST(sum(traded) AS BIGINT) AS trades
    FROM rr GROUP BY symbol, CAST(ts AS DATE) HAVING NOT bool_or({SWITCH})""",
)
def days_without_switch(spark, sf_dir) -> DataFrame:
    """L1: daily sums, days on which the contract changes left out."""
    switched = _results(spark, sf_dir).withColumn("is_switch", (F.hour("ts") == 9) & (F.day("ts") % 5 == 0))
    days = P.daily(switched, ["symbol"], switch="is_switch")
    return rounded(days.select("symbol", F.col("date").cast("string").alias("date"), "r", "b", "active", "trades"))


@query(
    "l13_segment_metrics",
    ORACLE_SQL["l2_daily_metrics"].replace("), e AS (", "), dd AS (SELECT symbol || ' ' || CASE WHEN date < DATE '2024-01-16' THEN 'in' ELSE 'out' END AS symbol, * EXCLUDE (symbol) FROM d), e AS (", 1).replace("AS equity FROM d)", "AS equity FROM dd)"),
)
def segment_metrics(spark, sf_dir) -> DataFrame:
    """Every metric of in-sample and out-of-sample days on their own."""
    days = P.daily(_results(spark, sf_dir), ["symbol"])
    part = F.when(F.col("date") < F.lit("2024-01-16").cast("date"), "in").otherwise("out")
    return rounded(P.metrics(days.withColumn("symbol", F.concat_ws(" ", "symbol", part)), ["symbol"]))


@query("b2_prefixed_columns", f"WITH {BARS} SELECT symbol, ts, open AS y_open, close AS y_close, high AS x_high, low AS x_low, volume AS x_volume, n_ticks AS x_n_ticks, buy_vol AS x_buy_vol, sell_vol AS x_sell_vol, delta AS x_delta FROM bars")
def prefixed_columns(spark, sf_dir) -> DataFrame:
    """Prices as y_ columns, everything else as x_ columns, columns of one kind dropped by name."""
    bars = hourly_bars(spark, sf_dir).drop("trading_date")
    return clean.drop_matching(clean.prefixed(bars, {"open": "y_open", "close": "y_close"}, keep=("symbol", "ts")), "vwap")
