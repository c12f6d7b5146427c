"""Scan, label, model, selection, ensemble and metric queries over hourly bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.factors import add_factors
from fathom.functions.windows import Series, correlation, finite, ratio
from fathom.operators import boosting as T
from fathom.operators import labels as L
from fathom.operators import moments as M
from fathom.operators import performance as P
from fathom.operators import recurrent as G
from fathom.operators import scan as X
from fathom.operators import selection as C
from fathom.operators import shapley as H
from fathom.operators.frames import hourly_bars
from fathom.plans.registry import BARS, TICKS, W, both, div, lag, query, ret, roll, rounded
from fathom.plans.tick_queries import PHI

S = Series()

# --- sequential scans


@query(
    "h1_ema_and_rsi",
    f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, ts, close, row_number() OVER {W()} AS k, close - {lag('close')} AS d FROM bars), s AS (
      SELECT symbol, avg(greatest(d, 0)) AS u, avg(greatest(-d, 0)) AS v FROM n WHERE k BETWEEN 2 AND 15 GROUP BY 1), e AS (
      SELECT symbol, ts, k, close::DOUBLE AS ema, NULL::DOUBLE AS u, NULL::DOUBLE AS v FROM n WHERE k = 1
      UNION ALL SELECT n.symbol, n.ts, n.k, e.ema + 2.0 / 15 * (n.close - e.ema),
        CASE WHEN n.k = 15 THEN s.u WHEN n.k > 15 THEN e.u + (greatest(n.d, 0) - e.u) / 14 END, CASE WHEN n.k = 15 THEN s.v WHEN n.k > 15 THEN e.v + (greatest(-n.d, 0) - e.v) / 14 END
      FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1 JOIN s ON s.symbol = n.symbol)
    SELECT symbol, ts, round(ema, 6) AS ema14, round(100 * u / nullif(u + v, 0), 6) AS rsi14 FROM e""",
)
def ema_and_rsi(spark, sf_dir) -> DataFrame:
    """H1, H4: an unadjusted exponential mean and a Wilder index in one scan."""
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", "close")
    made = X.ordered_scan(bars, ["symbol"], ["ts"], {"ema14": (lambda: X.ema(X.span(14)), ["close"]), "rsi14": (X.rsi, ["close"])})
    return rounded(made.drop("close"))


@query("h4_recursive_indicators")
def recursive_indicators(spark, sf_dir) -> DataFrame:
    """Every recursive indicator of the catalogue, in one scan per symbol."""
    bars = add_factors(hourly_bars(spark, sf_dir), ["lret", "clv_vol", "ad_line", "ad_raw", "lr_log", "signed_vol"])
    bars = bars.withColumns({"flow13": ratio("signed_vol", S.sum("volume", 13)), "lret": finite("lret")})
    hlc = ["high", "low", "close"]
    made = X.ordered_scan(
        bars.select("symbol", "ts", *hlc, "volume", "delta", "lret", "ad_line", "ad_raw", "lr_log", "flow13"),
        ["symbol"],
        ["ts"],
        {
            "ema20_adjusted": (lambda: X.ema(X.span(20), True), ["close"]),
            "ewma_var": (lambda: X.ewma_variance(20), ["lret"]),
            "atr14": (X.atr, hlc),
            "adx14": (X.adx, hlc),
            "macd": (lambda: X.macd(part="macd"), ["close"]),
            "macd_signal": (lambda: X.macd(part="signal"), ["close"]),
            "macd_hist": (X.macd, ["close"]),
            "trix14": (X.trix, ["close"]),
            "sar": (X.parabolic_sar, ["high", "low"]),
            "ad_ema3": (lambda: X.ema(X.span(3)), ["ad_line"]),
            "ad_ema10": (lambda: X.ema(X.span(10)), ["ad_line"]),
            "ad_factor": (lambda: X.ema(X.span(14)), ["ad_raw"]),
            "linearreg_ma": (lambda: X.ema(X.span(14)), ["lr_log"]),
            "klinger34": (lambda: X.ema(X.span(34)), ["flow13"]),
            "klinger55": (lambda: X.ema(X.span(55)), ["flow13"]),
            "vpin": (X.vpin, ["close", "volume"]),
        },
    )
    made = made.withColumns({
        "chaikin": F.col("ad_ema3") - F.col("ad_ema10"),
        "klinger": F.col("klinger34") - F.col("klinger55"),
        "keltner": ratio(F.col("close") - (F.col("ema20_adjusted") - 2 * F.col("atr14")), 4 * F.col("atr14")),
        "sar_diff": F.col("close") - F.col("sar"),
        "vpin_z": (F.col("vpin") - S.mean("vpin", 20)) / F.greatest(S.std("vpin", 20), F.lit(1e-9)),
    })
    made = made.withColumn("vpin_filtered", F.when(F.col("vpin_z") >= 2, F.col("vpin_z")).otherwise(0.0)).withColumn("delta_x_vpin", F.col("delta") * F.col("vpin"))
    return rounded(made.drop(*hlc, "volume", "delta", "lret", "ad_line", "ad_raw", "lr_log", "flow13"))


def _predictions(spark, sf_dir) -> DataFrame:
    """A momentum signal per bar: the five-bar z-score of the close."""
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("price"))
    return bars.withColumn("prediction", F.round(ratio(F.col("price") - S.mean("price", 5), S.std("price", 5)), 6)).withColumn("level", S.quantile(F.abs("prediction"), 50, 0.7, 30))


Z = f"coalesce(last_value(cz IGNORE NULLS) OVER {W()}, 0)"
PREDICTIONS = f"""{BARS}, z AS (SELECT symbol, ts, close AS price, round({div('close - (' + roll('avg', 'close', 5) + ')', roll('stddev_samp', 'close', 5))}, 6) AS prediction FROM bars), p0 AS (
  SELECT *, row_number() OVER {W()} AS k, {roll('quantile_cont(abs($), 0.7)', 'prediction', 50, 30)} AS level,
  {div('prediction - (' + roll('avg', 'prediction', 20, 2) + ')', roll('stddev_samp', 'prediction', 20, 2))} AS cz FROM z), p AS (SELECT *, {Z} AS zs FROM p0)"""


def _machine(over: str, entry: str = "true", expired: str = "false") -> str:
    """Recursive twin of the position scan: ``over`` ends flat, ``expired`` may open again at once."""
    opened = f"CASE WHEN p.prediction > 0 AND {entry} THEN 1 WHEN p.prediction < 0 AND {entry} THEN -1 ELSE 0 END"
    going = f"m.pos <> 0 AND NOT ({expired})"
    return f"""WITH RECURSIVE {PREDICTIONS}, m AS (
      SELECT p.symbol, p.ts, p.k, 0 AS held, {opened} AS pos, p.price AS paid FROM p WHERE k = 1
      UNION ALL SELECT p.symbol, p.ts, p.k, CASE WHEN {going} THEN m.held + 1 ELSE 0 END, CASE WHEN {going} THEN CASE WHEN {over} THEN 0 ELSE m.pos END ELSE {opened} END, CASE WHEN {going} THEN m.paid ELSE p.price END
      FROM m JOIN p ON p.symbol = m.symbol AND p.k = m.k + 1) SELECT symbol, ts, pos AS position FROM m"""


CROSS = "coalesce(CASE WHEN m.pos > 0 THEN p.prediction <= 0 ELSE p.prediction >= 0 END, false)"


def _positions(spark, sf_dir, level: str | None = None, **how) -> DataFrame:
    df = _predictions(spark, sf_dir).withColumn("entry", F.lit(0.0) if level is None else F.col(level))
    df = df.withColumn("cz", S.zscore("prediction", 20, 2)).withColumn("cz", F.coalesce(S.ffill("cz"), F.lit(0.0)))
    made = X.ordered_scan(df, ["symbol"], ["ts"], {"position": (lambda: X.position(**how), ["prediction", "entry", "price", "cz"])})
    return made.select("symbol", "ts", F.col("position").cast("int").alias("position"))


@query("h8_position_threshold", _machine(CROSS))
def position_threshold(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir)


@query("h8_position_fixed", _machine("false", expired="m.held + 1 >= 3"))
def position_fixed(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir, mode="fixed", forward=3)


@query("h8_position_hybrid", _machine(CROSS, expired="m.held + 1 >= 4"))
def position_hybrid(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir, mode="hybrid", forward=4)


@query("h8_position_zscore", _machine("CASE WHEN m.pos > 0 THEN p.zs <= 0.2 ELSE p.zs >= -0.2 END"))
def position_zscore(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir, mode="zscore_threshold", zscore=0.2)


@query("h10_position_zscore_hybrid", _machine("CASE WHEN m.pos > 0 THEN p.zs <= -0.5 ELSE p.zs >= 0.5 END", expired="m.held + 1 >= 6"))
def position_zscore_hybrid(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir, mode="zscore_hybrid", zscore=0.5, mirrored=True, forward=6)


@query("h9_position_strength", _machine(CROSS, "coalesce(abs(p.prediction) >= p.level, false)"))
def position_strength(spark, sf_dir) -> DataFrame:
    """Entries only where the prediction is among the strongest 30 % of late."""
    return _positions(spark, sf_dir, level="level")


@query("h11_position_stop", _machine(f"{CROSS} OR m.pos * (p.price - m.paid) <= -20"))
def position_stop(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir, stop=20.0)


def _results(spark, sf_dir) -> DataFrame:
    """Results of a signal that needs no scan: the sign of the last bar's body."""
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("price"), F.signum(F.col("close") - F.col("open")).alias("position"))
    # Prices here jump by orders of magnitude; the lift keeps returns of one size.
    return P.results(bars.withColumn("price", F.col("price") + 1000), S)


RESULTS = f"""{BARS}, q AS (SELECT symbol, ts, close + 1000 AS price, sign(close - open)::DOUBLE AS position FROM bars), h AS (
  SELECT *, coalesce({lag('position')}, 0) AS held, coalesce(price / {lag('price')} - 1, 0) AS actual_return FROM q), r AS (
  SELECT *, held * actual_return AS strategy_return, CAST(held <> coalesce({lag('held')}, 0) AS INT) AS traded FROM h), rr AS (
  SELECT *, 1 + sum(strategy_return) OVER {W()} AS cumulative_value FROM r)"""


@query(
    "h12_cash_account",
    f"""WITH {RESULTS}, g AS (SELECT *, coalesce(held * (price - {lag('price')}) * 10, 0) AS gross, CASE WHEN (coalesce({lag('held')}, 0) = 0) <> (held = 0) THEN 3.5 ELSE 0 END AS fee FROM rr)
    SELECT symbol, ts, round(gross, 4) AS gross, round(fee::DOUBLE, 4) AS fee, round(3000 + sum(gross - fee) OVER {W()}, 4) AS equity FROM g""",
)
def cash(spark, sf_dir) -> DataFrame:
    return rounded(P.cash_account(_results(spark, sf_dir), S).select("symbol", "ts", "gross", "fee", "equity"), 4)


@query(
    "h14_equity_and_drawdown",
    f"""WITH {RESULTS} SELECT symbol, ts, round(cumulative_value, 6) AS equity, round(cumulative_value / max(cumulative_value) OVER {W()} - 1, 6) AS drawdown,
      round(exp(sum(ln(1 + strategy_return)) OVER {W()}), 6) AS compounded FROM rr""",
)
def equity(spark, sf_dir) -> DataFrame:
    df = _results(spark, sf_dir)
    return rounded(df.select("symbol", "ts", F.col("cumulative_value").alias("equity"), (F.col("cumulative_value") / F.max("cumulative_value").over(S.so_far) - 1).alias("drawdown"), S.cumprod1("strategy_return").alias("compounded")))


# --- labels and models


def _fwd(k: int) -> str:
    return f"(lead(close, {k}) OVER {W()} / close - 1)"


@query(
    "i1_forward_labels",
    f"""WITH {BARS}, f AS (SELECT *, {', '.join(f'{_fwd(3 + k)} AS r{k}' for k in range(4))}, close / {lag('close')} - 1 AS r FROM bars)
    SELECT symbol, ts, round(CASE WHEN r0 IS NULL THEN NULL {' '.join(f'WHEN sign(r{k}) = -sign(r0) AND r0 <> 0 AND abs(r{k}) > 2 * abs(r0) THEN r{k}' for k in (1, 2, 3))} ELSE r0 END, 6) AS label,
      round(lead(close, 3) OVER {W()} - close, 6) AS points,
      round(CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) >= 4 THEN sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END, 6) AS next_sum,
      round(lead(open, 4) OVER {W()} / lead(open, 1) OVER {W()} - 1, 6) AS open_label FROM f""",
)
def forward_labels(spark, sf_dir) -> DataFrame:
    """Reversal-checked forward return, points, forward sum and open-to-open return."""
    bars = add_factors(hourly_bars(spark, sf_dir), ["ret"])
    return rounded(
        bars.select(
            "symbol", "ts", L.forward_return(S, "close", 3, 3).alias("label"), L.forward_return(S, "close", 3, points=True).alias("points"), L.forward_sum(S, "ret", 4).alias("next_sum"), (ratio(S.lead("open", 4), S.lead("open", 1)) - 1).alias("open_label")
        )
    )


def _matrix(spark, sf_dir) -> DataFrame:
    """Factors and a label per bar, over prices lifted so that returns are of one size."""
    bars = hourly_bars(spark, sf_dir)
    lifted = bars.withColumns({c: F.col(c) + 100 for c in ("open", "high", "low", "close")})
    made = add_factors(lifted, ["ret", "rel_vol", "close_position", "delta_z"])
    return made.withColumn("label", L.forward_return(S, "close", 3)).select("symbol", "ts", "ret", "rel_vol", "close_position", "delta_z", "label", F.col("close").alias("price"))


@query(
    "i5_walk_forward_ols",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, row_number() OVER {W()} - 1 AS rn, (close + 100) / ({lag('close')} + 100) - 1 AS ret, (lead(close, 3) OVER {W()} + 100) / (close + 100) - 1 AS label FROM bars),
    t AS (SELECT symbol, max(rn) + 1 AS total FROM x GROUP BY 1), f AS (SELECT symbol, total, unnest(range(200, total, 50)) AS begin FROM t),
    c AS (SELECT f.symbol, f.begin, any_value(least(f.begin + 50, f.total)) AS fin, regr_slope(label, ret) AS b, regr_intercept(label, ret) AS a FROM f JOIN x ON x.symbol = f.symbol AND x.rn >= greatest(f.begin - 208, 0) AND x.rn < f.begin - 8 WHERE ret IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
    SELECT x.symbol, x.ts, CAST((c.begin - 200) // 50 AS INT) AS fold, round(a + b * ret, 6) AS prediction FROM x JOIN c ON x.symbol = c.symbol AND x.rn >= c.begin AND x.rn < c.fin""",
)
def walk_forward_ols(spark, sf_dir) -> DataFrame:
    made = L.walk_forward(_matrix(spark, sf_dir), ["symbol"], "ts", ["ret"], "label", 200, 50, 3)
    return made.withColumn("prediction", F.round("prediction", 6))


@query(
    "i5_expanding_ols",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, row_number() OVER {W()} - 1 AS rn, (close + 100) / ({lag('close')} + 100) - 1 AS ret, (lead(close, 3) OVER {W()} + 100) / (close + 100) - 1 AS label FROM bars),
    t AS (SELECT symbol, max(rn) + 1 AS total FROM x GROUP BY 1), f AS (SELECT symbol, total, unnest(range(200, total, 50)) AS begin FROM t),
    c AS (SELECT f.symbol, f.begin, any_value(least(f.begin + 50, f.total)) AS fin, regr_slope(label, ret) AS b, regr_intercept(label, ret) AS a FROM f JOIN x ON x.symbol = f.symbol AND x.rn < f.begin - 8 WHERE ret IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
    SELECT x.symbol, x.ts, CAST((c.begin - 200) // 50 AS INT) AS fold, round(a + b * ret, 6) AS prediction FROM x JOIN c ON x.symbol = c.symbol AND x.rn >= c.begin AND x.rn < c.fin""",
)
def expanding_ols(spark, sf_dir) -> DataFrame:
    """Every refit on all rows before it, from running sums of products."""
    made = M.walk_forward_grid(_matrix(spark, sf_dir), ["symbol"], "ts", ["ret"], "label", [(200, 50)], 3, rolling=False)
    return rounded(made.select("symbol", "ts", "fold", "prediction"))


@query("i11_walk_forward_models")
def walk_forward_models(spark, sf_dir) -> DataFrame:
    """Every linear model of the dispatcher over the same folds."""
    rows, out = _matrix(spark, sf_dir), None
    for name in L.MODELS:
        made = L.walk_forward(rows, ["symbol"], "ts", ["ret", "rel_vol", "close_position", "delta_z"], "label", 200, 100, 3, model=name)
        made = made.select(F.lit(name).alias("model"), "symbol", "ts", F.round("prediction", 5).alias("prediction"))
        out = made if out is None else out.unionByName(made)
    return out


@query(
    "i8_purged_folds",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, row_number() OVER {W()} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, n // 3 AS len, least(rn // (n // 3), 2) AS fold FROM x)
    SELECT symbol, ts, CASE WHEN rn - fold * len >= 3 THEN CAST(fold AS BIGINT) END AS fold FROM f""",
)
def folds(spark, sf_dir) -> DataFrame:
    bars = hourly_bars(spark, sf_dir).withColumns({"rn": S.rn(), "n": F.count("*").over(Window.partitionBy("symbol"))})
    return bars.select("symbol", "ts", L.purged_fold(F.col("rn"), F.col("n"), 3, 3).cast("long").alias("fold"))


@query(
    "i17_sequences",
    f"""WITH {BARS}, y AS (SELECT symbol, ts, (close + 100) / ({lag('close')} + 100) - 1 AS ret, {div('volume', roll('avg', 'volume', 20))} AS rel_vol, {div('close - low', 'high - low')} AS close_position, (lead(close, 3) OVER {W()} + 100) / (close + 100) - 1 AS label FROM bars),
    full_rows AS (SELECT symbol, ts, ret + rel_vol + close_position AS s FROM y WHERE ret IS NOT NULL AND rel_vol IS NOT NULL AND close_position IS NOT NULL AND label IS NOT NULL)
    SELECT symbol, ts, 10 AS length, round(sum(s) OVER {W(10)}, 6) AS total FROM full_rows QUALIFY count(*) OVER {W(10)} = 10""",
)
def sequence_rows(spark, sf_dir) -> DataFrame:
    """The sequence builder that recurrent models read: ten factor rows for each bar."""
    made = L.sequences(_matrix(spark, sf_dir).dropna(), S, ["ret", "rel_vol", "close_position"], 10)
    return made.select("symbol", "ts", F.size("sequence").alias("length"), F.round(F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- information coefficients and selection


MATRIX = f"""{BARS}, x AS (SELECT symbol, ts, row_number() OVER {W()} - 1 AS rn, (close + 100) / ({lag('close')} + 100) - 1 AS ret, {div('volume', roll('avg', 'volume', 20))} AS rel_vol, {div('close - low', 'high - low')} AS close_position,
  (lead(close, 3) OVER {W()} + 100) / (close + 100) - 1 AS label FROM bars)"""
FACTOR_NAMES = ("ret", "rel_vol", "close_position")


@query(
    "j8_segment_icir",
    f"""WITH {MATRIX}, l AS (UNPIVOT (SELECT symbol, ts, rn // 100 AS segment, label, {', '.join(FACTOR_NAMES)} FROM x) ON {', '.join(FACTOR_NAMES)} INTO NAME factor VALUE value), k AS (SELECT * FROM l WHERE value IS NOT NULL AND label IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY symbol, factor, segment ORDER BY value) + (count(*) OVER (PARTITION BY symbol, factor, segment, value) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY symbol, factor, segment ORDER BY label) + (count(*) OVER (PARTITION BY symbol, factor, segment, label) - 1) / 2.0 AS b FROM k),
    i AS (SELECT symbol, factor, segment, corr(a, b) AS ic FROM r GROUP BY 1, 2, 3)
    SELECT factor, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(abs(ic)), 6) AS mean_abs_ic, round(CASE WHEN count(ic) >= 10 THEN abs(avg(ic)) / (stddev_samp(ic) + 1e-9) ELSE 0 END, 6) AS icir,
      round(avg(CASE WHEN abs(ic) > 0.02 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM i GROUP BY 1""",
)
def segment_icir(spark, sf_dir) -> DataFrame:
    """Spearman by 100-row segments, then the ranking of factors."""
    ics = C.segment_ic(_matrix(spark, sf_dir), ["symbol"], "ts", FACTOR_NAMES, "label", 100)
    return rounded(C.ic_summary(ics, ["factor"]))


def _rk(x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {W(n)} >= {n // 2} THEN list_sum(list_transform(list_filter(list({x}) OVER {W(n)}, lambda e: e IS NOT NULL), lambda e: CASE WHEN e < {x} THEN 1.0 WHEN e = {x} THEN 0.5 ELSE 0 END)) + 0.5 END"


@query(
    "j1_rolling_ic",
    f"""WITH {MATRIX}, k AS (SELECT symbol, ts, {_rk('ret', 40)} AS a, {_rk('label', 40)} AS b FROM x), c AS (SELECT symbol, ts, {both('corr', 'a', 'b', 40).replace('>= 40', '>= 20')} AS ic FROM k)
    SELECT symbol, ts, round(coalesce(CASE WHEN isnan(ic) THEN NULL ELSE ic END, 0), 6) AS ic_ret FROM c""",
)
def rolling_ic(spark, sf_dir) -> DataFrame:
    return rounded(C.rolling_ic(_matrix(spark, sf_dir).select("symbol", "ts", "ret", "label"), S, ["ret"], "label", 40).select("symbol", "ts", "ic_ret"))


N2 = 20
FRAME = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {N2} PRECEDING AND 1 PRECEDING)"


def _places(x: str) -> str:
    return f"list_transform(range(1, {N2 + 1}), lambda i: len(list_filter(range(1, {N2 + 1}), lambda j: {x}[j] < {x}[i] OR ({x}[j] = {x}[i] AND j < i))))"


@query(
    "j2_strict_rolling_ic",
    f"""WITH {MATRIX}, k AS (SELECT symbol, ts, list(ret) OVER {FRAME} AS f, list(label) OVER {FRAME} AS y, count(CASE WHEN ret IS NOT NULL AND label IS NOT NULL THEN 1 END) OVER {FRAME} AS n FROM x), g AS (SELECT * FROM k WHERE n = {N2}),
    r AS (SELECT symbol, ts, {_places('f')} AS a, {_places('y')} AS b FROM g)
    SELECT symbol, ts, round(1 - 6.0 * list_sum(list_transform(range(1, {N2 + 1}), lambda i: (a[i] - b[i]) * (a[i] - b[i]))) / ({N2} * ({N2} * {N2} - 1)), 6) AS ic FROM r""",
)
def strict_rolling_ic(spark, sf_dir) -> DataFrame:
    """Spearman over the rows before each row, ordinal ranks, the earlier of equals first."""
    made = C.strict_ic(_matrix(spark, sf_dir), S, "ret", "label", N2).where("ic is not null")
    return made.select("symbol", "ts", F.round("ic", 6).alias("ic"))


@query(
    "j6_factor_correlations",
    """WITH l AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS f, unnest(embedding) AS v FROM embeddings), c AS (SELECT a.f AS a, b.f AS b, corr(a.v::DOUBLE, b.v::DOUBLE) AS c FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.f < b.f GROUP BY 1, 2)
    SELECT CAST(f AS INT) AS factor, round(avg(abs(coalesce(c, 0))), 6) AS mean_abs_corr FROM (SELECT a AS f, c FROM c UNION ALL SELECT b, c FROM c) GROUP BY 1""",
)
def factor_correlations(spark, sf_dir) -> DataFrame:
    """Pairwise correlations of all factor columns, and each one's mean."""
    pairs = C.column_correlations(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"), "corr")
    both_ways = pairs.select(F.col("a").alias("factor"), "corr").unionByName(pairs.select(F.col("b").alias("factor"), "corr"))
    return both_ways.groupBy("factor").agg(F.round(F.avg(F.abs(F.coalesce("corr", F.lit(0.0)))), 6).alias("mean_abs_corr"))


@query(
    "j5_residual_factor",
    f"""WITH {MATRIX}, k AS (SELECT symbol, ts, ret, close_position - 0.5 AS c FROM x WHERE ret IS NOT NULL AND close_position IS NOT NULL)
    SELECT symbol, ts, round(ret - coalesce(sum(ret * c) OVER (PARTITION BY symbol) / nullif(sum(c * c) OVER (PARTITION BY symbol), 0), 0) * c, 6) AS residual FROM k""",
)
def residual_factor(spark, sf_dir) -> DataFrame:
    rows = _matrix(spark, sf_dir).where("ret is not null and close_position is not null").withColumn("c", F.col("close_position") - 0.5)
    return rounded(C.residual(rows, ["symbol"], "ret", "c").select("symbol", "ts", "residual"))


@query(
    "j5_residual_on_set",
    f"""WITH {MATRIX}, k AS (SELECT symbol, ts, ret AS y, close_position - 0.5 AS a, rel_vol AS b, ret IS NOT NULL AND close_position IS NOT NULL AND rel_vol IS NOT NULL AS whole FROM x),
    s AS (SELECT symbol, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM k WHERE whole GROUP BY symbol HAVING count(*) >= 100)
    SELECT k.symbol, ts, round(CASE WHEN aa IS NULL THEN y WHEN whole THEN y - (ay * bb - by_ * ab) / (aa * bb - ab * ab) * a - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * b END, 6) AS residual FROM k LEFT JOIN s ON k.symbol = s.symbol""",
)
def residual_on_set(spark, sf_dir) -> DataFrame:
    """A factor less its projection on a set of factors, symbols of under 100 complete rows as they are."""
    rows = _matrix(spark, sf_dir).withColumn("a", F.col("close_position") - 0.5)
    return rounded(C.residual_on(rows, ["symbol"], "ret", ["a", "rel_vol"]).select("symbol", "ts", "residual"))


@query("j12_cluster_picks")
def cluster_picks(spark, sf_dir) -> DataFrame:
    """Average-linkage clusters of the factor columns with their medoids and best candidates, weak ones dropped."""
    columns = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = C.column_correlations(columns, "embedding").collect()
    n = 1 + max((p.b for p in pairs), default=0)
    distance = np.zeros((n, n))
    for p in pairs:
        distance[p.a, p.b] = distance[p.b, p.a] = 1 - abs(p["corr"] or 0.0)
    own = C.linkage_clusters(distance, 12, method="average")
    each = columns.select(F.posexplode("embedding").alias("k", "v"), F.col("label").cast("double").alias("label")).groupBy("k").agg(F.abs(correlation("v", "label")).alias("c"))
    scores = {str(r.k): round(r.c or 0.0, 9) for r in each.collect()}  # one row a column
    middle = {c: m for c, _, m in C.medoids(distance, own)}
    picked = C.cluster_picks(scores, {str(k): c for k, c in enumerate(own)}, 3, 0.02)
    return rounded(spark.createDataFrame([(*row, middle[row[0]]) for row in picked], "cluster int, size int, top_factor string, best double, candidates string, medoid int"))


@query(
    "j19_strategy_correlations",
    f"""WITH {RESULTS}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(strategy_return) AS r FROM rr GROUP BY 1, 2),
    c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS c FROM d a JOIN d b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2)
    SELECT a, b, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS corr FROM c""",
)
def strategy_correlations(spark, sf_dir) -> DataFrame:
    """Correlation of the daily returns of strategies, pair by pair, over the days both have."""
    days = _results(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("strategy_return").alias("r"))
    a, b = (days.select(F.col("symbol").alias(s), "date", F.col("r").alias(f"r_{s}")) for s in "ab")
    return rounded(a.join(b, "date").where("a < b").groupBy("a", "b").agg(correlation("r_a", "r_b").alias("corr")))


@query(
    "j13_target_correlation",
    f"WITH {MATRIX}, l AS (UNPIVOT (SELECT symbol, label, {', '.join(FACTOR_NAMES)} FROM x) ON {', '.join(FACTOR_NAMES)} INTO NAME factor VALUE value), c AS (SELECT factor, corr(value, label) AS c FROM l GROUP BY 1) SELECT factor, round(c, 6) AS corr, coalesce(abs(c) >= 0.01, true) AS kept FROM c",
)
def target_correlation(spark, sf_dir) -> DataFrame:
    long = C.long_form(_matrix(spark, sf_dir), ["symbol", "label"], FACTOR_NAMES)
    made = long.groupBy("factor").agg(correlation("value", "label").alias("c"))
    return made.select("factor", F.round("c", 6).alias("corr"), F.coalesce(F.abs("c") >= 0.01, F.lit(True)).alias("kept"))


# --- ensembles and metrics


def _signals(spark, sf_dir) -> DataFrame:
    """Three models per bar in long form: momentum over 3, 8 and 21 bars, with fixed weights."""
    bars = hourly_bars(spark, sf_dir)
    out = None
    for model, n, weight in (("m3", 3, 0.8), ("m8", 8, 1.4), ("m21", 21, -0.2)):
        change = S.diff("close", n)
        one = bars.select("symbol", "ts", F.lit(model).alias("model"), change.alias("raw"), F.lit(weight).alias("weight"), F.signum(change).cast("int").alias("position"))
        out = one if out is None else out.unionByName(one)
    return out.where("raw is not null")


SIGNALS = f"""{BARS}, sg AS ({' UNION ALL '.join(f"SELECT symbol, ts, '{m}' AS model, close - {lag('close', n)} AS raw, {w} AS weight FROM bars" for m, n, w in (('m3', 3, 0.8), ('m8', 8, 1.4), ('m21', 21, -0.2)))}), sig AS (SELECT *, CAST(sign(raw) AS INT) AS position FROM sg WHERE raw IS NOT NULL)"""


@query(
    "k4_votes",
    f"""WITH {SIGNALS}, v AS (SELECT symbol, ts, count(*) AS models, count(*) FILTER (position = 1) AS longs, count(*) FILTER (position = -1) AS shorts,
      avg(position) AS mean, coalesce(sum(greatest(weight, 0) * position) / nullif(sum(greatest(weight, 0)), 0), avg(position)) AS score FROM sig GROUP BY 1, 2)
    SELECT symbol, ts, longs, shorts, CASE WHEN shorts >= ceil(models * 0.5) THEN -1 WHEN longs >= ceil(models * 0.5) THEN 1 ELSE 0 END AS majority, round(mean, 6) AS equal_weight,
      CASE WHEN score > 0.3 THEN 1 WHEN score < -0.3 THEN -1 ELSE 0 END AS weighted FROM v""",
)
def votes(spark, sf_dir) -> DataFrame:
    """K2-K5: equal weight, majority and weighted votes of three models."""
    signals, keys = _signals(spark, sf_dir), ["symbol", "ts"]
    majority = C.vote(signals, keys).select(*keys, "longs", "shorts", F.col("signal").alias("majority"))
    weighted = C.weighted_vote(signals, keys, "weight").select(*keys, F.col("signal").alias("weighted"))
    mean = signals.groupBy(*keys).agg(F.round(F.avg("position"), 6).alias("equal_weight"))
    return majority.join(weighted, keys).join(mean, keys)


@query(
    "k8_strength_positions",
    f"""WITH {BARS}, r AS (SELECT symbol, ts, delta, CASE WHEN count(delta) OVER {W(50)} >= 50 THEN (list_sum(list_transform(list(abs(delta)) OVER {W(50)}, lambda e: CASE WHEN e < abs(delta) THEN 1.0 WHEN e = abs(delta) THEN 0.5 ELSE 0 END)) + 0.5) / 50 END AS s FROM bars)
    SELECT symbol, ts, round(s, 6) AS strength, coalesce(CASE WHEN s >= 0.5 AND s <= 1 THEN 1.0 WHEN s >= 0.2 AND s < 0.5 THEN 0.7 ELSE 0 END * sign(delta), 0)::DOUBLE AS position FROM r""",
)
def strength_positions(spark, sf_dir) -> DataFrame:
    """F2, K7, K8: rolling percentile strength through a strength map."""
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", "delta", F.abs("delta").alias("size"))
    bars = X.ordered_scan(bars, ["symbol"], ["ts"], {"strength": (lambda: X.rolling_rank(50), ["size"])})
    position = C.strength_position(F.col("strength"), F.col("delta"), C.parse_strength_map("0.2-0.5:0.7,0.5-1:1"))
    return bars.select("symbol", "ts", F.round("strength", 6).alias("strength"), position.alias("position"))


@query(
    "k1_signal_zscore",
    f"WITH {BARS} SELECT symbol, ts, round((delta - ({roll('avg', 'delta', 500, 50)})) / greatest({roll('stddev_samp', 'delta', 500, 50)}, 1e-8), 6) AS z FROM bars",
)
def signal_zscore(spark, sf_dir) -> DataFrame:
    return rounded(hourly_bars(spark, sf_dir).select("symbol", "ts", C.signal_zscore(S, "delta").alias("z")))


DAYS = f"{RESULTS}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(strategy_return) AS r, sum(actual_return) AS b, bool_or(held <> 0) AS active, sum(traded) AS trades FROM rr GROUP BY 1, 2)"


@query(
    "l2_daily_metrics",
    f"""WITH {DAYS}, e AS (SELECT *, 1 + sum(r) OVER (PARTITION BY symbol ORDER BY date) AS equity FROM d), f AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date) - 1 AS fall FROM e), m AS (
      SELECT symbol, count(*) AS days, avg(r) * 252 AS annual_return, stddev_pop(r) * sqrt(252) AS annual_vol, min(fall) AS max_drawdown, avg(r) / nullif(stddev_pop(r) FILTER (r < 0), 0) * sqrt(252) AS sortino,
        count(*) FILTER (r > 0 AND active)::DOUBLE / nullif(count(*) FILTER (r <> 0 AND active), 0) AS win_rate, avg(r) FILTER (r > 0 AND active) / nullif(abs(avg(r) FILTER (r < 0 AND active)), 0) AS profit_loss,
        avg(b) * 252 AS benchmark_return, stddev_pop(b) * sqrt(252) AS bvol, stddev_pop(r - b) * sqrt(252) AS track, arg_max(equity, date) - 1 AS total_return, CAST(sum(trades) AS BIGINT) AS trade_count FROM f GROUP BY 1)
    SELECT symbol, days, round(annual_return, 6) AS annual_return, round(annual_vol, 6) AS annual_vol, round(coalesce(annual_return / nullif(annual_vol, 0), 0), 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown,
      round(annual_return / nullif(abs(max_drawdown), 0), 6) AS calmar, round(sortino, 6) AS sortino, round(win_rate, 6) AS win_rate, round(profit_loss, 6) AS profit_loss, round(benchmark_return, 6) AS benchmark_return,
      round(benchmark_return / nullif(bvol, 0), 6) AS benchmark_sharpe, round((annual_return - benchmark_return) / nullif(track, 0), 6) AS information_ratio, round(total_return, 6) AS total_return, trade_count FROM m""",
)
def daily_metrics(spark, sf_dir) -> DataFrame:
    """Daily sums of bar results and the metrics of each symbol."""
    return rounded(P.metrics(P.daily(_results(spark, sf_dir), ["symbol"]), ["symbol"]))


@query(
    "l13_segment_table",
    f"""WITH {DAYS}, s AS (SELECT *, CASE WHEN date < DATE '2024-01-16' THEN 'in' ELSE 'out' END AS part FROM d), u AS (SELECT symbol, 'all' AS part, r FROM d UNION ALL SELECT symbol, part, r FROM s)
    SELECT symbol, part, round(CASE WHEN count(*) < 10 THEN -999 WHEN stddev_pop(r) < 1e-9 THEN 0 ELSE avg(r) / stddev_pop(r) * sqrt(252) END, 6) AS sharpe FROM u GROUP BY 1, 2""",
)
def segment_table(spark, sf_dir) -> DataFrame:
    """Guarded Sharpe ratios of the whole, in-sample and out-of-sample days."""
    days = P.daily(_results(spark, sf_dir), ["symbol"])
    part = F.when(F.col("date") < F.lit("2024-01-16").cast("date"), "in").otherwise("out")
    parts = days.withColumn("part", F.explode(F.array(F.lit("all"), part)))
    return rounded(P.windowed_sharpe(parts, ["symbol", "part"], 10))


@query("i15_boosted_trees")
def boosted_trees(spark, sf_dir) -> DataFrame:
    """Two-phase boosted trees, grown on the first part of time and applied to the rest."""
    names = ["ret", "rel_vol", "close_position", "delta_z"]
    rows = T.as_features(_matrix(spark, sf_dir), ["symbol", "ts"], names).withColumn("fold", F.lit(0)).dropna(subset=names)
    before = F.lit("2024-01-16").cast("timestamp_ntz")
    how = T.Boosting(trees=5, depth=3, rate=0.1, columns=1.0)
    forests = T.two_phase(rows.where((F.col("ts") < before) & F.col("label").isNotNull()).withColumnRenamed("label", "y"), names, how, 3, ["delta_z"])
    made = T.predict(rows.where(F.col("ts") >= before).select("symbol", "ts", "fold", "x"), forests, len(names))
    return made.select("symbol", "ts", F.round("prediction", 6).alias("prediction"))


CUTS = (-0.1, 0.0, 0.1)


def _levels_sql() -> str:
    """One tree of two levels: every split of a node by sums over its rows."""
    soft = lambda g: f"greatest(abs({g}) - 1.0, 0.0)"
    worth = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + 8.0)"
    cells = f"SELECT vec_id, g, node, f, x[f + 1] AS v, unnest([{', '.join(map(str, CUTS))}]) AS cut FROM (SELECT *, unnest(generate_series(0, 63)) AS f FROM {{0}})"
    best = f"""SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS place FROM (
        SELECT *, {worth("gl", "hl")} + {worth("ga - gl", "ha - hl")} - ({worth("ga", "ha")}) AS gain FROM (
          SELECT node, f, cut, sum(g) AS ga, count(*) AS ha, coalesce(sum(g) FILTER (v <= cut), 0) AS gl, count(*) FILTER (v <= cut) AS hl FROM ({cells}) GROUP BY node, f, cut
        ) WHERE hl >= 20 AND ha - hl >= 20
      ) WHERE gain > 1e-6
    ) WHERE place = 1"""
    step = "SELECT d.vec_id, d.x, d.g, CASE WHEN s.f IS NULL THEN d.node WHEN d.x[s.f + 1] <= s.cut THEN 2 * d.node + 1 ELSE 2 * d.node + 2 END AS node FROM {0} d LEFT JOIN {1} s ON d.node = s.node"
    return f"""WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    c AS (SELECT pow(2, 30 - ceil(log2(max(abs(y))))) AS scale FROM e),
    m AS (SELECT sum(CAST(round(y * scale) AS BIGINT))::DOUBLE / count(*) / any_value(scale) AS base, any_value(scale) AS scale FROM e, c),
    n0 AS (SELECT vec_id, x, round((base - y) * scale) / scale AS g, 0 AS node FROM e, m),
    s0 AS ({best.format("n0")}), n1 AS ({step.format("n0", "s0")}),
    s1 AS ({best.format("n1")}), n2 AS ({step.format("n1", "s1")}),
    leaf AS (SELECT node, -0.3 * sign(sum(g)) * {soft("sum(g)")} / (count(*) + 8.0) AS w FROM n2 GROUP BY node)
    SELECT vec_id, node AS leaf, round(base + w, 6) AS prediction FROM n2 JOIN leaf USING (node), m"""


@query("i15_boosted_levels", _levels_sql())
def boosted_levels(spark, sf_dir) -> DataFrame:
    """One penalised tree of two levels over all components of the embeddings, and where rows end."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").dropna(subset=["embedding", "label"])
    rows = rows.select("vec_id", F.lit(0).alias("fold"), F.xxhash64("vec_id").alias("name"), F.col("label").cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    how = T.Boosting(trees=1, depth=2, rate=0.3, rows=1.0, columns=1.0)
    forests = T.grow(rows, 64, how, {0: [np.array(CUTS)] * 64})
    tree = forests[0].trees[0]
    leaf = F.lit(0)
    for _ in range(how.depth):
        for node in np.flatnonzero(tree.feature >= 0).tolist():
            goes_left = F.col("x")[int(tree.feature[node])] <= CUTS[int(tree.bin[node]) - 1]
            leaf = F.when(leaf == node, F.when(goes_left, 2 * node + 1).otherwise(2 * node + 2)).otherwise(leaf)
    made = T.predict(rows.select("vec_id", "fold", "x"), forests, 64)
    return made.select("vec_id", leaf.alias("leaf"), F.round("prediction", 6).alias("prediction"))


@query("i18_permutation_importance")
def importance(spark, sf_dir) -> DataFrame:
    """Rise of the error of a fitted linear model when one factor's values change places."""
    rows, names = _matrix(spark, sf_dir), ["ret", "rel_vol", "close_position"]
    fitted = L.coefficients(rows, names, "label")
    return C.permutation_importance(rows, ["symbol"], "ts", names, fitted, "label").withColumn("importance", F.round("importance", 8))


@query("i16_boosted_walk_forward")
def boosted_walk_forward(spark, sf_dir) -> DataFrame:
    """I16: two-phase boosted trees refitted along the way, each predicting the rows up to the next refit."""
    how = T.Boosting(trees=4, depth=3, rate=0.1, columns=1.0)
    made = T.walk_forward(_matrix(spark, sf_dir), ["symbol"], "ts", ["ret", "rel_vol", "close_position", "delta_z"], "label", 250, 250, 3, how, 3, ["delta_z"], backfill=True)
    return made.withColumn("prediction", F.round("prediction", 6))


@query("i20_shapley_selection")
def shapley_selection(spark, sf_dir) -> DataFrame:
    """Factors whose mean absolute Shapley value is among the two highest in two expanding folds or more."""
    how = T.Boosting(trees=3, depth=3, rate=0.1, columns=1.0)
    return H.persistent_factors(_matrix(spark, sf_dir), ["symbol"], "ts", ["ret", "rel_vol", "close_position", "delta_z"], "label", how, top=2, must=["ret"])


@query("i19_recurrent_walk_forward")
def recurrent_walk_forward(spark, sf_dir) -> DataFrame:
    """Gated recurrent networks on the factors that matter most to a first one, refitted along the way."""
    how = G.Recurrent(length=8, hidden=8, epochs=8, rate=1e-2, patience=3)
    made = G.walk_forward(_matrix(spark, sf_dir), ["symbol"], "ts", ["ret", "rel_vol", "close_position", "delta_z"], "label", 250, 250, 3, how, 3)
    return made.withColumn("prediction", F.round("prediction", 6))


WIDE = f"""{MATRIX}, full_rows AS (SELECT symbol, ts, ret, close_position - 0.5 AS cp, label FROM x WHERE ret IS NOT NULL AND close_position IS NOT NULL AND label IS NOT NULL)"""


@query(
    "i21_stacking",
    f"""WITH {WIDE}, g AS (SELECT sum(ret * ret) + 1e-5 AS a, sum(ret * cp) AS b, sum(cp * cp) + 1e-5 AS d, sum(ret * label) AS p, sum(cp * label) AS q FROM full_rows)
    SELECT f.symbol, f.ts, round((d * p - b * q) / (a * d - b * b) * ret + (a * q - b * p) / (a * d - b * b) * cp, 6) AS stacked FROM full_rows f, g""",
)
def stacking(spark, sf_dir) -> DataFrame:
    rows = _matrix(spark, sf_dir).withColumn("cp", F.col("close_position") - 0.5).dropna(subset=["ret", "cp", "label"])
    weights = C.stacking_weights(rows, ["ret", "cp"], "label")
    return rows.select("symbol", "ts", F.round(F.col("ret") * weights[0] + F.col("cp") * weights[1], 6).alias("stacked"))


@query(
    "i21_stacking_split",
    f"""WITH {WIDE}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS total FROM full_rows), i AS (SELECT * FROM n WHERE k < floor(total * 0.7::DOUBLE)),
    g AS (SELECT sum(ret * ret) + 1e-5 AS a, sum(ret * cp) AS b, sum(cp * cp) + 1e-5 AS d, sum(ret * label) AS p, sum(cp * label) AS q FROM i)
    SELECT n.symbol, n.ts, k < floor(total * 0.7::DOUBLE) AS fitted, round((d * p - b * q) / (a * d - b * b) * ret + (a * q - b * p) / (a * d - b * b) * cp, 6) AS stacked FROM n, g""",
)
def stacking_split(spark, sf_dir) -> DataFrame:
    """Weights from the first 70 percent of each series, applied to all of it."""
    rows = _matrix(spark, sf_dir).withColumn("cp", F.col("close_position") - 0.5).dropna(subset=["ret", "cp", "label"])
    place = Window.partitionBy("symbol").orderBy("ts")
    rows = rows.withColumn("fitted", F.row_number().over(place) - 1 < F.floor(F.count("*").over(Window.partitionBy("symbol")) * 0.7))
    weights = C.stacking_weights(rows.where("fitted"), ["ret", "cp"], "label")
    return rows.select("symbol", "ts", "fitted", F.round(F.col("ret") * weights[0] + F.col("cp") * weights[1], 6).alias("stacked"))


@query("j10_icir_composite")
def icir_composite(spark, sf_dir) -> DataFrame:
    """Weights from the ICIR of trailing segments, held until the next refresh."""
    rows = _matrix(spark, sf_dir)
    ics = C.segment_ic(rows, ["symbol"], "ts", FACTOR_NAMES, "label", 50)
    weights = C.refresh_weights(ics, 6, 0.1)
    return C.composite(rows, FACTOR_NAMES, weights, 50).withColumn("composite", F.round("composite", 6))


@query("j11_factor_clusters")
def factor_clusters(spark, sf_dir) -> DataFrame:
    """Clusters of all factor columns by correlation, and a diverse pick of them.

    The number of factors is fixed, so the correlations that reach the driver are too.
    """
    import numpy as np

    pairs = C.column_correlations(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").collect()
    n = 1 + max((p.b for p in pairs), default=0)
    distance = np.zeros((n, n))
    for p in pairs:
        distance[p.a, p.b] = distance[p.b, p.a] = 1 - abs(p["corr"] or 0.0)
    ward, average = C.linkage_clusters(distance, 4), C.linkage_clusters(distance, 4, method="average")
    picked = C.greedy_diverse({str(i): float(-distance[i].mean()) for i in range(n)}, {(str(p.a), str(p.b)): p["corr"] or 0.0 for p in pairs}, 5)
    return spark.createDataFrame([(i, ward[i], average[i], str(i) in picked) for i in range(n)], "factor int, ward int, average int, picked boolean")


@query(
    "k9_vote_strength",
    f"""WITH {SIGNALS}, v AS (SELECT symbol, ts, count(*) AS n, count(*) FILTER (position = 1) AS l, count(*) FILTER (position = -1) AS s FROM sig GROUP BY 1, 2), m AS (SELECT *, CASE WHEN s >= 1 AND s / n >= 0.6 AND s / n <= 1 THEN -1.0 WHEN l / n >= 0.6 AND l / n <= 1 THEN 1.0
      WHEN s >= 1 AND s / n >= 0.3 AND s / n < 0.6 THEN -0.5 WHEN l / n >= 0.3 AND l / n < 0.6 THEN 0.5 ELSE 0 END AS r FROM v)
    SELECT symbol, ts, (CASE WHEN l >= 1 AND s >= 1 THEN CASE WHEN l >= s THEN abs(r) ELSE -abs(r) END ELSE r END)::DOUBLE AS position FROM m""",
)
def vote_strength(spark, sf_dir) -> DataFrame:
    votes_ = C.vote(_signals(spark, sf_dir), ["symbol", "ts"])
    intervals = C.parse_strength_map("0.3-0.6:0.5,0.6-1:1")
    return votes_.select("symbol", "ts", C.vote_strength(F.col("longs"), F.col("shorts"), F.col("models"), intervals).alias("position"))


@query(
    "k10_rebuilt_results",
    f"""WITH {SIGNALS}, v AS (SELECT symbol, ts, avg(position) AS m FROM sig GROUP BY 1, 2), q AS (SELECT b.symbol, b.ts, b.close + 1000 AS price, CASE WHEN m > 0.5 THEN 1 WHEN m < -0.5 THEN -1 ELSE 0 END AS pos, hour(b.ts) = 9 AS is_switch FROM bars b JOIN v USING (symbol, ts)),
    h AS (SELECT *, coalesce({lag('pos')}, 0) AS held, coalesce(price / {lag('price')} - 1, 0) AS a FROM q)
    SELECT symbol, ts, held::DOUBLE AS held, round(CASE WHEN is_switch THEN 0 ELSE held * a END, 6) AS strategy_return, round(1 + sum(CASE WHEN is_switch THEN 0 ELSE held * a END) OVER {W()}, 6) AS cumulative_value FROM h""",
)
def rebuilt(spark, sf_dir) -> DataFrame:
    """Results of a combined signal, a bar late, with nothing earned on switch bars."""
    mean = _signals(spark, sf_dir).groupBy("symbol", "ts").agg(F.avg("position").alias("m"))
    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", (F.col("close") + 1000).alias("price")).join(mean, ["symbol", "ts"])
    signal = F.when(F.col("m") > 0.5, 1.0).when(F.col("m") < -0.5, -1.0).otherwise(0.0)
    made = P.results(bars.withColumn("position", signal), S, switch=F.hour("ts") == 9)
    return rounded(made.select("symbol", "ts", "held", "strategy_return", "cumulative_value"))


@query(
    "d15_slot_vpin",
    f"""WITH {TICKS}, o AS (SELECT symbol, trading_date, hour(ts) // 6 AS slot, price, greatest(size, 0) AS v, row_number() OVER w - 1 AS i, price - lag(price) OVER w AS c, sum(size) OVER w AS cum, sum(size) OVER (PARTITION BY symbol, trading_date, hour(ts) // 6) AS total,
      count(*) OVER (PARTITION BY symbol, trading_date, hour(ts) // 6) AS n FROM ticks WINDOW w AS (PARTITION BY symbol, trading_date, hour(ts) // 6 ORDER BY ts, seq)),
    e AS (SELECT *, 0.2 * pow(0.8, i) * sum(CASE WHEN i >= 2 THEN c * c * pow(0.8, -i) ELSE 0 END) OVER (PARTITION BY symbol, trading_date, slot ORDER BY i) AS variance FROM o),
    z AS (SELECT *, CASE WHEN i >= 2 THEN c / sqrt(greatest(variance, 1e-16)) ELSE 0 END AS z FROM e), t AS (SELECT *, CASE WHEN i >= 2 THEN 2 * {PHI} - 1 ELSE 0 END AS tilt FROM z),
    k AS (SELECT *, unnest(range(1, 5)) AS k FROM t), p AS (SELECT symbol, trading_date, slot, n, total, k, abs(sum(tilt * greatest(0, least(cum, (k + 1) * total / 5.0) - greatest(cum - v, k * total / 5.0)))) AS imbalance FROM k GROUP BY ALL)
    SELECT symbol, CAST(trading_date AS VARCHAR) AS trading_date, CAST(slot AS INT) AS slot, round(CASE WHEN n >= 3 AND total > 0 THEN sum(imbalance) / (total * 0.8) END, 6) AS vpin FROM p GROUP BY symbol, trading_date, slot, n, total""",
)
def slot_vpin(spark, sf_dir) -> DataFrame:
    """Volume-synchronised imbalance inside six-hour slots, from ticks."""
    from fathom.operators.frames import ticks

    df = ticks(spark, sf_dir).withColumn("slot", F.floor(F.hour("ts") / 6).cast("int"))
    made = X.vpin_by_slot(df, ["symbol", "trading_date", "slot"])
    return made.select("symbol", F.col("trading_date").cast("string").alias("trading_date"), "slot", F.round("vpin", 6).alias("vpin"))


@query(
    "e6_cross_asset",
    f"""WITH {BARS}, a AS (SELECT * FROM bars WHERE symbol = 'click'), b AS (SELECT ts, close FROM bars WHERE symbol = 'view')
    SELECT a.ts, round(a.close / nullif(a0.close, 0) - 1, 6) AS own_ret_4, round(b1.close / nullif(b0.close, 0) - 1, 6) AS other_ret_4, round((b1.close / nullif(b0.close, 0) - 1) - (a.close / nullif(a0.close, 0) - 1), 6) AS spread_4
    FROM a ASOF LEFT JOIN a a0 ON a.symbol = a0.symbol AND a.ts - INTERVAL 4 HOURS >= a0.ts ASOF LEFT JOIN b b1 ON a.ts >= b1.ts ASOF LEFT JOIN b b0 ON a.ts - INTERVAL 4 HOURS >= b0.ts""",
)
def cross_asset(spark, sf_dir) -> DataFrame:
    """Own and other return over four hours by as-of prices, and their spread."""
    from fathom.operators import joins

    bars = hourly_bars(spark, sf_dir).select("symbol", "ts", "close")
    own = bars.where("symbol = 'click'")
    other = bars.where("symbol = 'view'").withColumn("symbol", F.lit("click"))
    made = joins.asof_offsets(own, own, ["symbol"], "close", (4,), prefix="own")
    made = joins.asof_offsets(made, other, ["symbol"], "close", (0, 4), prefix="other")
    ours, theirs = ratio("close", "own_4") - 1, ratio("other_0", "other_4") - 1
    return rounded(made.select("ts", ours.alias("own_ret_4"), theirs.alias("other_ret_4"), (theirs - ours).alias("spread_4")))


@query(
    "l11_cash_metrics",
    f"""WITH {RESULTS}, g AS (SELECT *, coalesce(held * (price - {lag('price')}) * 10, 0) - CASE WHEN (coalesce({lag('held')}, 0) = 0) <> (held = 0) THEN 3.5 ELSE 0 END AS net FROM rr), e AS (SELECT *, 3000 + sum(net) OVER {W()} AS equity FROM g)
    SELECT symbol, round(sum(net), 4) AS net, round(arg_max(equity, ts), 4) AS equity, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses FROM e GROUP BY 1""",
)
def cash_metrics(spark, sf_dir) -> DataFrame:
    made = P.cash_account(_results(spark, sf_dir), S)
    count = lambda x: F.count(F.when(x, 1))
    return made.groupBy("symbol").agg(F.round(F.sum("net"), 4).alias("net"), F.round(F.max_by("equity", "ts"), 4).alias("equity"), count(F.col("net") > 0).alias("wins"), count(F.col("net") < 0).alias("losses"))
