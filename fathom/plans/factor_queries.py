"""Factor families over hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.factors import FACTORS, HURST_LAGS, add_factors
from fathom.operators.frames import hourly_bars
from fathom.plans.registry import BARS, QUERIES, ORACLE_SQL, W, both, div, lag, layered, ret, roll

#: SQL twin of each factor, by the same name; ``_`` names are only steps.
SQL: dict[str, str] = {
    "rn": f"row_number() OVER {W()} - 1",
    "ret": ret("close"),
    "lret": f"ln(close / {lag('close')})",
    "ret5": ret("close", 5),
    "ret20": ret("close", 20),
    "price_accel": f"ret - {lag('ret', 5)}",
    "price_reversal": "-ret",
    "intraday_return": div("close - open", "open"),
    "gap_ratio": div(f"open - {lag('close')}", lag("close")),
    "std20": roll("stddev_samp", "close", 20),
    "snr": f"(close - {lag('close', 20)}) / (std20 + 1e-8)",
    "trend_strength": "abs(snr)",
    "ma250_dev": f"(close / ({roll('avg', 'close', 250, 1)}) - 1) * 100",
    "ma5": roll("avg", "close", 5),
    "ma20": roll("avg", "close", 20),
    "ma60": roll("avg", "close", 60),
    "ma5_20": div("ma5", "ma20"),
    "ma20_60": div("ma20", "ma60"),
    "roc10": f"{ret('close', 10)} * 100",
    "close_position": div("close - low", "high - low"),
    "hl": div("high", "low"),
    "high_low_ratio": roll("avg", "hl", 20),
    "vol_change": ret("volume"),
    "vol_mom": ret("volume", 20),
    "rel_vol": div("volume", roll("avg", "volume", 20)),
    "vol_ma_ratio": div(roll("avg", "volume", 5), roll("avg", "volume", 20)),
    "vol_accel": f"vol_change - {lag('vol_change', 5)}",
    "signed_vol": f"CASE WHEN {lag('close')} IS NULL THEN volume ELSE sign(close - {lag('close')}) * volume END",
    "obv": f"sum(signed_vol) OVER {W()}",
    "tp": "(high + low + close) / 3",
    "vwap_tp_dev": div(f"close - ({roll('avg', 'tp', 20)})", roll("avg", "tp", 20)),
    "tp_up": f"CASE WHEN tp > {lag('tp')} THEN tp * volume WHEN {lag('tp')} IS NOT NULL THEN 0 END",
    "tp_down": f"CASE WHEN tp < {lag('tp')} THEN tp * volume WHEN {lag('tp')} IS NOT NULL THEN 0 END",
    "mfi14": f"100 * {div(roll('sum', 'tp_up', 14), '(' + roll('sum', 'tp_up', 14) + ') + (' + roll('sum', 'tp_down', 14) + ')')}",
    "money_flow_ratio": div(roll("sum", "tp_up", 14), "(" + roll("sum", "tp_up", 14) + ") + (" + roll("sum", "tp_down", 14) + ")"),
    "ret_vol": "ret * volume",
    "pvt": f"sum(ret_vol) OVER {W()}",
    "emv1": div(f"(high + low) / 2 - ({lag('high')} + {lag('low')}) / 2", div("volume / 10000.0", "high - low")),
    "ease_of_movement": roll("avg", "emv1", 14),
    "lret_vol": "lret * volume",
    "vol_weighted_return": div(roll("sum", "lret_vol", 20), roll("sum", "volume", 20)),
    "vol_price_corr": both("corr", "ret", "vol_change", 20),
    "clv_vol": f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0) * volume",
    "ad_line": f"sum(clv_vol) OVER {W()}",
    "ma_vol14": roll("avg", "volume", 14),
    "ad_raw": f"{div('2 * close - low - high', 'high - low')} * {div('volume', 'ma_vol14')}",
    "day_vwap": "(sum(vwap_pv) OVER (PARTITION BY symbol, trading_date ORDER BY ts)) / nullif((sum(vwap_v) OVER (PARTITION BY symbol, trading_date ORDER BY ts))::DOUBLE, 0)",
    "vwap_dev": div(f"close - ({roll('avg', 'day_vwap', 20)})", roll("avg", "day_vwap", 20)),
    "vwap_slope": both("regr_slope", "day_vwap", "rn", 5),
    "volatility": roll("stddev_samp", "ret", 20),
    "realized_vol": roll("stddev_samp", "lret", 20),
    "intraday_vol": "ln(high / low)",
    "overnight_vol": f"ln(open / {lag('close')})",
    "tr": f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))",
    "atr_sma14": roll("avg", "tr", 14),
    "hl2": "intraday_vol * intraday_vol",
    "parkinson": f"sqrt(({roll('avg', 'hl2', 20)}) / {4 * math.log(2)!r})",
    "vol_ratio_10_30": div(roll("stddev_samp", "lret", 10), roll("stddev_samp", "lret", 30)),
    "skew20": roll("skewness", "ret", 20),
    "kurt20": roll("kurtosis", "ret", 20),
    "price_jump": "CASE WHEN abs(ret) > 0.02 THEN 1 ELSE 0 END",
    "abs_change": f"abs(close - {lag('close')})",
    "fractal_dimension": f"1 + ln(nullif(({roll('sum', 'abs_change', 19)}), 0)) / {math.log(38)!r}",
    "illiq": div("abs(lret)", "close * volume"),
    "amihud_z": div(f"illiq - ({roll('avg', 'illiq', 20)})", roll("stddev_samp", "illiq", 20)),
    "illiq_std": roll("stddev_samp", "illiq", 20),
    "amihud_vol_z": div(f"illiq_std - ({roll('avg', 'illiq_std', 20)})", roll("stddev_samp", "illiq_std", 20)),
    "range_share": div("high - low", "close"),
    "spread_proxy": roll("avg", "range_share", 20),
    "abs_ret": "abs(ret)",
    "price_impact": both("corr", "abs_ret", "vol_change", 5),
    "v_high": "CASE WHEN close = high THEN volume ELSE 0 END",
    "v_low": "CASE WHEN close = low THEN volume ELSE 0 END",
    "depth_imbalance": div(f"({roll('sum', 'v_high', 20)}) - ({roll('sum', 'v_low', 20)})", roll("sum", "volume", 20)),
    "liq1": div("close * volume", "abs(lret) + 1e-8"),
    "liquidity": roll("avg", "liq1", 20),
    "sharpe20": div(roll("avg", "lret", 20), roll("stddev_samp", "lret", 20)),
    "up_change": f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(close - {lag('close')}, 0) END",
    "down_change": f"CASE WHEN {lag('close')} IS NOT NULL THEN least(close - {lag('close')}, 0) END",
    "rvi14": div(
        f"({roll('stddev_samp', 'up_change', 14)}) - ({roll('stddev_samp', 'down_change', 14)})", f"({roll('stddev_samp', 'up_change', 14)}) + ({roll('stddev_samp', 'down_change', 14)})"
    ),
    "ofi": div("buy_vol - sell_vol", "buy_vol + sell_vol"),
    "kyle_lambda": div(both("covar_samp", "lret", "ofi", 20), roll("var_samp", "ofi", 20)),
    "ofi_before": lag("ofi"),
    "kyle_lambda_lag": div(both("covar_samp", "lret", "ofi_before", 20), roll("var_samp", "ofi_before", 20)),
    "williams14": f"-100 * {div('(' + roll('max', 'high', 14) + ') - close', '(' + roll('max', 'high', 14) + ') - (' + roll('min', 'low', 14) + ')')}",
    "fast_k": f"100 * {div('close - (' + roll('min', 'low', 14) + ')', '(' + roll('max', 'high', 14) + ') - (' + roll('min', 'low', 14) + ')')}",
    "slow_k": roll("avg", "fast_k", 3),
    "slow_d": roll("avg", "slow_k", 3),
    "tp_ma20": roll("avg", "tp", 20),
    "cci20": div("tp - tp_ma20", f"0.015 * list_sum(list_transform(list(tp) OVER {W(20)}, lambda e: abs(e - tp_ma20))) / 20"),
    "aroon_up": f"CASE WHEN count(high) OVER {W(15)} >= 15 THEN 100.0 * (14 - (rn - arg_max(rn, (high, rn)) OVER {W(15)})) / 14 END",
    "aroon_down": f"CASE WHEN count(low) OVER {W(15)} >= 15 THEN 100.0 * (14 - (rn - arg_max(rn, (-low, rn)) OVER {W(15)})) / 14 END",
    "aroon_osc": "aroon_up - aroon_down",
    "bp": f"CASE WHEN {lag('close')} IS NOT NULL THEN close - least(low, {lag('close')}) END",
    "tr1": f"CASE WHEN {lag('close')} IS NOT NULL THEN tr END",
    "ultosc": "100 * (4 * "
    + div(roll("sum", "bp", 7), roll("sum", "tr1", 7))
    + " + 2 * "
    + div(roll("sum", "bp", 14), roll("sum", "tr1", 14))
    + " + "
    + div(roll("sum", "bp", 28), roll("sum", "tr1", 28))
    + ") / 7",
    "bb_upper": "ma20 + 2 * std20",
    "bb_lower": "ma20 - 2 * std20",
    "bb_position": div("close - bb_lower", "bb_upper - bb_lower"),
    "donchian_position": div(f"close - ({roll('min', 'low', 20)})", f"({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)})"),
    "chan_high": roll("max", "high", 20),
    "chan_low": roll("min", "low", 20),
    "channel_breakout": f"CASE WHEN close > {lag('chan_high')} THEN 1 WHEN close < {lag('chan_low')} THEN -1 ELSE 0 END",
    "body": "close - open",
    "qstick14": roll("avg", "body", 14),
    "lr_end14": f"({both('regr_intercept', 'close', 'rn', 14)}) + ({both('regr_slope', 'close', 'rn', 14)}) * rn",
    "lr_log": f"ln({div('lr_end14', 'close')})",
    "cvd": f"sum(delta) OVER {W()}",
    "price_delta": "ret * delta",
    "price_delta_volume": "price_delta * volume",
    "price_delta_trend": f"sum(price_delta) OVER {W()}",
    "effort_vs_result": "delta / (abs(ret) + 0.5)",
    "delta_z": "coalesce(" + div(f"delta - ({roll('avg', 'delta', 20, 5)})", roll("stddev_samp", "delta", 20, 5)) + ", 0)",
    "ret_z": "coalesce(" + div(f"ret - ({roll('avg', 'ret', 50, 12)})", roll("stddev_samp", "ret", 50, 12)) + ", 0)",
    "volume_z": "coalesce(" + div(f"volume - ({roll('avg', 'volume', 50, 12)})", roll("stddev_samp", "volume", 50, 12)) + ", 0)",
    "distribute": "CASE WHEN (delta_z >= 0.5 AND abs(ret_z) < 0.3) OR (delta_z <= -0.5 AND abs(ret_z) > 0.3) THEN delta ELSE 0 END",
    "trend": "CASE WHEN (delta_z >= 1 AND ret > 0) OR (delta_z <= -1 AND ret < 0) THEN delta ELSE 0 END",
    "trend1": "CASE WHEN delta_z >= 1 AND ret > 0 THEN ret ELSE 0 END",
    "absorption": "CASE WHEN volume_z > 0.2 AND ((delta_z < 0.5 AND ret_z >= 0.5) OR (delta_z > -0.5 AND ret_z <= -0.5)) THEN ret ELSE 0 END",
    "break_position": "0 * break5 + break10 + 0 * break20",
    "vol_median_ratio": div("volume", roll("quantile_cont($, 0.5)", "volume", 48)),
    "vol_pct": f"CASE WHEN count(volume) OVER {W(100)} >= 100 THEN (list_sum(list_transform(list(volume) OVER {W(100)}, lambda e: CASE WHEN e < volume THEN 1.0 WHEN e = volume THEN 0.5 ELSE 0 END)) + 0.5) / 100 END",
    "trend_break": "CASE WHEN vol_pct > 0.5 THEN break_position * trend ELSE 0 END",
    "trend_break2": "break_position * trend * vol_median_ratio",
    "trend_break_watch": lag("trend_break2", 3),
}
for _n in (5, 10, 20):
    SQL[f"hi{_n}"], SQL[f"lo{_n}"] = roll("max", "high", _n), roll("min", "low", _n)
    _width = f"{lag(f'hi{_n}')} - {lag(f'lo{_n}')}"
    SQL[f"break{_n}"] = f"(close - ({lag(f'hi{_n}')} + {lag(f'lo{_n}')}) / 2) / CASE WHEN {_width} IS NOT NULL THEN greatest({_width}, 1e-9) END"
for _k in HURST_LAGS:
    SQL[f"_d{_k}"] = f"close - {lag('close', _k)}"
    SQL[f"_h{_k}"] = f"ln(nullif(({roll('stddev_pop', f'_d{_k}', 100 - _k)}), 0))"
_x = [math.log(k) for k in HURST_LAGS]
_m = sum(_x) / len(_x)
_s = sum((a - _m) ** 2 for a in _x)
SQL["hurst"] = " + ".join(f"{(a - _m) / _s!r} * _h{k}" for a, k in zip(_x, HURST_LAGS, strict=True))

#: Families whose values are large or whose ratios are steep are rounded to fewer digits.
DIGITS = {"volume": 4, "flow": 4}


def _register(family: str) -> None:
    names = [n for n, f in FACTORS.items() if f.family == family and not n.startswith("_") and n in SQL and n not in ("rn", "liquidity", "liq1", "emv1")]
    level: dict[str, int] = {}

    def visit(name: str) -> int:
        if name not in FACTORS:
            return 0
        if name not in level:
            level[name] = 1 + max(visit(x) for x in FACTORS[name].needs)
        return level[name]

    for n in names:
        visit(n)
    layers = [{n: SQL[n] for n, at in level.items() if at == k} for k in range(1, max(level.values()) + 1)]
    digits = DIGITS.get(family, 6)

    def run(spark, sf_dir) -> DataFrame:
        made = add_factors(hourly_bars(spark, sf_dir), names)
        return made.select("symbol", "ts", *(F.round(F.col(n).cast("double"), digits).alias(n) for n in names))

    QUERIES[f"e_{family}_factors"] = run
    ORACLE_SQL[f"e_{family}_factors"] = layered(BARS, layers, names, digits=digits)


for _family in ("price", "volume", "volatility", "technical", "flow"):
    _register(_family)
