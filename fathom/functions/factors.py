"""Catalogue of bar factors: name, what it needs, and its expression over a ``Series``.

Needs are other factors or bar columns (open, high, low, close, volume, delta, buy_vol,
sell_vol, vwap_pv, vwap_v).  ``add_factors`` orders what was asked for into layers, each one
projection, so that window expressions of a layer share their sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.windows import Series, col, log_ratio, ratio

EPS = 1e-8


class Factor(NamedTuple):
    family: str
    needs: tuple[str, ...]
    make: Callable[[Series], Column]


FACTORS: dict[str, Factor] = {}


def factor(family: str, name: str, needs: str, make: Callable[[Series], Column]) -> None:
    FACTORS[name] = Factor(family, tuple(needs.split()), make)


def c() -> Column:
    return F.col("close")


def o() -> Column:
    return F.col("open")


def h() -> Column:
    return F.col("high")


def lo() -> Column:
    return F.col("low")


def v() -> Column:
    return F.col("volume")


# price and momentum
factor("price", "rn", "close", lambda s: s.rn())
factor("price", "ret", "close", lambda s: s.ret("close"))
factor("price", "lret", "close", lambda s: s.lret("close"))
factor("price", "ret5", "close", lambda s: s.ret("close", 5))
factor("price", "ret20", "close", lambda s: s.ret("close", 20))
factor("price", "price_accel", "ret", lambda s: s.diff("ret", 5))
factor("price", "price_reversal", "ret", lambda s: -F.col("ret"))
factor("price", "intraday_return", "open close", lambda s: ratio(c() - o(), o()))
factor("price", "gap_ratio", "open close", lambda s: ratio(o() - s.lag("close"), s.lag("close")))
factor("price", "std20", "close", lambda s: s.std("close", 20))
factor("price", "snr", "close std20", lambda s: s.diff("close", 20) / (F.col("std20") + EPS))
factor("price", "trend_strength", "snr", lambda s: F.abs("snr"))
factor("price", "ma250_dev", "close", lambda s: ratio(c() - s.mean("close", 250, 1), s.mean("close", 250, 1)) * 100)
for n in (5, 20, 60):
    factor("price", f"ma{n}", "close", lambda s, n=n: s.mean("close", n))
factor("price", "ma5_20", "ma5 ma20", lambda s: ratio("ma5", "ma20"))
factor("price", "ma20_60", "ma20 ma60", lambda s: ratio("ma20", "ma60"))
factor("price", "roc10", "close", lambda s: s.ret("close", 10) * 100)
factor("price", "close_position", "close high low", lambda s: ratio(c() - lo(), h() - lo()))
factor("price", "hl", "high low", lambda s: ratio(h(), lo()))
factor("price", "high_low_ratio", "hl", lambda s: s.mean("hl", 20))

# volume and price with volume
factor("volume", "vol_change", "volume", lambda s: s.ret("volume"))
factor("volume", "vol_mom", "volume", lambda s: s.ret("volume", 20))
factor("volume", "rel_vol", "volume", lambda s: ratio(v(), s.mean("volume", 20)))
factor("volume", "vol_ma_ratio", "volume", lambda s: ratio(s.mean("volume", 5), s.mean("volume", 20)))
factor("volume", "vol_accel", "vol_change", lambda s: s.diff("vol_change", 5))
factor("volume", "signed_vol", "close volume", lambda s: F.when(s.lag("close").isNull(), v()).otherwise(F.signum(s.diff("close")) * v()))
factor("volume", "obv", "signed_vol", lambda s: s.cumsum("signed_vol"))
factor("volume", "tp", "high low close", lambda s: (h() + lo() + c()) / 3)
factor("volume", "vwap_tp_dev", "tp close", lambda s: ratio(c() - s.mean("tp", 20), s.mean("tp", 20)))
factor("volume", "tp_up", "tp volume", lambda s: F.when(s.diff("tp") > 0, F.col("tp") * v()).when(s.lag("tp").isNotNull(), 0.0))
factor("volume", "tp_down", "tp volume", lambda s: F.when(s.diff("tp") < 0, F.col("tp") * v()).when(s.lag("tp").isNotNull(), 0.0))
factor("volume", "mfi14", "tp_up tp_down", lambda s: 100 * ratio(s.sum("tp_up", 14), s.sum("tp_up", 14) + s.sum("tp_down", 14)))
factor("volume", "money_flow_ratio", "tp_up tp_down", lambda s: ratio(s.sum("tp_up", 14), s.sum("tp_up", 14) + s.sum("tp_down", 14)))
factor("volume", "ret_vol", "ret volume", lambda s: F.col("ret") * v())
factor("volume", "pvt", "ret_vol", lambda s: s.cumsum("ret_vol"))
factor("volume", "emv1", "high low volume", lambda s: ratio((h() + lo()) / 2 - (s.lag("high") + s.lag("low")) / 2, ratio(v() / 10000, h() - lo())))
factor("volume", "ease_of_movement", "emv1", lambda s: s.mean("emv1", 14))
factor("volume", "lret_vol", "lret volume", lambda s: F.col("lret") * v())
factor("volume", "vol_weighted_return", "lret_vol volume", lambda s: ratio(s.sum("lret_vol", 20), s.sum("volume", 20)))
factor("volume", "vol_price_corr", "ret vol_change", lambda s: s.corr("ret", "vol_change", 20))
factor("volume", "clv_vol", "high low close volume", lambda s: F.coalesce(ratio((c() - lo()) - (h() - c()), h() - lo()), F.lit(0.0)) * v())
factor("volume", "ad_line", "clv_vol", lambda s: s.cumsum("clv_vol"))
factor("volume", "ma_vol14", "volume", lambda s: s.mean("volume", 14))
factor("volume", "ad_raw", "high low close volume ma_vol14", lambda s: ratio(2 * c() - lo() - h(), h() - lo()) * ratio(v(), "ma_vol14"))


def _volume_profile(s: Series, n: int = 20, bins: int = 10) -> Column:
    """Share of the range, by tenths, in which most volume of the last n bars traded."""
    seen = F.collect_list(F.struct(c().alias("p"), v().alias("v"))).over(s.last_n(n))
    low, high = F.min(c()).over(s.last_n(n)), F.max(c()).over(s.last_n(n))
    place = lambda p: F.least(F.floor((p - low) / (high - low) * bins), F.lit(bins - 1))
    summed = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(seen, F.lit(0.0), lambda a, e: a + F.when(place(e["p"]) == b, e["v"]).otherwise(0)))
    return F.when((F.count(c()).over(s.last_n(n)) >= n) & (high > low), (F.array_position(summed, F.array_max(summed)) - 1) / bins)


factor("volume", "volume_profile", "close volume", _volume_profile)
factor("volume", "day_vwap", "vwap_pv vwap_v trading_date", lambda s: _day_vwap(s))


def _day_vwap(s: Series) -> Column:
    day = Series((*s.keys, "trading_date"), s.order)
    return ratio(day.cumsum("vwap_pv"), day.cumsum("vwap_v"))


factor("volume", "vwap_dev", "close day_vwap", lambda s: ratio(c() - s.mean("day_vwap", 20), s.mean("day_vwap", 20)))
factor("volume", "vwap_slope", "day_vwap rn", lambda s: s.slope("day_vwap", 5))

# volatility and distribution
factor("volatility", "volatility", "ret", lambda s: s.std("ret", 20))
factor("volatility", "realized_vol", "lret", lambda s: s.std("lret", 20))
factor("volatility", "intraday_vol", "high low", lambda s: log_ratio(h(), lo()))
factor("volatility", "overnight_vol", "open close", lambda s: log_ratio(o(), s.lag("close")))
factor("volatility", "tr", "high low close", lambda s: F.greatest(h() - lo(), F.abs(h() - s.lag("close")), F.abs(lo() - s.lag("close"))))
factor("volatility", "atr_sma14", "tr", lambda s: s.mean("tr", 14))
factor("volatility", "hl2", "intraday_vol", lambda s: F.col("intraday_vol") * F.col("intraday_vol"))
factor("volatility", "parkinson", "hl2", lambda s: F.sqrt(s.mean("hl2", 20) / (4 * math.log(2))))
factor("volatility", "vol_ratio_10_30", "lret", lambda s: ratio(s.std("lret", 10), s.std("lret", 30)))
factor("volatility", "skew20", "ret", lambda s: s.skew("ret", 20))
factor("volatility", "kurt20", "ret", lambda s: s.kurt("ret", 20))
factor("volatility", "price_jump", "ret", lambda s: F.coalesce((F.abs("ret") > 0.02).cast("int"), F.lit(0)))
factor("volatility", "abs_change", "close", lambda s: F.abs(s.diff("close")))
factor("volatility", "fractal_dimension", "abs_change", lambda s: 1 + F.ln(F.nullif(s.sum("abs_change", 19), F.lit(0.0))) / math.log(38))
factor("volatility", "illiq", "lret close volume", lambda s: ratio(F.abs("lret"), c() * v()))
factor("volatility", "amihud_z", "illiq", lambda s: s.zscore("illiq", 20))
factor("volatility", "illiq_std", "illiq", lambda s: s.std("illiq", 20))
factor("volatility", "amihud_vol_z", "illiq_std", lambda s: s.zscore("illiq_std", 20))
factor("volatility", "range_share", "high low close", lambda s: ratio(h() - lo(), c()))
factor("volatility", "spread_proxy", "range_share", lambda s: s.mean("range_share", 20))
factor("volatility", "abs_ret", "ret", lambda s: F.abs("ret"))
factor("volatility", "price_impact", "abs_ret vol_change", lambda s: s.corr("abs_ret", "vol_change", 5))
factor("volatility", "v_high", "close high volume", lambda s: F.when(c() == h(), v()).otherwise(0))
factor("volatility", "v_low", "close low volume", lambda s: F.when(c() == lo(), v()).otherwise(0))
factor("volatility", "depth_imbalance", "v_high v_low volume", lambda s: ratio(s.sum("v_high", 20) - s.sum("v_low", 20), s.sum("volume", 20)))
factor("volatility", "liq1", "close volume lret", lambda s: ratio(c() * v(), F.abs("lret") + EPS))
factor("volatility", "liquidity", "liq1", lambda s: s.mean("liq1", 20))
factor("volatility", "sharpe20", "lret", lambda s: ratio(s.mean("lret", 20), s.std("lret", 20)))
factor("volatility", "up_change", "close", lambda s: F.greatest(s.diff("close"), F.when(s.lag("close").isNotNull(), 0.0)))
factor("volatility", "down_change", "close", lambda s: F.least(s.diff("close"), F.when(s.lag("close").isNotNull(), 0.0)))
factor("volatility", "rvi14", "up_change down_change", lambda s: ratio(s.std("up_change", 14) - s.std("down_change", 14), s.std("up_change", 14) + s.std("down_change", 14)))


def _covariance(s: Series, x: str, y: str, n: int) -> Column:
    """Sample covariance, NaN where an x is infinite, whatever its place in the frame."""
    return s.both(F.covar_samp, x, y, n) + 0 * s.both(lambda a, b: F.sum(a), x, y, n)


factor("volatility", "kyle_lambda", "lret ofi", lambda s: ratio(_covariance(s, "lret", "ofi", 20), s.roll(F.var_samp, "ofi", 20)))
factor("volatility", "ofi_before", "ofi", lambda s: s.lag("ofi"))
factor("volatility", "kyle_lambda_lag", "lret ofi_before", lambda s: ratio(_covariance(s, "lret", "ofi_before", 20), s.roll(F.var_samp, "ofi_before", 20)))


HURST_LAGS = range(2, 20)
for k in HURST_LAGS:
    factor("volatility", f"_d{k}", "close", lambda s, k=k: s.diff("close", k))
    factor("volatility", f"_h{k}", f"_d{k}", lambda s, k=k: F.ln(F.nullif(s.roll(F.stddev_pop, f"_d{k}", 100 - k), F.lit(0.0))))


def _hurst(s: Series) -> Column:
    """Slope of ln std of k-step differences on ln k, over the last 100 bars."""
    x = [math.log(k) for k in HURST_LAGS]
    mean = sum(x) / len(x)
    spread = sum((a - mean) ** 2 for a in x)
    total = F.lit(0.0)
    for a, k in zip(x, HURST_LAGS, strict=True):
        total = total + F.lit((a - mean) / spread) * F.col(f"_h{k}")
    return total


factor("volatility", "hurst", " ".join(f"_h{k}" for k in HURST_LAGS), _hurst)

# technical indicators without recursion
factor("technical", "williams14", "high low close", lambda s: -100 * ratio(s.max("high", 14) - c(), s.max("high", 14) - s.min("low", 14)))
factor("technical", "fast_k", "high low close", lambda s: 100 * ratio(c() - s.min("low", 14), s.max("high", 14) - s.min("low", 14)))
factor("technical", "slow_k", "fast_k", lambda s: s.mean("fast_k", 3))
factor("technical", "slow_d", "slow_k", lambda s: s.mean("slow_k", 3))
factor("technical", "tp_ma20", "tp", lambda s: s.mean("tp", 20))


def _cci(s: Series, n: int = 20) -> Column:
    seen = F.collect_list("tp").over(s.last_n(n))
    off = F.aggregate(seen, F.lit(0.0), lambda a, e: a + F.abs(e - F.col("tp_ma20"))) / n
    return ratio(F.col("tp") - F.col("tp_ma20"), 0.015 * off)


factor("technical", "cci20", "tp tp_ma20", _cci)


def _aroon(s: Series, best, x: str, n: int = 14) -> Column:
    """100 * (n - bars since the extreme) / n over n + 1 rows; the latest of equal extremes counts."""
    frame = s.last_n(n + 1)
    at = F.max(F.struct((F.col(x) if best is F.max else -F.col(x)).alias("x"), F.col("rn").alias("rn")))
    return F.when(F.count(x).over(frame) >= n + 1, 100.0 * (n - (F.col("rn") - at.over(frame)["rn"])) / n)


factor("technical", "aroon_up", "high rn", lambda s: _aroon(s, F.max, "high"))
factor("technical", "aroon_down", "low rn", lambda s: _aroon(s, F.min, "low"))
factor("technical", "aroon_osc", "aroon_up aroon_down", lambda s: F.col("aroon_up") - F.col("aroon_down"))
factor("technical", "bp", "close low", lambda s: F.when(s.lag("close").isNotNull(), c() - F.least(lo(), s.lag("close"))))
factor("technical", "tr1", "tr close", lambda s: F.when(s.lag("close").isNotNull(), F.col("tr")))
factor(
    "technical",
    "ultosc",
    "bp tr1",
    lambda s: 100 * (4 * ratio(s.sum("bp", 7), s.sum("tr1", 7)) + 2 * ratio(s.sum("bp", 14), s.sum("tr1", 14)) + ratio(s.sum("bp", 28), s.sum("tr1", 28))) / 7,
)
factor("technical", "bb_upper", "ma20 std20", lambda s: F.col("ma20") + 2 * F.col("std20"))
factor("technical", "bb_lower", "ma20 std20", lambda s: F.col("ma20") - 2 * F.col("std20"))
factor("technical", "bb_position", "close bb_upper bb_lower", lambda s: ratio(c() - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))
factor("technical", "donchian_position", "close high low", lambda s: ratio(c() - s.min("low", 20), s.max("high", 20) - s.min("low", 20)))
factor("technical", "chan_high", "high", lambda s: s.max("high", 20))
factor("technical", "chan_low", "low", lambda s: s.min("low", 20))
factor("technical", "channel_breakout", "close chan_high chan_low", lambda s: F.when(c() > s.lag("chan_high"), 1).when(c() < s.lag("chan_low"), -1).otherwise(0))
factor("technical", "body", "open close", lambda s: c() - o())
factor("technical", "qstick14", "body", lambda s: s.mean("body", 14))
factor("technical", "lr_end14", "close rn", lambda s: s.both(F.regr_intercept, "close", "rn", 14) + s.slope("close", 14) * F.col("rn"))
factor("technical", "lr_log", "lr_end14 close", lambda s: F.ln(ratio("lr_end14", "close")))

# order flow and breakout
factor("flow", "cvd", "delta", lambda s: s.cumsum("delta"))
factor("flow", "price_delta", "ret delta", lambda s: F.col("ret") * F.col("delta"))
factor("flow", "price_delta_volume", "price_delta volume", lambda s: F.col("price_delta") * v())
factor("flow", "price_delta_trend", "price_delta", lambda s: s.cumsum("price_delta"))
factor("flow", "ofi", "buy_vol sell_vol", lambda s: ratio(F.col("buy_vol") - F.col("sell_vol"), F.col("buy_vol") + F.col("sell_vol")))
factor("flow", "effort_vs_result", "delta ret", lambda s: F.col("delta") / (F.abs("ret") + 0.5))
factor("flow", "delta_z", "delta", lambda s: F.coalesce(s.zscore("delta", 20, 5), F.lit(0.0)))
factor("flow", "ret_z", "ret", lambda s: F.coalesce(s.zscore("ret", 50, 12), F.lit(0.0)))
factor("flow", "volume_z", "volume", lambda s: F.coalesce(s.zscore("volume", 50, 12), F.lit(0.0)))


def _at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def _cases(value: str, *cases: Column) -> Column:
    """``value`` where one of the cases holds, else 0."""
    out = F.lit(0.0)
    for case in reversed(cases):
        out = F.when(case, F.col(value).cast("double")).otherwise(out)
    return out


# The thresholds and rolling lengths of the cases below are fixed values of the factor catalogue.
dz, rz, vz = (lambda: F.col("delta_z")), (lambda: F.col("ret_z")), (lambda: F.col("volume_z"))
factor("flow", "distribute", "delta delta_z ret_z", lambda s: _cases("delta", (dz() >= 0.5) & (F.abs(rz()) < 0.3), (dz() <= -0.5) & (F.abs(rz()) > 0.3)))
factor("flow", "trend", "delta delta_z ret", lambda s: _cases("delta", (dz() >= 1) & (F.col("ret") > 0), (dz() <= -1) & (F.col("ret") < 0)))
factor("flow", "trend1", "delta_z ret", lambda s: _cases("ret", (dz() >= 1) & (F.col("ret") > 0)))
factor("flow", "absorption", "ret delta_z ret_z volume_z", lambda s: _cases("ret", (dz() < 0.5) & (rz() >= 0.5) & (vz() > 0.2), (dz() > -0.5) & (rz() <= -0.5) & (vz() > 0.2)))
for n in (5, 10, 20):
    factor("flow", f"hi{n}", "high", lambda s, n=n: s.max("high", n))
    factor("flow", f"lo{n}", "low", lambda s, n=n: s.min("low", n))
    factor("flow", f"break{n}", f"close hi{n} lo{n}", lambda s, n=n: (c() - (s.lag(f"hi{n}") + s.lag(f"lo{n}")) / 2) / _at_least(s.lag(f"hi{n}") - s.lag(f"lo{n}"), 1e-9))
factor("flow", "break_position", "break5 break10 break20", lambda s: 0 * F.col("break5") + F.col("break10") + 0 * F.col("break20"))
factor("flow", "vol_median_ratio", "volume", lambda s: ratio(v(), s.quantile("volume", 48, 0.5)))
factor("flow", "vol_pct", "volume", lambda s: s.rank("volume", 100))
factor("flow", "trend_break", "break_position trend vol_pct", lambda s: F.when(F.col("vol_pct") > 0.5, F.col("break_position") * F.col("trend")).otherwise(0.0))
factor("flow", "trend_break2", "break_position trend vol_median_ratio", lambda s: F.col("break_position") * F.col("trend") * F.col("vol_median_ratio"))
factor("flow", "trend_break_watch", "trend_break2", lambda s: s.lag("trend_break2", 3))


def add_factors(bars: DataFrame, names: Iterable[str], series: Series = Series()) -> DataFrame:  # noqa: B008
    """``bars`` with the named factors, and those they need, in as few projections as it takes."""
    level: dict[str, int] = {}

    def visit(name: str) -> int:
        if name in bars.columns:
            return 0
        if name not in FACTORS:
            raise KeyError(f"no bar column or factor named {name}")
        if name not in level:
            level[name] = 1 + max(visit(x) for x in FACTORS[name].needs)
        return level[name]

    wanted = list(dict.fromkeys(names))
    for name in wanted:
        visit(name)
    out = bars
    for k in range(1, max(level.values(), default=0) + 1):
        out = out.withColumns({n: FACTORS[n].make(series) for n, at in level.items() if at == k})
    return out.drop(*(n for n in level if n.startswith("_")))


__all__ = ["FACTORS", "Factor", "add_factors", "col", "factor"]
