import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom import catalog
from fathom.functions.factors import FACTORS, add_factors
from fathom.functions.windows import Series, normal_cdf


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    parts = []
    for symbol in ("A", "B"):
        close = 100 + rng.normal(size=160).cumsum()
        parts.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.date_range("2024-01-01", periods=160, freq="h"), "close": close, "open": close + rng.normal(size=160),
            "volume": rng.integers(0, 50, 160).astype(float), "delta": rng.normal(size=160) * 9, "buy_vol": rng.integers(0, 9, 160), "sell_vol": rng.integers(0, 9, 160),
        }))
    parts.append(pd.DataFrame({"symbol": ["one"], "ts": pd.to_datetime(["2024-01-01"]), "close": [5.0], "open": [5.0], "volume": [1.0], "delta": [0.0], "buy_vol": [0], "sell_vol": [0]}))
    flat = parts[0].assign(symbol="flat", close=7.0, open=7.0, volume=0.0, delta=0.0, buy_vol=0, sell_vol=0)
    out = pd.concat([*parts, flat], ignore_index=True)
    out["high"] = out[["open", "close"]].max(axis=1) + (out.symbol != "flat") * 0.5
    out["low"] = out[["open", "close"]].min(axis=1) - (out.symbol != "flat") * 0.5
    out["vwap_pv"], out["vwap_v"], out["trading_date"] = out.close * out.volume, out.volume, out.ts.dt.date
    return out


def test_rolling_rules_equal_pandas(spark, frame):
    names = ["ret", "std20", "skew20", "kurt20", "ma60", "mfi14", "bb_position", "vol_pct", "cci20", "ma250_dev", "hurst", "aroon_up"]
    found = add_factors(spark.createDataFrame(frame.sample(frac=1, random_state=1)), names).toPandas().set_index(["symbol", "ts"]).sort_index()
    for symbol in ("A", "B"):
        own = frame[frame.symbol == symbol].set_index("ts")
        ret = own.close.pct_change()
        tp = (own.high + own.low + own.close) / 3
        logs = [np.log(own.close.diff(k).rolling(100 - k).std(ddof=0)) for k in range(2, 20)]
        expected = {
            "ret": ret, "std20": own.close.rolling(20).std(), "skew20": ret.rolling(20).skew(), "kurt20": ret.rolling(20).kurt(), "ma60": own.close.rolling(60).mean(),
            "bb_position": (own.close - own.close.rolling(20).mean() + 2 * own.close.rolling(20).std()) / (4 * own.close.rolling(20).std()),
            "vol_pct": own.volume.rolling(100).rank(pct=True), "cci20": (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda x: abs(x - x.mean()).mean())),
            "ma250_dev": (own.close / own.close.rolling(250, min_periods=1).mean() - 1) * 100,
            "hurst": pd.concat(logs, axis=1).apply(lambda row: np.polyfit(np.log(range(2, 20)), row, 1)[0] if row.notna().all() else np.nan, axis=1),
            "aroon_up": own.high.rolling(15).apply(lambda x: 100 * (14 - (14 - np.flatnonzero(x == x.max())[-1])) / 14, raw=True),
        }
        for name, values in expected.items():
            assert np.allclose(found.loc[symbol, name].astype(float), values, atol=1e-6, equal_nan=True), name


def test_every_factor_runs_on_flat_and_single_rows(spark, frame):
    made = add_factors(spark.createDataFrame(frame), FACTORS)
    assert made.count() == len(frame)
    values = made.where("symbol in ('flat', 'one')").toPandas()
    numbers = values.select_dtypes("number").to_numpy(float)
    assert not np.isinf(numbers).any()
    assert not [c for c in made.columns if c.startswith("_")]


def test_log_ratios_of_zero_prices_equal_the_sql(spark, tmp_path):
    """Bars with a price of 0, at their low, at both ends and throughout."""
    rng = np.random.default_rng(8)
    ts = pd.date_range("2024-01-01", periods=300, freq="15min")
    value = np.round(rng.exponential(50, 300) + 1, 2)
    value[[101, 140, 143]] = value[200:204] = 0.0
    rows = pd.DataFrame({"event_id": np.arange(300), "ts": ts, "user_id": rng.integers(1, 90, 300), "event_type": "a", "value": value, "props": "{}"})
    rows.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("e_volatility_factors", "e_price_factors"):
        cursor = con.execute(catalog.ORACLE_SQL[name] + " ORDER BY ts")
        columns = [c[0] for c in cursor.description]
        want = cursor.fetchall()
        found = catalog.QUERIES[name](spark, str(tmp_path)).orderBy("ts").select(*columns).collect()
        assert len(found) == len(want) == 75
        for ours, theirs in zip(found, want, strict=True):
            for c, x, y in zip(columns[2:], ours[2:], theirs[2:], strict=True):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=2e-6, nan_ok=True)), (name, theirs[1], c, x, y)
        if name == "e_volatility_factors":
            seen = {math.copysign(1, v) for r in found for v in (r.intraday_vol, r.overnight_vol) if v is not None and math.isinf(v)}
            assert seen == {1.0, -1.0} and sum(r.parkinson is not None and math.isinf(r.parkinson) for r in found) >= 20


def test_no_look_ahead(spark, frame):
    names = [n for n in FACTORS if not n.startswith("_")]
    cut = frame.ts.sort_values().iloc[len(frame) // 2]
    whole = add_factors(spark.createDataFrame(frame), names).where(F.col("ts") <= F.lit(cut)).toPandas()
    past = add_factors(spark.createDataFrame(frame[frame.ts <= cut]), names).toPandas()
    key = ["symbol", "ts"]
    whole, past = (x.sort_values(key).reset_index(drop=True)[names].astype(float) for x in (whole, past))
    assert np.allclose(whole, past, equal_nan=True, rtol=1e-9, atol=1e-9)


def test_unknown_factor(spark, frame):
    with pytest.raises(KeyError):
        add_factors(spark.createDataFrame(frame.head(3)), ["nothing"])


def test_normal_cdf(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-6 for r in rows)


def test_fill_and_products(spark):
    s = Series(("k",), ("t",))
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 1.0, None, 3.0, None])], "k string, t int, x double")
    rows = df.select("t", s.ffill("x").alias("f"), s.bfill("x").alias("b")).orderBy("t").collect()
    assert [r.f for r in rows] == [None, 1, 1, 3, 3] and [r.b for r in rows] == [1, 1, 3, 3, None]
