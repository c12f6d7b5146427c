import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.functions.windows import Series
from fathom.operators import bars as B
from fathom.operators import clean, joins
from fathom.operators import labels as L
from fathom.operators import performance as P
from fathom.operators import scan as X
from fathom.operators import selection as C
from fathom.sources import readers, writers

T0 = datetime(2024, 1, 1)


def series(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, T0 + timedelta(hours=i), *v) for i, v in enumerate(values)], "symbol string, ts timestamp, high double, low double, close double")


# --- scans


def test_scans_equal_pandas_and_carry_over_batches(spark):
    rng = np.random.default_rng(1)
    close = 50 + rng.normal(size=300).cumsum()
    frames = [series(spark, zip((close + 1).tolist(), (close - 1).tolist(), close.tolist(), strict=True), s) for s in "ab"]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = X.ordered_scan(frames[0].unionByName(frames[1]).repartition(5), ["symbol"], ["ts"], {
            "e": (lambda: X.ema(0.2), ["close"]), "adj": (lambda: X.ema(0.2, True), ["close"]), "var": (lambda: X.ewma_variance(10), ["close"]), "rsi": (X.rsi, ["close"]),
        }).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    x = pd.Series(close)
    for symbol in "ab":
        own = made[made.symbol == symbol].sort_values("ts").reset_index(drop=True)
        assert np.allclose(own.e, x.ewm(alpha=0.2, adjust=False).mean())
        assert np.allclose(own["adj"], x.ewm(alpha=0.2).mean())
        assert np.allclose(own["var"], (x**2).ewm(halflife=10, min_periods=5).mean(), equal_nan=True)
        assert own.rsi.notna().sum() == 300 - 14 and own.rsi.dropna().between(0, 100).all()


def run(kernel, *columns):
    return [kernel(*row) for row in zip(*columns, strict=True)]


def test_indicator_warm_ups():
    x = (100 + np.random.default_rng(2).normal(size=120).cumsum()).tolist()
    high, low = [v + 1 for v in x], [v - 1 for v in x]
    first = lambda values: int(np.flatnonzero(~np.isnan(values))[0])
    assert first(run(X.rsi(14), x)) == 14
    assert first(run(X.macd(), x)) == 33
    assert first(run(X.atr(14), high, low, x)) == 14
    assert first(run(X.adx(14), high, low, x)) == 27
    assert first(run(X.trix(14), x)) == 40
    assert first(run(X.parabolic_sar(), high, low)) == 1
    rising = list(map(float, range(60)))
    sar = run(X.parabolic_sar(), [v + 1 for v in rising], rising)
    assert all(s <= v for s, v in zip(sar[1:], rising[1:], strict=True))
    assert run(X.rsi(14), rising)[-1] == 100


def test_vpin_stays_in_range():
    rng = np.random.default_rng(4)
    price, volume = (50 + rng.normal(size=400).cumsum()).tolist(), rng.integers(0, 40, 400).astype(float).tolist()
    found = np.array(run(X.vpin(), price, volume))
    assert np.isnan(found[0]) and (found[~np.isnan(found)] >= 0).all() and (found[~np.isnan(found)] <= 1.5).all() and np.isfinite(found[-50:]).all()


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ({"mode": "threshold"}, [1, 1, 0, -1, -1, 0, 1, 1, 0, 0]),
        ({"mode": "fixed", "forward": 2}, [1, 1, -1, -1, -1, -1, 1, 1, 0, 0]),
        ({"mode": "hybrid", "forward": 1}, [1, 1, -1, -1, -1, 1, 1, 0, 0, 0]),
        ({"mode": "threshold", "stop": 5.0}, [1, 0, -1, -1, -1, 0, 1, 1, 0, 0]),
    ],
)
def test_position_modes(how, expected):
    nan = float("nan")
    prediction = [1, 2, -1, -2, -3, 1, 2, nan, 0, 0]
    price = [100.0, 95, 96, 97, 97, 97, 97, 97, 97, 97]
    found = run(X.position(**how), map(float, prediction), [0.0] * 10, price)
    assert found == expected and set(found) <= {-1, 0, 1}


# --- joins


def test_asof_and_offsets_equal_merge_asof(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"symbol": rng.choice(list("ab"), 80), "ts": [T0 + timedelta(minutes=int(m)) for m in rng.choice(6000, 80, replace=False)]}).sort_values("ts")
    right = pd.DataFrame({"symbol": rng.choice(list("ab"), 60), "ts": [T0 + timedelta(minutes=int(m)) for m in rng.choice(6000, 60, replace=False)], "v": rng.normal(size=60)}).sort_values("ts")
    left.iloc[3, 1] = right[right.symbol == left.iloc[3, 0]].iloc[2, 1]
    left = left.sort_values("ts")
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    for strict in (False, True):
        found = joins.asof_backward(a, b, ["symbol"], columns=["v"], strict=strict).toPandas().sort_values(["ts", "symbol"]).v.to_numpy(float)
        expected = pd.merge_asof(left, right, on="ts", by="symbol", allow_exact_matches=not strict).sort_values(["ts", "symbol"]).v.to_numpy(float)
        assert np.allclose(found, expected, equal_nan=True)
    made = joins.asof_offsets(a, b, ["symbol"], "v", (1, 12)).toPandas().sort_values(["ts", "symbol"])
    for hours in (1, 12):
        moved = left.assign(at=left.ts - pd.Timedelta(hours=hours)).sort_values("at")
        expected = pd.merge_asof(moved, right.rename(columns={"ts": "at"}), on="at", by="symbol").sort_values(["ts", "symbol"]).v.to_numpy(float)
        assert np.allclose(made[f"ago_{hours}"].to_numpy(float), expected, equal_nan=True)


def test_offsets_keep_repeated_probes(spark):
    probe = spark.createDataFrame([("a", T0, 1), ("a", T0, 1), ("a", T0, 2), (None, T0, 3)], "symbol string, ts timestamp, other int")
    tape = spark.createDataFrame([("a", T0 - timedelta(hours=2), 5.0), (None, T0 - timedelta(hours=9), 7.0)], "symbol string, ts timestamp, v double")
    found = joins.asof_offsets(probe, tape, ["symbol"], "v", (1, 4))
    assert sorted((r.other, r.ago_1, r.ago_4) for r in found.collect()) == [(1, 5.0, None), (1, 5.0, None), (2, 5.0, None), (3, 7.0, 7.0)]


def test_one_to_one_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        joins.one_to_one(a, a.union(a).withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(Exception, match="repeated"):
        clean.unique_keys(a.union(a), ["k"]).collect()


# --- bars


def test_allocation_never_exceeds_the_increment(spark):
    rng = np.random.default_rng(6)
    rows = [("a", T0.date(), T0 + timedelta(seconds=i), i, int(c), float(rng.integers(9, 12)), int(rng.integers(0, 9)), float(rng.integers(12, 15)), int(rng.integers(0, 9))) for i, c in enumerate(rng.integers(-3, 9, 200).cumsum())]
    ticks = spark.createDataFrame(rows, "symbol string, trading_date date, ts timestamp, seq int, cum_volume int, b1 double, b1_v int, a1 double, a1_v int")
    found = B.allocate(B.pressure(B.increments(ticks))).toPandas()
    assert (found.dv >= 0).all() and (found.buy + found.sell <= found.dv + 1e-9).all() and np.allclose(found.delta, found.buy - found.sell)
    absent = B.pressure(ticks.withColumns({"b2": F.lit(0.0), "b2_v": F.lit(0), "a2": F.lit(None).cast("double"), "a2_v": F.lit(0)}), (2,))
    assert absent.where("sell_raw_2 is not null or buy_raw_2 is not null").count() == 0


def test_trading_minutes(spark):
    times = {"21:00": 0, "22:59": 119, "23:00": None, "09:00": 120, "10:14": 194, "10:15": None, "10:30": 195, "13:30": 255, "14:59": 344, "15:00": None}
    rows = spark.createDataFrame([(datetime(2024, 1, 2, *map(int, t.split(":"))), t) for t in times], "ts timestamp, t string")
    assert {r.t: r.m for r in rows.select("t", B.trading_minute(F.col("ts")).alias("m")).collect()} == times
    assert B.trading_periods(60)[-1] == (5, 300, 345)


# --- labels and models


def test_reversal_label_and_folds(spark):
    price = [100.0, 101.0, 102.0, 104.0, 90.0, 130.0, 131.0, 132.0]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(price)], "symbol string, ts int, p double")
    found = [r.y for r in df.select("ts", L.forward_return(Series(), "p", 1, 3).alias("y")).orderBy("ts").collect()]
    assert found[0] == pytest.approx(-0.10) and found[7] is None
    rows = spark.createDataFrame([("a", i) for i in range(130)], "symbol string, rn long")
    folds = L.walk_forward_folds(rows, ["symbol"], 50, 30, 3).orderBy("fold").collect()
    assert [(f.fold, f["first"], f["last"], f.begin, f.end) for f in folds] == [(0, 0, 42, 50, 80), (1, 22, 72, 80, 110), (2, 52, 102, 110, 130)]


@pytest.mark.parametrize("name", list(L.MODELS))
def test_models_recover_a_line(name):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.01
    beta = L.partial_least_squares(x, y, 3) if name == "pls" else L.MODELS[name](x, y)
    assert np.allclose(beta, [1.5, 2, -1, 0], atol=0.02)


def test_lasso_drops_what_does_not_matter():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    beta = L.elastic_net(x, x[:, 0] * 3 + rng.normal(size=300) * 0.1, 0.5)
    assert beta[1] == pytest.approx(2.5, abs=0.1) and (beta[2:] == 0).all()


# --- selection, ensembles, metrics


def test_clusters_and_greedy_pick():
    near, far = 0.1, 0.9
    d = np.array([[0, near, far, far], [near, 0, far, far], [far, far, 0, near], [far, far, near, 0]])
    for method in ("ward", "average"):
        labels = C.linkage_clusters(d, 2, method=method)
        assert labels[0] == labels[1] != labels[2] == labels[3]
    assert len(set(C.linkage_clusters(d, height=0.5, method="average"))) == 2
    assert C.greedy_diverse({"a": 1.0, "b": 0.9, "c": 0.1}, {("a", "b"): 0.99, ("a", "c"): 0.0, ("b", "c"): 0.0}, 2) == ["a", "c"]


def test_strength_map():
    assert C.parse_strength_map("0.2-0.5:0.7, 0.5-1:1") == [(0.2, 0.5, 0.7), (0.5, 1.0, 1.0)]
    assert C.parse_strength_map("0.5-1:1,0.2-0.5:0.7") == [(0.2, 0.5, 0.7), (0.5, 1.0, 1.0)] and C.parse_strength_map(" ") == []
    for bad in ("0.5-0.2:1", "a-b:1", "0.1-0.6:1,0.5-1:2", "0.2-0.5:7"):
        with pytest.raises(ValueError):
            C.parse_strength_map(bad)


def test_metrics_of_odd_series(spark):
    day = lambda i: (T0 + timedelta(days=i)).date()
    rows = [("win", day(i), 0.01, 0.0, True, 1) for i in range(5)] + [("none", day(i), 0.0, 0.01, False, 0) for i in range(5)] + [("one", day(0), -0.02, 0.0, True, 1)]
    found = {r.symbol: r for r in P.metrics(spark.createDataFrame(rows, "symbol string, date date, r double, b double, active boolean, trades int"), ["symbol"]).collect()}
    assert found["win"].win_rate == 1 and found["win"].max_drawdown == 0 and found["win"].calmar is None and found["win"].profit_loss is None
    assert found["none"].sharpe == 0 and found["none"].win_rate is None and found["none"].total_return == 0
    assert found["one"].total_return == pytest.approx(-0.02) and found["one"].max_drawdown == 0


# --- sources and sinks


def test_tick_files_and_sinks(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 9, 0, s), 1.0 * s, s, 2.0, 3, 1.0, 5, 2.0, 6) for d in (1, 2, 3) for s in range(4)]
    names = ["datetime", "last", "volume", "total_turnover", "open_interest", "b1", "b1_v", "a1", "a1_v"]
    for d in (1, 2, 3):
        pd.DataFrame([r for r in rows if r[0].day == d], columns=names).to_parquet(tmp_path / f"P_tick_2024-01-0{d}.parquet", coerce_timestamps="us")
    found = readers.read_ticks(spark, str(tmp_path), "2024-01-02")
    assert found.count() == 8 and found.where("b5 is not null").count() == 0 and "a5_v" in found.columns
    writers.write_table(found.withColumn("symbol", F.lit("P")), str(tmp_path / "out"), ("symbol", "trading_date"))
    assert [r.symbol for r in readers.symbols(spark, str(tmp_path / "out")).collect()] == ["P"]
    writers.write_csv_tail(found.withColumn("ts", F.col("datetime")).select("ts", "last"), str(tmp_path / "tail"), rows=3)
    assert spark.read.option("header", "true").csv(str(tmp_path / "tail")).count() == 3
    bars = spark.createDataFrame([(T0, 1.5)], "ts timestamp, x double")
    writers.write_results(bars, str(tmp_path / "results"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "results")).columns == ["datetime", "date", "time", "x"]
    writers.write_report(bars, {"fwd": 3}, str(tmp_path / "report"))
    assert {"fwd": 3} in [json.loads(r.value) for r in spark.read.text(str(tmp_path / "report")).collect()]


def test_selection_sinks_and_resume(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "set_id string, score double")
    writers.write_selection(str(tmp_path / "s"), table, table, table, [{"rank": 1, "factors": ["a"]}, {"rank": 2, "factors": ["b"]}], table)
    assert {p.name for p in (tmp_path / "s").iterdir()} == {"ranking", "clusters", "trials", "signal_corr", "best"}
    assert [json.loads(r.value)["rank"] for r in spark.read.text(str(tmp_path / "s" / "best")).collect()] == [1, 2]
    state, schema = str(tmp_path / "state"), "set_id string, score double"
    assert writers.resume_trials(spark, state, schema).count() == 0
    writers.save_trials(spark, state, table)
    writers.save_trials(spark, state, spark.createDataFrame([("a", 3.0), ("c", 0.5)], schema))
    assert {tuple(r) for r in writers.resume_trials(spark, state, schema).collect()} == {("a", 3.0), ("b", 2.0), ("c", 0.5)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("date,x_名,y_close\n2024-01-01,#NAME?,1.5\n2024-01-02,2,x\n".encode("gbk"))
    df = readers.with_index(readers.read_csv(spark, str(tmp_path / "g.csv")))
    assert [(r["x_名"], r.y_close) for r in df.orderBy("ts").collect()] == [(None, 1.5), (2.0, None)]
    # Each file is decoded as a whole: the bytes that tell may come late, and files may differ.
    before = {k: v for k, v in spark.conf.getAll.items()}
    folder = tmp_path / "many"
    folder.mkdir()
    ascii_rows = "".join(f"2024-01-01,{i},a\r\n" for i in range(20_000))
    (folder / "a.csv").write_bytes(("date,x_v,name\r\n" + ascii_rows + '2024-01-02,1,"名, 字"\r\n').encode("gbk"))
    (folder / "b.csv").write_bytes("\ufeffdate,x_v,name\n,2,é\n\n".encode())
    (folder / "c.csv").write_bytes("date,x_v,name\n2024-01-04,3,".encode() + b"\xff\xe9 end\n")
    (folder / "d.csv").write_bytes("date,x_v,name\n2024-01-05,4,\U00020000\n".encode("gb18030"))
    many = readers.read_csv(spark, str(folder))
    assert many.count() == 20_004 and [f.dataType.simpleString() for f in many.schema] == ["string"] * 3
    assert {r.name for r in many.where("name <> 'a'").collect()} == {"名, 字", "é", "ÿé end", "\U00020000"}
    typed = readers.read_csv(spark, str(folder / "d.csv"), ["x_v"], "date date, x_v int, name string")
    assert [tuple(r) for r in typed.collect()] == [(4,)] and {k: v for k, v in spark.conf.getAll.items()} == before
    (tmp_path / "gaps.csv").write_text("date,x_v\n,0\n2024-01-01,1\n,2\nnothing,3\n,4\n2024-01-03,5\n")
    filled = {r.x_v: r.ts and str(r.ts)[:10] for r in readers.with_index(readers.read_csv(spark, str(tmp_path / "gaps.csv"))).collect()}
    assert filled == {0.0: None, 1.0: "2024-01-01", 2.0: "2024-01-01", 3.0: None, 4.0: None, 5.0: "2024-01-03"}
    with pytest.raises(ValueError):
        readers.with_index(df.drop("ts"))
    assert readers.parse_run_config('{"close_threshold": "[0.0, 0.5]", "mode": "rolling"}') == {"close_threshold": [0.0, 0.5], "mode": "rolling"}
    assert readers.parse_path_list("# all\na.json ^\nb.json # second\n\n") == [("a.json", True), ("b.json", False)]


def test_csv_header_in_its_own_encoding_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a\xf1o,x\n1,\xff\xe9\n2,plain\n".encode("latin1"))
    one = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert one.columns == ["a\xf1o", "x"] and sorted(map(tuple, one.collect())) == [("1", "\xff\xe9"), ("2", "plain")]
    (tmp_path / "b.csv").write_text('x,more,a\xf1o\n"p,q",m,3\nr,n,4\n')
    (tmp_path / "c.csv").write_text("\n\na\xf1o\n5\n")
    both = readers.read_csv(spark, str(tmp_path))
    assert both.columns == ["a\xf1o", "x", "more"]
    assert sorted(map(tuple, both.collect()), key=str) == sorted([("1", "\xff\xe9", None), ("2", "plain", None), ("3", "p,q", "m"), ("4", "r", "n"), ("5", None, None)], key=str)
    typed = readers.read_csv(spark, str(tmp_path), schema="`a\xf1o` int, x int, none double")
    assert sorted(map(tuple, typed.collect())) == [(k, None, None) for k in range(1, 6)]


def test_cleaning(spark):
    df = spark.createDataFrame([("a", i, x, None, "q") for i, x in enumerate([1.0, float("inf"), None, 4.0])], "symbol string, ts int, x_a double, x_b double, other string")
    assert clean.complete_rows(df, ["x_a"]).count() == 2
    assert "x_b" not in clean.drop_empty_columns(df, ["x_a", "x_b"]).columns
    assert clean.project(df, "x_", ["other", "x_a", "absent"]).columns == ["x_a", "x_b", "other"]
    assert clean.lag_expand(df, ["x_a"], Series(), per_column={"x_a": 3}).columns[-2:] == ["x_a_1", "x_a_2"]
    assert clean.deltas(df, ["x_a"], Series()).count() == 3


@pytest.mark.parametrize("name", ["b8_fill", "b21_normal_cdf"])
def test_tick_windows_are_by_symbol_and_day(spark, sf_dir, name):
    """No window has all ticks of a symbol in one partition: windows over the symbol alone take rows a day."""
    from fathom import catalog

    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert all("_key#" in w or "trading_date#" in w for w in windows), windows


def test_carried_equals_whole_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(s, k // 10, k, None if rng.random() < 0.4 or k < 12 else float(rng.integers(0, 9))) for s in ("a", "b") for k in range(60)]
    rows += [(None, 1, 1, 2.0), ("c", 1, 1, None), ("a", None, 100, 3.0)]
    rows = [(s, d, k - 200 if d is None else k, v) for s, d, k, v in rows]
    found = clean.carried(spark.createDataFrame(rows, "symbol string, day int, k int, x double").repartition(5), "symbol", "day", ["k"], "x").collect()
    assert len(found) == len(rows)
    for r in found:
        own = [v for s, _, _, v in sorted(rows, key=lambda q: q[2]) if s == r.symbol and v is not None]
        seen = [v for s, _, k, v in sorted(rows, key=lambda q: q[2]) if s == r.symbol and v is not None and k <= r.k]
        assert (r["last"], r["first"]) == (seen[-1] if seen else None, own[0] if own else None)
        assert r.running_mean == (pytest.approx(sum(seen) / len(seen)) if seen else None)
        assert r["mean"] == (pytest.approx(sum(own) / len(own)) if own else None)


def test_correlations_take_every_component(spark, sf_dir):
    from fathom import catalog

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 40)) + 1000
    x[:, 39] = x[:, 0] + 0.1 * x[:, 39]
    rows = [([None if i == 3 and j == 5 else float(v) for j, v in enumerate(r)],) for i, r in enumerate(x)] + [(None,)]
    found = {(r.a, r.b): r["corr"] for r in C.column_correlations(spark.createDataFrame(rows, "v array<double>").repartition(3), "v").collect()}
    assert len(found) == 40 * 39 // 2
    for (a, b), c in found.items():
        keep = np.arange(200) != (3 if 5 in (a, b) else -1)
        assert abs(c - np.corrcoef(x[keep, a], x[keep, b])[0, 1]) < 1e-9
    assert catalog.QUERIES["j11_factor_clusters"](spark, sf_dir).count() == 64


def test_vpin_equals_pouring_by_units():
    """Volumes in whole units and equal, so that buckets can be filled one unit at a time."""
    rng = np.random.default_rng(8)
    price = (50 + rng.normal(size=120).cumsum()).tolist()
    n, unit = 4, 6.0
    found = run(X.vpin(buckets=n, window=50), price, [unit] * 120)
    ring, at, done, var = [[0.0, 0.0] for _ in range(n)], 0, 0, 0.0
    for i, p in enumerate(price):
        change = p - price[i - 1] if i else 0.0
        var = change**2 if i < 2 else 0.2 * change**2 + 0.8 * var
        buy = 0.5 * (1 + math.erf(change / max(math.sqrt(max(var, 1e-16)), 1e-8) / math.sqrt(2))) if i else 0.5
        for _ in range(int(unit)):
            ring[at][0] += buy
            ring[at][1] += 1 - buy
            if sum(ring[at]) >= n * unit - 1e-9:
                at, done = (at + 1) % n, done + 1
                ring[at] = [0.0, 0.0]
        total = n * n * unit if done >= n else sum(map(sum, ring))
        expected = sum(abs(b - s) for b, s in ring) / total if done else None
        assert found[i] == pytest.approx(expected) if done else np.isnan(found[i])


def test_vpin_survives_falling_volume():
    volume = [100.0] * 30 + [1.0] * 200 + [float("nan"), 0.0] + [500.0] * 5
    found = run(X.vpin(buckets=5, window=20), np.linspace(1, 2, len(volume)).tolist(), volume)
    assert np.isfinite(found[40:]).all() and found[231] == found[230] == found[229]


def test_slot_vpin_reads_shares_of_volume():
    prices, volumes = np.array([1.0, 1.0, 2.0, 1.0, 3.0, 2.0]), np.array([2.0, 2.0, 3.0, 5.0, 0.0, 8.0])
    # Unit by unit: each tick's signed share, in the last four fifths of all volume.
    change = np.diff(prices, prepend=prices[0])
    var, tilt = 0.0, []
    for i, c in enumerate(change):
        var = 0.2 * c * c + 0.8 * var if i >= 2 else 0.0
        tilt.append(math.erf(c / math.sqrt(max(var, 1e-16)) / math.sqrt(2)) if i >= 2 else 0.0)
    units = np.repeat(tilt, (volumes * 100).astype(int)).reshape(5, -1)
    assert X.slot_vpin(prices, volumes) == pytest.approx(np.abs(units.sum(1))[1:].sum() / units[1:].size, abs=1e-6)
    assert math.isnan(X.slot_vpin(prices[:2], volumes[:2])) and math.isnan(X.slot_vpin(prices, 0 * volumes))


def test_vote_strength_goes_through_intervals(spark):
    def slow(longs, shorts, n, intervals):
        out = 0.0
        for k, (low, high, size) in enumerate(intervals):
            inside = lambda x: low <= x <= high if k == len(intervals) - 1 else low <= x < high  # noqa: B023, E731
            if inside(longs / n):
                out = size
            if shorts and inside(shorts / n):
                out = -size
        return (abs(out) if longs >= shorts else -abs(out)) if longs and shorts else out

    rows = [(a, b, 7) for a in range(8) for b in range(8 - a)]
    df = spark.createDataFrame(rows, "l int, s int, n int")
    for text in ("0.2-0.5:0.7,0.5-1:1", "0.5-1:1,0.1-0.3:0.4", "0-0.4:0.5", ""):
        intervals = C.parse_strength_map(text)
        made = df.select("l", "s", C.vote_strength(F.col("l"), F.col("s"), F.col("n"), intervals, 3).alias("p")).collect()
        for r in made:
            plain = -1.0 if r.s >= 3 else 1.0 if r.l >= 3 else 0.0
            assert r.p == (slow(r.l, r.s, 7, intervals) if intervals else plain), (text, r)


def test_night_ticks_belong_to_the_next_trading_date(spark):
    rows = [("2024-01-05 10:00:00",), ("2024-01-05 21:30:00",), ("2024-01-06 22:00:00",), ("2024-01-08 09:00:00",), ("2024-01-08 22:59:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("trading_date"))
    found = {str(r.ts): str(r.trading_date) for r in B.with_trading_date(df).collect()}
    assert found == {"2024-01-05 10:00:00": "2024-01-05", "2024-01-05 21:30:00": "2024-01-08", "2024-01-06 22:00:00": "2024-01-08", "2024-01-08 09:00:00": "2024-01-08", "2024-01-08 22:59:00": "2024-01-09", "None": "None"}


def test_carried_values_cross_days(spark):
    rng = np.random.default_rng(6)
    rows = [(None if k % 9 == 0 else f"s{k % 3}", int(d), k, None if rng.random() < 0.5 else float(k)) for k in range(90) for d in [rng.integers(0, 6)]]
    df = spark.createDataFrame(rows, "symbol string, day int, seq int, x double")
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for strict in (False, True):
        for ahead in (False, True):
            found = {r.seq: r.y for r in clean.carried_value(df, ["symbol"], "day", ["seq"], "x", "y", strict, ahead).collect()}
            for i, r in enumerate(ordered):
                there = ordered[i + strict :] if ahead else ordered[: i + 1 - strict][::-1]
                assert found[r[2]] == next((o[3] for o in there if o[0] == r[0] and o[3] is not None), None)


def test_looking_ahead_takes_frames_that_grow(spark, sf_dir):
    """Spark sums up a frame that shrinks anew for each row, so a day of many ticks would cost their square."""
    from fathom import catalog

    rows = spark.createDataFrame([(i, i if i % 3 == 1 else None) for i in range(8)], "k int, x int").withColumn("symbol", F.lit("a"))
    filled = rows.withColumn("y", Series(("symbol",), ("k",)).bfill("x"))
    assert [r.y for r in filled.orderBy("k").collect()] == [1, 1, 4, 4, 4, 7, 7, 7]
    for made in (filled, catalog.QUERIES["c6_irregular_intervals"](spark, sf_dir)):
        frames = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "windowframe" in line]
        assert frames and not [f for f in frames if "currentrow$(), unboundedfollowing$()" in f or "1, unboundedfollowing$()" in f]


def test_residual_on_a_set_and_cluster_picks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=260)
    rows = [("s" if i < 200 else "few", i, float(a), None if i % 50 == 7 else float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, i int, a double, b double, y double").withColumn("twin", F.col("a") * 2)
    found = {r.i: r.residual for r in C.residual_on(df, ["symbol"], "y", ["a", "b", "twin"]).collect()}
    own = np.array([i < 200 and i % 50 != 7 for i in range(260)])
    beta = np.linalg.lstsq(x[own], y[own], rcond=None)[0]
    for i in range(260):
        want = y[i] if i >= 200 else None if i % 50 == 7 else y[i] - x[i] @ beta
        assert (found[i] is None) == (want is None) and (want is None or abs(found[i] - want) < 1e-8)
    assert C.cluster_picks({"a": 0.5, "b": 0.9, "c": 0.01, "d": 0.9}, {"a": 0, "b": 0, "c": 1, "d": 0}, 2, 0.1) == [(0, 3, "b", 0.9, "b | d")]
    distance = np.array([[0, 0.1, 0.2, 0.9], [0.1, 0, 0.1, 0.9], [0.2, 0.1, 0, 0.9], [0.9, 0.9, 0.9, 0]])
    assert C.medoids(distance, [0, 0, 0, 1]) == [(0, 3, 1), (1, 1, 3)]
