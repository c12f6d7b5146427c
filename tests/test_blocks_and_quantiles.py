from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import blocks, scan
from fathom.operators.quantiles import exact_quantiles

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(1)
    n = 1500
    rows = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.9, "hot", "x"), "ts": [T0 + timedelta(minutes=int(m)) for m in rng.integers(0, 12_000, n)], "seq": range(n), "price": np.round(rng.normal(50, 5, n), 3)})
    rows.loc[rng.random(n) < 0.1, "price"] = np.nan
    rows.loc[rows.ts < T0 + timedelta(minutes=700), "price"] = np.nan  # a first block with nearly no value
    return spark.createDataFrame(rows).withColumn("price", F.when(~F.isnan("price"), F.col("price"))).withColumn("day", F.to_date("ts")).repartition(7)


def test_blocks_equal_the_serial_scan(ticks):
    order = ["ts", "seq"]
    serial = scan.ordered_scan(ticks, ["symbol"], order, {"ema": (lambda: scan.ema(0.1), ["price"]), "wilder": (lambda: scan.wilder(14), ["price"]), "slow": (lambda: scan.wilder(400), ["price"])})
    want = serial.toPandas().set_index("seq").sort_index()
    for made, name in (
        (blocks.block_ema(ticks, ["symbol"], "day", order, "price", 0.1, "out"), "ema"),
        (blocks.block_wilder(ticks, ["symbol"], "day", order, "price", 14, "out"), "wilder"),
        (blocks.block_wilder(ticks, ["symbol"], "day", order, "price", 400, "out"), "slow"),  # the seed ends blocks later
    ):
        found = made.toPandas().set_index("seq").sort_index()
        assert len(found) == len(want) and np.allclose(found.out.astype(float), want[name].astype(float), equal_nan=True), name
        assert made.columns == [*ticks.columns, "out"]


def test_one_key_is_spread_over_its_blocks(spark, ticks):
    made = blocks.block_ema(ticks.where("symbol = 'hot'"), ["symbol"], "day", ["ts", "seq"], "price", 0.1, "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=999), "b": np.round(rng.normal(size=500)), "c": np.exp(20 * rng.normal(size=800)), "d": np.array([3.0]), "e": np.full(50, -1.5), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("b", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for parts in (64, 4096):
        found = {(r.k, r.share): r.value for r in exact_quantiles(df, ["k"], "x", shares, parts).collect()}
        assert set(found) == {(k, q) for k in values for q in shares}
        for (k, q), v in found.items():
            assert v == pytest.approx(np.quantile(values[k], q), rel=1e-12, abs=1e-12), (k, q)
    wide = spark.createDataFrame([(v,) for v in (1e308, -1e308, float("inf"), 0.0, float("-inf"), 5.0, 7.0)], "x double").withColumn("k", F.lit(1))
    assert {r.share: r.value for r in exact_quantiles(wide, ["k"], "x", (0.0, 0.5, 1.0)).collect()} == {0.0: float("-inf"), 0.5: 5.0, 1.0: float("inf")}
    assert exact_quantiles(df.where("false"), ["k"], "x", shares).count() == 0
