import os
import pickle
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom import catalog
from fathom.streaming import bars, keyed

NAMES = ("n2_streaming_tumbling_bars", "n3_streaming_sliding_vwap", "n4_streaming_session_bars", "n5_streaming_ema")


@pytest.fixture(scope="module")
def part_files(spark, sf_dir, tmp_path_factory):
    """The ticks as a table of 25 part files, each with ticks of all times."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(25).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_part_files_stream_like_one_file(spark, sf_dir, part_files, name):
    one, many = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (sf_dir, part_files))
    assert one and one == many


@pytest.fixture
def timely(spark, sf_dir, tmp_path):
    """The ticks as files in order of time, one to a micro-batch, and a stream of them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    folder = tmp_path / "timely"
    folder.mkdir()
    for k in range(6):
        part = rows.iloc[k * len(rows) // 6 : (k + 1) * len(rows) // 6].sample(frac=1, random_state=k)
        part.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    raw = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("user_id").alias("size"))
    return rows, stream, folder


def test_keyed_state_equals_batch_over_several_micro_batches(spark, timely, tmp_path):
    rows, stream, _ = timely
    how = {"alpha": 0.2, "band": 20.0, "volume": 300.0, "buckets": 3}
    with keyed.rocksdb(spark):
        found = bars.run_once(keyed.keyed_ticks(stream, **how), str(tmp_path / "state"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    found = {(r.symbol, r.seq): (r.change, r.ema, r.position, r.vpin) for r in found.collect()}
    want = {r[:2]: r[2:] for r in keyed.batch_ticks(list(zip(rows.event_type, rows.event_id, rows.value, rows.user_id, strict=True)), **how)}
    passed = rows.ts.max() - pd.Timedelta(minutes=10)
    due = [(s, i) for s, i, t in zip(rows.event_type, rows.event_id, rows.ts, strict=True) if t.floor("h") + pd.Timedelta(hours=1) <= passed]
    assert set(found) == set(due) and len(due) > 900
    assert {p for *_, p, _ in found.values()} == {-1.0, 0.0, 1.0} and any(v is not None for *_, v in found.values())
    for key in due:
        assert found[key] == pytest.approx(want[key]), key


def test_calendar_rows_added_between_batches_take_effect(spark, timely, tmp_path):
    rows, stream, folder = timely
    day = lambda k: [(f"p{k}", (rows.ts.iloc[k * len(rows) // 6] - pd.Timedelta(seconds=1)).to_pydatetime(), rows.ts.iloc[(k + 1) * len(rows) // 6 - 1].to_pydatetime())]
    schema = "period string, start_ts timestamp, end_ts timestamp"
    calendar, out = str(tmp_path / "calendar"), str(tmp_path / "out")
    spark.createDataFrame(day(0), schema).write.parquet(calendar)
    late = [folder / f"{k}.parquet" for k in range(3, 6)]
    for f in late:
        f.rename(f.with_suffix(".later"))
    first = bars.with_calendar(stream, calendar, out)
    assert {r.period for r in first.select("period").distinct().collect()} == {"p0"}
    spark.createDataFrame(day(4), schema).write.mode("append").parquet(calendar)
    for f in late:
        f.with_suffix(".later").rename(f)
    both = bars.with_calendar(stream, calendar, out)
    n = {r.period: r.n for r in both.groupBy("period").agg(F.count("*").alias("n")).collect()}
    assert n == {"p0": len(rows) // 6, "p4": 5 * len(rows) // 6 - 4 * len(rows) // 6}


class Kept(dict):
    """A map state in memory that counts the bytes written to it."""

    written = 0

    def updateValue(self, key, value):  # noqa: N802
        Kept.written += len(pickle.dumps(value))
        self[key] = value

    getValue, containsKey, removeKey = dict.get, dict.__contains__, dict.pop  # noqa: N815


class Handle:
    def __init__(self):
        self.timers, self.value = [], None

    def getMapState(self, *_):  # noqa: N802
        return Kept()

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, end):  # noqa: N802
        self.timers.append(end)


def test_taking_in_a_part_does_not_write_the_waiting_ticks_again(monkeypatch):
    monkeypatch.setattr(keyed, "HELD", 100, raising=False)
    rng, n = np.random.default_rng(5), 20_000
    ticks = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n), "s"), "seq": np.arange(n), "price": rng.integers(0, 90, n) / 4, "size": rng.integers(0, 5000, n) * 1.0})
    how, handle = {"alpha": 0.2, "band": 5.0, "volume": 300.0, "buckets": 3}, Handle()
    processor = keyed.TickProcessor(*how.values(), 3_600_000)
    processor.init(handle)
    Kept.written = 0
    assert not list(processor.handleInputRows(("a",), (ticks.iloc[k : k + 50] for k in range(0, n, 50)), None))
    assert Kept.written < 100 * n
    out = pd.concat(f for end in sorted(handle.timers) for f in processor.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda e=end: e)))
    ordered = ticks.sort_values("ts")
    want = pd.DataFrame(keyed.batch_ticks([("a", *r) for r in zip(ordered.seq, ordered.price, ordered["size"], strict=True)], **how), columns=out.columns)
    pd.testing.assert_frame_equal(out.reset_index(drop=True), want, check_dtype=False)


def test_a_tick_of_many_buckets_is_poured_at_once():
    state = keyed.TickState()
    assert [state.step(price, size, 0.1, 5.0, 10.0, 3)[-1] for price, size in ((1.0, 4.0), (0.5, 1e12), (2.0, 7.0))] == [None, 1.0, pytest.approx((1 + 1 + 0.2) / 3)]
