"""Keyed state over streams: increments, exponential mean, position and volume-synchronised imbalance.

A symbol's ticks arrive in any order.  They wait in cells of time, and a cell is worked on when
its event-time timer fires, that is once the watermark has passed its end: its ticks are put in
order and go through ``TickState``, which is a few numbers.  Input is taken in by parts, and what
is in memory at once is ``HELD`` ticks or one cell, never all ticks of a symbol.  A cell is stored in
parts that are only written and read once, so that taking in a tick costs the same however many wait.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import astuple, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, seq long, change double, ema double, position double, vpin double"
STATE = "last double, mean double, position double, filled double, bought double, shares array<double>"
TICK = np.dtype([("ts", "<i8"), ("seq", "<i8"), ("price", "<f8"), ("size", "<f8")])
#: Ticks that a task takes in before it stores them by cell.
HELD = 500_000


@dataclass
class TickState:
    """What one symbol's past leaves.  ``step`` takes the next tick.

    change: price less the one before.  ema: exponential mean.  position: 1 or -1 once the price
    is ``band`` above or below the mean, kept until the other side.  vpin: mean absolute
    imbalance of the last ``buckets`` buckets of ``volume``, ticks bought if the price has not
    fallen; missing until so many buckets are full.
    """

    last: float | None = None
    mean: float | None = None
    position: float = 0.0
    filled: float = 0.0
    bought: float = 0.0
    shares: list[float] = field(default_factory=list)

    def step(self, price: float, size: float, alpha: float, band: float, volume: float, buckets: int) -> tuple[float | None, float, float, float | None]:
        change = None if self.last is None else price - self.last
        self.mean = price if self.mean is None else self.mean + alpha * (price - self.mean)
        if abs(price - self.mean) > band:
            self.position = 1.0 if price > self.mean else -1.0
        left, buying = size, change is None or change >= 0
        while left > 0:
            if not self.filled and left >= volume:  # whole buckets, all bought or all sold
                whole, left = divmod(left, volume)
                self.shares = [*self.shares, *[1.0] * int(min(whole, buckets))][-buckets:]
                continue
            part = min(left, volume - self.filled)
            self.filled += part
            self.bought += part if buying else 0.0
            left -= part
            if self.filled >= volume:
                self.shares = [*self.shares, abs(2 * self.bought - volume) / volume][-buckets:]
                self.filled = self.bought = 0.0
        self.last = price
        return change, self.mean, self.position, sum(self.shares) / buckets if len(self.shares) == buckets else None


class TickProcessor(StatefulProcessor):
    def __init__(self, alpha: float, band: float, volume: float, buckets: int, cell_ms: int):
        self.how, self.cell_ms = (alpha, band, volume, buckets), cell_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", STATE)
        self.cells = handle.getMapState("cells", "cell long, part long", "ticks binary")
        self.parts = handle.getMapState("parts", "cell long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, stored = set(self.handle.listTimers()), {}
        held: list[np.ndarray] = []
        for part in rows:
            ticks = np.empty(len(part), TICK)
            ticks["ts"] = part.ts.astype("int64") // (1000 if part.ts.dt.unit == "ns" else 1)
            ticks["seq"], ticks["price"], ticks["size"] = part.seq.astype("int64"), part.price, part["size"]
            held.append(ticks)
            if sum(map(len, held)) >= HELD:
                self._store(np.concatenate(held), due, stored)
                held = []
        if held:
            self._store(np.concatenate(held), due, stored)
        yield from ()

    def _store(self, ticks: np.ndarray, due: set[int], stored: dict[int, int]) -> None:
        """Another part of every cell that ``ticks`` fall into, and a timer for each new one."""
        cells = ticks["ts"] // (1000 * self.cell_ms)
        order = np.argsort(cells, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            cell = int(cells[own[0]])
            if cell not in stored:
                stored[cell] = self.parts.getValue((cell,))[0] if self.parts.containsKey((cell,)) else 0
            self.cells.updateValue((cell, stored[cell]), (ticks[own].tobytes(),))
            stored[cell] += 1
            self.parts.updateValue((cell,), (stored[cell],))
            end = (cell + 1) * self.cell_ms
            if end not in due:
                self.handle.registerTimer(end)
                due.add(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Work on the cell that has ended; each has its own timer, and timers expire in order of time."""
        cell = expiredTimerInfo.getExpiryTimeInMs() // self.cell_ms - 1
        numbers = range(self.parts.getValue((cell,))[0])
        ticks = np.concatenate([np.frombuffer(self.cells.getValue((cell, k))[0], TICK) for k in numbers])
        for k in numbers:
            self.cells.removeKey((cell, k))
        self.parts.removeKey((cell,))
        ticks = ticks[np.lexsort((ticks["size"], ticks["price"], ticks["seq"], ticks["ts"]))]
        past = self.past.get() if self.past.exists() else None
        state = TickState(*past[:5], list(past[5])) if past is not None else TickState()
        made = [state.step(price, size, *self.how) for price, size in zip(ticks["price"].tolist(), ticks["size"].tolist(), strict=True)]
        self.past.update(astuple(state))
        out = pd.DataFrame(made, columns=["change", "ema", "position", "vpin"], dtype=float)
        out.insert(0, "symbol", key[0])
        out.insert(1, "seq", ticks["seq"])
        yield out


def keyed_ticks(ticks: DataFrame, alpha: float = 0.1, band: float = 5.0, volume: float = 500.0, buckets: int = 5, cell_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(symbol, seq, change, ema, position, vpin) of every tick whose cell the watermark has passed.

    Ticks later than the watermark are dropped before they get here.  ``ticks``: symbol, ts, seq,
    price, size.  Needs the state store of RocksDB, see ``rocksdb``.
    """
    own = ticks.withWatermark("ts", late).select("symbol", "ts", F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    processor = TickProcessor(alpha, band, volume, buckets, 60_000 * cell_minutes)
    made = own.groupBy("symbol").transformWithStateInPandas(processor, OUT, "Append", "EventTime")
    return made.select("symbol", "seq", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("change", "ema", "position", "vpin")))


@contextmanager
def rocksdb(spark) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as keyed processors must."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_ticks(rows: Sequence[tuple[str, int, float, float]], alpha: float = 0.1, band: float = 5.0, volume: float = 500.0, buckets: int = 5) -> list[tuple]:
    """The same for ticks (symbol, seq, price, size) that are in order already, in plain Python."""
    states: dict[str, TickState] = {}
    return [(symbol, seq, *states.setdefault(symbol, TickState()).step(price, size, alpha, band, volume, buckets)) for symbol, seq, price, size in rows]
