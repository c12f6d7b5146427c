"""Ordered scans: recurrences that no window expression can state.

Rows are dealt by key and sorted within partitions; a kernel then goes through each key's
rows batch by batch and carries its state over.  A key is worked on in order, as a
recurrence must be, but never held in memory as a whole.  All recurrences of a key that are
wanted together run in one scan.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
Kernel = Callable[..., float]


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, tuple[Callable[[], Kernel], Sequence[str]]]) -> DataFrame:
    """``df`` with one double column per output: a fresh kernel per key, called row by row.

    ``outputs``: name to (kernel factory, input columns).  A kernel gets the inputs as
    floats (NaN for NULL) and returns a float; NaN becomes NULL.
    """
    names = [c for c in df.columns if c not in outputs]
    inputs = sorted({c for _, columns in outputs.values() for c in columns})
    spare = {c: f"_in_{c}" for c in inputs}
    ready = df.select(*names, *(F.col(c).cast("double").alias(spare[c]) for c in inputs))
    ready = ready.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = df.select(*names).schema
    for name in outputs:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kernels = None, {}
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            owners = list(zip(*(batch.column(at[k]).to_pylist() for k in keys), strict=True))
            values = {c: batch.column(at[spare[c]]).to_numpy(zero_copy_only=False).astype(float).tolist() for c in inputs}
            out = {name: np.full(len(batch), NAN) for name in outputs}
            for i, owner in enumerate(owners):
                if owner != last:
                    last, kernels = owner, {name: make() for name, (make, _) in outputs.items()}
                for name, (_, columns) in outputs.items():
                    out[name][i] = kernels[name](*(values[c][i] for c in columns))
            made = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in out.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), *made], [*names, *outputs])

    return ready.mapInArrow(run, schema)


class SortedBlocks:
    """Values in order, in blocks of bounded size: to add, take away, count and pick takes little at any size."""

    def __init__(self, block: int = 512):
        self.block, self.blocks, self.tops = block, [], []

    def _at(self, x: float) -> int:
        return min(bisect_left(self.tops, x), len(self.tops) - 1)

    def add(self, x: float) -> None:
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = self._at(x)
        own = self.blocks[k]
        insort(own, x)
        if len(own) > 2 * self.block:
            self.blocks[k : k + 1] = [own[: self.block], own[self.block :]]
            self.tops[k : k + 1] = [own[self.block - 1], own[-1]]
        else:
            self.tops[k] = own[-1]

    def remove(self, x: float) -> None:
        k = self._at(x)
        own = self.blocks[k]
        del own[bisect_left(own, x)]
        if own:
            self.tops[k] = own[-1]
        else:
            del self.blocks[k], self.tops[k]

    def below(self, x: float) -> int:
        """Values less than x."""
        if not self.blocks:
            return 0
        k = self._at(x)
        return sum(map(len, self.blocks[:k])) + bisect_left(self.blocks[k], x)

    def up_to(self, x: float) -> int:
        """Values of x or less."""
        k = bisect_right(self.tops, x)
        return sum(map(len, self.blocks[:k])) + (bisect_right(self.blocks[k], x) if k < len(self.blocks) else 0)

    def pick(self, k: int) -> float:
        """The value at place k from 0."""
        for own in self.blocks:
            if k < len(own):
                return own[k]
            k -= len(own)
        raise IndexError(k)


def _windowed(n: int, found: Callable[[SortedBlocks, int, float], float], least: int) -> Kernel:
    """``found`` (ordered values, their number, current value) over the last n rows, gaps left out."""
    held, rows, seen = SortedBlocks(), deque(), 0

    def step(x: float) -> float:
        nonlocal seen
        if len(rows) == n:
            old = rows.popleft()
            if not math.isnan(old):
                held.remove(old)
                seen -= 1
        rows.append(x)
        if not math.isnan(x):
            held.add(x)
            seen += 1
        return found(held, seen, x) if seen >= least else NAN

    return step


def rolling_rank(n: int, least: int | None = None, share: bool = True) -> Kernel:
    """``Series.rank`` for windows of any length: ties averaged, ``share``: over the count."""

    def place(held: SortedBlocks, seen: int, x: float) -> float:
        if math.isnan(x):
            return NAN
        rank = (held.below(x) + held.up_to(x) + 1) / 2
        return rank / seen if share else rank

    return _windowed(n, place, n if least is None else least)


def _between(low: float, high: float, part: float) -> float:
    return low + (high - low) * part if part else low


def rolling_quantile(n: int, q: float, least: int | None = None) -> Kernel:
    """``Series.quantile`` for windows of any length: linear between the two nearest values."""

    def value(held: SortedBlocks, seen: int, x: float) -> float:
        at, part = int((seen - 1) * q), (seen - 1) * q % 1
        return _between(held.pick(at), held.pick(min(at + 1, seen - 1)), part)

    return _windowed(n, value, max(1, n if least is None else least))


def expanding_quantile(q: float) -> Kernel:
    """Quantile of all values so far, by two heaps that meet at it."""
    low: list[float] = []
    high: list[float] = []

    def step(x: float) -> float:
        if not math.isnan(x):
            if low and x > -low[0]:
                heappush(high, x)
            else:
                heappush(low, -x)
            place = (len(low) + len(high) - 1) * q
            while len(low) > int(place) + 1:
                heappush(high, -heappop(low))
            while len(low) < int(place) + 1:
                heappush(low, -heappop(high))
        if not low:
            return NAN
        place = (len(low) + len(high) - 1) * q
        return _between(-low[0], high[0] if high else -low[0], place % 1)

    return step


def rolling_spearman(n: int) -> Kernel:
    """Spearman correlation of the n complete rows before each row; of equals the earlier comes first.

    The ranks of a row's window are those of the row before it, moved by one where a value came
    or went between, so a row costs two passes over the window and no sort.
    """
    values, ranks = np.zeros((2, n)), np.zeros((2, n), np.int64)
    rows: deque[int] = deque()  # places of complete rows in the ring, -1 for gaps
    seen = at = 0

    def step(x: float, y: float) -> float:
        nonlocal seen, at
        out = NAN
        if seen == n:
            apart = ranks[0] - ranks[1]
            out = 1 - 6.0 * float(apart @ apart) / (n * (n * n - 1))
        if len(rows) == n:
            old = rows.popleft()
            if old >= 0:
                for own, place in zip(values, ranks, strict=True):
                    place[place > place[old]] -= 1
                    own[old], place[old] = NAN, -1
                seen -= 1
        if math.isnan(x) or math.isnan(y):
            rows.append(-1)
            return out
        for own, place, new in zip(values, ranks, (x, y), strict=True):
            held = place >= 0
            above = held & (own > new)
            place[above] += 1
            own[at], place[at] = new, int(held.sum()) - int(above.sum())
        rows.append(at)
        seen, at = seen + 1, (at + 1) % n
        return out

    ranks[:] = -1
    values[:] = NAN
    return step


def ema(alpha: float, adjust: bool = False) -> Kernel:
    """Exponential mean; ``adjust`` weighs by the sum of weights so far.  Gaps are passed over."""
    top = below = NAN

    def step(x: float) -> float:
        nonlocal top, below
        if math.isnan(x):
            return top / below if adjust and not math.isnan(top) else top
        if math.isnan(top):
            top, below = x, 1.0
        elif adjust:
            top, below = x + (1 - alpha) * top, 1 + (1 - alpha) * below
        else:
            top += alpha * (x - top)
        return top / below if adjust else top

    return step


def span(n: int) -> float:
    return 2 / (n + 1)


def seeded(n: int, alpha: float) -> Kernel:
    """Exponential mean that starts as the plain mean of the first n values."""
    seen, total, mean = 0, 0.0, NAN

    def step(x: float) -> float:
        nonlocal seen, total, mean
        if math.isnan(x):
            return mean
        seen += 1
        if seen <= n:
            total += x
            mean = total / n if seen == n else NAN
        else:
            mean += alpha * (x - mean)
        return mean

    return step


def wilder(n: int) -> Kernel:
    return seeded(n, 1 / n)


def ewma_variance(halflife: float, least: int = 5) -> Kernel:
    """Exponential mean of squares by half-life, once ``least`` values were seen."""
    decay, top, below, seen = 0.5 ** (1 / halflife), 0.0, 0.0, 0

    def step(x: float) -> float:
        nonlocal top, below, seen
        if not math.isnan(x):
            top, below, seen = x * x + decay * top, 1 + decay * below, seen + 1
        return top / below if seen >= least else NAN

    return step


def rsi(n: int = 14) -> Kernel:
    up, down, before = wilder(n), wilder(n), NAN

    def step(x: float) -> float:
        nonlocal before
        change, before = x - before, x if not math.isnan(x) else before
        if math.isnan(change):
            return NAN
        u, d = up(max(change, 0.0)), down(max(-change, 0.0))
        return 100 * u / (u + d) if u + d else (NAN if math.isnan(u) else 0.0)

    return step


def atr(n: int = 14) -> Kernel:
    mean, before = wilder(n), NAN

    def step(high: float, low: float, close: float) -> float:
        nonlocal before
        first, previous = math.isnan(before), before
        before = close
        return NAN if first else mean(max(high - low, abs(high - previous), abs(low - previous)))

    return step


def adx(n: int = 14) -> Kernel:
    plus, minus, true, out = wilder(n), wilder(n), wilder(n), wilder(n)
    old: tuple[float, float, float] | None = None

    def step(high: float, low: float, close: float) -> float:
        nonlocal old
        was, old = old, (high, low, close)
        if was is None:
            return NAN
        up, down = high - was[0], was[1] - low
        p, m = plus(up if up > down and up > 0 else 0.0), minus(down if down > up and down > 0 else 0.0)
        t = true(max(high - low, abs(high - was[2]), abs(low - was[2])))
        if math.isnan(t) or not t or not p + m:
            return out(NAN) if math.isnan(t) else out(0.0)
        return out(100 * abs(p - m) / (p + m))

    return step


def macd(fast: int = 12, slow: int = 26, signal: int = 9, part: str = "hist") -> Kernel:
    """Difference of two seeded means that start together, its signal line, or their gap."""
    quick, late, line = seeded(fast, span(fast)), seeded(slow, span(slow)), seeded(signal, span(signal))
    waiting = slow - fast

    def step(x: float) -> float:
        nonlocal waiting
        a = NAN
        if waiting <= 0:
            a = quick(x)
        waiting -= not math.isnan(x)
        gap = a - late(x)
        mean = line(gap)
        return {"macd": gap if not math.isnan(mean) else NAN, "signal": mean, "hist": gap - mean}[part]

    return step


def trix(n: int = 14) -> Kernel:
    chain, before = [seeded(n, span(n)) for _ in range(3)], NAN

    def step(x: float) -> float:
        nonlocal before
        for k in chain:
            x = k(x)
        was, before = before, x
        return 100 * (x / was - 1) if was else NAN

    return step


def parabolic_sar(step_size: float = 0.02, most: float = 0.2) -> Kernel:
    rows: list[tuple[float, float]] = []
    up, sar, extreme, speed = True, NAN, NAN, step_size

    def step(high: float, low: float) -> float:
        nonlocal up, sar, extreme, speed
        rows.append((high, low))
        if len(rows) == 1:
            return NAN
        del rows[:-3]
        before = rows[-2]
        if math.isnan(sar):
            up = not (before[1] - low > high - before[0] and before[1] - low > 0)
            sar, extreme = (before[1], high) if up else (before[0], low)
            return sar
        sar += speed * (extreme - sar)
        sar = min(sar, *(r[1] for r in rows[:-1])) if up else max(sar, *(r[0] for r in rows[:-1]))
        if (low < sar) if up else (high > sar):
            up, sar, speed = not up, extreme, step_size
            extreme = high if up else low
        elif (high > extreme) if up else (low < extreme):
            extreme, speed = high if up else low, min(most, speed + step_size)
        return sar

    return step


def vpin(buckets: int = 20, window: int = 50, decay: float = 0.8) -> Kernel:
    """Volume-synchronised imbalance: volume signed by the normal chance of each price change.

    Volume is poured into buckets of ``buckets`` times the mean volume of the last ``window``
    bars.  Looked at are the open bucket and the last ``buckets`` - 1 finished ones: their summed
    absolute imbalance over their volume, NULL before the first is finished.  Once ``buckets``
    were finished that volume counts as ``buckets`` whole buckets of the current size.  A size
    that falls below what the open bucket holds finishes it and pours the rest on.  Bars
    without price or volume repeat the value.
    """
    finished: deque[float] = deque(maxlen=buckets - 1)
    recent: deque[float] = deque(maxlen=window)
    poured = held = tilt_held = variance = 0.0
    count, bars, before, value = 0, 0, NAN, NAN

    def step(price: float, volume: float) -> float:
        nonlocal poured, held, tilt_held, variance, count, bars, before, value
        change, before = price - before if bars else 0.0, price
        variance = change * change if bars < 2 else decay * variance + (1 - decay) * change * change
        # Twice the chance of a buy less one: erf of the standardised change.
        tilt = math.erf(change / max(math.sqrt(max(variance, 1e-16)), 1e-8) / math.sqrt(2)) if bars else 0.0
        bars += 1
        recent.append(volume)
        if math.isnan(price) or not volume > 0:
            return value
        seen = [v for v in recent if v == v]
        size = buckets * sum(seen) / len(seen)
        poured += volume
        over = held + volume - size
        if over < -1e-9:
            held, tilt_held = held + volume, tilt_held + tilt * volume
        else:
            finished.append(abs(tilt_held + tilt * (size - held)))
            more, held = divmod(over, size) if over > 1e-9 else (0.0, 0.0)
            if size - held <= 1e-9:
                more, held = more + 1, 0.0
            finished.extend([abs(tilt) * size] * min(int(more), buckets))
            count, tilt_held = count + 1 + int(more), tilt * held
        whole = size * buckets if count >= buckets else poured
        value = (sum(finished) + abs(tilt_held)) / whole if count and whole > 0 else NAN
        return value

    return step


def position(
    mode: str = "threshold", enter: float = 0.0, long_close: float = 0.0, short_close: float = 0.0, forward: int = 3, stop: float | None = None, zscore: float = 0.0, mirrored: bool = False
) -> Kernel:
    """Position held on each bar: 1, -1 or 0, from predictions, an entry level, prices and a z-score.

    Flat bars open where the prediction passes both ``enter`` and the entry level.  Modes:
    "fixed" holds ``forward`` bars, "threshold" until the prediction crosses its close
    threshold, "hybrid" until either; "zscore_threshold" and "zscore_hybrid" close a long at
    z <= ``zscore`` (at z <= -|zscore| if ``mirrored``) and a short at its mirror image.
    ``stop`` also closes at that many points against the entry price.  A bar that closes by
    a rule is flat, and the next one may open; a bar on which the time has run out may open
    at once.  Missing values open and close nothing.
    """
    side, held, paid = 0, 0, NAN
    timed, by_prediction, by_zscore = mode in ("fixed", "hybrid", "zscore_hybrid"), mode in ("threshold", "hybrid"), mode.startswith("zscore")
    bound = -abs(zscore) if mirrored else zscore

    def step(prediction: float, level: float, price: float, z: float = 0.0) -> float:
        nonlocal side, held, paid
        if side:
            held += 1
            if timed and held >= forward:
                side = 0
            else:
                over = by_prediction and (prediction <= -long_close if side > 0 else prediction >= short_close)
                over = over or by_zscore and (z <= bound if side > 0 else z >= -bound)
                if over or stop is not None and side * (price - paid) <= -stop:
                    side = 0
                    return 0.0
                return float(side)
        if abs(prediction) > enter and abs(prediction) >= level:
            side, held, paid = (1 if prediction > 0 else -1), 0, price
        return float(side)

    return step


def slot_vpin(prices: np.ndarray, volumes: np.ndarray, buckets: int = 5, decay: float = 0.8) -> float:
    """Imbalance of one slot's ticks over equal shares of its volume, NaN for fewer than three ticks.

    Volume is signed by the normal chance of each price change against its exponential
    deviation; the first two ticks are neutral.  Signed volume as a function of volume is
    piecewise linear, so what falls into each share is read off at its edges.  The shares are
    a ring that is full at the end, which gives up its first one.  Ticks without a price
    have no volume.
    """
    size = np.where(np.isnan(prices), 0, np.maximum(np.nan_to_num(volumes), 0))
    total = size.sum()
    if len(prices) < 3 or total <= 0:
        return NAN
    change = np.nan_to_num(np.diff(prices, prepend=prices[0]))
    change[:2] = 0.0
    variance = pd.Series(change**2).ewm(alpha=1 - decay, adjust=False).mean().to_numpy()
    tilt = 2 * normal_share(change / np.sqrt(np.maximum(variance, 1e-16))) - 1
    tilt[:2] = 0.0
    edges = np.linspace(0, total, buckets + 1)[1:]
    signed = np.interp(edges, np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(tilt * size)])
    return float(np.abs(np.diff(signed)).sum() / (total - edges[0]))


def normal_share(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by the formula that ``normal_cdf`` gives columns."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / 2**0.5)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (1 + np.sign(z) * (1 - poly * np.exp(-z * z / 2))) / 2


def vpin_by_slot(ticks: DataFrame, keys: Sequence[str], price: str = "price", size: str = "size", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(keys, vpin) of each group of ticks; a slot's ticks are a bounded group."""
    schema = ", ".join(f"{c} {kind}" for c, kind in ticks.select(*keys).dtypes) + ", vpin double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order))
        value = slot_vpin(group[price].to_numpy(float), group[size].to_numpy(float))
        return group[list(keys)].head(1).assign(vpin=None if math.isnan(value) else value)

    return ticks.select(*keys, price, size, *order).groupBy(*keys).applyInPandas(run, schema)
