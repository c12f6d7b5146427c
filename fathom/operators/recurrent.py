"""Gated recurrent networks in numpy, one bounded fold a task.

A network reads the last ``length`` factor rows of a sample through one or more layers of gated
units and gives a number from the last state.  It is trained by back-propagation through time on
the Huber loss, with decoupled weight decay, clipped gradients and a rate that falls along a
cosine, and keeps the weights of the epoch that was best on the latest part of the training rows.
Samples of one step are worked on together; folds run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.windows import Series
from fathom.operators.labels import scaled, walk_forward_folds

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Recurrent:
    """Settings.  ``held_out``: share of the training samples, the latest, that stops it early."""

    length: int = 20
    hidden: int = 32
    layers: int = 1
    epochs: int = 40
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    patience: int = 8
    delta: float = 1.0
    clip: float = 5.0
    held_out: float = 0.15
    seed: int = 42


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_weights(width: int, how: Recurrent) -> Weights:
    """Uniform within one over the root of the state's size."""
    rng, h, half = np.random.default_rng(how.seed), how.hidden, max(how.hidden // 2, 1)
    draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(h)
    out: Weights = {}
    for k in range(how.layers):
        out |= {f"w{k}": draw(width if k == 0 else h, 3 * h), f"u{k}": draw(h, 3 * h), f"b{k}": draw(3 * h), f"c{k}": draw(3 * h)}
    return out | {"v": draw(h, half), "d": draw(half), "o": draw(half, 1), "e": draw(1)}


def forward(p: Weights, x: np.ndarray, layers: int) -> tuple[np.ndarray, list]:
    """Output of each sample of x (samples, steps, factors), and what going back needs."""
    seen, h = [], p["u0"].shape[0]
    for k in range(layers):
        state = np.zeros((len(x), h))
        states, gates = [state], []
        ahead = x @ p[f"w{k}"] + p[f"b{k}"]
        for t in range(x.shape[1]):
            back = state @ p[f"u{k}"] + p[f"c{k}"]
            r, z = _sigmoid(ahead[:, t, :h] + back[:, :h]), _sigmoid(ahead[:, t, h : 2 * h] + back[:, h : 2 * h])
            n = np.tanh(ahead[:, t, 2 * h :] + r * back[:, 2 * h :])
            gates.append((r, z, n, back[:, 2 * h :]))
            state = (1 - z) * n + z * state
            states.append(state)
        seen.append((x, states, gates))
        x = np.stack(states[1:], 1)
    inner = x[:, -1] @ p["v"] + p["d"]
    kept = np.maximum(inner, 0)
    seen.append((x[:, -1], inner, kept))
    return (kept @ p["o"] + p["e"])[:, 0], seen


def backward(p: Weights, seen: list, slope: np.ndarray, layers: int) -> Weights:
    """Gradients of the weights, given those of the outputs."""
    last, inner, kept = seen[-1]
    out: Weights = {"o": kept.T @ slope[:, None], "e": slope.sum(keepdims=True)}
    low = slope[:, None] @ p["o"].T * (inner > 0)
    out |= {"v": last.T @ low, "d": low.sum(0)}
    steps = len(seen[0][2])
    above = [np.zeros_like(last) for _ in range(steps)]
    above[-1] = low @ p["v"].T
    for k in reversed(range(layers)):
        x, states, gates = seen[k]
        du, dc, carried = np.zeros_like(p[f"u{k}"]), np.zeros_like(p[f"c{k}"]), np.zeros_like(last)
        ahead = np.zeros((len(last), steps, p[f"c{k}"].size))
        for t in reversed(range(steps)):
            r, z, n, back = gates[t]
            d = above[t] + carried
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (states[t] - n) * z * (1 - z)
            dr = dn * back * r * (1 - r)
            ahead[:, t] = np.concatenate([dr, dz, dn], 1)
            behind = np.concatenate([dr, dz, dn * r], 1)
            du += states[t].T @ behind
            dc += behind.sum(0)
            carried = d * z + behind @ p[f"u{k}"].T
        out |= {f"w{k}": np.einsum("nti,ntj->ij", x, ahead), f"u{k}": du, f"b{k}": ahead.sum((0, 1)), f"c{k}": dc}
        below = ahead @ p[f"w{k}"].T
        above = [below[:, t] for t in range(steps)]
    return out


def huber(off: np.ndarray, delta: float) -> tuple[float, np.ndarray]:
    """Mean loss of the errors, and its slope by each."""
    size = np.abs(off)
    loss = np.where(size <= delta, 0.5 * off**2, delta * (size - 0.5 * delta))
    return float(loss.mean()), np.clip(off, -delta, delta) / len(off)


def windows(x: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` rows up to each row that has so many: (samples, steps, factors)."""
    if len(x) < length:
        return np.zeros((0, length, x.shape[1]))
    return sliding_window_view(x, length, axis=0).transpose(0, 2, 1)


def train(x: np.ndarray, y: np.ndarray, how: Recurrent) -> Weights:
    """Weights for samples x (samples, steps, factors) in order of time and their labels."""
    cut = len(x) - max(1, int(how.held_out * len(x)))
    p = new_weights(x.shape[2], how)
    rng = np.random.default_rng(how.seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    best, kept, waited, step = np.inf, p, 0, 0
    for epoch in range(how.epochs):
        rate = how.rate * (0.55 + 0.45 * np.cos(np.pi * epoch / how.epochs))  # to a tenth
        order = rng.permutation(cut)
        for at in range(0, cut, how.batch):
            own = order[at : at + how.batch]
            made, seen = forward(p, x[own], how.layers)
            grads = backward(p, seen, huber(made - y[own], how.delta)[1], how.layers)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, how.clip / (norm + 1e-6))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] * (1 - rate * how.decay) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        loss = huber(forward(p, x[cut:], how.layers)[0] - y[cut:], how.delta)[0]
        if loss < best - 1e-7:
            best, kept, waited = loss, {k: v.copy() for k, v in p.items()}, 0
        else:
            waited += 1
            if waited >= how.patience:
                break
    return kept


def importance(p: Weights, x: np.ndarray, y: np.ndarray, how: Recurrent) -> np.ndarray:
    """Rise of the loss when one factor's sequences change places among the samples."""
    rng, base = np.random.default_rng(how.seed + 2), huber(forward(p, x, how.layers)[0] - y, how.delta)[0]
    out = []
    for j in range(x.shape[2]):
        moved = x.copy()
        moved[:, :, j] = x[rng.permutation(len(x)), :, j]
        out.append(huber(forward(p, moved, how.layers)[0] - y, how.delta)[0] - base)
    return np.array(out)


def two_phase(x: np.ndarray, y: np.ndarray, how: Recurrent, top: int) -> tuple[Weights, np.ndarray]:
    """Weights and the factors they take: all, or those most important to a first network (0: all)."""
    p = train(x, y, how)
    if not 0 < top < x.shape[2]:
        return p, np.arange(x.shape[2])
    late = slice(len(x) - max(1, int(how.held_out * len(x))), None)
    picked = np.sort(np.argsort(-importance(p, x[late], y[late], how), kind="stable")[:top])
    return train(x[:, :, picked], y, how), picked


def walk_forward(rows: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, train_rows: int, every: int, ahead: int, how: Recurrent, top: int = 0, least: int = 50) -> DataFrame:
    """Prediction of each row by the network trained last before it: (keys, order, fold, prediction).

    A fold is one group: its training rows, the rows it predicts and the ``length`` rows before
    those, a number bounded by its settings.  Missing factors count as the median of the training
    rows.  Training samples lie in the training rows as a whole; those without a label are left
    out, and a fold of fewer than ``least`` of them predicts nothing.
    """
    numbered = rows.withColumn("rn", Series(tuple(keys), (order,)).rn())
    folds = walk_forward_folds(numbered, keys, train_rows, every, ahead, True)
    dealt = numbered.select(*keys, order, "rn", *factors, label).join(folds, list(keys))
    dealt = dealt.where(((F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("last"))) | ((F.col("rn") > F.col("begin") - how.length) & (F.col("rn") < F.col("end"))))
    schema = ", ".join(f"{c} {kind}" for c, kind in dealt.select(*keys, order, "fold").dtypes) + ", prediction double"
    names = list(factors)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rn")
        known = group[(group.rn >= group["first"]) & (group.rn < group["last"])]
        asked = group[group.rn > group.begin - how.length]
        out = asked[asked.rn >= asked.begin][[*keys, order, "fold"]].assign(prediction=np.nan)
        x = known[names].to_numpy(float)
        middle = np.nan_to_num(np.nanmedian(x, axis=0)) if len(x) else np.zeros(len(names))
        filled = lambda v: np.where(np.isfinite(v), v, middle)
        y = known[label].to_numpy(float)[how.length - 1 :]
        there = np.isfinite(y)
        if there.sum() < least:
            return out
        centre, reach = scaled(filled(x))
        level, spread = y[there].mean(), max(float(y[there].std()), 1e-12)
        p, picked = two_phase(windows((filled(x) - centre) / reach, how.length)[there], (y[there] - level) / spread, how, top)
        made = windows((filled(asked[names].to_numpy(float)) - centre) / reach, how.length)[:, :, picked]
        found = level + spread * forward(p, made, how.layers)[0]
        out["prediction"] = np.concatenate([np.full(len(out) - len(found), np.nan), found])
        return out

    found = dealt.groupBy(*keys, "fold").applyInPandas(run, schema)
    return found.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))
