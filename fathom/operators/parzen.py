"""Tree-structured Parzen search over cluster picks and include flags.

Trials come in batches: a batch is proposed from the trials of the batches before it, scored by
one job, and logged before the next one starts.  A trial's draws depend on the seed, its number
and the logged scores alone, so a search that was interrupted goes on as if it had not been.

Trials are split into a good share and the rest; for every parameter, the counts of its values
in both, with a prior of one trial spread over all values, are its two densities.  A proposal
draws candidates from the good density and takes the one whose ratio of densities is highest,
parameter by parameter.  The pick of a cluster counts only in trials that include the cluster,
which is what makes the densities a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = "number int, set_id string, picks string, score double"
#: Score of an empty set, which is never evaluated.
EMPTY = -999.0


class Trial(NamedTuple):
    """``picks``: for every cluster the place of the factor that it gives, -1 if it gives none."""

    number: int
    set_id: str
    picks: tuple[int, ...]
    score: float | None = None


def _densities(values: Sequence[int], kinds: int) -> np.ndarray:
    return (np.bincount(np.array(values, np.int64), minlength=kinds) + 1 / kinds) / (len(values) + 1)


def _drawn(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, candidates: int) -> int:
    """Of values drawn from ``good``, the one with the highest ratio of densities; ties to the smaller."""
    found = np.unique(rng.choice(len(good), candidates, p=good / good.sum()))
    return int(found[np.argmax(good[found] / bad[found])])


def propose(number: int, sizes: Sequence[int], done: Sequence[Trial], taken: set[tuple[int, ...]], seed: int, startup: int = 10, share: float = 0.2, candidates: int = 3, tries: int = 16) -> tuple[int, ...]:
    """Picks of trial ``number``, given the scored trials before its batch.

    With fewer than ``startup`` of them, draws are uniform.  Picks in ``taken`` are drawn again,
    ``tries`` times at most.
    """
    rng = np.random.default_rng([seed, number])
    for _ in range(tries):
        picks = _proposed(rng, sizes, done, startup, share, candidates)
        if picks not in taken:
            break
    return picks


def _proposed(rng: np.random.Generator, sizes: Sequence[int], done: Sequence[Trial], startup: int, share: float, candidates: int) -> tuple[int, ...]:
    if len(done) < startup:
        return tuple(int(rng.integers(n)) if rng.random() < 0.5 else -1 for n in sizes)
    ranked = sorted(done, key=lambda t: (-t.score, t.number))
    cut = max(1, math.ceil(share * len(ranked)))
    parts = ranked[:cut], ranked[cut:]
    picks = []
    for c, n in enumerate(sizes):
        used = [_densities([int(t.picks[c] >= 0) for t in part], 2) for part in parts]
        if not _drawn(rng, *used, candidates):
            picks.append(-1)
            continue
        own = [_densities([t.picks[c] for t in part if t.picks[c] >= 0], n) for part in parts]
        picks.append(_drawn(rng, *own, candidates))
    return tuple(picks)


def named(picks: Sequence[int], clusters: Sequence[Sequence[str]], must: Sequence[str] = ()) -> str:
    return "|".join(sorted({*must, *(c[k] for c, k in zip(clusters, picks, strict=True) if k >= 0)}))


def logged(spark: SparkSession, path: str, batch: int) -> list[Trial]:
    """Trials of the whole batches at the start of a log; none if there is no log."""
    try:
        rows = spark.read.schema(LOG + ", batch int").json(path).collect()
    except AnalysisException:
        return []
    held: dict[int, list[Trial]] = {}
    for r in rows:
        held.setdefault(r.batch, []).append(Trial(r.number, r.set_id, tuple(map(int, r.picks.split(","))), r.score))
    out: list[Trial] = []
    for k in range(len(held)):
        if len(held.get(k, ())) != batch:
            break
        out += sorted(held[k])
    return out


def parzen_search(spark: SparkSession, clusters: Sequence[Sequence[str]], score: Callable[[list[tuple[str, ...]]], Mapping[str, float]], trials: int, batch: int = 8, seed: int = 42, must: Sequence[str] = (), path: str | None = None, stop: Callable[[int], bool] | None = None, **how) -> list[Trial]:
    """All trials in order; their number is ``trials`` rounded up to whole batches.

    ``score`` maps a list of sets to {set_id: score} in one job; a set that was scored before is
    not scored again.  With ``path``, each batch is written below it before the next one starts,
    and whole batches found there are taken over.  ``stop`` (batch number) ends a search early.
    """
    sizes = [len(c) for c in clusters]
    done = logged(spark, path, batch) if path else []
    known = {t.set_id: t.score for t in done}
    for b in range(len(done) // batch, -(-trials // batch)):
        if stop is not None and stop(b):
            break
        taken, drawn = {t.picks for t in done}, []
        for n in range(b * batch, (b + 1) * batch):
            drawn.append(propose(n, sizes, done, taken, seed, **how))
            taken.add(drawn[-1])
        names = [named(p, clusters, must) for p in drawn]
        fresh = sorted({n for n in names if n and n not in known})
        if fresh:
            known |= score([tuple(n.split("|")) for n in fresh])
        made = [Trial(b * batch + k, n, p, float(known.get(n, EMPTY)) if n else EMPTY) for k, (n, p) in enumerate(zip(names, drawn, strict=True))]
        if path:
            rows = [(t.number, t.set_id, ",".join(map(str, t.picks)), t.score) for t in made]
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").json(f"{path}/batch={b}")
        done = done + made
    return done


def as_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """number, set_id, score and best (the best score so far) of every trial."""
    best, rows = -math.inf, []
    for t in trials:
        best = max(best, t.score)
        rows.append((t.number, t.set_id, t.score, best))
    return spark.createDataFrame(rows, "number int, set_id string, score double, best double")
