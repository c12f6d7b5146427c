"""Hard-negative mining: threshold joins over an inverted index, in the manner of L2AP.

Rows are packed into shards of at most ``SHARD_ROWS`` vectors by the task that reads them, and
anchors, the stated query set, are sent to the shards in blocks.  In a shard the dimensions are
put in order of rising energy.  Its inverted index has a list of rows per dimension, and leaves
out of every row the leading dimensions whose norm alone cannot bring it to the threshold.  An
anchor reads the lists from the last dimension to the first and adds up partial scores; rows
whose partial score and remaining norms stay below the threshold drop out, and the few that are
left are completed from their vectors.  Every bound is proven, so no row is lost.

First the positives: the threshold of an anchor is the score of its last place so far, to begin
with among the anchors of its own label.  Then the windows: an anchor's threshold starts close
under its positives and is lowered step by step until every window is full or searched down to
its lower end.  Places filled in earlier shards of a task raise the thresholds of later ones.
Tasks give back their best rows a window, and the best of those are the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.graph import cut

SHARD_ROWS = 8192
#: Most numbers in one shard, and in one block of anchors.
SHARD_VALUES = 2_000_000
BLOCK_VALUES = 500_000
POSITIVES = 5
NEGATIVES = 5
#: Lower end of a window, in percent of the positive's score, which is its upper end.
LOW = 80
#: Percent of a positive's score that a window is searched down to, one after another.
LEVELS = (97, 92, 86, LOW)
#: Lists that are read between two prunings, and the share of rows at which the rest is completed directly.
STRIDE = 4
FEW = 16

_NONE = -(1 << 62)


class Index:
    """Inverted lists of ``x``, each row without the leading dimensions whose norm is under ``least``."""

    def __init__(self, x: np.ndarray, prefix: np.ndarray, least: float):
        self.x, self.prefix = x, prefix
        kept = (prefix[:, 1:] >= least) & (x != 0)
        self.start = np.where(kept.any(1), kept.argmax(1), x.shape[1])
        dim, self.rows = np.nonzero(kept.T)
        self.values = x[self.rows, dim]
        self.first = np.searchsorted(dim, np.arange(x.shape[1] + 1))

    def reach(self, q: np.ndarray, least: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``among`` whose inner product with ``q`` is ``least`` or more, and the products."""
        rest = np.sqrt(np.concatenate([[0.0], np.cumsum(q.astype(np.float64) ** 2)]))
        score = np.zeros(len(self.x), np.int64)
        left = among
        for j in range(self.x.shape[1] - 1, -1, -1):
            own = slice(self.first[j], self.first[j + 1])
            if q[j]:
                score[self.rows[own]] += q[j] * self.values[own]
            if j % STRIDE == 0:
                unread = np.maximum(self.start[left], j)
                bound = rest[unread] * self.prefix[left, unread]
                left = left[score[left] + bound * (1 + 1e-9) + 1 >= least]
                if len(left) * FEW <= len(among):
                    break
        done = self.x[left] @ q
        return left[done >= least], done[done >= least]


class Shard:
    """Rows by label; dimensions by rising energy."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, width: int):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        x = np.pad(x[order], ((0, 0), (0, max(0, width - x.shape[1]))))
        self.dims = np.argsort((x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = x[:, self.dims]
        self.prefix = np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(self.x.astype(np.float64) ** 2, axis=1)], axis=1))

    def index(self, least: float) -> Index:
        return Index(self.x, self.prefix, least)

    def turned(self, q: np.ndarray) -> np.ndarray:
        return np.pad(q, (0, max(0, len(self.dims) - len(q))))[self.dims]

    def of_label(self, label: int, same: bool) -> np.ndarray:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return np.arange(a, b) if same else np.concatenate([np.arange(a), np.arange(b, len(self.labels))])


class Anchors(NamedTuple):
    """A block of anchors; ``marks``: a score that the last positive of each reaches for certain."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    marks: np.ndarray
    #: Scores of each anchor's positives, highest first.
    positives: list[np.ndarray]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Places:
    """The ``k`` best (score, id) found so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def last(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else _NONE

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = _best(scores, ids, self.k)
            self.scores, self.ids = scores[order], ids[order]


def _ratio(least: np.ndarray, q: np.ndarray) -> float:
    """The norm that a row needs for the lowest of the thresholds."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    return float(np.divide(least, norm, out=np.zeros(len(norm)), where=norm > 0).min(initial=np.inf)) * (1 - 1e-9)


def _find_positives(shard: Shard, anchors: Anchors, places: list[Places]) -> None:
    least = np.array([max(p.last(), m) for p, m in zip(places, anchors.marks.tolist(), strict=True)])
    here = np.isin(anchors.labels, shard.labels)
    for part in (np.flatnonzero(here & (least > 0)), np.flatnonzero(here & (least <= 0))):
        if len(part):
            index = shard.index(max(0.0, _ratio(least[part], anchors.x[part])))
            for a in part.tolist():
                among = shard.of_label(anchors.labels[a], True)
                rows, scores = index.reach(shard.turned(anchors.x[a]), int(least[a]), among[shard.ids[among] != anchors.ids[a]])
                places[a].add(scores, shard.ids[rows])


def lower_end(positive: np.ndarray, percent: int = LOW) -> np.ndarray:
    """Smallest integer that is ``percent`` of a positive's score or more."""
    return -((-percent * positive) // 100)


def _find_negatives(shard: Shard, anchors: Anchors, places: list[list[Places]]) -> None:
    open_at = {a: list(range(len(own))) for a, own in enumerate(places) if own}
    for level in LEVELS:
        least = {}
        for a, windows in open_at.items():
            last = np.array([places[a][w].last() for w in windows])
            least[a] = int(np.maximum(lower_end(anchors.positives[a][windows], level), last).min())
        if not least:
            return
        asked = np.array(list(least))
        index = shard.index(max(0.0, _ratio(np.array(list(least.values())), anchors.x[asked])))
        for a in asked.tolist():
            rows, scores = index.reach(shard.turned(anchors.x[a]), least[a], shard.of_label(anchors.labels[a], False))
            still = []
            for w in open_at[a]:
                top = anchors.positives[a][w]
                inside = scores <= top
                found = Places(NEGATIVES)
                found.add(places[a][w].scores, places[a][w].ids)
                found.add(scores[inside], shard.ids[rows[inside]])
                if found.last() >= least[a] or least[a] <= lower_end(top):
                    keep = found.scores >= lower_end(top)
                    places[a][w].scores, places[a][w].ids = found.scores[keep], found.ids[keep]
                else:
                    still.append(w)
            open_at[a] = still
        open_at = {a: w for a, w in open_at.items() if w}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, x) as shards; shorter vectors are filled up with zeros."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = width = 0

    def pack() -> pa.RecordBatch:
        x = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for *_, v in held])
        columns = [np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), x]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["ids", "labels", "x"])

    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = batch.column(2)
        n = np.diff(x.offsets.to_numpy())
        values = x.flatten().to_numpy()
        first = np.cumsum(n) - n
        for at in range(0, len(batch), 256):
            part = slice(at, at + 256)
            wide = int(n[part].max(initial=0))
            dense = np.zeros((len(n[part]), wide), np.int64)
            row = np.repeat(np.arange(len(dense)), n[part])
            dense[row, np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])] = values[first[at] : first[at] + len(row)]
            if held and (rows + len(dense) > SHARD_ROWS or (rows + len(dense)) * max(width, wide) > SHARD_VALUES):
                yield pack()
                held, rows, width = [], 0, 0
            held.append((ids[part], labels[part], dense))
            rows, width = rows + len(dense), max(width, wide)
    if held:
        yield pack()


def _shard(batch: pa.RecordBatch, i: int, width: int) -> Shard:
    ids, labels, x = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels", "x"))
    return Shard(ids, labels, x.reshape(len(ids), -1), width)


def scaled(embeddings: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, x): components as floor(scale * component); rows that take part only.

    Rows take no part if vec_id, label, the vector or a component is null, a component is not
    finite, or the squared norm does not fit a 64-bit integer.
    """
    values = F.col(vector).cast("array<double>")
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**53 / scale))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    x = F.transform(values, lambda v: F.floor(scale * v).cast("long"))
    made = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return made.where(norm < 2.0**62)


def _anchor_blocks(anchors: DataFrame, limit: int) -> Iterator[Anchors]:
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    blocks = -(-size.n * max(1, size.width or 1) // limit)
    done = 0
    for b in range(blocks):
        rows = anchors.where(F.pmod(F.xxhash64("vec_id", "label"), F.lit(blocks)) == b).orderBy("vec_id", "label", "x").collect()
        if not rows:
            continue
        x = np.zeros((len(rows), size.width), np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r.x)] = r.x
        ids, labels = np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64)
        marks = np.full(len(rows), _NONE)
        for a in range(len(rows)):
            same = x[(labels == labels[a]) & (ids != ids[a])] @ x[a]
            if len(same) >= POSITIVES:
                marks[a] = np.partition(same, -POSITIVES)[-POSITIVES]
        yield Anchors(np.arange(done, done + len(rows)), ids, labels, x, marks, [])
        done += len(rows)


def mine_hard_negatives(rows: DataFrame, every: int = 100, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, x), see ``scaled``.

    Anchors are the rows whose vec_id is divisible by ``every``; equal rows are one anchor.  An
    anchor's positives are its ``POSITIVES`` best rows of the same label by inner product, ties
    by the smaller vec_id; a row with the anchor's vec_id is none.  For each of them: the
    ``NEGATIVES`` best rows of other labels that score ``LOW`` to 100 percent of it.
    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.  A row that is repeated takes a place each time.  Positives of a negative
    score have no window.  Shorter vectors count as filled up with zeros.  Anchors go out in
    blocks of at most ``block_values`` numbers, or one anchor.
    """
    spark = rows.sparkSession
    shards = cut(rows.mapInArrow(_packed, "ids binary, labels binary, x binary"))
    made = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for anchors in _anchor_blocks(rows.where(F.col("vec_id") % every == 0).distinct(), block_values):
        width = anchors.x.shape[1]
        sent = spark.sparkContext.broadcast(anchors)

        def positives(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            own = sent.value
            places = [Places(POSITIVES) for _ in own.ids]
            for batch in batches:
                for i in range(len(batch)):
                    _find_positives(_shard(batch, i, width), own, places)
            number = np.repeat(own.numbers, [len(p.ids) for p in places])
            yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(np.concatenate([getattr(p, c) for p in places])) for c in ("ids", "scores"))], ["anchor", "id", "score"])

        ranked = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
        best = shards.mapInArrow(positives, "anchor long, id long, score long").withColumn("rank", ranked).where(F.col("rank") <= POSITIVES)
        found = best.orderBy("anchor", "rank").collect()  # a few rows for each anchor of the block
        own: list[list] = [[] for _ in anchors.ids]
        for r in found:
            own[r.anchor - int(anchors.numbers[0])].append(r)
        own = [[r for r in p if r.score >= 0] for p in own]
        sent = spark.sparkContext.broadcast(anchors._replace(positives=[np.array([r.score for r in p], np.int64) for p in own]))

        def negatives(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            own = sent.value
            places = [[Places(NEGATIVES) for _ in p] for p in own.positives]
            for batch in batches:
                for i in range(len(batch)):
                    _find_negatives(_shard(batch, i, width), own, places)
            out = [(own.numbers[a], w, i, s) for a, p in enumerate(places) for w, q in enumerate(p) for i, s in zip(q.ids, q.scores, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([r[c] for r in out], np.int64)) for c in range(4)], ["anchor", "place", "negative_id", "negative_score"])

        ranked = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
        best = shards.mapInArrow(negatives, "anchor long, place long, negative_id long, negative_score long").withColumn("rank", ranked)
        names = [(int(n), w, int(i), r.id, r.score) for n, i, p in zip(anchors.numbers, anchors.ids, own, strict=True) for w, r in enumerate(p)]
        named = spark.createDataFrame(names, "anchor long, place long, anchor_id long, positive_id long, positive_score long")
        out = best.where(F.col("rank") <= NEGATIVES).join(F.broadcast(named), ["anchor", "place"])
        made = made.unionByName(out.select(*made.columns))
    return made
