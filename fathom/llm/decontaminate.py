"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased alphanumeric words.  Items that
share runs of ``SEED`` words with a document are candidates; those whose seeds could not
cover the asked share of the item are left out at once; an item of fewer words is one with a
document that holds it whole.  For the rest, the longest common
run that overlaps no earlier one is marked again and again, found by running Karp-Rabin
hashes and confirmed word by word.  The marked share of the item is its coverage, which does
not depend on the order in which its parts occur.

Items are the query set: they are dealt by hash into blocks of at most ``BLOCK_CHARS``
characters, and a block at a time is sent to the tasks that read the documents.  A larger
benchmark means more blocks and the same work on each, so results do not depend on its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.words import ALNUM, Words, mix, pieces, words

SEED = 4
COVERAGE = 0.5
#: Most characters of the items of one block; a longer single item is a block of its own size.
#: A task holds about 20 bytes for every character of a block.
BLOCK_CHARS = 4_000_000
#: Seeds of documents and items that are paired at once (24 bytes each).
PAIRED = 1 << 20

_BASE = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GATE = np.uint64((1 << 20) - 1)


def running(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``size`` tokens."""
    return Runs(tokens).hash(size) if len(tokens) >= size else np.zeros(0, np.uint64)


class Runs:
    """Rolling hashes of one sequence at any length, each in one pass over its prefix sums."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        steps = np.full((2, len(tokens) + 1), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, _BACK
        up, self.down = np.multiply.accumulate(steps, axis=1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[:-1], out=self.sums[1:])

    def hash(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.down) - size])


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``few``, without sorting the many."""
    few = np.unique(few)
    return few[np.searchsorted(few, values).clip(max=len(few) - 1)] == values if len(few) else np.zeros(len(values), bool)


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` unmarked tokens begin."""
    taken = np.zeros(len(free) + 1, np.int64)
    np.cumsum(~free, out=taken[1:])
    return np.flatnonzero(taken[size:] == taken[: len(taken) - size])


def _shared_part(item: Runs, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of ``doc`` inside runs of ``least`` that the item has, their places, and which are no gap."""
    known = _among(running(doc, least), item.hash(least))
    edge = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(known)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    # One marked token stands for each gap, so that no run goes across it.
    gaps = np.flatnonzero(np.diff(inside, prepend=-1) > 1)
    places = np.insert(inside, gaps, inside[gaps] - 1)
    free = np.insert(np.ones(len(inside), bool), gaps, False)
    return doc[places], places, free


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, length), longest first.

    Of several longest runs the one that comes first in the item, then in the document, is
    marked.  Lengths fall from one to the next by strides and bisection, each step linear in the tokens;
    a tiling has at most sqrt(2 n) lengths, so repetitive texts cost no pairs of places.
    """
    if min(len(item), len(doc)) < least:
        return []
    one = Runs(item)
    part, places, free_doc = _shared_part(one, doc, least)
    two = Runs(part)
    free_item = np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open item places with their hashes, and open document places, that share a run."""
        p, t = _open(free_item, size), _open(free_doc, size)
        if not len(p) or not len(t):
            return p[:0], p[:0], t[:0]
        a, b = one.hash(size)[p], two.hash(size)[t]
        ours = _among(b, a)
        both = _among(a, b[ours])
        return p[both], a[both], t[ours]

    top = min(len(item), len(part))
    while top >= least:
        low, high, stride = least - 1, top, 1  # a run of ``low`` is there, one of ``high`` + 1 is not
        while low < high:
            # Stride down from the top, ever wider, until a run is found; then bisect.
            size = max(high + 1 - stride, least) if low < least else (low + high + 1) // 2
            stride *= 2
            low, high = (size, high) if len(common(size)[0]) else (low, size - 1)
        if low < least:
            break
        size = low
        p_all, hashes, t_all = common(size)
        theirs = two.hash(size)[t_all]
        order = np.argsort(theirs, kind="stable")
        theirs, t_all = theirs[order], t_all[order]
        next_at: dict[int, int] = {}
        for p, h in zip(p_all.tolist(), hashes):
            if not free_item[p] or not free_item[p + size - 1]:
                continue
            at, end = next_at.get(int(h), int(np.searchsorted(theirs, h, "left"))), int(np.searchsorted(theirs, h, "right"))
            while at < end:
                t = int(t_all[at])
                taken = np.flatnonzero(~free_doc[t : t + size])
                if len(taken):
                    at += int(np.searchsorted(t_all[at:end], t + taken[-1] + 1))
                elif not np.array_equal(item[p : p + size], part[t : t + size]):
                    at += 1
                else:
                    free_item[p : p + size] = free_doc[t : t + size] = False
                    found.append((p, int(places[t]), size))
                    break
            next_at[int(h)] = at
        top = size - 1
    return found


class Items(NamedTuple):
    """Benchmark items as token hashes, and their seeds sorted by hash.

    ``short``: by number of words, the whole of items that have no seed, sorted, and their owners.
    """

    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    gate: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index_items(ids: list[int | None], texts: pa.Array) -> Items:
    tokens: list[np.ndarray] = []
    for piece in pieces(texts):
        found = words(piece, table=ALNUM)
        tokens += [found.hash[found.first[i] : found.first[i + 1]] for i in range(len(found.first) - 1)]
    seeds = [running(t, SEED) for t in tokens]
    n = [len(s) for s in seeds]
    everything = np.concatenate([np.zeros(0, np.uint64), *seeds])
    owner = np.repeat(np.arange(len(seeds), dtype=np.int32), n)
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
    order = np.argsort(everything, kind="stable")
    gate = np.zeros(1 << 20, bool)
    gate[(everything & _GATE).astype(np.int64)] = True
    short = {}
    for size in range(1, SEED):
        own = np.array([i for i, t in enumerate(tokens) if len(t) == size], np.int64)
        if len(own):
            whole = np.concatenate([running(tokens[i], size) for i in own.tolist()])
            turn = np.argsort(whole, kind="stable")
            short[size] = whole[turn], own[turn]
    return Items(list(ids), tokens, everything[order], owner[order], place[order], gate, short)


def _whole_items(found: Words, items: Items) -> Iterator[tuple[int, int]]:
    """(text, item) of items too short for a seed that a text holds as they are."""
    for size, (whole, owner) in items.short.items():
        runs = running(found.hash, size)
        at = np.flatnonzero(_among(runs, whole))
        text = np.searchsorted(found.first, at, "right") - 1
        inside = at + size <= found.first[text + 1]
        pairs = np.unique(np.stack([text[inside].astype(np.uint64), runs[at[inside]]], 1), axis=0)
        for t, h in pairs:
            for k in owner[np.searchsorted(whole, h, "left") : np.searchsorted(whole, h, "right")].tolist():
                yield int(t), k


def _candidates(found: Words, items: Items, coverage: float) -> Iterator[tuple[int, int]]:
    """(text, item) whose shared seeds cover enough of the item to be worth tiling."""
    if len(found.hash) < SEED or not len(items.seeds):
        return
    seeds = running(found.hash, SEED)
    at = np.flatnonzero(items.gate[(seeds & _GATE).astype(np.int64)])
    text = np.searchsorted(found.first, at, "right") - 1
    whole = at + SEED <= found.first[text + 1]
    at, text = at[whole], text[whole]
    low, high = np.searchsorted(items.seeds, seeds[at], "left"), np.searchsorted(items.seeds, seeds[at], "right")
    hit = high > low
    # A seed that a text repeats counts once.
    pairs = np.unique(np.stack([text[hit], low[hit], high[hit]], 1), axis=0)
    total = np.cumsum(pairs[:, 2] - pairs[:, 1])
    last_of_text = np.flatnonzero(np.r_[pairs[1:, 0] != pairs[:-1, 0], True]) if len(pairs) else []
    begin = 0
    for end in last_of_text:
        if end < len(pairs) - 1 and total[end] - (total[begin - 1] if begin else 0) < PAIRED:
            continue
        part, begin = pairs[begin : end + 1], end + 1
        n = part[:, 2] - part[:, 1]
        which = np.repeat(part[:, 1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hits = np.stack([np.repeat(part[:, 0], n), items.owner[which], items.place[which]], 1)
        hits = hits[np.lexsort(hits.T[::-1])]
        edge = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1)])
        step = np.full(len(hits), SEED)
        step[:-1] = np.minimum(np.diff(hits[:, 2]), SEED)
        step[np.r_[edge[1:] - 1, len(hits) - 1]] = SEED
        covered = np.add.reduceat(step, edge)
        owners = hits[edge, 1]
        sizes = np.array([len(t) for t in items.tokens])[owners]
        for k in np.flatnonzero(covered >= coverage * sizes):
            yield int(hits[edge[k], 0]), int(owners[k])


def find_leaks(column: pa.Array, items: Items, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item index, covered words, words of the item, tiles) at or above ``coverage``."""
    for piece in pieces(column):
        found = words(piece, table=ALNUM)
        for text, own in (*_candidates(found, items, coverage), *_whole_items(found, items)):
            item = items.tokens[own]
            marked = tiles(item, found.hash[found.first[text] : found.first[text + 1]], min(SEED, len(item)))
            covered = sum(n for _, _, n in marked)
            if covered >= coverage * len(item):
                yield piece.first + text, own, covered, len(item), len(marked)


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[Items]:
    """The items as indexes of at most ``limit`` characters, or one item; one at a time on the driver."""
    plain = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    size = plain.agg(F.sum(F.length("text")).alias("all"), F.max(F.length("text")).alias("longest")).first()
    blocks = -(-(size["all"] or 0) // limit)
    while blocks > 1:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        most = plain.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n").alias("n")).first().n
        if most <= max(limit, size["longest"]):
            break
        blocks += -(-blocks // 4)
    for b in range(blocks):
        rows = plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if rows:
            yield index_items([r.item_id for r in rows], pa.array([r.text for r in rows], pa.large_string()))


_PAIRS = ["doc_id", "item_id", "covered", "item_words", "tiles"]
_PAIRS_SQL = "doc_id long, item_id long, covered long, item_words long, tiles long"


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it covers to ``coverage`` or more.

    Columns: doc_id, item_id, covered and item_words (words), tiles, coverage.  Null and
    empty texts cover nothing; items of fewer than ``SEED`` words match where they stand whole,
    items without words never.  A row repeated in either table gives its pairs once.  Rows
    without doc_id or item_id count like others; those of one pair of ids are told together,
    with the widest coverage among them.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], _PAIRS_SQL)
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = list(find_leaks(batch.column(1), shared.value, coverage))
                if leaks:
                    row, own, *rest = zip(*leaks, strict=True)
                    ids = [batch.column(0).take(pa.array(row)), pa.array([shared.value.ids[k] for k in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int64()) for c in rest)], _PAIRS)

        found = found.unionByName(texts.mapInArrow(run, _PAIRS_SQL))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "item_words", "tiles")).alias("b"))
    return best.select("doc_id", "item_id", "b.*").withColumn("coverage", F.col("covered") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose own text covers an item; nothing else changes."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, *_ in find_leaks(batch.column(at), shared.value, coverage)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
