"""Ranked lexical search: impact-sorted lists read in turn, without random access (NRA).

Documents are indexed in shards of at most ``SHARD_DOCS`` rows, each by the task that reads
them: nothing is shuffled, and no task holds more than one shard.  A shard keeps, for every
term, the documents that hold it.  Once the counts over all shards are known, each posting
has an impact, its part of a score, and every list is sorted by impact.

For an item, the lists of its terms are read from the top, in rounds of growing depth.  What
was read of a document is the lower end of its score; the upper end adds, for each list in
which it was not met yet, the next unread impact of that list.  A round ends an item's search
once no document that was not met, and none whose ends differ, can reach the place that is
still open: membership, ties and scores are then final.  The best scores of earlier shards of
the same task stand as the mark from the start, so later shards stop early.  Tasks give back
their ``k`` best rows an item, and the best of these are the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.graph import cut
from fathom.llm.words import ALNUM, pieces, words

SHARD_DOCS = 8192
SHARD_POSTINGS = 4_000_000
#: Most distinct query terms that are sent out to keep other terms out of the index; with more, all terms are indexed.
SENT_TERMS = 1_000_000
#: Most pairs of item and term in one block of items, or one item.
BLOCK_TERMS = 500_000
#: Postings of each list that the first round reads; every further round reads four times as deep.
FIRST_DEPTH = 64

_SHARD = "ids binary, sizes binary, n_docs long, n_terms long, terms array<long>, held array<long>, docs binary, tfs binary"
_SHARD_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(1)):
            found = words(piece, table=ALNUM)
            owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(piece.first + owner)), pa.array(found.hash.view(np.int64))], ["item_id", "term"])


def _shards(batches: Iterator[pa.RecordBatch], sent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Pack documents (doc_id, text) into shards; with ``sent``, sorted terms, only those are kept."""
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    postings: list[tuple[np.ndarray, ...]] = []
    docs = held = 0

    def packed() -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(c) for c in zip(*postings, strict=True))
        order = np.argsort(term, kind="stable")
        names, df = np.unique(term[order], return_counts=True)
        own_sizes = np.concatenate(sizes)
        row = [np.concatenate(ids).tobytes(), own_sizes.tobytes(), int((own_sizes > 0).sum()), int(own_sizes.sum()), names, df, doc[order].tobytes(), tf[order].tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], _SHARD_NAMES)

    for batch in batches:
        for piece in pieces(batch.column(1)):
            found = words(piece, table=ALNUM)
            n = np.diff(found.first)
            term, owner = found.hash.view(np.int64), np.repeat(np.arange(len(n)), n)
            if sent is not None:
                at = np.minimum(np.searchsorted(sent, term), len(sent) - 1)
                term, owner = (term[keep := sent[at] == term], owner[keep]) if len(sent) else (term[:0], owner[:0])
            order = np.lexsort((term, owner))
            term, owner = term[order], owner[order]
            fresh = np.ones(len(term), bool)
            fresh[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(fresh)
            tf = np.diff(np.append(first, len(term)))
            for row in range(0, len(n), SHARD_DOCS):
                own = slice(*np.searchsorted(owner[first], [row, row + SHARD_DOCS]))
                part = batch.column(0).slice(piece.first + row, min(SHARD_DOCS, len(n) - row))
                if docs and (docs + len(part) > SHARD_DOCS or held + len(tf[own]) > SHARD_POSTINGS):
                    yield packed()
                    ids, sizes, postings, docs, held = [], [], [], 0, 0
                ids.append(part.to_numpy())
                sizes.append(n[row : row + SHARD_DOCS])
                postings.append((term[first][own], (docs + owner[first][own] - row).astype(np.int32), tf[own].astype(np.int32)))
                docs, held = docs + len(part), held + len(tf[own])
    if docs:
        yield packed()


class Block(NamedTuple):
    """Items ``ids``; item i has the terms ``terms[at[first[i]:first[i + 1]]]``, sorted, of weight ``weights``."""

    ids: list[int | None]
    first: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int


class Best(NamedTuple):
    scores: np.ndarray
    ids: np.ndarray


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    n = np.maximum(end - begin, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + np.repeat(begin - (np.cumsum(n) - n), n), owner


def nra(begin: np.ndarray, end: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, k: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``k`` best and score ``mark`` or more, with their final scores.

    List i is ``docs[begin[i]:end[i]]``, its positive ``impacts`` falling.  No posting is read
    but in list order, and reading stops when nothing that is open could matter.
    """
    lower = np.zeros(n_docs, np.int64)
    read_docs, read_lists = [], []
    depth, done = FIRST_DEPTH, begin
    while True:
        now = np.minimum(begin + depth, end)
        at, owner = _spread(done, now)
        np.add.at(lower, docs[at], impacts[at])
        read_docs.append(docs[at])
        read_lists.append(owner)
        # The next unread impact bounds what a list can still add.
        rest = np.where(now < end, impacts[np.minimum(now, len(impacts) - 1)], 0) if len(impacts) else np.zeros(len(begin), np.int64)
        unmet = int(rest.sum())
        upper = lower + unmet
        for d, o in zip(read_docs, read_lists, strict=True):
            np.subtract.at(upper, d, rest[o])
        place = int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs >= k else 0
        open_at = max(place, mark, 1)
        left = np.flatnonzero(upper >= open_at)
        # A document never met has upper == unmet: once that is too little, all that is left was met.
        if unmet < open_at and (lower[left] == upper[left]).all():
            return left, lower[left]
        done, depth = now, 4 * depth


def _rank_shard(shard: dict, block: Block, best: list[Best]) -> None:
    terms, df = np.asarray(shard["terms"], np.int64), np.asarray(shard["held"], np.int64)
    ids, sizes = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["sizes"], np.int64)
    docs, tfs = np.frombuffer(shard["docs"], np.int32), np.frombuffer(shard["tfs"], np.int32)
    if not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    asked = np.flatnonzero((terms[at] == block.terms) & (block.weights > 0))
    stop = np.cumsum(df)
    take, owner = _spread((stop - df)[at[asked]], stop[at[asked]])
    docs, tf = docs[take].astype(np.int64), tfs[take].astype(np.int64)
    length = 10 + 90 * sizes * block.n_docs // block.n_terms
    impact = block.weights[asked][owner] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[docs]))
    owner, docs, impact = (x[impact > 0] for x in (owner, docs, impact))
    order = np.lexsort((docs, -impact, owner))
    docs, impact = docs[order], impact[order]
    begin, end = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
    n = np.bincount(owner, minlength=len(asked))
    end[asked] = np.cumsum(n)
    begin[asked] = end[asked] - n
    for i in range(len(block.ids)):
        own = block.at[block.first[i] : block.first[i + 1]]
        own = own[end[own] > begin[own]]
        if not len(own):
            continue
        had = best[i]
        mark = int(had.scores[-1]) if len(had.scores) == block.k else 1
        found, scores = nra(begin[own], end[own], docs, impact, len(ids), block.k, mark)
        scores, names = np.concatenate([had.scores, scores]), np.concatenate([had.ids, ids[found]])
        order = np.lexsort((names, -scores))[: block.k]
        best[i] = Best(scores[order], names[order])


def rank_lexical(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, sent_terms: int = SENT_TERMS) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Columns: item_id, rank (from 1), doc_id, score (above 0; the higher first, then the smaller
    doc_id).  Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased; null
    texts have none, and items without terms no rows.  Rows of one item_id, null included, are
    one item with the terms of all.  A row of ``docs`` that is repeated is ranked each time.
    Rows without doc_id count as documents but are not ranked.  Terms are told apart by 64-bit
    hashes.  With more than ``sent_terms`` distinct terms in all items, every term is indexed;
    the items are ranked in blocks of ``block_terms`` (item, term) pairs against the same index.
    """
    spark = docs.sparkSession
    asked = cut(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_terms, "item_id long, term long").distinct())
    n_terms = asked.select("term").distinct().count()
    sent = None
    if n_terms <= sent_terms:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r.term for r in asked.select("term").distinct().collect()], np.int64)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    plain = texts.where("doc_id is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shards(batches, None if sent is None else sent.value)

    index = cut(plain.mapInArrow(pack, _SHARD).withColumn("ranked", F.lit(True)))
    # Rows without doc_id have no name to be ranked by; what they hold still counts.
    nameless = texts.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long"))
    counted = index.unionByName(cut(nameless.mapInArrow(pack, _SHARD).withColumn("ranked", F.lit(False))))
    total = counted.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    df = counted.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.held").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * (total.n or 0) + 2) / (2.0 * F.col("df") + 1)))
    weighted = cut(asked.join(df, "term").select("item_id", "term", weight.cast("long").alias("w")))
    blocks = -(-weighted.count() // block_terms)
    made = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").collect()
        if not rows:
            continue
        terms, at = np.unique(np.array([r.term for r in rows], np.int64), return_inverse=True)
        weights = np.zeros(len(terms), np.int64)
        weights[at] = [r.w for r in rows]
        first = [i for i in range(len(rows)) if not i or rows[i].item_id != rows[i - 1].item_id]
        block = Block([rows[i].item_id for i in first], np.array([*first, len(rows)]), at, terms, weights, total.n, total.l, k)
        shared = spark.sparkContext.broadcast(block)

        def rank(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            best = [Best(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.ids]
            for batch in batches:
                for i in range(len(batch)):
                    _rank_shard({c: batch.column(c)[i].as_py() if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c)[i].values.to_numpy() for c in ("ids", "sizes", "terms", "held", "docs", "tfs")}, block, best)
            names = pa.array([x for x, own in zip(block.ids, best, strict=True) for _ in own.ids], pa.int64())
            columns = [np.concatenate([own[c] for own in best]) if best else np.zeros(0, np.int64) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], ["item_id", "doc_id", "score"])

        made = made.unionByName(index.mapInArrow(rank, made.schema))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return made.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
