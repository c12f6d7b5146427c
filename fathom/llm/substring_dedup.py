"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash over the last ``WINDOW`` bytes cuts a text wherever its top bits are zero, so
cuts depend on nearby content only and an insertion moves no cut beyond it.  A chunk that
also occurs in a document with a smaller doc_id repeats it; with ``inside``, so does one that
occurs earlier in the same document.  Neighbouring repeated chunks join to spans, and spans
of at least ``LEAST_BYTES`` are reported; shorter ones are phrases that texts share by chance.

Chunks are compared by BLAKE2b: by 64 bits where a chunk is shorter than a span, so that only
several in a row can make one, and by 128 bits where it may be a span alone.  At 10^12 chunks
one chunk in 10^7 has an unrelated one with the same 64 bits; two such in a row, which a false
span takes, are not to be expected.

Chunks are made twice, to find shared digests and to flag what holds them: that takes less than
writing all chunks out, and the first pass is combined before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.graph import cut
from fathom.llm.words import Text, mix, pieces

#: Bytes that the hash looks back on: every byte shifts it by two of its 32 bits.
WINDOW = 16
MEAN_BITS = 5
#: Gaps longer than ``QUIET`` are cut where the hash is highest within ``NEAR`` bytes around,
#: so that text of one repeated word or line, which may never meet the mask, has cuts too.
QUIET = 160
NEAR = 32
LONGEST = 512
LEAST_BYTES = 96

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(text: Text) -> np.ndarray:
    """Rolling hash after each byte; the bytes before a text's start count as nothing."""
    n = len(text.starts) - 1
    where = np.arange(len(text.data)) + np.repeat(np.arange(1, n + 1) * WINDOW, np.diff(text.starts))
    value = np.zeros(len(text.data) + (n + 1) * WINDOW, np.uint32)
    value[where] = _GEAR[text.data]
    reach = 1
    while reach < WINDOW:  # each round doubles how far back a value reaches
        value[reach:] += value[:-reach] << np.uint32(2 * reach)
        reach *= 2
    return value[where]


def chunk_ends(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every chunk; none crosses a text or splits a character."""
    size = len(text.data)
    inner = np.zeros(size + 1, bool)
    inner[:size] = (text.data & 0xC0) == 0x80
    cut = np.zeros(size + 1, bool)
    value = gear_hash(text)
    cut[1:] = value >> np.uint32(32 - MEAN_BITS) == 0
    cut &= ~inner
    cut[text.starts] = True
    at = np.flatnonzero(cut)
    for i in np.flatnonzero(np.diff(at) > QUIET):
        gap = value[at[i] : at[i + 1]]
        around = sliding_window_view(gap, 2 * NEAR + 1).max(1)
        cut[at[i] + NEAR + 1 + np.flatnonzero(gap[NEAR:-NEAR] == around)] = True
    cut &= ~inner
    cut[text.starts] = True
    at = np.flatnonzero(cut)
    long = np.flatnonzero(np.diff(at) > LONGEST)
    if len(long):
        more = [np.arange(at[i] + LONGEST, at[i + 1], LONGEST) for i in long]
        extra = np.concatenate(more)
        for _ in range(3):
            extra = extra + inner[extra]
        at = np.unique(np.concatenate([at, extra]))
    return at[:-1], at[1:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for piece in pieces(batch.column(1), 500_000):
            if not len(piece.data):
                continue
            begin, end = chunk_ends(piece)
            raw = piece.data.tobytes()
            digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            text = np.searchsorted(piece.starts, begin, "right") - 1
            begin, end = begin - piece.starts[text], end - piece.starts[text]
            digest, more = np.frombuffer(digest, np.int64).reshape(-1, 2).T.copy()
            more[end - begin < LEAST_BYTES] = 0
            order = np.lexsort((digest, text))  # stable, so of equal chunks of a text the earliest comes first
            again = np.zeros(len(order), bool)
            again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (more[order[1:]] == more[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
            columns = [digest, more, ids[piece.first + text], begin.astype(np.int32), end.astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "more", "doc_id", "start_byte", "end_byte", "again"])


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES, inside: bool = False) -> DataFrame:
    """One row per span that repeats text of earlier documents or, with ``inside``, earlier text of its own.

    Columns: doc_id, start_byte and end_byte in the UTF-8 text (end exclusive), chunks,
    first_doc_ids (sorted documents in which its chunks occur first).  Null and empty
    texts, and rows without doc_id, have no spans.  Rows repeated with one doc_id repeat
    nothing of each other.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = texts.mapInArrow(_chunks, "digest long, more long, doc_id long, start_byte int, end_byte int, again boolean")
    if not inside:
        chunks = chunks.withColumn("again", F.lit(False))
    shared = chunks.groupBy("digest", "more").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.max("again").alias("any")).where("first_doc_id < last or any")
    # Written first: straight from the aggregate, the join below would inherit its partitions,
    # and adaptive execution could not split that of a very common chunk.
    shared = cut(shared)
    again = chunks.join(shared.drop("last", "any"), ["digest", "more"]).where("doc_id > first_doc_id or again").drop("digest", "more", "again").distinct()
    order = Window.partitionBy("doc_id").orderBy("start_byte")
    fresh = F.coalesce(F.lag("end_byte").over(order) != F.col("start_byte"), F.lit(True)).cast("int")
    island = again.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    spans = island.groupBy("doc_id", "island").agg(
        F.min("start_byte").alias("start_byte"),
        F.max("end_byte").alias("end_byte"),
        F.count("*").alias("chunks"),
        F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )
    return spans.where(F.col("end_byte") - F.col("start_byte") >= least_bytes).drop("island")


def remove_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES, inside: bool = False) -> DataFrame:
    """``docs`` with repeated spans cut out of text; n_chars, if there, follows."""
    spans = repeated_spans(docs, least_bytes, inside).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_spans"))
    joined = docs.join(spans.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    raw, kept, end = texts[i].encode(), [], 0
                    for s in spans:
                        kept.append(raw[end : s["start_byte"]])
                        end = s["end_byte"]
                    texts[i] = b"".join([*kept, raw[end:]]).decode()
            out = batch.select(names).set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))
            yield out

    cleaned = joined.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned
