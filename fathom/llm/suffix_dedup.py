"""Suffix-array dedup: bytes that lie in a string of ``length`` bytes which starts elsewhere too.

A global suffix array needs no single machine: only suffixes that agree in ``length`` bytes
matter, and those are brought together first.

1. Every window of ``length`` bytes is dealt by the least hash among the strings of ``GRAM``
   bytes in it, so equal windows have equal keys wherever they stand.  Neighbouring windows of
   one key make a segment of text.  Keys of one string can hold no repeat; they are gone
   after one aggregation, and only the text of distinct segments of the others is sent.
2. Strings that many documents share would draw windows with all sorts of surroundings to one
   key.  So frequent strings, counted on a bounded sample of texts, come last in the order, and
   a window is dealt by one only if it has no other.  Should a key still hold more than
   ``HEAVY`` bytes of distinct segments, its string comes last as well and segments are made
   anew.  The order decides who meets where, never what is found.
3. Whole keys are packed into shards of about ``SHARD`` bytes.  The suffixes of every key of a
   shard are sorted by induced sorting, all keys side by side; common prefixes with the neighbour
   in that order are taken in text order, and a window is repeated if either neighbour shares
   ``length`` bytes.  Of a segment that occurs several times two copies enter, so the array shows
   that it repeats.
4. Repeated windows go back to all places of their segments, and each text is cut once.

Segments and strings are told apart by polynomial hashes, 128 bits for both together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.graph import cut
from fathom.llm.near_dedup import _runs
from fathom.llm.suffix_array import common_prefixes, suffix_arrays
from fathom.llm.words import Text, pieces, prefix_hash, span_hash

LENGTH = 200
GRAM = 48
#: Most windows in one segment; text of one repeated letter or line has one key throughout.
RUN = 1024
SHARD = 1_500_000
HEAVY = 32_000_000
PIECE = 400_000
#: Bytes of texts on which frequent strings are counted, in parts of ``FIT_PART`` bytes.
FIT_BYTES = 32_000_000
FIT_PART = 8_000_000
#: A string is frequent if it occurs in one of so many sampled texts; at most so many strings are.
FREQUENT = 500
MOST_FREQUENT = 200_000
_BITS = 22
_LATE = np.uint64(1 << 63)


def _keys(text: Text, gram: int, late: np.ndarray | None) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on; those that ``late`` marks have the top bit."""
    run = prefix_hash(text.data, fold_case=False)
    begin = np.arange(max(len(text.data) - gram + 1, 0))
    key = span_hash(run, begin, begin + gram) >> np.uint64(1)
    if late is not None:
        key[late[key & np.uint64((1 << _BITS) - 1)]] |= _LATE
    return key


def _segments(text: Text, length: int, gram: int, late: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Key, digest, begin and end (in ``text.data``) of every segment, and the text that it is of."""
    n = len(text.data)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    least = _sliding(_keys(text, gram, late), length - gram + 1, True)
    owner = np.repeat(np.arange(len(text.starts) - 1), np.diff(text.starts))
    whole = np.flatnonzero(owner[: len(least)] == owner[length - 1 :])
    least = least[whole]
    if not len(least):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1] + 1) | (owner[whole[1:]] != owner[whole[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(least)))
    if size.max() > RUN:
        parts = -(-size // RUN)
        at = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        first, size = at, np.diff(np.append(at, len(least)))
    begin = whole[first]
    end = begin + size + length - 1
    digest = span_hash(prefix_hash(text.data, fold_case=False), begin, end)
    return least[first], digest, begin, end, owner[begin]


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of ``width`` values from each on."""
    pick, reach = np.minimum if least else np.maximum, 1
    while reach < width:
        step = min(reach, width - reach)
        values = pick(values[:-step], values[step:])
        reach += step
    return values


def _dealt_by(text: Text, length: int, gram: int, late: np.ndarray | None) -> np.ndarray:
    """Keys of the strings that some window is dealt by, one for each place where such a string stands."""
    if len(text.data) < length:
        return np.zeros(0, np.uint64)
    keys, width = _keys(text, gram, late), length - gram + 1
    least = _sliding(keys, width, True)
    owner = np.repeat(np.arange(len(text.starts) - 1), np.diff(text.starts))
    least[owner[: len(least)] != owner[length - 1 :]] = 0
    spare = np.zeros(width - 1, np.uint64)
    # A string's key is at least that of every window it is in; it deals a window if they are equal.
    return keys[_sliding(np.concatenate([spare, least, spare]), width, False) == keys]


def _repeated_windows(raw: list[bytes], counts: list[int], lane: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and last + 1 of runs of windows that stand more than once in the segments of one ``lane`` (rising)."""
    copies = np.minimum(counts, 2)
    source, own_lane = np.repeat(np.arange(len(raw)), copies), np.repeat(lane, copies)
    closes = np.append(own_lane[1:] != own_lane[:-1], True)
    size = np.array([len(r) for r in raw])[source]
    after = np.cumsum(size + 1 + closes)
    end = after - 1 - closes
    begin = end - size
    text = np.zeros(after[-1], np.uint16)  # 0 ends a lane, 1 a segment
    text[end] = 1
    inside = np.ones(len(text), bool)
    inside[end] = inside[after[closes] - 1] = False
    text[inside] = np.frombuffer(b"".join([raw[k] for k in source.tolist()]), np.uint8).astype(np.uint16) + 2
    order = suffix_arrays(text, np.append(0, after[closes][:-1]))
    shared = common_prefixes(text, order)[order] >= length
    again = np.zeros(len(text) + 1, np.int8)
    again[order] = shared
    again[order[:-1]] |= shared[1:]
    # Only where a window lies in its segment, and in one copy of each: the other tells the same.
    once = np.append(True, source[1:] != source[:-1])
    edge = np.zeros(len(text) + 1, np.int8)
    edge[begin[once]] += 1
    edge[end[once] - length + 1] -= 1
    again &= np.cumsum(edge, dtype=np.int8)
    turn = np.diff(again, prepend=np.int8(0))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    at = np.searchsorted(begin, first, "right") - 1
    return source[at], first - begin[at], last - begin[at]


#: ``place``: first byte times ``_LONGEST``, plus the length in bytes.
_PLACE = "key long, digest long, id long, name long, place long"
_LONGEST = 1 << 20


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` with text as size and packed: compressed once, before texts are shuffled."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raw = [x.as_buffer() for x in part.column("text")]
                columns = [pa.array([r.size for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, "size", "packed"])

    return texts.mapInArrow(run, texts.drop("text").schema.add("size", "long").add("packed", "binary"))


def unpacked(batch: pa.RecordBatch, row: int) -> bytes:
    """Bytes of a text from the columns size and packed."""
    size = batch.column("size")[row].as_py()
    return pa.Codec("zstd").decompress(batch.column("packed")[row].as_buffer(), size, asbytes=True) if size else b""


def _frequent(texts: DataFrame, gram: int) -> np.ndarray:
    """Marks, by the low bits of a key, of strings that many texts hold; from a bounded sample of texts."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    late = np.zeros(1 << _BITS, bool)
    share = min(1.0, FIT_BYTES / max(size, 1))
    sample = texts.where(F.pmod("name", F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = sample.repartition(max(1, min(size, FIT_BYTES) // FIT_PART))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = taken = 0

        def told() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(3, n // FREQUENT)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], ["key", "n"])

        for batch in batches:
            for piece in pieces(batch.column(2), PIECE):
                keys = _keys(piece, gram, None)
                owner = np.repeat(np.arange(len(piece.starts) - 1), np.diff(piece.starts))[: len(keys)]
                order = np.lexsort((keys, owner))
                once = np.ones(len(order), bool)  # a text counts once for each string
                once[1:] = (keys[order[1:]] != keys[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                held.append(keys[order[once]])
                n, taken = n + len(piece.starts) - 1, taken + len(keys)
                if taken > FIT_PART:
                    yield told()
                    held, n, taken = [], 0, 0
        if held:
            yield told()

    found = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT)
    for r in found.select((F.col("key").bitwiseAND((1 << _BITS) - 1)).cast("int").alias("k")).distinct().toLocalIterator():
        late[r.k] = True
    return late


def _places(texts: DataFrame, length: int, gram: int, late: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """All segments whose key occurs twice or more, and their distinct ones with count and a place."""
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(late))

    def marks() -> np.ndarray:
        return np.unpackbits(sent.value).astype(bool)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = marks()
        for batch in batches:
            for piece in pieces(batch.column(2), PIECE):
                key, n = np.unique(_dealt_by(piece, length, gram, last), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = marks()
        for batch in batches:
            for piece in pieces(batch.column(2), PIECE):
                key, digest, begin, end, text = _segments(piece, length, gram, last)
                row = pa.array(piece.first + text)
                columns = [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)]
                columns.append(pa.array((begin - piece.starts[text]) * _LONGEST + end - begin))
                yield pa.RecordBatch.from_arrays(columns, _columns(_PLACE))

    shared = cut(texts.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    found = cut(texts.mapInArrow(places, _PLACE).join(shared, "key", "left_semi"))
    distinct = found.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "name", "place")).alias("at"))
    return found, distinct.select("key", "digest", "n", "at.*")


def _spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, name, spans): repeated bytes of each text that has any; spans may overlap."""
    late = _frequent(texts, gram)
    while True:
        found, distinct = _places(texts, length, gram, late)
        distinct = cut(distinct)
        heavy = distinct.groupBy("key").agg(F.sum(F.col("place") % _LONGEST).alias("n")).where((F.col("n") > HEAVY) & (F.col("key") >= 0))
        more = [r.key & ((1 << _BITS) - 1) for r in heavy.select("key").toLocalIterator()]  # a few: each has HEAVY bytes
        if not more:
            break
        late[more] = True

    asked = distinct.groupBy("id", "name").agg(F.collect_list(F.struct("key", "digest", "n", "place")).alias("asked"))
    taken = packed(texts).join(asked, ["id", "name"]).select("size", "packed", "asked")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "n"]
        for batch in batches:
            held: list[pa.RecordBatch] = []
            size = 0
            for i in range(len(batch)):
                raw, own = unpacked(batch, i), batch.column(2)[i].values
                at = [raw[p // _LONGEST : p // _LONGEST + p % _LONGEST] for p in own.field("place").to_pylist()]
                held.append(pa.RecordBatch.from_arrays([*(own.field(c) for c in names), pa.array(at, pa.binary())], [*names, "text"]))
                size += held[-1].nbytes
                if size > SHARD or i == len(batch) - 1:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            key, digest, n, text = (table[c].to_pylist() for c in table.column_names)
            own = list({(k, d): i for i, (k, d) in enumerate(zip(key, digest, strict=True))}.values())  # repeated rows bring a segment twice
            lane = np.cumsum([bool(j) and key[i] != key[own[j - 1]] for j, i in enumerate(own)])
            segment, first, last = _repeated_windows([text[i] for i in own], [n[i] for i in own], lane, length)
            if len(segment):
                row = pa.array(np.array(own)[segment])
                columns = [table["key"].combine_chunks().take(row), table["digest"].combine_chunks().take(row), pa.array(first.astype(np.int32)), pa.array((last + length - 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "first", "last"])

        for table in _runs(batches, ["key"]):
            held.append(table)
            size += table["text"].nbytes
            if size >= SHARD:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    segments = taken.mapInArrow(take, "key long, digest long, n long, text binary").repartition("key").sortWithinPartitions("key")
    repeats = cut(segments.mapInArrow(sort, "key long, digest long, first int, last int"))
    start = F.floor(F.col("place") / _LONGEST).cast("int")
    back = found.join(repeats, ["key", "digest"]).select("id", "name", (start + F.col("first")).alias("begin"), (start + F.col("last")).alias("end"))
    return back.distinct().groupBy("id", "name").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _removed(spans: pa.Array | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that lie in ``spans``."""
    if spans is None:
        return []
    begin, end = spans.field("begin").to_numpy(), spans.field("end").to_numpy()
    order = np.lexsort((end, begin))
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return list(zip(begin[fresh].tolist(), end[np.append(fresh[1:], len(end)) - 1].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is left of its UTF-8 bytes.

    A byte is removed if a string of ``length`` bytes that covers it also starts at another
    place, in the same text or any other; strings never cross texts.  Columns: doc_id, n_bytes,
    spans (removed runs as begin and end, in order), kept (the remaining bytes; they need not be
    valid UTF-8).  Null texts count as empty.  Rows that are repeated, and rows without doc_id,
    are texts like any other, so they repeat one another.  ``gram``: length of the strings that
    windows are dealt by, from 1 to ``length``; it changes nothing in the result.
    """
    gram = min(GRAM, max(1, length // 2)) if gram is None else gram
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(own).alias("name"), own.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    spans = _spans(texts.where(F.octet_length("text") >= length).drop("doc_id"), length, gram)
    joined = packed(texts).join(spans, ["id", "name"], "left").select("doc_id", "size", "packed", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sizes, runs, kept = [], [], []
                for i in range(len(part)):
                    raw = unpacked(part, i)
                    own = _removed(part.column("spans")[i].values)
                    edges = [0, *(x for run in own for x in run), len(raw)]
                    sizes.append(len(raw))
                    runs.append([{"begin": a, "end": b} for a, b in own])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(clean, "doc_id long, n_bytes long, spans array<struct<begin: int, end: int>>, kept binary")


def removal_report(cleaned: DataFrame) -> DataFrame:
    """Counts and the digest of what is left, from the rows of ``suffix_dedup``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]))
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
