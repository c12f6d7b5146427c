"""Near-duplicate documents: banded MinHash candidates, odd-sketch filter, exact check.

1. Each text becomes its set of distinct word shingles (64-bit hashes).  Texts with equal
   sets form one class, and only one representative of a class goes on.
2. A MinHash signature feeds two things: bands of ``ROWS`` values that put likely pairs in
   one bucket, and an odd sketch, a bitmap in which every sample flips one bit.  The number
   of bits in the XOR of two sketches estimates their similarity closely where it is high.
3. Within a bucket only edges that could join components are proposed: a minimum spanning
   forest under sketch distance, or, in a bucket too large for one task, a star around its
   first document.  Each edge is confirmed on the full shingle sets.
4. Pairs that share a bucket, whose estimate lies within the sketch's margin and that are
   still in different components are then compared on full sets, bucket by bucket; a bucket
   gives back only the links that join components, never its pairs.  So no link below the
   threshold is made, and every link counts that shares a bucket and lies in the margin.

Buckets of more than ``BLOCK`` rows or ``BLOCK_SHINGLES`` shingles are cut into blocks.  A row
stays in its own block; only those outside the component that most of the bucket belongs to
visit the other blocks, and they stream past them.  So no task holds an unbounded bucket, and
a bucket of n near copies costs about n steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.graph import components, cut, join_spread
from fathom.llm.words import mix, pieces, shingles, words

SAMPLES = 512
BANDS = 32
ROWS = 4
SKETCH_BITS = 2048
BLOCK = 512
BLOCK_SHINGLES = 4_000_000
#: Standard deviations of the sketch's estimate that a candidate may lie under the threshold.
MARGIN = 3.5

_SEED = np.random.default_rng(20240607)
_FACTORS = (_SEED.integers(1, 1 << 63, SAMPLES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def minhash(values: np.ndarray) -> np.ndarray:
    low = None
    for at in range(0, len(values), 128):
        part = (values[at : at + 128, None] * _FACTORS[None]).min(0)
        low = part if low is None else np.minimum(low, part)
    return low


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity of the number of samples that fall on each bit."""
    bits = (mix(samples ^ _SALTS) >> np.uint64(32)) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for part in samples[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix(key + part)
    return key.view(np.int64)


def max_distance(threshold: float) -> int:
    """Most differing sketch bits of a pair that may still reach ``threshold``.

    Two errors add up: that of the share of equal samples, and that of bits hit twice.
    """
    flips = 2 * SAMPLES * (1 - threshold)
    decay = np.exp(-2 * flips / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - decay)
    sampling = 2 * SAMPLES * decay * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    folding = max(0.0, SKETCH_BITS / 4 * (1 - decay**2) - flips * decay**2) ** 0.5
    return int(np.ceil(mean + MARGIN * np.hypot(sampling, folding)))


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(1)):
            hashes, first = shingles(words(piece), size)
            n, digest, bands, sketch = [], [], [], []
            for i in range(len(first) - 1):
                own = np.unique(hashes[first[i] : first[i + 1]])
                n.append(len(own))
                if not len(own):
                    digest.append(None), bands.append(None), sketch.append(None)
                    continue
                low = minhash(own)
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                sketch.append(odd_sketch(low))
            ids = batch.column(0).slice(piece.first, len(n))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], whole: list[str] | None = None) -> Iterator[pa.Table]:
    """Groups of rows with equal ``keys`` in sorted input, as many as one batch ends.

    Groups are whole, but for those whose columns outside ``whole`` (if given) are set: these
    come in parts, as they are read.
    """
    held: list[pa.RecordBatch] = []
    parts = [k for k in keys if whole is not None and k not in whole]

    def last_key(batch):
        return [batch.column(k)[len(batch) - 1].as_py() for k in keys]

    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        if held and [batch.column(k)[0].as_py() for k in keys] != last_key(held[-1]):
            change[0] = True
        starts = np.flatnonzero(change)
        if len(starts):
            if starts[-1]:
                held.append(batch.slice(0, starts[-1]))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
        if parts and all(held[-1].column(k)[0].as_py() for k in parts):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    change = np.zeros(len(table), bool)
    change[0] = True
    for k in keys:
        x = table[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts, [*starts[1:], len(table)], strict=True)


def _distances(sketch: np.ndarray, n: np.ndarray, at: int, percent: int) -> np.ndarray:
    """Sketch distance of all rows to row ``at``; sets too unequal in size to link are far."""
    bits = np.bitwise_count(sketch ^ sketch[at]).sum(1, dtype=np.int32)
    small, large = np.minimum(n, n[at]), np.maximum(n, n[at])
    bits[100 * small < percent * large] = SKETCH_BITS + 1
    return bits


def _forest(sketch, n, far, percent):
    """Edges of a minimum spanning forest."""
    left = np.ones(len(n), bool)
    best = np.full(len(n), SKETCH_BITS + 1, np.int32)
    via = np.zeros(len(n), np.int64)
    at = 0
    while True:
        left[at] = False
        bits = _distances(sketch, n, at, percent)
        closer = left & (bits < best)
        best[closer], via[closer] = bits[closer], at
        if not left.any():
            return
        at = int(np.where(left, best, SKETCH_BITS + 2).argmin())
        if best[at] <= far:
            yield via[at], at


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _propose(batches: Iterator[pa.RecordBatch], far: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Forest edges of every bucket, the smaller id first."""
    for table in _runs(batches, ["key"]):
        ids, n = table["doc_id"].to_numpy(), table["n_shingles"].to_numpy()
        sketch, out = _sketches(table["sketch"]), []
        for start, end in _groups(table, ["key"]):
            own = slice(start, end)
            out.extend((ids[start + a], ids[start + b]) for a, b in _forest(sketch[own], n[own], far, percent))
        if out:
            pairs = np.unique(np.sort(np.array(out, np.int64), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _close(batches: Iterator[pa.RecordBatch], far: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with sketches and sizes, those that the sketches do not rule out."""
    for batch in batches:
        bits = np.bitwise_count(_sketches(batch.column("sketch_a")) ^ _sketches(batch.column("sketch_b"))).sum(1, dtype=np.int32)
        n_a, n_b = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
        near = (bits <= far) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
        yield batch.select(["a", "b"]).filter(pa.array(near))


_PLACE = ["key", "block"]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(rows of a block, rows that meet them): the block itself, then its visitors in parts.

    Input is sorted by key, block and visit, so a block is whole before the first visitor comes.
    """
    own: pa.Table | None = None
    for table in _runs(batches, [*_PLACE, "visit"], whole=_PLACE):
        for start, end in _groups(table, [*_PLACE, "visit"]):
            part = table.slice(start, end - start)
            if part["visit"][0].as_py():
                if own is not None and all(own[k][0] == part[k][0] for k in _PLACE):
                    yield own, part
            else:
                own = part
                yield own, part


def _remaining(batches: Iterator[pa.RecordBatch], far: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows with a close row of another component that they meet here first."""
    for own, other in _meetings(batches):
        sketch, n, component = _sketches(own["sketch"]), own["n_shingles"].to_numpy(), own["component"].to_numpy()
        bands = own["bands"].combine_chunks().flatten().to_numpy().reshape(len(own), BANDS)
        band = own["band"][0].as_py()
        theirs = _sketches(other["sketch"]), other["n_shingles"].to_numpy(), other["component"].to_numpy(), other["bands"].combine_chunks().flatten().to_numpy().reshape(len(other), BANDS)
        flagged, met = np.zeros(len(own), bool), np.zeros(len(other), bool)
        for at in np.flatnonzero(other["outside"].to_numpy(zero_copy_only=False)):
            bits = np.bitwise_count(sketch ^ theirs[0][at]).sum(1, dtype=np.int32)
            size = theirs[1][at]
            near = (bits <= far) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (component != theirs[2][at])
            found = np.flatnonzero(near)
            if band:
                found = found[(bands[found, :band] != theirs[3][at, :band]).all(1)]
            if len(found):
                flagged[found] = met[at] = True
        for table, mark in ((own, flagged), (other, met)):
            if mark.any():
                yield from table.select(_FLAGGED).filter(pa.array(mark)).to_batches()


_FLAGGED = ["key", "block", "visit", "doc_id", "component", "outside"]


def _settle(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components, found on full sets; at most one fewer than a block's components."""
    held, joined = None, {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for own, other in _meetings(batches):
        if held is not own:
            held, joined = own, {}
            sets = list(_sets(own["text"].combine_chunks(), size))
            n = np.array([len(s) for s in sets])
            everything, owner = np.concatenate(sets), np.repeat(np.arange(len(own)), n)
            component = own["component"].to_numpy()
        out = []
        theirs, outside = other["component"].to_numpy(), other["outside"].to_numpy(zero_copy_only=False)
        for at, mine in enumerate(sets if other is own else _sets(other["text"].combine_chunks(), size)):
            if not outside[at] or not len(mine):
                continue
            place = np.searchsorted(mine, everything).clip(max=len(mine) - 1)
            both = np.bincount(owner[mine[place] == everything], minlength=len(own))
            for to in np.unique(component[100 * both >= percent * (n + len(mine) - both)]).tolist():
                a, b = root(to), root(int(theirs[at]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    out.append((to, theirs[at]))
        if out:
            pairs = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for piece in pieces(column):
        hashes, first = shingles(words(piece), size)
        for i in range(len(first) - 1):
            yield np.unique(hashes[first[i] : first[i + 1]])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for one, two in zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size), strict=True):
            both = len(np.intersect1d(one, two, assume_unique=True))
            same.append(100 * both >= percent * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.bool_())], ["a", "b", "linked"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id and text; other columns are ignored.  Null, empty and blank texts
    have no shingles, link with nothing and are kept; so do rows without doc_id, whose
    component is NULL.  Repeated rows of one doc_id with one text give equal rows.
    """
    far = max_distance(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut(
        texts.mapInArrow(
            lambda batches: _signatures(batches, size),
            "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary",
        )
    )
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    mine = (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep"))
    reps = full.join(classes.withColumnRenamed("digest", "d"), mine, "left_semi").dropDuplicates(["doc_id"])
    reps = cut(reps.select("doc_id", "n_shingles", "bands", "sketch"))
    rows = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    # Buckets with the same members are worked on once.
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("first.weight") / BLOCK_SHINGLES)).cast("int")
    buckets = (
        rows.groupBy("band", "key")
        .agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("doc_id")).alias("who"), F.min("doc_id").alias("lead"), F.sum("n_shingles").alias("weight"))
        .where("members > 1").groupBy("members", "who").agg(F.min(F.struct("band", "key", "lead", "weight")).alias("first"))
        .select("first.band", "first.key", "first.lead", blocks.alias("blocks"))
    )
    member = rows.drop("n_shingles").join(buckets, ["band", "key"])
    member = cut(member.withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int")))

    def dealt(parts: DataFrame, *order: str) -> DataFrame:
        return parts.repartition(*_PLACE).sortWithinPartitions(*_PLACE, *order, "doc_id")

    within = dealt(member.where("blocks = 1").select("doc_id", *_PLACE).join(reps.drop("bands"), "doc_id"))
    pairs = within.mapInArrow(lambda batches: _propose(batches, far, percent), "a long, b long")
    star = cut(member.where("blocks > 1 and doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct())
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    star = join_spread(star, side("a"), "a", star.count()).join(side("b"), "b")
    pairs = cut(pairs.unionByName(star.mapInArrow(lambda batches: _close(batches, far, percent), "a long, b long")).distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    compared = cut(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    one = compared.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = compared.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    asked = join_spread(pairs, one, "a", pairs.count()).join(two, "b").select("a", "b", "text_a", "text_b")
    checked = asked.mapInArrow(lambda batches: _confirm(batches, size, percent), "a long, b long, linked boolean")
    group = cut(components(cut(checked.where("linked").select("a", "b"))))
    # What is still apart: compared in the buckets where more than one component meets.
    named = member.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = cut(named.select("doc_id", "band", *_PLACE, "blocks", F.coalesce("component", "doc_id").alias("component")))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.max("blocks").alias("blocks")).where("parts > 1")
    mixed = cut(mixed.select("key", "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    here = named.join(mixed, _PLACE).withColumns({"outside": F.col("component") != F.col("main"), "visit": F.lit(0)}).drop("main")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    visits = here.where("outside and blocks > 1").withColumns({"block": F.explode(others), "visit": F.lit(1)})
    met = dealt(here.unionByName(visits).drop("blocks").join(reps, "doc_id"), "visit")
    flagged = cut(met.mapInArrow(lambda batches: _remaining(batches, far, percent), "key long, block int, visit int, doc_id long, component long, outside boolean").distinct())
    # Rows of large buckets may be flagged without an edge so far.
    more = cut(flagged.select("doc_id").distinct().join(wanted, "doc_id", "left_anti"))
    if not more.isEmpty():
        compared = compared.unionByName(cut(texts.join(more, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    asked = dealt(flagged.join(compared, "doc_id"), "visit")
    joined = asked.mapInArrow(lambda batches: _settle(batches, size, percent), "a long, b long")
    merged = cut(components(cut(joined.distinct())).withColumnRenamed("component", "final"))
    group = group.withColumnRenamed("node", "rep").join(merged.withColumnRenamed("node", "component"), "component", "left")
    group = group.select("rep", F.coalesce("final", "component").alias("component"))
    # Nodes that had no link before are components of their own name there.
    group = group.unionByName(merged.select(F.col("node").alias("rep"), F.col("final").alias("component"))).groupBy("rep").agg(F.min("component").alias("component"))
    named = classes.join(group, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
    out = signed.select("doc_id", "n_shingles", own).join(named, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each near-duplicate group."""
    removed = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_removed")).distinct()
    return docs.join(removed, F.col("doc_id") == F.col("_removed"), "left_anti")
