"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Rotations learned on a bounded sample (iterative quantisation) turn vectors into balanced
   binary codes.  A code is cut into ``tables`` disjoint substrings of ``bits`` bits each.
2. Every substring has a hash table of its own.  Vectors of one label that agree in one
   substring meet in a bucket of its table, so a pair whose codes differ in fewer bits than
   there are tables is met for certain.  Of those that meet, the ones within Hamming distance
   ``reach`` of each other by their whole codes go on.
3. Cosines of the original vectors, in double precision, decide.  A pair is counted in the
   first table in which it meets.

``bits``, ``tables`` and ``reach`` come from the data: the sample's vectors are turned by the
angle of the threshold, part of the way at random and part of the way along differences of
other vectors, and the cheapest tables that find ``RECALL`` of these pairs are taken.  Cost is
that of ``n`` vectors in the largest label, so more vectors mean more bits and more tables, and
buckets stay small.  Equal vectors of one label are one class, indexed once.

Buckets larger than ``BLOCK`` are cut into blocks and pairs of blocks are separate groups of
rows; codes alone are compared there, and only rows with a close code bring their vectors.  A
block gives back counts and at most one edge a vector, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.graph import components, cut
from fathom.llm.near_dedup import _groups, _runs
from fathom.llm.words import mix

BLOCK = 1024
#: Most vectors that the rotations are learned on; those with the lowest hash of vec_id.
FIT_ROWS = 8192
#: Most numbers in all of them together; vectors beyond it are left out of the fit.
FIT_VALUES = 4_000_000
#: Of the sample, the vectors that each single rotation is learned on.
TURN_ROWS = 2048
#: Share of pairs at the threshold that the tables are built to find.
RECALL = 0.997
#: A label with fewer vectors in the sample is centred on the mean of all.
OWN_MEAN = 32
#: Cost of carrying a vector to a table, in comparisons of two codes.
CARRY = 200


class Codes(NamedTuple):
    """How vectors of one length become codes of ``tables`` substrings of ``bits`` bits."""

    means: dict[int | None, np.ndarray]
    turns: np.ndarray
    bits: int
    tables: int
    reach: int

    def substrings(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """One number per vector and table."""
        centre = np.stack([self.means.get(x, self.means[None]) for x in labels.tolist()])
        on = ((unit - centre) @ self.turns)[:, : self.bits * self.tables] > 0
        weights = np.uint32(1) << np.arange(self.bits, dtype=np.uint32)
        return (on.reshape(len(unit), self.tables, self.bits) * weights).sum(2, dtype=np.uint32)


def learn_rotation(centred: np.ndarray, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Projection: principal axes, rotated so that signs lose least (ITQ)."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(centred.T @ centred)
    flat = centred[rng.permutation(len(centred))[:TURN_ROWS]] @ axes
    turn = np.linalg.qr(rng.normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    return axes @ turn


def _turned(unit: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Each vector turned by the angle of cosine ``least``: half of them at random, half towards others."""
    aim = rng.normal(size=unit.shape)
    some = rng.random(len(unit)) < 0.5
    other = unit[rng.permutation(len(unit))] - unit[rng.permutation(len(unit))]
    aim[some] = other[some]
    aim -= (aim * unit).sum(1, keepdims=True) * unit
    size = np.linalg.norm(aim, axis=1, keepdims=True)
    return least * unit + (1 - least**2) ** 0.5 * np.divide(aim, size, out=np.zeros_like(aim), where=size > 1e-12)


def fit_codes(unit: np.ndarray, labels: np.ndarray, n: int, least: float, seed: int = 11) -> Codes:
    """Rotations and tables for ``n`` vectors of one label, from sampled unit vectors and their labels."""
    dim, rng = unit.shape[1], np.random.default_rng(seed)
    means: dict[int | None, np.ndarray] = {None: unit.mean(0)}
    names, at, size = np.unique(labels, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(size >= OWN_MEAN):
        means[int(names[k])] = unit[at == k].mean(0)
    # Rotations fit the vectors they are learned on better than others: half are kept to count on.
    learned, judged = (np.arange(0, len(unit), 2), np.arange(1, len(unit), 2)) if len(unit) >= 64 else (np.arange(len(unit)),) * 2
    near = _turned(unit, least, rng)
    # Neighbours in a shuffled order by label: pairs of one label, as buckets bring them together.
    order = judged[np.lexsort((rng.random(len(judged)), at[judged]))]
    a, b = order[:-1][at[order[:-1]] == at[order[1:]]], order[1:][at[order[:-1]] == at[order[1:]]]
    best = None
    for centres in (means, {None: np.zeros(dim)}):
        centre = np.stack([centres.get(x, centres[None]) for x in labels.tolist()])
        learn = lambda k, centre=centre: learn_rotation((unit - centre)[learned], seed=seed + k)
        turns = [learn(k) for k in range(max(1, -(-256 // dim)))]
        signs = lambda x, turns=turns, centre=centre: (x - centre) @ np.concatenate(turns, 1) > 0
        own, theirs = signs(unit), signs(near)
        same, other = (own == theirs)[judged].mean(1), (own[a] == own[b]).mean(1) if len(a) else np.array([0.5])
        for bits in range(1, 33):
            tables = 1
            missed = (1 - same**bits).clip(0, 1)
            while (missed**tables).mean() > 1 - RECALL:
                tables += -(-tables // 8)
            cost = tables * (CARRY + n * (other**bits).mean())
            if best is None or cost < best[0]:
                best = (cost, bits, tables, centres, turns, learn)
    _, bits, tables, centres, turns, learn = best
    while len(turns) * dim < bits * tables:
        turns.append(learn(len(turns)))
    made = Codes(centres, np.concatenate(turns, 1)[:, : bits * tables], bits, tables, 0)
    # As far as any of the pairs is apart, and one deviation more.
    apart = np.bitwise_count(made.substrings(unit[judged], labels[judged]) ^ made.substrings(near[judged], labels[judged])).sum(1)
    return made._replace(reach=int(np.ceil(apart.max() + apart.std())))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    nulls = column.flatten().is_null().to_numpy(zero_copy_only=False)
    size = np.asarray(column.value_lengths().fill_null(0))
    ends = np.cumsum(size)
    out: list[np.ndarray | None] = []
    for begin, end in zip(ends - size, ends, strict=True):
        own = values[begin:end]
        most = np.abs(own).max(initial=0.0)
        if nulls[begin:end].any() or not np.isfinite(most) or most == 0 or np.isnan(own).any():
            out.append(None)
            continue
        own = own / most
        out.append(own / np.sqrt(own @ own))
    return out


def _encode(batches: Iterator[pa.RecordBatch], models: dict[int, Codes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        vectors = [None if label is None else v for v, label in zip(_vectors(batch.column(2)), labels, strict=True)]
        digest: list[bytes | None] = [None] * len(vectors)
        code: list[bytes | None] = [None] * len(vectors)
        keys: list[np.ndarray | None] = [None] * len(vectors)
        for dim in {len(v) for v in vectors if v is not None}:
            at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
            unit, own = np.stack([vectors[i] for i in at]), np.array([labels[i] for i in at], np.int64)
            # Vectors of a length that the sample lacks are rare: they meet by label alone.
            model = models.get(dim) or Codes({None: np.zeros(dim)}, np.zeros((dim, 1)), 1, 1, 1)
            parts = model.substrings(unit, own)
            salt = mix(np.arange(1, model.tables + 1, dtype=np.uint64) + np.uint64(dim) * np.uint64(1 << 20))
            key = mix(parts.astype(np.uint64) + mix(salt[None] + own.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
            for k, i in enumerate(at):
                keys[i], code[i] = key[k], parts[k].tobytes()
                digest[i] = hashlib.blake2b(unit[k].tobytes() + own[k].tobytes(), digest_size=16).digest()
        raw = [None if v is None else v.tobytes() for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["vec_id", "digest", "unit", "code", "keys"],
        )


def _stars(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges from each vertex of a component to its first one."""
    left = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.flatnonzero(linked[root] & left)
        while len(front):
            left[front] = False
            yield from ((root, int(x)) for x in front)
            front = np.flatnonzero(linked[front].any(0) & left)


_KEYS = ["place", "key", "i", "j"]


class _Group(NamedTuple):
    """Rows of two blocks of a bucket, or of one; ``code``: one number per row and table."""

    rows: slice
    code: np.ndarray
    block: np.ndarray
    cross: bool
    place: int

    def close(self, at: int, reach: dict[int, int]) -> np.ndarray:
        """Rows that meet row ``at`` here first and whose codes are within reach of its code."""
        apart = self.code ^ self.code[at]
        near = np.bitwise_count(apart).sum(1, dtype=np.int32) <= reach.get(self.code.shape[1], 32 * self.code.shape[1])
        near &= (apart[:, : self.place] != 0).all(1)
        near[at] = False
        return near & (self.block != self.block[at]) if self.cross else near


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, _Group]]:
    for table in _runs(batches, _KEYS):
        block, place = table["block"].to_numpy(), table["place"].to_numpy()
        cross, code = table["i"].to_numpy() != table["j"].to_numpy(), table["code"].to_pylist()
        for start, end in _groups(table, _KEYS):
            if end - start > 1:
                own = np.stack([np.frombuffer(x, np.uint32) for x in code[start:end]])
                yield table, _Group(slice(start, end), own, block[start:end], bool(cross[start]), int(place[start]))


def _retrieve(batches: Iterator[pa.RecordBatch], reach: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket that have a row with a close code there."""
    for table, group in _buckets(batches):
        found = np.array([group.close(at, reach).any() for at in range(len(group.code))])
        if found.any():
            yield from table.slice(group.rows.start, len(found)).drop_columns("code").filter(pa.array(found)).to_batches()


def _rerank(batches: Iterator[pa.RecordBatch], reach: dict[int, int], least: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, root, links): links counted here, and one edge into the component seen here."""
    for table, group in _buckets(batches):
        part = table.slice(group.rows.start, len(group.code))
        ids, copies = part["vec_id"].to_numpy(), part["copies"].to_numpy()
        unit = np.stack([np.frombuffer(x, np.float64) for x in part["unit"].to_pylist()])
        linked = unit @ unit.T >= least
        linked |= linked.T  # the product may differ in its last bit from side to side
        for at in np.flatnonzero(linked.sum(1) > 1):
            linked[at] &= group.close(at, reach)
        np.fill_diagonal(linked, False)
        n = (linked @ copies).astype(np.int64)
        out = [(ids[x], ids[root], 0) for root, x in _stars(linked)] + [(ids[x], ids[x], n[x]) for x in np.flatnonzero(n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["vec_id", "root", "links"])


def embedding_duplicates(table: DataFrame, least: float = 0.93, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``table`` has vec_id, embedding (array of float or double) and label (integer); other
    columns are ignored.  Vectors link when labels are equal, lengths are equal and their
    cosine is at least ``least``.  Null labels, and vectors that are null, empty, zero or
    hold nulls, NaN or infinities, link with nothing, like rows without vec_id, whose
    component is NULL.  Every row counts as a vector.
    """
    rows = table.select(F.col("vec_id").cast("long"), F.when(F.col("vec_id").isNotNull(), F.col("label").cast("long")).alias("label"), F.col("embedding").cast("array<double>"))
    known = rows.where("embedding is not null and label is not null")
    sample: dict[int, list[tuple[np.ndarray, int]]] = {}
    values = 0
    for r in known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding", "label").toLocalIterator():
        values += len(r.embedding)
        if values > FIT_VALUES:
            break
        for v in _vectors(pa.array([r.embedding], pa.list_(pa.float64()))):
            if v is not None:
                sample.setdefault(len(v), []).append((v, r.label))
    n = known.groupBy("label").count().agg(F.max("count").alias("n")).first().n or 0
    models = {dim: fit_codes(np.stack([v for v, _ in own]), np.array([x for _, x in own]), n, least) for dim, own in sample.items()}
    reach = {m.tables: max(o.reach for o in models.values() if o.tables == m.tables) for m in models.values()}
    coded = cut(rows.mapInArrow(lambda batches: _encode(batches, models), "vec_id long, digest binary, unit binary, code binary, keys array<long>"))
    classes = coded.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    mine = coded.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("vec_id") == F.col("rep")))
    reps = cut(mine.select("vec_id", "copies", "unit", "code", "keys").dropDuplicates(["vec_id"]))
    spread = reps.select("vec_id", F.posexplode("keys").alias("place", "key"))
    # Buckets with the same members are worked on once, in the first of their tables.
    buckets = (
        spread.groupBy("place", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("vec_id")).alias("who")).where("n > 1")
        .groupBy("n", "who").agg(F.min(F.struct("place", "key")).alias("first"))
        .select("first.place", "first.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    member = spread.join(buckets, ["place", "key"])
    member = member.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("vec_id", "place", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def dealt(parts: DataFrame) -> DataFrame:
        return parts.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "vec_id")

    close = dealt(member.join(reps.select("vec_id", "code"), "vec_id"))
    close = cut(close.mapInArrow(lambda batches: _retrieve(batches, reach), "vec_id long, place int, key long, block int, i int, j int"))
    asked = dealt(close.join(reps.drop("keys"), "vec_id"))
    found = cut(asked.mapInArrow(lambda batches: _rerank(batches, reach, least), "vec_id long, root long, links long"))
    links = found.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    group = components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")).distinct())
    named = (
        classes.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = coded.select("vec_id", "digest").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
