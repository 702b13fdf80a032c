"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .minhash import mix64

BITS = 512
WORDS = BITS // 64
FEATURES = "vec_id long, dim int, d1 long, d2 long, unit binary, signs array<long>"


@lru_cache(maxsize=8)
def hyperplanes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def sign_features(vectors: DataFrame, id_col: str, vector_col: str, seed: int) -> DataFrame:
    """Per vector a digest, the unit vector in double precision and the signs at ``BITS`` random hyperplanes; nulls where
    the vector is null, zero, or has null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for vector in batch.column(1).to_pylist():
                row = (0, None, None, None, None)
                if vector and None not in vector:
                    v = np.array(vector, np.float64) + 0.0
                    most = np.abs(v).max()
                    if np.isfinite(most) and most > 0:
                        unit = v / most
                        unit /= math.sqrt(float(unit @ unit))
                        digest = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                        signs = np.packbits(unit @ hyperplanes(len(v), seed) > 0).view(np.int64)
                        row = (len(v), int(digest[0]), int(digest[1]), unit.tobytes(), signs)
                out.append(row)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds))],
                names=["vec_id", "dim", "d1", "d2", "unit", "signs"],
            )

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, FEATURES)


def miss_probability(cosine: float, bits: int, tables: int) -> float:
    """Probability that two vectors at this cosine share no table, each reading ``bits`` of the ``BITS`` signs."""
    q = math.acos(cosine) / math.pi
    total = 0.0
    for d in range(BITS + 1):
        log_p = math.lgamma(BITS + 1) - math.lgamma(d + 1) - math.lgamma(BITS - d + 1) + d * math.log(q) + (BITS - d) * math.log1p(-q)
        hit = math.comb(BITS - d, bits) / math.comb(BITS, bits)
        total += math.exp(log_p) * (1 - hit) ** tables
    return total


def table_count(cosine: float, bits: int, miss: float) -> int:
    tables = 8
    while miss_probability(cosine, bits, tables) > miss:
        tables = math.ceil(tables * 1.1)
    return tables


def sign_limit(cosine: float, deviations: float = 7.0) -> int:
    """Most differing signs of two vectors at this cosine: the mean and ``deviations`` standard deviations."""
    q = math.acos(cosine) / math.pi
    return math.ceil(BITS * q + deviations * math.sqrt(BITS * q * (1 - q)))


def table_masks(bits: int, tables: int, seed: int) -> np.ndarray:
    """The signs that each table reads, as 64-bit masks (tables x WORDS)."""
    rng = np.random.default_rng([seed, bits])
    masks = np.zeros((tables, BITS), np.uint8)
    for t in range(tables):
        masks[t, rng.choice(BITS, bits, replace=False)] = 1
    return np.packbits(masks, axis=1).view(np.uint64)


def table_keys(reps: DataFrame, masks: np.ndarray) -> DataFrame:
    """(uid, signs, keys): one bucket key per table, salted with table and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix64(np.arange(1, len(masks) + 1, dtype=np.uint64))
        for batch in batches:
            dim = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.uint64)
            signs = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            keys = np.empty((len(dim), len(masks)), np.uint64)
            for t, mask in enumerate(masks):
                h = salts[t] + dim
                for w in range(WORDS):
                    h = mix64(h + (signs[:, w] & mask[w]))
                keys[:, t] = h
            offsets = np.arange(0, keys.size + 1, len(masks), dtype=np.int32) if len(dim) else np.zeros(1, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["uid", "signs", "keys"])

    return reps.select("uid", "dim", "signs").mapInArrow(run, "uid long, signs array<long>, keys array<long>")


def candidate_pairs(buckets: DataFrame, masks: np.ndarray, limit: int, step: int = 1 << 16) -> DataFrame:
    """(a, b) of rows in one bucket whose signs differ at most ``limit`` times, each pair in its first table only.

    ``buckets``: key, part, own, table, uid and the signs s0.. of a row.  Rows of one (key, part) follow each other;
    rows are compared with the one, two, ... places behind, all buckets of a stretch at once.  In parts that compare
    two blocks of a large bucket, only pairs across the blocks count.
    """

    def pairs_of(key, own, table, uid, signs) -> Iterator[pa.RecordBatch]:
        first, second, held = [], [], 0
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        size = np.diff(np.append(start, len(uid)))
        behind = np.repeat(start + size, size) - np.arange(len(uid)) - 1  # rows of the bucket after this one
        within = np.repeat(np.bitwise_or.reduceat(own, start) == 0, size)
        at, shift = np.arange(len(uid)), 1
        while True:
            at = at[behind[at] >= shift]
            if not len(at):
                break
            for cut in range(0, len(at), step):
                i = at[cut : cut + step]
                j = i + shift
                ok = within[i] | (own[i] != own[j])
                i, j = i[ok], j[ok]
                x = signs[i] ^ signs[j]
                near = np.bitwise_count(x).sum(axis=1) <= limit
                i, j, x = i[near], j[near], x[near]
                fresh = np.ones(len(i), bool)
                for t in range(int(table[i].max(initial=0))):
                    live = np.flatnonzero(fresh & (table[i] > t))
                    if not len(live):
                        continue
                    fresh[live] = ((x[live] & masks[t]) != 0).any(axis=1)
                first.append(uid[i[fresh]])
                second.append(uid[j[fresh]])
                held += int(fresh.sum())
                if held >= step:
                    yield ordered(first, second)
                    first, second, held = [], [], 0
            shift += 1
        if held:
            yield ordered(first, second)

    def ordered(first: list[np.ndarray], second: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(first), np.concatenate(second)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, part, own, table, uid = rows[:5]
            signs = np.stack(rows[5:], axis=1).view(np.uint64)
            yield from pairs_of(np.stack([key, part], axis=1), own, table, uid, signs)

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            if not len(held[0]):
                continue
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(change):
                end = int(change[-1]) + 1
                yield from solved([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield from solved(held)

    return buckets.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, units: DataFrame, cosine: float, most: int = 200_000) -> DataFrame:
    """What the pairs whose cosine in double precision reaches ``cosine`` add up to, task by task.

    Rows (a, b, others): with b a link of a spanning forest of the task's links, without b the number of vectors that
    a is linked with there.  A task so returns a few rows per vector that it meets, however many links there are; after
    ``most`` vectors it starts afresh, which only repeats forest links and splits counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        others: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def told() -> pa.RecordBatch:
            a, b = [e[0] for e in edges], [e[1] for e in edges]
            columns = [[*a, *others], b + [None] * len(others), [None] * len(edges) + list(others.values())]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "others"])
            root.clear()
            others.clear()
            edges.clear()
            return out

        for batch in batches:
            a, b, x, y, of_a, of_b = batch.columns
            for i, j, u, v, m, n in zip(a.to_pylist(), b.to_pylist(), x, y, of_a.to_pylist(), of_b.to_pylist()):
                if float(np.frombuffer(u.as_buffer()) @ np.frombuffer(v.as_buffer())) < cosine:
                    continue
                others[i] = others.get(i, 0) + n
                others[j] = others.get(j, 0) + m
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((i, j))
            if len(others) >= most:
                yield told()
        if others:
            yield told()

    side = lambda name, unit, copies: units.select(
        F.col("uid").alias(name), F.col("unit").alias(unit), F.col("copies").alias(copies)
    )
    both = pairs.join(side("a", "x", "of_a"), "a").join(side("b", "y", "of_b"), "b")
    return both.select("a", "b", "x", "y", "of_a", "of_b").mapInArrow(run, "a long, b long, others long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, miss: float = 1e-4,
    block: int = 1000, seed: int = 29,
) -> DataFrame:
    """Links of cosine >= ``cosine`` between vectors, and their connected components.

    Equal vectors become one class.  Each class reads ``BITS`` random-hyperplane signs; a table's bucket is a random
    choice of about log2(classes) of them, and there are as many tables as keep the chance to miss a pair exactly
    at the threshold below ``miss`` (pairs above it are missed far less).  Rows of one bucket whose signs agree well
    enough become candidates in their first common table only; a bucket above ``block`` rows is compared
    block by block in separate tasks.  All candidates are verified by their cosine in double precision.

    Returns vec_id, n_links, component_id (smallest vec_id), kept.  Vectors that are null, zero, or hold null or
    non-finite components link with nothing, not even with each other; vectors of different dimension never
    link.  Rows that repeat an identifier are vectors of their own; null identifiers are never chosen over others.  An
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    features = sign_features(vectors, id_col, vector_col, seed).withColumn("uid", F.monotonically_increasing_id())
    features = scratch.write(features, "features")
    same = ["dim", "d1", "d2"]
    classes = features.where("dim > 0").groupBy(*same).agg(F.min("uid").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")
    reps = features.join(classes.select(F.col("rep").alias("uid"), "copies"), "uid").select("uid", "dim", "unit", "signs", "copies")
    reps = scratch.write(reps, "reps")
    n = reps.count()
    bits = max(8, math.ceil(math.log2(max(2, n))))
    masks = table_masks(bits, table_count(cosine, bits, miss), seed)

    words = [F.col("signs")[w].alias(f"s{w}") for w in range(WORDS)]
    rows = scratch.write(table_keys(reps, masks), "keys").select("uid", *words, F.posexplode("keys").alias("table", "key"))
    large = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = scratch.write(large.select("key", F.ceil(F.col("m") / block).alias("blocks")), "large")
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # across two blocks, rows are told apart by 1 and 2; inside one block all have 0
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
    part = (low * F.col("blocks") + high).cast("long")
    rows = rows.select("key", part.alias("part"), side.alias("own"), "table", "uid", *[f"s{w}" for w in range(WORDS)])
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    pairs = scratch.write(candidate_pairs(rows, masks, sign_limit(cosine)), "pairs")
    linked = scratch.write(verified(pairs, reps, cosine), "linked")
    labels = components(linked.where("b IS NOT NULL").select("a", "b"), scratch)
    degrees = linked.where("b IS NULL").groupBy("a").agg(F.sum("others").alias("others"))
    degrees = scratch.write(degrees, "degrees")
    members = features.select("uid", "vec_id", *same).join(classes, same, "left")
    members = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(degrees.withColumnRenamed("a", "rep"), "rep", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    members = members.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "rep", "uid").alias("component"))
    members = scratch.write(members, "members")
    first = scratch.write(members.groupBy("component").agg(F.min("vec_id").alias("component_id")), "first")
    scratch.keep_only(members, first)
    out = members.join(first, "component")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
