"""Near-duplicates by MinHash bands, odd sketches and exact verification on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

C1, C2, C3, GOLD = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * GOLD
    h = (h ^ (h >> np.uint64(32))) * GOLD
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted.

    Words are the runs without white space after lowering A-Z, both as the bytes methods do it on UTF-8.  A text
    with fewer words than a shingle has one shingle, its whole sequence; no words, none.
    """

    def __init__(self, size: int, max_words: int = 200_000):
        import xxhash

        self.size, self.max_words, self.digest = size, max_words, xxhash.xxh3_64_intdigest
        self.words: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.max_words:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in [w for w in set(words) if len(w) > 64]:
            del known[w]
        size = min(self.size, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            total = total * C1 + h[i : len(h) - size + 1 + i]
        return np.unique(mix64(total))


class MinHasher:
    """MinHash samples of a set of 64-bit hashes, their band keys and their odd sketch."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        self.a = (rng.integers(0, 1 << 31, k, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.int64).astype(np.uint32)
        self.place = mix64(np.arange(1, k + 1, dtype=np.uint64) * C2)
        self.salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * C3)
        self.step = max(64, (1 << 19) // k)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(x), self.step):
            values = np.multiply.outer(self.a, x[at : at + self.step])
            values += self.b[:, None]
            values = values.min(axis=1)
            least = values if least is None else np.minimum(least, values)
        return least.astype(np.uint64)

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        key = self.salt.copy()
        for column in samples.reshape(self.bands, self.rows).T:
            key = mix64(key * C1 + column)
        return key.view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parities of the samples' numbers falling on each bit, as 64-bit words."""
        at = mix64(samples * C1 + self.place) % np.uint64(self.bits)
        parity = (np.bincount(at.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return np.packbits(parity).view(np.int64)


def sketch_limit(similarity: float, samples: int, bits: int, deviations: float = 5.0) -> int:
    """Most differing bits of two sketches whose sets are at least that similar.

    Of ``samples`` independent samples a share 1 - similarity differs, and each such sample sets two
    bits at random; mean plus ``deviations`` standard deviations of the differing bits.
    """
    differ = samples * (1 - similarity)
    mean = bits / 2 * (1 - math.exp(-4 * differ / bits))
    slope = 2 * math.exp(-4 * differ / bits)
    var = slope**2 * differ * similarity + bits / 4 * (1 - math.exp(-8 * differ / bits))
    return math.ceil(mean + deviations * math.sqrt(var))


#: Samples and bits of the second sketch, which only rows in shared keys get: it tells 0.8 from about 0.74.
FINE_SAMPLES, FINE_BITS = 2048, 4096
FEATURES = "doc_id long, uid long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"


def set_features(docs: DataFrame, size: int, hasher: MinHasher, id_col: str, text_col: str, key: Column) -> DataFrame:
    """One row per document: ``key`` as uid, set size, a 128-bit digest of the set, band keys and odd sketch (null for an empty set)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            n, d1, d2, bands, sketches = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingler.of(text.as_py())
                n.append(len(hashes))
                digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                d1.append(digest[0])
                d2.append(digest[1])
                samples = hasher.samples(hashes) if len(hashes) else None
                bands.append(None if samples is None else hasher.band_keys(samples))
                sketches.append(None if samples is None else hasher.odd_sketch(samples))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(bands, lists), pa.array(sketches, lists)],
                names=["doc_id", "uid", "n", "d1", "d2", "bands", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.cast("long").alias("uid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(features, FEATURES)


def _differing_bits(words: int) -> Column:
    parts = [F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(words)]
    return sum(parts[1:], parts[0])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = 60, rows: int = 7, bits: int = 1024, key_col: str | None = None,
) -> DataFrame:
    """Components of documents whose word-shingle sets have 100 * intersection >= ``percent`` * union.

    1. One pass over the texts gives each document's set size, set digest, band keys and odd sketch.  Equal
       sets become one class, represented by one row; only representatives go on.
    2. Band keys held by one representative go at once.  The default 60 bands of 7 samples miss a pair
       at similarity 0.8 with a probability below 1e-6, and less above.
    3. Every key links its members to the one that meets most others.  Each member verifies the link that most of
       its keys propose, if sketches and sizes allow it, and verified links are contracted to components;
       this is done twice, the second time over the keys that still join different components.
    4. Members of one key that are still in different components meet pair by pair, never inside one component;
       pairs with too different sizes or sketches stop in the join, all others are verified on the full sets.  Here
       a second sketch of many more samples keeps the pairs just below the similarity out.
       No candidate is left out, so components are those of all links found by the bands.

    Verification fetches the texts of documents in shared keys once and intersects complete sets of 64-bit
    shingle hashes.  A key's star and its cross-component pairs are joins, which adaptive execution splits; no
    group is gathered.

    Returns doc_id, n_shingles, component_id (smallest identifier of the component), kept.  Null and empty texts
    have an empty set and link with nothing, not with each other.  Fewer words than a shingle: the whole
    sequence is the shingle.  Rows that repeat an identifier are documents of their own under that identifier;
    null identifiers are never chosen over others.  An empty table gives no rows; other columns are ignored.

    ``key_col`` names a number that is unique to each row and the same in every read of ``docs``.  It is then a further
    column of the result, and ``kept`` holds for exactly one row of each component: smallest identifier, then key.
    """
    scratch = Scratch(docs.sparkSession)
    hasher = MinHasher(bands, rows, bits)
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    features = scratch.write(set_features(docs, words, hasher, id_col, text_col, key), "features")
    digest = ["d1", "d2", "n"]
    reps = scratch.write(features.where("n > 0").groupBy(*digest).agg(F.min("uid").alias("rep")), "reps")
    labels = _class_components(docs, features, reps, scratch, words, percent, hasher, id_col, text_col, key_col)
    rows_ = features.select("uid", "doc_id", *digest).join(reps, digest, "left")
    rows_ = rows_.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    rows_ = scratch.write(rows_.select("uid", "doc_id", "n", F.coalesce("component", "rep", "uid").alias("component")), "members")
    best = [F.min("doc_id").alias("component_id")]
    if key_col:
        best.append(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("uid"))).alias("first"))
    first = scratch.write(rows_.groupBy("component").agg(*best), "first")
    scratch.keep_only(rows_, first)
    out = rows_.join(first, "component")
    kept = F.col("uid") == F.col("first.uid") if key_col else F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"),
        *([F.col("uid").alias(key_col)] if key_col else []),
    )


def _class_components(
    docs: DataFrame, features: DataFrame, reps: DataFrame, scratch: Scratch, words: int, percent: int, hasher: MinHasher,
    id_col: str, text_col: str, key_col: str | None, rounds: int = 2,
) -> DataFrame:
    """(id, component) over the class representatives' row numbers."""
    fine = MinHasher(1, FINE_SAMPLES, FINE_BITS, seed=19)
    keys = features.join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.write(shared, "shared")
    members = scratch.write(keys.join(shared, "key"), "members")
    wanted = scratch.write(members.groupBy("uid").agg(F.sum("size").alias("weight")), "wanted")
    known = features.join(wanted, "uid").select("uid", "weight", "doc_id", "n", "d1", "d2", "sketch", "bands")
    known = scratch.write(known, "known")
    sets = _sets_of(docs, known, scratch, words, fine, id_col, text_col, key_col)
    sketches = known.select("uid", "n", "sketch")
    limit = sketch_limit(percent / 100, hasher.bands * hasher.rows, hasher.bits)
    alike = _differing_bits(hasher.bits // 64)
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("s")), "a")
        both = left.join(sets.select(F.col("uid").alias("b"), F.col("set").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        total = F.size("s") + F.size("t") - common
        return both.where(100 * common >= percent * total).select("a", "b")

    one = sketches.select(F.col("uid").alias("a"), "n", F.col("sketch").alias("x"))
    two = sketches.select(F.col("uid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    sharp = sketch_limit(percent / 100, FINE_SAMPLES, FINE_BITS)

    links = labels = tried = None
    for _ in range(rounds):
        where = _mixed_keys(members, known, labels, scratch)
        # the member that meets most others is the likeliest neighbour of a key's members
        star = F.max_by(F.struct(F.col("uid").alias("star"), F.col("c").alias("star_c")), F.struct("weight", -F.col("uid")))
        stars = scratch.write(where.groupBy("key").agg(star.alias("s")).select("key", "s.*"), "stars")
        met = where.join(stars, "key").where("c <> star_c").groupBy(F.col("uid").alias("a"), F.col("star").alias("b"))
        met = met.agg(F.count("*").alias("keys"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        best = met.groupBy("a").agg(F.max_by("b", F.struct("keys", -F.col("b"))).alias("b"))
        best = scratch.write(best.join(one, "a").join(two, "b").where(sizes & (alike <= limit)).select("a", "b"), "best")
        found = scratch.write(verified(best), "links")
        links = found if links is None else links.union(found)
        tried = best if tried is None else tried.union(best)
        labels = components(links, scratch)

    mixed = _mixed_keys(members, known, labels, scratch)
    # rows outside a key's largest component meet all rows of other components, so that component never meets itself
    groups = mixed.groupBy("key", "c").agg(F.count("*").alias("k"))
    major = scratch.write(groups.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("major")), "major")
    traits = known.select("uid", "n", "sketch", "bands").join(sets.select("uid", "fine"), "uid")
    rows = mixed.join(major, "key").select("key", "uid", "c", (F.col("c") != F.col("major")).alias("minor")).join(traits, "uid")
    rows = scratch.write(rows, "rows")
    left = rows.where("minor").select(
        "key", F.col("uid").alias("a"), "c", "n", F.col("sketch").alias("x"), F.col("fine").alias("u"), F.col("bands").alias("p")
    )
    right = rows.select(
        "key", F.col("uid").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("sketch").alias("y"),
        F.col("fine").alias("v"), F.col("bands").alias("q"), "minor",
    )
    differ = F.aggregate(F.zip_with("u", "v", lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda t, k: t + k)
    once = F.array_min(F.array_intersect("p", "q")) == F.col("key")  # a pair counts under its least common key only
    meet = (F.col("c") != F.col("d")) & (~F.col("minor") | (F.col("a") < F.col("b"))) & sizes & (alike <= limit) & (differ <= sharp) & once
    pairs = left.join(right.hint("merge"), "key").where(meet).select("a", "b")
    more = verified(scratch.write(pairs, "pairs"))
    return components(links.union(more), scratch)


def _mixed_keys(members: DataFrame, known: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(key, uid, weight, c) of the keys whose members are not all in one component yet."""
    rows = members.select("key", "uid").join(known.select("uid", "weight"), "uid")
    if labels is None:
        return scratch.write(rows.withColumn("c", F.col("uid")), "where")
    rows = rows.join(labels, F.col("uid") == F.col("id"), "left")
    rows = scratch.write(rows.select("key", "uid", "weight", F.coalesce("component", "uid").alias("c")), "where")
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return scratch.write(rows.join(scratch.write(mixed, "mixed"), "key"), "where")


def _sets_of(
    docs: DataFrame, known: DataFrame, scratch: Scratch, words: int, fine: MinHasher, id_col: str, text_col: str,
    key_col: str | None,
) -> DataFrame:
    """(uid, set, fine) of the rows in ``known``, from their texts: full set and a sketch of many more samples.

    Texts return by their key, without one by identifier; where rows share one, the row whose set has the known digest is the right one
    (rows that repeat identifier and text give the same set again, which only repeats links).
    """
    import xxhash

    text = docs.select(F.col(key_col or id_col).cast("long").alias("i"), F.col(text_col).alias("text"))
    same = F.col("i") == F.col("uid") if key_col else F.col("i").eqNullSafe(F.col("doc_id"))
    rows = text.join(known.select("uid", "doc_id", "d1", "d2"), same)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            uid, found, sketches = [], [], []
            for u, t, d1, d2 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                hashes = shingler.of(t.as_py())
                digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                if (digest[0], digest[1]) == (d1, d2):
                    uid.append(u)
                    found.append(hashes.view(np.int64))
                    sketches.append(fine.odd_sketch(fine.samples(hashes)))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(found, lists), pa.array(sketches, lists)], names=["uid", "set", "fine"]
            )

    found = rows.select("uid", "text", "d1", "d2").mapInArrow(sets, "uid long, set array<long>, fine array<long>")
    return scratch.write(found, "sets")
