"""Removal of long repeated byte strings by prefix-free parsing and suffix order of phrase contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, Scratch
from .phrases import GRAM, Parsed

PARSED = "key long, row long, n long, sha string, a array<int>, hi array<int>, h array<long>, f array<long>"
CONTEXTS = "h long, uid long, i int, edge boolean, a int, low int, high int, before binary, after binary"


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_py()


def parse(rows: DataFrame, length: int, window: int) -> DataFrame:
    """One row per text: size, SHA-256, and its triggers.

    Strings of ``length`` bytes that start at lo..hi share the trigger a (the first one of the window at their start);
    lo is one more than the hi before.  ``h`` hashes the stretch that all of them contain, from the trigger on, which
    is the beginning of the parse's suffix at that phrase; ``f`` hashes everything any of them contains.
    """
    core = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for data in _bytes(batch.column(2)):
                a = hi = h = f = np.zeros(0, np.int64)
                if len(data) >= length:
                    parsed = Parsed(data, window)
                    trigger = parsed.trigger[: len(data) - length + 1]
                    last = np.flatnonzero(np.append(trigger[1:] != trigger[:-1], True))
                    lo, hi, a = np.append(0, last[:-1] + 1), last, trigger[last]
                    h = parsed.hash(a, a + core).view(np.int64)
                    shape = ((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
                    f = parsed.hash(lo, hi + length, shape).view(np.int64)
                for into, value in zip(out, (len(data), hashlib.sha256(data).hexdigest(), a.astype(np.int32), hi.astype(np.int32), h, f)):
                    into.append(value)
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds))],
                names=["key", "row", "n", "sha", "a", "hi", "h", "f"],
            )

    return rows.select("key", "row", "text").mapInArrow(run, PARSED)


def contexts(rows: DataFrame, length: int, window: int) -> DataFrame:
    """The bytes before and after the common stretch of the triggers asked for in ``wants`` (i, h, edge)."""
    core, reach = length - window + 1, window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            uids, wants, all_a, all_hi = (batch.column(i).to_pylist() for i in range(4))
            for uid, want, a_, hi_, data in zip(uids, wants, all_a, all_hi, _bytes(batch.column(4))):
                for w in want:
                    i = w["i"]
                    a, hi, lo = a_[i], hi_[i], hi_[i - 1] + 1 if i else 0
                    before, after = data[max(0, a - reach) : a], data[a + core : a + core + reach]
                    out.append((w["h"], uid, i, w["edge"], a, a - hi, a - lo, before, after))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.select("uid", "wants", "a", "hi", "text").mapInArrow(run, CONTEXTS)


def suffix_order(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order, and the common prefix of each with the one before it in that order (-1 for the first)."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
    sizes = np.array([len(s) for s in strings])
    table = np.zeros((len(strings), width + 1), np.uint8)
    for k, i in enumerate(order):
        table[k, : sizes[i]] = np.frombuffer(strings[i], np.uint8)
    differ = table[1:] != table[:-1]
    differ[:, width] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, np.append(-1, common)


def repeated_offsets(before: list[bytes], after: list[bytes], low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
    """Which strings occur twice among contexts of one common stretch: a boolean for each (context, offset 0..reach).

    The string at offset d takes d bytes before the stretch and reach - d after it.  Two suffix orders tell equal
    pieces: the order of the parts before, read backwards (suffixes of dictionary phrases), and the order of the
    parts after (suffixes of the parse).  At depth d a class is a run of neighbours whose common prefix is at
    least d; equal pairs of classes are neighbours in corpus order that agree over the whole string.
    """
    c = len(before)
    depth = np.arange(reach + 1)

    def classes(strings: list[bytes], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, common = suffix_order(strings, reach)
        found = np.empty((c, reach + 1), np.int64)
        found[order] = np.cumsum(common[:, None] < depths, axis=0)
        return found, np.array([len(s) for s in strings])[:, None] >= depths

    left, left_there = classes([s[::-1] for s in before], depth)
    right, right_there = classes(after, reach - depth)
    valid = left_there & right_there & (depth >= low[:, None]) & (depth <= high[:, None])
    # strings that do not exist get numbers of their own
    pair = np.where(valid, left * (c + 1) + right, -1 - np.arange(c)[:, None])
    order = np.argsort(pair, axis=0, kind="stable")
    ranked = np.take_along_axis(pair, order, axis=0)
    same = ranked[1:] == ranked[:-1]
    edge = np.zeros((1, reach + 1), bool)
    twice = np.empty_like(valid)
    np.put_along_axis(twice, order, np.vstack([edge, same]) | np.vstack([same, edge]), axis=0)
    return twice


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e) - 1) for s, e in zip(at[::2], at[1::2])]


SPANS = "uid long, spans array<struct<first:int,last:int>>"


def _repeats_by_order(some: DataFrame, reach: int) -> DataFrame:
    """Starts of repeated strings at edge triggers, group by group of one common stretch, in stretch order."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(group: list[dict]) -> list[tuple]:
            if not any(r["edge"] for r in group):
                return []
            low, high = np.array([r["low"] for r in group]), np.array([r["high"] for r in group])
            twice = repeated_offsets([r["before"] for r in group], [r["after"] for r in group], low, high, reach)
            out = []
            for k in np.flatnonzero(twice.any(axis=1)):
                if group[k]["edge"]:
                    a = group[k]["a"]
                    out.append((group[k]["uid"], [{"first": a - e, "last": a - s} for s, e in _runs(twice[k])]))
            return out

        group: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group and group[0]["h"] != r["h"]:
                    out += solved(group)
                    group = []
                group.append(r)
            yield _spans_batch(out, spans)
        yield _spans_batch(solved(group) if group else [], spans)

    columns = ["h", "uid", "edge", "a", "low", "high", "before", "after"]
    return some.select(*columns).repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def _spans_batch(rows: list[tuple], spans: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([u for u, _ in rows], pa.int64()), pa.array([s for _, s in rows], spans)], names=["uid", "spans"]
    )


def _repeats_by_rows(some: DataFrame, reach: int) -> DataFrame:
    """The same for stretches with any number of contexts: one row per string, grouped by a 128-bit hash."""
    each = some.withColumn("d", F.explode(F.sequence("low", "high")))
    before = F.expr("substring(before, length(before) - d + 1, d)")
    after = F.expr(f"substring(after, 1, {reach} - d)")
    there = (F.length("before") >= F.col("d")) & (F.length("after") >= reach - F.col("d"))
    each = each.where(there).select(
        "h", "uid", "edge", "a", "d", F.xxhash64(before, after).alias("k1"), F.xxhash64(F.lit(3), before, F.lit(4), after).alias("k2")
    )
    key = ["h", "d", "k1", "k2"]
    twice = each.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    first = (F.col("a") - F.col("d")).alias("first")
    found = each.where("edge").join(twice, key).select("uid", first, (F.col("a") - F.col("d")).alias("last"))
    return found.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _byte_runs(rows: DataFrame, length: int) -> DataFrame:
    """uid, starts, ends of the maximal removed byte runs, from triggers and single spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, firsts, lasts = [], [], []
            for uid, hi_, all_, edges, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                hi = np.array(hi_)
                lo = np.append(0, hi[:-1] + 1)
                full = np.setdiff1d(np.array(all_ or [], np.int64), np.array(edges or [], np.int64))
                first = np.concatenate([lo[full], [s["first"] for part in spans or [] for s in part]]).astype(np.int64)
                last = np.concatenate([hi[full], [s["last"] for part in spans or [] for s in part]]).astype(np.int64) + length
                if not len(first):
                    continue
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.append(True, first[1:] > last[:-1])
                uids.append(uid)
                firsts.append(first[new].astype(np.int32))
                lasts.append(last[np.append(new[1:], True)].astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(firsts, ints), pa.array(lasts, ints)], names=["uid", "starts", "ends"]
            )

    columns = rows.select("uid", "hi", "triggers", "edges", "spans")
    return columns.mapInArrow(run, "uid long, starts array<int>, ends array<int>")


def _cut(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) from texts and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for starts, ends, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _bytes(batch.column(3))):
                edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                for into, value in zip(out, (len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept)):
                    into.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.select("doc_id", "starts", "ends", "text").mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = 192,
    max_group: int = 128, keep_bytes: bool = False,
) -> DataFrame:
    """Remove every byte of a string of ``length`` bytes that also starts anywhere else, in the same text or another.

    1. Every text is parsed into phrases at triggers (see ``phrases.Parsed``).  The strings that start between two
       triggers share a stretch behind their trigger; only stretches found twice (128-bit: the stretch's hash and the
       hash of all their strings) can hold a repeat.  One row per trigger, about one for 96 bytes, is counted.
    2. Where a trigger's whole context is found twice, all its strings are repeated.
    3. The others are the ends of repeats.  Their contexts, and one of each class found twice, are fetched from
       the texts and sorted: suffixes of the phrase before the trigger and of the parse behind the
       stretch are put in order, and both orders together give the corpus order in which equal strings are
       neighbours.  Stretches with more than ``max_group`` different contexts go string by string through a grouped
       table instead, so no group of any size meets in one task and none is left out.
    4. Overlapping strings are merged to byte runs, and the texts are cut.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if asked).  Strings are judged on the
    input.  A null text is empty; texts shorter than ``length`` lose nothing.  Rows that repeat identifier and text are
    texts of their own and lose what they share.  A null identifier stays null.  An empty table gives no rows; other
    columns are ignored.
    """
    if window < 1 or length < window + GRAM:
        raise ValueError("length must be at least window + 16")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("key"), F.xxhash64(text).alias("row"), text.alias("text"))
    parsed = scratch.write(parse(texts, length, window).withColumn("uid", F.monotonically_increasing_id()), "parsed")
    triggers = parsed.select("uid", F.posexplode(F.arrays_zip("h", "f")).alias("i", "x")).select("uid", "i", "x.h", "x.f")
    twice = scratch.write(triggers.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    found = scratch.write(triggers.join(twice, "h"), "found")
    classes = found.groupBy("h", "f").agg(F.count("*").alias("n"), F.min(F.struct("uid", "i")).alias("one"))
    classes = scratch.write(classes.select("h", "one.uid", "one.i", (F.col("n") == 1).alias("edge")), "classes")
    open_ends = scratch.write(classes.where("edge").select("h").distinct(), "open")
    wants = classes.join(open_ends, "h").groupBy("uid").agg(F.collect_list(F.struct("i", "h", "edge")).alias("wants"))
    asked = scratch.write(parsed.select("uid", "key", "row", "a", "hi").join(wants, "uid"), "asked")
    some = scratch.write(contexts(texts.join(asked, ["key", "row"]), length, window), "contexts")
    # rows that repeat identifier and text fetch the same context again
    some = some.dropDuplicates(["uid", "i"]) if _repeats_rows(parsed) else some
    sizes = scratch.write(some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max_group).select("h"), "large")
    by_order = _repeats_by_order(some.join(sizes, "h", "left_anti"), window - 1)
    by_rows = _repeats_by_rows(some.join(sizes, "h"), window - 1)
    spans = scratch.write(by_order.union(by_rows), "spans")

    per_text = found.groupBy("uid").agg(F.collect_list("i").alias("triggers"))
    edges = classes.where("edge").groupBy("uid").agg(F.collect_list("i").alias("edges"))
    spans = spans.groupBy("uid").agg(F.collect_list("spans").alias("spans"))
    joined = per_text.join(edges, "uid", "left").join(spans, "uid", "left").join(parsed.select("uid", "hi"), "uid")
    runs = scratch.write(_byte_runs(joined, length), "runs")
    cuts = scratch.write(parsed.select("uid", "key", "row").join(runs, "uid").dropDuplicates(["key", "row"]).drop("uid"), "cuts")
    scratch.keep_only(parsed, runs, cuts)
    back = F.when(F.col("key") != LAST_ID, F.col("key")).alias("doc_id")
    cut = _cut(texts.join(cuts, ["key", "row"]).select(back, "starts", "ends", "text"))
    whole = parsed.join(runs.select("uid"), "uid", "left_anti").select("key", "row", "n", "sha")
    zero = F.lit(0).cast("long")
    whole_rows = whole.select(back, F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    if not keep_bytes:
        return cut.drop("kept").union(whole_rows)
    kept = whole.join(texts.dropDuplicates(["key", "row"]), ["key", "row"]).select(
        back, F.col("n").alias("n_bytes"), zero, zero, F.col("sha"), F.col("text").cast("binary")
    )
    return cut.union(kept)


def _repeats_rows(parsed: DataFrame) -> bool:
    """Whether rows repeat both identifier and text."""
    return not parsed.groupBy("key", "row").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
