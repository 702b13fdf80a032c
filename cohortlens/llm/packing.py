"""Best-fit packing of documents into fixed-length sequences by fitted length patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder_for

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False, added_tokens: bool = False,
) -> DataFrame:
    """Pieces of at most ``max_len`` ids per document: doc_id, piece, start, length, ids_crc32 (and ids).

    Only longer documents are cut, into full pieces after a shorter first one.  A null text is empty
    and gives the end id alone.  ``added_tokens``: see ``TextEncoder``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path, end_id, added_tokens)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.document(text.as_py())
                n = len(data) // 4
                first = n if n <= max_len else n % max_len or max_len
                edges = [0, *range(first, n + 1, max_len)]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append((i, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])) + ((data[4 * a : 4 * b],) if keep_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * (5 + keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def length_patterns(max_len: int, parts: int = 3) -> np.ndarray:
    """All multisets of at most three lengths that fill a sequence exactly, as rows of descending lengths (0: none)."""
    found = [(max_len, 0, 0)]
    if parts >= 2:
        found += [(i, max_len - i, 0) for i in range((max_len + 1) // 2, max_len)]
    if parts >= 3:
        for i in range(-(-max_len // 3), max_len - 1):
            rest = max_len - i
            found += [(i, j, rest - j) for j in range(-(-rest // 2), min(i, rest - 1) + 1)]
    return np.array(found, np.int64)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares: repeat counts x of the patterns with A x near the histogram.

    Accelerated projected gradient; A has at most three entries a column, so a step costs a few
    passes over the patterns.  Errors at long lengths weigh more, as a short document left over
    fits in anywhere.
    """
    size = len(hist)
    weight = 0.2 + np.arange(size) / size
    weight[0] = 0.0
    target = hist * weight

    def forward(x: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for c in range(patterns.shape[1]):
            total += np.bincount(patterns[:, c], x, size)
        return total * weight

    def backward(r: np.ndarray) -> np.ndarray:
        return sum((r * weight)[patterns[:, c]] for c in range(patterns.shape[1]))

    v = np.ones(len(patterns))
    for _ in range(30):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - backward(forward(y) - target) / (1.02 * norm))
        if (y - new) @ (new - x) > 0:  # restart the momentum when it points uphill
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(hist: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, repeats); equal sequences are handled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    space = np.zeros(max_len + 1, np.int64)  # sequences by free space
    for length in range(max_len, 0, -1):
        left = int(hist[length])
        while left:
            fits = np.flatnonzero(space[length:])
            if not len(fits):
                each = max_len // length
                groups = [((length,) * each, left // each)] if left >= each else []
                if left % each:
                    groups.append(((length,) * (left % each), 1))
                for lengths, n in groups:
                    free = max_len - length * len(lengths)
                    open_bins.setdefault(free, []).append((lengths, n))
                    space[free] += n
                break
            free = length + int(fits[0])
            lengths, n = open_bins[free].pop()
            used = min(n, left)
            if n > used:
                open_bins[free].append((lengths, n - used))
            space[free] -= used
            open_bins.setdefault(free - length, []).append((lengths + (length,), used))
            space[free - length] += used
            left -= used
    return [group for groups in open_bins.values() for group in groups]


def plan_patterns(hist: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (descending lengths, repeats) that use every document of the histogram exactly once.

    The fitted counts are rounded so that the running total over similar patterns stays right, and never
    above what is left; the residual goes through best-fit decreasing.  The plan's size depends on
    ``max_len`` only.
    """
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = length_patterns(max_len)
    fitted = np.cumsum(fit_counts(patterns, hist.astype(float)))
    counts = np.diff(np.floor(fitted + 0.5), prepend=0.0).astype(np.int64)
    for k in np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]:
        lengths = tuple(int(v) for v in patterns[k] if v)
        n = min(int(counts[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            plan.append((lengths, n))
            for v in lengths:
                left[v] -= n
    return plan + best_fit(left, max_len)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, intervals of ranks: columns first rank, multiplicity, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for v in dict.fromkeys(lengths):
            m = lengths.count(v)
            first = used.get(v, 0)
            rows.setdefault(v, []).append((first, m, sequence, offset))
            used[v] = first + n * m
            offset += m * v
        sequence += n
    return {v: np.array(r, np.int64) for v, r in rows.items()}


def pack(pieces: DataFrame, max_len: int, scratch: Scratch, salt_rows: int = 200_000) -> DataFrame:
    """Give every piece a sequence and an offset: adds ``sequence_id`` and ``offset``.

    ``pieces`` is a written table with a ``length`` from 1 to ``max_len``.  Only its histogram
    (``max_len`` counts) comes to the driver, and the plan, bounded by ``max_len`` alone, goes back to the
    tasks.  A piece's rank among its length is its rank inside a salt of the length plus the counts of the
    salts before, so a length shared by a third of all rows is ranked by many tasks.
    """
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    hist = np.zeros(max_len + 1, np.int64)
    for length, n in counted.items():
        hist[length] = n
    slots = _slots(plan_patterns(hist, max_len))
    salts = max(8, -(-int(hist.sum()) // salt_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    shifts = scratch.write(shifts, "shifts")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(shifts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("shift")).drop("salt", "shift")
    names = [c for c in ranked.columns if c != "rank"]
    fields = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                first, many, start, shift = slots[int(v)][np.searchsorted(slots[int(v)][:, 0], rank[at], "right") - 1].T
                inside = rank[at] - first
                sequence[at] = start + inside // many
                offset[at] = shift + inside % many * v
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``max_len`` ids.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset; the pieces of a
    sequence follow each other without gap from offset 0.  Null and empty texts are packed as their end id.
    Repeated rows are packed each on its own; a null identifier stays null.  An empty table gives no
    rows; other columns are ignored.  ``added_tokens``: see ``TextEncoder``.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col, added_tokens=added_tokens)
    pieces = scratch.write(pieces, "pieces")
    packed = pack(pieces, max_len, scratch)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
