"""Ranked lexical search: sequential reads of impact-sorted lists with score intervals (no random access)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Every ASCII byte that is no letter or digit parts terms; A-Z fold to a-z; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)
IMPACT_BITS = 20  # impacts stay below 1,000,000
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "item long, doc_id long, score long, shard int"


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class QueryBlock:
    """Items with their distinct terms; what every task needs of a block, bounded by the block's text."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int], list[int]]] = []  # (item, terms, repeats)
        for item, text in items:
            counts = Counter(terms(text.encode()))
            if counts:
                ids = [self.number.setdefault(t, len(self.number)) for t in counts]
                self.items.append((item, ids, list(counts.values())))


def _blocks(rows: Iterable[Row], block_bytes: int) -> Iterator[QueryBlock]:
    block, size = [], 0
    for row in rows:
        block.append((row["item"], row["text"] or ""))
        size += len(block[-1][1]) + 64
        if size >= block_bytes:
            yield QueryBlock(block)
            block, size = [], 0
    if block:
        yield QueryBlock(block)


def _postings(docs: DataFrame, block: QueryBlock) -> DataFrame:
    """One row per document with a term: its identifier, its number of terms, and the block's terms in it."""
    number, size = block.number, max(len(block.number), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, lengths, ids, counts = number.get, [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text or b"")
                own = [t for t in map(known, words) if t is not None]
                lengths.append(len(words))
                counts.append(len(own))
                ids.append(np.array(own, np.int64))
            flat = np.concatenate([np.zeros(0, np.int64), *ids])
            key, tf = np.unique(np.repeat(np.arange(len(ids)), counts) * size + flat, return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(ids) + 1) * size), pa.int32())
            out = pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            ], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))

    return docs.mapInArrow(run, POSTINGS)


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort((term << IMPACT_BITS) | ((1 << IMPACT_BITS) - 1 - impact))
        self.doc_ids, self.doc, self.impact = doc_ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, ids: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that can be among the ``k`` best: at least ``floor``, ties included.

        Every round reads on in all lists, twice as far as before.  A document's lower bound is what was read of it;
        its upper bound adds the last read impact of each list in which it has not appeared.  It ends when every
        document whose upper bound reaches the k-th lower bound has both bounds equal, so that membership, ties and
        scores are settled.
        """
        pos, end = self.start[ids], self.start[ids + 1]
        there = pos < end
        ids, weight, pos, end = ids[there], weight[there], pos[there], end[there]
        lower = np.zeros(len(self.doc_ids), np.int64)
        seen = np.zeros((len(ids), len(lower)), bool)
        step = 64
        while True:
            take = np.minimum(step, end - pos)
            row = np.repeat(np.arange(len(ids)), take)
            at = np.repeat(pos - (np.cumsum(take) - take), take) + np.arange(len(row))
            np.add.at(lower, self.doc[at], weight[row] * self.impact[at])
            seen[row, self.doc[at]] = True
            pos, step = pos + take, step * 2
            bound = np.where(pos < end, weight * self.impact[np.maximum(pos - 1, 0)], 0)
            total = int(bound.sum())
            least = max(floor, 1)
            if len(lower) > k:
                least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            near = np.flatnonzero(lower + total >= least)
            if total:
                upper = lower[near] + total - bound @ seen[:, near]
                near, upper = near[upper >= least], upper[upper >= least]
                if (upper > lower[near]).any():
                    continue
            return near, lower[near]


def _hits(postings: DataFrame, block: QueryBlock, weight: np.ndarray, totals: tuple[int, int], k: int, shard_size: int) -> DataFrame:
    n_terms = len(block.number)
    items = [(item, np.array(ids), weight[ids] * np.array(counts)) for item, ids, counts in block.items]
    n_docs, n_all = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, list[tuple[int, bool, int]]] = {}
        held: list[pa.RecordBatch] = []

        def solve() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            missing = rows.column("doc_id").is_null().to_numpy()
            doc_ids = rows.column("doc_id").fill_null(0).to_numpy()
            length = rows.column("n").to_numpy().astype(object)  # the product may pass 64 bits
            m = (25 + (75 * length * n_docs) // n_all).astype(np.int64)
            size = pc.list_value_length(rows.column("terms")).to_numpy()
            flat = lambda c: pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64)
            shard = Shard(doc_ids, np.repeat(np.arange(len(doc_ids)), size), flat("terms"), flat("tfs"), m, n_terms)
            for item, ids, weights in items:
                mine = best.setdefault(item, [])
                floor = -mine[-1][0] if len(mine) == k else 0
                found, score = shard.search(ids, weights, k, floor)
                mine += zip((-score).tolist(), missing[found].tolist(), doc_ids[found].tolist())
                mine.sort()
                del mine[k:]

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                held.append(batch.slice(lo, 4096))
                size += len(held[-1].column(2).flatten()) + held[-1].num_rows
                if size >= shard_size:
                    solve()
                    size = 0
        if held and size:
            solve()
        out = [(item, None if missing else doc, -score) for item, rows in best.items() for score, missing, doc in rows]
        if out:
            where = TaskContext.get().partitionId()
            columns = [list(c) for c in zip(*out)] + [[where] * len(out)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item", "doc_id", "score", "shard"])

    return postings.mapInArrow(run, HITS)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20, shard_size: int = 4_000_000,
) -> DataFrame:
    """The ``k`` best documents of each item: (item column, rank, doc_id, score), in whole numbers throughout.

    Terms are runs of ASCII letters and digits and of all other characters, with A-Z folded; N counts the documents
    with a term and L their terms.  A term of df documents weighs floor(1000 ln((2N+2)/(2df+1))); its impact in a
    document is (1000000000 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L.  A score sums weight times impact
    over the item's terms, repeats included.

    Documents form shards of about ``shard_size`` postings, whatever partition they come from; each shard sorts its
    lists by impact and reads them in order until all candidates are settled, starting at the k-th score that earlier
    shards of the task left.  Items pass in blocks of ``block_bytes`` of text, the only thing that tasks are sent, and
    the documents are read once a block.  Shards give at most k rows an item and task, which meet in two steps.

    Null and empty texts hold no term; items without a known term return no row, and documents that score 0 are left
    out.  Equal scores go by identifier, null last; documents that share an identifier are separate, and so are
    items.  Empty tables give an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("text"))
    listed = scratch.write(
        items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()), "items",
    )
    found = []
    for k_block, block in enumerate(_blocks(listed.toLocalIterator(), block_bytes)):
        postings = scratch.write(_postings(texts, block), "postings")
        totals = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"] or not block.items:
            continue
        df = np.zeros(len(block.number), np.int64)
        for row in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[row["t"]] = row["count"]
        n = totals["docs"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        hits = _hits(postings, block, weight, (n, totals["terms"]), k, shard_size)
        found.append(scratch.write(hits, f"hits-{k_block}"))
        scratch.drop(postings)
    hits = reduce(DataFrame.union, found) if found else spark.createDataFrame([], HITS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.row_number()
    # first within some of the shards, so that no task meets the rows of all
    some = Window.partitionBy("item", F.pmod("shard", F.lit(64))).orderBy(*order)
    hits = hits.withColumn("rank", place.over(some)).where(F.col("rank") <= k)
    ranked = hits.withColumn("rank", place.over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(listed.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", "doc_id", "score"
    )
