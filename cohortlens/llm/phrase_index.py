"""Word n-grams by bidirectional search in a Burrows-Wheeler index of each shard, and the collocations among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: ASCII upper case folds; the signs .,;:!? and the line controls end a piece; blanks and tabs part words.
FOLD = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BREAK = 0  # the symbol between pieces

GRAMS = "lang string, size int, phrase string, f long"


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the folded texts, one after the other, and whether a piece ends after each."""
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(FOLD), np.uint8)
    line = data == 0x0A
    inside = ~(line | (data == 0x20) | (data == 0x09))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    offsets = np.r_[0, np.cumsum(last - first)]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]
    )
    piece = np.cumsum(line, dtype=np.int32)[first]
    return words, np.diff(piece, append=-1) != 0


def _symbols(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """(vocabulary, text): words are numbered from 1 in order of appearance, and ``BREAK`` follows each piece."""
    coded = pa.chunked_array([words for words, _ in parts]).combine_chunks().dictionary_encode()
    ends = np.concatenate([e for _, e in parts])
    text = np.full(len(ends) + int(ends.sum()), BREAK, np.int32)
    text[np.arange(len(ends)) + np.cumsum(ends) - ends] = coded.indices.to_numpy() + 1
    return coded.dictionary, text


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols; the text is a ring."""
    n = len(symbols)
    place = np.arange(n)
    rank = symbols.astype(np.int64)
    for k in range(1, depth + 1):
        key = symbols.astype(np.int64) * (int(rank.max()) + 1) + np.roll(rank, -1) if k > 1 else rank
        shift = n.bit_length()
        if int(key.max()).bit_length() + shift < 63:  # key and place in one word sort much faster than by index
            packed = np.sort((key << shift) | place)
            order, key = packed & ((1 << shift) - 1), packed >> shift
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        if k < depth:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    return order


class Side:
    """Rank queries over one Burrows-Wheeler transform."""

    def __init__(self, bwt: np.ndarray, n_symbols: int):
        self.bwt, self.n = bwt, len(bwt)
        self.start = np.r_[0, np.cumsum(np.bincount(bwt, minlength=n_symbols))]

    @cached_property
    def places(self) -> np.ndarray:
        """The places of every symbol, one symbol after the other."""
        return np.sort(self.bwt.astype(np.int64) * self.n + np.arange(self.n))

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of the suffixes that open with ``symbol`` and go on like the suffix at ``row``."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * self.n + row)


class Intervals:
    """n-grams with their number of rows, words (one column a place) and first rows in both transforms."""

    def __init__(self, words: np.ndarray, size: np.ndarray, forward: np.ndarray | None, backward: np.ndarray | None):
        self.words, self.size, self.forward, self.backward = words, size, forward, backward

    def where(self, keep: np.ndarray | slice) -> Intervals:
        return Intervals(self.words[keep], self.size[keep], self.forward[keep], self.backward[keep])

    def portions(self, rows: int) -> Iterator[Intervals]:
        """The n-grams in portions of about ``rows`` rows of the transform."""
        portion = np.cumsum(self.size) // rows
        cuts = np.r_[0, np.flatnonzero(np.diff(portion)) + 1, len(portion)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield self.where(slice(lo, hi))


class PhraseIndex:
    """A bidirectional index of word ids: the transform of the text and that of the reversed text.

    Rows are sorted by their first ``depth`` words only, which is enough to extend n-grams of up to ``depth`` words by
    one more.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray, n_symbols: int):
        self.forward, self.backward, self.n_symbols = Side(forward, n_symbols), Side(backward, n_symbols), n_symbols

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        turned = symbols[::-1]
        return tuple(s[_suffix_order(s, depth) - 1].astype("<i4") for s in (symbols, turned))

    def words(self) -> Intervals:
        word = np.arange(1, self.n_symbols)
        start = self.forward.start
        return Intervals(word[:, None], start[word + 1] - start[word], start[word], start[word])

    def extend(
        self, grams: Intervals, right: bool, keep: Callable[[np.ndarray], np.ndarray] | None = None, last: bool = False
    ) -> Intervals:
        """All n-grams one word longer, to the right or to the left, with their counts.

        The words that follow an n-gram are the symbols in its rows of the reversed text's transform, those before it
        the symbols in its rows of the text's; both intervals move along.  ``keep`` chooses among the new n-grams by
        their words; after the ``last`` step the rows are not needed any more.
        """
        if right:
            side, here, there = self.backward, grams.backward, grams.forward
        else:
            side, here, there = self.forward, grams.forward, grams.backward
        size = grams.size
        row = np.repeat(here - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        gram = np.repeat(np.arange(len(size)), size)
        key, count = np.unique(gram * self.n_symbols + side.bwt[row], return_counts=True)
        gram, symbol = key // self.n_symbols, key % self.n_symbols
        old = grams.words[gram]
        words = np.column_stack([old, symbol] if right else [symbol, old])
        chosen = symbol != BREAK
        if keep is not None:
            at = np.flatnonzero(chosen)
            chosen[at] = keep(words[at])
        if last:
            return Intervals(words[chosen], count[chosen], None, None)
        before = np.cumsum(count) - count  # rows of smaller symbols, of earlier n-grams as well
        first = np.searchsorted(gram, np.arange(len(size)))
        other = (there[gram] + before - before[first[gram]])[chosen]
        own = side.step(symbol[chosen], here[gram[chosen]])
        return Intervals(words[chosen], count[chosen], *((other, own) if right else (own, other)))


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, vocabulary, text) of the shards of a task.

    A task gathers words until there are ``shard_words`` of them and then closes a shard for each language, so a hot
    language makes more shards, not larger ones; only a single text can make a shard larger.
    """
    parts: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    held = 0
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for at, (lang, text) in enumerate(zip(batch.column(0), batch.column(1))):
            texts.setdefault(lang.as_py(), []).append(text.as_py())
            size += len(text.as_buffer())
            if size < 2 << 20 and at + 1 < batch.num_rows:
                continue
            for key, some in texts.items():
                parts.setdefault(key, []).append(_cut(some))
                held += len(parts[key][-1][1])
            texts, size = {}, 0
            if held >= shard_words:
                yield from _closed(parts)
                held = 0
    yield from _closed(parts)


def _closed(parts: dict[str, list[tuple[pa.Array, np.ndarray]]]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for lang in list(parts):
        vocabulary, text = _symbols(parts.pop(lang))
        if len(vocabulary):
            yield lang, vocabulary, text


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash of each word of a language, to be added up over a phrase."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slots of n-grams from the hashes of their words (one row an n-gram)."""
    mixed = np.zeros(len(hashes), np.uint64)
    for k in range(hashes.shape[1]):
        mixed = (mixed + hashes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _frequent_bits(grams: DataFrame, bits: int) -> np.ndarray:
    """A bit map of ``2**bits`` bits, set for every n-gram of the table; its size does not depend on the table's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in _by_language(batch):
                phrases = [p.encode().split(b" ") for p in rows]
                if phrases:
                    hashes = _hashes(lang, [w for p in phrases for w in p]).reshape(len(phrases), -1)
                    slot = _slot(hashes, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], ["at", "bit"])

    marks = grams.select("lang", "phrase").mapInArrow(run, "at long, bit long")
    filled = marks.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("word")).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[filled.column("at").to_numpy()] = filled.column("word").to_numpy()
    return found.view(np.uint64)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    for lang in pc.unique(batch.column(0)).to_pylist():
        yield lang, batch.filter(pc.equal(batch.column(0), lang)).column(1).to_pylist()


def _shard_grams(
    texts: DataFrame, size: int, shard_words: int, frequent: np.ndarray | None = None, bits: int = 0
) -> DataFrame:
    """(lang, size, phrase, f): the n-grams of ``size`` words of every shard with their counts there.

    With ``frequent`` only n-grams both of whose parts one word shorter have their bit set there.  n-grams grow to the
    right and to the left in turn, some rows of the transform at a time.
    """
    spread = texts.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, text in _shards(batches, shard_words):
            if size == 1:
                word = np.arange(1, len(vocabulary) + 1)
                count = np.bincount(text, minlength=len(vocabulary) + 1)[1:]
                yield from rows(lang, vocabulary, Intervals(word[:, None], count, None, None))
                continue
            hashes = None if spread is None else np.r_[np.uint64(0), _hashes(lang, vocabulary.to_pylist())]
            index = PhraseIndex(*PhraseIndex.of(text, size - 1), len(vocabulary) + 1)
            for found in grown(index, index.words(), 1, hashes):
                yield from rows(lang, vocabulary, found)

    def common(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        slot = _slot(hashes[words], bits)
        return (spread.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

    def grown(index: PhraseIndex, grams: Intervals, k: int, hashes: np.ndarray | None) -> Iterator[Intervals]:
        """All n-grams of ``size`` words from those of ``k`` words."""
        if k == size:
            yield grams
            return
        right, keep = bool(k % 2), None
        if hashes is not None and k == size - 1:
            new = slice(1, None) if right else slice(None, -1)
            grams = grams.where(common(grams.words, hashes))
            keep = lambda words: common(words[:, new], hashes)
        for some in grams.portions(1 << 20):
            yield from grown(index, index.extend(some, right, keep, last=k == size - 1), k + 1, hashes)

    def rows(lang: str, vocabulary: pa.Array, found: Intervals) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(found.size), 1 << 17):
            part = found.words[lo : lo + (1 << 17)]
            columns = [vocabulary.take(pa.array(part[:, k] - 1)) for k in range(size)]
            blank = pa.scalar(b" ", pa.large_binary())
            phrase = pc.binary_join_element_wise(*columns, blank) if size > 1 else columns[0]
            n = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)),
                phrase.cast(pa.large_string()).cast(pa.string()),
                pa.array(found.size[lo : lo + (1 << 17)].astype(np.int64)),
            ], ["lang", "size", "phrase", "f"])

    return texts.mapInArrow(run, GRAMS)


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, max_words: int = 3, min_count: int = 10, text_col: str = "text",
    lang_col: str = "lang", shard_words: int = 2_500_000, filter_bits: int = 26,
) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all n-grams of up to ``max_words`` words with f >= ``min_count``, (lang, n)).

    Level by level, each from the texts: an n-gram can be frequent only if both parts one word shorter are, so shards
    report only those whose parts are set in a bit map of ``2**filter_bits`` bits.  The map has a fixed size; where
    its slots are shared, shards report some n-grams too many, which the sum then drops.  n counts all words.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"),
    )
    levels, frequent, totals = [], None, None
    for size in range(1, max_words + 1):
        rows = _shard_grams(texts, size, shard_words, frequent, filter_bits)
        # shards have each phrase once, so adding up before the shuffle would save nothing
        level = rows.repartition("lang", "phrase").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        if size == 1:
            level = scratch.write(level, "words")
            totals = scratch.write(level.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        levels.append(scratch.write(level.where(F.col("f") >= min_count), f"level-{size}"))
        if size < max_words:
            frequent = _frequent_bits(levels[-1], filter_bits)
    return reduce(DataFrame.union, levels), totals


def _part(first: Column | int, length: Column) -> Column:
    """``length`` words of the phrase from place ``first`` on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
    covered_percent: int = 50, top: int = 2000, shard_words: int = 2_500_000, filter_bits: int = 26,
) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    a counts the phrase, l and r its two parts at the cut with the lowest score floor(1000000 a a / (l r)), of equal
    scores the earliest cut; n counts the words of the language.  Candidates occur ``min_count`` times; one goes if a
    longer candidate that holds it has at least ``covered_percent`` percent of its count.  Equal scores go by higher
    count, then by phrase in byte order.

    Counts come from ``frequent_phrases`` over whole texts and all rows; arithmetic is exact to 38 digits.  Null texts
    are empty, a null language counts as ``und``, repeated rows count each, empty tables give an empty result; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    grams, totals = frequent_phrases(docs, scratch, max_words, min_count, text_col, lang_col, shard_words, filter_bits)
    size = F.col("size")
    many = grams.where(size > 1)
    cuts = many.select("lang", "size", "phrase", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part(1, F.col("k")), "right": _part(F.col("k") + 1, size - F.col("k"))})
    part = grams.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    for side in ("left", "right"):
        own = part.withColumnsRenamed({"part_lang": f"{side}_lang", "part": f"{side}_part", "part_f": f"{side}_f"})
        cuts = cuts.join(own, (F.col("lang") == F.col(f"{side}_lang")) & (F.col(side) == F.col(f"{side}_part")))
    exact = F.expr(
        "cast(1000000 as decimal(7,0)) * (cast(f as decimal(15,0)) * cast(f as decimal(15,0)))"
        " div (cast(left_f as decimal(15,0)) * cast(right_f as decimal(15,0)))"
    )
    scored = cuts.withColumn("score", exact).groupBy("lang", "size", "phrase", "f").agg(
        F.min(F.struct("score", "k", F.col("left_f").alias("l"), F.col("right_f").alias("r"))).alias("best")
    )
    # every phrase inside a longer candidate, with the largest count of those around it
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i ->"
        " array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    around = many.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("f"))
    )
    order = [F.desc("best.score"), F.desc("f"), F.asc("phrase")]
    # a hot language is first cut down in parts
    part_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part_of)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = kept.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").alias("score"),
    )
