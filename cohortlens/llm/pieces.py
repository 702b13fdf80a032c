"""SentencePiece BPE by vectorised merge rounds, and decoding of the ids."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"  # the piece alphabet's sign for a blank
POINTS = 0x110000
NONE = np.iinfo(np.int32).max
IDS = "<u4"
#: Words up to this length are kept in a worker's cache.
CACHED_LENGTH = 64
#: Texts that a task works on at a time.
SLICE = 256


def _one_bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("cohortlens-each-byte", _one_bad_byte)


class PieceModel:
    """The merges of a SentencePiece BPE model as flat tables.

    ``pairs`` are the keys (left, right) of all splits of a piece into two pieces, ``merged`` the piece of each
    key and ``rank`` the dense order of its score, best first.  A code point outside the vocabulary is the symbol
    ``size + code point``: it is part of no pair and becomes its UTF-8 bytes at the end.

    All places of the best pair of a word can be merged at once if no merge with the new piece comes as early as the
    piece itself (``safe``); otherwise the library would look at the new neighbours first, and only the leftmost place
    is merged in the round.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.stride = n + POINTS
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        control = {i for i in range(n) if sp.is_control(i)}
        byte = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        own = {name: i for i, name in enumerate(names) if i not in control and i not in byte and i != self.unknown}
        score = {i: sp.get_score(i) for i in own.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs, merged = [], []
        for name, i in own.items():
            for cut in range(1, len(name)):
                left, right = own.get(name[:cut]), own.get(name[cut:])
                if left is not None and right is not None:
                    pairs.append(left * self.stride + right)
                    merged.append(i)
        self.pairs, self.merged = np.array(pairs, np.int64), np.array(merged, np.int32)
        self.rank = np.array([order[score[i]] for i in merged], np.int32)
        self._hash_pairs()
        earliest = np.full(n, NONE, np.int64)
        for side in (self.pairs // self.stride, self.pairs % self.stride):
            np.minimum.at(earliest, side, self.rank)
        ranks = np.full(n, -1, np.int64)
        ranks[list(score)] = [order[s] for s in score.values()]
        shared = np.bincount(ranks[ranks >= 0], minlength=len(order)) > 1
        self.safe = (earliest > ranks) & (ranks >= 0) & ~shared[ranks]
        self.symbol = np.arange(POINTS, dtype=np.int32) + n
        for name, i in own.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        # words end where no piece can reach across
        many = [name for name in own if len(name) > 1]
        breaks = not any("\n" in name for name in many)
        spaces = not any(name[k] != SPACE and name[k + 1] == SPACE for name in many for k in range(len(name) - 1))
        stop = SPACE * spaces + "\n" * breaks
        if spaces:
            pattern = f"{SPACE}*[^{stop}]+|{SPACE}+" + "|\n" * breaks
        else:
            pattern = "[^\n]+|\n" if breaks else "(?s:.+)"
        self.words = re.compile(pattern)
        probe = "ﬁ ① Å  x "
        self.plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.byte_id = np.zeros(256, IDS)
        for i, b in byte.items():
            self.byte_id[b] = i
        self.has_bytes = len(byte) == 256
        surface = [b"" if i in control else bytes([byte[i]]) if i in byte else
                   sp.decode([i]).encode() if i == self.unknown else name.encode() for i, name in enumerate(names)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.silent = np.zeros(n, bool)
        self.silent[list(control)] = True
        self.opens = np.array([name.startswith(SPACE) and i in score for i, name in enumerate(names)])
        self.cache: dict[str, bytes] = {}
        self.max_words = 250_000

    # the pair table: open addressing, a few times more slots than pairs

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash_pairs(self) -> None:
        self.bits = max(8, 3 + len(self.pairs).bit_length())
        self.slots = np.full((1 << self.bits) + 256, -1, np.int64)  # place of the pair
        self.keys = np.full(len(self.slots), -1, np.int64)
        waiting, at = np.arange(len(self.pairs)), self._slot(self.pairs)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # of several pairs the last one stays
            rest = self.slots[at] != waiting
            waiting, at = waiting[rest], at[rest] + 1
        used = self.slots >= 0
        self.keys[used] = self.pairs[self.slots[used]]

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``key``, places in ``pairs``) of the keys that are pairs."""
        at = self._slot(key)
        seen = self.keys[at]
        hit = seen == key
        found, slots = [np.flatnonzero(hit)], [at[hit]]
        open_ = np.flatnonzero(~hit & (seen >= 0))
        while len(open_):
            at = at[open_] + 1 if len(at) == len(key) else at + 1
            seen = self.keys[at]
            hit = seen == key[open_]
            found.append(open_[hit])
            slots.append(at[hit])
            rest = ~hit & (seen >= 0)
            open_, at = open_[rest], at[rest]
        return np.concatenate(found), self.slots[np.concatenate(slots)]

    # encoding

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end, as little-endian 32-bit bytes."""
        if len(self.cache) > self.max_words:
            self.cache.clear()
        known, parts, holes = self.cache.get, [], []
        new: dict[str, int] = {}
        for text in texts:
            words = self.words.findall(self._normal(text))
            ids = list(map(known, words))
            if None in ids:
                holes.append([(k, new.setdefault(words[k], len(new))) for k, i in enumerate(ids) if i is None])
            else:
                holes.append(())
            parts.append(ids)
        made = self.encode_words(list(new))
        self.cache.update((w, made[i]) for w, i in new.items() if len(w) <= CACHED_LENGTH)
        for ids, missing in zip(parts, holes):
            for k, i in missing:
                ids[k] = made[i]
        return list(map(b"".join, parts))

    def _normal(self, text: str) -> str:
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Merge rounds over all words at once; a word leaves the arrays when it has no pair left."""
        out: list[bytes] = [b""] * len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.array([len(w) for w in words], np.int64))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            rank, piece = self._look_up(symbols, word)
            best = np.minimum.reduceat(rank, first)
            done = best == NONE
            if done.any():
                self._finish(out, symbols, word[first], first, size, done)
                rest = ~np.repeat(done, size)
                symbols, word, rank, piece = symbols[rest], word[rest], rank[rest], piece[rest]
                best, size = best[~done], size[~done]
                if not len(symbols):
                    break
            symbols, word = self._merge(out, symbols, word, rank, piece, best, size)
        return out

    def _look_up(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that starts at each symbol; ``NONE`` where there is none."""
        rank, piece = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        at = np.flatnonzero(word[1:] == word[:-1])
        key = symbols[at].astype(np.int64) * self.stride + symbols[at + 1]
        hit, pair = self._find(key)
        rank[at[hit]] = self.rank[pair]
        piece[at[hit]] = self.merged[pair]
        return rank, piece

    def _merge(self, out, symbols, word, rank, piece, best, size) -> tuple[np.ndarray, np.ndarray]:
        """One round: the best pair of every word, at all its places from the left or at the leftmost one only."""
        pair = rank == np.repeat(best, size)
        place = np.arange(len(pair))
        # in a chain of overlapping places every second one goes, counted from the left
        opens = pair & ~np.r_[False, pair[:-1]]
        start = np.maximum.accumulate(np.where(opens, place, 0))
        chosen = pair & ((place - start) % 2 == 0)
        at = np.flatnonzero(chosen)
        leftmost = np.r_[True, word[at][1:] != word[at][:-1]]
        safe = self.safe[piece[at]]
        # a long word whose pairs must go one after the other leaves for the heap
        which = np.cumsum(np.r_[False, word[1:] != word[:-1]])
        slow = np.zeros(len(best), bool)
        slow[which[at[leftmost & ~safe]]] = True
        slow &= size > 256
        at = at[safe | leftmost]
        symbols[at] = piece[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        if slow.any():
            for w in np.flatnonzero(slow):
                inside = which == w
                out[word[inside][0]] = self._bytes(self._one_by_one(symbols[inside & keep].tolist()))
            keep &= ~slow[which]
        return symbols[keep], word[keep]

    def _one_by_one(self, symbols: list[int]) -> np.ndarray:
        """Merges of one word in strict order, by a heap of (rank, place)."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._pair_dict
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := table.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = table[left, right][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([s for s in symbols if s >= 0], np.int32)

    @property
    def _pair_dict(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_dict"):
            left, right = (self.pairs // self.stride).tolist(), (self.pairs % self.stride).tolist()
            self._dict = dict(zip(zip(left, right), zip(self.rank.tolist(), self.merged.tolist())))
        return self._dict

    def _bytes(self, symbols: np.ndarray) -> bytes:
        """Symbols as ids; symbols outside the vocabulary as their bytes."""
        if not (odd := symbols >= self.size).any():
            return symbols.astype(IDS).tobytes()
        if not self.has_bytes:  # a run of unknown symbols is one unknown id
            ids = np.where(odd, self.unknown, symbols)
            return ids[~(odd & np.r_[False, odd[:-1]])].astype(IDS).tobytes()
        parts = [self.byte_id[np.frombuffer(chr(s - self.size).encode(), np.uint8)] if s >= self.size
                 else np.array([s], IDS) for s in symbols.tolist()]
        return np.concatenate(parts).tobytes()

    def _finish(self, out, symbols, names, first, size, done) -> None:
        odd = np.logical_or.reduceat(symbols >= self.size, first)
        flat = symbols.astype(IDS).tobytes()
        for w, at, n, strange in zip(names[done].tolist(), first[done].tolist(), size[done].tolist(), odd[done].tolist()):
            out[w] = self._bytes(symbols[at : at + n]) if strange else flat[4 * at : 4 * (at + n)]

    # decoding

    def decode(self, rows: list[bytes]) -> list[str]:
        """The text of each row of ids, as the library's ``decode(ids)`` gives it."""
        ids = np.frombuffer(b"".join(rows), IDS).astype(np.int64)
        size = self.surface_size[ids]
        total = int(size.sum())
        skip = np.cumsum(size) - size
        raw = self.surface[np.repeat(self.surface_at[ids] - skip, size) + np.arange(total)].tobytes()
        ends = np.r_[0, np.cumsum(size)]
        count = np.cumsum([0] + [len(r) // 4 for r in rows])
        out = []
        quiet = np.flatnonzero(self.silent[ids])
        quiet_at = np.searchsorted(quiet, count).tolist()
        for lo, hi, q0, q1 in zip(count[:-1].tolist(), count[1:].tolist(), quiet_at[:-1], quiet_at[1:]):
            # silent ids end a run of byte pieces
            cuts = [lo - 1, *quiet[q0:q1].tolist(), hi]
            first = next((a + 1 for a, b in zip(cuts, cuts[1:]) if b - a > 1), None)
            text = "".join(
                raw[ends[a + 1] : ends[b]].decode("utf-8", "cohortlens-each-byte") for a, b in zip(cuts, cuts[1:]) if b - a > 1
            )
            if first is not None and self.opens[ids[first]]:
                text = text[1:]  # the blank that encoding puts before a text
            out.append(text.replace(SPACE, " "))
        return out


@lru_cache(maxsize=2)
def model_for(path: str) -> PieceModel:
    """The worker's model; tasks that follow each other in one Python worker share its caches."""
    return PieceModel(path)


def _with_columns(df: DataFrame, keep: list[str] | None, steps: list[tuple[str, T.DataType, str, Callable]]) -> DataFrame:
    """``df`` with a column (name, type, source, work) for each step, made by ``work(list) -> list`` in the same pass.

    A batch goes through in slices, so that a task holds the lists of a few hundred texts only.
    """
    made = [name for name, *_ in steps]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    sent = list(dict.fromkeys([*kept, *(source for *_, source, _ in steps if source in df.columns)]))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, *_ in steps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                rows = batch.slice(lo, SLICE)
                new: dict[str, list] = {}
                for name, _, source, work in steps:
                    new[name] = work(new[source] if source in new else rows.column(source).to_pylist())
                columns = [rows.column(c) for c in kept]
                columns += [pa.array(new[n], pa.string() if kind == T.StringType() else pa.binary()) for n, kind, *_ in steps]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    return df.select(*sent).mapInArrow(run, schema)


def encode_pieces(
    docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the ids of every whole text as binary: little-endian unsigned 32-bit, begin and end id included.

    The ids are those of the library's ``encode`` with begin and end and without sampling, for BPE models without
    user-defined symbols.  A text is cut into words where no piece can reach across; the distinct words of a few
    hundred texts are merged together, all in the same rounds over flat arrays.  ``decoded_col`` names a column for
    the text decoded from these ids, made in the same pass.

    A null or empty text holds begin and end only.  A column of the name of a new one is replaced; all other columns
    (or those of ``keep``), repeated rows and null identifiers stay as they are; an empty table gives an empty table.
    Texts of any length are encoded whole; a word is never split, and one without any white space of a million
    characters takes as many rounds as it has different merges.
    """

    def encode(texts: list[str | None]) -> list[bytes]:
        model = model_for(model_path)
        first, last = (np.array([i], IDS).tobytes() for i in (model.begin, model.end))
        return [first + ids + last for ids in model.encode([t or "" for t in texts])]

    steps = [(ids_col, T.BinaryType(), text_col, encode)]
    if decoded_col:
        steps.append((decoded_col, T.StringType(), ids_col, _decoder(model_path)))
    return _with_columns(docs, keep, steps)


def _decoder(model_path: str) -> Callable[[list], list]:
    return lambda rows: model_for(model_path).decode([r or b"" for r in rows])


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``ids_col``, as the library's ``decode(ids)``.

    Control ids are silent, one blank at the start goes if a piece opens with it, byte pieces are read as UTF-8 and
    each byte that is not becomes U+FFFD.  Null ids count as none and give the empty text; an id outside the
    vocabulary raises.  A column of the name ``text_col`` is replaced; the others stay.
    """
    return _with_columns(docs, None, [(text_col, T.StringType(), ids_col, _decoder(model_path))])
