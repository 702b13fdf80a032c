"""Exact tokenization through the tokenizers library, each distinct word once while a bounded cache holds it."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

# A cut is made only between a non-space and ASCII white space.  There every pre-tokenizer used here ends a
# piece, and no normalisation reaches across; a chunk is its white space and the word after it.
CHUNK = re.compile(r"\s*\S+|\s+", re.ASCII)
# Spaces by one definition or another outside ASCII white space: texts with them are encoded as a whole.
ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
ODD_SPACE = re.compile("[" + "".join(map(chr, ODD)) + "]")
# One blank or line break or nothing, Latin-1 letters, then ASCII signs but the apostrophe: pieces that all
# word and byte-level pre-tokenizers cut alike, and that normalisation leaves alone but for case.
PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """A dict that makes missing values and keeps at most ``limit``; when full it starts anew once as many
    values again were made as it holds twice."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.extra = make, limit, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) < self.limit:
                self[key] = value
            else:
                self.extra += 1
                if self.extra > 2 * self.limit:
                    self.clear()
                    self.extra = 0
        return value


class TextEncoder:
    """The ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Texts are cut at white space, and each distinct word goes once to the library.  Plain words go to its merge
    model straight away, after the case folding and byte letters that the file's pipeline asks for; any
    other chunk goes through the whole pipeline, and a text with unusual spaces goes through it as a whole.
    The cache of words holds at most ``max_words`` entries, that of pieces half as many.

    ``added_tokens``: the file's added tokens are found in the text, as the library does by itself; otherwise their
    strings are ordinary text.  They hold no white space, so they never reach across a cut.
    """

    def __init__(self, path: str, end_id: int, max_words: int = 400_000, added_tokens: bool = False):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # word models drop white space and lower; byte-level ones keep both
        self.word_model = bool(spec["model"].get("end_of_word_suffix"))
        self.letters = byte_letters()
        self.end = array("I", [end_id]).tobytes()
        self.pieces = _Cache(self._piece, max_words // 2)
        self.chunks = _Cache(self._chunk, max_words)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isalnum():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        plain = PLAIN.fullmatch(chunk)
        if plain is None:
            return None if ODD_SPACE.search(chunk) else self.encode_whole(chunk)
        space, word, signs = plain.groups()
        if self.word_model:
            ids = self.pieces[word.lower()]
        elif space == " ":
            ids = self.pieces[space + word]
        else:
            ids = self.pieces[space] + self.pieces[word] if space else self.pieces[word]
        return ids + self.pieces[signs] if signs else ids

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def document(self, text: str | None) -> bytes:
        """Ids of the text and the end id, as native (little-endian) 32-bit bytes; null is empty."""
        pieces = list(map(self.chunks.__getitem__, CHUNK.findall(text or "")))
        if None in pieces:
            pieces = [self.encode_whole(text)]
        pieces.append(self.end)
        return b"".join(pieces)


@lru_cache(maxsize=4)
def encoder_for(path: str, end_id: int, added_tokens: bool = False) -> TextEncoder:
    """The worker's encoder; tasks that follow each other in one Python worker share its caches."""
    return TextEncoder(path, end_id, added_tokens=added_tokens)


def public_tokenizer(name: str) -> str:
    """Path of an installed vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
