"""Encoding of whole texts with public tokenizers, word by word through a cache.

Both vocabularies part texts before blanks: no token holds text from both sides of a boundary where a blank
follows a non-blank. So a text may be cut there, each distinct cut piece encoded once and the rest looked up.
Texts with other white space than U+0020 and U+0009 to U+000D are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PIECES = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
#: Encodings kept by a worker; the cache is emptied when full.
CACHE = 800_000
#: Pieces whose parts are known without the tokenizer's own splitting: Latin letters, then perhaps marks.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a letter: printable ones as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(own)))
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100)]}


_LETTERS = _byte_letters()
_CODERS: dict[tuple[str, bool], "Coder"] = {}


def _bare(text: str) -> list[bytes]:
    """Words; A to Z are lower-cased, as the vocabulary does, where no special token could be met by it."""
    raw = text.encode()
    return (raw if b"<|" in raw else raw.lower()).split()


class Coder(dict):
    """Encodings by piece, made when first met. ``drops_blanks``: the vocabulary ignores white space, so pieces are the bare words."""

    def __init__(self, path: str, drops_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_blanks = drops_blanks
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str | bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.words.clear()
        text = piece.decode() if self.drops_blanks else piece
        plain = _PLAIN.fullmatch(text)
        if plain:
            space, letters, marks = plain.groups()
            out = self._word(letters.lower() if self.drops_blanks else space + letters)
            if marks:
                out += self._word(marks)
        else:
            out = self._whole(text)
        self[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        """A word, or a run of marks, that the tokenizer does not part."""
        out = self.words.get(word)
        if out is None:
            spelled = word if word.isascii() and word[0] != " " else word.translate(_LETTERS)
            ids = array("I", [t.id for t in self.model.tokenize(spelled)])
            if sys.byteorder == "big":
                ids.byteswap()
            out = self.words[word] = ids.tobytes()
        return out

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if _OTHER_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, _bare(text) if self.drops_blanks else _PIECES.findall(text)))


def coder(path: str, drops_blanks: bool) -> Coder:
    """One for each worker and file."""
    if (path, drops_blanks) not in _CODERS:
        _CODERS[path, drops_blanks] = Coder(path, drops_blanks)
    return _CODERS[path, drops_blanks]


def forget(path: str, drops_blanks: bool) -> None:
    """Empties the worker's cache of encodings; the vocabulary stays."""
    own = coder(path, drops_blanks)
    own.clear()
    own.words.clear()


def encoded(path: str, drops_blanks: bool, texts: list[str], end_id: int):
    """Yields each text's ids with ``end_id`` after them."""
    encode, end = coder(path, drops_blanks).encode, np.asarray([end_id], "<u4").tobytes()
    for text in texts:
        yield encode(text) + end
