"""Sum-of-squares online packing of token documents into windows.

Each task packs its own documents as they come. A level array counts the open windows by how full they are. A
remainder goes into the level, or a new window, that makes the sum of squared counts least. Full windows'
worth of a longer document are cut off first. When a task ends, what its open windows hold is cut anew into full
windows, and the last tail at powers of two, which are never padded. Open windows hold remainders of the task's
documents alone, so memory is bounded by the split that a task reads.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
piece; very long texts are cut; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import as_bytes
from tidemark.llm.vocab import encoded, forget

CAPACITY = 1024
#: A piece: document, start in it, ids as bytes, the document's tokens.
Piece = tuple[int, int, bytes, int]


class Packer:
    """``add`` documents, ``finish``; both give closed windows, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def _level(self, size: int) -> int:
        """The fill level to put ``size`` tokens into; 0: a new window. Ties: the fullest."""
        counts, c = self.counts, self.capacity
        here = counts[1 : c - size + 1]
        best, level = 2 * counts[size] + 1 if size < c else 1, 0
        if here.any():
            then = counts[1 + size : c + 1]
            change = 2 * (then - here) + 2
            change[-1] = 1 - 2 * here[-1]  # a window that closes leaves no count
            change[here == 0] = np.iinfo(np.int64).max
            k = len(change) - 1 - int(change[::-1].argmin())
            if change[k] <= best:
                level = k + 1
        return level

    def _put(self, piece: Piece, size: int) -> list[list[Piece]]:
        level = self._level(size)
        if level:
            window = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return [window]
        self.levels[level + size].append(window)
        self.counts[level + size] += 1
        self.open += 1
        return []

    def add(self, doc: int, ids: bytes) -> list[list[Piece]]:
        total = len(ids) // 4
        cut = total - total % self.capacity
        out = [[(doc, k, ids[4 * k : 4 * (k + self.capacity)], total)] for k in range(0, cut, self.capacity)]
        if cut < total:
            out += self._put((doc, cut, ids[4 * cut :], total), total - cut)
        return out

    def finish(self) -> list[list[Piece]]:
        """Empties all open windows into full ones; the tail is cut at powers of two."""
        pieces = [p for level in reversed(self.levels) for window in level for p in window]
        self.__init__(self.capacity)
        total = sum(len(p[2]) // 4 for p in pieces)
        tail = total % self.capacity
        sizes = [self.capacity] * (total // self.capacity) + [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1]
        out, at, skip = [], 0, 0
        for size in sizes:
            window: list[Piece] = []
            while size:
                doc, start, ids, n = pieces[at]
                take = min(size, len(ids) // 4 - skip)
                window.append((doc, start + skip, ids[4 * skip : 4 * (skip + take)], n))
                skip, size = skip + take, size - take
                if skip == len(ids) // 4:
                    at, skip = at + 1, 0
            out.append(window)
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, drops_blanks: bool, capacity: int = CAPACITY, keep_cache: bool = True) -> DataFrame:
    """Pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded_length).

    Without ``keep_cache`` a worker gives up its encodings after each task, and so leaves its memory to other stages.

    No exchange. A sequence's id is its task's number and its number there; both follow from the input's
    splits and rows, so a task that runs again gives the same.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(capacity), TaskContext.get().partitionId() << 32

        def rows(windows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[tuple] = []
            for window in windows:
                size = sum(len(p[2]) for p in window) // 4
                padded = size if size & (size - 1) == 0 else capacity
                at = 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids) // 4, ids, total, number, at, padded))
                    at += len(ids) // 4
                number += 1
            for k in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out[k : k + 5000], strict=True), strict=True)], names=names)

        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in as_bytes(batch.column(1))]
            closed: list[list[Piece]] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(vocabulary, drops_blanks, texts, end_id), strict=True):
                closed += packer.add(doc, ids)
                if len(closed) >= 2000:
                    yield from rows(closed)
                    closed = []
            yield from rows(closed)
        yield from rows(packer.finish())
        if not keep_cache:
            forget(vocabulary, drops_blanks)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long")
