"""Alignment of two tokenizers over the same texts, each distinct text once.

Texts are shuffled by the text itself, so each distinct one is tokenised and aligned once and carries the number of
documents that hold it. A text with a leading space is tokenised by A (byte-level BPE), the text alone by B (piece BPE,
which adds that space). Byte offsets at which tokens of both end cut the tokens into groups; the two tokens that end
there are linked. Tokens hold a byte at least, so a group has exactly one link.

An id pair's count is the number of its links in all documents: those of a distinct text, times its documents. Blocks of
texts hold each distinct segment (a word with the blanks before it) once; a block gives each distinct pair once to the
counting join, and gets its corpus-wide count back. Measures go back to the documents by the SHA-256 of their texts.

Edge cases: texts that are null or empty, or whose tokens' bytes differ from the text (unknown pieces, U+2581 in it),
have no tokens: zeros and an empty digest. Repeated rows and null ids get a row each; copies, however many, cost one
alignment; ties for the highest count all count as best; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import emit, written
from tidemark.llm.katz import _expand, _squeeze

#: A word with the blanks before it, or the blanks at the end. Neither vocabulary joins what lies on both sides of such a cut.
_SEGMENT = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: The same, with the marks that end a word of Latin letters cut off, for a B without pieces that hold both.
_CUT = re.compile(r"[ \t\n]*[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?=[.,;:!?]+(?:[ \t\n]|\Z))|[.,;:!?]+(?=[ \t\n]|\Z)|[ \t\n]*[^ \t\n]+|[ \t\n]+")
_CROSSES = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF][.,;:!?]")
#: Texts with these are tokenised whole: other white space, control characters, and the mark that stands for a space in pieces.
_WHOLE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u2581\u3000\ufeff]")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_SPACE_PIECE = "\u2581"


@dataclass(frozen=True)
class Alignment:
    #: Segments whose alignment a worker keeps, in two halves: when one is full, the other is emptied.
    cache: int = 400_000
    #: Characters of text after which a block is closed, at the end of a text.
    block: int = 6_000_000


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves, the others as the letters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Tokenizes with both vocabularies and aligns, through a cache of segments."""

    def __init__(self, path_a: str, path_b: str, how: Alignment):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.how = how
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letter = _byte_of_letter()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(_SPACE_PIECE, " ").encode() for p in pieces]
        self.space_b, self.x_b = self.b.piece_to_id(_SPACE_PIECE), self.b.piece_to_id(_SPACE_PIECE + "x")
        self.segment = _SEGMENT if any(_CROSSES.search(p) for p in pieces) else _CUT
        self.cache: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def aligned(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """For each text: (A's tokens, B's, groups, the groups spelled out, codes of the linked pairs); None where the bytes differ.

        Where all bytes agree the texts lie end to end: one run of tokens, with a common end after each text.
        """
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        ids_a, ids_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        raw = "".join(texts).encode()
        of_a, of_b = [self.bytes_a.get(x, b"") for x in ids_a], [self.bytes_b[x] for x in ids_b]
        end_a, end_b = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (of_a, of_b))
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        own = n_a.all() and n_b.all() and all(of_a) and all(of_b) and b"".join(of_a) == raw and b"".join(of_b) == raw
        if not own or (end_a[np.cumsum(n_a) - 1] != ends).any() or (end_b[np.cumsum(n_b) - 1] != ends).any():
            return [None] if len(texts) == 1 else [x for t, i, j in zip(texts, a, b, strict=True) for x in self.aligned([t], [i], [j])]
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)  # of each group
        last_b = at[last_a]
        codes = (np.asarray(ids_a, np.int64)[last_a] << 32 | np.asarray(ids_b, np.int64)[last_b]).tolist()
        said_a, said_b = list(map(str, ids_a)), list(map(str, ids_b))
        to_a, to_b = [0, *(last_a + 1).tolist()], [0, *(last_b + 1).tolist()]
        said = [",".join(said_a[i:j]) + "|" + ",".join(said_b[p:q]) for i, j, p, q in zip(to_a, to_a[1:], to_b, to_b[1:])]  # noqa: B905
        ends = [0, *(np.searchsorted(last_a, np.cumsum(n_a) - 1) + 1).tolist()]
        return [(x, y, j - i, ";".join(said[i:j]), tuple(codes[i:j])) for x, y, i, j in zip(n_a.tolist(), n_b.tolist(), ends, ends[1:])]  # noqa: B905

    def whole(self, text: str) -> tuple | None:
        return self.aligned([f" {text}"], [self.a.encode(f" {text}", add_special_tokens=False).ids], [self.b.encode(text)])[0] if text else None

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(" " + text)

    def learn(self, segments: set[str]) -> None:
        """Adds the alignments of segments to the cache; each starts with a blank, or is the marks after a word."""
        if len(self.cache) + len(segments) > self.how.cache // 2:
            self.cache, self.old = {}, self.cache
        new = []
        for s in segments.difference(self.cache):
            if s in self.old:
                self.cache[s] = self.old[s]
            else:
                new.append(s)
        if not new:
            return
        of_a = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B puts a space before what it gets: it stands for a segment's own, or goes with a first letter or blank
        of_b = self.b.encode([s[1:] if s[0] == " " else s if s[0] in "\t\n" else "x" + s for s in new], num_threads=1)
        for k, s in enumerate(new):
            if s == " ":
                of_b[k] = [self.space_b]
            elif s[0] != " ":
                of_b[k] = of_b[k][1:] if of_b[k][:1] == [self.space_b if s[0] in "\t\n" else self.x_b] else []
        self.cache.update(zip(new, self.aligned(new, of_a, of_b), strict=True))


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str, how: Alignment) -> Aligner:
    """One for each worker and pair of files."""
    key = path_a, path_b, how
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("digest", pa.list_(pa.binary())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string()))]
    + [("n_segments", pa.list_(pa.int32())), ("segments", pa.binary()), ("n_links", pa.list_(pa.int32())), ("links", pa.binary()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
_BLOCK_DDL = (
    "block long, digest array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "n_segments array<int>, segments binary, n_links array<int>, links binary, codes array<long>, counts array<long>"
)


class _Block:
    """Texts, the numbers of their segments, and the links of each distinct segment."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.of: dict[str, int] = {}  # segment, or the digest of a whole text → its number in the block
        self.entries: list[tuple] = []
        self.said: list[str] = []
        self.digests, self.sha, self.times, self.lens, self.segments = [], [], [], [], []

    def number_of(self, key, entry: tuple) -> int:
        n = self.of[key] = len(self.entries)
        self.entries.append(entry)
        self.said.append(entry[3])
        return n

    def add(self, digest: bytes, times: int, numbers: list[int], size: int) -> None:
        self.digests.append(digest), self.times.append(times), self.lens.append(len(numbers))
        self.sha.append(hashlib.sha256(";".join([self.said[n] for n in numbers]).encode()).hexdigest() if numbers else "")
        self.segments.append(np.asarray(numbers, np.int32))
        self.size += size

    def batch(self) -> pa.RecordBatch:
        segments = np.concatenate(self.segments) if self.segments else np.zeros(0, np.int32)
        lens = np.asarray(self.lens, np.int64)
        times = np.bincount(segments, np.repeat(np.asarray(self.times, np.float64), lens), len(self.entries)).astype(np.int64)
        n_links = np.fromiter((len(e[4]) for e in self.entries), np.int64, len(self.entries))
        codes = np.fromiter((c for e in self.entries for c in e[4]), np.int64, int(n_links.sum()))
        codes, links = np.unique(codes, return_inverse=True)
        counts = np.bincount(links, np.repeat(times, n_links), len(codes)).astype(np.int64)
        measures = {n: _sums(np.fromiter((e[k] for e in self.entries), np.int64, len(self.entries))[segments], lens) for k, n in enumerate(("n_a", "n_b", "n_groups"))}
        one = {"block": self.number, "digest": self.digests, "groups_sha256": self.sha, "n_segments": lens, "segments": _squeeze(segments.astype(np.uint32)), "n_links": n_links, "links": _squeeze(links.astype(np.uint32)), "codes": codes, "counts": counts} | measures
        return emit(_BLOCKS, {k: [v] for k, v in one.items()})


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sum of each run of ``lens`` values; empty runs give 0."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.cumsum(lens)
    return ends[at] - ends[at - lens]


def _blocks(texts: DataFrame, path_a: str, path_b: str, how: Alignment) -> DataFrame:
    """Blocks of aligned texts, from (digest, text, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b, how)
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                rows = [(*x, None if _WHOLE.search(x[1]) else both.segments(x[1])) for x in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                both.learn({s for *_, segments in rows if segments for s in segments})
                for digest, text, times, segments in rows:
                    if segments is None:
                        entry = both.whole(text)
                        numbers = [block.number_of(digest, entry)] if entry else []
                    else:
                        numbers = list(map(block.of.get, segments))
                        if None in numbers:
                            if any(both.cache[s] is None for s, n in zip(segments, numbers, strict=True) if n is None):
                                numbers = []
                            for k, n in enumerate(numbers):
                                if n is None:
                                    s = segments[k]
                                    numbers[k] = block.of[s] if s in block.of else block.number_of(s, both.cache[s])
                    block.add(digest, times, numbers, len(text))
                    if block.size >= how.block:
                        yield block.batch()
                        block = _Block(block.number + 1)
        if block.digests:
            yield block.batch()

    return texts.mapInArrow(run, _BLOCK_DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, count, best) of every linked id pair: its links in all documents, and whether none of its B id has more.

    A code holds A's id above 32 bits and B's below them. A B id has at most as many pairs as A's vocabulary has tokens.
    """
    each = blocks.select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("x.codes", "x.counts")
    summed = each.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("count"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND(0xFFFFFFFF))
    return summed.select("code", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


_MEASURES = pa.schema([("digest", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _measures(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each distinct text, from its block's links and their corpus-wide counts."""
    asked = blocks.select("block", F.posexplode("codes").alias("at", "code"))
    told = asked.join(counts, "code").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name: batch.column(batch.schema.get_field_index(name))[row].values  # noqa: B023, E731
                n_links, lens = (of(n).to_numpy().astype(np.int64) for n in ("n_links", "n_segments"))
                links, segments = (_expand(batch.column(batch.schema.get_field_index(n))[row].as_py(), np.uint32) for n in ("links", "segments"))
                count, best = np.zeros(len(of("codes")), np.int64), np.zeros(len(of("codes")), np.int64)
                if (answer := of("told")) is not None and len(count):
                    at = answer.field("at").to_numpy()
                    count[at], best[at] = answer.field("count").to_numpy(), answer.field("best").to_numpy(zero_copy_only=False)
                sums = {n: _sums(_sums(v[links], n_links)[segments], lens) for n, v in (("count_sum", count), ("n_best", best), ("n_links", np.ones_like(count)))}
                yield pa.RecordBatch.from_arrays([pa.array(sums[f.name], f.type) if f.name in sums else of(f.name) for f in _MEASURES], schema=_MEASURES)

    ddl = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("counts").join(told, "block", "left").mapInArrow(run, ddl)


def align(docs: DataFrame, path_a: str, path_b: str, how: Alignment = Alignment()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the pair table: code, count, best)."""
    digest = F.unhex(F.sha2(F.col("text"), 256))
    texts = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    blocks = written(_blocks(texts.select(digest.alias("digest"), "text", "times"), path_a, path_b, how), "aligned")
    counts = written(pair_counts(blocks), "pair-counts")
    measures = written(_measures(blocks, counts), "measures")
    keyed = docs.select("doc_id", F.when(F.col("text") != "", digest).alias("digest"))
    zeros = {n: 0 for n in measures.columns if n not in ("digest", "groups_sha256")}
    return keyed.join(measures, "digest", "left").fillna(zeros | {"groups_sha256": ""}).select("doc_id", *zeros, "groups_sha256"), counts
