"""Token-id files: patched frame-of-reference blocks.

A shard image is one self-contained file: a header, the documents' ids and lengths, the offset at which each
block starts, and the blocks. A block of ``BLOCK`` values holds its minimum, a width, the values less the
minimum packed at that width, and a list of exceptions (position and the bits above the width) for the values
that need more. The width is the one that the chosen percentile of the block's values needs.

Images travel as binary cells of Parquet files, so they reach any store that Spark writes, are committed
with the job and are written again if an executor is lost. ``dump`` makes plain files of them.

Edge cases: a null or empty text is the end id alone; repeated rows are kept, in the order of their texts; rows
with a null id come first and get a null id back;
an empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, shared_dir, shuffle_parts
from tidemark.llm.vocab import encoded

MAGIC = b"TMPFOR01"
BLOCK = 256
PERCENTILE = 90
#: Values after which a shard is closed, at the end of a document.
SHARD_VALUES = 1_000_000
#: Stands for a null id in a shard.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<8sQIII")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A shard image of uint32 ``values`` and the documents that they belong to, in order."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = values
    if n:
        padded[n:] = values[-1]
    v = padded.reshape(blocks, BLOCK)
    least = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - least[:, None]
    rank = min(BLOCK - 1, -(-percentile * BLOCK // 100) - 1)
    widths = _bits(np.partition(v, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    over = v.astype(np.uint64) >> widths.astype(np.uint64)[:, None]
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        if w:
            kind = "<u2" if w <= 16 else "<u4"  # the bits above the width are exceptions
            low = v[at].astype(kind).view(np.uint8).reshape(len(at), BLOCK, -1)
            bits = np.unpackbits(low, axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        else:
            packed = np.zeros((len(at), 0), np.uint8)
        for k, row in zip(at, packed, strict=True):
            bodies[k] = row.tobytes()
    rows, cols = np.nonzero(over)
    counts = np.bincount(rows, minlength=blocks)
    ends = np.cumsum(counts)
    where, high = cols.astype("<u2"), over[rows, cols].astype("<u4")
    out, starts, offset = [], np.empty(blocks, "<u8"), 0
    for k in range(blocks):
        a, b = ends[k] - counts[k], ends[k]
        body = struct.pack("<IBH", int(least[k]), int(widths[k]), int(counts[k])) + bodies[k] + where[a:b].tobytes() + high[a:b].tobytes()
        starts[k] = offset
        offset += len(body)
        out.append(body)
    head = _HEAD.pack(MAGIC, n, BLOCK, blocks, len(doc_ids))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<i8").tobytes(), starts.tobytes(), *out])


def read_index(image: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of values, document ids, lengths, block starts, where the blocks begin)."""
    magic, n, block, blocks, docs = _HEAD.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a shard image of this format")
    at = _HEAD.size
    ids = np.frombuffer(image, "<i8", docs, at)
    lengths = np.frombuffer(image, "<i8", docs, at + 8 * docs)
    starts = np.frombuffer(image, "<u8", blocks, at + 16 * docs)
    return n, ids, lengths, starts, at + 16 * docs + 8 * blocks


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks ``first`` up to ``last``, exclusive, or of all; only those blocks are touched."""
    n, _, _, starts, base = read_index(image)
    last = len(starts) if last is None else last
    count = last - first
    least, widths, exceptions = np.empty(count, np.uint32), np.empty(count, np.int64), np.empty(count, np.int64)
    for k in range(count):
        least[k], widths[k], exceptions[k] = struct.unpack_from("<IBH", image, base + int(starts[first + k]))
    raw = np.frombuffer(image, np.uint8)
    body = base + starts[first:last].astype(np.int64) + 7
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(widths):
        if w:
            at = np.flatnonzero(widths == w)
            size = BLOCK * int(w) // 8
            bits = np.unpackbits(raw[body[at][:, None] + np.arange(size)], axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            full = np.zeros((len(at), BLOCK, 16 if w <= 16 else 32), np.uint8)
            full[:, :, :w] = bits
            out[at] = np.packbits(full, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    for k in np.flatnonzero(exceptions):
        at = int(body[k]) + BLOCK * int(widths[k]) // 8
        m = int(exceptions[k])
        where = np.frombuffer(image, "<u2", m, at)
        high = np.frombuffer(image, "<u4", m, at + 2 * m)
        out[k, where] |= high << np.uint32(widths[k])
    out += least[:, None]
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def document(image: bytes, k: int) -> np.ndarray:
    """The ids of the shard's document number ``k``, from its blocks alone."""
    _, _, lengths, _, _ = read_index(image)
    start = int(lengths[:k].sum())
    end = start + int(lengths[k])
    first = start // BLOCK
    return unpack(image, first, -(-end // BLOCK))[start - first * BLOCK : end - first * BLOCK]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, drops_blanks: bool, path: str | None = None) -> str:
    """Encode the whole texts and write shard images in ascending order of ``doc_id``; returns the path.

    One exchange, by ranges of ``doc_id``; each range is a stream of shards, so memory holds one shard.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    ranged = docs.select("doc_id", "text").repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def image() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), "<u4")
            lengths = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "before": [before], "first_doc": [ids[0]], "n_docs": [len(ids)], "n_values": [size], "image": [pack(values, np.asarray(ids), lengths)]},
                schema=_SHARDS,
            )

        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in as_bytes(batch.column(1))]
            for doc, own in zip(batch.column(0).to_pylist(), encoded(vocabulary, drops_blanks, texts, end_id), strict=True):
                ids.append(NO_ID if doc is None else doc)
                held.append(own)
                size += len(own) // 4
                if size >= SHARD_VALUES:
                    yield image()
                    seq, before, ids, held, size = seq + 1, before + size, [], [], 0
        if ids:
            yield image()

    ranged.mapInArrow(shards, _SHARDS_SQL).write.parquet(path)
    return path


_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_values", pa.int64()), ("image", pa.binary())])
_SHARDS_SQL = "part int, seq int, before long, first_doc long, n_docs long, n_values long, image binary"


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards; ``ids`` are little-endian uint32 bytes.

    ``start`` adds the totals of the ranges before; there is one total for each task that wrote.
    """
    shards = spark.read.schema(_SHARDS_SQL).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_values").alias("n"), F.min("first_doc").alias("at"))
    order = Window.orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "image")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, ids, lengths, _, _ = read_index(image)
                flat = unpack(image).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(starts + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([flat[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(unfold, "doc_id long, start long, n_tokens long, ids binary")


def dump(shards: DataFrame, folder: str) -> list[str]:
    """Plain files of the shard images, one shard at a time through the driver; for a local folder."""
    out = []
    for row in shards.orderBy("part", "seq").toLocalIterator():
        file = Path(folder, f"{row.part:06d}-{row.seq:06d}.pfor")
        file.write_bytes(bytes(row.image))
        out.append(str(file))
    return out
