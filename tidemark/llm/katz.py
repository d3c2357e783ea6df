"""Katz backoff scoring: Good-Turing discounted word bigrams over unigrams, exactly normalised.

The events are the training words and the end of a text, and one event for all words never seen. Every training
word has bigrams of its own, as context and as continuation:

    P(w | h) = d(c) c(h, w) / c(h)         if the bigram was seen,
               alpha(h) P(w)               otherwise.

alpha(h) gives the unseen events exactly what discounting left.

Work is done by blocks of documents: a block sends each distinct word, or bigram, once to the table partition
that owns it, with its count in the block's training documents; so a word that is everywhere costs one entry
for each block. The partition adds the counts up, writes its part of the table, and answers with the totals. A
block's answers meet its tokens again by the block's number, and every token is evaluated. Counts cover all
training documents.

Words have numbers in bigrams. The ``vocabulary`` most frequent ones are numbered by the driver, which sends their
probabilities to all tasks. Each other word is numbered by the partition that owns it, and its count goes along
with its bigrams; so no task holds a table of all words.

Edge cases: a null or empty text is its end alone; without training documents every token has probability 1;
repeated rows are scored, and learned from, each; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, forget, shuffle_parts, written

START, END, OTHER, FIRST = 0, 1, 2, 3


@dataclass(frozen=True)
class Katz:
    #: Numbers that the driver gives out: to the start, the end, words never seen, and the most frequent words.
    vocabulary: int = 65_536
    #: Continuations in a row of the model; a context with more has several rows.
    row: int = 65_536
    #: Counts up to this are discounted.
    discounted: int = 5
    #: Bytes of text after which a block is closed, at the end of a document.
    block: int = 8_000_000
    #: Table partitions for each shuffle partition.
    spread: int = 3


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def _expand(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = len(self)
        return len(self) - 1


def tokenised(docs: DataFrame, held_out: Column, how: Katz) -> DataFrame:
    """Blocks: (block, words, tokens, docs, lens, held). ``tokens`` number the block's ``words``; ends are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, docs_, lens, held, size = _Ids(), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_pydict({"block": [number], "words": [_zip(b" ".join(ids))], "tokens": [_squeeze(tokens)], "docs": [docs_], "lens": [lens], "held": [held]}, schema=_BLOCKS)

        for batch in batches:
            for doc, text, out in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.lower().split()
                parts.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
                docs_.append(doc), lens.append(len(words)), held.append(out)
                size += len(text)
                if size >= how.block:
                    yield block()
                    number += 1
                    ids, parts, docs_, lens, held, size = _Ids(), [], [], [], [], 0
        if docs_:
            yield block()

    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False))).mapInArrow(run, "block long, words binary, tokens binary, docs array<long>, lens array<int>, held array<boolean>")


_BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_()))])


@dataclass
class Block:
    """What a row of ``tokenised`` holds."""

    words: list[bytes]
    tokens: np.ndarray
    docs: list
    lens: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, words: bytes, tokens: bytes, docs: list, lens: list, held: list) -> Block:
        return cls(_unzip(words).split(), _expand(tokens, np.uint32), docs, np.asarray(lens, np.int64), np.asarray(held, bool))

    def owners(self, parts: int) -> np.ndarray:
        """The unigram partition of each word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in self.words), np.int64, len(self.words))

    def classes(self, known: dict[bytes, int]) -> np.ndarray:
        return np.fromiter((known.get(w, OTHER) for w in self.words), np.int64, len(self.words))

    def training(self) -> np.ndarray:
        """Which tokens belong to training documents."""
        return np.repeat(~self.held, self.lens)


def bigrams(numbers: np.ndarray, tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each position, ends included; the document of each), from the numbers of the block's words."""
    ends = np.cumsum(lens + 1) - 1
    to = np.empty(len(tokens) + len(lens), np.uint64)
    inner = np.ones(len(to), bool)
    inner[ends] = False
    to[inner] = numbers[tokens]
    to[ends] = END
    before = np.empty_like(to)
    before[1:] = to[:-1]
    before[ends - lens] = START
    return before << np.uint64(32) | to, np.repeat(np.arange(len(lens)), lens + 1)


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, continuations) of codes."""
    return (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes: steps of the contexts, and of the continuations inside each."""
    context, to = _split(codes)
    step = np.diff(context, prepend=0)
    within = np.concatenate([[False], step[1:] == 0])
    to[within] -= to[np.flatnonzero(within) - 1].copy()
    return _squeeze(step.astype(np.uint32)), _squeeze(to.astype(np.uint32))


def _unpack(steps: bytes, to: bytes) -> np.ndarray:
    step, to = _expand(steps, np.uint32).astype(np.int64), np.cumsum(_expand(to, np.uint32), dtype=np.int64)
    new = step > 0
    new[0] = True
    at = np.flatnonzero(new)
    base = np.concatenate([[0], to[at[1:] - 1]])
    return (np.cumsum(step) << 32 | (to - base[np.cumsum(new) - 1])).astype(np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in range(batch.num_columns))


def word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows of two kinds: ``model`` (word, c), one for each word; ``answer`` (block, part, data, ranks), what a block asked for.

    An answer has the words' totals and their ranks by total in the partition.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *fields in _rows(batches):
            b = Block.of(*fields)
            count = np.bincount(b.tokens[b.training()], minlength=len(b.words)).astype(np.uint32)
            owner = b.owners(parts)
            for p in range(parts):
                at = np.flatnonzero(owner == p)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([number]), pa.array([_zip(b" ".join([b.words[k] for k in at]))]), pa.array([_squeeze(count[at])])], names=["part", "block", "words", "counts"])

    def add(table: pa.Table) -> pa.Table:
        ids, told, part = _Ids(), [], table.column("part")[0].as_py()
        for number, words, counts in zip(table.column("block").to_pylist(), table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            at = np.fromiter(map(ids.__getitem__, _unzip(words).split()), np.int64)
            told.append((number, at, _expand(counts, np.uint32)))
        total = np.zeros(len(ids), np.uint64)
        for _, at, counts in told:
            total[at] += counts
        rank = np.empty(len(ids), np.uint32)
        rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(ids), dtype=np.uint32)
        kinds = ["model"] * len(ids) + ["answer"] * len(told)
        return pa.table(
            {
                "kind": kinds, "part": pa.array([part] * len(kinds), pa.int32()), "block": pa.array([None] * len(ids) + [n for n, _, _ in told], pa.int64()),
                "word": pa.array([*ids, *[None] * len(told)], pa.binary()), "c": pa.array([*total.tolist(), *[None] * len(told)], pa.int64()),
                "data": pa.array([None] * len(ids) + [_squeeze(total[at]) for _, at, _ in told], pa.binary()),
                "ranks": pa.array([None] * len(ids) + [_squeeze(rank[at]) for _, at, _ in told], pa.binary()),
            }
        )

    asked = blocks.mapInArrow(ask, "part int, block long, words binary, counts binary")
    return asked.groupBy("part").applyInArrow(add, "kind string, part int, block long, word binary, c long, data binary, ranks binary")


def discounts(n: list[int], k: int) -> np.ndarray:
    """Good-Turing discount of each count up to ``k``, from ``n[r]``, how many events have count r; 1 at 0.

    Where the counts of counts give none between 0 and 1, half an event is taken off.
    """
    out = np.ones(k + 1)
    whole = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - whole) / (1 - whole) if n[r] and whole < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.float64)
    small = c < len(d)
    return np.where(small, c * d[np.where(small, c, 0).astype(np.int64)], c)


@dataclass
class Unigrams:
    """N and V, the discounts, what is left for the unseen, the most frequent words' numbers and probabilities."""

    n: int
    v: int
    ends: int
    d: np.ndarray
    scale: float
    unseen: float
    known: dict[bytes, int]
    p: np.ndarray

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of an event with training count c, above 0."""
        return discounted(c, self.d) * self.scale


def unigrams(table: DataFrame, ends: int, how: Katz) -> Unigrams:
    """From the table (word, c) and the number of training documents; the driver gets the most frequent words and a few counts."""
    k = how.discounted
    seen = table.where("c > 0")
    sums = seen.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, k + 2)], *[F.sum(F.when(F.col("c") == r, F.col("c"))).alias(f"s{r}") for r in range(1, k + 1)]).first()
    n, v = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    counts = [0] + [int(sums[f"n{r}"] or 0) + (ends == r) for r in range(1, k + 2)]
    d = discounts(counts, k)
    used = n - sum((1 - d[r]) * r * counts[r] for r in range(1, k + 1))
    top = seen.orderBy(F.desc("c"), "word").limit(how.vocabulary - FIRST).select("word", "c").collect()
    known = {bytes(r["word"]): FIRST + i for i, r in enumerate(top)}
    # if nothing was discounted, one event's worth is set aside for the unseen
    whole = n if used < n else n + 1
    scale = 1 / whole if n else 0.0
    p = np.zeros(FIRST + len(top))
    p[FIRST:] = discounted(np.array([r["c"] for r in top], np.float64), d) * scale
    p[END] = discounted(np.array([ends]), d)[0] * scale
    p[OTHER] = max(0.0, 1 - p.sum())
    unseen = 1 - used * scale
    return Unigrams(n, v, ends, d, scale, unseen, known, p)


def numbered(blocks: DataFrame, answers: DataFrame, model: Unigrams, how: Katz, parts: int) -> DataFrame:
    """Blocks (block, numbers, totals, tokens, docs, lens, held): the number and training count of each word instead of the word."""
    known = model.known

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _NUMBERED.empty_table()
        kept = [block.column(c)[0].as_py() for c in ("words", "tokens", "docs", "lens", "held")]
        b = Block.of(*kept)
        owner, count, rank = b.owners(parts), np.zeros(len(b.words), np.uint64), np.zeros(len(b.words), np.int64)
        for p, data, ranks in zip(*(answers.column(c).to_pylist() for c in ("part", "data", "ranks")), strict=True):
            count[owner == p], rank[owner == p] = _expand(data, np.uint64), _expand(ranks, np.uint32)
        own = np.where(count > 0, how.vocabulary + rank * parts + owner, OTHER)
        if len(own) and own.max() >= 1 << 32:
            raise ValueError("more words than numbers of 32 bits")
        numbers = np.fromiter((known.get(w, x) for w, x in zip(b.words, own.tolist(), strict=True)), np.uint32, len(own))
        return pa.table([pa.array([x], f.type) for x, f in zip([block.column("block")[0].as_py(), _squeeze(numbers), _squeeze(count), *kept[1:]], _NUMBERED, strict=True)], schema=_NUMBERED)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "block long, numbers binary, totals binary, tokens binary, docs array<long>, lens array<int>, held array<boolean>")


_NUMBERED = pa.schema([_BLOCKS.field("block"), ("numbers", pa.binary()), ("totals", pa.binary()), *list(_BLOCKS)[2:]])


def bigram_counts(blocks: DataFrame, model: Unigrams, how: Katz, parts: int) -> DataFrame:
    """Rows of three kinds: ``model`` (context, words, counts), ``counts`` (counts of counts), ``answer`` (block, part, data, facts, lower).

    An answer has the counts of the block's bigrams, in order, and for each of its contexts the total, how many
    continuations were seen once, twice, ..., and their unigram probability together. In blocks that are not
    ``numbered`` all words but the most frequent are one.
    """
    k, p, known, by_number = how.discounted, model.p, model.known, "numbers" in blocks.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *fields in _rows(batches):
            if by_number:
                numbers, total, tokens = (_expand(x, kind) for x, kind in zip(fields[:3], (np.uint32, np.uint64, np.uint32), strict=True))
                lens, held = np.asarray(fields[4], np.int64), np.asarray(fields[5], bool)
            else:
                b = Block.of(*fields)
                numbers, total, tokens, lens, held = b.classes(known), np.zeros(len(b.words), np.uint64), b.tokens, b.lens, b.held
            code, doc = bigrams(numbers, tokens, lens)
            codes, at = np.unique(code, return_inverse=True)
            count = np.bincount(at[~held[doc]], minlength=len(codes)).astype(np.uint32)
            context, to = _split(codes)
            rare = to >= how.vocabulary
            order = np.argsort(numbers, kind="stable")
            totals = np.zeros(len(codes), np.uint64)
            totals[rare] = total[order[np.searchsorted(numbers[order], to[rare])]]
            owner = context % parts
            for part in range(parts):
                own = np.flatnonzero(owner == part)
                if len(own):
                    data = [*_pack(codes[own]), _squeeze(count[own]), _squeeze(totals[own[rare[own]]])]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number]), *[pa.array([x]) for x in data]], names=["part", "block", "steps", "to", "counts", "totals"])

    def add(table: pa.Table) -> pa.Table:
        part, numbers = table.column("part")[0].as_py(), table.column("block").to_pylist()
        asked = [_unpack(x, y) for x, y in zip(table.column("steps").to_pylist(), table.column("to").to_pylist(), strict=True)]
        codes, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_expand(x, np.uint32) for x in table.column("counts").to_pylist()]), minlength=len(codes)).astype(np.int64)
        context, to = _split(codes)
        rare = to >= how.vocabulary
        weight = np.zeros(len(codes))
        weight[~rare] = p[to[~rare]]
        weight[at[rare[at]]] = model.probability(np.concatenate([_expand(x, np.uint64) for x in table.column("totals").to_pylist()]))
        contexts, first = np.unique(context, return_index=True)
        group = np.searchsorted(contexts, context)
        seen = total > 0
        facts = np.zeros((len(contexts), k + 1), np.uint64)
        facts[:, 0] = np.bincount(group, weights=total, minlength=len(contexts))
        for r in range(1, k + 1):
            facts[:, r] = np.bincount(group[total == r], minlength=len(contexts))
        lower = np.bincount(group[seen], weights=weight[seen], minlength=len(contexts))
        rows: list[tuple] = []
        for x, a, b in zip(contexts.tolist(), first.tolist(), [*first[1:].tolist(), len(codes)], strict=True):
            every = np.arange(a, b)[seen[a:b]]
            for j in range(0, len(every), how.row):
                own = every[j : j + how.row]
                rows.append(("model", part, None, x, to[own].tolist(), total[own].tolist(), None, None, None))
        rows.append(("counts", part, None, None, None, [int((total == r).sum()) for r in range(k + 2)], None, None, None))
        place = 0
        for number, own in zip(numbers, asked, strict=True):
            here = at[place : place + len(own)]
            place += len(own)
            mine = np.unique(group[here])
            rows.append(("answer", part, number, None, None, None, _squeeze(total[here].astype(np.uint64)), _squeeze(facts[mine].T.reshape(-1)), _squeeze(lower[mine])))
        names = ["kind", "part", "block", "context", "words", "counts", "data", "facts", "lower"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    asked = blocks.mapInArrow(ask, "part int, block long, steps binary, to binary, counts binary, totals binary")
    return asked.groupBy("part").applyInArrow(add, "kind string, part int, block long, context long, words array<long>, counts array<long>, data binary, facts binary, lower binary")


def backoff(facts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what a discounted count is multiplied with, alpha) of each context, from its facts.

    If nothing was discounted, one event's worth is set aside; if no event is left unseen, nothing is.
    """
    k = len(d) - 1
    total, once, lower = facts[:, 0], facts[:, 1 : k + 1], facts[:, k + 1]
    used = total - (once * (1 - d[1:]) * np.arange(1, k + 1)).sum(axis=1)
    rest = 1 - lower
    closed = rest < 1e-12
    whole = np.where(closed, used, np.where(used < total, total, total + 1))
    whole = np.maximum(whole, 1e-300)
    none = total == 0
    alpha = np.where(closed, 0.0, (1 - used / whole) / np.where(closed, 1.0, rest))
    return np.where(none, 0.0, 1 / whole), np.where(none, 1.0, alpha)


def score(docs: DataFrame, held_out: Column, how: Katz = Katz()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``base_score`` is that of unigrams with one added to each count.
    """
    parts = how.spread * shuffle_parts(docs.sparkSession)
    blocks = written(tokenised(docs, held_out, how), "blocks")
    words = written(word_counts(blocks.select("block", "words", "tokens", "docs", "lens", "held"), parts), "words", ["kind"])
    ends = int(blocks.select(F.size(F.filter("held", lambda x: ~x)).alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0)
    uni = unigrams(words.where("kind = 'model'"), ends, how)
    named = written(numbered(blocks, words.where("kind = 'answer'").select("block", "part", "data", "ranks"), uni, how, parts), "numbered")
    forget(blocks, words)
    pairs = written(bigram_counts(named, uni, how, parts), "bigrams", ["kind"])
    k = how.discounted
    sums = pairs.where("kind = 'counts'").agg(*[F.sum(F.get("counts", F.lit(r))).alias(f"n{r}") for r in range(1, k + 2)]).first()
    d2 = discounts([0] + [int(sums[f"n{r}"] or 0) for r in range(1, k + 2)], k)

    def evaluate(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        numbers, count, tokens = (_expand(block.column(c)[0].as_py(), t) for c, t in (("numbers", np.uint32), ("totals", np.uint64), ("tokens", np.uint32)))
        docs, held = block.column("docs")[0].as_py(), block.column("held")[0].as_py()
        lens, count = np.asarray(block.column("lens")[0].as_py(), np.int64), count.astype(np.float64)
        told = {p: x for p, *x in zip(*(answers.column(c).to_pylist() for c in ("part", "data", "facts", "lower")), strict=True)}
        own = np.where(count > 0, uni.probability(count), uni.unseen) if uni.n else np.ones(len(count))
        code, doc = bigrams(numbers, tokens, lens)
        ends_at = np.cumsum(lens + 1) - 1
        inner = np.ones(len(code), bool)
        inner[ends_at] = False
        alone, c = np.empty(len(code)), np.empty(len(code))
        alone[inner], alone[ends_at] = own[tokens], uni.p[END]
        c[inner], c[ends_at] = count[tokens], uni.ends
        codes, first, at = np.unique(code, return_index=True, return_inverse=True)
        context, _ = _split(codes)
        part = context % parts
        seen, factor, alpha = np.zeros(len(codes)), np.zeros(len(codes)), np.ones(len(codes))
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            data, facts, lower = told[p]
            contexts, here = np.unique(context[mine], return_inverse=True)
            f, a = backoff(np.column_stack([_expand(facts, np.uint64).reshape(k + 1, len(contexts)).T.astype(np.float64), _expand(lower, np.float64)]), d2)
            seen[mine], factor[mine], alpha[mine] = _expand(data, np.uint64), f[here], a[here]
        # recursion: a seen bigram, else the unigram by the context's weight
        prob = np.where(seen > 0, discounted(seen, d2) * factor, alpha * alone[first]) if uni.n else np.ones(len(codes))
        logs = np.log10(np.maximum(prob, 1e-300))[at]
        base = np.log10((c + 1) / (uni.n + uni.v + 1))
        n = len(lens)
        summed = lambda x: np.bincount(doc, weights=x, minlength=n)
        values = [docs, held, lens + 1, summed(c > 0).astype(np.int64), np.full(n, uni.n), summed(base), summed(logs)]
        return pa.table([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=names)

    answers = pairs.where("kind = 'answer'").select("block", "part", "data", "facts", "lower")
    return named.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
