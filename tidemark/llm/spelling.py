"""Spelling variants: near words found with k-d trees over letter-count vectors, and the frequent form of each word.

Two words are near if one inserted, deleted or replaced letter makes one of the other. Such an edit moves a word's
vector of letter counts by an L1 distance of two at most: a replaced letter takes one down and one up, an inserted one
takes one up. So each word needs a search in a small box around its vector, among words of its own length and of the
next one.

Vectors are held in unary: for each letter one bit for each count up to ``PLANES``; capital and small accented letters
share a coordinate. That only shortens distances, so no near word is missed, and the L1 distance of vectors, or of a
vector and a box, is a count of bits. A node of a tree halves its words at one coordinate; its box is pruned where more
letters than the edit allows have to go up, or down, to reach it. What is left is verified letter by letter.

Words of a length are dealt to cells by the top of their tree, which the driver fits to a bounded sample of words; the
boxes of cells follow from its splits, so every word has a cell, whatever the sample. A word goes to its cell as a
point, and as a query to the other cells that its search reaches: of two cells, from the lower to the higher one,
so each pair is met once. A cell is one task's tree. Pairs never leave it: it gives each word's number of near words and
the best of them.

Edge cases: null and empty texts have no words; a null id is the empty text in what the noise is drawn from; repeated
rows count each; of near words with the same n the smaller in code-point order is the form; words with the same letters
share a leaf, which is searched in blocks; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted, written

#: Counts of a letter that are told apart; higher ones are as this.
PLANES = 3
#: Coordinates: a to z, and the letters from U+00C0 on by their place in half of that block.
_COORDINATE = np.zeros(256, np.uint64)
_COORDINATE[[ord(c) for c in ascii_lowercase]] = np.arange(26)
_COORDINATE[0xC0:] = 26 + np.arange(64) % 32
_BIT = np.uint64(1) << _COORDINATE
#: Pairs of a leaf that are compared at once.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Spelling:
    #: Code points that a word has at least.
    min_chars: int = 7
    #: Occurrences of a word, at least.
    min_n: int = 2
    #: How many times more frequent than the word its form is, at least.
    ratio: int = 10
    #: Words of one length that share a cell, about. More where the sample is too small to part them.
    cell: int = 12_000
    #: Words that the driver fits the tops of the trees to, at most; and that it needs for each cell.
    sample: int = 400_000
    sample_of_cell: int = 32
    #: Words in a leaf of a cell's tree.
    leaf: int = 64


def word_counts(docs: DataFrame, how: Spelling = Spelling(), noise: int | None = None) -> DataFrame:  # noqa: B008
    """(word, n) of the words that occur often enough. With ``noise``, about one of so many runs loses a letter."""
    run = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z\u00C0-\u00FF]{%d,}" % how.min_chars), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("word"))
    if noise:
        size, h = F.length("word"), F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word"))
        at = (h % size).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))
        runs = runs.select(F.when(h % noise == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= how.min_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.min_n)


def letters(words: list[str], size: int) -> np.ndarray:
    """The words' letters, as a row each. A letter's code point is its byte in Latin-1."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, size)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Unary letter counts: planes × words, bit c of plane k set where coordinate c counts more than k."""
    planes = np.zeros((PLANES, len(rows)), np.uint64)
    for column in rows.T:
        bit = _BIT[column]
        for k in range(PLANES - 1, 0, -1):
            planes[k] |= planes[k - 1] & bit
        planes[0] |= bit
    return planes


def more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many more letters vectors ``a`` count than ``b``, over the coordinates where they count more."""
    out = np.bitwise_count(a[0] & ~b[0])
    for k in range(1, PLANES):
        out += np.bitwise_count(a[k] & ~b[k])  # at most 192, so bytes hold it
    return out


class Tree:
    """A k-d tree over unary vectors. ``tight``: nodes' boxes are those of their members, else what the splits leave."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: dict[int, np.ndarray] = {}
        every = np.full(PLANES, np.iinfo(np.uint64).max, np.uint64)
        self._grow(points, np.arange(points.shape[1]), leaf, tight, np.zeros(PLANES, np.uint64), every)
        #: Number of each leaf among the leaves.
        self.number = {node: k for k, node in enumerate(sorted(self.members))}

    def _grow(self, points: np.ndarray, members: np.ndarray, leaf: int, tight: bool, lo: np.ndarray, hi: np.ndarray) -> int:
        own = points[:, members]
        if tight:
            lo, hi = np.bitwise_and.reduce(own, axis=1), np.bitwise_or.reduce(own, axis=1)
        node = len(self.lo)
        self.lo.append(lo), self.hi.append(hi), self.children.append(None)
        if len(members) > leaf:
            ones = np.unpackbits(np.ascontiguousarray(own.T).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            at = int(np.argmin(np.abs(2 * ones - len(members))))
            if 0 < ones[at] < len(members):
                plane, bit = divmod(at, 64)
                has = (own[plane] >> np.uint64(bit)) & np.uint64(1) == 1
                up, down = lo.copy(), hi.copy()
                up[: plane + 1] |= np.uint64(1 << bit)  # as many of the letter at least
                down[plane:] &= ~np.uint64(1 << bit)  # fewer of it
                self.children[node] = self._grow(points, members[~has], leaf, tight, lo, down), self._grow(points, members[has], leaf, tight, up, hi)
                return node
        self.members[node] = members
        return node

    def search(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, the queries that reach its box by at most so many letters up and down)."""
        todo = [(0, np.arange(queries.shape[1]))]
        while todo:
            node, who = todo.pop()
            own = queries[:, who]
            who = who[(more(self.lo[node][:, None], own) <= up) & (more(own, self.hi[node][:, None]) <= down)]
            if len(who):
                if self.children[node]:
                    todo += [(child, who) for child in self.children[node]]
                else:
                    yield node, who


def near_pairs(tree: Tree, points: np.ndarray, rows: np.ndarray, q_points: np.ndarray, q_rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, points) that are near, by blocks. Queries are as long as the points, or one letter shorter."""
    same = q_rows.shape[1] == rows.shape[1]
    size = q_rows.shape[1]
    for leaf, who in tree.search(q_points, 1, int(same)):
        members = tree.members[leaf]
        step = max(1, _BLOCK // len(members))
        for k in range(0, len(who), step):
            part = who[k : k + step]
            p, q = points[:, None, members], q_points[:, part, None]
            close = (more(p, q) <= 1) & (more(q, p) <= int(same))
            at_q, at_p = np.nonzero(close)
            at_q, at_p = part[at_q], members[at_p]
            for j in range(0, len(at_q), _BLOCK):
                a, b = at_q[j : j + _BLOCK], at_p[j : j + _BLOCK]
                x, y = q_rows[a], rows[b]
                if same:
                    near = (x != y).sum(axis=1) == 1
                else:
                    head = np.logical_and.accumulate(x == y[:, :size], axis=1).sum(axis=1)
                    tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    near = head + tail >= size
                yield a[near], b[near]


POINT, SAME, SHORTER = 0, 1, 2


class Router:
    """The tops of the trees: by length, the cells that a word's search reaches."""

    def __init__(self, sizes: dict[int, int], sample: list[str], rate: int, how: Spelling):
        by_size: dict[int, list[str]] = {}
        for word in sample:
            by_size.setdefault(len(word), []).append(word)
        self.trees, self.first, total = {}, {}, 0
        for size in sorted(sizes):
            points = vectors(letters(by_size.get(size, []), size))
            self.trees[size] = Tree(points, max(how.cell // rate, how.sample_of_cell), tight=False)
            self.trees[size].members = dict.fromkeys(self.trees[size].members)
            self.first[size] = total
            total += len(self.trees[size].members)

    def cells(self, size: int, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        if size in self.trees:
            for leaf, who in self.trees[size].search(queries, up, down):
                yield self.first[size] + self.trees[size].number[leaf], who

    def deal(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, role, places of words) for words of any lengths."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            place = np.flatnonzero(sizes == size)
            q = vectors(letters([words[k] for k in place], size))
            home = np.zeros(len(place), np.int64)
            for cell, who in self.cells(size, q, 0, 0):
                home[who] = cell
                yield cell, POINT, place[who]
            for cell, who in self.cells(size, q, 1, 1):
                if len(higher := who[home[who] < cell]):
                    yield cell, SAME, place[higher]
            for cell, who in self.cells(size + 1, q, 1, 0):
                yield cell, SHORTER, place[who]


def router(words: DataFrame, how: Spelling) -> Router:
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = max(how.cell // how.sample_of_cell, -(-sum(sizes.values()) // how.sample), 1)
    parted = [size for size, n in sizes.items() if n > how.cell]
    # about sample words, at the rate; the limit holds however their hashes fall
    sample = words.where(F.length("word").isin(parted) & (F.pmod(F.xxhash64("word"), F.lit(rate)) == 0)).select("word").limit(2 * how.sample).collect() if parted else []
    return Router(sizes, sorted(r.word for r in sample), rate, how)


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search_cell(words: list[str], ns: list[int], roles: np.ndarray, how: Spelling) -> pa.Table:
    """Each word's number of near words in the cell, and the best of them."""
    n = np.asarray(ns, np.int64)
    at = [np.flatnonzero(roles == r) for r in (POINT, SAME, SHORTER)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(at[POINT]):
        rows = {r: letters([words[k] for k in at[r]], len(words[at[r][0]])) for r in (POINT, SAME, SHORTER) if len(at[r])}
        planes = {r: vectors(x) for r, x in rows.items()}
        tree = Tree(planes[POINT], how.leaf, tight=True)
        for role in rows:
            for q, p in near_pairs(tree, planes[POINT], rows[POINT], planes[role], rows[role]):
                if role == POINT:
                    q, p = q[q < p], p[q < p]
                found.append((at[role][q], at[POINT][p]))
    if not found:
        return _FOUND.empty_table()
    a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    who, first, times = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return pa.table({"word": [words[k] for k in who], "n_near": times, "best_n": n[best], "best": [words[k] for k in best]}, schema=_FOUND)


def near_words(words: DataFrame, how: Spelling = Spelling()) -> DataFrame:  # noqa: B008
    """(word, n_near, best_n, best) for each cell in which a word has near words."""
    tops = router(words, how)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_pylist()
            for cell, role, place in tops.deal(every):
                part = batch.take(pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), cell, np.int64)), pa.array(np.full(len(place), role, np.int32)), *part.columns], names=["cell", "role", "word", "n"])

    def search(table: pa.Table) -> pa.Table:
        return _search_cell(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("role").to_numpy(), how)

    dealt = words.select("word", "n").mapInArrow(deal, "cell long, role int, word string, n long")
    return dealt.groupBy("cell").applyInArrow(search, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the last of its chain of forms. A form has a larger n, so chains end.

    Each round joins every word's goal with that goal's own, so a chain of k forms needs log2(k) rounds.
    """
    goals, n = counted(forms.select("word", F.col("form").alias("root")), "forms")
    while n:
        further = goals.select(F.col("word").alias("root"), F.col("root").alias("further"))
        goals, _ = counted(goals.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        n = not goals.where("moved").isEmpty()
        goals = goals.drop("moved")
    return goals


def variants(words: DataFrame, how: Spelling = Spelling()) -> DataFrame:  # noqa: B008
    """(word, n, n_near, form, form_n, root) of each word of (word, n)."""
    found = near_words(words, how).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("best"))
    plain: Column = F.lit(None).cast("struct<less: bigint, best: string>")
    every = found.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), plain.alias("best")))
    every = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= how.ratio * F.col("n")
    every = written(every.select("word", "n", "n_near", F.when(has, F.col("best.best")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "near-words")
    last = roots(every.where("form is not null"))
    return every.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, how: Spelling = Spelling(), noise: int | None = None) -> DataFrame:  # noqa: B008
    """The words of the documents, grouped by spelling."""
    return variants(written(word_counts(docs, how, noise), "words"), how)
