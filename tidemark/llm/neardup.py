"""Near duplicates: banded MinHash, sequential Bayesian pruning, exact verification, components.

1. One pass makes each document's set of word shingles, its size, a key of the whole set, the keys of its
   bands and one byte of each of its MinHashes. Equal sets are one class, held by its smallest id.
2. Classes that share a band are candidates. A bucket's head is its smallest id. Each class is first compared
   with the head that it shares most bands with: one pair for a class, however large the bucket is.
3. A pair's signatures are compared in batches. After each, the pair is dropped if the posterior probability
   that its similarity reaches the threshold is below the chosen miss probability.
4. What is left is verified on the full sets, and components are drawn.
5. Buckets that still hold several components are compared across them: the members outside a bucket's largest
   component against all, in blocks. A first pass compares signatures alone and names the members with a pair
   that is not dropped. A second pass brings those members' full sets to their blocks and verifies there. A
   block gives out only links that join what its verified links have not joined yet, so at most one for each
   of its members, however many pairs it tests. A pair that shares several bands is tested in the first of them.

So no candidate pair goes untested unless verified links join its ends already. The bands miss a pair at the
threshold with a probability of (1 - 0.8^4)^24, or 3 in a million.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing; one with fewer
words than a shingle has its whole sequence as one; repeated texts are one class; repeated ids give repeated
rows, and texts of one id are linked with each other; a row with a null id has a null component and is kept,
and nothing is linked through it; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, counted, shuffle_parts, slices, written
from tidemark.llm.components import components


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 24
    rows: int = 4
    hashes: int = 128
    batch: int = 32
    miss: float = 1e-6
    #: Members of a bucket compared at a time; long documents count as several.
    block: int = 1024
    long: int = 2048
    #: Pairs of one member verified at a time, those with most matches first.
    chunk: int = 32
    #: Documents verified against one head in a task's group.
    salted: int = 500
    #: Bytes up to which a table of pairs is sent to all executors; larger ones are joined by exchange.
    broadcast: int = 32 << 20
    seed: int = 7


_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; A to Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    key = np.full(n, width * 0x1000193, np.uint64)
    for k in range(width):
        key = (key ^ h[k : k + n]) * _MIX
        key ^= key >> np.uint64(32)
    return np.unique(key)


@lru_cache(4)
def _multipliers(how: NearDup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    return rng.integers(0, 1 << 63, how.hashes, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, how.hashes, np.uint64)


def minhashes(keys: np.ndarray, how: NearDup) -> np.ndarray:
    """32 high bits of the least value of each hash function."""
    a, b = _multipliers(how)
    low = np.full(how.hashes, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(keys), 512):
        low = np.minimum(low, (keys[k : k + 512, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache(4)
def least_matches(how: NearDup) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is dropped).

    Signatures hold one byte of each hash, so hashes of different values match once in 256. The similarity's
    prior is uniform.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    q = s + (1 - s) / 256
    over = s >= how.percent / 100
    out = []
    for n in range(how.batch, how.hashes + 1, how.batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(q) + (n - m) * np.log1p(-q)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        tail = p[:, over].sum(axis=1) / p.sum(axis=1)
        out.append((n, int(np.argmax(tail >= how.miss))))
    return out


def surviving(a: np.ndarray, b: np.ndarray, how: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """(rows that no batch drops, their matches) of two arrays of signatures, row by row."""
    left, done, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in least_matches(how):
        matches = matches + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], n
    return left, matches


def profiles(docs: DataFrame, how: NearDup) -> DataFrame:
    """(doc_id, n, key, bands, sig) of every document; bands and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, key, bands, sig = [], [], [], []
            for text in as_bytes(batch.column(1)):
                own = shingles(text, how.shingle)
                n.append(len(own))
                if not len(own):
                    key.append(None), bands.append(None), sig.append(None)
                    continue
                low = minhashes(own, how)
                band = np.zeros(how.bands, np.uint64)
                for r in range(how.rows):
                    band = (band ^ low[r : how.bands * how.rows : how.rows].astype(np.uint64)) * _MIX
                    band ^= band >> np.uint64(31)
                band = (band + np.arange(how.bands, dtype=np.uint64)) * _MIX
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(band.view(np.int64).tolist())
                sig.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "n", "key", "bands", "sig"])
        _HASHES.clear()  # a worker that goes on to other stages keeps no words

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, sig binary")


def fits(df: DataFrame, limit: int) -> bool:
    """Whether a written table is at most so large on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def pruned(pairs: DataFrame, sigs: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, how.hashes) for k in (2, 3))
            keep = pa.array(surviving(left, right, how)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes(F.col("n_a"), F.col("n_b"), how))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sizes(n, m, how: NearDup):
    """Sets so unlike in size can't be linked."""
    return 100 * F.least(n, m) >= how.percent * F.greatest(n, m)


def verified(pairs: DataFrame, docs: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets.

    ``b``'s text is brought to the texts of its ``a``'s, which a very common ``b`` meets in several groups.
    """
    pairs = written(pairs.distinct(), "pairs")
    texts = docs.select("doc_id", "text")
    near = F.broadcast if fits(pairs, how.broadcast) else (lambda df: df)
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / how.salted).cast("int").alias("salts"))
    tail = texts.join(near(pairs.join(groups, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))), "doc_id")
    head = texts.join(near(groups.select(F.col("b").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))), "doc_id")
    rows = tail.select("b", "salt", F.col("doc_id").alias("a"), "text").unionByName(head.select(F.col("doc_id").alias("b"), "salt", F.lit(None).cast("long").alias("a"), "text"))
    rows = rows.repartition(shuffle_parts(docs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for b, salt, a, text in zip(*(batch.column(k).to_pylist() for k in range(3)), as_bytes(batch.column(3)), strict=True):
                if a is None:
                    current, own = (b, salt), shingles(text, how.shingle)
                    continue
                if current != (b, salt):
                    raise ValueError("a pair without its text")
                other = shingles(text, how.shingle)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= how.percent * (len(own) + len(other) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("b", "salt", "a", "text").mapInArrow(run, "a long, b long")


def common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of ``own``'s hashes each of the others holds; all sorted and distinct, none empty."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    starts = np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]])
    return np.add.reduceat((own[at] == flat).astype(np.int64), starts)


class _Block:
    """Members of one block of one bucket: ``rest`` to be compared with, ``ask`` that ask. Rows as ``_compared`` deals them."""

    def __init__(self, rows: list[tuple], how: NearDup):
        self.how, self.band = how, rows[0][0]
        self.rest, self.ask = [r for r in rows if not r[3]], [r for r in rows if r[3]]
        column = lambda k, kind=np.int64: np.array([r[k] for r in self.rest], kind)
        self.doc, self.component, self.minor, self.n = column(4), column(5), column(6, bool), column(7)
        self.sig = np.frombuffer(b"".join(r[8] for r in self.rest), np.uint8).reshape(-1, how.hashes)
        self.bands = np.array([r[9] for r in self.rest], np.int64).reshape(-1, how.bands)

    def candidates(self, x: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``rest``, matches) of the pairs of one asker that this block has to test."""
        how = self.how
        # of two askers the one with the larger id asks
        ok = np.flatnonzero((self.component != x[5]) & (100 * np.minimum(self.n, x[7]) >= how.percent * np.maximum(self.n, x[7])) & ~(self.minor & (self.doc > x[4])))
        left, matches = surviving(self.sig[ok], np.broadcast_to(np.frombuffer(x[8], np.uint8), (len(ok), how.hashes)), how)
        ok, own = ok[left], np.array(x[9], np.int64)
        before = int(np.flatnonzero(own == self.band)[0])
        first = ~(self.bands[ok, :before] == own[:before]).any(axis=1)
        return ok[first], matches[first]

    def marked(self) -> set[int]:
        """Members with a pair to be verified."""
        out: set[int] = set()
        for x in self.ask if self.rest else ():
            at, _ = self.candidates(x)
            if len(at):
                out.add(x[4])
                out.update(self.doc[at].tolist())
        return out

    def links(self) -> list[tuple[int, int]]:
        """Verified links between components that no earlier ones have joined."""
        sets = [np.frombuffer(r[10], np.uint64) for r in self.rest]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for x in self.ask if self.rest else ():
            at, matches = self.candidates(x)
            at, own = at[np.argsort(-matches, kind="stable")].tolist(), np.frombuffer(x[10], np.uint64)
            while at:
                at = [k for k in at if find(int(self.component[k])) != find(x[5])]
                some, at = at[: self.how.chunk], at[self.how.chunk :]
                for k, shared in zip(some, common(own, [sets[k] for k in some]) if some else (), strict=True):
                    p, q = find(int(self.component[k])), find(x[5])
                    if p != q and 100 * shared >= self.how.percent * (len(own) + len(sets[k]) - shared):
                        root[p] = q
                        out.append((max(x[4], int(self.doc[k])), min(x[4], int(self.doc[k]))))
        return out


def _compared(members: DataFrame, how: NearDup) -> DataFrame:
    """Deals members (band, doc_id, component, minor, n, sig, bands, perhaps set) to blocks. Without sets: marks (band, doc_id). With sets: links (a, b)."""
    full = "set" in members.columns
    weight = 1 + F.col("n") / how.long
    sizes = members.groupBy("band").agg(F.ceil(F.sum(weight) / how.block).cast("int").alias("nb"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("minor"), weight)) / how.block).cast("int")).alias("nq"))
    told, hashed = members.join(sizes, "band"), F.xxhash64("doc_id", F.lit(1))
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    carried = ["doc_id", "component", "minor", "n", "sig", "bands", *["set"] * full]
    rest = told.select("band", to(F.col("nq")).alias("q"), F.pmod(hashed, F.col("nb")).cast("int").alias("c"), F.lit(0).alias("asks"), *carried)
    asks = told.where("minor").select("band", F.pmod(hashed, F.col("nq")).cast("int").alias("q"), to(F.col("nb")).alias("c"), F.lit(1).alias("asks"), *carried)
    rows = rest.unionByName(asks).repartition(shuffle_parts(members.sparkSession), "band", "q", "c").sortWithinPartitions("band", "q", "c", "asks", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: list[tuple]) -> list[tuple[int, int]]:
            if not block:
                return []
            own = _Block(block, how)
            return own.links() if full else [(own.band, doc) for doc in sorted(own.marked())]

        give = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["x", "y"])
        key, block = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if row[:3] != key:
                    out += told(block)
                    key, block = row[:3], []
                block.append(row)
            yield give(out)
        yield give(told(block))

    return rows.mapInArrow(run, "x long, y long").toDF(*(("a", "b") if full else ("band", "doc_id")))


def _across(buckets: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, how: NearDup) -> DataFrame | None:
    """Verified links (a, b) that join the components in each bucket; None if no bucket holds several components or no pair stands."""
    told = written(buckets.join(labels, F.col("doc_id") == F.col("id"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "told")
    parts = told.groupBy("band", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("top")).where("parts > 1").select("band", F.col("top.component").alias("top"))
    members = told.join(mixed, "band").join(reps, "doc_id").select("band", "doc_id", "component", (F.col("component") != F.col("top")).alias("minor"), "n", "sig", "bands")
    members, many = counted(members, "members")
    if not many:
        return None
    marks, many = counted(_compared(members, how).distinct(), "marks")
    if not many:
        return None
    named = written(marks.select("doc_id").distinct(), "named")
    near = F.broadcast if fits(named, how.broadcast) else (lambda df: df)
    sets = docs.select("doc_id", "text").join(near(named), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text, how.shingle) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["doc_id", "n", "set"])

    sets = written(sets.mapInArrow(run, "doc_id long, n long, set binary").dropDuplicates(["doc_id", "n"]), "sets")
    return _compared(members.join(marks, ["band", "doc_id"]).join(sets, ["doc_id", "n"]), how)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) after further links (a, b)."""
    own = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    drawn = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = components(drawn).select(F.col("id").alias("component"), F.col("component").alias("last"))
    # ids that had no link before name themselves
    every = labels.unionByName(drawn.select(F.explode(F.array("a", "b")).alias("id")).withColumn("component", F.col("id")))
    return every.join(over, "component", "left").groupBy("id").agg(F.min(F.coalesce("last", "component")).alias("component"))


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; the smallest id of a component is kept."""
    all_docs, many = counted(profiles(docs, how), "profiles")
    classes = written(all_docs.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # sets that many documents share are few, so they are sent to all tasks; those of all others are exchanged
    hot = F.broadcast(classes.where(F.col("copies") > many / (8 * shuffle_parts(docs.sparkSession))).select("key", "rep"))  # fewer than 8 for each partition
    plain = all_docs.select("doc_id", "n", "key")
    member = plain.join(hot, "key").unionByName(plain.join(hot, "key", "left_anti").join(classes.select("key", "rep"), "key", "left"))
    firsts = all_docs.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).dropDuplicates(["key"])
    reps = written(firsts.select("doc_id", "n", "bands", "sig"), "reps")
    bands = reps.select(F.explode("bands").alias("band"), "doc_id")
    heads = written(bands.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m"), "heads")
    buckets = written(bands.join(heads, "band"), "buckets")
    shared = buckets.where("doc_id != head").groupBy("doc_id", "head").agg(F.count("*").alias("m"))
    first = shared.groupBy("doc_id").agg(F.max(F.struct("m", -F.col("head"))).alias("best")).select(F.col("doc_id").alias("a"), (-F.col("best.col2")).alias("b"))
    labels = written(components(verified(pruned(first, reps.select("doc_id", "n", "sig"), how), docs, how)), "labels")
    across = _across(buckets.select("band", "doc_id"), labels, reps, docs, how)
    if across is not None:
        more, found = counted(across.distinct(), "across")
        if found:
            labels = written(_joined(labels, more), "labels")
    out = member.join(labels, member["rep"] == labels["id"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
