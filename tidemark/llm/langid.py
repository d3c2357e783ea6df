"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is bound: its letters' vectors, each permuted once
for every place after it, are multiplied. A text bundles its n-grams: their vectors are added. A language's
prototype bundles the n-grams of all its training texts. A text gets the language whose prototype has the
largest cosine with it.

Bundling is a sum, so the prototypes of a whole corpus are made from n-gram counts that tasks count for
themselves and that are then summed by (language, n-gram): at most ``SYMBOLS ** N`` rows for a language.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing
could be learned; a row with a null id is learned from and not held out; ties go to the language first in order; repeated rows get equal results; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 0 parts words, 1 to 26 are a to z, the others share the remaining letters of all scripts.
SYMBOLS = 64
N = 3


@dataclass(frozen=True)
class Profile:
    dimensions: int = 1024
    seed: int = 20


_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of each code point, made once in a worker."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
                continue
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
        _TABLE.append(table)
    return _TABLE[0]


def _letters(how: Profile) -> list[np.ndarray]:
    """Letter vectors, permuted for each place of an n-gram."""
    rng = np.random.default_rng(how.seed)
    base = rng.integers(0, 2, (SYMBOLS, how.dimensions)).astype(np.int8) * 2 - 1
    order = rng.permutation(how.dimensions)
    out = [base]
    for _ in range(N - 1):
        out.append(out[-1][:, order])
    return out[::-1]


def ngram_vectors(codes: np.ndarray, letters: list[np.ndarray]) -> np.ndarray:
    """Bound vectors of coded n-grams, one a row."""
    out = letters[0][codes // SYMBOLS ** (N - 1)]
    for k in range(1, N):
        out = out * letters[k][codes // SYMBOLS ** (N - 1 - k) % SYMBOLS]
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, code) of every n-gram with a letter in its middle place; texts are parted by blanks."""
    joined = "\n\n" + "\n\n".join(texts) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    s = _symbols()[points].astype(np.int32)
    lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(s) - 2]
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    # the n-gram at position p has its middle at p + 1; text k begins at 2 + the lengths before it
    held = s[1:-1] > 0
    return np.concatenate([np.zeros(1, np.int32), owner])[: len(codes)][held], codes[held]


def _groups(texts: list[str], size: int, most: int) -> Iterator[slice]:
    k = 0
    while k < len(texts):
        n, total = k, 0
        while n < len(texts) and n - k < most and (n == k or total + len(texts[n]) <= size):
            total += len(texts[n])
            n += 1
        yield slice(k, n)
        k = n


def learn(docs: DataFrame, training: Column) -> DataFrame:
    """(lang, code, n): n-gram counts of the training rows with a language; all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = totals.setdefault(lang, np.zeros(SYMBOLS**N, np.int64))
                for part in _groups(own, 1_000_000, 10_000):
                    total += np.bincount(ngrams(own[part])[1], minlength=SYMBOLS**N)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "code", "n"])

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, how: Profile = Profile()) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one a row, of length 1.

    Prototypes are bundled on the executors; the driver gets one vector for each language and task.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letters(how), {}
        for batch in batches:
            langs, codes, n = np.asarray(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs):
                for at in np.array_split(np.flatnonzero(langs == lang), 1 + (langs == lang).sum() // 8192):
                    sums[lang] = sums.get(lang, 0) + n[at].astype(np.float64) @ ngram_vectors(codes[at], letters).astype(np.float32)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    places = counts.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    summed = places.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    found = sorted((r.lang, [p.x for p in r.v]) for r in summed.collect())
    out = np.array([v for _, v in found], np.float64).reshape(len(found), how.dimensions)
    return [x for x, _ in found], out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, langs: list[str], profile: np.ndarray, how: Profile = Profile()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is looked at. The score is the cosine, at least 0."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, wanted = _letters(how), profile.T.astype(np.float32)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for part in _groups(texts, 1_000_000, 256):
                owner, codes = ngrams(texts[part])
                if not len(codes) or not langs:
                    continue
                seen, at = np.unique(codes, return_inverse=True)
                rows = part.stop - part.start
                count = np.bincount(owner.astype(np.int64) * len(seen) + at, minlength=rows * len(seen)).reshape(rows, len(seen)).astype(np.float32)
                bundle = np.zeros((rows, how.dimensions), np.float32)
                for k in range(0, len(seen), 8192):
                    bundle += count[:, k : k + 8192] @ ngram_vectors(seen[k : k + 8192], letters).astype(np.float32)
                length = np.linalg.norm(bundle, axis=1)
                cosine = (bundle @ wanted) / np.maximum(length, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                some = count.sum(axis=1) > 0
                label[part] = np.where(some, np.asarray(langs, object)[best], "und")
                score[part] = np.where(some, np.clip(cosine[np.arange(rows), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
