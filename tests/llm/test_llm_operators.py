"""Small tests of the operators against brute force, round trips and held-out accuracy; and of odd tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import katz, langid, mixing, neardup, packing, pii, quality, sketch, tokens, urls
from tidemark.llm.components import components
from tidemark.llm.vocab import Coder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, sketch int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n, words=tuple(f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")):
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def fixture_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies; and columns with the operators' own names."""
    rng = random.Random(3)
    texts = {k: prose(rng, rng.randint(30, 120)) for k in range(2, 30)}
    texts[30] = texts[5]
    for k, base in ((31, 5), (32, 7), (33, 32), (34, 9)):
        w = texts[base].split()
        w[3] = w[-4] = f"edit{k}"
        texts[k] = " ".join(w)
    texts |= {0: None, 1: "", 35: " \n\t ", 36: "single", 37: "Two words", 38: "two WORDS", 39: prose(rng, 3000), 40: "é 日本語 <|endoftext|> x\xa0y z", 41: "a@b.example.org, +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1"}
    rows = [(k, t, None if k % 7 == 0 else "en", None, None, "clash", 1) for k, t in sorted(texts.items())]
    return rows + [rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows=None):
    return {r[0]: r[1] or "" for r in (rows or fixture_rows())}


# 1 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 49408, 2**32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    v = (rng.integers(0, high, n) * (rng.random(n) < 0.9)).astype(np.uint32)
    image = tokens.pack(v, np.array([7, 8]), np.array([n // 2, n - n // 2]))
    assert (tokens.unpack(image) == v).all()
    assert (tokens.document(image, 1) == v[n // 2 :]).all()


def test_outliers_are_exceptions_not_width():
    v = np.zeros(2560, np.uint32)
    v[::100] = 40_000
    assert len(tokens.pack(v, np.array([1]), np.array([2560]))) < 600


@pytest.mark.parametrize("path, bare", [(WORD, True), (BYTE, False)])
def test_encoding_by_pieces_is_exact(path, bare):
    plain, own = Tokenizer.from_file(path), Coder(path, bare)
    odd = ["it's DON'T l'été 12 345abc", "x<|endoftext|> y <|StartOfText|> <|startoftext|>", "éé ÀÉ ßİ a b \t\n z  ", "a\xa0 b \n", "a.,b ,.c ##x", "Éa ́", *texts_of().values()]
    for text in odd:
        assert own.encode(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, docs, none, tmp_path):
    path = tokens.write_token_files(docs, WORD, 1, True)
    got = sorted(map(tuple, tokens.read_token_files(spark, path).collect()), key=lambda r: (r[0], r[1]))
    plain, at, want = Tokenizer.from_file(WORD), 0, []
    for k, text in sorted((r[0], r[1] or "") for r in fixture_rows()):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        want.append((k, at, len(ids), np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == want
    files = tokens.dump(spark.read.parquet(path), str(tmp_path))
    assert sum(tokens.read_index(open(f, "rb").read())[0] for f in files) == at
    assert tokens.read_token_files(spark, tokens.write_token_files(none, WORD, 1, True)).count() == 0


# 2 --------------------------------------------------------------------------------------------------------


def test_sketches(spark, docs, none):
    own = sketch.with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", size=2, scale=2)
    rows = own.collect()
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text.lower()].add((tuple(r.sketch.low), r.sketch.least))
        assert (r.sketch.least is not None) == bool(r.text.split())
    assert all(len(v) == 1 for v in by_text.values())
    # the sketch of a union is the union of the sketches, also where one is empty
    a = spark.createDataFrame([([1, -(2**63), 5],), ([7, 4],)], "h array<bigint>")
    parts = a.select(sketch.sketch(F.col("h")).alias("s")).collect()
    both = a.agg(F.flatten(F.collect_list("h")).alias("h")).select(sketch.sketch(F.col("h")).alias("s")).first().s
    assert sorted({*parts[0].s, *parts[1].s}) == both
    assert sketch.with_sketch(none.select("text"), "text", "s").count() == 0


def test_next_document(spark, docs, none):
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = lambda df: df.withColumn("c", F.col("text"))
    got = sorted((r.doc_id, r.text, r.next) for r in sketch.with_next(d, "c", same).collect())
    rows = sorted((r[0], r[1] or "") for r in fixture_rows())
    assert got == sorted((k, t, rows[(i + 1) % len(rows)][1]) for i, (k, t) in enumerate(rows))
    one = d.where("doc_id = 36")
    assert [r.next for r in sketch.with_next(one, "c", same).collect()] == ["single"]
    assert sketch.with_next(none.select("doc_id", "text"), "c", same).count() == 0


def test_containment(spark):
    told = "named_struct('low', cast(array({}) as array<bigint>), 'least', cast({} as bigint))"
    r = spark.sql(f"select {told.format('1L,2L,3L,4L', 1)} a, {told.format('3L,4L', 3)} b, {told.format('', 'null')} e, {told.format('', 9)} f").select(
        sketch.containment(F.col("a"), F.col("b")).alias("ab"), sketch.containment(F.col("b"), F.col("a")).alias("ba"), sketch.containment(F.col("e"), F.col("a")).alias("ea"), sketch.containment(F.col("e"), F.col("e")).alias("ee"), sketch.containment(F.col("e"), F.col("f")).alias("ef"), sketch.resemblance(F.col("a.low"), F.col("b.low")).alias("j")
    )
    assert tuple(r.first()) == (0.5, 1.0, 0.0, 1.0, 0.0, 0.5)


# 3 --------------------------------------------------------------------------------------------------------


def test_katz_base_and_normalisation(spark, docs, none):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = katz.score(docs, held, katz.Katz(vocabulary=40, block=4000)).collect()
    out = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [None]
    counts = collections.Counter(w for r in fixture_rows() if not out(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    by_id = texts_of()
    assert len(got) == len(fixture_rows())
    for r in got:
        w = words(by_id[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert katz.score(none, held).count() == 0
    nothing = katz.score(docs.where(held), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in nothing)


def test_katz_sums_to_one(docs):
    """The unigrams and each context's bigrams, the unseen events among them."""
    how = katz.Katz(vocabulary=60, block=4000)
    blocks = katz.tokenised(docs, F.lit(False), how)
    table = katz.word_counts(blocks, 3).where("kind = 'model'")
    uni = katz.unigrams(table, len(fixture_rows()), how)
    every = np.array([r.c for r in table.collect()])
    assert math.isclose(uni.probability(every[every > 0]).sum() + uni.p[katz.END] + uni.unseen, 1) and math.isclose(uni.p.sum(), 1)
    rows = katz.bigram_counts(blocks, uni, how, 3)
    model = rows.where("kind = 'model'").collect()
    n = sum((np.array(r.counts) for r in rows.where("kind = 'counts'").collect()), np.zeros(7, int))
    d = katz.discounts([0, *n[1:].tolist()], how.discounted)
    for r in model:
        c, to = np.array(r.counts), np.array(r.words)
        facts = np.array([[c.sum(), *[(c == k).sum() for k in range(1, 6)], uni.p[to].sum()]], float)
        factor, alpha = katz.backoff(facts, d)
        unseen = np.setdiff1d(np.arange(1, len(uni.p)), to)
        assert math.isclose((katz.discounted(c, d) * factor[0]).sum() + alpha[0] * uni.p[unseen].sum(), 1)
    assert sum(sum(r.counts) for r in model) == uni.n


def test_katz_bigrams_of_rare_words(spark):
    """Equal to plain counts over all words, though the driver numbers but a few of them."""
    rng = random.Random(5)
    texts = {k: " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60))) for k in range(80)}
    held = {k: k % 5 == 0 for k in texts}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in katz.score(d, F.col("doc_id") % 5 == 0, katz.Katz(vocabulary=12, block=900, row=2)).collect()}
    ways = lambda t: list(zip([0, *t.split()], [*t.split(), 1], strict=True))
    two = collections.Counter(x for k, t in texts.items() if not held[k] for x in ways(t))
    one = collections.Counter(w for (_, w), c in two.items() for _ in range(c))
    of = lambda c: katz.discounts([0] + [sum(x == r for x in c.values()) for r in range(1, 7)], 5)
    d1, d2, n = of(one), of(two), sum(one.values())
    left = {w: katz.discounted([c], d1)[0] for w, c in one.items()}
    assert sum(left.values()) < n
    p = lambda w: left[w] / n if w in left else 1 - sum(left.values()) / n
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c

    def log(h, w):
        own = after[h] if h in after else {}
        if not own:
            return math.log10(p(w))
        facts = np.array([[sum(own.values()), *[sum(c == r for c in own.values()) for r in range(1, 6)], sum(map(p, own))]], float)
        factor, alpha = katz.backoff(facts, d2)
        return math.log10(katz.discounted([own[w]], d2)[0] * factor[0] if w in own else alpha[0] * p(w))

    for k, t in texts.items():
        assert math.isclose(got[k], sum(log(h, w) for h, w in ways(t)), rel_tol=1e-9), k


def test_backoff_weights():
    # directly: the backoff weights close each context's distribution
    d = katz.discounts([0, 50, 20, 9, 5, 3, 2], 5)
    facts = np.array([[100.0, 10, 4, 2, 1, 1, 0.3], [7.0, 0, 0, 0, 0, 0, 0.2], [0.0, 0, 0, 0, 0, 0, 0.0], [12.0, 2, 1, 0, 0, 0, 1.0]])
    factor, alpha = katz.backoff(facts, d)
    used = facts[:, 0] - (facts[:, 1:6] * (1 - d[1:]) * np.arange(1, 6)).sum(axis=1)
    assert np.allclose(used * factor + alpha * (1 - facts[:, 6]), 1)
    assert ((0 < d) & (d <= 1)).all() and (katz.discounts([0, 0, 0, 0, 0, 0, 0], 5) > 0).all()


# 4 --------------------------------------------------------------------------------------------------------


def checked_pieces(rows, want):
    """Each document's ids once; each sequence gapless, at most full, and padded only as told."""
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        parts[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= 1024 and own[0].padded_length == (at if at & (at - 1) == 0 else 1024)
    got = {k: b"".join(x for _, x, _ in sorted(v)) for k, v in parts.items()}
    assert got == want
    return sum(r.length for r in rows), sum(own[0].padded_length for own in sequences.values())


def test_packing(docs, none):
    plain = Tokenizer.from_file(BYTE)
    unique = docs.dropDuplicates(["doc_id"])
    want = {k: np.asarray([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for k, t in texts_of().items()}
    used, padded = checked_pieces(packing.pack(unique, BYTE, 0, False).collect(), want)
    assert used == padded  # what is left over is cut at powers of two
    assert packing.pack(docs, BYTE, 0, False).agg(F.sum("length")).first()[0] > used
    assert packing.pack(none, BYTE, 0, False).count() == 0


def test_sum_of_squares_level():
    p = packing.Packer(capacity=10)
    ids = lambda n: b"\0\0\0\0" * n
    for k, n in enumerate((4, 6, 10, 23)):
        p.add(k, ids(n))
    rng = random.Random(5)
    for k in range(200):
        size = rng.randint(1, 9)
        counts = p.counts.copy()
        level = p._level(size)
        squares = {}
        for h in range(0, 10 - size + 1):
            if h == 0 or counts[h]:
                c = counts.copy()
                if h:
                    c[h] -= 1
                if h + size < 10:
                    c[h + size] += 1
                squares[h] = int((c[1:10] ** 2).sum())
        assert squares[level] == min(squares.values())
        p.add(k, ids(size))
    assert sum(len(w) for w in p.levels) == p.open
    small = packing.Packer(capacity=10)
    closed = [w for k in range(50) for w in small.add(k, ids(6))] + small.finish()
    assert small.open == 0 and sum(len(x[2]) for w in closed for x in w) == 50 * 24


def test_giving_up_the_cache_changes_nothing(docs):
    of = lambda keep: sorted(map(str, packing.pack(docs, BYTE, end_id=0, drops_blanks=False, keep_cache=keep).collect()))
    assert of(True) == of(False)


# 5 --------------------------------------------------------------------------------------------------------


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality(docs, none):
    rng = random.Random(2)
    rep = prose(rng, 12)
    extra = ["a | b | c | d | e | f | g | h\n" * 6, f"{rep}\n{rep}\n" + prose(rng, 30), "x#y " * 30, "We use cookies.\n" + prose(rng, 60) + "\nlast line", "\n\n" + "WOW!! BUY!! NOW!! " * 20]
    spark = docs.sparkSession
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(docs.select("doc_id", "text", "kept").unionByName(more, allowMissingColumns=True)).collect()}
    for k, text in (texts_of() | {100 + i: t for i, t in enumerate(extra)}).items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text), k
        assert not (r.kept and r.base_failed)
    assert [got[k].kept for k in range(2, 30)] == [True] * 28
    assert [got[100 + k].kept for k in range(5)] == [False, brute_quality(extra[1])[5] is False, False, True, False]
    assert "cookies" not in got[103].clean_text and got[103].clean_text.endswith("last line")
    assert quality.clean_lines(none).count() == 0


@pytest.mark.parametrize(("line", "rule"), [("Home / News / Sport / Weather", "navigation"), ("Docs :: API :: Index", "navigation"), ("Really?! No?! Yes?! Go!?", "punctuation"), ("either/or and 10:30 or so!", None), ("Alle Rechte vorbehalten, 2020", "boilerplate"), ("Cliquez ici pour lire la suite", "boilerplate")])
def test_lines_without_symbols_reach_the_rules(line, rule):
    assert quality.line_fails(line.encode().split(), line.encode(), quality.LineRules()) == rule


def test_menus_go_and_prose_stays():
    text = "\n".join(["Home", "About us", "", "Contact", "Log book", "This is a line of prose, with an end.", "Short one", "Other", "It ends here."]).encode()
    *_, clean, failed = quality.assess(text, quality.LineRules())
    assert failed == 4 and clean.decode().split("\n") == ["", "This is a line of prose, with an end.", "Short one", "Other", "It ends here."]


# 6 --------------------------------------------------------------------------------------------------------


MIX = mixing.Mix(targets={"good": 0.8, "poor": 0.16, "toxic": 0.04}, penalty=0.1)


@pytest.fixture(scope="module")
def mixable(spark):
    """200 documents in three plain domains, and labels for most of them."""
    rng = random.Random(4)
    rows = [(k, prose(rng, 40) + (" vile scum, awful trash" if k % 10 == 0 else "") + (" ### $$$ ***" * 10 if k % 10 == 1 else "")) for k in range(200)]
    labels = [(k, int(k % 10 != 1), int(k % 10 == 0)) for k in range(200) if k % 3]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing(spark, docs, none, mixable):
    d, labels = mixable
    out = mixing.mix(d, labels, MIX).collect()
    assert len(out) == 200 and all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in out)
    assert all(r.n_tokens == len(r.text.split()) for r in out)
    total = {x: sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in out) for x in mixing.DOMAINS}
    budget = sum(r.n_tokens * r.p_good for r in out) / 0.8
    assert all(abs(total[x] - MIX.targets[x] * budget) <= 1e-4 * budget for x in mixing.DOMAINS)
    bad = lambda t: np.mean([r.rate for r in out if (r.doc_id % 10 == 0) == t])
    assert bad(True) < 0.7 < bad(False)
    # of documents without a label, each domain is told apart
    held = [r for r in out if r.doc_id % 3 == 0]
    told = {k: np.mean([max(mixing.DOMAINS, key=lambda x: r[f"p_{x}"]) == want for r in held if want == ("toxic" if r.doc_id % 10 == 0 else "poor" if r.doc_id % 10 == 1 else "good")]) for k, want in enumerate(mixing.DOMAINS)}
    assert min(told.values()) > 0.5
    again = mixing.resampled(mixing.mix(docs, labels, MIX), docs.columns)
    assert again.columns == docs.columns
    assert mixing.mix(none, labels).count() == 0
    unlabelled = mixing.mix(docs, labels.limit(0), mixing.Mix(steps=2))
    assert unlabelled.count() == len(fixture_rows()) and unlabelled.where("rate < 0 or rate is null").isEmpty()


def test_posteriors_equal_plain_ones(spark, docs, mixable):
    """Spark's sums over cells against numpy's, and cells against hashes computed alone."""
    d, labels = mixable
    model = mixing.learn(d, labels, MIX)
    every = docs.select("doc_id", "text").unionByName(d)
    cells = {(r.doc_id, r.n_tokens): r["_cells"] for r in mixing.with_evidence(every, ["doc_id"], MIX).collect()}
    for r in mixing.with_posteriors(every, model, MIX).collect():
        words = (r.text or "").split(" ") if r.text and "\n" not in r.text and "\t" not in r.text else None
        own = np.array(cells[r.doc_id, r.n_tokens])
        assert len(set(own)) == len(own) and (words is None or r.n_tokens == len([w for w in words if w]))
        assert np.allclose([r[f"p_{x}"] for x in mixing.DOMAINS], model.probabilities(own), atol=1e-9)
    # no row of the plan holds the weights, and a moved rate keeps it small
    mixed = mixing.mix(d, labels, MIX)
    twelve = mixed.withColumn("rate", mixing.rate([(0.1, 0.2, 0.3)] * 12))
    assert len(mixing.resampled(twelve, d.columns)._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    plan = mixing.with_posteriors(d, model, MIX)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _w_p_good" not in plan and len(plan) < 20_000


@pytest.mark.parametrize("targets", [{"good": 0.4, "poor": 0.4, "toxic": 0.2}, {"good": 0.1, "poor": 0.1, "toxic": 0.8}])
def test_rates_are_least_squares(spark, targets):
    """Against projected gradient over single documents in numpy, run long; also where no rates can meet the targets."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.4, 0.4, 0.4), 60)
    p[:, 2] = np.maximum(p[:, 2], 0.05)
    p /= p.sum(axis=1, keepdims=True)
    t = rng.integers(1, 50, 60).astype(float)
    df = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p, strict=True)], "n_tokens long, p_good double, p_poor double, p_toxic double")
    got = mixing.fit(df, mixing.Mix(targets=targets, budget=2000.0, tolerance=1e-3))
    want = np.array([targets[d] for d in mixing.DOMAINS]) * 2000
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    r = np.ones(60)
    for _ in range(20_000):
        r = np.maximum(0, r - step * (p @ ((r * t) @ p - want)))
    least = (((r * t) @ p - want) ** 2).sum()
    assert ((got.got - want) ** 2).sum() <= least * 1.05 + 25
    by_rate = [x.r for x in df.select(mixing.rate(got.moves).alias("r")).collect()]
    assert min(by_rate) >= 0 and np.allclose((np.array(by_rate) * t) @ p, got.got)
    assert got.met == (np.abs(got.got - want).max() <= 2)


# 7 --------------------------------------------------------------------------------------------------------


def brute_components(texts, size):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        sets[k] = frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs, neardup.NearDup(shingle=2)).collect()
    want = brute_components(texts_of(), 2)
    assert len(got) == len(fixture_rows())
    assert all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in got)
    assert any(want[k][1] != k for k in want)
    assert neardup.near_duplicates(none).count() == 0


def test_a_hot_group_and_a_bad_head(spark):
    """Near copies around texts that share less than the threshold with them, in small blocks."""
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(14 if k < 3 else 3):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.NearDup(shingle=2, block=8, salted=5)).collect()}
    assert got == {k: v[1] for k, v in brute_components(dict(rows), 2).items()}


def test_several_hot_buckets_of_unlike_members(spark):
    """Families whose members lie on both sides of the threshold, in blocks of a few members."""
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = prose(rng, 80 + 20 * family).split()
        for _ in range(60):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.choice((1, 3, 5, 7, 9))):
                w[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.NearDup(shingle=2, block=16, long=64, chunk=3)).collect()}
    want = {k: v[1] for k, v in brute_components(dict(rows), 2).items()}
    assert got == want and len(set(want.values())) > 10


def test_blocks_give_a_forest():
    """However many pairs a block tests, its links join components once."""
    how = neardup.NearDup(bands=2, rows=1, hashes=32)
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(k % 5) for k in range(40)]
    sig = bytes(32)
    rows = [(7, 0, 0, asks, k, k, True, 100, sig, [1, 7], s.tobytes()) for asks in (0, 1) for k, s in enumerate(sets)]
    links = neardup._Block([(*r[:9], [10 + r[4], 7], r[10]) for r in rows], how).links()
    assert len(links) == 39 and {x for pair in links for x in pair} == set(range(40))
    assert neardup._Block(rows, how).links() == []  # all share the earlier band too
    assert neardup.common(sets[0], sets[:3]).tolist() == [100, 99, 98]


def test_null_ids_in_near_duplicates(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (6, None), (None, "")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(shingle=2)).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (None, 3, None, True), (5, 3, 5, True), (6, 0, 6, True), (None, 0, None, True)], key=str)


def test_posterior_bounds():
    how = neardup.NearDup()
    rng = np.random.default_rng(1)
    for s, survive in ((0.95, 1.0), (0.85, 0.999), (0.3, 0.0)):
        q = s + (1 - s) / 256
        same = rng.random((4000, how.hashes)) < q
        a = rng.integers(0, 256, same.shape, np.uint8)
        b = np.where(same, a, a + 1).astype(np.uint8)
        share = len(neardup.surviving(a, b, how)[0]) / len(a)
        assert share >= survive if survive else share == 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(50, 60), (60, 55), (70, 70)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 60: 50, 55: 50, 70: 70}


# 8 --------------------------------------------------------------------------------------------------------


def brute_spans(text):
    import re

    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, rule in kinds:
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_equal_plain_ones():
    rng = random.Random(6)
    odd = ["a@b.c@d.e.f x@@y.z 1.2.3.4.5.6.7.8 1.2.3.256 000.01.1.1", "..@a-.b-c é@é.com a.b@c.d.", "+1234567890123456 +12-34", "a@b@c.d", "x" * 3000 + "@y.z"]
    odd += ["".join(rng.choice("a1.@+- (4)é") for _ in range(60)) for _ in range(300)]
    assert all(pii.patterns(t)[0] == brute_spans(t) for t in odd)


def test_network_on_held_out_sentences():
    w = pii.train()
    rows = pii.labelled_spans(pii.Training(seed=77, sentences=200))
    hit = wrong = missed = 0
    for (_, spans), got in zip(rows, pii.model_spans([t for t, _ in rows], w), strict=True):
        inner = lambda xs: {s for s in xs if s[1] < 96}
        a, b = inner(spans), inner(got)
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + missed) > 0.75 and hit / (hit + wrong) > 0.75


def test_gradients():
    how = pii.Training(sentences=4, length=12, embedding=3, hidden=2)
    rng = np.random.default_rng(0)
    w = {k: rng.standard_normal(v.shape) * 0.5 for k, v in pii.train(pii.Training(sentences=2, epochs=1, length=12, embedding=3, hidden=2)).items()}
    rows = pii.labelled_spans(how)
    x, y = np.stack([pii.symbols(t) for t, _ in rows]), np.stack([pii._targets(s, 12) for _, s in rows])

    def loss(w):
        s, _ = pii.emissions(x, w)
        a = s[0]
        gold = s[0][np.arange(4), y[:, 0]]
        for t in range(1, 12):
            a = s[t] + pii._logsum(a[:, :, None] + w["t"], 1)
            gold = gold + s[t][np.arange(4), y[:, t]] + w["t"][y[:, t - 1], y[:, t]]
        return float((pii._logsum(a, 1) - gold).mean())

    grad = pii._gradients(x, y, w)
    for name, g in grad.items():
        at = tuple(rng.integers(0, n) for n in g.shape) if name != "e" else (int(x[0, 0]), 0)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert math.isclose(g[at], (loss(up) - loss(down)) / 2e-5, rel_tol=1e-3, abs_tol=1e-6), name


def test_personal_data(spark, docs, none):
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for k, text in texts_of().items():
        base = brute_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert {x for x in pii.listed(base).split(",")} <= {x for x in got[k].spans.split(",")}
    assert (got[41].n_email, got[41].n_ip, got[41].n_card, got[41].n_phone) == (1, 1, 1, 1)
    assert got[41].masked_text == "[EMAIL], [PHONE], [CARD], [IP]" and got[0].masked_text is None
    assert pii.detect(none).count() == 0
    w = pii.train()
    far = "word " * 400
    alone = pii.find([b"call (555) 123-4567 now", (far + "call (555) 123-4567 now").encode()], w)
    assert [len(a[1]) for a in alone] == [1, 1] and alone[1][1][0][0] == alone[0][1][0][0] + len(far)


def test_addresses_without_digits_or_at_signs():
    w = pii.train()
    for told in ("anre[at]doti[dot]org", "thin.er (at) veal (dot) org"):
        for text in (f"on ou {told} re ti", "word " * 300 + f"{told} word" + " word" * 300, "1 @ " + "word " * 300 + told):
            a = text.index(told)
            assert (a, a + len(told), "email") in pii.find([text.encode()], w)[0][1], text


def test_failed_patterns_of_other_kinds_drop_nothing():
    """Recall of ``find`` for each spelling, over drawn personal data among words."""
    rng = random.Random(12)
    w = pii.train()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        body += next(c for c in "0123456789" if pii.luhn(body + c))
        return ".".join(body[k : k + 4] for k in range(0, 16, 4))

    for kind, make in (("phone", lambda: f"0{digits(3)} {digits(3)} {digits(4)}"), ("card", card)):
        told = [make() for _ in range(100)]
        found = pii.find([f"on ou {x} re ti".encode() for x in told], w)
        assert np.mean([(6, 6 + len(x), kind) in every for x, (_, every) in zip(told, found, strict=True)]) > 0.5, kind


def test_windows_left_out_change_nothing(monkeypatch):
    """Long addresses among long stretches of words give the spans that decoding every window gives."""
    rng = random.Random(9)
    w = pii.train()
    name = lambda n: "".join(rng.choice("abcdefghilmnorstu") for _ in range(n))
    texts = [("word " * rng.randint(0, 60) + f"{name(rng.randint(1, 400))}{at}{name(rng.randint(1, 300))}.org" + " word" * rng.randint(0, 60)).encode() for at in ("@", "[at]") * 10]
    got = pii.find(texts, w)
    monkeypatch.setattr(pii, "_windows", lambda ids: np.ones(max(1, -(-(len(ids) - pii.STRIDE) // pii.STRIDE)), bool))
    assert got == pii.find(texts, w)


# 9 --------------------------------------------------------------------------------------------------------


def test_language(spark, docs, none):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    langs, profile = langid.prototypes(langid.learn(sample, train))
    assert langs == ["de", "en", "es", "fr"]
    told = langid.identify(sample, langs, profile).join(sample.where(~train).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in told]) > 0.95 and all(0 <= r.score <= 1 for r in told)
    odd = {r.doc_id: r for r in langid.identify(docs, langs, profile).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[35].lang_pred == "und" and odd[0].score == 0 and odd[36].lang_pred in langs
    assert langid.identify(none, langs, profile).count() == 0
    empty = langid.prototypes(langid.learn(none, F.lit(True)))
    assert {r.lang_pred for r in langid.identify(docs, *empty).collect()} == {"und"}


def test_binding_and_bundling():
    """A text's bundle is the sum of its n-grams' bound vectors, whatever the batch."""
    how, texts = langid.Profile(dimensions=64), ["abc abd", "x", "", "Straße é"]
    letters = langid._letters(how)
    owner, codes = langid.ngrams(texts)
    for k, text in enumerate(texts):
        s = [0, 0, *[int(langid._symbols()[ord(c)]) for c in text], 0, 0]
        want = sorted((a * 64 + b) * 64 + c for a, b, c in zip(s, s[1:], s[2:], strict=False) if b)
        assert sorted(codes[owner == k].tolist()) == want
    v = langid.ngram_vectors(np.array([(1 * 64 + 2) * 64 + 3]), letters)[0]
    assert (v == letters[0][1] * letters[1][2] * letters[2][3]).all()


# 10 -------------------------------------------------------------------------------------------------------

RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "bad.net/")]


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">x</a>' for h in hosts)
    rows = [
        (1, "http://A.org/x?y#z", link("friend.com")), (2, "http://w.example.org/es/1", None), (3, "http://example.org", ""), (4, "http://sub.bad.net/", link("friend.com")),
        (5, "https://farm.com/a", link("bad.net", "bad.net")), (6, "https://friend.com/a", link("other.com")), (7, "https://other.com/", "<a href='/local'>"), (8, None, link("bad.net")), (9, "no scheme/x", None), (10, "https://mixed.com", link("farm.com", "a.org", "friend.com", "q.com")), (10, "https://mixed.com", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(1))
    got = collections.defaultdict(list)
    for r in urls.judge(df, RULES).collect():
        got[r.page_id].append(r)
    one = {k: v[0] for k, v in got.items()}
    assert (one[1].host, one[1].path, one[1].rule, one[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (one[2].rule, one[2].verdict, one[3].path, one[3].rule) == ("example.org/es/", "block", "", None)
    assert (one[4].rule, one[4].verdict, one[5].verdict, one[6].verdict) == ("bad.net/", "block", "block", "allow")
    assert all((one[k].host, one[k].path, one[k].rule, one[k].verdict) == ("", "", None, "allow") for k in (8, 9))
    assert len(got[10]) == 2 and one[6].trust > 0 and one[5].distrust > 0
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_a_linked_seed_without_pages_and_with_many_links(spark):
    """A blocked host that was never crawled blocks those that link to it alone, however many they are."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [(k, f"https://f{k}.com/", link("bad.net")) for k in range(40)] + [(90, "https://news.com/", link("bad.net", "a.org", "b.com", "c.com")), (91, "https://half.example.org/es/1", None), (92, "https://half.example.org/x", None), (93, "https://toward.com/", link("f0.com"))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert all(got[k].verdict == "block" and got[k].distrust == 1 for k in range(40)) and 0 < got[93].distrust < 0.5
    assert got[90].verdict == "allow" and 0 < got[90].distrust < 0.5
    assert (got[91].verdict, got[92].verdict) == ("block", "allow")


def test_propagation_equals_plain_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 3), ("b", "d", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, n long")
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.5), "d": (0.25, 0.0)}
    how = urls.Propagation(rounds=5, rounds_in_a_plan=2)
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(df, spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double"), how).collect()}

    def plain(edges, start):
        out = collections.Counter()
        for s, _, n in edges:
            out[s] += n
        score, flow = {h: 0.15 * x for h, x in start.items()}, {}
        for _ in range(5):
            flow = collections.Counter()
            for s, t, n in edges:
                flow[t] += 0.85 * score.get(s, 0) * n / out[s]
            score = {h: flow[h] + 0.15 * start[h] for h in start}
        return flow

    back = [(t, s, n) for s, t, n in edges]
    ones = dict.fromkeys(seeds, 1.0)
    for way, k in ((edges, 0), (back, 1)):
        some, every = plain(way, {h: x[k] for h, x in seeds.items()}), plain(way, ones)
        assert all(math.isclose(got[h][k], some[h] / every[h] if every[h] else 0.0, abs_tol=1e-9) for h in "abcd")


# all ------------------------------------------------------------------------------------------------------

ODD = [(None, "no id here at all, but words enough to count for something"), (None, None), (0, "ties tie"), (0, "ties tie"), (5, None), (7, ""), (8, "word " * 3000), (2**40, "é 日本語 a@b.example.org")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_queries_on_odd_tables(spark, tmp_path, rows):
    """Every query, as registered, on null ids and texts, ties, repeated rows, long texts, clashing columns, and empty tables."""
    import __spark_entry__

    docs = [(k, t, "en", None, len(t or ""), "x", 1.5, 2) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, rate double, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pages = [(k, t, t, "clash") for k, t in rows]
    spark.createDataFrame(pages, "page_id long, url string, html string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") and name != "op12_spelling":  # its rows are words; its own tests have odd tables
            got = query(spark, str(tmp_path)).collect()
            key = "page_id" if name.startswith("op10") else "doc_id"
            assert collections.Counter(r[key] for r in got) >= collections.Counter(k for k, _ in rows), name
            if not name.startswith("op4"):
                assert len(got) == len(rows), name


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    """op2's columns from plain Python: the edited text, and likenesses from shingle sets whose hashes are kept."""
    import __spark_entry__

    rows = sorted((k, t or "") for k, t in {r[0]: r[1] for r in fixture_rows()}.items())
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["op2_fingerprints"](spark, str(tmp_path)).collect()}
    for (k, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [set(x[i : i + 16] for i in range(0, len(x), 16)) for x in (got[k].fingerprint, got[k].edited_fingerprint)]
        if len(t) > 200:
            assert math.isclose(got[k].near_edited, len(prints[0] & prints[1]) / len(prints[0]))
