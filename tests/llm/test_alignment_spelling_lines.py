"""Operators 11 to 13 against brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import align, linededup, spelling
from tidemark.llm.align import _WHOLE
from tidemark.llm.queries import op11_alignment, op12_spelling, op13_line_dedup

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, count long, row string, gone int, n int, word string"


def table(spark, tmp_path, rows):
    """A documents table with further columns that bear the operators' own names."""
    spark.createDataFrame([(k, t, "en", 1, "r", 2, 3, "w") for k, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B, align.Alignment())


# 11 -------------------------------------------------------------------------------------------------------

PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "Zeit", "é", "ß", "日本", "😀", ",", ".", "'s", "123", "<|endoftext|>", "<s>", "\r", "\xa0", "▁", "<0x41>", "don't", " \n ", " the", "\x00", "À", "́", "œ", "end.", "Wort,", "é!?", "x9."]


def mixed(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def plain_alignment(both, text):
    """(A ids, B ids, groups) straight from the contract, or None."""
    raw = f" {text}".encode()
    a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    if not text or b"".join(both.bytes_a[x] for x in a) != raw or b"".join(both.bytes_b[x] for x in b) != raw:
        return None
    ends = [np.cumsum([len(of[x]) for x in ids]).tolist() for ids, of in ((a, both.bytes_a), (b, both.bytes_b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups


def test_segments_align_as_whole_texts(aligner):
    """Cutting a text into segments changes no token; special tokens' strings are plain text."""
    cut = 0
    for text in mixed(1, 3000):
        whole = aligner.whole(text)
        want = plain_alignment(aligner, text)
        assert (whole is None) == (want is None)
        if whole:
            assert whole[3] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want[2])
        if not _WHOLE.search(text):
            segments = aligner.segments(text)
            aligner.learn(set(segments))
            parts = [aligner.cache[s] for s in segments]
            got = None if None in parts else (*(sum(p[k] for p in parts) for k in range(3)), ";".join(p[3] for p in parts), tuple(c for p in parts for c in p[4]))
            assert got == whole
            cut += 1
    assert cut > 300


def test_alignment_query_equals_brute_force(spark, tmp_path, aligner, monkeypatch):
    texts = mixed(2, 60) + ["the Zeit and the 123 don't " * 40, "It was the best of times, it was the worst of times."]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[-1]) for k in range(40)] + [(None, texts[-2]), (3, texts[3]), (500, None), (501, "")]
    got = op11_alignment(spark, table(spark, tmp_path, rows)).collect()
    plain = {t: plain_alignment(aligner, t or "") for _, t in rows}
    count = collections.Counter()
    for _, t in rows:
        for a, b in (plain[t] or ([], [], []))[2]:
            count[a[-1], b[-1]] += 1
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = collections.Counter()
    for k, t in rows:
        if plain[t] is None:
            want[k, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        a, b, groups = plain[t]
        pairs = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[k, len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_small_blocks_and_caches_change_nothing(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(mixed(4, 80))], "doc_id long, text string")
    some = lambda how: sorted(map(tuple, align.align(docs, A, B, how)[0].collect()))
    assert some(align.Alignment(cache=20, block=50)) == some(align.Alignment())


# 12 -------------------------------------------------------------------------------------------------------


def plain_words(rows):
    count = collections.Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and words[v] >= 10 * words[w] else None for w, v in best.items()}
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def edits(rng, word, letters):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]])


def spelled(seed, letters="abcéÿÀ×"):
    """Words of few letters, so that many share their letters, and chains of ever more frequent forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)]
    for _ in range(300):
        words.append(edits(rng, rng.choice(words), letters))
    chain = ["verbatim", "verbatum", "verbatun", "verbotun"]
    return {w: rng.choice([2, 3, 5, 30, 400]) for w in words if len(w) >= 7} | {w: 2 * 11**k for k, w in enumerate(chain)}


@pytest.mark.parametrize("how", [spelling.Spelling(), spelling.Spelling(cell=20, sample_of_cell=4, leaf=3), spelling.Spelling(cell=20, sample=10, sample_of_cell=2, leaf=1)])
def test_variants_equal_brute_force(spark, how):
    """Whatever the cells and leaves, and however few words the tops of the trees are fitted to."""
    words = spelled(5)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), how).collect()}
    want = plain_variants(words)
    assert got == want
    assert want["verbatim"][4] == "verbotun" and sum(v[1] for v in want.values()) > 500


def test_spelling_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for k, (w, n) in enumerate(sorted(spelled(6).items())):
        rows.append((k, " ".join(rng.choice([w, w.upper(), w.capitalize()]) for _ in range(min(n, 60))) + "; short 1234567 Straßenbahnœx"))
    rows += [(None, "verbotun " * 40), (3, rows[3][1]), (900, None), (901, ""), (902, "x" * 30_000 + " " + "x" * 30_000)]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in op12_spelling(spark, table(spark, tmp_path, rows)).collect()}
    assert got == plain_variants(plain_words(rows))


def test_tree_boxes_prune_nothing_near():
    """Every near pair survives the boxes, at every leaf size."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aabcdeé") for _ in range(8)) for _ in range(400)})
    rows = spelling.letters(words, 8)
    points = spelling.vectors(rows)
    want = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    for leaf in (1, 7, 1000):
        tree = spelling.Tree(points, leaf, tight=True)
        got = [(words[q], words[p]) for a, b in spelling.near_pairs(tree, points, rows, points, rows) for q, p in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


# 13 -------------------------------------------------------------------------------------------------------


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    small = -(1 << 70)
    where = collections.defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(small if k is None else k)
    gone = {line: max(ids) for line, ids in where.items() if len(ids) >= min_docs}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if gone.get(key(line), k if k is not None else small) == (k if k is not None else small)]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def lined(seed):
    rng = random.Random(seed)
    shared = [f"Line {k} that many documents share, more or less, at {k * 7}" for k in range(12)] + ["Ünïcode " * 5, "é" * 39, "é" * 40, "x" * 39]
    rows = []
    for k in range(150):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line of document {k} and number {j}, which is long" for j in range(rng.randint(1, 9))]
        rows.append((k, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \r"]) for x in lines)))
    everywhere = "a line that is in every single document of this table"
    rows = [(k, t + "\n" + everywhere) for k, t in rows]
    return rows + [(None, shared[0]), (None, shared[1] + "\n" + everywhere), (7, everywhere), (7, everywhere), (200, None), (201, ""), (202, "\n\n"), (203, (shared[2] + "\n") * 3000)]


def test_line_query_equals_brute_force(spark, tmp_path):
    rows = lined(1)
    got = op13_line_dedup(spark, table(spark, tmp_path, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == plain_lines(rows)


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 2), (9, 3)])
def test_batches_and_levels_change_nothing(spark, batches, fan):
    rows = lined(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = linededup.dedup_lines(docs, linededup.LineDedup(batches=batches, fan=fan)).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == plain_lines(rows)


def test_runs_are_levelled_and_deleted(spark):
    runs = linededup.LineRuns(spark, linededup.LineDedup(fan=2))
    lines = spark.range(400).selectExpr("40 - cast(id / 10 as int) doc_id", "id % 37 line_hi", "id % 5 line_lo")
    for k in range(7):
        runs.add(lines.where(f"doc_id > {34 - 6 * k} and doc_id <= {40 - 6 * k}"))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    firsts = [r for name in runs.names() for r in spark.table(f"{runs.database}.{name}").where("first").collect()]
    assert len(firsts) == len({(r.line_hi, r.line_lo) for r in firsts}) == lines.select("line_hi", "line_lo").distinct().count()
    runs.close()
    assert runs.database not in {d.name for d in spark.catalog.listDatabases()}


# all ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("query", [op11_alignment, op12_spelling, op13_line_dedup])
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, table(spark, tmp_path, [])).collect() == []
