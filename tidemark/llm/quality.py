"""Line-first cleaning: judge each line by rules, drop the lines that fail, then reject documents that lost too much.

Navigation: lines of separators, and runs of short lines that no mark ends. Punctuation: lines of symbols and
doubled marks. Boilerplate: phrases of web pages in four languages.

The work is one pass over each text with no exchange, so a third of all rows in one source changes nothing.

Edge cases: a null or empty text has no words, keeps no lines and fails; repeated rows get equal verdicts;
an empty table gives an empty result; columns of the input that clash with the new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import BLANKS, as_bytes, slices

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
SEPARATORS = {x.encode() for x in ("|", "»", "›", "•", "·", ">", "/", "::")}
_END = (b".", b",", b";", b":", b"!", b"?", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb")
_SHOUT = re.compile(rb"[!?]{2}|[#*$%&|<>]")
_BOILERPLATE = re.compile(
    rb"all rights reserved|cookie (?:policy|settings|consent)|we use cookies|enable javascript|privacy policy"
    rb"|terms (?:of (?:use|service)|and conditions)|subscribe to|sign up for|log ?in|click here|read more|share (?:this|on)"
    rb"|skip to (?:main )?content|lorem ipsum"
    rb"|alle rechte vorbehalten|diese (?:web)?seite verwendet cookies|wir verwenden cookies|datenschutzerkl\xc3\xa4rung|newsletter abonnieren|jetzt anmelden|hier klicken|zum (?:haupt)?inhalt springen"
    rb"|tous droits r\xc3\xa9serv\xc3\xa9s|nous utilisons des cookies|politique de confidentialit\xc3\xa9|mentions l\xc3\xa9gales|cliquez ici|lire la suite|aller au contenu"
    rb"|todos los derechos reservados|utilizamos cookies|pol\xc3\xadtica de privacidad|aviso legal|haga clic aqu\xc3\xad|leer m\xc3\xa1s|ir al contenido",
    re.I,
)


@dataclass(frozen=True)
class LineRules:
    """Parameters. Shares are of words but ``max_lost``, which is of the code points in words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    #: A line of navigation has at least so many separators and this share of its words are such.
    nav_separators: int = 2
    nav_share: float = 0.25
    #: So many lines in a row, of at most so many words and without a mark at the end, are a menu.
    menu_lines: int = 4
    menu_words: int = 3
    #: A line fails for punctuation if this share of its words holds symbols or doubled ! or ?.
    symbol_share: float = 0.3
    symbol_words: int = 3
    #: Boilerplate phrases count in lines of at most so many words.
    boilerplate_words: int = 25
    #: Documents that lose more than this share of their words' code points are rejected.
    max_lost: float = 0.3


def line_fails(words: list[bytes], line: bytes, rules: LineRules) -> str | None:
    """The rule a line fails: navigation, punctuation, boilerplate or None. A line without words never fails."""
    n = len(words)
    if not n:
        return None
    # neither rule counts a word in a line that holds nothing it looks for
    if any(s in line for s in SEPARATORS):
        separators = sum(w in SEPARATORS for w in words)
        if separators >= rules.nav_separators and separators >= rules.nav_share * n:
            return "navigation"
    if _SHOUT.search(line):
        odd = sum(1 for w in words if _SHOUT.search(w))
        if odd >= rules.symbol_words and odd >= rules.symbol_share * n:
            return "punctuation"
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(ids: np.ndarray, window: int) -> int:
    """Words inside windows of ``window`` words that stand twice or more in the text, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = order[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def menu_lines(lines: list[tuple[bytes, list[bytes]]], rules: LineRules) -> set[int]:
    """Places, among the lines with words, of those in a run of short lines that no mark ends."""
    out: set[int] = set()
    run: list[int] = []
    for k in range(len(lines) + 1):
        if k < len(lines) and len(lines[k][1]) <= rules.menu_words and not lines[k][1][-1].endswith(_END):
            run.append(k)
        else:
            if len(run) >= rules.menu_lines:
                out.update(run)
            run = []
    return out


class _Ids(dict):
    def __missing__(self, word):
        self[word] = len(self)
        return len(self) - 1


def assess(text: bytes, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, failed lines)."""
    chars = lambda x: len(x.decode("utf-8", "replace"))
    solid = text.translate(None, BLANKS)
    word_chars = chars(solid)
    n_symbols = len(solid.translate(None, _NOT_SYMBOLS))
    seen, dup, lost, failed, kept_lines, words = set(), 0, 0, 0, [], []
    lines = [(line, line.split()) for line in text.split(b"\n")]
    menu, place = menu_lines([x for x in lines if x[1]], rules), -1
    for line, own in lines:
        if own:
            place += 1
            words += own
            dup += line in seen
            seen.add(line)
            if place in menu or line_fails(own, line, rules):
                failed += 1
                lost += chars(b"".join(own))
                continue
        kept_lines.append(line)
    n = len(words)
    ids = _Ids()
    repeats = repeated_words(np.fromiter(map(ids.__getitem__, words), np.uint64, n), rules.repeat_window) if n > rules.repeat_window else 0
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and lost <= rules.max_lost * word_chars
    return n, word_chars, n_symbols, dup, repeats, base_failed, kept, b"\n".join(kept_lines), failed


_ADDED = [
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("clean_text", T.StringType(), pa.string()),
    ("n_failed_lines", T.LongType(), pa.int64()),
]


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with its measures, verdict and, if asked for, the text without the failed lines."""
    added = [a for a in _ADDED if with_text or a[0] != "clean_text"]
    names = {a[0] for a in added}
    carried = [f for f in docs.schema if f.name not in names]
    schema = T.StructType(carried + [T.StructField(n, t) for n, t, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            out = [assess(x, rules) for x in as_bytes(batch.column(at))]
            cols = dict(zip([a[0] for a in _ADDED], zip(*out), strict=True)) if out else {a[0]: () for a in _ADDED}
            cols["clean_text"] = [x.decode("utf-8", "replace") for x in cols["clean_text"]] if with_text else ()
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            arrays += [pa.array(cols[n], t) for n, _, t in added]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)
