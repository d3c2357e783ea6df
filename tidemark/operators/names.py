"""Listed names over all cells of a table: one automaton for a list, one pass over the cells.

A list is dealt to shards of bounded size. A shard is one automaton (all names in all spellings at once), sent to
every task; a text is read once for each shard, however many names it holds. So what is broadcast never grows past a
shard, and a longer list costs more passes over the cells, not more memory.

Two ways to be in a cell: as words, where no letter or digit touches the name, in any spelling, case or white space,
or as part of a link, where the name's letters and digits are joined by hyphens; and anywhere, as the text itself in
any case. A null or empty cell holds no name; empty names are in no cell; of names that overlap, the longer one counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# German letters and the digraphs that stand for them.
DIGRAPHS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"})


@dataclass(frozen=True)
class Listing:
    #: Names of one automaton.
    shard: int = 20_000
    #: Characters that a name needs to be looked for anywhere in a cell.
    anywhere_chars: int = 4


def bare(name: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))


def forms(name: str) -> tuple[set[str], set[str]]:
    """(spellings as words, spellings in a link), folded."""
    words = {" ".join(s.split()).lower() for s in (name, bare(name.translate(DIGRAPHS)), bare(name))} - {""}
    links = {re.sub("[^a-z0-9]+", "-", bare(w)).strip("-") for w in words} - {""}
    return words, links


def folded(text: str, squeeze: bool = True) -> tuple[str, list[int]]:
    """The text in lower case, its white space as single spaces if asked for, and the place in it of each character."""
    out, places = [], []
    for k, c in enumerate(text):
        low = c.lower()
        if squeeze and c.isspace():
            if out and out[-1] == " ":
                continue
            low = " "
        out.append(low if len(low) == 1 else c)
        places.append(k)
    return "".join(out), places


def _free(text: str, start: int, end: int, solid) -> bool:
    return not (start > 0 and solid(text[start - 1])) and not (end < len(text) and solid(text[end]))


def _word(c: str) -> bool:
    return c.isalpha() or c.isnumeric()


def _link(c: str) -> bool:
    return c.isascii() and (c.isalpha() or c.isdigit())


class Matcher:
    """The automaton of a shard: (n, name) pairs, n being the name's place in the list."""

    def __init__(self, names: list[tuple[int, str]], anywhere: int | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int, str]]] = {}
        for n, name in names:
            if anywhere is not None:
                if len(name) >= anywhere:
                    owners.setdefault(name.lower(), []).append((n, len(name), "anywhere"))
                continue
            words, links = forms(name)
            for kind, spelled in (("words", words), ("link", links)):
                for s in spelled:
                    owners.setdefault(s, []).append((n, len(name), kind))
        for s, of in owners.items():
            self.automaton.add_word(s, (len(s), of))
        if owners:
            self.automaton.make_automaton()
        self.anywhere = anywhere is not None

    def found(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(n, the name's length, start, end, kind) of every place where a name is; places in the text itself."""
        if not len(self.automaton) or not text:
            return []
        low, places = folded(text, squeeze=not self.anywhere)
        out = []
        for last, (size, of) in self.automaton.iter(low):
            start = last - size + 1
            for n, length, kind in of:
                if kind == "anywhere" or _free(low, start, last + 1, _word if kind == "words" else _link):
                    out.append((n, length, places[start], places[last] + 1, kind))
        return out

    def scrubbed(self, text: str) -> str:
        """Names replaced by ``<PERSON_n>``, in links by ``person-n``; longer names first, then those listed first."""
        taken = bytearray(len(text))
        chosen = []
        for n, length, a, b, kind in sorted(self.found(text), key=lambda x: (-x[1], x[0], x[4] != "words", x[2])):
            # a link is in lower case already; the same letters in capitals are words or nothing
            if not any(taken[a:b]) and (kind == "words" or text[a:b] == text[a:b].lower()):
                taken[a:b] = b"\x01" * (b - a)
                chosen.append((a, b, f"<PERSON_{n}>" if kind == "words" else f"person-{n}"))
        for a, b, token in sorted(chosen, reverse=True):
            text = text[:a] + token + text[b:]
        return text


def shards(names: DataFrame, how: Listing) -> list[list[tuple[int, str]]]:
    """The list (n, name), longer names first, in shards."""
    rows = names.where("trim(name) <> ''").orderBy(F.length("name").desc(), "n").select("n", "name")
    return _dealt([(r.n, r.name) for r in rows.toLocalIterator()], how.shard)


def _dealt(rows: list, size: int) -> list[list]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def cells(rows: DataFrame, key: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, cell, value): every cell of every column but the key as text, in one pass. Nulls are left out."""
    named = [F.struct(F.lit(c).alias("cell"), F.col(c).cast("string").alias("value")) for c in rows.columns if c != key and c not in skip]
    return rows.select(key, F.explode(F.array(*named)).alias("c")).select(key, "c.cell", "c.value").where("value is not null")


def occurrences(named: DataFrame, names: DataFrame, anywhere: bool = False, how: Listing = Listing()) -> DataFrame:  # noqa: B008
    """The rows of (..., value) with each listed name (n, start, end, kind) in them; places are code points, end exclusive."""
    kept = [c for c in named.columns if c != "value"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "value") + ", n long, start int, `end` int, kind string"

    def of(shard: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shard, how.anywhere_chars if anywhere else None)
            for batch in batches:
                row, hits = [], []
                for k, value in enumerate(batch.column(batch.schema.get_field_index("value")).to_pylist()):
                    for n, _, a, b, kind in matcher.found(value or ""):
                        row.append(k), hits.append((n, a, b, kind))
                part = batch.select(kept).take(pa.array(row, pa.int64()))
                told = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=[*kept, "n", "start", "end", "kind"])

        return named.mapInArrow(run, ddl)

    every = [of(shard) for shard in shards(names, how)] or [of([])]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out


def scrub(rows: DataFrame, column: str, names: DataFrame, how: Listing = Listing()) -> DataFrame:  # noqa: B008
    """The rows, with listed names in a column replaced; a shard of longer names before one of shorter ones."""
    for shard in shards(names, how):

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shard)
            for batch in batches:
                k = batch.schema.get_field_index(column)
                told = pa.array([None if t is None else matcher.scrubbed(t) for t in batch.column(k).to_pylist()], pa.string())
                yield batch.set_column(k, batch.schema.field(k).with_type(pa.string()), told)

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def assert_none_listed(label: str, named: DataFrame, names: DataFrame, how: Listing = Listing()) -> None:  # noqa: B008
    """Raises if a listed name is left in any value."""
    left = occurrences(named, names, how=how).select("n").distinct().count()
    if left:
        raise ValueError(f"{label} still names {left} listed person(s)")
