"""Clauses of a gazette text: one pass from left to right gives each clause, its kind and its place.

All are column expressions over one text: no window, no shuffle. Places are code points, end exclusive, so
``substring(text, start + 1, end - start)`` is the clause.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, whichever alphabet a text is in.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Abbreviations whose full stop ends no clause.
SHORT = "Nr|No|Publ|p|art|Art|al|ch|lit|bzw|ca|resp|S|N|Ziff|chiffre|cf|vgl|vol|St|Fr|sig|Mio|mio|Dr|Prof|Hr|M|Mme|ing|dipl|lic|rer|pol|oec|med|iur|phil|nat|techn|sc"
# What begins a clause after a full stop and white space: a capital, a bracket, or a name's particle.
OPENS = r"[A-ZÄÖÜÉÈÀÂÎÔÛ\[]|(?:von|van|de|di|da|d['’])" + SPACE + "*[A-ZÄÖÜÉÈ]"
# Identifiers of companies, and the heads of corrections.
UID = r"\bCHE-\d{3}\.\d{3}\.\d{3}\b"
CORRECTION = r"(?i)^(?:Berichtigung|Rectification|Rettifica)\b"
# What makes a clause one of persons, whatever else it says; with stems of which a text that fits has one, where looking for them is cheaper.
PERSON = (
    (r"(?i)^(?:Eingetragene Personen|Ausgeschiedene Personen|Personnes? (?:inscrite|radiée|et signature)|Personnes? inscrites?|Inscription ou modification de personne|Nouvelles personnes|Persone iscritte|Nuove persone|Persone radiate|Revisionsstelle|Organe de révision|Administration:)", ()),
    (r"(?i)\b(?:signe(?:nt)?|signature|unterzeichnet|Unterschrift|Zeichnungsberechtigung|firma (?:collettiva|individuale))\b", ("signe", "signature", "unterzeichnet", "unterschrift", "zeichnungsberechtigung", "firma ")),
    (r"(?i)\b(?:est|sont) (?:nommée?s?|maintenant|désormais|membres?|président|radiée?s?)\b|n'(?:est|sont) plus\b", ("est ", "sont ")),
    (r"\b(?:Staatsangehörige?r?|von [A-ZÄÖÜ][\p{L}-]+, in [A-ZÄÖÜ]|de [A-ZÉ][\p{L}-]+, à [A-ZÉ]|da [A-Z][\p{L}-]+, in [A-Z])", ("staatsangeh", ", in ", ", à ")),
    (r"(?i)\b(?:Mitglied|Präsident(?:in)?|Geschäftsführer(?:in)?|Prokurist(?:in)?|administrateur|administratrice|gérant|directeur|directrice|membro|presidente)\b", ("mitglied", "präsident", "geschäftsführer", "prokurist", "administrat", "gérant", "direct", "membro", "presidente")),
    (r"\bDr\.\s*(?:med\.\s*)?[A-ZÄÖÜ]", ("dr.",)),
)
# The other kinds, the first that fits counts.
KINDS = (
    ("correction", CORRECTION, ()),
    ("statutes", r"(?i)^(?:Statutenänderung|Statuten neu|Statuten:|Statuts modifiés|Modification des statuts|Nouveaux statuts|Statuts du|Statuts:|Statuti modificati|Nuovi statuti|Statuti:)", ()),
    ("purpose", r"(?i)^(?:Zweck neu|Zweck:|But:|Nouveau but|Scopo)", ()),
    ("name", r"(?i)^(?:Firma neu|Uebersetzungen der Firma|Übersetzungen der Firma|Nouvelle raison|Traductions de la raison|Nuova ragione)", ()),
    ("conversion", r"(?i)\b(?:Umwandlung|umgewandelt|Rechtsform neu|Transformation|transformée?|Nouvelle (?:forme|nature) juridique|trasformazione|trasformata)\b", ("umwandlung", "umgewandelt", "rechtsform neu", "transform", "juridique", "trasforma")),
    ("band", r"(?i)\b(?:Kapitalband|marge de fluctuation|margine di variazione)\b", ("kapitalband", "marge de", "margine di")),
    ("contribution", r"(?i)\b(?:Qualifizierte Tatbestände|Sacheinlage|Sachübernahme|Verrechnung|verrechnet|compensation de créance|apport en nature|reprise de biens|conferimento in natura|compensazione|bedingte[nms]? (?:Aktien)?[Kk]apital|capital conditionnel|augmentation conditionnelle|capitale condizionale)", ("qualifizierte", "sacheinlage", "sachübernahme", "verrechn", "compensa", "apport", "reprise", "conferimento", "bedingte", "condition", "condizionale")),
    ("shares", r"(?i)\b(?:Aktien neu|Namenaktien|Inhaberaktien|Partizipationsscheine|Nouvelles actions|actions (?:nominatives|au porteur|ordinaires|privilégiées)|divisé en|Nuove azioni|azioni nominative)", ("aktien neu", "namenaktien", "inhaberaktien", "partizipationsscheine", "actions", "divisé en", "azioni")),
    ("capital", r"(?i)\b(?:Aktienkapital|Stammkapital|Partizipationskapital|Liberierung|Kapitalerhöhung|Kapitalherabsetzung|Herabsetzung|capital-actions|capital social|capital-participation|augmentation|réduction|capitale azionario|aumento|riduzione)\b", ("kapital", "liberierung", "herabsetzung", "capital", "augmentation", "réduction", "aumento", "riduzione")),
)
# The five rules of personal data. A role is one of an owner or founder.
_ROLE = r"(?:associée?s?|associé-gérant|associée-gérante|actionnaires?|gérante?s?|fondateurs?|fondatrices?|Gesellschafter(?:in|innen)?|Aktionär(?:in|innen|e)?|Gründer(?:in|innen)?|socio|soci|azionisti?)"
_SOLE = r"(?:(?:unique|seule?|einzige[nr]?|unico|unica)\s+)?"
PERSONAL = {
    "register person format": r"\b[A-ZÄÖÜÉÈ][\p{L}'-]+, [A-ZÄÖÜÉÈ][\p{L}'-]+(?: [A-ZÄÖÜÉÈ][\p{L}'-]+)?, (?:von|de|da|aus) [A-ZÄÖÜÉÈ]",
    "role followed by a name": _ROLE + r"\s+" + _SOLE + r"[A-ZÄÖÜÉÈ][\p{L}'’-]+\s+[A-ZÄÖÜÉÈ][\p{L}'’-]+",
    "doctor title": r"\bDr\.\s*(?:med\.\s*)?[A-ZÄÖÜ][a-zäöü]",
    "care-of contact": r"c/o\s+[A-ZÄÖÜÉÈ][\p{L}'’-]+\s+[A-ZÄÖÜÉÈ]",
    "person clause": r"(?i)(?:Eingetragene Personen|Ausgeschiedene Personen|Personnes? inscrites?|Persone iscritte)",
}
_LETTER = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_LETTER})(?={_LETTER})|(?<={_LETTER})(?!{_LETTER}))"
_MARK = "\x01"


def java(pattern: str) -> str:
    """The pattern with word edges of ASCII letters and case folded in all alphabets, as the fixed values mean them."""
    return re.sub(r"\\b", lambda _: _EDGE, pattern.replace("(?i)", "(?iu)"))


def personal_data(body: Column) -> Column:
    """The names of the rules of personal data that a text meets."""
    return F.array_compact(F.array(*[F.when(body.rlike(java(p)), F.lit(rule)) for rule, p in PERSONAL.items()]))


def let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kind(clause: Column, place: Column, may: Column) -> Column:
    """Persons come before all but the header, which names the company first of all. ``may``: the rules that the whole text can meet."""
    kind, n = F.lit("other"), len(PERSON) + len(KINDS)
    ordered = [("person", p) for p, _ in PERSON] + [(name, p) for name, p, _ in KINDS]
    for k, (name, pattern) in zip(range(n - 1, -1, -1), reversed(ordered), strict=True):
        kind = F.when(F.get(may, F.lit(k)) & clause.rlike(java(pattern)), name).otherwise(kind)
    header = F.when(clause.rlike(java(CORRECTION)), "correction").otherwise("header")
    return F.when((place == 0) & clause.rlike(java(UID)), header).otherwise(kind)


def _may(body: Column) -> Column:
    """For each rule, whether the text has one of its stems."""
    stems = [s for _, s in PERSON] + [s for _, _, s in KINDS]
    return let(F.lower(body), lambda low: F.array(*[reduce(Column.__or__, [low.contains(s) for s in some], F.lit(not some)) for some in stems]))


def pieces(body: Column) -> Column:
    """The text cut after each full stop that ends a clause; joined they are the text."""
    ends = rf"\.(?<!(?<!{_LETTER})(?:{SHORT})\.)(?={SPACE}+(?:{OPENS}))"
    return F.split(F.regexp_replace(F.replace(body, F.lit(_MARK), F.lit(" ")), ends, "." + _MARK), _MARK)


def spans(body: Column) -> Column:
    """Array of (text, start): the clauses without their kinds."""

    def said(piece: Column, place: Column) -> Column:
        # the white space before a clause is no part of it, but for the first
        lead = F.when(place == 0, 0).otherwise(F.length(F.regexp_extract(piece, f"^{SPACE}+", 0)))
        return F.struct(F.substring(piece, lead + 1, F.length(piece)).alias("text"), lead.alias("lead"), F.length(piece).alias("size"))

    def placed(rows: Column) -> Column:
        """Each piece with the length of all before it."""
        begins = F.aggregate(rows, F.array(F.lit(0)), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x["size"])))
        return F.zip_with(rows, F.slice(begins, 1, F.size(rows)), lambda x, at: F.struct(x["text"].alias("text"), (at + x["lead"]).alias("start")))

    ended = F.regexp_replace(body, f"{SPACE}+$", "")
    return F.filter(let(F.transform(pieces(ended), said), placed), lambda x: x["text"] != "")


def clauses(body: Column) -> Column:
    """Array of (kind, text, start, end). A blank text has none, a null one null."""

    def told(rows: Column, may: Column) -> Column:
        one = lambda x, k: F.struct(_kind(x["text"], k, may).alias("kind"), x["text"].alias("text"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"))
        return F.transform(rows, one)

    def headed(rows: Column) -> Column:
        """The company's header may come second, after the notice of a correction."""
        second = lambda x, k: (k == 1) & (F.get(rows, F.lit(0))["kind"] == "correction") & x["text"].rlike(java(UID))
        return F.transform(rows, lambda x, k: F.when(second(x, k), x.withField("kind", F.lit("header"))).otherwise(x))

    both = F.struct(spans(body).alias("rows"), _may(body).alias("may"))
    return F.when(body.isNotNull(), let(let(both, lambda x: told(x["rows"], x["may"])), headed))
