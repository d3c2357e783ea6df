"""Gazette documents: XML to typed events, in expressions.

Texts are German, French or Italian. Former text in brackets is read as the state before and nothing else.
A document that lacks its id, number or day goes to the quarantine side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clauses as clause
from tidemark.functions import dates, text

#: Wording of the events, in three languages.
BAND = r"(?i)Kapitalband|marge de fluctuation|margine di variazione"
BAND_GONE = r"(?i)aufgehoben|supprimé|soppresso"
SET_OFF = (
    r"(?iu)Verrechnung (?:einer |von |der )?Forderung|Forderung(?:en)?(?![A-Za-z0-9_])[\s\S]{0,160}?(?:verrechnet|zur Verrechnung(?!\s+mit\s+(?:dem\s+|den\s+)?(?:Bilanzverlust|Verlust|Unterbilanz)))"
    r"|durch Verrechnung(?! mit)|compensation (?:de |d['’]une |des )créances?|compensazione (?:di |del |dei )credit"
)
IN_KIND = r"(?iu)Sacheinlage|Sachübernahme|apport en nature|reprise de biens|conferimento in natura|assunzione di beni"
CONDITIONAL = r"(?iu)aus bedingtem (?:Aktien)?Kapital|au moyen d['’]un capital conditionnel|mediante (?:il )?capitale condizionale"
CASH = r"(?iu)\bin bar\b|en espèces|in contanti"
REDUCTION = r"(?iu)Kapitalherabsetzung|réduction (?:ordinaire )?du capital|riduzione (?:ordinaria )?del capitale"
AT_ONCE = r"(?iu)gleichzeitig|Wiedererhöhung|simultané|immédiatement|contemporaneamente"
RESERVES = r"(?iu)frei verwendbare[sn]? Eigenkapital|Umwandlung von Reserven|incorporation de réserves|capitale proprio liberamente disponibile"
CORRECTION = r"(?i)^(?:Berichtigung|Rectification|Rettifica)\b"
CANCELLED = r"(?iu)(?:annulliert|aufgehoben|annulée?|annullata)[^0-9]{0,200}([0-9]{10})"
#: Notices that a clause or a qualified fact was removed, or that shares were paid up later; they tell of other events.
REMOVED = r"(?iu)^(?:Suppression de la|Radiation de la|Streichung der|Soppressione della|Die Bestimmung über die (?:Sacheinlage|Sachübernahme)|Nachträgliche (?:Voll)?[Ll]iberierung|Le capital-actions a été libéré ultérieurement|libéré ultérieurement)"
ITEMS = r"(\d[\d’']*)\s+([^\d,;\[\]]*?(?:[Aa]ktien|actions?|azioni)[^\d,;\[\]]*?)\s*(?:zu|de|da)\s+(CHF|EUR|USD|GBP)\s+([\d’'.]*\d)"
#: Where a text states its shares (now, formerly), by language; the second wording states them without a "before".
STATED = {
    "de": (r"Aktien neu:\s*([^\[]*?)(?:\[bisher:\s*([^\]]*)\]|\.\s+(?=[A-ZÄÖÜ])|$)", r"Aktien:\s*([\s\S]*?)(?:\.\s+(?=[A-ZÄÖÜ])|\.?$)"),
    "fr": (r"Nouvelles actions:\s*([^\[]*?)(?:\[précédemment:\s*([^\]]*)\]|\.\s+(?=[A-ZÉÈ])|$)", r"divisé en\s+([\s\S]*?)(?:\.\s+(?=[A-ZÉÈ])|\.?$)"),
    "it": (r"Nuove azioni:\s*([^\[]*?)(?:\[finora:\s*([^\]]*)\]|\.\s+(?=[A-Z])|$)", r"suddiviso in\s+([\s\S]*?)(?:\.\s+(?=[A-Z])|\.?$)"),
}
#: A split of shares, participation capital, issued shares, shares set off, notices of an adoption, a change of currency.
RESPLIT = r"Les\s+(\d[\d’']*\s+actions[^.]*?de\s+(?:CHF|EUR|USD|GBP)\s+[\d’'.]*\d)\s+sont transformées en\s+([\s\S]*?)(?:\.\s+(?=[A-ZÉÈ])|\.?$)"
PARTICIPATION = r"(?i)^\s*\d[\d’']*\s+(?:bons|Namen-Partizipationsscheine|Partizipationsscheine|buoni)"
ISSUED = r"(?i)(?:par l['’]émission de|émission de|Ausgabe von|emissione di)\s+([\s\S]*?)(?:,\s*(?:dont|toutes|entièrement|libérées)|\.\s+(?=[A-ZÉÈÄÖÜ])|\.?$)"
ISSUED_COUNT = r"(?i)^(\d[\d’']*)\s+(?:nouvelles\s+)?(?:actions|Aktien|Namenaktien|Inhaberaktien|azioni)\b"
SET_OFF_SHARES = r"(?iu)(?:wofür|il est remis|per cui)\s+(\d[\d’']*)\s+(?:[\p{L}-]+\s+){0,3}?(?:Namenaktien|Inhaberaktien|Aktien|actions|azioni)|dont\s+(\d[\d’']*)\s+actions[^,;.]{0,60}?libérées? par compensation"
ADOPTION = r"(?iu)(?<![\p{L}])(?:beschlossen|eingeführt|geändert|aufgehoben|introduit une clause|modifié une clause|supprimé une clause|ha introdotto|ha modificato|ha soppresso)(?![\p{L}])"
REDENOMINATION = r"(?iu)monnaie du capital[\s\S]{0,200}?(?:a été )?converti|Währung des (?:Aktien)?[Kk]apitals[\s\S]{0,200}?(?:umgestellt|umgewandelt|geändert)|Umstellung (?:der Währung|des Aktienkapitals auf)|valuta del capitale[\s\S]{0,200}?convertit"
CURRENCY_BEFORE = r"(?iu)monnaie du capital-actions de\s+(CHF|EUR|USD|GBP)\b"


#: Where each field of a document stands, whatever the root's prefix.
PATHS = {
    "id": "meta/id", "sub_rubric": "meta/subRubric", "language": "meta/language", "number": "meta/publicationNumber", "day": "meta/publicationDate", "cantons": "meta/cantons", "journal_day": "content/journalDate", "text": "content/publicationText",
    "uid": "commonsNew/company/uid", "name": "commonsNew/company/name", "legal_form": "commonsNew/company/legalForm", "name_before": "commonsActual/company/name", "legal_form_before": "commonsActual/company/legalForm", "purpose": "commonsNew/purpose", "seat": "commonsNew/company/seat",
    "capital_after": "commonsNew/capital/nominal", "capital_before": "commonsActual/capital/nominal", "flagged": "capitalChanged/nominal",
}
# A character that no XML document can hold, not even as a reference.
_BETWEEN = "\uffff"


def fields(xml: Column) -> Column:
    """Array of the trimmed texts at ``PATHS``, in their order; null where one is missing or blank. A document is read once for all of them.

    A path in ``concat`` stands for the text of its first place in the document.
    """
    every = "concat(" + f",'{_BETWEEN}',".join(f"//{path}" for path in PATHS.values()) + ")"
    return F.transform(F.split(F.xpath_string(xml, F.lit(every)), _BETWEEN), lambda x: F.nullif(F.trim(x), F.lit("")))


def publications(raw: DataFrame) -> DataFrame:
    """(xml) to one row for each document, numbers as their decimal text."""
    at = {name: F.get("_fields", F.lit(k)) for k, name in enumerate(PATHS)}
    same = lambda *names: [at[name].alias(name) for name in names]
    return raw.select(fields(F.col("xml")).alias("_fields")).select(
        *same("id", "sub_rubric", "language", "number"), F.substring(at["day"], 1, 10).try_cast("date").alias("published_at"), F.get(F.split(at["cantons"], r"[ ,]"), F.lit(0)).alias("canton"),
        F.substring(at["journal_day"], 1, 10).try_cast("date").alias("journal_at"), F.coalesce(at["text"], F.lit("")).alias("text"), text.uid(at["uid"]).alias("uid"), *same("name", "legal_form", "name_before", "legal_form_before", "purpose", "seat"),
        text.plain_number(at["capital_after"]).alias("capital_after"), text.plain_number(at["capital_before"]).alias("capital_before"), (at["flagged"] == "true").alias("flagged"),
    )


def split(published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    good = F.col("id").isNotNull() & F.col("number").isNotNull() & F.col("published_at").isNotNull()
    return published.where(good), published.where(~good)


def active(body: Column) -> Column:
    """What the entry does: without former text in brackets and without notices of removed clauses."""
    said = F.filter(F.transform(clause.spans(body), lambda c: c["text"]), lambda t: ~t.rlike(REMOVED))
    return F.regexp_replace(F.array_join(said, " "), r"\[[^\]]*\]", " ")


def clauses(published: DataFrame) -> DataFrame:
    """(id, seq, kind, clause, start, end): the clauses of each text with their place in it; no exchange."""
    parts = published.select("id", F.posexplode(clause.clauses(F.coalesce("text", F.lit("")))).alias("seq", "c"))
    return parts.select("id", "seq", "c.kind", F.col("c.text").alias("clause"), "c.start", "c.end")


def share_classes(body: Column) -> Column:
    """Array of (count, nominal, currency, label)."""
    part = lambda k: F.regexp_extract_all(body, F.lit(ITEMS), k)
    return F.transform(
        F.arrays_zip(part(1).alias("n"), part(2).alias("label"), part(3).alias("currency"), part(4).alias("nominal")),
        lambda x: F.struct(text.plain_number(x["n"]).try_cast("long").alias("count"), text.plain_number(x["nominal"]).alias("nominal"), x["currency"].alias("currency"), F.trim(x["label"]).alias("label")),
    )


def _first_in(body: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))


def share_segments(body: Column, language: Column) -> Column:
    """(after, before): the last statement of the shares, and the first "before" of a text that may state them several times.

    Statements are found by wording and put in the order of the text. Participation capital is no share. A text in
    another language is read as German.
    """
    none = F.lit(None).cast("string")

    def said(pattern: str, now: int, former: int | None) -> Column:
        after = F.regexp_extract_all(body, F.lit(pattern), now)
        before = F.regexp_extract_all(body, F.lit(pattern), former) if former else F.transform(after, lambda _: none)
        # what stands before the i-th mark is as long as that statement's place
        parts = F.split(F.regexp_replace(F.replace(body, F.lit("\x01"), F.lit(" ")), f"({pattern})", "\x01$1"), "\x01")
        rows = F.arrays_zip(after.alias("after"), before.alias("before"))
        placed = F.transform(rows, lambda x, i: F.struct(F.length(F.array_join(F.slice(parts, 1, i + 1), "")).alias("at"), x["after"].alias("after"), F.nullif(x["before"], F.lit("")).alias("before")))
        return F.filter(placed, lambda x: ~x["after"].rlike(PARTICIPATION))

    def of(name: str) -> Column:
        primary, other = STATED[name]
        return F.array_sort(F.concat(said(RESPLIT, 2, 1), said(primary, 1, 2), said(other, 1, None)))

    found = F.when(language == "fr", of("fr")).when(language == "it", of("it")).otherwise(of("de"))
    first, last = F.get(found, F.lit(0)), F.element_at(found, -1)
    before = F.when(F.size(found) > 1, F.coalesce(first["before"], first["after"])).when(F.size(found) == 1, first["before"])
    return F.struct(F.when(F.size(found) > 0, last["after"]).alias("after"), before.alias("before"))


def issued_shares(body: Column) -> Column:
    """Shares issued as stated, summed over classes; quotas are no shares. Null where none are stated."""
    said = _first_in(body, ISSUED, 1)
    classes = share_classes(said)
    total = F.aggregate(classes, F.lit(0).cast("long"), lambda s, x: s + x["count"])
    return F.when(F.size(classes) > 0, total).otherwise(text.plain_number(_first_in(F.trim(said), ISSUED_COUNT, 1)).try_cast("long"))


def currency_before(body: Column, before_classes: Column, after_classes: Column) -> Column:
    """The capital's former currency if this entry changes it: from the classes, or from what a French text says."""
    now = F.transform(after_classes, lambda c: c["currency"])
    other = F.get(F.filter(F.transform(before_classes, lambda c: c["currency"]), lambda c: ~F.array_contains(now, c)), F.lit(0))
    return F.coalesce(F.when(F.size(now) > 0, other), F.when(body.rlike(REDENOMINATION), _first_in(body, CURRENCY_BEFORE, 1)))


def contribution(body: Column, issued: Column | None = None) -> Column:
    """How an increase was paid; cash if nothing else is said.

    A set-off for fewer shares than were issued leaves the rest to cash. A clause that only adopts conditional capital issues nothing.
    ``body`` is the active text.
    """
    set_off, in_kind = body.rlike(SET_OFF), body.rlike(IN_KIND)
    covered = text.plain_number(F.coalesce(_first_in(body, SET_OFF_SHARES, 1), _first_in(body, SET_OFF_SHARES, 2))).try_cast("long")
    partial = F.coalesce(covered < issued, F.lit(False)) if issued is not None else F.lit(False)
    conditional = F.exists(clause.spans(body), lambda c: c["text"].rlike(CONDITIONAL) & ~c["text"].rlike(ADOPTION))
    return F.when((set_off | in_kind) & (body.rlike(CASH) | partial), "mixed").when(set_off, "set_off").when(in_kind, "in_kind").when(conditional, "conditional_capital").otherwise("cash")


def _read(published: DataFrame) -> DataFrame:
    """Each publication with the kinds of its events, in their fixed order, and what they are made of."""
    stated = share_segments(F.col("text"), F.col("language"))
    now = published.withColumn("now", active(F.col("text"))).withColumn("stated", stated)
    now = now.withColumn("after_classes", share_classes(F.col("stated.after"))).withColumn("before_classes", share_classes(F.col("stated.before"))).withColumn("issued", issued_shares(F.col("now")))
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["count"]))
    a, b = F.col("capital_after").try_cast("decimal(20,2)"), F.col("capital_before").try_cast("decimal(20,2)")
    same_day = F.col("now").rlike(REDUCTION) & F.col("now").rlike(AT_ONCE)
    direction = F.when(same_day & (a == b), "unchanged").when(a > b, "increase").when(a < b, "reduction").otherwise("unchanged")
    shares_after, stated_before = total(F.col("after_classes")), total(F.col("before_classes"))
    # what is not stated follows from what was issued, if that leaves a count
    rest = F.when((direction == "increase") & ~same_day & (shares_after >= F.col("issued")), shares_after - F.col("issued"))
    shares_before = F.coalesce(stated_before, rest)
    # A changed capital is an event; an unchanged one only if shares were redrawn or cancelled and reissued.
    changed = (F.col("sub_rubric") != "HR01") & a.isNotNull() & b.isNotNull() & ((direction != "unchanged") | same_day | (shares_after != shares_before))
    cancels = F.nullif(F.regexp_extract("now", CANCELLED, 1), F.lit(""))
    band = F.col("now").rlike(BAND)
    kinds = F.array(
        F.when(cancels.isNotNull(), "cancellation"), F.when((F.col("sub_rubric") == "HR01") & ~F.col("now").rlike(r"(?i)Sitzverlegung|transfert de siège|trasferimento"), "formation"),
        F.when((F.col("legal_form_before") == "0107") & (F.col("legal_form") == "0106"), "conversion_to_ag"), F.when(changed, "capital_change"), F.when(band, "capital_band"), F.when(F.col("name") != F.col("name_before"), "name_change"),
    )
    statute = dates.swiss_day(F.regexp_extract("now", r"(?iu)((?:Statuten|Statuts|Statuti)[^.]{0,60}\d{1,2}[^,;]{0,30}\d{4})", 1))
    return now.select(
        *published.columns, "now", "issued", "after_classes", "before_classes", F.array_compact(kinds).alias("kinds"), direction.alias("direction"), shares_after.alias("shares_after"), shares_before.alias("shares_before"), cancels.alias("cancels"),
        F.when(band, F.when(F.col("now").rlike(BAND_GONE), "removed").otherwise("adopted")).alias("band_action"), dates.legal_day(statute, F.col("journal_at"), F.col("published_at")).alias("legal_at"),
    )


def _event(kind: Column, seq: Column) -> Column:
    """An event of a row of ``_read``; what belongs to other kinds is null."""
    of = lambda t, value: F.when(kind == t, value)
    step = lambda value: of("capital_change", value)
    how = F.when(F.col("direction") == "increase", contribution(F.col("now"), F.coalesce("issued", F.col("shares_after") - F.col("shares_before")))).otherwise("unknown")
    return F.struct(
        F.sha2(F.concat_ws(",", F.col("id"), seq.cast("string")), 256).alias("event_id"), seq.alias("seq"), kind.alias("type"), step(F.col("direction")).alias("direction"), step(F.col("capital_before")).alias("capital_before"), step(F.col("capital_after")).alias("capital_after"),
        step(F.col("shares_before")).alias("shares_before"), step(F.col("shares_after")).alias("shares_after"), step(how).alias("contribution"), step(F.col("now").rlike(RESERVES)).alias("from_reserves"), step(F.col("now").rlike(REDUCTION) & F.col("now").rlike(AT_ONCE)).alias("restructuring_pair"),
        step(F.col("issued")).alias("issued"), step(currency_before(F.col("now"), F.col("before_classes"), F.col("after_classes"))).alias("currency_before"), step(F.array_contains("kinds", "conversion_to_ag")).alias("with_conversion"), of("capital_band", F.col("band_action")).alias("band_action"),
        of("cancellation", F.col("cancels")).alias("cancels"), F.when(F.col("text").rlike(CORRECTION), F.nullif(F.regexp_extract("text", r"([0-9]{10})", 1), F.lit(""))).alias("corrects"), of("name_change", F.col("name_before")).alias("name_before"), of("name_change", F.col("name")).alias("name_after"),
    )


def parsed(published: DataFrame) -> DataFrame:
    """Each publication with its clauses and ``events``: an array of up to six, in their fixed order. No exchange."""
    kept = [*published.columns, "legal_at", "after_classes", "before_classes"]
    return _read(published).select(*kept, clause.clauses(F.col("text")).alias("clauses"), F.transform("kinds", _event).alias("events"))


def events(published: DataFrame) -> DataFrame:
    """(event_id, id, seq, uid, type, ...): up to six events of a document, in their fixed order."""
    # outer, so that the optimiser infers no filter that would read every text a second time
    rows = parsed(published).select("id", "number", "uid", "published_at", "legal_at", "canton", F.explode_outer("events").alias("e")).where("e is not null")
    first = ["event_id", "id", "number", "seq", "uid", "type", "published_at", "legal_at", "canton"]
    own = [c for c in rows.schema["e"].dataType.names if c not in first]
    return rows.select("e.event_id", "id", "number", "e.seq", "uid", "e.type", "published_at", "legal_at", "canton", *[f"e.{c}" for c in own])
