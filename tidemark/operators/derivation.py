"""A release from raw documents: one scan, one parsed parent, three outputs and every counter.

The parent has a row for each document with its events as an array, and is written once; what a document that can't be
read leaves is a row without events. Counters are observed while the tables are written, so nothing is scanned to be
counted. Histories are folded as windows over one row for each publication: an event sees the publications before its
own, never its own other events, and the company's founding up to its own day.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import canonical, dates, domain, redaction
from tidemark.operators import releases
from tidemark.sources import gazette

# Wording of technology, and of holdings, in a statutory purpose; labels of preferred shares; a public company's form.
TECH = (
    r"(?iu)(?<![A-Za-z0-9_])(?:software|logiciels?|numériques?|informatik|informatique|informatica|digitale?n?(?![A-Za-z0-9_])|digital(?:isierung|isation)|(?:online-|software-|digitale\s)?plattform|plateforme (?:numérique|digitale|en ligne|logicielle)|piattaform[ae] digital"
    r"|technologie[ns]?|technologique|tecnologi[ae]|KI(?![A-Za-z0-9_])|IA(?![A-Za-z0-9_])|künstliche[nr]? Intelligenz|intelligence artificielle|intelligenza artificiale|artificial intelligence|machine learning|Daten(?:analyse|verarbeitung|banken?|plattform)?(?![A-Za-z0-9_])|données|dati(?![A-Za-z0-9_])|data(?![A-Za-z0-9_])|cloud"
    r"|biotech|pharma|medizin(?:technik|produkte|ische)|médica(?:l|ux|ments?)|medicament|medtech|diagnosti|therapeuti|thérapeuti|Therapie(?:n|form)?(?![A-Za-z0-9_])|klinische|clinique|clinical|Genom(?:e?(?![A-Za-z0-9_])|ik|isch|sequenz)|génom|genomic|molekular|moléculaire|molecolar|Zell(?:therapie|linien|kultur)|cellulaire|protein|protéin|antikörper|anticorps"
    r"|[A-Za-z0-9_]*sensor(?:en|ik)?(?![A-Za-z0-9_])|capteurs?|robot|drohnen?|drones?|batterie|wasserstoff|hydrogène|quanten|quantique|quantum|photoni|laser|halbleiter|semi-?conduct|forschung und entwicklung|recherche et (?:le )?développement|ricerca e sviluppo|research and development|fintech|blockchain|kryptow|crypto)"
)
HOLDING = r"(?iu)(?<![A-Za-z0-9_])(?:Holding|Halten(?:,| und| von)[^.]{0,40}Beteiligungen|Verwaltung von Beteiligungen|Erwerb[^.]{0,30}Beteiligungen|détention[^.]{0,40}participations|gestion de participations|prise de participations|detenzione[^.]{0,40}partecipazioni|gestione di partecipazioni)"
PREFERRED = r"(?iu)Vorzug|privilégi|privilegi|Serie|Série|Seed"
PUBLIC_FORM = "0106"
#: The clauses that are evidence for an event of a kind.
EVIDENCE = {
    "capital_change": ("capital", "shares", "contribution", "band", "conversion"), "conversion_to_ag": ("conversion", "capital", "shares"), "capital_band": ("band",),
    "formation": ("purpose", "capital", "shares"), "name_change": ("name",), "cancellation": ("correction", "other"),
}


@dataclass(frozen=True)
class Plan:
    """What a release covers, and the scorer whose answers it uses."""

    snapshot: str
    backfill_start: str
    model: str = ""
    prompt: str = ""
    rules_threshold: float = domain.RULES_THRESHOLD


@dataclass
class Derived:
    """The outputs; ``counters`` is filled as they are written."""

    rows: dict[str, DataFrame]
    parent: DataFrame
    seen: dict[str, Observation] = field(default_factory=dict)

    def counters(self) -> dict[str, int]:
        """All counters of what has been written so far; waits for none."""
        return {name: int(value or 0) for seen in self.seen.values() for name, value in seen.get.items()}


def parse(raw: DataFrame, path: str) -> Derived:
    """The parsed parent of raw documents (xml), written to a path by one scan of them. Rows with ``failed`` could not be read."""
    published = gazette.publications(raw)
    failed = F.col("id").isNull() | F.col("number").isNull() | F.col("published_at").isNull()
    told = gazette.parsed(published).withColumn("failed", failed)
    told = told.withColumn("events", F.when(failed, F.array().cast(told.schema["events"].dataType)).otherwise(F.col("events")))
    seen = Observation(f"parsed-{uuid.uuid4().hex}")
    told.observe(seen, F.count(F.lit(1)).alias("publications"), F.count_if("failed").alias("parse_failures")).write.mode("overwrite").parquet(path)
    return Derived({}, raw.sparkSession.read.schema(told.schema).parquet(path), {"parsed": seen})


def _of_kind(kind: str) -> Column:
    return F.filter("events", lambda e: e["type"] == kind)


def _preferred(classes: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(classes, lambda c: c["label"].rlike(PREFERRED)), lambda c: F.lower(c["label"])))


def folded(parent: DataFrame, founding: DataFrame | None = None) -> DataFrame:
    """Good publications with ``context``: the state before each, and the names so far. ``founding``: (uid, founded_on) known from elsewhere."""
    rows = parent.where("not failed and uid is not null")
    step = F.element_at(_of_kind("capital_change"), -1)
    state = F.when(F.size(_of_kind("capital_change")) > 0, F.struct(step["capital_after"].alias("capital_after"), step["shares_after"].alias("shares_after"), F.col("after_classes").alias("classes")))
    band = F.element_at(_of_kind("capital_band"), -1)
    own = rows.select("*", state.alias("_step"), F.when(F.size(_of_kind("capital_band")) > 0, band["band_action"] != "removed").alias("_band"), (F.size(_of_kind("conversion_to_ag")) > 0).alias("_converted"), F.when(F.size(_of_kind("formation")) > 0, F.col("legal_at")).alias("_founded"))
    w = Window.partitionBy("uid").orderBy("published_at", "number", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    days = Window.partitionBy("uid").orderBy("published_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = own.select(
        "*", F.last("_step", ignorenulls=True).over(before).alias("_previous"), F.coalesce(F.last("_band", ignorenulls=True).over(before), F.lit(False)).alias("prior_band"),
        F.coalesce(F.max("_converted").over(before), F.lit(False)).alias("converted_before"), F.first("_founded", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_formed"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_set(F.array_compact(F.array("name", "name_before"))).over(days)))).alias("names"),
    )
    if founding is not None:
        told = told.join(founding.select("uid", F.col("founded_on").alias("_known")), "uid", "left")
    known = F.when(F.col("_known") <= F.col("published_at"), F.col("_known")) if founding is not None else F.lit(None).cast("date")
    founded = F.coalesce("_formed", known)
    return told.select(*parent.columns, "names", "prior_band", "converted_before", "_previous", founded.alias("founded_on"), dates.age_bucket(founded, F.col("legal_at")).alias("age_bucket"))


def _context(e: Column) -> tuple[Column, Column, Column]:
    """(shares before, their source, whether a preferred class is new) of a capital step, from its entry or from the step before it."""
    previous, after, stated = F.col("_previous"), F.col("after_classes"), F.col("before_classes")
    nominals = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["nominal"])))
    no_split = (F.size(previous["classes"]) <= 0) | (F.size(after) <= 0) | (nominals(previous["classes"]) == nominals(after))
    continuous = F.coalesce((previous["capital_after"] == e["capital_before"]) & no_split, F.lit(False))
    carried = F.when(continuous, previous["shares_after"])
    source = F.when(e["shares_before"].isNotNull(), "entry").when(carried.isNotNull(), "previous_event").otherwise("unknown")
    base = F.when(F.size(stated) > 0, stated).when(continuous & (F.size(previous["classes"]) > 0), previous["classes"])
    new = F.when((F.size(after) > 0) & base.isNotNull(), F.size(F.array_except(_preferred(after), _preferred(base))) > 0)
    return F.coalesce(e["shares_before"], carried), source, new


def conditions(e: Column, shares_before: Column, new_preferred: Column) -> dict[str, Column]:
    """When each rule of the catalogue fires for a capital step of a folded publication. An unknown age fires none."""
    growth = F.when(e["currency_before"].isNotNull(), F.lit(0)).otherwise(e["capital_after"].try_cast("decimal(20,2)") - e["capital_before"].try_cast("decimal(20,2)"))
    least = F.array_min(F.transform("after_classes", lambda c: c["nominal"].try_cast("decimal(20,4)")))
    opening = F.get(F.split("purpose", r"(?<=[.;])\s+(?=[A-ZÄÖÜÉÈ])"), F.lit(0))
    rise = e["shares_after"] - shares_before
    return {
        "odd_amount_small_nominal": (least <= domain.SMALL_NOMINAL) & (growth > 0) & ~domain.is_round(growth, 1_000), "young_company": F.col("age_bucket").isin("under_2", "2_to_6"), "tech_purpose": F.col("purpose").rlike(TECH), "new_preferred_class": new_preferred,
        "round_amount_holding": opening.rlike(HOLDING) & ~opening.rlike(TECH) & domain.is_round(growth, 10_000), "esop_sized_increment": (rise > 0) & ~F.coalesce(new_preferred, F.lit(False)) & (rise / e["shares_after"] < domain.ESOP_FRACTION),
        "set_off_only": e["contribution"] == "set_off", "in_kind_only": e["contribution"] == "in_kind", "conditional_capital_issuance": e["contribution"] == "conditional_capital", "reserves_funded": e["from_reserves"], "conversion_from_gmbh": e["with_conversion"],
        "restructuring_pair": e["restructuring_pair"], "capital_reduction": e["direction"] == "reduction",
    }


def model_input(e: Column, shares_before: Column, new_preferred: Column, fired: Column) -> Column:
    """What the scorer is asked about a step: facts and a purpose without names, and no text of the entry."""
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    clean = lambda t: redaction.redacted(t, F.col("names"), F.col("seat"))
    classes = F.transform("after_classes", lambda c: F.struct(c["count"].alias("count"), c["nominal"].alias("nominal"), c["label"].rlike(PREFERRED).alias("preferred")))
    before = F.when(e["currency_before"].isNotNull(), F.concat_ws(" ", e["capital_before"], e["currency_before"], F.lit("(capital currency changed)"))).otherwise(e["capital_before"])
    return F.struct(
        F.lit("AG/SA").alias("legalForm"), F.col("canton").alias("canton"), F.col("age_bucket").alias("companyAge"), before.alias("nominalCapitalBefore"), e["capital_after"].alias("nominalCapitalAfter"), unknown(shares_before).alias("sharesBefore"), unknown(e["shares_after"]).alias("sharesAfter"),
        classes.alias("shareClassesAfter"), unknown(new_preferred).alias("newPreferredClass"), e["contribution"].alias("contribution"), F.col("prior_band").alias("withinCapitalBand"), e["with_conversion"].alias("duringConversionFromGmbH"), clean(F.coalesce("purpose", F.lit(""))).alias("purpose"), fired.alias("firedRules"),
    )


def derive(derived: Derived, plan: Plan, answers: DataFrame, founding: DataFrame | None = None) -> Derived:
    """Events, names and assessments of a parsed parent, as of the snapshot.

    ``answers`` is the scorer's cache: (input_hash, model, prompt, score, error). A candidate without an answer, or with
    an error, abstains and counts as a scorer error; a refusal abstains and does not.
    """
    rows = folded(derived.parent.where(F.col("published_at") <= F.lit(plan.snapshot).cast("date")), founding)
    names = rows.select("uid", "name", "published_at", F.col("id").alias("publication_id")).where("name is not null")

    each = rows.select(*rows.columns, F.explode_outer("events").alias("e")).where("e is not null")
    e = F.col("e")
    shares, source, new = _context(e)
    step = e["type"] == "capital_change"
    each = each.withColumn("_shares", F.when(step, shares)).withColumn("_source", F.when(step, source)).withColumn("_new", F.when(step, new))
    wanted = F.create_map(*[x for k, kinds in EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, kinds)))])
    spans = F.transform(F.filter("clauses", lambda c: F.array_contains(wanted[e["type"]], c["kind"])), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    broken = F.size(F.filter(spans, lambda s: (s["start"] < 0) | (s["end"] > F.length("text")) | (s["start"] >= s["end"])))
    own = [f for f in each.schema["e"].dataType.names if f != "shares_before"]
    events = each.select(
        *[e[f].alias(f) for f in own], F.col("id").alias("publication_id"), "number", "uid", "published_at", "legal_at", "canton", F.col("_shares").alias("shares_before"), F.col("_source").alias("shares_source"), F.col("_new").alias("new_preferred_class"),
        F.when(step, F.col("age_bucket")).alias("age_bucket"), F.when(step, F.col("prior_band")).alias("prior_band"), F.when(step, F.col("converted_before")).alias("converted_before"), F.when(step, redaction.excerpt(F.col("text"), F.col("clauses"))).alias("excerpt"), spans.alias("spans"), broken.alias("_broken"),
    )

    rises = each.where(step & (e["direction"] == "increase") & (F.col("published_at") >= F.lit(plan.backfill_start).cast("date")))
    when = conditions(e, F.col("_shares"), F.col("_new"))
    judged = rises.select(
        e["event_id"].alias("event_id"), domain.hits(when).alias("rule_hits"), domain.score(when).alias("rules_score"), domain.reject_reason(F.coalesce("legal_form", F.lit("")), e["restructuring_pair"], e["direction"]).alias("reject_reason"),
        model_input(e, F.col("_shares"), F.col("_new"), domain.hits(when)).alias("input"),
    )
    judged = judged.withColumn("candidate", F.col("reject_reason").isNull()).withColumn("input_hash", F.when(F.col("candidate"), canonical.fingerprint(F.col("input"))))
    known = answers.where((F.col("model") == plan.model) & (F.col("prompt") == plan.prompt)).select("input_hash", "score", "error").dropDuplicates(["input_hash"])
    told = judged.join(known.withColumn("_told", F.lit(True)), "input_hash", "left")
    refused = F.coalesce(F.col("error") == "refusal", F.lit(False))
    failed = F.col("candidate") & (F.col("_told").isNull() | (F.col("error").isNotNull() & ~refused))
    tier = F.when(~F.col("candidate"), "capital_increased").when(failed, "abstain").otherwise(domain.tier(F.col("score"), refused))
    assessments = told.select("event_id", tier.alias("tier"), "rule_hits", "rules_score", (F.col("candidate") & (F.col("rules_score") >= plan.rules_threshold)).alias("rules_positive"), "reject_reason", "input_hash", F.col("candidate").alias("_candidate"), failed.alias("_failed"))

    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("events", "names", "assessments")}
    events = events.observe(seen["events"], F.count(F.lit(1)).alias("events"), F.sum("_broken").alias("span_violations")).drop("_broken")
    names = names.observe(seen["names"], F.count(F.lit(1)).alias("names"))
    assessments = assessments.observe(seen["assessments"], F.count(F.lit(1)).alias("assessments"), F.count_if("_candidate").alias("candidates"), F.count_if("_failed").alias("scorer_errors")).drop("_candidate", "_failed")
    return Derived({"events": events, "names": names, "assessments": assessments}, derived.parent, derived.seen | seen)


@dataclass(frozen=True)
class Built:
    release: str
    activated: bool
    failures: list[str]
    counters: dict[str, int]


def build(store: releases.Store, release: str, raw: DataFrame, plan: Plan, answers: DataFrame, has_eval: bool, founding: DataFrame | None = None, dry: bool = False) -> Built:
    """Derives a release from raw documents, writes it, and makes it current if no gate fails. ``dry``: counts and gates, but writes no release.

    The gates are taken from what was observed while the release was written, so they hold for just those rows.
    """
    parsed = parse(raw, f"{store.path}/staging/{release}")
    derived = derive(parsed, plan, answers, founding)
    if dry:
        for df in derived.rows.values():
            df.write.format("noop").mode("overwrite").save()
    else:
        store.stage(release, derived.rows)
    counters = derived.counters()
    present = parsed.parent.where("not failed and sub_rubric = 'HR02'").select(F.col("published_at").alias("day"))
    missing = dates.missing_days(present, plan.backfill_start, plan.snapshot).count()
    failures = releases.gates(counters, missing, counters["span_violations"], has_eval)
    if not dry:
        store.close(release, failures)
    return Built(release, not failures and not dry, failures, counters)
