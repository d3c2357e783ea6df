"""Rules, tiers and statuses as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the tiers and of the rules.
TAU, TAU_LOW, RULES_THRESHOLD, SMALL_NOMINAL, ESOP_FRACTION = 0.6, 0.35, 1.0, 1, 0.02


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    weight: float


#: The rule catalogue.
RULES = (
    Rule("odd_amount_small_nominal", "positive", 1.0),
    Rule("young_company", "positive", 0.5),
    Rule("tech_purpose", "positive", 0.5),
    Rule("new_preferred_class", "positive", 1.5),
    Rule("round_amount_holding", "negative", -1.0),
    Rule("esop_sized_increment", "negative", -1.0),
    Rule("set_off_only", "negative", -1.5),
    Rule("in_kind_only", "negative", -1.5),
    Rule("conditional_capital_issuance", "negative", -1.0),
    Rule("reserves_funded", "negative", -1.5),
    Rule("conversion_from_gmbh", "negative", -1.0),
    Rule("restructuring_pair", "hard_negative", 0.0),
    Rule("capital_reduction", "hard_negative", 0.0),
)


def fingerprint() -> str:
    return "|".join(f"{r.id}:{r.kind}:{r.weight:g}" for r in RULES)


def tier(score: Column, refused: Column | None = None) -> Column:
    """likely_financing, abstain or capital_increased; without a score, or refused: abstain."""
    out = F.when(score.isNull(), "abstain").when(score >= TAU, "likely_financing").when(score >= TAU_LOW, "abstain").otherwise("capital_increased")
    return out if refused is None else F.when(refused, "abstain").otherwise(out)


def hits(conditions: dict[str, Column]) -> Column:
    """The rules that fire, in the catalogue's order; a null condition does not."""
    fired = [F.when(conditions[r.id], F.lit(r.id)) for r in RULES if r.id in conditions]
    return F.filter(F.array(*fired), lambda x: x.isNotNull())


def hit_list(conditions: dict[str, Column], mark: str = "|") -> Column:
    """The same as text, in compiled code: joining skips nulls."""
    return F.concat_ws(mark, *[F.when(conditions[r.id], F.lit(r.id)) for r in RULES if r.id in conditions])


def score(conditions: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for r in RULES:
        if r.id in conditions:
            out = out + F.when(conditions[r.id], F.lit(r.weight)).otherwise(0.0)
    return out


def reject_reason(legal_form: Column, restructuring: Column, direction: Column) -> Column:
    """Why an event is no candidate; null if it is one."""
    return F.when(legal_form != "0106", "not_ag").when(restructuring, "restructuring_pair").when(direction == "reduction", "capital_reduction").when(direction != "increase", "not_increase")


def is_round(amount: Column, unit: int) -> Column:
    return (amount > 0) & (F.abs(F.pmod(amount.cast("decimal(20,2)"), F.lit(unit).cast("decimal(20,2)"))) < 0.005)


def direction(before: Column, after: Column, currency_changed: Column, stated: Column) -> Column:
    """Across a change of currency only a stated increase counts."""
    return F.when(currency_changed, F.when(stated, "increase").otherwise("unchanged")).when(after > before, "increase").when(after < before, "reduction").otherwise("unchanged")


def issuance(before: Column, after: Column, conversion: Column, restructuring: Column, reduction: Column, nominal_changed: Column) -> tuple[Column, Column, Column]:
    """(reason or null, new shares, fraction): the first reason that holds; else the figures."""
    reason = (
        F.when(conversion, "conversion to an AG").when(restructuring, "shares cancelled and reissued").when(reduction, "capital reduction").when(nominal_changed, "nominal value per share changed")
        .when(before.isNull() | after.isNull(), "share counts not published").when((after <= before) | (after <= 0), "no new shares")
    )
    return reason, F.when(reason.isNull(), after - before), F.when(reason.isNull(), (after - before) / after)


def status(tier_: Column, confirmed: Column, possible: Column) -> Column:
    """The seven states."""
    base = F.coalesce(tier_, F.lit("not_assessed"))
    return F.when(confirmed, F.when(tier_ == "likely_financing", "confirmed").otherwise("confirmed_missed")).when(possible, "possible_confirmation").otherwise(base)


def feed_group(status_: Column, tier_: Column) -> Column:
    return F.when(status_.isin("confirmed", "confirmed_missed"), "confirmed").when(tier_ == "likely_financing", "likely").when(tier_ == "abstain", "undecided").otherwise("increased")


def stratum(rules: Column, model: Column) -> Column:
    return F.when(rules & model, "both").when(rules, "rules_only").when(model, "model_only")
