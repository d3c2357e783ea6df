"""Mixing to target weights by soft membership, in DataFrame functions alone.

A softmax classifier, learned from the labelled table, predicts for each document how likely it belongs to
each domain. Projected-gradient least squares then fits nonnegative rates, one for each document, so that
the expected tokens of the domains match the targets: a step needs a few sums over all documents, and each
document moves by its own posteriors and is projected to at least 0.

The classifier is fitted on at most ``max_labelled`` labelled documents, chosen by a hash of the id; the driver
gets their evidence, at most as many numbers each as there are cells. All else covers all documents.

A document's evidence is a set of cells: its words in lower case and the ends of its words, hashed, and how
much its words vary. Each text is split once.

Edge cases: a null text is empty and has no tokens; without labels all domains are equally likely; targets that
no rates can meet are met as nearly as least squares allow, which ``Fit`` tells; repeated rows get equal rates;
null ids are no labels; an empty table gives none; new columns replace those of the same name, and all others
are kept.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

DOMAINS = ("good", "poor", "toxic")
_PAIRS = [(a, b) for i, a in enumerate(DOMAINS) for b in DOMAINS[i:]]


@dataclass(frozen=True)
class Mix:
    targets: dict[str, float] = field(default_factory=lambda: {"good": 0.9, "poor": 0.08, "toxic": 0.02})
    max_labelled: int = 8_000
    #: Cells that words, and the ends of words, are hashed to.
    word_cells: int = 8192
    end_cells: int = 2048
    #: Steps and penalty of the classifier.
    rounds: int = 60
    penalty: float = 3.0
    #: The fit ends when no domain misses by more than this share of the budget, or when a step lessens the misses by less than a hundredth of that.
    tolerance: float = 1e-4
    steps: int = 40
    #: Tokens wanted in all; unset: as many as keep the rate of the domain with the largest target near 1.
    budget: float | None = None
    #: A domain's target asks for at most so many times the tokens that it has, but for the domain with the largest one; unset: no bound.
    #: What is left of a domain then isn't repeated without end to stand for what is gone.
    max_rise: float | None = None

    @property
    def cells(self) -> int:
        return self.word_cells + self.end_cells + 8


def domain() -> Column:
    """The labelled table's domains."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")


def with_evidence(docs: DataFrame, carried: list[str], how: Mix) -> DataFrame:
    """``carried`` with n_tokens and _cells, the distinct cells of the text. Each step is a column of its own, so that none is computed twice."""
    split = docs.select(*carried, F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"))
    told = split.select(
        *carried, F.size("_words").cast("long").alias("n_tokens"),
        F.array_distinct(F.transform("_words", lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(how.word_cells)).cast("int"))).alias("_of_words"),
        F.array_distinct(F.transform("_words", lambda w: F.pmod(F.xxhash64(F.substring(w, -3, 3)), F.lit(how.end_cells)).cast("int") + how.word_cells)).alias("_of_ends"),
    )
    variety = F.least(F.lit(7), F.floor(8 * F.size("_of_words") / F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int") + (how.word_cells + how.end_cells)
    return told.select(*carried, "n_tokens", F.concat("_of_words", "_of_ends", F.array(variety)).alias("_cells"))


@dataclass(frozen=True)
class Classifier:
    """``bias`` for each domain and ``weights`` (domain, cell); no weights: all domains are equally likely."""

    bias: np.ndarray
    weights: np.ndarray | None

    def probabilities(self, cells: np.ndarray) -> np.ndarray:
        """Of one document's cells; what ``with_posteriors`` computes in Spark."""
        if self.weights is None:
            return np.full(len(DOMAINS), 1 / len(DOMAINS))
        z = self.bias + self.weights[:, cells].sum(axis=1)
        e = np.exp(z - z.max())
        return e / e.sum()


def softmax_regression(cells: list[np.ndarray], y: np.ndarray, how: Mix) -> Classifier:
    """Penalised maximum likelihood by accelerated steps, each coordinate's scaled by a bound on its curvature."""
    flat, sizes = np.concatenate(cells), np.array([len(c) for c in cells])
    at, doc = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(cells)), sizes)
    k = len(DOMAINS)
    curvature = 0.5 * np.bincount(flat, weights=sizes[doc], minlength=how.cells) + how.penalty
    w = np.zeros((how.cells, k))
    ahead, pace = w, 1.0
    bias = np.log((np.bincount(y, minlength=k) + 1.0) / (len(y) + k))
    for _ in range(how.rounds):
        z = np.add.reduceat(ahead[flat], at, axis=0) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        slope = np.column_stack([np.bincount(flat, weights=p[doc, c], minlength=how.cells) for c in range(k)])
        new = ahead - (slope + how.penalty * ahead) / curvature[:, None]
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / next_pace * (new - w), new, next_pace
        bias = bias - 2 * p.mean(axis=0)
    return Classifier(bias, w.T)


def learn(docs: DataFrame, labels: DataFrame, how: Mix = Mix()) -> Classifier:
    """From labelled documents; the driver gets the cells of at most ``max_labelled`` of them."""
    known = labels.where("doc_id is not null").select("doc_id", domain().alias("_domain")).distinct()
    chosen = known.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id", "_domain").limit(how.max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows are sent
    rows = with_evidence(rows, ["doc_id", "_domain"], how).select("doc_id", "_domain", F.array_join(F.array_sort("_cells"), " ").alias("cells"))
    # of a repeated id the text whose cells come first, whichever task read it
    got = sorted(map(tuple, rows.groupBy("doc_id", "_domain").agg(F.min("cells")).collect()))
    if not got:
        return Classifier(np.zeros(len(DOMAINS)), None)
    return softmax_regression([np.array(c.split(), np.int64) for _, _, c in got], np.array([DOMAINS.index(d) for _, d, _ in got]), how)


def with_posteriors(docs: DataFrame, classifier: Classifier, how: Mix = Mix()) -> DataFrame:
    """``docs`` with n_tokens and p_<domain>. The weights are a table of one row, which the plan reads once."""
    names = [f"p_{d}" for d in DOMAINS]
    carried = [c for c in docs.columns if c not in {"n_tokens", "rate", *names}]
    told = with_evidence(docs, carried, how)
    if classifier.weights is None:
        return told.select(*carried, "n_tokens", *[F.lit(1.0 / len(DOMAINS)).alias(n) for n in names])
    as_text = [",".join(map(repr, w.tolist())) for w in classifier.weights]
    table = written(docs.sparkSession.range(1).select(*[F.split(F.lit(x), ",").cast("array<double>").alias(n) for n, x in zip(names, as_text, strict=True)]), "weights")
    # the optimiser joins the next two projections, so the weights are read as scalar subqueries and no row holds them
    told = told.select(*carried, "n_tokens", "_cells", *[table.select(n).scalar().alias(f"_w_{n}") for n in names])
    start = F.struct(*[F.lit(float(b)).alias(n) for n, b in zip(names, classifier.bias, strict=True)])
    add = lambda total, cell: F.struct(*[(total[n] + F.get(f"_w_{n}", cell)).alias(n) for n in names])
    told = told.select(*carried, "n_tokens", F.aggregate("_cells", start, add).alias("_logits"))
    scored = told.select("*", F.greatest(*[F.col("_logits")[n] for n in names]).alias("_top"))
    scored = scored.select(*carried, "n_tokens", *[F.exp(F.col("_logits")[n] - F.col("_top")).alias(n) for n in names])
    total = F.col(names[0]) + F.col(names[1]) + F.col(names[2])
    return scored.select(*carried, "n_tokens", *[(F.col(n) / total).alias(n) for n in names])


@dataclass(frozen=True)
class Fit:
    """The steps, each a move for each domain; tokens wanted and got; whether no miss passes the tolerance."""

    moves: list[tuple[float, ...]]
    wanted: np.ndarray
    got: np.ndarray
    met: bool


def rate(moves: list[tuple[float, ...]], start: Column | None = None) -> Column:
    """The rate after these steps, from a document's posteriors."""
    r = F.lit(1.0) if start is None else start
    for move in moves:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(float(m)) * F.col(f"p_{d}") for d, m in zip(DOMAINS, move, strict=True)), F.lit(0.0)))
    return r


def _sums(told: DataFrame, rates: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens of each domain, the domains' products over documents with a rate) under each of the rates; one aggregate."""
    told = told.select("n_tokens", *[f"p_{d}" for d in DOMAINS], *[r.alias(f"r{i}") for i, r in enumerate(rates)])
    t, p = F.col("n_tokens"), {d: F.col(f"p_{d}") for d in DOMAINS}
    asked = [F.sum(F.col(f"r{i}") * t * p[d]).alias(f"{i}_{d}") for i in range(len(rates)) for d in DOMAINS]
    asked += [F.sum(F.when(F.col(f"r{i}") > 0, t * p[a] * p[b])).alias(f"{i}_{a}_{b}") for i in range(len(rates)) for a, b in _PAIRS]
    row = told.agg(*asked).first()
    out = []
    for i in range(len(rates)):
        gram = np.zeros((len(DOMAINS), len(DOMAINS)))
        for a, b in _PAIRS:
            gram[DOMAINS.index(a), DOMAINS.index(b)] = gram[DOMAINS.index(b), DOMAINS.index(a)] = float(row[f"{i}_{a}_{b}"] or 0.0)
        out.append((np.array([float(row[f"{i}_{d}"] or 0.0) for d in DOMAINS]), gram))
    return out


def fit(posteriors: DataFrame, how: Mix = Mix()) -> Fit:
    """Rates that minimise the squared misses of the domains' tokens, by projected gradient from rates of 1.

    In the metric that weighs a document by its tokens, a step moves each rate by its posteriors times the misses.
    Divided by the largest eigenvalue of the domains' products over all documents, such a step never raises the
    sum of squares. Each round also tries longer steps, scaled by the damped inverse of the products over the
    documents that still have a rate, and takes the best of all; so the sum of squares falls in each round.
    A round is one aggregate over all documents.
    """
    (have, gram), = _sums(posteriors, [F.lit(1.0)])
    target = np.array([how.targets.get(d, 0.0) for d in DOMAINS])
    lead = int(target.argmax())
    budget = how.budget if how.budget is not None else have[lead] / max(target[lead], 1e-9)
    wanted = target * budget
    if how.max_rise is not None:
        wanted = np.where(np.arange(len(DOMAINS)) == lead, wanted, np.minimum(wanted, how.max_rise * have))
    steepest = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    moves: list[tuple[float, ...]] = []
    got, met, enough = have, False, how.tolerance * max(budget, 1e-9)
    for _ in range(how.steps):
        miss = got - wanted
        met = bool(np.abs(miss).max() <= enough)
        if met:
            break
        damped = [np.linalg.lstsq(gram + s * np.trace(gram) * np.eye(len(DOMAINS)), miss, rcond=1e-12)[0] for s in (1e-12, 1e-3, 1e-2, 1e-1)]
        tries = [miss / steepest, *damped]
        now = rate(moves).alias("_rate")
        sums = _sums(posteriors.select("*", now), [rate([tuple(x)], F.col("_rate")) for x in tries])
        squares = [float(((g - wanted) ** 2).sum()) for g, _ in sums]
        best = int(np.argmin(squares))
        moves.append(tuple(tries[best].tolist()))
        got, gram = sums[best]
        if np.sqrt((miss**2).sum()) - np.sqrt(squares[best]) < 0.01 * enough:
            met = bool(np.abs(got - wanted).max() <= enough)
            break  # least squares, though perhaps short of the targets
    if not met:
        logging.getLogger(__name__).warning("targets %s are met as %s only", wanted.tolist(), got.tolist())
    return Fit(moves, wanted, got, met)


def _rated(told: DataFrame, how: Mix) -> DataFrame:
    fitted = fit(told, how)
    return told.withColumn("rate", rate(fitted.moves)).withColumn("targets_met", F.lit(fitted.met))


def mix(docs: DataFrame, labels: DataFrame, how: Mix = Mix(), learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_tokens, the posteriors, the fitted rate, and whether the rates meet the targets.

    The classifier is learned from the labelled rows of ``learn_from``, such as the documents before a filter took a
    domain out; unset: of ``docs``. Posteriors are computed once, and written with the documents.
    """
    carried = docs.drop("targets_met")
    told = written(with_posteriors(carried, learn(docs if learn_from is None else learn_from, labels, how), how), "posteriors")
    return _rated(told, how)


def rates(docs: DataFrame, labels: DataFrame, how: Mix = Mix()) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, targets_met) of every document."""
    told = written(with_posteriors(docs.select("doc_id", "text"), learn(docs, labels, how), how).drop("text"), "posteriors")
    return _rated(told, how)


def resampled(mixed: DataFrame, columns: list[str], salt: str = "mix") -> DataFrame:
    """Each document as many times as its rate says: the whole part, and one more as often as the rest says, by a hash of id and text."""
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return mixed.select(*columns, copies.alias("_n")).where("_n > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select(*columns)
