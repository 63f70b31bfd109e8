"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A labelled table gives domains (clean, poor, toxic). A Bernoulli naive Bayes over telling words and shape bins, counted on a bounded
sample of labelled documents, predicts every document's posterior over the domains. Distributed projected-gradient least squares fits the rates of use r >= 0,
one for each document: from all rates at 1, every step sums the domains' expected token totals, sum r x tokens x posterior, over all
documents, and each rate goes against the gradient of the squared misses and is cut at 0. A rate follows from its document's posterior and the
steps so far, so it is worked out where the document lies and kept nowhere; a step brings back one sum for each domain and pair of
domains. The first length of a step is the inverse of the largest eigenvalue of the normal equations, by power iteration; later ones
follow Barzilai and Borwein's rule and fall back to that when the misses have grown.

A domain's squared miss counts in relation to what it has, which makes the steps even. They end when every domain's total is within
TOLERANCE of its target; the rates are then those nearest to 1, but for what was cut on the way. If that isn't reached because no
rates meet the targets, the descent starts again with misses in relation to the targets. The misses that stay are in the model, and larger
ones are logged.

Targets: weights of the domains; the `anchor` domain keeps its token total, which sets the budget. Domains without tokens or labelled
documents take no part, and the others' weights are scaled up.

Null texts count as empty (no token, the prior's posterior). Rows of `labels` with nulls or unknown values don't count; a document
with several labels counts for each. Without labels all rates are 1. Repeated rows get a row each, empty tables an empty result.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

DOMAINS = ("clean", "poor", "toxic")
WEIGHTS = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}
PER_DOMAIN = 1500
#: Telling words for each domain: how many, how many labelled documents must have one, and how much likelier it must be inside than outside.
TOP, LEAST, LIFT = 50, 8, 5.0
#: Fixed set: what is cut from the ends of a word of ASCII; of others all that is no letter is.
_EDGES = "0123456789.,;:!?\"'()[]{}<>#$%&*@~^|+=/\\_-"
#: Columns that the operator adds, or uses on the way.
OWN = ("_tokens", "_p", "_rate", "_words", "_shape", "_all", "_log")
#: Most steps of a descent, and the miss of a domain's total as a share of its target (of what it has, if that is 0).
MAX_STEPS, TOLERANCE = 60, 1e-4
#: After so many steps without a smaller greatest miss a descent ends.
PATIENCE = 15


def domain_of(quality: Column, toxic: Column) -> Column:
    """Fixed rule: toxic documents first, then poor ones."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 0), "poor").when((toxic == 0) & (quality == 1), "clean")


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words (distinct, lower case), _shape (bins) and _tokens (the number of words)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    share = lambda kind: F.regexp_count(whole, F.lit(kind)) / F.greatest(F.length(whole), F.lit(1))
    step = lambda name, x, bins: F.concat(F.lit(f"{name}:"), F.least(F.lit(9), F.floor(x * bins)).cast("string"))
    with_words = docs.withColumn("_all", words)
    distinct = F.array_distinct("_all")
    return with_words.withColumns(
        {
            "_tokens": F.size("_all").cast("bigint"),
            "_shape": F.array(step("symbols", share("[#$%&*@~^|]"), 50), step("capitals", share("[A-Z]"), 20), step("shouts", share("!"), 50), step("variety", F.size(distinct) / F.greatest(F.size("_all"), F.lit(1)), 9)),
            "_words": F.array_distinct(F.transform(distinct, lambda w: F.lower(F.when(F.octet_length(w) == F.length(w), F.btrim(w, F.lit(_EDGES))).otherwise(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))))),
        }
    ).drop("_all")


@dataclass
class DomainModel:
    """Domains that were seen; log prior with all words absent; for each feature the change of each domain's log likelihood; misses of the fit."""

    domains: list[str] = field(default_factory=list)
    base: list[float] = field(default_factory=list)
    weight: dict[str, list[float]] = field(default_factory=dict)
    misses: dict[str, float] = field(default_factory=dict)

    def log_likelihood(self, features: Column) -> Column:
        """Array of the domains' log probabilities, up to a constant."""
        table = F.create_map(*[x for k, v in sorted(self.weight.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
        known = F.array(*map(F.lit, sorted(self.weight)))
        add = lambda acc, f: F.zip_with(acc, table[f], lambda a, b: a + b)
        return F.aggregate(F.array_intersect(features, known), F.array(*map(F.lit, self.base)), add)


def _softmax(log: str) -> Column:
    e = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 6))


def train(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> DomainModel:
    """Counts features on about per_domain labelled documents of each domain, chosen by a hash of the id."""
    named = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("_domain")).where("doc_id IS NOT NULL AND _domain IS NOT NULL")
    counts = {r[0]: r[1] for r in named.groupBy("_domain").count().collect()}
    domains = [d for d in DOMAINS if d in counts]
    if not domains:
        return DomainModel()
    roll = F.pmod(F.xxhash64("doc_id", F.lit("domain-sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(min(1.0, per_domain / counts[d])))])
    chosen = named.where(roll < share[F.col("_domain")]).orderBy(roll, "_domain").limit(2 * per_domain * len(domains))  # more only if ids repeat
    sample = described(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    each = sample.select("_domain", F.explode(F.concat("_shape", "_words")).alias("f"))
    by = stored(each.groupBy("f").agg(*[F.sum((F.col("_domain") == d).cast("bigint")).alias(d) for d in domains]))
    totals = {r[0]: r[1] for r in sample.groupBy("_domain").count().collect()}
    domains = [d for d in domains if totals.get(d)]
    if not domains:
        return DomainModel()
    n = sum(totals.values())
    rate = {d: (F.col(d) + 0.5) / (totals[d] + 1.0) for d in domains}
    is_shape = F.col("f").rlike("^[a-z]+:[0-9]$")
    # a document has one bin of each kind: categorical; words are there or not: Bernoulli
    weight = {r[0]: [math.log(x) for x in list(r)[1:]] for r in by.where(is_shape).select("f", *[rate[d] for d in domains]).collect()}
    words = {}
    for d in domains if len(domains) > 1 else []:
        inside = F.col(d) / totals[d]
        outside = sum(F.col(x) for x in domains if x != d) / max(1, n - totals[d])
        best = by.where(~is_shape & (F.col("f") != "") & (F.col(d) >= LEAST) & (inside >= LIFT * outside)).orderBy(F.desc(inside - LIFT * outside), "f").limit(TOP)
        words |= {r[0]: list(r)[1:] for r in best.select("f", *[rate[x] for x in domains]).collect()}
    share = [counts[d] / sum(counts[x] for x in domains) for d in domains]
    base = [math.log(share[k]) + sum(math.log(1 - p[k]) for p in words.values()) for k in range(len(domains))]
    return DomainModel(domains, base, weight | {f: [math.log(x / (1 - x)) for x in p] for f, p in words.items()})


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """docs with _tokens and _p, the posteriors in the order of the model's domains."""
    held = described(docs, text)
    if not model.domains:
        return held.withColumn("_p", F.array().cast("array<double>")).drop("_words", "_shape")
    if not model.weight:
        total = [math.exp(b - max(model.base)) for b in model.base]
        return held.withColumn("_p", F.array(*[F.lit(x / sum(total)) for x in total])).drop("_words", "_shape")
    log = model.log_likelihood(F.concat("_shape", "_words"))
    return held.withColumn("_log", log).withColumn("_p", _softmax("_log")).drop("_words", "_shape", "_log")


@dataclass
class Rates:
    """The rate of a document: from 1 on, each step takes posterior . step away and cuts at 0."""

    steps: list[list[float]] = field(default_factory=list)

    def of(self, p: Column) -> Column:
        out = F.lit(1.0)
        for step in self.steps:
            out = F.greatest(F.lit(0.0), out - sum((p[k] * F.lit(x) for k, x in enumerate(step)), F.lit(0.0)))
        return out


def largest_eigenvalue(a: np.ndarray, rounds: int = 50) -> float:
    """Of a symmetric matrix without negative eigenvalues, by power iteration."""
    x = np.ones(len(a))
    for _ in range(rounds):
        y = a @ x
        size = float(np.linalg.norm(y))
        if not size:
            return 0.0
        x = y / size
    return float(x @ a @ x)


def descend(sums, start: tuple[np.ndarray, np.ndarray], target: np.ndarray, weight: np.ndarray, size: np.ndarray) -> tuple[Rates, np.ndarray]:
    """Projected-gradient steps on the squared misses, each times its domain's weight; the rates with the smallest greatest miss / size, and their totals.

    sums(rates) gives the totals and, over documents of a rate above 0, the sums for pairs of domains; start is that of all rates at 1.
    """
    rates, (got, pairs) = Rates(), start
    root = np.sqrt(weight)
    best = (math.inf, rates, got)
    values: list[float] = []
    last, since = None, 0
    for _ in range(MAX_STEPS):
        miss = got - target
        worst = float(np.abs(miss / size).max())
        if worst < best[0]:
            best, since = (worst, rates, got), 0
        else:
            since += 1
        top = largest_eigenvalue(root[:, None] * pairs * root)
        if worst <= TOLERANCE / 2 or since >= PATIENCE or not top:
            break
        gradient, value = weight * miss, float(weight @ miss**2)
        length = 1 / top
        if last is not None and value <= max(values[-4:]):
            # the last step and the change of the gradient that it made, both measured over documents
            before, held, took = last
            moved, change = took * float(before @ held @ before), -float(before @ held @ (gradient - before))
            length = min(max(moved / change, 0.5 / top), 1e4 / top) if change > 0 else length
        values.append(value)
        last = (gradient, pairs, length)
        rates = Rates([*rates.steps, [float(x) for x in length * gradient]])
        got, pairs = sums(rates)
    worst = float(np.abs((got - target) / size).max())
    return (rates, got) if worst < best[0] else best[1:]


def fit(held: DataFrame, domains: list[str], weights: dict[str, float], anchor: str) -> tuple[Rates, np.ndarray, np.ndarray, np.ndarray]:
    """The rates for stored rows of _tokens and _p; what the domains have, their targets and the totals that the rates give."""
    d, p, t = range(len(domains)), F.col("_p"), F.col("_tokens")

    def sums(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
        with_rate = held.select("_p", t.alias("_tokens"), rates.of(p).alias("_r"))
        on = F.when(F.col("_r") > 0, t).otherwise(0)
        row = with_rate.agg(*[F.sum(t * F.col("_r") * p[k]) for k in d], *[F.sum(on * p[i] * p[j]) for i in d for j in d]).first()
        cells = np.array([x or 0.0 for x in row], float)
        return cells[: len(domains)], cells[len(domains) :].reshape(len(domains), len(domains))

    start = sums(Rates())
    have = start[0]
    if not have.sum():
        return Rates(), have, have, have
    live = [k for k in d if have[k] > 0 and weights.get(domains[k], 0) >= 0]
    a = domains.index(anchor) if anchor in domains and have[domains.index(anchor)] > 0 and weights.get(anchor, 0) > 0 else None
    scale = sum(weights.get(domains[k], 0.0) for k in live) or 1.0
    budget = float(have.sum()) if a is None else have[a] / (weights[anchor] / scale)
    target = np.array([budget * weights.get(domains[k], 0.0) / scale if k in live else 0.0 for k in d])
    size = np.array([x if x > 0 else h if h > 0 else 1.0 for x, h in zip(target, have)])
    near = lambda got: np.abs((got - target) / size).max() <= TOLERANCE
    rates, got = descend(sums, start, target, np.array([1 / h if h > 0 else 0.0 for h in have]), size)
    if not near(got):
        rates, got = descend(sums, start, target, 1 / size**2, size)
    return rates, have, target, got


def missed(domains: list[str], have: np.ndarray, target: np.ndarray, got: np.ndarray) -> dict[str, float]:
    """For each domain with tokens the miss as a share of its target, or of what it has if that is 0."""
    return {d: float(abs(g - t) / (t if t > 0 else h)) for d, h, t, g in zip(domains, have, target, got) if h > 0}


def fitted(held: DataFrame, model: DomainModel, weights: dict[str, float], anchor: str) -> Rates:
    """The rates; their misses go into the model, and a miss beyond TOLERANCE is logged."""
    rates, have, target, got = fit(held, model.domains, weights, anchor)
    model.misses = missed(model.domains, have, target, got)
    if over := {d: m for d, m in model.misses.items() if m > TOLERANCE}:
        logging.getLogger(__name__).warning("token totals miss their targets, as shares of them: %s", over)
    return rates


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: str = "clean") -> tuple[DataFrame, DomainModel]:
    """docs with _tokens, _p and _rate; and the model, whose domains name the places of _p. Columns of docs of these names are replaced.

    The rows are stored with their posteriors before the rates are fitted: whatever then filters on the rate reads them, and no plan
    carries the posterior's expression into a filter.
    """
    docs = docs.drop(*OWN)
    model = train(docs, labels)
    held = posteriors(docs, model)
    if not model.domains:
        return held.withColumn("_rate", F.lit(1.0)), model
    held = stored(held)
    rates = fitted(held.select("_tokens", "_p"), model, weights or WEIGHTS, anchor)
    return held.withColumn("_rate", F.round(rates.of(F.col("_p")), 6)), model


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, tokens, a posterior for each domain, the likeliest domain and the rate. Texts are read once for the posteriors."""
    model = train(docs, labels)
    held = posteriors(docs.select("doc_id", "text"), model).select("doc_id", "_tokens", "_p")
    if not model.domains:
        return held.select("doc_id", F.col("_tokens").alias("tokens"), *[F.lit(0.0).alias(f"p_{d}") for d in DOMAINS], F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"))
    held = stored(held)
    rates = fitted(held, model, WEIGHTS, "clean")
    p = {d: F.col("_p")[model.domains.index(d)] if d in model.domains else F.lit(0.0) for d in DOMAINS}
    best = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("_p", F.array_max("_p")).cast("int"))
    return held.select("doc_id", F.col("_tokens").alias("tokens"), *[c.alias(f"p_{d}") for d, c in p.items()], best.alias("domain"), F.round(rates.of(F.col("_p")), 6).alias("rate"))


def sampled(mixed: DataFrame, key: str = "doc_id", slack: float = 0.2) -> DataFrame:
    """Rows that stay when each is used at most once: always from a rate of 1 - slack on, else with the rate as probability, by a hash of the id."""
    roll = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 24)) / float(1 << 24)
    return mixed.where((F.col("_rate") >= 1 - slack) | (roll < F.col("_rate")))
