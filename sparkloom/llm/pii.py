"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote (+ yes, - no, 0 abstains) on candidate spans. The votes of all documents are counted
by pattern, expectation-maximisation estimates from these counts how reliable each labeler is (Dawid-Skene with abstentions),
and its posteriors are the soft labels of a final span classifier, a logistic regression on votes and shape features. Base spans,
which fixed patterns and checks define, always stay; the classifier decides about the other candidates.

The counts cover all documents and are summed before they are shuffled. What reaches the driver is one row per pattern: at most
kinds x 3^labelers x 2^features rows, however large the corpus.

Nulls count as the empty text and give no spans; an empty table gives an empty result; repeated rows are judged one by one; an
input column that is called as the output column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches
from ._fit import logistic, sigmoid

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
_any_digit = lambda text: any(c in text for c in "0123456789")  # noqa: E731  ten memchr calls are faster than one regex
_spelt_dot = lambda text: "dot" in text or "Dot" in text or "DOT" in text

#: Further candidates: addresses that are spelt out, IPv6, shorter cards, numbers without a country code.
MORE = {
    "email": re.compile(r"(?ai)\b[a-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\bat\b) ?[a-z0-9-]+ ?(?:\(dot\)|\[dot\]|\bdot\b) ?[a-z]{2,12}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])"),
}
#: Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it nl be ch at uk us ca au jp cn in br mx ru pl se no dk fi eu dev app".split())
FIRST_NAMES = frozenset("james mary john anna maria peter paul david laura sarah thomas michael jean marie pierre hans klaus juan jose carlos luis lucia".split())
NEAR = {
    "email": frozenset("email e-mail mail contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host server address addr client peer adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell whatsapp telefon telefono".split()),
}
AGAINST = frozenset("version release isbn issn order invoice chapter section page sku serial figure table".split())
WORD = re.compile(r"[^\W\d_][\w-]*")
#: Words of a table of word lists, at most, as every worker holds them.
MAX_WORDS = 500_000


@dataclass(frozen=True)
class WordLists:
    """What the gazetteer and context labelers know, in lower case."""

    top_domains: frozenset[str] = TOP_DOMAINS
    first_names: frozenset[str] = FIRST_NAMES
    near: tuple[tuple[str, frozenset[str]], ...] = tuple(NEAR.items())
    against: frozenset[str] = AGAINST


LISTS = WordLists()


def word_lists(words: DataFrame) -> WordLists:
    """The fixed lists and the words of a table (list, word): top_domain, first_name, against, or a kind for the words that stand near it.

    Null words and other lists don't count; more than MAX_WORDS different words are refused with an error.
    """
    rows = words.select(F.col("list"), F.lower(F.trim("word")).alias("word")).where("word <> ''").where(F.col("list").isin("top_domain", "first_name", "against", *KINDS)).distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words; a worker may hold that many")
    by: dict[str, set[str]] = {}
    for r in rows:
        by.setdefault(r["list"], set()).add(r["word"])
    more = lambda name: frozenset(by.get(name, ()))
    return WordLists(TOP_DOMAINS | more("top_domain"), FIRST_NAMES | more("first_name"), tuple((k, v | more(k)) for k, v in NEAR.items()), AGAINST | more("against"))

LABELERS = ("pattern", "check", "gazetteer", "context", "counter")
FEATURES = ("base", "long", "separated", "edge")

CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,shape:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by kind as listed, then start."""
    out = []
    at, least = text.find("@"), 0
    while at >= 0:  # the local part can't hold an @, so each match ends its local part at one
        if (left := LOCAL_END.search(text, max(least, at - 400), at)) and (right := DOMAIN.match(text, at + 1)):
            start = left.start()
            while start > least and start <= at - 400 + 1 and re.match(r"[A-Za-z0-9._%+-]", text[start - 1]):
                start -= 1
            out.append(("email", start, right.end()))
            least = right.end()
        at = text.find("@", max(at + 1, least))
    if _any_digit(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _vote(text: str, kind: str, start: int, end: int, base: bool, lists: WordLists = LISTS) -> tuple[str, str]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    digits = _digits(span)
    near = {w.lower() for w in WORD.findall(before)}
    votes = ["+" if base else "0"]
    if kind == "card":
        votes.append("+" if luhn(digits) else "-")
    elif kind == "phone":
        votes.append("+" if 8 <= len(digits) <= 15 and len(set(digits)) > 3 else "-")
    elif kind == "ip":
        parts = re.split(r"[.:]", span)
        votes.append("+" if len(parts) == 8 or all(len(p) < 4 and (p == "0" or p[0] != "0") for p in parts) else "-")
    elif base:
        votes.append("+" if re.search(r"[A-Za-z]", span) and ".." not in span else "-")
    else:  # letters alone say nothing where the address is spelt out
        votes.append("+" if re.search(r"[\[(0-9._+-]", span) else "0")
    if kind == "email":
        words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", span) if w]
        known = words[-1] in lists.top_domains
        if base:
            votes.append("+" if known or lists.first_names & set(words) else "-" if not words[-1].isalpha() else "0")
        else:  # ordinary words can look like an address that is spelt out
            votes.append("+" if known else "-")
    elif kind == "phone":
        votes.append("+" if span[0] == "+" else "0")
    elif kind == "card":
        votes.append("+" if digits[:1] in ("3", "4", "5", "6") else "-")
    else:
        votes.append("-" if span.startswith(("0.", "255.")) else "0")
    votes.append("+" if near & dict(lists.near)[kind] else "0")
    votes.append("-" if near & lists.against else "0")
    edge = (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum())
    return "".join(votes), "".join("01"[x] for x in (base, len(span) >= 16, any(c in span for c in " -()"), edge))


def candidates(text: str, lists: WordLists = LISTS) -> list[tuple[str, int, int, bool, str, str]]:
    """All candidate spans with their votes and shape, by kind as listed, then start."""
    base = base_spans(text)
    spans = [(*x, True) for x in base]
    if _any_digit(text) or _spelt_dot(text):
        taken = sorted((s, e) for _, s, e in base)
        spans += [(k, *m.span(), False) for k in KINDS for m in MORE[k].finditer(text) if not any(s < m.end() and m.start() < e for s, e in taken)]
    return sorted(((k, s, e, b, *_vote(text, k, s, e, b, lists)) for k, s, e, b in spans), key=lambda x: (KINDS.index(x[0]), x[1]))


def _candidates(text: Column, lists: WordLists) -> Column:
    names = [f.name for f in _ARROW.value_type]

    @F.arrow_udf(CANDIDATES)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, x)) for x in candidates(t or "", lists)] for t in col.to_pylist()], _ARROW)

    return run(text)


@dataclass
class SpanModel:
    """reliability: for each kind and labeler the rates of a yes vote on true and on false spans; decide: kind, votes, shape -> probability."""

    reliability: dict[str, dict[str, tuple[float, float]]]
    decide: dict[tuple[str, str, str], float]


def _em(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and each labeler's yes rates given true and false; votes 1, -1 or 0 (abstains)."""
    post, rates = start, np.full((votes.shape[1], 2), 0.5)
    for _ in range(rounds):
        w = np.stack([weight * post, weight * (1 - post)], 1)
        prior = (w.sum(0) + 1) / (w.sum() + 2)
        yes, no = (votes > 0).T @ w + [2.0, 0.5], (votes < 0).T @ w + [0.5, 2.0]  # labelers are better than chance a priori
        rates = yes / (yes + no)
        log = np.log(prior) + (votes > 0) @ np.log(rates) + (votes < 0) @ np.log(1 - rates)
        post = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    return post, rates


def _encode(votes: str, shape: str) -> tuple[list[int], list[float]]:
    v = [{"+": 1, "-": -1, "0": 0}[c] for c in votes]
    return v, [1.0, *(float(x > 0) for x in v), *(float(x < 0) for x in v), *(float(c) for c in shape)]


def fit_spans(counts: list[tuple[str, str, str, int]], rounds: int = 50) -> SpanModel:
    """Fits from (kind, votes, shape, count) rows; no rows give a model that knows no span."""
    reliability, decide = {}, {}
    for kind in KINDS:
        rows = sorted(r for r in counts if r[0] == kind)
        if not rows:
            continue
        coded = [_encode(v, s) for _, v, s, _ in rows]
        votes, x = np.array([c[0] for c in coded]), np.array([c[1] for c in coded])
        weight = np.array([float(r[3]) for r in rows])
        start = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
        post, rates = _em(votes, weight, start, rounds)
        scaled = weight / weight.sum() * min(weight.sum(), 1e4)
        p = sigmoid(x @ logistic(x, post, scaled))
        reliability[kind] = {n: (float(a), float(b)) for n, (a, b) in zip(LABELERS, rates)}
        decide |= {(k, v, s): float(q) for (k, v, s, _), q in zip(rows, p)}
    return SpanModel(reliability, decide)


def find_pii(docs: DataFrame, text: str = "text", out: str = "spans", least: float = 0.5, lists: WordLists = LISTS) -> DataFrame:
    """docs with the column `out`: array of (kind, start, end, base, score), by kind as listed and start; code points, end exclusive.

    lists may come from a table, see word_lists.
    """
    bounded_batches(docs.sparkSession)
    seen = docs.select(F.explode(_candidates(F.col(text), lists)).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    model = fit_spans([tuple(r) for r in seen.collect()])  # bounded by the patterns there can be
    known = [x for k, v in model.decide.items() for x in (F.lit(":".join(k)), F.lit(v))]
    scores = F.create_map(*known) if known else F.lit(None).cast("map<string,double>")
    score = lambda x: F.coalesce(scores[F.concat_ws(":", x["kind"], x["votes"], x["shape"])], F.lit(0.0))
    every = F.transform(_candidates(F.col(text), lists), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), score(x).alias("score")))
    return docs.withColumn(out, F.filter(every, lambda x: x["base"] | (x["score"] >= least)))


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The spans' places in the text become <KIND>; of overlapping spans the one that starts first counts, a longer one before a shorter."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["done"], F.substr(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("done"), (-x["minus_end"]).alias("at"))
    )
    cut = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substr(F.col(text), acc["at"] + 1)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans and their number."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["base"])
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
