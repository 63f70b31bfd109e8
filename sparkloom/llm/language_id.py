"""Language identification in two levels: the family first, then one-versus-one linear SVMs among the family's languages.

Features are hashed letter n-grams (1 to 3 bytes of lower-cased UTF-8) of the whole text, as square roots of their shares, scaled to
length one. The classifier is fitted on at most `per_lang` labelled documents of each language, chosen by a hash of the id; that
bound is the only one: every document is classified, over its whole text.

A text that is null or has no letter gets `und` and score 0. Rows without a label, or held out, are never learnt from. With no
labelled row at all every document is `und`; with one language all letters are that language. Repeated rows are judged one by one;
an input column that is called as the output column is replaced. No shuffle takes place beyond the counts of labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_mod

DIMS = 2048
UND = "und"
CHUNK = 1 << 20
#: Fixed table: language families. Other languages are families of their own.
FAMILIES = {
    "germanic": "en de nl da sv no is af".split(),
    "romance": "fr es it pt ro ca gl".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl be".split(),
    "turkic": "tr az kk uz".split(),
    "sinitic": "zh yue".split(),
    "indic": "hi ur bn mr ne pa".split(),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Byte classes: ASCII letters and bytes of longer characters count, the rest is a gap between words.
_LETTER = np.array([(97 <= b <= 122) or b >= 128 for b in range(256)])


def _ids(raw: np.ndarray) -> np.ndarray:
    """Hashed ids of the 1-, 2- and 3-grams of letters in the bytes; grams may begin at a gap, not hold one inside."""
    b = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
    one, two = b[1:-1], b[1:-1] + (b[:-2] << np.uint32(8))
    three = two + (b[2:] << np.uint32(16))
    live = one != 32
    mix = lambda x, salt: ((x * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(21)).astype(np.int64)
    return np.concatenate([mix(x[live], s) for x, s in ((one, 0), (two, 0x9E3779B9), (three, 0x7F4A7C15))])


def features(text: str) -> np.ndarray:
    """The whole text's feature vector; zeros if it has no letter."""
    total = np.zeros(DIMS)
    raw = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace") + b"  ", np.uint8)
    for k in range(0, len(raw) - 2, CHUNK):
        total += np.bincount(_ids(raw[k : k + CHUNK + 2]), minlength=DIMS)
    root = np.sqrt(total)
    return (root / max(np.linalg.norm(root), 1e-12)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Linear SVM with squared hinge loss and an intercept, by accelerated gradient steps; y is 1 or -1; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    top = np.ones(x.shape[1])
    for _ in range(20):  # power iteration, for the step's length
        top = x.T @ (weight * (x @ top))
        lip = np.linalg.norm(top)
        top /= max(lip, 1e-12)
    lip = 1e-3 + 2.4 * lip
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - (1e-3 * v - 2 * x.T @ (weight * y * slack)) / lip
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """families: names; family_w: a row for each pair of families; pairs: for each family its languages, and a row for each pair of them."""

    families: list[str]
    family_w: np.ndarray
    languages: dict[str, list[str]]
    pair_w: dict[str, np.ndarray]

    @staticmethod
    def _choose(x: np.ndarray, names: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner's place and confidence of each row: one-versus-one votes, weighted by the margins."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ w[:, :-1].T.astype(np.float32) + w[:, -1]
        p = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
        votes = np.zeros((len(x), len(names)))
        for k, (i, j) in enumerate(combinations(range(len(names)), 2)):
            votes[:, i] += p[:, k]
            votes[:, j] += 1 - p[:, k]
        best = votes.argmax(1)
        return best, votes[np.arange(len(x)), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UND] * len(x), np.zeros(len(x))
        family, sure = self._choose(x, self.families, self.family_w)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            best, own = self._choose(x[rows], self.languages[name], self.pair_w[name])
            out[rows] = np.array(self.languages[name], object)[best]
            score[rows] = sure[rows] * own
        return list(out), score


def _pairwise(x: np.ndarray, y: np.ndarray, names: list[str]) -> np.ndarray:
    rows = []
    for a, b in combinations(names, 2):
        own = (y == a) | (y == b)
        rows.append(_svm(x[own], np.where(y[own] == a, 1.0, -1.0)))
    return np.array(rows).reshape(-1, DIMS + 1)


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """Fits from feature rows and their languages; order of the rows doesn't matter."""
    y = np.array(langs, object)
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = sorted(by)
    of = np.array([FAMILY.get(z, z) for z in langs], object)
    return LanguageModel(families, _pairwise(x, of, families), by, {f: _pairwise(x, y, by[f]) for f in families})


def sample_of_labelled(docs: DataFrame, lang: str, text: str, key: str, per_lang: int) -> DataFrame:
    """At most about per_lang labelled rows of each language, by a hash of the key: the same rows wherever they lie."""
    counts = {r[0]: r[1] for r in docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return docs.where(F.lit(False))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    roll = (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("lang-sample")), F.lit(1 << 20)) / float(1 << 20))
    return docs.where(F.col(text).isNotNull() & (roll < share[F.col(lang)])).orderBy(roll, F.xxhash64(text)).limit(2 * per_lang * len(counts))  # more only if keys repeat


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_lang: int = 800) -> LanguageModel:
    """Fits the model on a bounded sample of docs' labelled rows; features are made on the executors."""

    @F.arrow_udf("binary")
    def vector(col: pa.Array) -> pa.Array:
        return pa.array([features(t).tobytes() if has_letter(t) else None for t in col.to_pylist()], pa.binary())

    rows = sample_of_labelled(docs.select(key, lang, text), lang, text, key, per_lang).select(F.col(lang).alias("l"), vector(text).alias("v")).where("v is not null").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)  # at most 2 x per_lang x languages vectors of 8 KB
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows]).reshape(-1, DIMS)
    return fit(x, [r[0] for r in rows])


PREDICTION = "struct<lang:string,score:double>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """docs with the column `out`: the language and a score from 0 to 1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (languages choose 2) x 16 KB

    @F.arrow_udf(PREDICTION)
    def run(col: pa.Array) -> pa.Array:
        langs, scores, texts = [], [], col.to_pylist()
        for k in range(0, len(texts), 256):
            part = texts[k : k + 256]
            full = [has_letter(t) for t in part]
            x = np.array([features(t) for t, ok in zip(part, full) if ok], np.float32).reshape(-1, DIMS)
            names, sure = shared.value.predict(x)
            found = iter(zip(names, sure))
            for ok in full:
                name, s = next(found) if ok else (UND, 0.0)
                langs.append(name)
                scores.append(float(s))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_ARROW))

    # not deterministic for the planner: else a filter on the prediction is pushed below it with a second evaluation
    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return crc_mod(F.col(key), folds) == fold


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document; learnt from the rows that aren't held out."""
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
