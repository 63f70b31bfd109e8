"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is a node with two states, bad and good. A node sees its own line's features and those of the lines before
and after it; an edge holds the states of neighbours together. Forward-backward gives each line's probability of being good, and
their mean, weighted by the lines' lengths, is the document's raw score, which a logistic fit turns into a probability.

Lines inherit their document's label in training, on at most `per_class` labelled documents of each class (of `most_bytes` at most),
chosen by a hash of the id. Every document is scored, over its whole text: long texts go through in pieces, of which three sums are kept
for each line, so memory grows with the number of lines alone, not with their bytes.

Null and empty texts have one empty line and get the score that such a line has; without labels of both classes every score is the
share of label 1 (0.5 if there is no label). Repeated rows are scored one by one; a document with several labels is learnt from
once for each. An input column that is called as the output column is replaced. No shuffle of texts takes place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_mod
from ._fit import logistic, sigmoid

CHUNK = 1 << 20
#: Byte classes.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,;:'\"()-", "!?", "#$%&*@~^+=<>/\\_[]{}`", "|"]
_CLASS = np.full(256, len(_GROUPS) + 1, np.uint8)
_CLASS[:128] = len(_GROUPS)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
N_CLASSES = len(_GROUPS) + 2
OWN = N_CLASSES + 7
WIDTH = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of the texts: own features, lengths in bytes, and the number of lines of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    end = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    length = end - start
    doc_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    lines = np.diff(np.concatenate([[0], np.searchsorted(end, doc_end, "right")]))
    out = np.zeros((len(end), OWN))
    cls = _CLASS[raw]
    for k in range(N_CLASSES):
        total = np.concatenate([[0], np.cumsum(cls == k, dtype=np.int32)])
        out[:, k] = (total[end] - total[start]) / np.maximum(length, 1)
    gap = (cls == 3) | (raw == 10)
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    of = np.searchsorted(end, first)
    words = np.bincount(of, minlength=len(end))
    if len(first):
        # a word's digest: bytes weighted by place; only equality with the words just before it matters
        begun = np.zeros(len(raw), np.int64)
        begun[first] = first
        place = np.arange(len(raw)) - np.maximum.accumulate(begun)
        value = np.where(gap, 0, (raw.astype(np.int64) + 1) * ((place * 2654435761 + 97) & 0xFFFFFFFF))
        total = np.concatenate([[0], np.cumsum(value)])
        word = total[last] - total[first]
        same = lambda k: np.bincount(of[k:], (word[k:] == word[:-k]) & (of[k:] == of[:-k]), len(end)) if len(word) > k else np.zeros(len(end))
        out[:, N_CLASSES] = same(1) / np.maximum(words, 1)
        out[:, N_CLASSES + 1] = (same(2) + same(3) + same(4)) / np.maximum(words, 1)
    out[:, N_CLASSES + 2] = np.log1p(length) / 8
    out[:, N_CLASSES + 3] = np.minimum(length / np.maximum(words, 1) / 10, 3)
    out[:, N_CLASSES + 4] = length == 0
    if len(end) > 1:  # the same line as the one before
        alike = np.zeros(len(end))
        near = np.flatnonzero((length[1:] == length[:-1]) & (length[1:] > 0)) + 1
        for k in near:
            alike[k] = raw[start[k] : end[k]].tobytes() == raw[start[k - 1] : end[k - 1]].tobytes()
        alike[np.cumsum(lines)[:-1]] = 0  # not across texts
        out[:, N_CLASSES + 5] = alike
    out[:, N_CLASSES + 6] = words <= 2
    return out, length.astype(float), lines


def _long_line(line: bytes) -> np.ndarray:
    """line_features of one line, worked out in segments: memory doesn't grow with it."""
    counts, words, same, last = np.zeros(N_CLASSES, np.int64), 0, np.zeros(5, np.int64), []  # same: by distance; last: digests of the four words before
    place, digest = 0, 0  # of the word that is open at a segment's end
    for at in range(0, len(line), CHUNK):
        raw = np.frombuffer(line, np.uint8, min(CHUNK, len(line) - at), at)
        cls = _CLASS[raw]
        counts += np.bincount(cls, minlength=N_CLASSES)
        gap = cls == 3
        edge = np.concatenate([[0], np.flatnonzero(gap) + 1])  # a word may begin here
        begin = np.repeat(edge, np.diff(np.concatenate([edge, [len(raw)]])))
        held = np.where(begin == 0, np.arange(len(raw)) + place, np.arange(len(raw)) - begin)
        value = np.where(gap, 0, (raw.astype(np.int64) + 1) * ((held * 2654435761 + 97) & 0xFFFFFFFF))
        sums = np.add.reduceat(value, np.minimum(edge, len(raw) - 1))
        sums[edge == len(raw)] = 0  # the segment ends with a gap
        sizes = np.diff(np.concatenate([edge, [len(raw) + 1]])) - 1
        with np.errstate(over="ignore"):
            sums[0] += digest
        sizes[0] += place
        place, digest = int(sizes[-1]), int(sums[-1])
        done = sums[:-1][sizes[:-1] > 0]  # the last one may go on
        if at + CHUNK >= len(line) and place:
            done = np.concatenate([done, [np.int64(digest)]])
        row = np.concatenate([np.array(last, np.int64), done])
        for k in range(1, 5):
            same[k] += int((row[k:] == row[:-k])[max(0, len(last) - k) :].sum()) if len(row) > k else 0
        words += len(done)
        last = row[-4:].tolist()
    out = np.zeros(OWN)
    n, w = len(line), max(words, 1)
    out[:N_CLASSES] = counts / max(n, 1)
    out[N_CLASSES:] = same[1] / w, same[2:].sum() / w, np.log1p(n) / 8, min(n / w / 10, 3), n == 0, 0, words <= 2
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at line ends into pieces of about CHUNK bytes; a longer line is a piece of its own."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(b"\n", at, at + CHUNK)
        if cut < 0:
            cut = text.find(b"\n", at + CHUNK)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _batches(texts: list[bytes]) -> Iterator[tuple[list[bytes], bool]]:
    """Texts in batches of about CHUNK bytes, and long ones in pieces; and whether a batch goes on with the text before it."""
    part, size = [], 0
    for t in texts:
        if len(t) > CHUNK or size + len(t) > CHUNK:
            if part:
                yield part, False
            part, size = [], 0
        if len(t) > CHUNK:
            for k, piece in enumerate(_pieces(t)):
                yield [piece], k > 0
            continue
        part.append(t)
        size += len(t)
    if part:
        yield part, False


def projected(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features times weights (a column for each wanted sum), lengths and numbers of lines, batch by batch: only what is wanted of a line is kept."""
    rows, lengths, lines, tail = [], [], [], b""
    for part, goes_on in _batches(texts):
        if len(part) == 1 and len(part[0]) > CHUNK and b"\n" not in part[0]:
            own, length, n = _long_line(part[0])[None], np.array([float(len(part[0]))]), np.array([1])
        else:
            own, length, n = line_features(part)
        if goes_on:
            first = part[0][: part[0].find(b"\n")] if b"\n" in part[0] else part[0]
            own[0, N_CLASSES + 5] = bool(first) and first == tail
        if len(part) == 1:
            tail = part[0][part[0].rfind(b"\n") + 1 :]
        rows.append(own @ weights)
        lengths.append(length)
        if goes_on:
            lines[-1][-1] += n[0]
        else:
            lines.append(n.copy())
    return np.concatenate(rows) if rows else np.zeros((0, weights.shape[1])), np.concatenate(lengths) if rows else np.zeros(0), np.concatenate(lines) if rows else np.zeros(0, np.int64)


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after within the text, and a column of ones."""
    begin = np.concatenate([[0], np.cumsum(lines)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begin] = 0
    after[begin + lines - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(node: np.ndarray, edge: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once. node: log weight of state good against bad for each line; edge: 2 x 2 log weights.

    Gives each line's probability of good, and the expected number of each pair of neighbouring states by line (of the line and the next).
    """
    begin = np.concatenate([[0], np.cumsum(lines)[:-1]])
    order = np.argsort(-lines, kind="stable")
    begin, lines = begin[order], lines[order]
    n, most = len(node), int(lines.max(initial=0))
    live = np.searchsorted(-lines, -np.arange(most), "left")  # texts that have a line t
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), node], 1)
    for t in range(most):
        at = begin[: live[t]] + t
        a = score[at] if t == 0 else score[at] + np.logaddexp(fwd[at - 1, :1] + edge[0], fwd[at - 1, 1:] + edge[1])
        fwd[at] = a - a.max(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = score[at + 1] + bwd[at + 1]
        b = np.logaddexp(nxt[:, :1] + edge[:, 0], nxt[:, 1:] + edge[:, 1])
        bwd[at] = b - b.max(1, keepdims=True)
    both = fwd + bwd
    good = sigmoid(both[:, 1] - both[:, 0])
    joint = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[begin + lines - 1] = False
    at = np.flatnonzero(inner)
    j = fwd[at][:, :, None] + edge[None] + (score[at + 1] + bwd[at + 1])[:, None, :]
    j = np.exp(j - j.max((1, 2), keepdims=True))
    joint[at] = j / j.sum((1, 2), keepdims=True)
    return good, joint


@dataclass
class QualityModel:
    node: np.ndarray
    edge: np.ndarray
    scale: tuple[float, float]
    share: float
    fitted: bool

    def raw(self, sums: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of projected() sums: a line's own features, and what they tell its neighbours."""
        begin = np.concatenate([[0], np.cumsum(lines)[:-1]])
        node = sums[:, 0] + self.node[-1]
        before, after = np.zeros(len(node)), np.zeros(len(node))
        before[1:], after[:-1] = sums[:-1, 1], sums[1:, 2]
        before[begin] = 0
        after[begin + lines - 1] = 0
        good, _ = marginals(node + before + after, self.edge, lines)
        weight = length + 1.0
        return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)

    def columns(self) -> np.ndarray:
        """The node's weights by whose features they are for: the line's own, the line's before and the line's after."""
        return self.node[:-1].reshape(3, OWN).T

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        p = np.clip(self.raw(*projected(texts, self.columns())), 1e-6, 1 - 1e-6)
        return sigmoid(self.scale[0] * np.log(p / (1 - p)) + self.scale[1])


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> QualityModel:
    """Maximum likelihood of the lines' labels, each document and each class weighing the same, by Adam steps."""
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), (1.0, 0.0), float(labels.mean()) if len(labels) else 0.5, False)
    own, length, lines = projected(texts, np.eye(OWN))
    x = with_neighbours(own, lines)
    doc = np.repeat(np.arange(len(texts)), lines)
    y = labels[doc].astype(float)
    by_doc = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    weight = (by_doc / lines)[doc]
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lines) - 1] = False
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = weight[inner & (y == s)].sum()
    w = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        edge = w[WIDTH:].reshape(2, 2)
        good, joint = marginals(x @ w[:WIDTH], edge, lines)
        g = np.concatenate([x.T @ (weight * (good - y)), ((joint * weight[:, None, None]).sum(0) - seen).ravel()])
        g += ridge * np.concatenate([w[:WIDTH], 10 * w[WIDTH:]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = QualityModel(w[:WIDTH], w[WIDTH:].reshape(2, 2), (1.0, 0.0), float(labels.mean()), True)
    p = np.clip(model.raw(own @ model.columns(), length, lines), 1e-6, 1 - 1e-6)
    a = logistic(np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1), labels.astype(float), by_doc * len(p), ridge=0.5)
    model.scale = (max(float(a[0]), 1e-3), float(a[1]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, most_bytes: int = 1 << 18) -> QualityModel:
    """Fits on a bounded sample: about per_class labelled documents of each class of at most most_bytes, by a hash of the id; labels other than 0 and 1 don't count."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    roll = F.pmod(F.xxhash64("doc_id", F.lit("quality-sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("quality") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = labels.where(roll < share)  # about per_class rows of each class
    rows = docs.where("text IS NULL OR octet_length(text) <= " + str(most_bytes)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.orderBy(F.xxhash64("quality", "text"), "text").limit(4 * per_class).collect()  # more only if ids repeat; a fixed choice of them
    rows = sorted((r[0], r[1]) for r in rows)
    return fit([t.encode("utf-8", "replace") for _, t in rows], np.array([q for q, _ in rows], int))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with the column `out`: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(shared.value.score([(t or "").encode("utf-8", "replace") for t in col.to_pylist()]) if len(col) else [], pa.float64())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))  # so that no filter on the score works it out a second time


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learnt from the rows that aren't held out."""
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held), labels.where(~held))
    found = score_quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
