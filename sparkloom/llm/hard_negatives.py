"""Hard negatives by a full sort of each anchor's scores.

Anchors are rows themselves, every `every`-th id. A score is the inner product of whole numbers, so sums are exact in any order. For an
anchor and one of its positives, the negatives wanted are the best `k` rows of other labels whose scores lie between two shares of the
positive's score.

Rows and anchors are dealt into blocks, rows by a number of their own (so no id or label is hot), and each block of anchors meets each
block of rows in a group of bounded size. A group works out its scores, and for each anchor sorts them by score and id (numpy's lexsort).
First each group gives every anchor its best `positives` rows of the same label, and a ranking over the groups keeps the best of them.
Then, with the positives' scores known, a binary search in the sorted scores finds each positive's upper limit, and the first k rows of
other labels from there that are above its lower limit are read; again a ranking over the groups keeps the first k. No group or ranking
needs more than its own entries, and all rows are scored. The work is anchors times rows, as the stated set of queries asks.

Rows of a null id, label or vector, or of a null or non-finite component, take no part. Shorter vectors count as padded with zeros, and an
empty one scores 0 with all. Components are floor(256 x) and saturate at 64 bits, as scores do; both are exact below. Repeated rows are rows
of their own: a copy of an anchor may be its positive, and each copy of an anchor has its own results. Among equal scores smaller ids come
first; rows of equal score and id can't be told apart in the result. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, stored

EVERY, POSITIVES, K = 50, 5, 3
#: Limits of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Most rows and anchors of a group, and scores that are held at once.
ROWS, ANCHORS, HELD = 1 << 15, 1 << 10, 1 << 21
_KIND = "row bigint, id bigint, label bigint, v array<bigint>"


def prepared(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row (a number of its own), id, label and v, the components as floor(256 x); stored."""
    x = F.col("_v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = embeddings.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return stored(held.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform(x, lambda c: F.floor(c * 256)).cast("array<bigint>").alias("v")))


def _matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, labels and the vectors, padded to the longest."""
    whole = pa.Table.from_batches(batches)
    v = whole.column("v").combine_chunks()
    sizes = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, np.int64)
    out = np.zeros((len(v), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = v.flatten().to_numpy()
    return (*(whole.column(c).to_numpy() for c in ("row", "id", "label")), out)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b; beyond 64 bits the nearest number that fits."""
    n = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = most(a) * most(b) * n
    if bound < 1 << 53:  # every sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object) if n else np.zeros((len(a), len(b)), object)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _order(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, then rising id."""
    return np.lexsort((ids, ~score))  # ~s falls as s rises, without overflow


def first_positives(own: tuple, rows: tuple, positives: int) -> list[tuple]:
    """(anchor's row, id, score) of each anchor's best rows of the same label in this block."""
    out = []
    step = max(1, HELD // max(1, len(rows[0])))
    for at in range(0, len(own[0]), step):
        s = scores(own[3][at : at + step], rows[3])
        for k in range(len(s)):
            same = np.flatnonzero((rows[2] == own[2][at + k]) & (rows[0] != own[0][at + k]))
            best = same[_order(s[k][same], rows[1][same])[:positives]]
            out += [(int(own[0][at + k]), int(i), int(x)) for i, x in zip(rows[1][best], s[k][best])]
    return out


def limited(score: np.ndarray, ids: np.ndarray, other: np.ndarray, wanted: list[int], k: int, low: int = LOW, high: int = HIGH) -> list[list[int]]:
    """For each wanted positive score the places of the first k rows of other labels within its limits, by the sorted scores."""
    order = _order(score, ids)
    order = order[other[order]]
    falling = ~score[order]
    out = []
    for p in wanted:
        top, bottom = (high * p) // 100, -((-low * p) // 100)
        start = int(np.searchsorted(falling, ~top, "left"))
        found = order[start : start + k]
        out.append([int(i) for i in found if score[i] >= bottom])
    return out


def first_negatives(own: tuple, wanted: list[list[tuple[int, int, int]]], rows: tuple, k: int, low: int, high: int) -> list[tuple]:
    """(anchor's row, place of the positive, id, score) of the best k negatives of this block for each anchor and positive."""
    out = []
    step = max(1, HELD // max(1, len(rows[0])))
    for at in range(0, len(own[0]), step):
        s = scores(own[3][at : at + step], rows[3])
        for j in range(len(s)):
            asked = wanted[at + j]
            places = limited(s[j], rows[1], rows[2] != own[2][at + j], [p for _, _, p in asked], k, low, high)
            out += [(int(own[0][at + j]), place, int(rows[1][i]), int(s[j][i])) for (place, _, _), found in zip(asked, places) for i in found]
    return out


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors together, with the group (r, b) in which they meet; `anchor` tells which is which."""
    r = max(-(-n_rows // ROWS), min(partitions(rows.sparkSession), max(1, n_rows // 1024)))
    b = max(1, -(-n_anchors // ANCHORS))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    wide = rows.select("*", deal(r).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"), F.lit(False).alias("anchor"))
    return wide.unionByName(anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), deal(b).alias("b"), F.lit(True).alias("anchor")), allowMissingColumns=True)


def _split(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, pa.Table | None]:
    whole = pa.Table.from_batches(list(batches))
    mask = whole.column("anchor")
    own, rows = whole.filter(mask), whole.filter(pc.invert(mask))
    return (own, rows) if len(own) and len(rows) else (None, None)


def hard_negatives(held: DataFrame, every: int = EVERY, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of prepared() rows."""
    anchors = held.where(F.col("id") % every == 0)
    n_rows, n_anchors = held.count(), anchors.count()

    def near(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = _split(batches)
        found = first_positives(_matrix(own.to_batches()), _matrix(rows.to_batches()), positives) if own is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["row", "positive", "score"])

    best = _grid(held, anchors, n_rows, n_anchors).groupBy("r", "b").applyInArrow(near, "row bigint, positive bigint, score bigint")
    placed = best.select("*", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive")).alias("place")).where(F.col("place") <= positives)
    wanted = stored(placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("wanted")))  # `positives` at most
    asked = stored(anchors.join(wanted, "row"))

    def far(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = _split(batches)
        found = []
        if own is not None:
            asks = [[(x["place"], x["positive"], x["score"]) for x in w] for w in own.column("wanted").to_pylist()]
            found = first_negatives(_matrix(own.to_batches()), asks, _matrix(rows.to_batches()), k, low, high)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["row", "place", "negative", "score"])

    met = _grid(held, asked, n_rows, n_anchors).groupBy("r", "b").applyInArrow(far, "row bigint, place int, negative bigint, score bigint")
    ranked = met.select("*", F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "negative")).alias("rank")).where(F.col("rank") <= k)
    named = asked.select("row", F.col("id").alias("anchor_id"), F.inline("wanted").alias("place", "positive_id", "positive_score"))
    return ranked.join(named, ["row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """The contract's query: labels of ids divisible by 7 are moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(embeddings.select("vec_id", "embedding", moved.alias("label"))))


#: The same by all scores of all anchors, for small tables.
NEGATIVES_SQL = """
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.r AS r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.r <> b.r AS other_row, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0
), p AS (
    SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS place FROM s WHERE same AND other_row QUALIFY place <= 5
), n AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
