"""Exact order statistics, and samples of similar pairs, without a sort or a map of all values in one task.

Ranks are found by refining histograms: the values of a range fall into BUCKETS equal parts, one aggregate counts them and tells each
part's own least and greatest value, and the part that holds the rank is the next range. It ends when the part holds one value. A pass
brings at most BUCKETS rows a rank to the driver, whatever the number of rows or of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised, released
from .dedup import few, posting_counts, with_hashes

BUCKETS = 4096


def _bucket(v: Column, low: float, high: float) -> Column:
    """The part of [low, high] that v falls to; it never falls as v grows, whatever the rounding."""
    width = high / 2 - low / 2
    # a quotient first, so that nothing overflows
    return F.least(F.lit(BUCKETS - 1), F.floor((v / 2 - F.lit(low / 2)) / F.lit(width) * (BUCKETS - 1)).cast("int"))


def values_at(df: DataFrame, c: str, ranks: list[int]) -> list[float]:
    """The values of the given ranks, from 0 on, of the column's non-null values in order; NaN is the greatest. Ranks must be below their number."""
    held = df.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL")
    inf = float("inf")
    finite = held.where(~F.isnan("v") & (F.abs("v") != inf))
    edges = held.agg(F.count_if(F.col("v") == -inf), F.count_if(~F.isnan("v") & (F.abs("v") != inf)), F.count_if(F.col("v") == inf), F.min(F.when(~F.isnan("v") & (F.abs("v") != inf), F.col("v"))), F.max(F.when(~F.isnan("v") & (F.abs("v") != inf), F.col("v")))).first()
    below, inside, above = edges[0], edges[1], edges[2]
    out: dict[int, float] = {}
    open_: dict[int, tuple[float, float, int]] = {}  # rank: its range and how many values lie before the range
    for r in set(ranks):
        if r < below:
            out[r] = -inf
        elif r < below + inside:
            open_[r] = (edges[3], edges[4], below)
        else:
            out[r] = inf if r < below + inside + above else math.nan
    while open_:
        ranges = sorted({(low, high) for low, high, _ in open_.values() if low < high})
        found: dict[tuple[float, float], list] = {}
        if ranges:
            # ranges of different ranks are equal or apart
            where, part = F.lit(None).cast("int"), F.lit(None).cast("int")
            for k, (low, high) in enumerate(ranges):
                own = F.col("v").between(low, high)
                where, part = F.when(own, k).otherwise(where), F.when(own, _bucket(F.col("v"), low, high)).otherwise(part)
            rows = finite.select("v", where.alias("k"), part.alias("b")).where("k IS NOT NULL").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for row in rows:
                found.setdefault(ranges[row["k"]], []).append(row)
        for r, (low, high, before) in list(open_.items()):
            if low == high:
                out[r] = low
                del open_[r]
                continue
            for row in sorted(found[low, high], key=lambda x: x["b"]):
                if r < before + row["n"]:
                    open_[r] = (row["low"], row["high"], before)
                    break
                before += row["n"]
    return [out[r] for r in ranks]


def lower_quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """q and value at index floor((n - 1) q) of the ordered values, in the column's type; no rows without values."""
    n = df.agg(F.count(c)).first()[0]
    found = values_at(df, c, [math.floor((n - 1) * q) for q in at]) if n else []
    kind = df.schema[c].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(zip(at, found)), "q double, value double").withColumn("value", F.col("value").cast(kind))


def linear_quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """q and value by linear interpolation between the two nearest ranks; null without values."""
    n = df.agg(F.count(c)).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([(q, None) for q in at], "q double, value double")
    places = [(n - 1) * q for q in at]
    found = values_at(df, c, [r for p in places for r in (math.floor(p), math.ceil(p))])
    rows = [(q, found[2 * k] if found[2 * k] == found[2 * k + 1] else found[2 * k] + (found[2 * k + 1] - found[2 * k]) * (p - math.floor(p))) for k, (q, p) in enumerate(zip(at, places))]
    return df.sparkSession.createDataFrame(rows, "q double, value double")


#: Rows of a range partition, about, and parts at most.
PART_ROWS, PARTS = 200_000, 4096


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, the place of each row from 0 on in the order; stored. Range partitions are numbered by themselves and start where those before end."""
    spark = df.sparkSession
    rows = materialised(df)
    parts = min(PARTS, max(1, -(-rows.count() // PART_ROWS)))
    own = F.monotonically_increasing_id()
    held = materialised(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.shiftright(own, 33).cast("int").alias("_part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("_own")))
    released(rows)
    counts = {r[0]: r[1] for r in held.groupBy("_part").count().collect()}  # PARTS at most
    starts, at = [], 0
    for k in range(max(counts, default=0) + 1):
        starts.append(at)
        at += counts.get(k, 0)
    return held.withColumn("place", F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_part")) + F.col("_own")).drop("_part", "_own")


def sampled_pairs(held: DataFrame, ordinal: str, wanted: int = 10_000, seed: int = 0) -> tuple[DataFrame, float]:
    """(a, b, common, na, nb), once for each time that the pair is drawn, and how many draws one pair and shared shingle expects.

    held has what shingled() or hashed() gives. A list of c documents that share a shingle has c (c - 1) / 2 pairs. Each list draws about wanted x
    its pairs / all pairs of them, by a hash: the whole part of that number, and one more with the probability of the rest. Only the
    postings of lists that draw are placed. A draw is a pair of places in the list, and its documents are looked up by their places, so
    no pair is made that isn't drawn, and no list, however long, is gone through in one task. A pair is drawn for each shingle that it
    shares: weigh it by 1 / common.
    """
    rows = with_hashes(held)
    lists = materialised(posting_counts(rows, "t bigint, c bigint", lambda t, c: [t[c > 1], c[c > 1]]).withColumn("w", F.col("c") * (F.col("c") - 1) / 2))
    total = lists.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return held.sparkSession.createDataFrame([], f"a {held.schema[ordinal].dataType.simpleString()}, b {held.schema[ordinal].dataType.simpleString()}, common int, na int, nb int"), 0.0
    rate = min(1.0, wanted / total) if total > wanted else 1.0
    roll = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = (F.floor(F.col("w") * rate) + (roll(F.lit("times"), "t") < F.col("w") * rate - F.floor(F.col("w") * rate)).cast("int")).cast("int")
    picked = materialised(lists.select("t", "c", (times if rate < 1 else F.lit(1)).alias("times")).where("times > 0"))  # about `wanted` at most
    post = placed(rows.select(F.col(ordinal).alias("o"), F.explode("h").alias("t")).join(few(picked.count())(picked.select("t")), "t").select("t", "o"), "t", "o")
    starts = picked.join(post.groupBy("t").agg(F.min("place").alias("first")), "t")
    if rate < 1:
        draws = starts.select("t", "c", "first", F.explode(F.sequence(F.lit(1), "times")).alias("k"))
        x = F.floor(roll(F.lit("x"), "t", "k") * F.col("c"))
        y = F.floor(roll(F.lit("y"), "t", "k") * (F.col("c") - 1))
        drawn = draws.select((F.col("first") + x).alias("x"), (F.col("first") + F.when(y >= x, y + 1).otherwise(y)).alias("y"))
    else:  # all pairs: there are at most `wanted`
        one = starts.select("c", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 2)).alias("i"))
        drawn = one.select((F.col("first") + F.col("i")).alias("x"), F.explode(F.sequence(F.col("first") + F.col("i") + 1, F.col("first") + F.col("c") - 1)).alias("y"))
    drawn = materialised(drawn)
    at = lambda s: post.select(F.col("place").alias(s), F.col("o").alias(f"o{s}"))
    named = materialised(drawn.join(at("x"), "x").join(at("y"), "y").select(F.least("ox", "oy").alias("a"), F.greatest("ox", "oy").alias("b")))

    def side(s: str) -> DataFrame:
        ends = named.select(F.col(s).alias(ordinal)).distinct()
        return rows.join(few(ends.count())(ends), ordinal, "left_semi").select(F.col(ordinal).alias(s), F.col("h").alias(f"g{s}"), F.col("n").alias(f"n{s}"))

    out = materialised(named.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"), "na", "nb"))
    released(lists, picked, drawn, named)
    return out, rate


def sampled_audit(held: DataFrame, ordinal: str, wanted: int = 10_000, seed: int = 0) -> DataFrame:
    """What similarity_audit tells of all pairs that share a shingle, estimated from about `wanted` draws, with standard errors.

    draws; pairs and pairs_error; for each bound the estimated pairs; the greatest similarity seen; mean_similarity and mean_error. Without more
    than `wanted` pairs and shared shingles everything is counted, and errors are 0.
    """
    drawn, rate = sampled_pairs(held, ordinal, wanted, seed)
    union = F.col("na") + F.col("nb") - F.col("common")
    each = drawn.select("common", union.alias("u"), (1 / F.col("common")).alias("w"), (F.col("common") / union).alias("j"))
    up = F.lit(1 / rate if rate else 0.0)
    row = each.agg(
        F.count("*").alias("draws"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("_ww"),
        *[F.coalesce(F.sum(F.when(F.col("common") * 100 >= F.col("u") * p, F.col("w"))), F.lit(0.0)).alias(f"gte_0_{p}") for p in (80, 90, 95, 99)],
        F.coalesce(F.max("j"), F.lit(0.0)).alias("max_similarity"),
        F.coalesce(F.sum(F.col("w") * F.col("j")), F.lit(0.0)).alias("_wj"),
        F.coalesce(F.sum(F.col("w") * F.col("w") * F.col("j")), F.lit(0.0)).alias("_wwj"),
        F.coalesce(F.sum(F.col("w") * F.col("w") * F.col("j") * F.col("j")), F.lit(0.0)).alias("_wwjj"),
    )
    mean = F.coalesce(F.try_divide("_wj", "_w"), F.lit(0.0))
    exact = F.lit(rate >= 1 or not rate)
    spread = F.col("_wwjj") - 2 * mean * F.col("_wwj") + mean * mean * F.col("_ww")
    return row.select(
        "draws",
        (F.col("_w") * up).alias("pairs"),
        F.when(exact, 0.0).otherwise(F.sqrt("_ww") * up).alias("pairs_error"),
        *[(F.col(f"gte_0_{p}") * up).alias(f"gte_0_{p}") for p in (80, 90, 95, 99)],
        "max_similarity",
        mean.alias("mean_similarity"),
        F.when(exact, 0.0).otherwise(F.coalesce(F.try_divide(F.sqrt(F.greatest(spread, F.lit(0.0))), F.col("_w")), F.lit(0.0))).alias("mean_error"),
    )
