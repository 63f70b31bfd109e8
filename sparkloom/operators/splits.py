"""Train, validation and test splits by whole families."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

SPLITS = ("train", "validation", "test")


def assign_families(sizes: list[tuple[str, int]], ratios: tuple[float, float, float] = (0.9, 0.05, 0.05)) -> dict[str, str]:
    """Families in the given order, each to the split that lacks most rows of its share; ties go to the earlier split.

    With three families or more the two smallest are kept for validation and test.
    """
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be non-negative and sum to 1")
    total = sum(n for _, n in sizes)
    got, out = dict.fromkeys(SPLITS, 0), {}
    if len(sizes) >= 3:
        for (family, n), split in zip(sorted(sizes, key=lambda x: (x[1], *((False,) if x[0] is None else (True, x[0])))), SPLITS[1:]):
            out[family] = split
            got[split] += n
    for family, n in sizes:
        if family not in out:
            split = max(SPLITS, key=lambda s: (total * ratios[SPLITS.index(s)] - got[s], -SPLITS.index(s)))
            out[family] = split
            got[split] += n
    return out


#: Families of a range that is walked at once, about, and ranges at most.
RANGE, RANGES = 100_000, 4096


def walk(sizes: list[int], got: list[int], total: int, ratios: tuple[float, float, float], out: list[int] | None = None) -> list[int]:
    """Rows that each split has after the families of these sizes, from what it has before; out gets each family's split."""
    a, b, c = got
    wa, wb, wc = (total * r for r in ratios)
    for n in sizes:
        x, y, z = wa - a, wb - b, wc - c
        if x >= y and x >= z:
            a, k = a + n, 0
        elif y >= z:
            b, k = b + n, 1
        else:
            c, k = c + n, 2
        if out is not None:
            out.append(k)
    return [a, b, c]


def _level(got: list[int], rows: int, total: int, ratios: tuple[float, float, float], step: int) -> list[int]:
    """About where `rows` more rows leave the splits, if they come in small families: those that lack most are filled first. In multiples of step."""
    lack = sorted(((total * r - g, k) for k, (r, g) in enumerate(zip(ratios, got))), reverse=True)
    add, left = [0.0] * 3, float(rows)
    for k in range(3):
        # bring the first k + 1 down to the next one's lack
        room = (lack[k][0] - lack[k + 1][0]) * (k + 1) if k < 2 else left
        use = min(left, max(0.0, room))
        for _, j in lack[: k + 1]:
            add[j] += use / (k + 1)
        left -= use
    whole = [int(x) // step * step for x in add]
    first = lack[0][1]
    whole[first] += rows - sum(whole)
    return [g + w for g, w in zip(got, whole)]


def assigned(sizes: DataFrame, family: str, order: list[str], ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), families: int | None = None) -> DataFrame:
    """(family, split) of a table of families and their sizes n, by the rule of assign_families in the given order, without the families on the driver.

    The order is cut into ranges. How a range ends depends on how the one before it ended, so all are walked from a guess, at once; then
    each whose start has turned out otherwise is walked again from there, until every range has started where the one before it ended.
    Walks that start apart mostly meet within a range, so few rounds are needed; a round settles one more range at the least. The
    driver has three numbers for each range.
    """
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be non-negative and sum to 1")
    kind = sizes.schema[family].dataType.simpleString()
    rows = materialised(sizes.select(F.col(family).alias("family"), "n", *order))
    count, total = rows.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return rows.select(F.col("family").alias(family), F.lit("").alias("split"))
    small = rows.orderBy("n", F.asc_nulls_first("family")).limit(2).collect() if count >= 3 else []
    got = [0, *(r["n"] for r in small)] if small else [0, 0, 0]
    reserved = F.lit(None).cast("int")
    for k, r in enumerate(small):
        reserved = F.when(F.col("family").eqNullSafe(F.lit(r["family"]).cast(kind)), k + 1).otherwise(reserved)
    ranges = min(RANGES, max(1, -(-count // (families or RANGE))))
    own = F.monotonically_increasing_id()
    held = materialised(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("family", "n", reserved.alias("reserved"), own.alias("at"), F.shiftright(own, 33).cast("int").alias("part")))

    def table_of(group: pa.Table) -> pa.Table:
        return group.sort_by("at")

    def measured(group: pa.Table) -> pa.Table:
        n = group.filter(pc.is_null(group.column("reserved"))).column("n").to_numpy()
        return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "rows": pa.array([int(n.sum())], pa.int64()), "step": pa.array([int(np.gcd.reduce(n)) if len(n) else 0], pa.int64())})

    facts = {r["part"]: (r["rows"], r["step"]) for r in held.groupBy("part").applyInArrow(measured, "part int, rows bigint, step bigint").collect()}
    parts = sorted(facts)
    step = math.gcd(*(s for _, s in facts.values())) or 1
    start, before = {}, 0
    for p in parts:
        start[p] = _level(got, before, total, ratios, step)
        before += facts[p][0]
    end: dict[int, list[int]] = {}
    todo = set(parts)
    while todo:
        begin = {p: start[p] for p in todo}

        def ended(group: pa.Table) -> pa.Table:
            group = table_of(group)
            p = group.column("part")[0].as_py()
            n = group.filter(pc.is_null(group.column("reserved"))).column("n").to_pylist()
            return pa.table({"part": pa.array([p], pa.int32()), "got": pa.array([walk(n, begin[p], total, ratios)], pa.list_(pa.int64()))})

        end |= {r["part"]: list(r["got"]) for r in held.where(F.col("part").isin(sorted(todo))).groupBy("part").applyInArrow(ended, "part int, got array<bigint>").collect()}
        todo = set()
        for p, q in zip(parts, parts[1:]):
            if start[q] != end[p]:
                start[q] = end[p]
                todo.add(q)

    def named(group: pa.Table) -> pa.Table:
        group = table_of(group)
        free = pc.is_null(group.column("reserved"))
        out: list[int] = []
        walk(group.filter(free).column("n").to_pylist(), start[group.column("part")[0].as_py()], total, ratios, out)
        each = iter(out)
        split = [SPLITS[next(each) if r is None else r] for r in group.column("reserved").to_pylist()]
        return pa.table({"family": group.column("family"), "split": pa.array(split, pa.string())})

    return held.groupBy("part").applyInArrow(named, f"family {kind}, split string").withColumnRenamed("family", family)


def family_split(df: DataFrame, family: str, ordinal: str, seed: int = 42, mode: str = "hash", ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), families: int | None = None) -> DataFrame:
    """df with `split`. mode hash: families in order of a digest, in ranges of about `families`, nothing of them on the driver.

    mode python: families by first occurrence, shuffled by Python's generator, which takes a row of each family on the driver. Rows without
    a family are one family.
    """
    spark = df.sparkSession
    sizes = df.groupBy(family).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"), F.sha2(F.concat(F.lit(str(seed)), F.col(family).cast("string")), 256).alias("digest"))
    if mode == "python":
        rows = [(r[0], r["n"]) for r in sizes.orderBy("first").collect()]
        random.Random(seed).shuffle(rows)
        chosen = spark.createDataFrame(list(assign_families(rows, ratios).items()) or [], f"`{family}` {df.schema[family].dataType.simpleString()}, split string")
    else:
        chosen = materialised(assigned(sizes, family, ["digest"], ratios, families))
    chosen = chosen.withColumnRenamed(family, "_family")
    return df.join(chosen, df[family].eqNullSafe(chosen["_family"])).drop("_family")


def hash_split(df: DataFrame, family: str, seed: int = 42, percent: tuple[int, int] = (90, 95)) -> DataFrame:
    """df with `split` by the family's digest alone: no counting, no shuffle, the same at every size."""
    slot = F.conv(F.substring(F.sha2(F.concat(F.lit(str(seed)), F.col(family).cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(slot < percent[0], "train").when(slot < percent[1], "validation").otherwise("test"))


def leakage(df: DataFrame, family: str, split: str = "split") -> DataFrame:
    """Families that stand in more than one split."""
    return df.groupBy(family).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def smallest_families(df: DataFrame, family: str, n: int = 2) -> DataFrame:
    sizes = df.groupBy(family).agg(F.count("*").alias("size"))
    return sizes.orderBy("size", family).limit(n).withColumn("rank", F.row_number().over(Window.orderBy("size", family)))


def manifest(df: DataFrame, family: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(family).alias("families"))
