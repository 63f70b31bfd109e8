"""Deterministic samples, shuffles and set operations. Order comes from digests of ids, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, id_: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256)


def sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: a top-k by digest."""
    return df.withColumn("_s", seeded(seed, id_)).orderBy("_s", id_).limit(n).drop("_s")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


#: Rows of a bucket of an epoch, about; buckets are 16^2 to 16^4.
BUCKET_ROWS = 200_000


def epoch(df: DataFrame, id_: str, seed: int, number: int, batch: int) -> DataFrame:
    """id, place and batch of one epoch: every row once, in the order of a digest; ranks are counted within buckets of the digest's first letters, as many as the rows need."""
    n, letters = df.count(), 2
    while letters < 4 and n > BUCKET_ROWS * 16**letters:
        letters += 1
    held = df.select(id_).withColumn("_s", F.sha2(F.concat(F.lit(f"{seed}:{number}:"), F.col(id_).cast("string")), 256))
    held = held.withColumn("_b", F.conv(F.substring("_s", 1, letters), 16, 10).cast("int"))
    sizes = held.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))  # a row a bucket
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_s", id_))
    placed = held.withColumn("_r", rank).join(F.broadcast(before), "_b").withColumn("place", F.col("_r") + F.col("_c") - 1)
    return placed.select(id_, "place", F.floor(F.col("place") / batch).cast("bigint").alias("batch"))


def random_windows(spark, windows: int, n: int, seed: int) -> DataFrame:
    """n window indexes with replacement, by draw number; a cursor is the next draw."""
    return spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(windows)).alias("index"))


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)
