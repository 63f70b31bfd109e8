"""Closed forms around training: parameter counts, the learning rate, and the quality target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_parts(vocabulary: Column, layers: int = 24, width: int = 768, hidden: int = 2176) -> Column:
    """Array of part and parameters of a decoder with tied embeddings, gated feed-forward layers and two norms a layer."""
    v, (n, d, f) = vocabulary.cast("bigint"), (F.lit(x).cast("bigint") for x in (layers, width, hidden))
    parts = {"embedding": v * d, "attention": n * 4 * d * d, "feed_forward": n * 3 * d * f, "norms": n * 2 * d + d}
    return F.array(*[F.struct(F.lit(k).alias("part"), x.alias("parameters")) for k, x in (parts | {"total": sum(parts.values(), F.lit(0))}).items()])


def parameter_breakdown(spark: SparkSession, vocabulary: int = 32_000, layers: int = 24, width: int = 768, hidden: int = 2176) -> DataFrame:
    return spark.range(1).select(F.explode(parameter_parts(F.lit(vocabulary), layers, width, hidden)).alias("x")).select("x.*")


def learning_rate(step: Column, top: float, least: float, warm_up: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to the least rate."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warm_up) / F.lit(max(1, total - warm_up))))
    return F.when(step < warm_up, F.lit(top) * step / max(1, warm_up)).otherwise(least + (top - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * share)))


def schedule(spark: SparkSession, steps: int, top: float, least: float, warm_up: int) -> DataFrame:
    return spark.range(steps + 1).select(F.col("id").alias("step"), learning_rate(F.col("id"), top, least, warm_up, steps).alias("rate"))


def decay_groups(parameters: DataFrame, name: str = "name", dims: str = "dims", count: str = "parameters") -> DataFrame:
    """Weights of two or more dimensions decay; norms, biases and vectors don't."""
    decays = (F.col(dims) >= 2) & ~F.lower(F.col(name)).rlike("norm|bias")
    return parameters.groupBy(F.when(decays, "decay").otherwise("no_decay").alias("group")).agg(F.count("*").alias("tensors"), F.sum(count).alias("parameters"))


def meets_target(syntax: Column, compiled: Column, functional: Column, eos: Column) -> Column:
    return (syntax >= 0.8) & (compiled >= 0.8) & (functional >= 0.5) & (eos >= 0.95)


def cross_entropy(logits: Column, target: Column, ignore: int = -100) -> Column:
    """Loss of one position: log of the summed exponentials, less the target's logit; null for an ignored target, so that avg leaves it out."""

    def of(x: Column) -> Column:
        top = F.array_max(x)
        return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) - F.get(x, target)

    return F.when(target != ignore, F.get(F.transform(F.array(logits), of), F.lit(0)))


def clipping(gradients: DataFrame, values: str, most: float = 1.0) -> DataFrame:
    """One row: the norm over all arrays, the factor that brings it to `most` at most, and counts of values that are no finite numbers."""
    v = F.col(values).cast("array<double>")
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    row = gradients.agg(F.sqrt(F.coalesce(F.sum(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).alias("norm"), F.coalesce(F.sum(F.size(F.filter(v, odd))), F.lit(0)).cast("bigint").alias("not_finite"))
    return row.withColumn("factor", F.least(F.lit(1.0), F.lit(float(most)) / (F.col("norm") + 1e-6)))
