"""Counts, distributions and report rows. Everything is an aggregate; what is one row stays a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedup_form, lengths, quality_bucket, size_class
from ..session import materialised
from . import selection


def dataset_statistics(df: DataFrame, instruction: Column, response: Column, syntax: Column | None = None) -> DataFrame:
    """One row: total, mean, least and greatest lengths, share of valid syntax, size class; zeros for no rows."""
    zero = lambda c, t="double": F.coalesce(c, F.lit(0)).cast(t)
    li, lr = F.length(instruction), F.length(response)
    row = df.agg(
        F.count("*").alias("total"),
        *[zero(f(c), t).alias(f"{n}_{side}_chars") for side, c in (("instruction", li), ("response", lr)) for n, f, t in (("avg", F.avg, "double"), ("min", F.min, "bigint"), ("max", F.max, "bigint"))],
        *([zero(F.avg(syntax.cast("double")) * 100).alias("syntax_percent")] if syntax is not None else []),
    )
    return row.withColumn("size_class", size_class(F.col("total")))


def dimension_counts(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dim, value, n) for each dimension, in one pass over the rows."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for n, c in dims.items()])).alias("x"))
    return each.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def margins(df: DataFrame, dims: dict[str, Column], sets: list[tuple[str, ...]]) -> DataFrame:
    """Every dimension's value ('*' where it is summed over) and n, for each set of dimensions, by grouping sets in one aggregate."""
    held = df.select(*[F.coalesce(c.cast("string"), F.lit("unknown")).alias(d) for d, c in dims.items()])
    grouped = held.groupingSets([[F.col(d) for d in own] for own in sets], *[F.col(d) for d in dims])
    counted = grouped.agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    return counted.select(*[F.when(F.col(f"_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims], "n")


def dataset_summary(df: DataFrame, dims: dict[str, Column], score: Column | None = None) -> DataFrame:
    """dimension_counts, with the quality histogram as one more dimension: what a report on records lists beside dataset_statistics."""
    return dimension_counts(df, dims | ({"quality": quality_bucket(score)} if score is not None else {}))


def sft_summary(df: DataFrame, instruction: Column, response: Column, cases: Column, distinct: dict[str, Column]) -> DataFrame:
    """One row on instruction records: mean lengths of the normal forms, least and most test cases, distinct prompts, responses and other values, share of distinct responses. Zeros for no rows."""
    i, r = dedup_form(F.coalesce(instruction, F.lit(""))), dedup_form(F.coalesce(response, F.lit("")))
    # digests, so that whole texts aren't shuffled for the distinct counts
    held = df.select(F.xxhash64(i, F.lit(1)).alias("hi"), F.xxhash64(i, F.lit(2)).alias("gi"), F.xxhash64(r, F.lit(1)).alias("hr"), F.xxhash64(r, F.lit(2)).alias("gr"), F.length(i).alias("li"), F.length(r).alias("lr"), cases.alias("c"), *[c.alias(f"d_{n}") for n, c in distinct.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = held.agg(
        F.count("*").alias("n"), zero(F.avg("li")).cast("double").alias("avg_prompt_chars"), zero(F.avg("lr")).cast("double").alias("avg_response_chars"), zero(F.min("c")).cast("bigint").alias("min_cases"), zero(F.max("c")).cast("bigint").alias("max_cases"),
        F.count_distinct("hi", "gi").alias("unique_prompts"), F.count_distinct("hr", "gr").alias("unique_responses"), *[F.count_distinct(f"d_{n}").alias(f"unique_{n}") for n in distinct],
    )
    return row.withColumn("response_unique_rate", F.coalesce(F.try_divide("unique_responses", "n"), F.lit(0.0)))


def validation_counters(checked: DataFrame, id_: str = "id", category: str = "category", missing: Column | None = None) -> DataFrame:
    """One row over records with valid, syntax_valid and non_python: counts, and PASS where none is invalid, no id repeats and no category is unknown (null)."""
    none = missing if missing is not None else F.lit(False)
    row = checked.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(~F.col("syntax_valid")).alias("syntax_failures"), F.count_if(none).alias("missing_fields"),
        (F.count(id_) - F.count_distinct(id_)).alias("duplicate_ids"), F.count_if(F.col(category).isNull()).alias("invalid_categories"), F.count_if("non_python").alias("non_python"),
    )
    passed = (F.col("invalid") == 0) & (F.col("duplicate_ids") == 0) & (F.col("invalid_categories") == 0)
    return row.withColumn("result", F.when(passed, "PASS").otherwise("FAIL"))


def quality_histogram(df: DataFrame, score: Column) -> DataFrame:
    return df.groupBy(quality_bucket(score).alias("bucket")).agg(F.count("*").alias("n"))


def family_profile(df: DataFrame, family: str) -> DataFrame:
    """Families, the median and the greatest number of rows of one."""
    sizes = materialised(df.groupBy(family).agg(F.count("*").alias("n")))
    median = selection.linear_quantiles(sizes, "n", [0.5]).select(F.col("value").alias("median_rows"))
    return sizes.agg(F.count("*").alias("families"), F.max("n").alias("max_rows")).join(median, how="cross").select("families", "median_rows", "max_rows")  # of one row each


def distinct_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """kind, rows, distinct and surplus; each kind aggregates by itself, so no rows are multiplied beyond the kinds."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("key")) for n, c in keys.items()])).alias("x")).groupBy("x.kind", "x.key").count()
    return each.groupBy("kind").agg(F.sum("count").alias("rows"), F.count("*").alias("distinct_keys"), F.sum(F.col("count") - 1).alias("surplus"))


def split_audit(df: DataFrame, instruction: Column, response: Column, syntax: Column, malformed: Column, long: int = 20_000) -> DataFrame:
    text = F.length(instruction) + F.length(response)
    tests = {"malformed": malformed, "syntax_invalid": ~syntax, "empty_instruction": F.trim(instruction) == "", "empty_response": F.trim(response) == "", "overlong": text > long}
    return df.agg(F.count("*").alias("seen"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def corpus_stats(df: DataFrame, text: Column, *by: str) -> DataFrame:
    """documents, characters, bytes and lines, in all or by columns."""
    held = df.select(*by, lengths(text).alias("l"))
    sums = [F.count("*").alias("documents")] + [F.coalesce(F.sum(f"l.{n}"), F.lit(0)).alias(n) for n in ("chars", "bytes", "lines")]
    return held.groupBy(*by).agg(*sums) if by else held.agg(*sums)


def token_metrics(df: DataFrame, text: Column, ids: Column, unknown: int = 3) -> DataFrame:
    """Sums and ratios of a tokenised corpus; a ratio over nothing is 0."""
    row = df.agg(
        F.count("*").alias("examples"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"),
        F.sum(F.size(ids)).alias("tokens"), F.sum(F.size(F.filter(ids, lambda x: x == unknown))).alias("unknown"),
    )
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return row.withColumns({"chars_per_token": over("chars", "tokens"), "bytes_per_token": over("bytes", "tokens"), "tokens_per_char": over("tokens", "chars"), "tokens_per_example": over("tokens", "examples"), "unknown_rate": over("unknown", "tokens")})


def linear_quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """q and value by linear interpolation, exactly, by refining histograms."""
    return selection.linear_quantiles(df, c, at)


def lower_quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """q and value at index floor((n - 1) q) of the ordered values, by refining histograms."""
    return selection.lower_quantiles(df, c, at)


def distribution(df: DataFrame, c: str) -> DataFrame:
    """count, min, mean and the lower p50, p90, p95, p99, and max, in one row."""
    q = lower_quantiles(df, c, [0.5, 0.9, 0.95, 0.99]).groupBy().pivot("q", [0.5, 0.9, 0.95, 0.99]).agg(F.first("value")).toDF("p50", "p90", "p95", "p99")
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max")).join(q, how="cross")  # of one row each


#: Fixed value: the sequence lengths to choose from.
CANDIDATES = (64, 96, 128, 192, 256, 320, 384, 512)


def sequence_candidates(df: DataFrame, c: str, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """For each candidate length: truncated rows, their share, and padding tokens; all in one pass."""
    sums = []
    for k in candidates:
        sums += [F.count_if(F.col(c) > k).alias(f"t{k}"), F.coalesce(F.sum(F.greatest(F.lit(0), F.lit(k) - F.col(c))), F.lit(0)).alias(f"p{k}")]
    row = df.agg(F.count(c).alias("n"), *sums)
    each = F.array(*[F.struct(F.lit(k).alias("length"), F.col(f"t{k}").alias("truncated"), F.col(f"p{k}").cast("bigint").alias("padding")) for k in candidates])
    return row.select("n", F.explode(each).alias("x")).select("x.*", F.coalesce(F.try_divide(F.col("x.truncated"), F.col("n")), F.lit(0.0)).alias("rate"))


def selected_length(candidates: DataFrame, fallback: bool = False) -> DataFrame:
    """length: the least candidate that cuts no row. Without one none, or the greatest with fallback."""
    least = F.min(F.when(F.col("truncated") == 0, F.col("length")))
    return candidates.agg((F.coalesce(least, F.max("length")) if fallback else least).alias("length")).where("length IS NOT NULL")


def budget_expectations(df: DataFrame, tokens: str, supervised: str, length: int, batch: int = 8, passes: int = 2) -> DataFrame:
    """One row: examples, tokens, supervised and ignored ones, padding at a fixed length, what an update is expected to hold, updates and steps.

    An example's shifted pair uses one place less than it has tokens.
    """
    row = df.agg(F.count("*").alias("examples"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(supervised), F.lit(0)).alias("supervised"))
    n, t, s = F.col("examples"), F.col("tokens"), F.col("supervised")
    share = lambda x: F.coalesce(F.try_divide(x, n) * batch, F.lit(0.0))
    updates = F.ceil(n / batch)
    return row.select("examples", "tokens", "supervised", (t - s).alias("ignored"), (n * length - t).alias("static_padding"), share(t - n).alias("positions_per_update"), share(s).alias("supervised_per_update"), updates.alias("updates_per_pass"), (updates * passes).alias("steps"), (t - n).alias("positions_per_pass"))


def training_progress(log: DataFrame, step: str = "step", recent: int = 20) -> DataFrame:
    """One row over a metrics log (train_loss, validation_loss, learning_rate, tokens_seen, gradient_norm, tokens_per_second; nulls where a row has none).

    First, last and best losses, the step of the best validation, means of the last `recent` training rows, and flags: training loss falls,
    validation doesn't rise above its first, and validation is a quarter above training. No row without training rows.
    """
    train, valid = log.where("train_loss IS NOT NULL"), log.where("validation_loss IS NOT NULL")
    of = lambda c, f, name: f(c, step).alias(name)
    row = train.agg(
        F.count("*").alias("_n"), F.max(step).alias("current_step"), of("tokens_seen", F.max_by, "tokens_seen"), of("learning_rate", F.max_by, "learning_rate"),
        of("train_loss", F.min_by, "initial_train_loss"), of("train_loss", F.max_by, "latest_train_loss"), F.min("train_loss").alias("best_train_loss"),
    )
    checked = valid.agg(of("validation_loss", F.min_by, "_first"), of("validation_loss", F.max_by, "latest_validation_loss"), F.min("validation_loss").alias("best_validation_loss"), F.min_by(step, F.struct("validation_loss", step)).alias("best_validation_step"))
    last = train.orderBy(F.desc(step)).limit(recent).agg(F.avg("gradient_norm").alias("recent_gradient_norm"), F.avg("tokens_per_second").alias("recent_tokens_per_second"))
    whole = row.where("_n > 0").join(checked, how="cross").join(last, how="cross")  # of one row each
    flag = lambda c: F.coalesce(c, F.lit(False))
    return whole.withColumns({
        "train_loss_decreasing": F.col("latest_train_loss") < F.col("initial_train_loss"),
        "validation_loss_improving": flag(F.col("latest_validation_loss") <= F.col("_first")),
        "divergence_warning": flag(F.col("latest_validation_loss") > F.col("latest_train_loss") * 1.25),
    }).drop("_n", "_first")


def budget(df: DataFrame, tokens: str, supervised: str, batch: int = 8, passes: int = 6) -> DataFrame:
    """For 1 to `passes` passes: updates, and tokens seen and learnt from."""
    row = df.agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.sum(supervised).alias("supervised"))
    return row.select("n", "tokens", "supervised", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("passes")).select(
        "passes", (F.ceil(F.col("n") / batch) * F.col("passes")).alias("updates"), (F.col("tokens") * F.col("passes")).alias("tokens_seen"), (F.col("supervised") * F.col("passes")).alias("supervised_seen")
    )


def generation_summary(df: DataFrame, text: Column) -> DataFrame:
    """count, share of distinct outputs, surplus copies, and whether all outputs begin alike."""
    each = df.select(dedup_form(text).alias("t")).groupBy("t").count()
    row = each.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("distinct_outputs"), F.count_distinct(F.substring("t", 1, 80)).alias("prefixes"))
    return row.select("n", F.try_divide("distinct_outputs", "n").alias("unique_rate"), (F.col("n") - F.col("distinct_outputs")).alias("surplus"), ((F.col("n") > 0) & (F.col("prefixes") <= 1)).alias("prefix_collapse"))


def evaluation_rates(df: DataFrame) -> DataFrame:
    """Rates over all rows, and executable and functional rates over the rows where they apply; null where none does."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return df.agg(F.count("*").alias("n"), rate("syntax_valid").alias("syntax_rate"), rate("compile_valid").alias("compile_rate"), rate("executable").alias("executable_rate"), rate("functional_correct").alias("functional_rate"))


def similarity_audit(pairs: DataFrame) -> DataFrame:
    """Pairs (common, na, nb) counted at 0.80, 0.90, 0.95 and 0.99, with the greatest and mean similarity."""
    union = F.col("na") + F.col("nb") - F.col("common")
    at = {"gte_0_80": 80, "gte_0_90": 90, "gte_0_95": 95, "gte_0_99": 99}
    j = F.col("common") / union
    return pairs.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("common") * 100 >= union * p).alias(n) for n, p in at.items()], F.coalesce(F.max(j), F.lit(0.0)).alias("max_similarity"), F.coalesce(F.avg(j), F.lit(0.0)).alias("mean_similarity"))


def top_values(df: DataFrame, value: Column, ordinal: str, n: int = 10) -> DataFrame:
    """The most frequent values; of equals the one that occurs first."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def progress_summary(df: DataFrame, step: str, metric: str, last: int = 20) -> DataFrame:
    """First, last and best value of a metric, the best's step, and the mean of the last so many; top-k, not one big sort."""
    held = df.where(F.col(metric).isNotNull())
    tail = held.orderBy(F.desc(step)).limit(last).agg(F.avg(metric).alias("recent_mean"))
    row = held.agg(F.count("*").alias("n"), F.min_by(metric, step).alias("first"), F.max_by(metric, step).alias("last"), F.min(metric).alias("best"), F.min_by(step, F.struct(metric, step)).alias("best_step"))
    return row.join(tail, how="cross").withColumn("improved", F.col("last") < F.col("first"))  # of one row each


def gate(checks: DataFrame, name: str = "name", passed: str = "passed") -> DataFrame:
    """status PASS if every check passed, with the names of those that didn't."""
    return checks.agg(F.when(F.coalesce(F.bool_and(passed), F.lit(False)), "PASS").otherwise("FAIL").alias("status"), F.array_sort(F.collect_list(F.when(~F.col(passed), F.col(name)))).alias("failed"))


def classify_split(overlaps: dict[str, Column]) -> Column:
    """A test split by what it shares with training: prompts, solutions or templates, in that order."""
    found = [F.when(n > 0, f"shares_{label}") for label, n in overlaps.items()]
    return F.coalesce(*found, F.lit("disjoint"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
