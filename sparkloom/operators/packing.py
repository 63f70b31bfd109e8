"""Token streams, training windows, answer masks and cache checks, on arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE, BOS, EOS, PAD = -100, 1, 2, 0


def framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


#: Rows of a range of offsets(), about; ranges are 64 to 1024.
RANGE_ROWS = 200_000


def offsets(df: DataFrame, ordinal: str, length: Column, ranges: int | None = None) -> DataFrame:
    """df with start: the summed lengths of all rows with smaller ordinals.

    Rows are cut into ranges of ordinals, as many as they need; sums run inside each, and the ranges' totals (a row each) are carried along.
    """
    held = df.withColumn("_n", length.cast("bigint"))
    ranges = ranges or min(1024, max(64, -(-df.count() // RANGE_ROWS)))
    q = held.agg(F.percentile_approx(ordinal, [(k + 1) / ranges for k in range(ranges - 1)], 10_000).alias("q")).first()["q"] or []
    borders = sorted(set(q))
    held = held.withColumn("_r", F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<bigint>"), lambda b: b < F.col(ordinal))) if borders else F.lit(0))
    totals = held.groupBy("_r").agg(F.sum("_n").alias("_t"))
    carry = totals.select(F.col("_r"), F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))  # one row a range
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_s", inner).join(F.broadcast(carry), "_r").withColumn("start", F.col("_s") + F.col("_c")).drop("_n", "_r", "_s", "_c")


def stream(df: DataFrame, ids: str, start: str = "start") -> DataFrame:
    """(pos, token): the packed stream."""
    return df.select(F.col(start), F.posexplode(ids).alias("k", "token")).select((F.col(start) + F.col("k")).alias("pos"), "token")


def windows(ids: Column, length: int, stride: int = 1) -> Column:
    """Training windows of a stream: index, x and y (x shifted by one)."""

    def of(held: Column) -> Column:
        n = F.size(held) - length
        at = lambda i: F.struct(i.alias("index"), F.slice(held, i + 1, length).alias("x"), F.slice(held, i + 2, length).alias("y"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), at)).otherwise(F.array())

    return F.get(F.transform(F.array(ids), of), F.lit(0))


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("bigint")


def sft_encoding(prompt: Column, answer: Column, length: int) -> Column:
    """input_ids, labels, prompt and answer lengths, truncated. Prompts have BOS, answers EOS.

    More than length + 1 ids: an answer that fills them keeps its last ones and the prompt goes; else the prompt keeps BOS and its tail.
    Where exactly one prompt id fits, that is BOS.
    """
    capacity = length + 1
    p, a = F.concat(F.array(F.lit(BOS)), prompt), F.concat(answer, F.array(F.lit(EOS)))
    over = F.size(p) + F.size(a) > capacity
    room = F.lit(capacity) - F.size(a)
    tail = F.when(room > 1, F.slice(p, F.size(p) - room + 2, room - 1)).otherwise(F.array().cast("array<int>"))
    cut_p = F.when(~over, p).when(room <= 0, F.array().cast("array<int>")).otherwise(F.concat(F.slice(p, 1, 1), tail))
    cut_a = F.when(over & (room <= 0), F.slice(a, F.size(a) - capacity + 1, capacity)).otherwise(a)
    return F.struct(
        F.concat(cut_p, cut_a).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(cut_p)), cut_a).alias("labels"),
        F.size(cut_p).alias("prompt_length"), F.size(cut_a).alias("answer_length"), over.alias("truncated"),
    )


def padded(input_ids: Column, labels: Column, length: int) -> Column:
    """x and y of a fixed length: ids, and the labels shifted by one."""
    use = F.least(F.lit(length), F.greatest(F.lit(0), F.size(input_ids) - 1))
    x = F.concat(F.slice(input_ids, 1, use), F.array_repeat(F.lit(PAD), F.lit(length) - use))
    y = F.concat(F.slice(labels, 2, use), F.array_repeat(F.lit(IGNORE), F.lit(length) - use))
    return F.struct(x.alias("x"), y.alias("y"))


def cache_stats(df: DataFrame, ids: str) -> DataFrame:
    n = F.size(ids)
    has = lambda t: F.coalesce(F.sum(F.size(F.filter(ids, lambda x: x == t))), F.lit(0))
    return df.agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("avg_tokens"), has(BOS).alias("bos"), has(EOS).alias("eos"), F.min(F.array_min(ids)).alias("min_id"), F.max(F.array_max(ids)).alias("max_id"))


def sft_cache_stats(encoded: DataFrame, encoding: str = "e") -> DataFrame:
    """One row over sft_encoding structs: documents, stored, answer and ignored tokens, truncated documents, longest document. Zeros for no rows."""
    n = F.size(f"{encoding}.input_ids")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return encoded.agg(
        F.count("*").alias("documents"), zero(F.sum(n)).alias("stored_tokens"), zero(F.sum(f"{encoding}.answer_length")).alias("answer_tokens"), zero(F.sum(f"{encoding}.prompt_length")).alias("ignored_tokens"),
        F.count_if(f"{encoding}.truncated").alias("truncated"), zero(F.max(n)).alias("max_tokens"),
    )


def cache_checks(df: DataFrame, ids: str, labels: str, vocabulary: int = 32_000) -> DataFrame:
    """(name, passed): ids in range, same lengths, both kinds of label, labels that repeat their ids."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    row = df.agg(
        every(F.forall(ids, lambda x: (x >= 0) & (x < vocabulary))).alias("ids_in_range"), every(F.size(ids) == F.size(labels)).alias("same_length"),
        F.coalesce(F.bool_or(F.exists(labels, lambda x: x == IGNORE)), F.lit(False)).alias("has_ignored"), F.coalesce(F.bool_or(F.exists(labels, lambda x: x != IGNORE)), F.lit(False)).alias("has_supervised"),
        every(F.forall(F.zip_with(ids, labels, lambda a, b: (b == IGNORE) | (a == b)), lambda x: x)).alias("labels_match"),
    )
    return row.unpivot([], row.columns, "name", "passed")


def checked_ids(ids: Column, vocabulary: int = 32_000) -> Column:
    """The ids; reading a row with one outside the vocabulary raises."""
    return F.when(F.exists(ids, lambda x: x.isNull() | (x < 0) | (x >= vocabulary)), F.raise_error(F.lit("an id lies outside the vocabulary")).cast("array<int>")).otherwise(ids)


def offset_checks(df: DataFrame, start: str, length: Column) -> DataFrame:
    """(name, passed): starts and ends of all rows fit together from 0 to the total, and none is negative.

    Every end but the total must be another row's start: counted by place, so that no order of all rows is needed.
    """
    held = df.select(F.col(start).alias("s"), length.cast("bigint").alias("n"))
    row = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.bool_and((F.col("s") >= 0) & (F.col("n") >= 0)), F.lit(True)).alias("not_negative"), F.coalesce(F.min("s"), F.lit(0)).alias("first"))
    ends = held.select(F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("s") + F.col("n")).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    open_ = ends.groupBy("x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    edges = open_.agg(F.count("*").alias("k"), F.max(F.when(F.col("d") == 1, F.col("at"))).alias("a"), F.max(F.when(F.col("d") == -1, F.col("at"))).alias("z"))
    both = row.join(edges, how="cross")  # of one row each
    told = both.select("not_negative", (F.col("first") == 0).alias("starts_at_zero"), F.when(F.col("total") == 0, F.col("k") == 0).otherwise((F.col("k") == 2) & F.col("a").eqNullSafe(F.lit(0)) & F.col("z").eqNullSafe(F.col("total"))).alias("contiguous"))
    return told.unpivot([], told.columns, "name", "passed")


def sft_gates(encoded: DataFrame, length: int, encoding: str = "e", vocabulary: int = 32_000) -> DataFrame:
    """(name, passed) of what a cache of sft_encoding structs must hold before it is written: ids and labels in range and of one length, no row cut, every
    row with prompt and answer labels, and stored rows of 2 to length + 1 ids."""
    e = lambda c: F.col(f"{encoding}.{c}")
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    row = encoded.agg(
        every(F.forall(e("input_ids"), lambda x: (x >= 0) & (x < vocabulary))).alias("ids_in_range"),
        every(F.forall(e("labels"), lambda x: (x == IGNORE) | ((x >= 0) & (x < vocabulary)))).alias("labels_in_range"),
        every(F.size(e("input_ids")) == F.size(e("labels"))).alias("same_length"),
        every(~e("truncated")).alias("no_truncation"),
        every(F.exists(e("labels"), lambda x: x == IGNORE) & F.exists(e("labels"), lambda x: x >= 0)).alias("both_kinds_everywhere"),
        every(F.size(e("input_ids")).between(2, length + 1)).alias("lengths_fit"),
    )
    return row.unpivot([], row.columns, "name", "passed")


def order_free_digest(df: DataFrame, *columns: str) -> DataFrame:
    """A digest of all rows whatever their order and partitions: two builds of a cache agree in it."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("mixed"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("summed"))


def allowed_splits(df: DataFrame, split: str = "split", forbidden: tuple[str, ...] = ("challenge", "sanity")) -> DataFrame:
    """df as it is; a row of a forbidden split raises when it is read."""
    return df.where(F.when(F.col(split).isin(*forbidden), F.raise_error(F.lit("a frozen split must not be cached")).cast("boolean")).otherwise(True))
