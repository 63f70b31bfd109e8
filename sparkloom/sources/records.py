"""Readers and writers of records, manifests and token caches. All go through Spark's sources, so any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised

#: The canonical record columns; `record_kind` tells instruction records from code-only ones.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "task_type", "category", "instruction", "input", "response", "code", "language", "source")]
    + [T.StructField("quality_score", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("family_id", T.StringType())]
)
#: Fixed defaults of missing fields.
DEFAULTS = {"id": "", "category": "misc", "language": "python", "input": "", "source": "unknown", "family_id": ""}


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """value, and ok: whether the line is a JSON object. Blank lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    return lines.withColumn("ok", F.json_object_keys("value").isNotNull())


#: Pieces of files whose numbers of lines may be broadcast, at most.
MOST_PIECES = 1 << 17


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 on) and value of text files, which are read in pieces as usual.

    Lines are counted by piece first; a line's number is what the pieces before it in its file hold, and its place in its own. Both reads plan
    the same pieces, as they read the same files under the same settings.
    """
    own = F.monotonically_increasing_id()
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), own.alias("_at"))
    pieces = materialised(text.groupBy("file", "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select("file", "_piece", "_first", before.alias("_before"))
    starts = F.broadcast(starts) if pieces.count() <= MOST_PIECES else starts
    return text.join(starts, ["file", "_piece"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value, and ok: whether the line is a JSON object, with its place for messages. Blank lines count as lines and are skipped."""
    held = read_lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    return held.withColumn("ok", F.json_object_keys("value").isNotNull())


def line_errors(numbered: DataFrame) -> DataFrame:
    """Of read_numbered's rows those that are no records, with a message that names file and line."""
    return numbered.where(~F.col("ok")).select("file", "line", F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("line").cast("string"), F.lit(": invalid JSON object")).alias("message"))


def gated(rows: DataFrame, reason: Column, path: str, reasons: list[str]) -> DataFrame:
    """Writes rows to path/status=accepted and path/status=rejected, the latter with their reason, and gives (name, n): rows, accepted, rejected and each reason.

    The counts are observed while the rows are written, so everything is read and judged once; reasons outside the list count as `other`.
    """
    seen = Observation()
    held = rows.withColumn("reason", reason)
    known = F.col("reason").isin(reasons)
    counts = [F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if(F.col("reason").isNotNull() & ~known).alias("other"), *[F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in reasons]]
    marked = held.observe(seen, *counts).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
    marked.write.mode("overwrite").partitionBy("status").parquet(path)
    return rows.sparkSession.createDataFrame([(k.removeprefix("reason_"), v) for k, v in seen.get.items()], "name string, n bigint")


def gate_side(spark: SparkSession, path: str, status: str) -> DataFrame:
    """What gated() wrote as accepted or rejected."""
    return spark.read.parquet(path).where(F.col("status") == status).drop("status")


def parse(lines: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Typed records from JSON lines (column value): fields by name, defaults where they are missing, kind by which keys are there."""
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    r = F.from_json("value", RECORD, {"mode": "PERMISSIVE"})
    code = F.array_contains(keys, "code") & ~F.array_contains(keys, "instruction") & ~F.array_contains(keys, "response")
    held = lines.withColumns({"_r": r, "_code": code})
    field = lambda n: F.coalesce(F.col(f"_r.{n}"), F.lit(DEFAULTS[n])) if n in DEFAULTS else F.col(f"_r.{n}")
    columns = {n: field(n) for n in RECORD.fieldNames()}
    columns |= {
        "record_kind": F.when(F.col("_code"), "code").otherwise("instruction"),
        "task_type": F.coalesce("_r.task_type", F.when(F.col("_code"), "code").otherwise("code_generation")),
        "quality_score": F.coalesce("_r.quality_score", F.lit(1.0)),
        "metadata": F.coalesce("_r.metadata", F.create_map().cast("map<string,string>")),
        "instruction": F.when(~F.col("_code"), F.coalesce("_r.instruction", F.lit(""))),
        "response": F.when(~F.col("_code"), F.coalesce("_r.response", F.lit(""))),
        "code": F.when(F.col("_code"), F.col("_r.code")),
    }
    return held.select(*([ordinal] if ordinal else []), *[c.alias(n) for n, c in columns.items()])


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return parse(read_jsonl(spark, path).where("ok"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is a list of objects or an object with an `examples` list: one JSON text a row, as column value."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", "array<string>")).otherwise(F.from_json(F.get_json_object("value", "$.examples"), "array<string>"))
    return whole.select(F.explode(listed).alias("value"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key) of an exclusion manifest; ids and content hashes may go by either of two names. A file that isn't there excludes nothing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "kind string, key string")
    r = F.from_json("value", "problem_ids array<string>, ids array<string>, instruction_hashes array<string>, content_hashes array<string>, hashes array<string>")
    none = F.array().cast("array<string>")
    one = spark.read.text(path, wholetext=True).select(r.alias("r"))
    kinds = {"id": F.coalesce("r.problem_ids", "r.ids", none), "instruction": F.coalesce("r.instruction_hashes", none), "content": F.coalesce("r.content_hashes", "r.hashes", none)}
    parts = [one.select(F.lit(k).alias("kind"), F.explode(v).alias("key")) for k, v in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name and SHA-256 of every file under the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def from_code_search(raw: DataFrame) -> DataFrame:
    """Instruction records from code search rows (language, license, docstring/query, code): those in Python with text, code and a licence."""
    query = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("docstring", "query") if c in raw.columns])
    held = raw.where((F.col("language") == "python") & (F.coalesce("license", F.lit("")) != "") & (F.coalesce("code", F.lit("")) != "")).withColumn("_q", query).where("_q IS NOT NULL")
    said = F.regexp_replace(F.trim("_q"), r"\.+$", "")
    return held.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.lit("code_generation").alias("task_type"), F.lit("misc").alias("category"),
        F.concat(F.lit("Write a Python function that "), said, F.lit(".")).alias("instruction"), F.lit("").alias("input"), F.col("code").alias("response"),
        F.lit("codesearchnet").alias("source"), F.lit(0.9).alias("quality_score"), F.create_map(F.lit("original_query"), F.col("_q"), F.lit("license"), F.col("license")).alias("metadata"),
    )


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> str:
    """JSON lines with keys in order; the job's commit makes the folder appear whole. Gives one SHA-256 over the parts' digests, by name.

    With order the parts are ranges of that column, ordered within, so that their lines, one part after the other, are in order.
    """
    lines = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    lines.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)
    parts = spark_digests(df.sparkSession, path)
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: x["sha256"]), "\n"), 256)).first()[0]


def spark_digests(spark: SparkSession, path: str) -> DataFrame:
    """file_digests of what Spark wrote: parts alone, under the number that they have in the name."""
    return file_digests(spark, path).where(F.col("name").startswith("part-")).withColumn("name", F.regexp_extract("name", r"^part-(\d+)", 1))


def sft_sides(records: DataFrame, path: str) -> DataFrame:
    """The view of records for supervised tuning written as accepted and rejected rows in one pass; (name, n) of both and of each reason."""
    from ..operators.validate import sft_view

    return gated(sft_view(records), F.col("reason"), path, ["empty_instruction", "empty_response", "syntax_invalid"])


def write_corpus(texts: DataFrame, path: str, column: str = "text") -> None:
    """One {"text": ..} a line, for training a tokenizer."""
    texts.select(F.to_json(F.struct(F.col(column).alias("text"))).alias("value")).write.mode("overwrite").text(path)


def write_tokens(tokens: DataFrame, path: str, split: str | None = None) -> None:
    """A packed cache: Parquet rows of ids with their offsets, by split if there is one."""
    w = tokens.write.mode("overwrite")
    (w.partitionBy(split) if split else w).parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
