"""Queries for the record, cache, audit and streaming operators that the catalogue doesn't cover, each with DuckDB SQL.

Where the driver's tables have no case of a rule, rows are made from documents by their ids, so that each rule is met.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contamination, curves, dedup, packing, sandbox, skills, stats, validate
from ..session import materialised
from ..sources import records
from ..streaming import incremental
from .catalog import _IDS, NORM, PAIRS, SHINGLES, hashed, pairs, query, table

def _id() -> Column:
    return F.col("doc_id")


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def _word_ids(c: str) -> Column:
    """The catalogue's stand-in for token ids: 10 and a word's length."""
    return F.transform(F.split(c, " "), lambda w: F.length(w) + 10)


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


# --- records ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT conv_id, turn, sha256({NORM.format('instruction')}) AS prompt, sha256({NORM.format("instruction || chr(10) || 'given ' || turn")}) AS prompt_input, sha256({NORM.format('response')}) AS response, sha256({NORM.format('instruction || chr(10) || response')}) AS pair FROM pairs")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = T.record_keys(F.col("instruction"), F.concat(F.lit("given "), F.col("turn")), F.col("response"))
    return pairs(spark, sf_dir).select("conv_id", "turn", *[T.digest(c).alias(n) for n, c in keys.items()])


@query(
    "SELECT doc_id, sha256(trim(text, ' ' || chr(10))) AS instruction, sha256(trim(text, ' ' || chr(10))) AS response, CASE WHEN doc_id % 3 = 0 THEN 'linked_lists' WHEN doc_id % 3 = 1 THEN 'oop' END AS category, "
    "CASE WHEN doc_id % 2 = 0 THEN 'bug_fixing' ELSE 'code_generation' END AS task_type, 'python' AS language, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS source, 'topic_' || lang AS family_id, "
    "CASE WHEN doc_id % 4 = 0 THEN 'py_' || left(sha256(CASE WHEN doc_id % 2 = 0 THEN 'bug_fixing' ELSE 'code_generation' END || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || chr(10) || trim(text, ' ' || chr(10))), 20) ELSE 'r' || doc_id END AS id FROM documents"
)
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.struct(
        F.when(_id() % 4 == 0, " ").otherwise(F.concat(F.lit("r"), _id())).alias("id"), F.concat(F.lit("\r\n "), "text", F.lit(" \r\n")).alias("instruction"), F.concat(F.lit(" ```Python\n"), "text", F.lit("\n```\n")).alias("response"),
        F.when(_id() % 3 == 0, "Linked-List").when(_id() % 3 == 1, "OOP_Python").otherwise("nothing").alias("category"), F.when(_id() % 2 == 0, "Bug-Fixing").alias("task_type"),
        F.when(_id() % 5 == 0, " ").otherwise(F.col("source")).alias("source"), F.concat(F.lit(" Topic "), "lang").alias("family_id"), F.lit("Python").alias("language"),
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", F.to_json(raw).alias("value"))
    held = validate.normalised(records.parse(lines, "doc_id"))
    return held.select("doc_id", T.digest(F.col("instruction")).alias("instruction"), T.digest(F.col("response")).alias("response"), "category", "task_type", "language", "source", "family_id", "id")


#: A record for each rule of the schema: the id's remainder names it.
_BROKEN = ("id", "instruction", "response", "language", "task_type", "category", "quality_score", None)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of which each breaks one rule, or none; a fifth doesn't parse as Python."""
    k = _id() % len(_BROKEN)
    bad = lambda n, wrong, right: F.when(k == _BROKEN.index(n), wrong).otherwise(right)
    response = F.when(_id() % 5 == 0, F.concat(F.lit("x = = "), _id())).otherwise(F.concat(F.lit("total = "), _id()))
    return _docs(spark, sf_dir).select(
        "doc_id", F.lit("instruction").alias("record_kind"), bad("id", " ", F.concat(F.lit("r"), _id() % 700)).alias("id"), bad("instruction", "\n", F.lit("Add the numbers")).alias("instruction"), bad("response", "", response).alias("response"),
        F.lit(None).cast("string").alias("code"), bad("language", "Rust", F.lit(" Python ")).alias("language"), bad("task_type", "poetry", F.lit("code")).alias("task_type"), bad("category", "none", F.lit("math")).alias("category"),
        bad("quality_score", F.lit(1.5), F.lit(0.9)).alias("quality_score"),
    )


_RULE = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_BROKEN) if n) + " END"


@query(f"SELECT coalesce({_RULE}, 'none') AS issue, count(*) AS n FROM documents GROUP BY 1")
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(F.coalesce(validate.schema_issue(), F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


@query(
    f"SELECT doc_id, doc_id % 5 <> 0 OR doc_id % 8 = 2 AS syntax_valid, false AS non_python, array_to_string(list_filter([{_RULE}, CASE WHEN doc_id % 8 = 1 THEN 'empty instruction' END, CASE WHEN doc_id % 8 = 2 THEN 'response/code is too short' END, "
    f"CASE WHEN doc_id % 5 = 0 AND doc_id % 8 <> 2 THEN 'Python syntax error' END], lambda x: x IS NOT NULL), '; ') AS issues, {_RULE} IS NULL AND doc_id % 5 <> 0 AS valid FROM documents"
)
def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(_records(spark, sf_dir)).select("doc_id", "syntax_valid", "non_python", F.array_join("issues", "; ").alias("issues"), "valid")


@query(
    f"WITH v AS (SELECT *, {_RULE} IS NULL AND doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'r' || doc_id % 700 END AS id FROM documents) SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, "
    "count(*) FILTER (doc_id % 5 = 0 AND doc_id % 8 <> 2) AS syntax_failures, count(*) FILTER (doc_id % 8 = 1) AS missing_fields, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (doc_id % 8 = 5) AS invalid_categories, 0::BIGINT AS non_python, 'FAIL' AS result FROM v"
)
def validation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = validate.validate(_records(spark, sf_dir)).withColumn("category", T.category(F.col("category")))
    return stats.validation_counters(held, missing=F.trim(F.replace("instruction", F.lit("\n"), F.lit(""))) == "")


@query("SELECT coalesce(CASE WHEN doc_id % 8 = 1 THEN 'empty_instruction' WHEN doc_id % 8 = 2 THEN 'empty_response' WHEN doc_id % 5 = 0 THEN 'syntax_invalid' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def sft_view_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = validate.sft_view(_records(spark, sf_dir).withColumn("syntax_valid", validate.syntax_valid("response")))
    return held.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS seen, count(*) FILTER (doc_id % 8 = 0) AS malformed, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 8 <> 2) AS syntax_invalid, count(*) FILTER (doc_id % 8 = 1) AS empty_instruction, count(*) FILTER (doc_id % 8 = 2) AS empty_response, 0::BIGINT AS overlong FROM documents")
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _records(spark, sf_dir).withColumn("ok", validate.syntax_valid("response"))
    return stats.split_audit(held, T.strip(F.col("instruction")), F.col("response"), F.col("ok"), F.trim("id") == "")


#: A whole instruction record, and what each remainder changes in it.
_WHOLE = {
    "id": "a", "instruction": "Add two numbers", "input": "", "response": "def solve(a, b):\n    return a + b", "response_type": "code", "category": "math", "skill_id": "add", "prompt_template_id": "p", "difficulty": "easy",
    "task_style": "plain", "function_name": "solve", "test_cases": [{"args": [k, 1], "kwargs": {}, "expected": k + 1} for k in range(5)], "provenance": "generated",
}
_CHANGES: tuple[tuple[dict, str, str], ...] = (
    ({}, "", ""),
    ({"provenance": None}, "missing:provenance", "missing_schema:provenance"),
    ({"response_type": "text"}, "response_type", "response_type"),
    ({"test_cases": _WHOLE["test_cases"][:2]}, "test_cases", "minimum_test_cases"),
    ({"test_cases": _WHOLE["test_cases"][:4]}, "", "minimum_test_cases"),
    ({"response": "import os\ndef solve(a, b):\n    return eval('a + b')"}, "dynamic_execution,unsafe_import", "dynamic_execution,unsafe_import"),
    ({"response": "def solve(a, b:\n"}, "syntax_or_compile", "syntax_or_compile"),
    ({"response": "def add(a, b):\n    return a + b"}, "", "response_function_name"),
    ({"instruction": "Scenario 12: add two numbers"}, "", "artificial_identifier"),
    ({"difficulty": "hard", "function_name": "add"}, "", "difficulty,function_name"),
)


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v, _) in enumerate(_CHANGES)) + " END AS second, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, _, v) in enumerate(_CHANGES)) + " END AS third FROM documents")
def sft_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [json.dumps({n: v for n, v in (_WHOLE | change).items() if v is not None}) for change, _, _ in _CHANGES]
    held = _docs(spark, sf_dir).withColumn("value", F.get(F.array(*map(F.lit, texts)), (_id() % len(texts)).cast("int")))
    second = validate.sft_errors(held).select("doc_id", "value", F.array_join("errors", ",").alias("second"))
    return validate.sft_errors(second, cases=5, strict=True).select("doc_id", "second", F.array_join("errors", ",").alias("third"))


@query("SELECT doc_id, '## ' || doc_id || chr(10) || chr(10) || '- Source: `' || source || '`' || chr(10) || '- Language: `' || lang || '`' || chr(10) || chr(10) || '**Instruction:** ' || n_chars || chr(10) || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) AS section FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id LIMIT 100")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import sampling

    chosen = sampling.sample(table(spark, sf_dir, "documents"), "doc_id", 100)
    return chosen.select("doc_id", T.review(_id(), {"Source": F.col("source"), "Language": F.col("lang")}, F.col("n_chars").cast("string"), F.col("text")).alias("section"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, instruction || CASE WHEN turn % 4 = 0 THEN chr(10) || 'given' ELSE '' END || chr(10) || response AS text FROM pairs")
def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("turn") % 4 == 0, "given").otherwise("")
    return pairs(spark, sf_dir).select("conv_id", "turn", T.row_text(F.col("instruction"), given, F.col("response")).alias("text"))


# --- audits ----------------------------------------------------------------------------------------------------------


@query("WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'lang' AS dim, coalesce(lang, 'unknown') AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM j GROUP BY ALL UNION ALL SELECT 'quality', CASE WHEN quality >= 1 THEN '1.0' WHEN quality >= 0.8 THEN '0.8' ELSE '0.5_or_lower' END, count(*) FROM j GROUP BY ALL")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.dataset_summary(held, {"lang": F.col("lang"), "source": F.col("source")}, F.col("quality"))


@query(
    f"WITH {PAIRS}, p AS (SELECT {NORM.format('instruction')} AS i, {NORM.format('response')} AS r, turn FROM pairs) SELECT count(*) AS n, round(avg(length(i)), 6) AS avg_prompt_chars, round(avg(length(r)), 6) AS avg_response_chars, min(turn) AS min_cases, max(turn) AS max_cases, "
    "count(DISTINCT i) AS unique_prompts, count(DISTINCT r) AS unique_responses, count(DISTINCT turn) AS unique_turn, round(count(DISTINCT r) / count(*), 9) AS response_unique_rate FROM p"
)
def sft_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = stats.sft_summary(pairs(spark, sf_dir), F.col("instruction"), F.col("response"), F.col("turn"), {"turn": F.col("turn")})
    return row.withColumns({"avg_prompt_chars": F.round("avg_prompt_chars", 6), "avg_response_chars": F.round("avg_response_chars", 6), "response_unique_rate": F.round("response_unique_rate", 9)})


_KINDS = {"prompt": "instruction", "solution": "response"}


@query(
    f"WITH {PAIRS}, m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, conv_id * 1000 + turn AS ordinal FROM pairs WHERE conv_id % 2 = 0 AND {NORM.format(c)} IN (SELECT {NORM.format(c)} FROM pairs WHERE conv_id % 2 = 1)" for k, c in _KINDS.items())
    + ") SELECT kind, ordinal, row_number() OVER (PARTITION BY kind ORDER BY ordinal)::INT AS rank FROM m QUALIFY rank <= 20"
)
def challenge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pairs(spark, sf_dir).withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    keys = {k: (T.digest(T.dedup_form(F.col(c))),) * 2 for k, c in _KINDS.items()}
    found = contamination.matches(held.where("conv_id % 2 = 0"), held.where("conv_id % 2 = 1"), keys)
    return contamination.evidence(found, "ordinal").select("kind", "ordinal", "rank")


@query("SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 7 = 0 THEN 'unexpected' WHEN doc_id % 7 = 1 THEN 'missing' WHEN doc_id % 7 = 2 THEN 'changed' ELSE 'same' END AS status FROM documents")
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir, "text").select("doc_id", _id().cast("string").alias("name"), T.digest(F.col("text")).alias("sha256"))
    actual = held.where("doc_id % 7 <> 1").withColumn("sha256", F.when(_id() % 7 == 2, "other").otherwise(F.col("sha256")))
    return contamination.manifest_diff(held.where("doc_id % 7 <> 0"), actual)


@query(f"WITH {SHINGLES}, p AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS r FROM sh) SELECT count(DISTINCT s) AS shingles, count(*) AS postings, count(DISTINCT s) FILTER (r > 100) AS shingles_over, count(*) FILTER (r > 100) AS postings_lost FROM p")
def posting_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.posting_cap(materialised(hashed(spark, sf_dir)))


@query("WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) AS r, count(*) OVER () AS n FROM documents) SELECT count(*) AS n, min(v) AS min, round(avg(v), 6) AS mean, max(v) AS max, " + ", ".join(f"max(v) FILTER (r = floor((n - 1) * {q}::DOUBLE) + 1) AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM s")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(table(spark, sf_dir, "documents"), "n_chars").withColumn("mean", F.round("mean", 6))


@query("SELECT count(*) AS n, round(avg((doc_id % 5 <> 0)::INT), 9) AS syntax_rate, round(avg((doc_id % 5 <> 0)::INT), 9) AS compile_rate, round(avg((doc_id % 3 = 0)::INT) FILTER (doc_id % 2 = 0), 9) AS executable_rate, round(avg((doc_id % 6 = 0)::INT) FILTER (doc_id % 4 = 0), 9) AS functional_rate FROM documents")
def evaluation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = validate.syntax_valid(F.when(_id() % 5 == 0, F.lit("x = =")).otherwise("x = 1"))
    held = _docs(spark, sf_dir).withColumns({"syntax_valid": parsed, "compile_valid": parsed, "executable": F.when(_id() % 2 == 0, _id() % 3 == 0), "functional_correct": F.when(_id() % 4 == 0, _id() % 6 == 0)})
    row = stats.evaluation_rates(held)
    return row.withColumns({c: F.round(c, 9) for c in row.columns if c != "n"})


@query("SELECT count(*) AS tested, count(*) FILTER (doc_id % 9 > 1) AS passed, count(*) FILTER (doc_id % 9 <= 1) AS failed, min(3 + doc_id % 4) AS min_cases, round(count(*) FILTER (doc_id % 9 > 1) / count(*), 9) AS rate, count(*) FILTER (doc_id % 9 <= 1) = 0 AS all_pass FROM documents")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir).select("doc_id", F.when(_id() % 9 == 0, "timeout").when(_id() % 9 > 1, "functional_pass").alias("outcome"), (3 + _id() % 4).alias("test_count"))
    return sandbox.audit_summary(held).withColumn("rate", F.round("rate", 9))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'timeout' END AS outcome FROM documents WHERE doc_id % 9 <= 1 ORDER BY doc_id LIMIT 100")
def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir).select(_id().alias("id"), F.when(_id() % 9 == 0, "timeout").when(_id() % 9 > 1, "functional_pass").alias("outcome"))
    return sandbox.failures(held)


@query("SELECT lang, source, CASE WHEN lang <> 'en' THEN length(lang) END AS size FROM documents")
def skill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("lang", "source")
    return skills.lookup(held, held.where("lang <> 'en'").select("lang", F.length("lang").cast("bigint").alias("size")).distinct(), "lang").select("lang", "source", "size")


# --- caches ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS}, t AS (SELECT len(string_split(instruction, ' ')) + 1 AS p, len(string_split(response, ' ')) + 1 AS a FROM pairs), k AS (SELECT p + a > 65 AS truncated, CASE WHEN p + a > 65 THEN greatest(0, 65 - a) ELSE p END AS p, CASE WHEN p + a > 65 THEN least(a, 65) ELSE a END AS a FROM t) "
       "SELECT count(*) AS documents, sum(p + a)::BIGINT AS stored_tokens, sum(a)::BIGINT AS answer_tokens, sum(p)::BIGINT AS ignored_tokens, count(*) FILTER (truncated) AS truncated, max(p + a)::BIGINT AS max_tokens FROM k")  # fmt: skip
def sft_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sft_cache_stats(pairs(spark, sf_dir).select(packing.sft_encoding(_word_ids("instruction"), _word_ids("response"), 64).alias("e")))


_FRAMED = f"t AS (SELECT conv_id * 1000 + turn AS ordinal, list_concat([1], {_IDS.format('text')}, [2]) AS ids FROM conversations)"


@query(f"WITH {_FRAMED} SELECT count(*) AS documents, sum(len(ids))::BIGINT AS tokens, min(len(ids))::INT AS min_tokens, max(len(ids))::INT AS max_tokens, round(avg(len(ids)), 6) AS avg_tokens, count(*) AS bos, count(*) AS eos, min(list_min(ids))::INT AS min_id, max(list_max(ids))::INT AS max_id FROM t")
def token_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").select(packing.framed(_word_ids("text")).alias("ids"))
    return packing.cache_stats(held, "ids").withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {_FRAMED}, s AS (SELECT *, coalesce(sum(len(ids)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t) SELECT start + unnest(range(len(ids))) AS pos, unnest(ids)::INT AS token FROM s")
def packed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), packing.framed(_word_ids("text")).alias("ids"))
    return packing.stream(packing.offsets(held, "ordinal", F.size("ids")), "ids")


@query(f"WITH {_FRAMED}, u AS (SELECT ordinal, ids, least(32, len(ids) - 1) AS n FROM t) SELECT ordinal, array_to_string(list_resize(ids[1:n], 32, 0), ',') AS x, array_to_string(list_resize(ids[2:n + 1], 32, -100), ',') AS y FROM u")
def padded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), packing.framed(_word_ids("text")).alias("ids"))
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return held.select("ordinal", packing.padded(F.col("ids"), F.col("ids"), 32).alias("e")).select("ordinal", shown("e.x").alias("x"), shown("e.y").alias("y"))


@query("SELECT count(*) AS rows, true AS same FROM conversations")
def cache_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda n: packing.order_free_digest(table(spark, sf_dir, "conversations").repartition(n, "turn").select("conv_id", "turn", packing.framed(_word_ids("text")).alias("ids")), "conv_id", "turn", "ids")
    one, two = build(3), build(5)
    return one.join(two.toDF("r", "m", "s"), how="cross").select("rows", ((F.col("rows") == F.col("r")) & F.col("mixed").eqNullSafe(F.col("m")) & F.col("summed").eqNullSafe(F.col("s"))).alias("same"))  # of one row each


# --- model arithmetic over the embeddings ----------------------------------------------------------------------------

_V = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"WITH e AS (SELECT {{id}} AS id, {_V} AS v FROM embeddings WHERE {{id}} % 7 <> 0), m AS (SELECT id, v, list_max(v) AS top FROM e) SELECT count(*) AS positions, round(avg(top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))) - v[1 + id % 8]), 6) AS loss FROM m".replace("{id}", "vec_id"))
def masked_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("vec_id")
    target = F.when(id_ % 7 == 0, -100).otherwise((id_ % 8).cast("int"))
    held = table(spark, sf_dir, "embeddings").select(curves.cross_entropy(F.col("embedding").cast("array<double>"), target).alias("loss"))
    return held.agg(F.count("loss").alias("positions"), F.round(F.avg("loss"), 6).alias("loss"))


@query(f"WITH n AS (SELECT sqrt(sum(list_sum(list_transform({_V}, lambda x: x * x)))) AS norm FROM embeddings) SELECT round(norm, 6) AS norm, 0::BIGINT AS not_finite, round(least(1.0, 1.0 / (norm + 1e-6)), 9) AS factor FROM n")
def gradient_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.clipping(table(spark, sf_dir, "embeddings"), "embedding").withColumns({"norm": F.round("norm", 6), "factor": F.round("factor", 9)})


# --- streams ---------------------------------------------------------------------------------------------------------


def _local(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - unnest([0, 12]) * INTERVAL 1 HOUR AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY start")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(incremental.drained(incremental.sliding(incremental.events(spark, sf_dir)), "events_sliding", "complete"), "start")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k'
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(incremental.drained(incremental.sessions(incremental.events(spark, sf_dir), "user_id"), "events_sessions", "complete"), "start", "end")


@query("SELECT DISTINCT event_type FROM events")
def events_first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = incremental.dedup_within(incremental.events(spark, sf_dir), F.col("event_type"), "ts", "3650 days")
    return incremental.drained(held.select("event_type"), "events_first_of_kind")
