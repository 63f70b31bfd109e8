"""Record checks: markers, secrets, length gates, ordered rejection, and checks that need Python's own parser."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CATEGORIES, TASK_TYPES, category, clean_text, content_text, digest, family_id, line_count, stable_id, strip, strip_fence, task_type

#: Markers, patterns and limits.
FOREIGN_MARKERS = ("#include <", "public static void main", "system.out.println", "std::cout", "console.log(", "package main", "func main()")
PLACEHOLDERS = ("solution omitted", "write code here", "placeholder answer")
SECRET_PATTERNS = (
    r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    r"(?:api[_-]?key|access[_-]?token|secret)\s*[:=]\s*[A-Za-z0-9_\-]{16,}",
    r"(?:password|passwd)\s*[:=]\s*\S+",
)
ARTIFICIAL = r"(?:_train_|_validation_|_challenge_|Scenario\s+\d+|\b(?:task|example\s+id)\s+\d+)"
LICENSES = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "CC0-1.0", "project_owned", "generated")
INSTRUCTION_CHARS, RESPONSE_CHARS, RESPONSE_LINES = (10, 2000), (10, 12000), 300
FORBIDDEN_IMPORTS = ("os", "sys", "subprocess", "socket", "shutil", "pathlib", "requests", "urllib", "http", "ftplib")
DYNAMIC_CALLS = ("eval", "exec", "compile", "__import__")
SFT_FIELDS = ("id", "instruction", "input", "response", "response_type", "category", "skill_id", "prompt_template_id", "difficulty", "task_style", "function_name", "test_cases", "provenance")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def non_python(code: Column) -> Column:
    return _any([F.lower(code).contains(m) for m in (*FOREIGN_MARKERS, "<html")])


def placeholder(code: Column) -> Column:
    return _any([F.lower(code).contains(m) for m in PLACEHOLDERS]) | F.lower(code).rlike(r"\btodo\b")


def has_secret(text: Column) -> Column:
    return _any([text.rlike(f"(?i){p}") for p in SECRET_PATTERNS])


def artificial(text: Column) -> Column:
    return text.rlike(f"(?i){ARTIFICIAL}")


def too_short(code: Column) -> Column:
    return F.length(strip(code)) < 3


def length_issue(instruction: Column, response: Column) -> Column:
    """too_short, too_long or null."""
    short = (F.length(instruction) < INSTRUCTION_CHARS[0]) | (F.length(response) < RESPONSE_CHARS[0])
    long = (F.length(instruction) > INSTRUCTION_CHARS[1]) | (F.length(response) > RESPONSE_CHARS[1]) | (line_count(response) > RESPONSE_LINES)
    return F.when(short, "too_short").when(long, "too_long")


def schema_issue(prefix: str = "") -> Column:
    """The first broken rule of a record in canonical columns, or null."""
    c = lambda n: F.col(prefix + n)
    blank = lambda n: F.coalesce(strip(c(n)), F.lit("")) == ""
    code = c("record_kind") == "code"
    return (
        F.when(blank("id"), "id")
        .when(~code & blank("instruction"), "instruction")
        .when(F.when(code, blank("code")).otherwise(blank("response")), "response")
        .when(F.lower(F.coalesce(strip(c("language")), F.lit(""))) != "python", "language")
        .when(~c("task_type").isin(list(TASK_TYPES)), "task_type")
        .when(~c("category").isin(list(CATEGORIES)), "category")
        .when(c("quality_score").isNull() | ~c("quality_score").between(0, 1), "quality_score")
    )


def normalised(records: DataFrame) -> DataFrame:
    """Canonical records (as sources.records.parse gives them) with clean texts, fences off code, canonical labels, language python, a source, a family and an id.

    Unknown labels become null; code records take their family from their category where they name none.
    """
    code = F.col("record_kind") == "code"
    text = lambda n: clean_text(F.coalesce(F.col(n), F.lit("")))
    held = records.withColumns(
        {
            "instruction": F.when(~code, text("instruction")), "input": F.when(~code, text("input")), "response": F.when(~code, strip_fence(text("response"))), "code": F.when(code, strip_fence(text("code"))),
            "category": category(F.col("category")), "task_type": task_type(F.col("task_type")), "language": F.lit("python"), "source": F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("unknown")),
        }
    )
    named = F.coalesce(F.nullif(strip(F.coalesce("family_id", F.lit(""))), F.lit("")), F.when(code, F.col("category")))
    none = F.lit("")
    key = stable_id(F.coalesce("task_type", none), F.coalesce("instruction", none), F.coalesce("input", none), F.coalesce("code", "response", none))
    return held.withColumns({"family_id": family_id(F.coalesce("instruction", none), named), "id": F.when(F.coalesce(strip(F.col("id")), none) == "", key).otherwise(F.col("id"))})


def guard_final(name: str, final: bool, manifest: dict | None = None) -> None:
    """Raises where a test set would be evaluated before its time: without `final`, or while a manifest doesn't show that training left it out."""
    if name.lower().startswith("test") and not final:
        raise ValueError("a test set is evaluated only once, at the end")
    if final:
        held = manifest or {}
        sources = [str(held.get("splits", {}).get(s, {}).get("source", "")).lower() for s in ("train", "validation")]
        if any("test" in s for s in sources) or not held.get("test_split_immutable"):
            raise ValueError("the manifest doesn't show that the test set was left out")


def license_known(license_: Column, allowed: list[str] | tuple[str, ...] | None = None) -> Column:
    known = F.coalesce(license_, F.lit("")) != ""
    return known if allowed is None else known & license_.isin(list(allowed))


# --- checks that need Python's parser -------------------------------------------------------------------------------


def _errors(code: str) -> list[str]:
    """Names of what is wrong with a piece of code."""
    try:
        tree = ast.parse(code)
        compile(tree, "<record>", "exec")
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return ["syntax_or_compile"]
    found = set()
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if any(n.split(".")[0] in FORBIDDEN_IMPORTS for n in names):
            found.add("unsafe_import")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in DYNAMIC_CALLS:
            found.add("dynamic_execution")
    top = [n.name for n in tree.body if isinstance(n, ast.FunctionDef)]
    if top != ["solve"]:
        found.add("not_one_solve")
    return sorted(found)


@F.arrow_udf(T.ArrayType(T.StringType()))
def code_errors(code: pa.Array) -> pa.Array:
    """syntax_or_compile; unsafe_import, dynamic_execution, not_one_solve."""
    return pa.array([_errors(c or "") for c in code.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.BooleanType())
def syntax_valid(code: pa.Array) -> pa.Array:
    """Whether Python's parser of the workers' version takes the text."""
    out = []
    for c in code.to_pylist():
        try:
            ast.parse(c or "")
            out.append(True)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            out.append(False)
    return pa.array(out, pa.bool_())


def validate(records: DataFrame) -> DataFrame:
    """records with code_text, syntax_valid, non_python, issues and valid."""
    code = F.coalesce(F.when(F.col("record_kind") == "code", F.col("code")).otherwise(F.col("response")), F.lit(""))
    held = records.withColumn("code_text", code).withColumn("syntax_valid", syntax_valid("code_text"))
    c = F.col("code_text")
    issues = F.array_compact(
        F.array(
            schema_issue(),
            F.when((F.col("record_kind") != "code") & (F.coalesce(strip(F.col("instruction")), F.lit("")) == ""), "empty instruction"),
            F.when(too_short(c), "response/code is too short"),
            F.when(non_python(c), "obvious non-Python syntax detected"),
            F.when(placeholder(c), "placeholder or TODO response"),
            F.when(~F.col("syntax_valid"), "Python syntax error"),
        )
    )
    return held.withColumns({"non_python": non_python(c), "issues": issues}).withColumn("valid", F.size("issues") == 0)


def reject_reason(excluded: Column, instruction: Column, response: Column, syntax: Column | None = None, executed: Column | None = None) -> Column:
    """The first gate that a record fails: excluded, secret, length, syntax, execution; null if it passes."""
    text = content_text(instruction, F.lit(""), response)
    reason = F.when(excluded, "benchmark_exclusion").when(has_secret(text), "secret_detected").when(length_issue(instruction, response).isNotNull(), length_issue(instruction, response))
    if syntax is not None:
        reason = reason.when(~syntax, "syntax_invalid")
    return reason if executed is None else reason.when(~executed, "execution_failed")


def excluded(records: DataFrame, exclusions: DataFrame, id_: str = "id", instruction: str = "instruction", response: str = "response") -> DataFrame:
    """records with `excluded`: by id, by digest of the instruction, or by digest of instruction and response. Three joins on equal keys."""
    keys = {"id": F.col(id_).cast("string"), "instruction": digest(F.lower(strip(F.col(instruction)))), "content": digest(F.concat(F.col(instruction), F.lit("\n"), F.col(response)))}
    out, flags = records, []
    for kind, key in keys.items():
        side = exclusions.where(F.col("kind") == kind).select(F.col("key").alias(f"_k_{kind}")).distinct()
        out = out.withColumn(f"_v_{kind}", key).join(side, F.col(f"_v_{kind}") == F.col(f"_k_{kind}"), "left")
        flags.append(F.col(f"_k_{kind}").isNotNull())
    out = out.withColumn("excluded", _any(flags))
    return out.drop(*[f"_{a}_{k}" for a in "kv" for k in keys])


def sft_view(records: DataFrame) -> DataFrame:
    """records with reason: empty_instruction, empty_response, syntax_invalid or null."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    return records.withColumn("reason", F.when(blank("instruction"), "empty_instruction").when(blank("response"), "empty_response").when(~F.col("syntax_valid"), "syntax_invalid"))


def sft_errors(records: DataFrame, cases: int = 3, strict: bool = False) -> DataFrame:
    """JSON records (column value) with their sorted error codes; strict adds the rules of the third dataset version."""
    keys = F.json_object_keys("value")
    get = lambda n: F.coalesce(F.get_json_object("value", f"$.{n}"), F.lit(""))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, SFT_FIELDS)), keys))
    tests = F.from_json(get("test_cases"), "array<string>")
    whole = lambda t: F.json_object_keys(t)
    bad = F.exists(tests, lambda t: whole(t).isNull() | ~F.array_contains(whole(t), "expected") | (F.lit(strict) & ~(F.array_contains(whole(t), "args") & F.array_contains(whole(t), "kwargs"))))
    text = F.concat_ws("\n", get("instruction"), get("input"), get("response"))
    checks = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_schema:" if strict else "missing:"), F.concat_ws(",", missing))),
        F.when(get("response_type") != "code", "response_type"),
        F.when(tests.isNull() | (F.size(tests) < cases), "minimum_test_cases" if strict else "test_cases").when(bad, "test_case_schema"),
    ]
    if strict:
        checks += [F.when(get("function_name") != "solve", "function_name"), F.when(~get("difficulty").isin("easy", "medium"), "difficulty"), F.when(artificial(text), "artificial_identifier")]
    else:
        checks += [F.when((strip(get("instruction")) == "") | (strip(get("response")) == ""), "empty_text")]
    held = records.withColumns({"_checks": F.array_compact(F.array(*checks)), "_code": code_errors(get("response"))})
    named = F.transform("_code", lambda e: F.when(e == "not_one_solve", "response_function_name").otherwise(e)) if strict else F.filter("_code", lambda e: e != "not_one_solve")
    return held.withColumn("errors", F.array_sort(F.array_distinct(F.concat("_checks", named)))).drop("_checks", "_code")


def duplicate_ids(records: DataFrame, id_: str = "id") -> DataFrame:
    return records.groupBy(id_).count().where("count > 1")


def require(records: DataFrame, id_: str = "id", expected: int | None = None) -> DataFrame:
    """records as they are; raises if an id repeats or the count differs: nothing is dropped."""
    if (twice := duplicate_ids(records, id_).count()) or (expected is not None and (n := records.count()) != expected):
        raise ValueError(f"{twice} repeated ids" if twice else f"{n} records, {expected} expected")
    return records


