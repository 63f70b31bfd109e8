import json

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import validate
from sparkloom.sources import records

FENCED = "```python\ndef add(a, b):\n    return a + b\n```"
ROWS = [
    {"id": "r1", "task_type": "code_generation", "category": "functions", "instruction": "Add two numbers in Python", "response": FENCED, "language": "python", "source": "fixture", "quality_score": 1.0},
    {"id": "r2", "category": "linked-list", "code": "def f():\n    return 1", "source": "fixture"},
    {"id": "r3", "category": "strings", "instruction": "Broken on purpose", "response": "def f(:\n  pass", "source": "fixture"},
    {"id": "r4", "category": "strings", "instruction": "Print from Java", "response": "public static void main(String[] a) { }", "source": "fixture"},
    {"id": "r5", "category": "strings", "instruction": "Score out of range", "response": "print('x')", "quality_score": 1.2},
    {"id": "r6", "category": "strings", "instruction": "Empty answer", "response": ""},
    {"id": "r7", "category": "nonsense", "instruction": "Unknown category", "response": "x = 1  # TODO later"},
]


def test_parse_normalise_validate(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(map(json.dumps, ROWS)) + "\n\n[1]\n")
    lines = records.read_jsonl(spark, f"file://{path}")
    assert lines.where("NOT ok").count() == 1
    held = records.load_records(spark, f"file://{path}").withColumns({"response": T.strip_fence(T.clean_text(F.col("response"))), "category": T.category(F.col("category"))})
    got = {r.id: r for r in validate.validate(held).collect()}
    assert got["r1"].valid and got["r1"].response == "def add(a, b):\n    return a + b"
    assert got["r2"].record_kind == "code" and got["r2"].category == "linked_lists" and got["r2"].valid
    assert "Python syntax error" in got["r3"].issues and got["r4"].non_python
    assert got["r5"].issues[0] == "quality_score" and "response/code is too short" in got["r6"].issues and "placeholder or TODO response" in got["r7"].issues


def test_text_forms(spark):
    row = spark.createDataFrame([("\x00 A\r\nB  ", "Solve 12 odd", "a\x0bb\r\nc ")], "a string, b string, c string").select(
        T.clean_text(F.col("a")).alias("clean"), T.dedup_form(F.col("a")).alias("norm"), T.template_form(F.col("b")).alias("template"), T.family_id(F.col("b")).alias("family"), T.line_count(F.col("c")).alias("lines"),
        T.family_id(F.col("b"), F.lit(" My Fam!")).alias("slug"), T.shingles(F.lit("a b")).alias("short"), T.shingles(F.lit("a b c a b c")).alias("long"), T.shingles(F.lit(" ")).alias("none"),
    ).first()
    assert row.clean == "A\nB" and row.template == "solve <NUM> odd" and row.family == "odd_even" and row.lines == len("a\x0bb\r\nc ".splitlines())
    assert row.slug == "my_fam" and row.short == ["a b"] and row.long == ["a b c", "b c a", "c a b"] and row.none == []


def test_gates(spark):
    rows = [("api_key = abcdefghijklmnop1234", "x" * 20), ("plain words here", "y" * 20), ("short", "y" * 20), ("long answer here", "z" * 13_000), ("many lines here", "a\n" * 400)]
    got = [r.why for r in spark.createDataFrame(rows, "i string, r string").select(validate.reject_reason(F.lit(False), F.col("i"), F.col("r")).alias("why")).collect()]
    assert got == ["secret_detected", None, "too_short", "too_long", "too_long"]


def test_sft_errors(spark):
    good = {k: "" for k in validate.SFT_FIELDS} | {"instruction": "Do it", "response": "def solve(x):\n    return x", "response_type": "code", "function_name": "solve", "difficulty": "easy", "test_cases": [{"args": [1], "kwargs": {}, "expected": 1}] * 5}
    bad = {k: v for k, v in good.items() if k != "skill_id"} | {"response": "import os\neval('1')", "test_cases": []}
    odd = good | {"instruction": "Scenario 12", "test_cases": [{"args": [1]}] * 5}
    df = spark.createDataFrame([(json.dumps(x),) for x in (good, bad, odd)], "value string")
    got = [r.errors for r in validate.sft_errors(df, 5, strict=True).collect()]
    assert got[0] == [] and got[1] == ["dynamic_execution", "minimum_test_cases", "missing_schema:skill_id", "response_function_name", "unsafe_import"] and got[2] == ["artificial_identifier", "test_case_schema"]
    assert validate.sft_errors(df).collect()[0].errors == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"examples": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "x.json").write_text(json.dumps({"ids": ["a"], "hashes": ["h"], "instruction_hashes": []}))
    assert records.read_examples(spark, f"file://{tmp_path}/m.json").count() == 2
    assert sorted(map(tuple, records.read_exclusions(spark, f"file://{tmp_path}/x.json").collect())) == [("content", "h"), ("id", "a")]
    records.write_jsonl(spark.createDataFrame([(2, "b")], "z int, a string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()[0] == '{"a":"b","z":2}'
    raw = spark.createDataFrame([("1", "python", "MIT", "adds numbers..", "x = 1"), ("2", "java", "MIT", "q", "c"), ("3", "python", "", "q", "c")], "id string, language string, license string, docstring string, code string")
    assert [r.instruction for r in records.from_code_search(raw).collect()] == ["Write a Python function that adds numbers."]
