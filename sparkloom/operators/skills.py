"""Skill catalogues for supervised records: skills and compositions of two, prompts in mixed-radix order, and disjoint splits with a frozen one."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Our skills: name, category, what the code does with `items`, an expression, and sample inputs.
SKILLS: dict[str, tuple[str, str, str]] = {
    "keep_even": ("lists", "keep the even numbers", "[n for n in items if n % 2 == 0]"),
    "keep_odd": ("lists", "keep the odd numbers", "[n for n in items if n % 2]"),
    "double": ("lists", "double every number", "[n * 2 for n in items]"),
    "square": ("math", "square every number", "[n * n for n in items]"),
    "negate": ("math", "negate every number", "[-n for n in items]"),
    "ascending": ("sorting", "sort the numbers upwards", "sorted(items)"),
    "descending": ("sorting", "sort the numbers downwards", "sorted(items, reverse=True)"),
    "backwards": ("lists", "reverse the order", "items[::-1]"),
    "distinct": ("sets", "drop repeated numbers", "list(dict.fromkeys(items))"),
    "positive": ("conditions", "keep numbers above zero", "[n for n in items if n > 0]"),
    "gaps": ("algorithms", "give the differences of neighbours", "[b - a for a, b in zip(items, items[1:])]"),
    "running_sum": ("algorithms", "give the running sums", "[sum(items[:k + 1]) for k in range(len(items))]"),
    "running_max": ("algorithms", "give the running maxima", "[max(items[:k + 1]) for k in range(len(items))]"),
    "every_second": ("lists", "keep every second number", "items[::2]"),
    "rotate": ("arrays", "move the first number to the end", "items[1:] + items[:1]"),
    "clip": ("conditions", "limit numbers to the range from -5 to 5", "[max(-5, min(5, n)) for n in items]"),
}
INPUTS = ([3, -1, 4, 1, -5], [], [7], [2, 2, 8, 0], [-3, -3, 9, 10, 6, 1], [12, 5, 5, -7])
STARTS = ("Write a Python function named solve that should", "Implement solve so that it can", "Create a Python function solve to", "Complete solve, which has to")
GIVENS = ("for a list called items:", "given a list of integers items:", "working on the list items:")
ENDS = ("return a new list.", "don't change the input.", "the list may be empty.")


def catalogue() -> list[tuple[str, str, str, list[str]]]:
    """(skill, category, wording, expressions in order): single skills, and every skill followed by each of the next three."""
    names = list(SKILLS)
    out = [(n, SKILLS[n][0], SKILLS[n][1], [SKILLS[n][2]]) for n in names]
    for k, n in enumerate(names):
        for step in (1, 2, 3):
            m = names[(k + step) % len(names)]
            out.append((f"{n}_then_{m}", SKILLS[m][0], f"{SKILLS[n][1]} and then {SKILLS[m][1]}", [SKILLS[n][2], SKILLS[m][2]]))
    return out


def _record(expressions: list[str]) -> tuple[str, str]:
    body = "".join(f"    items = {e}\n" for e in expressions[:-1]) + f"    return {expressions[-1]}"
    code = f"def solve(items):\n{body}"
    space: dict = {}
    exec(compile(code, "<skill>", "exec"), space)
    return code, json.dumps([{"args": [x], "kwargs": {}, "expected": space["solve"](list(x))} for x in INPUTS])


@F.arrow_udf(T.StructType([T.StructField("response", T.StringType()), T.StructField("test_cases", T.StringType())]))
def _rendered(expressions: pa.Array) -> pa.Array:
    rows = [_record(e) for e in expressions.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["response", "test_cases"])


def records(spark: SparkSession, count: int, first: int = 0) -> DataFrame:
    """Supervised records by number: each number is one combination of skill, start, given and end, none twice before all were used."""
    skills = F.array(*[F.struct(F.lit(s).alias("skill_id"), F.lit(c).alias("category"), F.lit(w).alias("wording"), F.array(*map(F.lit, e)).alias("code")) for s, c, w, e in catalogue()])
    sizes, digits, radix = (len(catalogue()), len(STARTS), len(GIVENS), len(ENDS)), [], 1
    for n in sizes:
        digits.append((F.floor(F.col("id") / radix) % n).cast("int"))
        radix *= n
    pick = [F.get(F.array(*map(F.lit, x)), d) for x, d in zip((STARTS, GIVENS, ENDS), digits[1:])]
    rows = spark.range(first, first + count).withColumn("s", F.get(skills, digits[0])).withColumn("r", _rendered("s.code"))
    return rows.select(
        F.format_string("sk_%08d", "id").alias("id"), F.concat_ws(" ", pick[0], "s.wording", pick[1], pick[2]).alias("instruction"), F.lit("").alias("input"), "r.response", F.lit("code").alias("response_type"),
        "s.category", "s.skill_id", F.format_string("t%d_%d_%d", *digits[1:]).alias("prompt_template_id"), F.when(F.size("s.code") > 1, "medium").otherwise("easy").alias("difficulty"),
        F.when(F.size("s.code") > 1, "composition").otherwise("single").alias("task_style"), F.lit("solve").alias("function_name"), "r.test_cases", F.lit("generated").alias("provenance"),
    )


def splits(spark: SparkSession, train: int, validation: int, challenge: int) -> DataFrame:
    """records with split: disjoint ranges of numbers, so no prompt stands in two splits."""
    limit = len(catalogue()) * len(STARTS) * len(GIVENS) * len(ENDS)
    if train + validation + challenge > limit:
        raise ValueError(f"only {limit} different prompts")
    out, at = None, 0
    for name, n in (("train", train), ("validation", validation), ("challenge", challenge)):
        part = records(spark, n, at).withColumn("split", F.lit(name))
        out, at = part if out is None else out.unionByName(part), at + n
    return out


def identity(spec: dict, probes: tuple[str, ...] = ("def f(x):\n    return x", "naïve café", "  spaces\t", "1234")) -> dict[str, str]:
    """What a tokenizer is and does: a digest of its canonical JSON and one of the ids it gives for fixed probes."""
    import hashlib

    from tokenizers import Tokenizer

    text = json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    held = Tokenizer.from_str(json.dumps(spec))
    ids = json.dumps([held.encode(p, add_special_tokens=False).ids for p in probes])
    return {"spec": hashlib.sha256(text.encode()).hexdigest(), "behaviour": hashlib.sha256(ids.encode()).hexdigest()}


def lookup(records: DataFrame, catalogue: DataFrame, skill: str = "skill_id") -> DataFrame:
    """records with the columns of their skill; those of an unknown skill keep nulls. The catalogue has a row a skill, whatever the data's size."""
    return records.join(F.broadcast(catalogue.dropDuplicates([skill])), skill, "left")
