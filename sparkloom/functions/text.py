"""Column functions over text: cleaning, normal forms, keys, shingles and document formats. All but canonical_json run inside the JVM."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed set: the characters that Python's str.strip() and \s treat as white space.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same set as characters, and as a class in which one range test settles letters below U+1680.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_QUICK = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"


def strip(c: Column) -> Column:
    """Outer white space removed, any Unicode kind."""
    return F.btrim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Without NULs, with LF line ends, stripped."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), "\r\n?", "\n"))


def strip_fence(c: Column) -> Column:
    """The inside of a Markdown fence that spans the whole value (plain, python or py); other values as they are."""
    pattern = rf"(?i)^[{SPACE}]*```(?:python|py)?[{SPACE}]*\n([\s\S]*?)\n?```[{SPACE}]*$"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).otherwise(c)


def dedup_form(c: Column) -> Column:
    """Lower case, runs of white space as one space, stripped."""
    return strip(F.regexp_replace(F.lower(c), f"{_QUICK}+", " "))


def template_form(c: Column) -> Column:
    """The dedup form with numbers masked."""
    return F.regexp_replace(dedup_form(c), r"\d+", "<NUM>")


def masked_template(c: Column) -> Column:
    """The template form with generated function names masked too."""
    return F.regexp_replace(template_form(c), r"solve_[a-z0-9_]+_(?:train|validation|challenge)_\d+", "<FUNCTION>")


def digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def words(c: Column) -> Column:
    """The dedup form's words; none for a blank text."""
    return F.array_remove(F.split(dedup_form(c), " "), "")


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-word shingles; a text of at most k words is one shingle, a blank text none."""

    def of(w: Column) -> Column:
        whole = F.array(F.concat_ws(" ", w))
        joined = lambda i: F.concat(w[i], *[x for j in range(1, k) for x in (F.lit(" "), w[i + j])])
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), joined)
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= k, whole).otherwise(F.array_distinct(many))

    # bound by a transform over one element: inside a lambda an expression would be worked out again for each item
    return F.get(F.transform(F.array(words(c)), of), F.lit(0))


#: Record kinds and labels.
TASK_TYPES = ("code_generation", "code_completion", "bug_fixing", "code_explanation", "code_optimization", "algorithm_implementation", "data_structure", "library_usage", "code")
CATEGORIES = (
    "beginner", "conditions", "loops", "functions", "recursion", "strings", "lists", "tuples", "sets", "dictionaries", "oop", "files",
    "exceptions", "modules", "algorithms", "sorting", "searching", "arrays", "linked_lists", "stacks", "queues", "trees", "graphs",
    "dynamic_programming", "greedy", "backtracking", "math", "numpy", "pandas", "matplotlib", "regex", "debugging", "optimization",
    "code_completion", "intermediate_python", "misc",
)
CATEGORY_ALIASES = {
    "linked-list": "linked_lists", "linked list": "linked_lists", "linkedlist": "linked_lists", "linked lists": "linked_lists",
    "dict": "dictionaries", "dictionary": "dictionaries", "oop_python": "oop", "object_oriented": "oop",
    "code completion": "code_completion", "dynamic programming": "dynamic_programming", "data structures": "data_structure",
}


def category(c: Column) -> Column:
    """The canonical category, or null for an unknown one."""
    key = F.replace(F.lower(strip(c)), F.lit("/"), F.lit("_"))
    alias = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    named = F.coalesce(F.try_element_at(alias, key), F.replace(key, F.lit(" "), F.lit("_")))
    return F.when(named.isin(list(CATEGORIES)), named)


def task_type(c: Column) -> Column:
    """The canonical task type, or null for an unknown one."""
    key = F.translate(F.lower(strip(c)), "- ", "__")
    return F.when(key.isin(list(TASK_TYPES)), key)


#: Keyword rules of families, in order; all words of a rule must occur.
FAMILY_RULES = (
    ("prime_check", ("prime",)), ("palindrome", ("palindrome",)), ("reverse_string", ("reverse", "string")), ("fibonacci", ("fibonacci",)),
    ("factorial", ("factorial",)), ("sorting", ("sort",)), ("binary_search", ("binary", "search")),
)


def family_id(instruction: Column, explicit: Column | None = None) -> Column:
    """An explicit family's slug, else the first keyword rule that fits, else a digest of the instruction's words."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.lower(instruction), "[^a-z0-9 ]+", " "), r"\s+", " "))
    rule = F.when(plain.rlike(r"\b(?:odd|even)\b"), "odd_even")
    for name, terms in FAMILY_RULES:
        fits = F.lit(True)
        for t in terms:
            fits = fits & plain.contains(t)
        rule = rule.when(fits, name)
    derived = rule.otherwise(F.concat(F.lit("family_"), F.substring(digest(plain), 1, 16)))
    if explicit is None:
        return derived
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(explicit)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(strip(explicit), F.lit("")) != "", slug).otherwise(derived)


def stable_id(task: Column, instruction: Column, input_: Column, response: Column) -> Column:
    return F.concat(F.lit("py_"), F.substring(digest(F.concat_ws("\n", task, instruction, input_, response)), 1, 20))


def content_text(instruction: Column, input_: Column, response: Column, code: Column | None = None) -> Column:
    whole = F.concat(instruction, F.lit("\n"), input_, F.lit("\n"), response)
    return whole if code is None else F.coalesce(code, whole)


def training_document(instruction: Column, input_: Column, response: Column, specials: bool = False) -> Column:
    """The text that a record trains on; with specials, as the tokenizer's corpus has it."""
    given = F.when(input_ != "", F.concat(F.lit("\n\n"), input_)).otherwise(F.lit(""))
    body = F.concat(F.lit("### User\n"), instruction, given, F.lit("\n\n### Assistant\n"), response)
    return F.concat(F.lit("<BOS>\n"), body, F.lit("\n<EOS>")) if specials else body


MARKER = "\n\n### Assistant\n"


def sft_parts(document: Column) -> Column:
    """prefix (with the first answer marker) and answer."""
    at = F.locate(MARKER, document)
    return F.struct(F.substring(document, F.lit(1), at + (len(MARKER) - 1)).alias("prefix"), F.substr(document, at + len(MARKER)).alias("answer"))


def evaluation_prompt(instruction: Column, input_: Column) -> Column:
    given = F.when(input_ != "", F.concat(F.lit("\n"), input_)).otherwise(F.lit(""))
    return F.concat(F.lit("### User\n"), instruction, given, F.lit(MARKER))


#: Fixed patterns: what a line of code begins with, and a fenced block.
CODE_START = r"(?ms)^(?:from\s+\w+|import\s+\w+|def\s+\w+|class\s+\w+|if\s+__name__\s*==|if\s+|for\s+|while\s+|print\s*\(|[A-Za-z_]\w*\s*=).*"

FENCE = r"(?is)```(?:python|py)?\s*\n?(.*?)```"


def extract_code(c: Column) -> Column:
    """The longest fenced block, the first of equals; else the text from the first line that looks like code; else null."""
    blocks = F.regexp_extract_all(c, F.lit(FENCE), F.lit(1))
    longest = F.aggregate(blocks, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
    rest = F.regexp_extract(c, CODE_START, 0)
    return F.when(F.size(blocks) > 0, strip(longest)).when(rest != "", strip(rest))


def difficulty(index: Column) -> Column:
    slot = F.pmod(index, F.lit(20))
    return F.when(slot < 9, "easy").when(slot < 17, "medium").otherwise("hard")


def quality_bucket(score: Column) -> Column:
    return F.when(score >= 1.0, "1.0").when(score >= 0.8, "0.8").otherwise("0.5_or_lower")


def size_class(n: Column) -> Column:
    """Fixed labels at 25,000, 50,000, 90,000 and 110,000 records."""
    label = F.when(n < 25_000, "prototype_only").when(n < 50_000, "small_training_set").when(n < 90_000, "usable_training_set")
    return label.when(n <= 110_000, "production_candidate_target_met").otherwise("above_target")


def lengths(c: Column) -> Column:
    """Code points, UTF-8 bytes and lines."""
    lines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    return F.struct(F.length(c).cast("bigint").alias("chars"), F.octet_length(c).cast("bigint").alias("bytes"), lines.cast("bigint").alias("lines"))


def line_count(c: Column) -> Column:
    """Lines as Python's splitlines counts them: every kind of line end, none for a trailing one."""
    ends = "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
    n = F.size(F.regexp_extract_all(c, F.lit(ends), F.lit(0)))
    return F.when(F.length(c) == 0, 0).otherwise(n + F.when(c.rlike(f"(?:{ends})\\z"), 0).otherwise(1))


def function_name(skill: Column, split: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("solve"), F.regexp_replace(skill, "[^a-z0-9]+", "_"), split, index.cast("string"))


def row_text(instruction: Column, input_: Column, response: Column) -> Column:
    """A record as a benchmark measures it: its fields by lines, without an empty input. Nulls count as empty."""
    i, g, r = (F.coalesce(c, F.lit("")) for c in (instruction, input_, response))
    return F.concat(i, F.when(g != "", F.concat(F.lit("\n"), g)).otherwise(F.lit("")), F.lit("\n"), r)


def record_keys(instruction: Column, input_: Column, response: Column) -> dict[str, Column]:
    """Normal forms by which audits compare records: prompt, prompt with input, response, and prompt with response. Nulls count as empty."""
    i, g, r = (F.coalesce(c, F.lit("")) for c in (instruction, input_, response))
    line = F.lit("\n")
    return {"prompt": dedup_form(i), "prompt_input": dedup_form(F.concat(i, line, g)), "response": dedup_form(r), "pair": dedup_form(F.concat(i, line, r))}


@F.arrow_udf(T.StringType())
def canonical_json(value: pa.Array) -> pa.Array:
    """JSON texts with sorted keys and no white space, numbers in Python's form; null where the text is no JSON."""
    out = []
    for v in value.to_pylist():
        try:
            out.append(None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def review(id_: Column, fields: dict[str, Column], instruction: Column, response: Column) -> Column:
    """A record as a section of a Markdown review. Nulls are shown as empty."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [x for n, c in fields.items() for x in (F.lit(f"- {n}: `"), shown(c), F.lit("`\n"))]
    return F.concat(F.lit("## "), shown(id_), F.lit("\n\n"), *lines, F.lit("\n**Instruction:** "), shown(instruction), F.lit("\n\n```python\n"), shown(response), F.lit("\n```\n"))
