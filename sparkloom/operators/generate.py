"""Generated programming tasks: a grid of categories, families and variants, made from spark.range, and code rendered from templates."""

from __future__ import annotations

import copy
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import difficulty, digest

#: Families of each category in the full corpus, and each category's blueprints in turn.
FAMILIES = {
    "beginner": 560, "conditions": 320, "functions": 360, "strings": 400, "oop": 280, "arrays": 120, "linked_lists": 100, "stacks": 80, "queues": 80,
    "trees": 70, "graphs": 70, "algorithms": 480, "debugging": 320, "code_completion": 200, "files": 160, "numpy": 120, "pandas": 120,
    "intermediate_python": 120, "misc": 40,
}
BLUEPRINTS = {
    "beginner": ("parity", "sign", "digit_sum", "reverse"),
    "conditions": ("parity", "sign", "prime"),
    "functions": ("factorial", "fibonacci", "safe_int", "generator"),
    "strings": ("reverse", "vowels", "unique", "anagram"),
    "oop": ("accumulator", "counter", "dataclass_like"),
    "arrays": ("unique", "chunk", "sort"),
    "linked_lists": ("linked_values", "reverse"),
    "stacks": ("stack",),
    "queues": ("queue",),
    "trees": ("tree_sum", "binary_search"),
    "graphs": ("graph_degree", "bfs_order"),
    "algorithms": ("sort", "binary_search", "window", "prefix_sum", "merge"),
    "debugging": ("bug_fix", "bug_boundary", "bug_accumulator"),
    "code_completion": ("completion", "completion_loop"),
    "files": ("file_lines", "safe_int", "csv_rows"),
    "numpy": ("numpy_mean", "numpy_shape", "numpy_filter"),
    "pandas": ("pandas_filter", "pandas_group", "pandas_missing"),
    "intermediate_python": ("generator", "merge", "decorator_like", "context_like"),
    "misc": ("chunk", "safe_int", "merge"),
}
FORMS = ("Write a Python function that {description}.", "Implement Python code to {description}.", "Create a reusable Python solution that {description}.", "Given the input values, use Python to {description}.")
FULL, PER_FAMILY = 100_000, 25


def allocation(target: int) -> dict[str, int]:
    """Rows of each category: 25 a family for the full corpus, else in proportion, what rounding leaves going to the first categories."""
    if target == FULL:
        return {c: n * PER_FAMILY for c, n in FAMILIES.items()}
    whole = sum(FAMILIES.values())
    rows = {c: target * n // whole for c, n in FAMILIES.items()}
    for c in list(rows)[: target - sum(rows.values())]:
        rows[c] += 1
    return rows


def in_grid(rows: DataFrame, ordinal: str, target: int = FULL, per_family: int = PER_FAMILY) -> DataFrame:
    """rows with category, blueprint, family_index, variant, family_id, difficulty, template_id and variant_id of the task that has their ordinal."""
    if target <= 0 or per_family <= 0:
        raise ValueError("target and per_family must be positive")
    at, upto = [], 0
    for c, n in allocation(target).items():
        at.append((c, upto, upto + n))
        upto += n
    place, name, first = F.col(ordinal), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for c, a, b in reversed(at):
        name, first = F.when((place >= a) & (place < b), c).otherwise(name), F.when((place >= a) & (place < b), a).otherwise(first)
    prints = F.create_map(*[x for c, v in BLUEPRINTS.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])
    rows = rows.withColumns({"category": name, "_k": place - first})
    rows = rows.withColumns({"family_index": F.floor(F.col("_k") / per_family), "variant": F.col("_k") % per_family}).drop("_k")
    turn = F.element_at(prints, F.col("category"))
    rows = rows.withColumn("blueprint", F.get(turn, (F.col("family_index") % F.size(turn)).cast("int")))
    return rows.withColumns(
        {
            "family_id": F.format_string("%s/%s/%04d", "category", "blueprint", "family_index"),
            "difficulty": difficulty(F.col("family_index") + F.col("variant")),
            "template_id": F.concat_ws("_", "category", "blueprint", F.lit("v1")),
            "variant_id": F.format_string("variant_%02d", "variant"),
        }
    )


def grid(spark: SparkSession, target: int = FULL, per_family: int = PER_FAMILY) -> DataFrame:
    """ordinal, category, blueprint, family_index, variant, family_id, difficulty, template_id for every task."""
    rows = spark.range(min(target, sum(allocation(target).values()))).withColumnRenamed("id", "ordinal")
    return in_grid(rows, "ordinal", target, per_family)


#: Our own tasks under the fixed names of the blueprints: what the code does, the code, and arguments of its tests. P is a family's parameter, D its divisor.
TEMPLATES: dict[str, tuple[str, str, list]] = {
    "parity": ("count the even and the odd ones of a list's numbers once P is added to each", "def solve(numbers):\n    odd = sum((n + P) & 1 for n in numbers)\n    return [len(numbers) - odd, odd]", [[[1, 2, "P"]], [[]]]),
    "sign": ("tell in which direction each reading moved away from P", "def solve(readings):\n    moves = []\n    for now in readings:\n        moves.append((now > P) - (now < P))\n    return moves", [[["P", "P1", 0]], [[]]]),
    "digit_sum": ("list the numbers up to a limit whose digits add up to P", "def solve(limit):\n    return [n for n in range(limit + 1) if sum(map(int, str(n))) == P]", [[60], [0]]),
    "reverse": ("turn round every run of P items and leave the runs in place", "def solve(items):\n    out = []\n    for at in range(0, len(items), P):\n        run = items[at:at + P]\n        run.reverse()\n        out.extend(run)\n    return out", [[[1, 2, 3, 4, 5]], [[]]]),
    "prime": ("collect the first P primes from a starting number on", "def solve(start):\n    found, n = [], max(start, 2)\n    while len(found) < P:\n        if all(n % k for k in range(2, n) if k * k <= n):\n            found.append(n)\n        n += 1\n    return found", [[1], [90]]),
    "factorial": ("write a number in the factorial base, with P places at most", "def solve(number):\n    places, base = [], 2\n    while number and len(places) < P:\n        number, place = divmod(number, base)\n        places.append(place)\n        base += 1\n    return places[::-1]", [[463], [0]]),
    "fibonacci": ("count the steps until a sum of its two forerunners, from 1 and P, passes a mark", "def solve(mark):\n    older, newer, steps = 1, P, 0\n    while newer <= mark:\n        older, newer, steps = newer, older + newer, steps + 1\n    return steps", [[100], [0]]),
    "safe_int": ("read the leading digits of each field, P where a field has none", "def solve(fields):\n    out = []\n    for field in fields:\n        end = 0\n        while field[end:end + 1].isdecimal():\n            end += 1\n        out.append(int(field[:end]) if end else P)\n    return out", [[["12px", "none", "7"]], [[]]]),
    "generator": ("list multiples of P below a limit", "def solve(limit):\n    def multiples():\n        value = P\n        while value < limit:\n            yield value\n            value += P\n    return list(multiples())", [[30], [1]]),
    "vowels": ("hide the vowels of a text except in its first P letters", "def solve(text):\n    return text[:P] + ''.join('*' if c in 'aeiouAEIOU' else c for c in text[P:])", [["Orange juice, please"], [""]]),
    "unique": ("name the items that stand exactly once among the first P", "def solve(items):\n    held = items[:P]\n    return [x for x in held if held.count(x) == 1]", [[[3, 1, 3, 4]], [[]]]),
    "anagram": ("group words of the same letters and keep groups of P words at most", "def solve(words):\n    groups = {}\n    for word in words:\n        groups.setdefault(''.join(sorted(word)), []).append(word)\n    return [g for g in groups.values() if len(g) <= P]", [[["tea", "eat", "ate", "tan"]], [[]]]),
    "accumulator": ("keep a running product modulo P and list it after each factor", "class Wheel:\n    def __init__(self, teeth):\n        self.teeth, self.at = teeth, 1\n\n    def turn(self, by):\n        self.at = self.at * by % self.teeth\n        return self.at\n\n\ndef solve(factors):\n    wheel = Wheel(P)\n    return [wheel.turn(f) for f in factors]", [[[3, 5, 7]], [[]]]),
    "counter": ("count items that occur P times at most", "def solve(items):\n    counts = {}\n    for item in items:\n        counts[item] = counts.get(item, 0) + 1\n    return {k: v for k, v in counts.items() if v <= P}", [[["a", "b", "a"]], [[]]]),
    "dataclass_like": ("describe a point shifted by P", "class Point:\n    def __init__(self, x, y):\n        self.x, self.y = x, y\n\n    def shifted(self, by):\n        return Point(self.x + by, self.y + by)\n\n\ndef solve(x, y):\n    p = Point(x, y).shifted(P)\n    return [p.x, p.y]", [[1, 2]]),
    "chunk": ("deal items in turn to P hands", "def solve(items):\n    return [items[hand::P] for hand in range(P)]", [[[1, 2, 3, 4, 5]], [[]]]),
    "sort": ("sort integers by their distance from P", "def solve(items):\n    return sorted(items, key=lambda n: (abs(n - P), n))", [[[9, 1, 4]], [[]]]),
    "linked_values": ("link values and read every P-th", "def solve(values):\n    head = None\n    for v in reversed(values):\n        head = (v, head)\n    out, k = [], 0\n    while head:\n        if k % P == 0:\n            out.append(head[0])\n        head, k = head[1], k + 1\n    return out", [[[1, 2, 3, 4, 5]], [[]]]),
    "stack": ("push values on a stack of P places and pop one", "def solve(values):\n    stack = []\n    for v in values:\n        if len(stack) < P:\n            stack.append(v)\n    return stack.pop() if stack else None", [[[1, 2, 3]], [[]]]),
    "queue": ("serve the first P of a queue", "def solve(values):\n    served, rest = values[:P], values[P:]\n    return [served, len(rest)]", [[[1, 2, 3]], [[]]]),
    "tree_sum": ("sum a nested tree and add P", "def solve(tree):\n    def total(node):\n        return node if isinstance(node, int) else sum(map(total, node))\n    return total(tree) + P", [[[1, [2, [3]]]], [[]]]),
    "binary_search": ("count the numbers below P in a sorted list by halving", "def solve(ordered):\n    low, high = 0, len(ordered)\n    while low != high:\n        half = low + (high - low) // 2\n        low, high = (half + 1, high) if ordered[half] < P else (low, half)\n    return low", [[[1, "P", 90]], [[]]]),
    "graph_degree": ("list edges whose ends have P neighbours or fewer between them", "def solve(edges):\n    near = {}\n    for a, b in edges:\n        near.setdefault(a, set()).add(b)\n        near.setdefault(b, set()).add(a)\n    return [[a, b] for a, b in edges if len(near[a] | near[b]) <= P]", [[[["a", "b"], ["b", "c"], ["c", "d"], ["b", "e"]]], [[]]]),
    "bfs_order": ("visit at most P nodes breadth first", "def solve(graph, start):\n    seen, queue = [start], [start]\n    while queue:\n        for node in graph.get(queue.pop(0), []):\n            if node not in seen:\n                seen.append(node)\n                queue.append(node)\n    return seen[:P]", [[{"a": ["b", "c"], "b": ["d"]}, "a"]]),
    "window": ("find the narrowest spread of P neighbours", "def solve(items):\n    spreads = []\n    for end in range(P, len(items) + 1):\n        part = items[end - P:end]\n        spreads.append(max(part) - min(part))\n    return min(spreads, default=None)", [[[1, 2, 8, 9, 30] * 8], [[]]]),
    "prefix_sum": ("find the place where a running total first reaches P", "def solve(items):\n    total = 0\n    for place, n in enumerate(items):\n        total += n\n        if total >= P:\n            return place\n    return None", [[[1, 2, 3, 40]], [[]]]),
    "merge": ("merge two sorted lists and drop values below P", "def solve(a, b):\n    out, i, j = [], 0, 0\n    while i < len(a) or j < len(b):\n        if j == len(b) or (i < len(a) and a[i] <= b[j]):\n            out.append(a[i])\n            i += 1\n        else:\n            out.append(b[j])\n            j += 1\n    return [n for n in out if n >= P]", [[[1, 30], [2, 40]], [[], []]]),
    "bug_fix": ("repair a mean that failed on empty input and used P as default", "def solve(items):\n    return sum(items) / len(items) if items else P", [[[1, 3]], [[]]]),
    "bug_boundary": ("repair a range that left out its end P", "def solve(start):\n    return list(range(start, P + 1))", [[1], [99]]),
    "bug_accumulator": ("repair a sum that forgot its start P", "def solve(items):\n    total = P\n    for n in items:\n        total += n\n    return total", [[[1, 2]], [[]]]),
    "completion": ("complete a function that scales by P", "def solve(value):\n    return value * P", [[3], [0]]),
    "completion_loop": ("complete a loop that repeats text P times", "def solve(text):\n    parts = []\n    for _ in range(P):\n        parts.append(text)\n    return '-'.join(parts)", [["a"]]),
    "file_lines": ("return the lines of a text that are longer than P", "def solve(text):\n    return [line for line in text.splitlines() if len(line) > P]", [["a\nlong enough a line, surely\n"]]),
    "csv_rows": ("parse comma-separated rows and keep P fields", "def solve(text):\n    return [row.split(',')[:P] for row in text.splitlines() if row]", [["a,b,c\n1,2,3\n"]]),
    "numpy_mean": ("return an array's mean plus P", "import numpy as np\n\n\ndef solve(items):\n    return float(np.mean(items)) + P", [[[1.0, 3.0]]]),
    "numpy_shape": ("give the shape of rows of P zeros", "import numpy as np\n\n\ndef solve(rows):\n    return list(np.zeros((rows, P)).shape)", [[3]]),
    "numpy_filter": ("keep array values above P", "import numpy as np\n\n\ndef solve(items):\n    a = np.array(items)\n    return a[a > P].tolist()", [[[1, 50]]]),
    "pandas_filter": ("keep frame values above P", "import pandas as pd\n\n\ndef solve(items):\n    f = pd.DataFrame({'v': items})\n    return f[f.v > P].v.tolist()", [[[1, 50]]]),
    "pandas_group": ("sum a frame's groups and add P", "import pandas as pd\n\n\ndef solve(keys, values):\n    s = pd.DataFrame({'k': keys, 'v': values}).groupby('k').v.sum() + P\n    return {k: int(v) for k, v in s.items()}", [[["a", "b", "a"], [1, 2, 3]]]),
    "pandas_missing": ("fill missing values with P", "import pandas as pd\n\n\ndef solve(items):\n    return pd.Series(items, dtype='float').fillna(P).tolist()", [[[1.0, None]]]),
    "decorator_like": ("wrap a function that adds P", "def adding(f):\n    def wrapped(value):\n        return f(value) + P\n    return wrapped\n\n\n@adding\ndef double(value):\n    return value * 2\n\n\ndef solve(value):\n    return double(value)", [[4]]),
    "context_like": ("log entering and leaving around P", "from contextlib import contextmanager\n\n\ndef solve(name):\n    log = []\n\n    @contextmanager\n    def section():\n        log.append('in ' + name)\n        yield P\n        log.append('out')\n\n    with section() as value:\n        log.append(value)\n    return log", [["a"]]),
}


def _fill(value, p: int, d: int):
    if isinstance(value, list):
        return [_fill(v, p, d) for v in value]
    return {"P": p, "P1": p + 1, "D": d, "D1": d + 1}.get(value, value) if isinstance(value, str) else value


def render(blueprint: str, family_index: int, variant: int) -> tuple[str, str, list[dict]]:
    """Description, code and test cases of one task. Expected values come from the template's own code, which is trusted."""
    said, code, calls = TEMPLATES[blueprint]
    p, d = 2 + family_index % 19, 2 + family_index + variant
    put = lambda s: "".join(str(p) if w == "P" else str(d) if w == "D" else w for w in _split(s))
    code, space = put(code), {}
    exec(compile(code, "<template>", "exec"), space)
    cases = []
    for args in calls:
        args = _fill(args, p, d)
        cases.append({"args": args, "kwargs": {}, "expected": space["solve"](*copy.deepcopy(args))})
    return put(said), code, cases


def _split(s: str) -> list[str]:
    """The string cut so that the parameters P and D stand alone."""
    out, at = [], 0
    for k, c in enumerate(s):
        alone = c in "PD" and not (k and (s[k - 1].isalnum() or s[k - 1] in "_'")) and not (k + 1 < len(s) and (s[k + 1].isalnum() or s[k + 1] == "_"))
        if alone:
            out += [s[at:k], c]
            at = k + 1
    return [*out, s[at:]]


@F.arrow_udf(T.StructType([*[T.StructField(n, T.StringType()) for n in ("description", "code", "test_cases")], T.StructField("test_count", T.IntegerType())]))
def rendered(blueprint: pa.Array, family_index: pa.Array, variant: pa.Array) -> pa.Array:
    rows = [render(b, f, v) for b, f, v in zip(blueprint.to_pylist(), family_index.to_pylist(), variant.to_pylist())]
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([json.dumps(r[2], ensure_ascii=False) for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int32())]
    return pa.StructArray.from_arrays(columns, names=["description", "code", "test_cases", "test_count"])


def instruction(description: Column, category: Column, family_index: Column, variant: Column) -> Column:
    """One of four forms by variant, with a note that names the parameter set."""
    noted = F.concat(description, F.lit(" for the "), category, F.lit(" parameter set "), (family_index + 2).cast("string"))
    form = F.get(F.array(*map(F.lit, FORMS)), (variant % len(FORMS)).cast("int"))
    return F.replace(form, F.lit("{description}"), noted)


def tasks_of(grid: DataFrame, ordinal: str = "ordinal", *more: str) -> DataFrame:
    """A grid's rows with rendered code: a record's columns, function_name, test_cases, its metadata (nothing is executed here) and more columns of its own."""
    rows = grid.withColumn("r", rendered("blueprint", "family_index", "variant"))
    return rows.select(
        *more,
        F.concat(F.lit("py_cgen_"), F.substring(digest(F.concat_ws("\n", "family_id", "variant", "r.code")), 1, 20)).alias("id"), F.col(ordinal).alias("ordinal"), "category", "family_id", "difficulty", "template_id", "variant_id",
        instruction(F.col("r.description"), F.col("category"), F.col("family_index"), F.col("variant")).alias("instruction"), F.lit("").alias("input"),
        F.col("r.code").alias("response"), F.lit("solve").alias("function_name"), "r.test_cases", "r.test_count",
        F.lit("code_generation").alias("task_type"), F.lit("programmatic").alias("source"), F.lit(1.0).alias("quality_score"), F.lit("generated").alias("license"), F.lit("function").alias("interface"),
        F.lit(False).alias("execution_tested"), F.lit(False).alias("execution_passed"),
    )


def executed(tasks: DataFrame, outcome: str = "outcome") -> DataFrame:
    """tasks with their execution flags by the outcome of a run; a task without one was not tested."""
    return tasks.withColumns({"execution_tested": F.col(outcome).isNotNull(), "execution_passed": F.coalesce(F.col(outcome) == "functional_pass", F.lit(False))})


def tasks(spark: SparkSession, target: int = FULL, per_family: int = PER_FAMILY, partitions: int | None = None) -> DataFrame:
    rows = grid(spark, target, per_family)
    return tasks_of(rows.repartition(partitions) if partitions else rows)


def prompts(spark: SparkSession, skills: dict[str, list[str]], starts: list[str], givens: list[str], wants: list[str], count: int) -> DataFrame:
    """Prompts by mixed-radix numbers: every combination of skill, wording, start, given and want once before any repeats."""
    flat = [(s, w) for s, ws in skills.items() for w in ws]
    parts = [F.array(*[F.struct(F.lit(s).alias("skill"), F.lit(w).alias("wording")) for s, w in flat]), *[F.array(*map(F.lit, x)) for x in (starts, givens, wants)]]
    rows, radix = spark.range(count), 1
    digits = []
    for size in (len(flat), len(starts), len(givens), len(wants)):
        digits.append((F.floor(F.col("id") / radix) % size).cast("int"))
        radix *= size
    pick = [F.get(p, d) for p, d in zip(parts, digits)]
    text = F.concat_ws(" ", pick[1], pick[0]["wording"], pick[2], pick[3])
    return rows.select(F.col("id").alias("ordinal"), pick[0]["skill"].alias("skill_id"), text.alias("instruction"), F.format_string("t%d_%d_%d", *digits[1:]).alias("prompt_template_id"))
