import difflib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import contamination, dedup, generate, packing, sampling, sandbox, splits, stats, tokens, validate


def norm(t):
    return " ".join(t.lower().split())


def shingles(t):
    w = norm(t).split()
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def sequential(rows, threshold=0.9):
    """Keeps the first of equal or similar records, one after the other."""
    kept, keys, out = [], set(), {}
    for o, i, r in rows:
        key, text = norm(i) + "\n" + norm(r), norm(i + "\n" + r)
        if key in keys:
            out[o] = "exact"
            continue
        s = shingles(text)
        near = [k for k in kept if s & k[0] and max(len(s & k[0]) / len(s | k[0]), difflib.SequenceMatcher(None, text, k[1]).ratio()) >= threshold]
        if near:
            out[o] = "near"
            continue
        out[o] = None
        kept.append((s, text))
        keys.add(key)
    return out


def test_near_dedup_matches_a_sequential_pass(spark):
    rnd = random.Random(0)
    base = [" ".join(rnd.choice("red green blue small large box ball cup".split()) for _ in range(14)) for _ in range(8)]
    rows = []
    for o in range(90):
        w = rnd.choice(base).split()
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(["odd", "even", "red"])
        rows.append((o, "say " + w[0], " ".join(w)))
    got = dedup.near_dedup(spark.createDataFrame(rows, "o long, i string, r string"), "i", "r", "o")
    assert {r.o: r.drop_reason for r in got.collect()} == sequential(rows)


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for o in range(330):  # near copies by one word at an end or a letter, copies, and others that share a hot opening
        w = list(base)
        kind = rnd.random()
        if kind < 0.5:
            w[rnd.choice([0, 59])] = f"x{o}"
        elif kind < 0.7:
            w[rnd.randrange(60)] += "y"
        elif kind < 0.9:
            w = base[:4] + [f"z{rnd.randrange(40)}q{rnd.randrange(9)}" for _ in range(40)]
        rows.append((o, "w", " ".join(w), f"f{o % 3}"))
    df = spark.createDataFrame(rows, "o long, i string, r string, f string")
    expected = sequential([r[:3] for r in rows])
    assert sum(v is not None for v in expected.values()) > 200
    for block in (2000, 50):
        monkeypatch.setattr(dedup, "BLOCK", block)
        assert {r.o: r.drop_reason for r in dedup.near_dedup(df, "i", "r", "o").collect()} == expected
    got = {r.o: r.drop_reason for r in dedup.near_dedup(df, "i", "r", "o", family="f").collect()}
    apart = {}  # exact copies count over all families, near ones within each
    kept, keys = [], set()
    for o, i, r, f in rows:
        key, text = norm(i) + "\n" + norm(r), norm(i + "\n" + r)
        s = shingles(text)
        near = any(f == k[2] and s & k[0] and max(len(s & k[0]) / len(s | k[0]), difflib.SequenceMatcher(None, text, k[1]).ratio()) >= 0.9 for k in kept)
        apart[o] = "exact" if key in keys else "near" if near else None
        if apart[o] is None:
            kept.append((s, text, f))
            keys.add(key)
    assert got == apart


def test_no_pair_of_the_character_ratio_is_shuffled(spark):
    rnd = random.Random(7)
    texts = ["hot opening words " + " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.choice([3, 60]))) for _ in range(60)]
    texts += [t[:k] + "x" + t[k + 1 :] for t in texts for k in (20, len(t) - 1)]
    rows = [(o, t) for o, t in enumerate(rnd.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "o long, _text string")
    held = dedup.hashed(df, F.col("_text"), "o", "_text").withColumn("shingles", F.lit(None).cast("array<string>"))
    pairs = dedup.ratio_pairs(held, "o", 9, 10)
    expected = [(a, b) for a, s in rows for b, t in rows if a < b and shingles(s) & shingles(t) and difflib.SequenceMatcher(None, t, s).ratio() >= 0.9]
    assert sorted(map(tuple, pairs.collect())) == expected and len(expected) > 100
    assert "Exchange" not in pairs._jdf.queryExecution().toString()
    some = dedup.ratio_pairs(held.where("o >= 90"), "o", 9, 10, held.where("o < 90"))
    assert sorted(map(tuple, some.collect())) == [p for p in expected if p[0] < 90 <= p[1]]


def test_common_subsequences_bound_the_ratio():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd é") for _ in range(rnd.randint(0, 90))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for c in a:
            row, above = [0], row
            for k, d in enumerate(b):
                row.append(above[k] + 1 if c == d else max(above[k + 1], row[k]))
        got = dedup.longest_common(a, dedup.places(b), len(b))
        assert got == row[-1] and 2 * got >= difflib.SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) - 1e-9


def test_containments(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "zone two three four five six sevenths"), (3, "one two"), (4, None)], "id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two three four"), (3, "one two")], "item long, text string")
    # items of two words count as well
    assert sorted(map(tuple, contamination.containments(docs, bench, "id", "item").collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3)]


def test_splits():
    sizes = [(f"f{k}", 2) for k in range(30)]
    got = splits.assign_families(sizes)
    assert {s: sum(v == s for v in got.values()) for s in splits.SPLITS} == {"train": 26, "validation": 2, "test": 2} or sum(v == "train" for v in got.values()) >= 26
    with pytest.raises(ValueError):
        splits.assign_families(sizes, (0.5, 0.5, 0.5))


def test_family_split_has_no_leak(spark):
    df = spark.range(200).withColumn("family", F.col("id") % 31)
    for mode in ("python", "hash"):
        out = splits.family_split(df, "family", "id", mode=mode)
        assert out.count() == 200 and splits.leakage(out, "family").count() == 0 and out.select("split").distinct().count() == 3


def test_masks_windows_and_checks(spark):
    df = spark.createDataFrame([([10, 11], [12]), (list(range(10, 20)), [30, 31]), ([10], list(range(40, 60)))], "p array<int>, a array<int>")
    got = [r.e for r in df.select(packing.sft_encoding(F.col("p"), F.col("a"), 7).alias("e")).collect()]
    assert got[0].input_ids == [1, 10, 11, 12, 2] and got[0].labels == [-100, -100, -100, 12, 2] and not got[0].truncated
    assert got[1].input_ids == [1, 16, 17, 18, 19, 30, 31, 2] and got[1].truncated
    assert got[2].input_ids == [*range(53, 60), 2] and got[2].prompt_length == 0
    w = spark.range(1).select(F.explode(packing.windows(F.sequence(F.lit(3), F.lit(16)), 5)).alias("w")).collect()
    assert len(w) == 9 and (w[2].w.x, w[2].w.y) == ([5, 6, 7, 8, 9], [6, 7, 8, 9, 10])
    x = df.limit(1).select(packing.padded(F.array(*map(F.lit, [1, 30, 41, 52, 2])), F.array(*map(F.lit, [-100, -100, -100, 52, 2])), 6).alias("x")).first().x
    assert x.x == [1, 30, 41, 52, 0, 0] and x.y == [-100, -100, 52, 2, -100, -100]


def test_quantiles_offsets_and_epochs(spark):
    df = spark.createDataFrame([(k, k * k % 97) for k in range(101)], "id long, v long")
    values = sorted(k * k % 97 for k in range(101))
    assert {r.q: r.value for r in stats.lower_quantiles(df, "v", [0.5, 0.9, 0.99]).collect()} == {q: values[int(100 * q)] for q in (0.5, 0.9, 0.99)}
    starts = {r.id: r.start for r in packing.offsets(df, "id", F.col("v"), ranges=7).collect()}
    assert starts == {k: sum(j * j % 97 for j in range(k)) for k in range(101)}
    places = [r.place for r in sampling.epoch(df, "id", 1, 2, 8).collect()]
    assert sorted(places) == list(range(101))


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([("the other thing \tthere, 123 naïve",), ("then the theory: 12\n\n  x",)], "text string")
    spec = tokens.train_bpe(df, "text", vocabulary=320)
    assert tokens.round_trip_failures(df, "text", spec).count() == 0
    ids = df.select(tokens.encode(spec, 1, 2)("text").alias("i")).first().i
    assert ids[0] == 1 and ids[-1] == 2 and len(spec["model"]["vocab"]) <= 320


def test_generated_tasks_pass_their_tests(spark):
    for blueprint in generate.TEMPLATES:
        _, code, cases = generate.render(blueprint, 7, 2)
        if "import" not in code:
            assert sandbox.run_tests(code, "solve", cases, 20.0, True) == "functional_pass", blueprint
    assert sum(generate.allocation(100_000).values()) == 100_000 and sum(generate.allocation(777).values()) == 777
    one = generate.tasks(spark, 60)
    assert {tuple(r) for r in one.select("task_type", "source", "license", "interface", "execution_tested", "execution_passed").collect()} == {("code_generation", "programmatic", "generated", "function", False, False)}
    ran = generate.executed(one.withColumn("outcome", F.when(F.col("ordinal") % 3 == 0, "functional_pass").when(F.col("ordinal") % 3 == 1, "timeout")))
    assert sorted(map(tuple, ran.groupBy("execution_tested", "execution_passed").count().collect())) == [(False, False, 20), (True, False, 20), (True, True, 20)]
    a, b = (sorted(map(tuple, generate.tasks(spark, 60).select("id", "instruction").collect())) for _ in "ab")
    assert a == b and len({x[0] for x in a}) == 60


def test_sandbox_outcomes():
    case = [{"args": [1], "expected": 2}]
    assert sandbox.run_tests("while True:\n    pass", "solve", [], 0.5) == "timeout"
    assert sandbox.run_tests("import os\ndef solve(x):\n    return 2", "solve", case) == "unsafe_for_execution"
    assert sandbox.run_tests("def solve(x):\n    return x", "solve", case, 20.0) == "runtime_failure"
    assert sandbox.run_tests("def solve(x):\n    return x + 1", "solve", case, 20.0) == "functional_pass"


def test_null_keys_and_families_lose_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "A "), (5, "b")], "id long, k string")
    assert sorted(r.id for r in dedup.exact_dedup(df, F.lower(F.trim("k")), "id").collect()) == [1, 2, 5]
    flags = {r.id: r.has_earlier_k for r in dedup.earlier_flags(df, {"k": F.lower(F.trim("k"))}, "id").collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True, 5: False}
    for mode in ("hash", "python"):
        rows = spark.createDataFrame([(i, f) for i, f in enumerate(["x", "x", None, None, "y", "z", "z", "z"])], "id long, f string")
        got = splits.family_split(rows, "f", "id", mode=mode).collect()
        assert sorted(r.id for r in got) == list(range(8)) and len({(r.f, r.split) for r in got}) == 4


def test_language_counts_whatever_its_case(spark):
    row = {"id": "1", "instruction": "i", "response": "r", "code": "", "record_kind": "instruction", "task_type": "code_generation", "category": "strings", "quality_score": 1.0}
    rows = [row | {"language": lang} for lang in ("Python", " python ", "java", "", None)]
    schema = "id string, instruction string, response string, code string, record_kind string, task_type string, category string, quality_score double, language string"
    got = [r.x for r in spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).select(validate.schema_issue().alias("x")).collect()]
    assert got == [None, None, "language", "language", "language"]


def test_a_split_is_named_by_what_it_shares(spark):
    got = spark.createDataFrame([(0, 0), (1, 1), (0, 2)], "p int, s int").select(stats.classify_split({"prompts": F.col("p"), "solutions": F.col("s")}).alias("x"), stats.classify_split({}).alias("y")).collect()
    assert [tuple(r) for r in got] == [("disjoint", "disjoint"), ("shares_prompts", "disjoint"), ("shares_solutions", "disjoint")]


def test_gram_bounds_never_lose_a_pair(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(400):
        words = "".join(rnd.choice("etaoinshr dlu,xq9") for _ in range(rnd.choice([20, 90, 210, 400, 1500])))
        if k % 4 == 0:
            words = "".join(rnd.choice("etaoinshrd") for _ in range(300)) + words[:20]  # few anchors
        if k % 5 == 0:
            words = words[:8] * (len(words) // 8)  # few different grams
        other = list(words)
        for _ in range(rnd.randrange(1, 2 + len(other) // rnd.choice([8, 20, 100]))):
            at = rnd.randrange(len(other))
            if rnd.random() < 0.5:
                other[at : at + rnd.randrange(4)] = []
            else:
                other[at:at] = rnd.choice(["x", "e", "the ", "é😀"])
        rows.append((words, "".join(other)) if k % 3 else ("".join(other), words))
    texts = sorted({t for r in rows for t in r})
    strangers = [(texts[k], texts[k * 7 % len(texts)]) for k in range(len(texts))]
    df = spark.createDataFrame(rows + strangers, "x string, y string")
    got = df.select("x", "y", dedup.shares_grams(9, 10)(F.length("x"), dedup.gram_bits(F.col("x")), F.length("y"), dedup.gram_bits(F.col("y"))).alias("may")).collect()
    near = [r for r in got if difflib.SequenceMatcher(None, r.x, r.y).ratio() >= 0.9]
    assert len(near) > 60 and all(r.may for r in near)
    assert sum(not r.may for r in got) > 200
