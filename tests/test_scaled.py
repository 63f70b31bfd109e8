"""Operators that must give exact results without a driver loop or one task: against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import contamination, dedup, selection, splits, stats, tokens
from sparkloom.streaming import incremental

# --- splits ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,sizes,families", [(1, [1], 7), (2, [1, 2, 3, 7, 40], 13), (3, [4], 10), (4, [6, 9, 900], 50), (5, [1, 2, 3], 10_000)])
def test_split_without_the_driver_is_the_sequential_rule(spark, seed, sizes, families):
    rnd = random.Random(seed)
    rows = [(f"f{k}", rnd.choice(sizes)) for k in range(rnd.choice([120, 400]))]
    for ratios in ((0.9, 0.05, 0.05), (0.4, 0.35, 0.25), (0.0, 1.0, 0.0)):
        df = spark.createDataFrame([(f, n, k) for k, (f, n) in enumerate(rows)], "family string, n long, k long")
        got = {r[0]: r[1] for r in splits.assigned(df, "family", ["k"], ratios, families).collect()}
        assert got == splits.assign_families(rows, ratios)


def test_split_of_rows_with_null_families_and_few_families(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice([None, *range(30)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "family int, k int")
    got = splits.family_split(df, "family", "k", families=4).collect()
    sizes = {}
    for f, _ in rows:
        sizes[f] = sizes.get(f, 0) + 1
    import hashlib

    order = sorted(sizes, key=lambda f: (f is not None, hashlib.sha256(f"42{f}".encode()).hexdigest()))
    want = splits.assign_families([(f, sizes[f]) for f in order])
    assert len(got) == 300 and all(r.split == want[r.family] for r in got)
    two = splits.family_split(df.where("family < 2"), "family", "k").select("family", "split").distinct().collect()
    assert len(two) == 2
    assert splits.family_split(df.limit(0), "family", "k").count() == 0
    with pytest.raises(ValueError):
        splits.family_split(df, "family", "k", ratios=(0.5, 0.1, 0.1))


# --- order statistics ------------------------------------------------------------------------------------------------

INF = float("inf")


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_are_those_of_the_sorted_values(spark, seed):
    rnd = random.Random(seed)
    values = [
        [rnd.gauss(0, 1) for _ in range(3000)],
        [10.0 ** rnd.uniform(-300, 300) * rnd.choice([1, -1]) for _ in range(800)] + [1.7e308, -1.7e308, 5e-324],
        [float(rnd.randint(0, 3)) for _ in range(500)] + [INF, INF, -INF, math.nan],
        [7.25] * 40,
    ][seed]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    order = sorted(values, key=lambda x: (math.isnan(x), x))
    at = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    n = len(order)
    show = lambda x: "nan" if math.isnan(x) else x
    assert [show(r.value) for r in stats.lower_quantiles(df, "v", at).collect()] == [show(order[math.floor((n - 1) * q)]) for q in at]
    if seed != 2:
        got = [r.value for r in stats.linear_quantiles(df, "v", at).collect()]
        want = [order[math.floor((n - 1) * q)] + (order[math.ceil((n - 1) * q)] - order[math.floor((n - 1) * q)]) * ((n - 1) * q - math.floor((n - 1) * q)) for q in at]
        assert np.allclose(got, want, rtol=1e-12)


def test_quantiles_without_values_and_plan(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert stats.lower_quantiles(none, "v", [0.5]).count() == 0 and stats.linear_quantiles(none, "v", [0.5]).first().value is None
    ints = spark.range(1000).withColumn("v", F.col("id") % 10)
    assert stats.lower_quantiles(ints, "v", [0.5, 1.0]).dtypes[1] == ("value", "bigint") and [r.value for r in stats.lower_quantiles(ints, "v", [0.5, 1.0]).collect()] == [4, 9]


def test_places_are_those_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(selection, "PART_ROWS", 30)
    rows = [(random.Random(k).randint(0, 20), k) for k in range(500)]
    got = selection.placed(spark.createDataFrame(rows, "a int, b int").repartition(5), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in got) == list(range(500))


# --- sampled similarity ----------------------------------------------------------------------------------------------


def shingled(spark, n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(n):
        texts.append(rnd.choice(texts) + " " + rnd.choice(words) if texts and rnd.random() < 0.3 else " ".join(["all", "have", "this", *(rnd.choice(words) for _ in range(rnd.randint(5, 25)))]))
    return dedup.shingled(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), F.col("text"), "id")


def test_a_sample_of_pairs_estimates_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(selection, "PART_ROWS", 1000)
    held = shingled(spark, 400, 1).cache()
    exact = stats.similarity_audit(dedup.candidate_pairs(held, "id")).first()
    for seed in (0, 1):
        got = selection.sampled_audit(held, "id", 8000, seed).first()
        assert 7500 < got.draws < 8500 and 0 < got.pairs_error < 0.05 * exact.pairs
        assert abs(got.pairs - exact.pairs) < 4 * got.pairs_error and abs(got.mean_similarity - exact.mean_similarity) < 4 * got.mean_error
        assert abs(got.gte_0_80 - exact.gte_0_80) < 0.5 * exact.gte_0_80 and got.max_similarity <= exact.max_similarity


def test_few_pairs_are_counted_exactly(spark):
    held = shingled(spark, 12, 2)
    got, want = selection.sampled_audit(held, "id", 10_000).first(), stats.similarity_audit(dedup.candidate_pairs(held, "id")).first()
    assert round(got.pairs) == want.pairs and abs(got.mean_similarity - want.mean_similarity) < 1e-12 and got.pairs_error == 0 and got.max_similarity == want.max_similarity
    assert selection.sampled_audit(held.limit(0), "id").first().pairs == 0


# --- containment -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [(50_000, 16 << 20), (3, 16 << 20), (50_000, 60)])
def test_containment_of_items_of_any_length(spark, most):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 4)))
    items = [(k, "".join(word() for _ in range(rnd.choice([1, 1, 2, 15])))) for k in range(25)] + [(90, ""), (91, None), (3, "bé"), (92, "x" * 50 + "yz"), (93, "x" * 50 + "zz")]
    docs = [(k, "".join(word() for _ in range(40))) for k in range(40)]
    docs += [(100 + k, "aa" + (t or "") + "b") for k, (_, t) in enumerate(items)] + [(None, "bé"), (200, None), (201, ""), (100, "bé"), (202, "x" * 60 + "yz")]
    got = contamination.containments(spark.createDataFrame(docs, "doc int, text string").repartition(3), spark.createDataFrame(items, "item int, text string"), "doc", "item", most_items=most[0], most_chars=most[1])
    want = {(d, i) for d, t in docs for i, n in items if t and n and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 60
    assert contamination.containments(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame([], "item int, text string"), "doc", "item").count() == 0


def test_texts_are_in_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc int, text string")
    plan = contamination.containments(docs, spark.createDataFrame([(1, "me")], "item int, text string"), "doc", "item")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("Join")  # below the join only ids and items are left
    keys = contamination.overlap_matrix(docs.withColumn("s", F.lit("a")), "s", {"text": F.col("text")})._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in keys


# --- tokenizer training ----------------------------------------------------------------------------------------------


def plain_merges(words, size, least):
    """The rule itself: count everything again after each merge."""
    words, out, known = [(list(w), n) for w, n in words], [], set()
    while len(known) < size:
        count = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                count[p] = count.get(p, 0) + n
        best = max(count, key=lambda p: (count[p], p), default=None)
        if best is None or count[best] < least:
            break
        out.append(list(best))
        known.add("".join(best))
        words = [(tokens.merged(w, best), n) for w, n in words]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_are_those_of_the_plain_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(tokens, "ROUND", 16)
    rnd = random.Random(seed)
    words = sorted({("".join(rnd.choice("aabcde" if seed == 1 else "ab") for _ in range(rnd.randint(1, 9))), rnd.randint(1, 40)) for _ in range(60)})
    want = plain_merges(words, 30, 2)
    vocab = {}
    assert tokens._learnt([(list(w), n) for w, n in words], vocab, 30, 2) == want and list(vocab) == list(dict.fromkeys("".join(p) for p in want))
    vocab = {}
    df = spark.createDataFrame([(list(w), n) for w, n in words], "w array<string>, n long").repartition(3)
    assert tokens._learnt_in_rounds(df, vocab, 30, 2) == want and len(want) >= 28


def test_training_by_rounds_gives_the_same_tokenizer(spark):
    df = spark.createDataFrame([("the cat sat on the mat and the hat",), ("naïve cats said that the mats",), (None,), ("",)] * 2, "text string")
    one, two = (tokens.train_bpe(df, "text", 290, driver_pretokens=k) for k in (100, 0))
    assert one == two and len(one["model"]["merges"]) > 8


def test_completion_takes_the_first_new_substrings(spark):
    docs = [(1, "abc d"), (2, "xabcd<y"), (3, None), (4, "ab")]
    known = spark.createDataFrame([("abc",)], "token string")
    want, seen = [], {"abc"}
    for _, t in docs:
        for k in range(8, 2, -1):
            for i in range(len(t or "") - k + 1):
                g = t[i : i + k]
                if g not in seen and g.isprintable() and g == g.strip() and not set("<>") & set(g):
                    seen.add(g)
                    want.append(g)
    df = spark.createDataFrame(docs, "id int, text string")
    for need in (3, 100):
        assert [r.token for r in tokens.completion_tokens(df, "text", known, need, "id").collect()] == want[:need]


# --- grouping sets ---------------------------------------------------------------------------------------------------


def test_margins_count_every_set(spark):
    rows = [("a", 1), ("a", None), ("b", 1), ("b", 1)]
    got = stats.margins(spark.createDataFrame(rows, "x string, y int"), {"x": F.col("x"), "y": F.col("y")}, [("x",), ("x", "y"), ()])
    assert sorted(map(tuple, got.collect())) == sorted([("a", "*", 2), ("b", "*", 2), ("a", "1", 1), ("a", "unknown", 1), ("b", "1", 2), ("*", "*", 4)])


# --- streams ---------------------------------------------------------------------------------------------------------


def written(spark, path, batches, schema):
    """A stream that reads one batch after the other."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for name in os.listdir(path):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{path}/{name}", f"{path}/b{k}-{name}")
                os.utime(f"{path}/b{k}-{name}", (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_near_pairs_of_a_stream_within_the_watermark(spark, tmp_path):
    rnd = random.Random(7)
    base = ["".join(f"w{rnd.randint(0, 400)} " for _ in range(60)) for _ in range(6)]

    def text():
        words = rnd.choice(base).split()
        if rnd.random() < 0.7:
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 5)}"
        return " ".join(words)

    batches, k = [], 0
    for b in range(4):
        rows = []
        for _ in range(25):
            rows.append((1000 - k, text(), 10_000 + 600 * b + rnd.randint(0, 500)))
            k += 1
        batches.append(rows)
    batches[3] += [(2000, batches[0][0][1], 10_000), (2001, "", 11_000), (2002, None, 11_000)]  # 2000: far behind the watermark
    stream = written(spark, tmp_path / "in", [[(i, t, s) for i, t, s in b] for b in batches], "id long, text string, s long").withColumn("at", F.timestamp_seconds("s"))
    found, query = incremental.run(incremental.near_candidates(stream, "id", "text", "at", horizon="15 minutes", late="10 minutes"))
    rows = [r for b in batches for r in b]
    docs = spark.createDataFrame(rows, "id long, text string, s long")
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    got = {tuple(r) for r in incremental.verified(found, docs, "id", "text").collect()}
    at = {i: s for i, _, s in rows}
    every = {tuple(r) for r in dedup.near_pairs(dedup.shingled(docs, F.col("text"), "id"), "id", 9, 10).collect()}
    want = {r for r in every if 2000 not in r[:2] and abs(at[r[0]] - at[r[1]]) <= 900}
    assert got == want and len(want) > 50 and len(want) < len(every)
    assert incremental.late_rows(query) > 0 and 0 < incremental.kept_rows(query)


def test_joined_streams_forget_and_count_late_rows(spark, tmp_path):
    kind = "key long, s long"
    first = written(spark, tmp_path / "a", [[(1, 10_000), (2, 10_050)], [(1, 30_000)], [(4, 60_000), (3, 5)]], kind)
    then = written(spark, tmp_path / "b", [[(1, 10_100), (2, 13_000), (2, 9_000)], [(1, 30_001), (1, 29_000)], [(4, 60_000), (9, 60_500)]], kind)
    at = lambda d: d.withColumn("ts", F.timestamp_seconds("s"))
    found, query = incremental.run(incremental.followed(at(first), at(then), "key", "ts", "10 minutes", "5 minutes", "5 minutes").select("first_key", "first_s", "then_s"))
    assert sorted(map(tuple, found.collect())) == [(1, 10_000, 10_100), (1, 30_000, 30_001)]
    assert incremental.late_rows(query) == 1  # (3, 5); a batch's rows are late by the watermark of the batch before it
    assert incremental.kept_rows(query) <= 3  # all but the last batch's rows are forgotten


def test_a_stream_without_rows_gives_an_empty_table(spark, tmp_path):
    empty = written(spark, tmp_path / "e", [[]], "key long, s long")
    assert incremental.drained(empty, "none").count() == 0
    assert incremental.drained(empty.groupBy("key").count(), "none", "complete").count() == 0
