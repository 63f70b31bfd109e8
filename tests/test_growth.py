"""What must not grow faster than the tables: totals without pairs, postings counted in batches, few postings placed, small encoder batches."""

import difflib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import contamination, dedup, selection, stats, tokens


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join([f"c{k}" for k in range(i % 7 + 3)] + [f"w{i // 2}x{k}" for k in range(8)])) for i in range(90)] + [(90, ""), (91, None), (92, "c0 c1 c2")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_totals_are_those_of_the_pairs(docs, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS", 16)
    monkeypatch.setattr(dedup, "AT_ONCE", 50)
    got = dedup.shared_totals(dedup.hashed(docs, F.col("text"), "id"), "id").first().asDict()
    want = stats.similarity_audit(dedup.candidate_pairs(dedup.shingled(docs, F.col("text"), "id"), "id")).first().asDict()
    assert want["pairs"] > 2000 and {k: pytest.approx(v) for k, v in want.items()} == got


def test_posting_counts_in_several_parts(docs, monkeypatch):
    monkeypatch.setattr(dedup, "PART", 20)
    held = dedup.shingled(docs, F.col("text"), "id")
    each = Counter(s for r in held.collect() for s in r.shingles)
    found = dedup.posting_counts(held, "t bigint, c bigint", lambda t, c: [t[c > 1], c[c > 1]])
    assert sorted(r.c for r in found.collect()) == sorted(c for c in each.values() if c > 1)
    assert {r.size: r.shingles for r in dedup.posting_sizes(held).collect()} == Counter(each.values())
    assert tuple(dedup.posting_cap(held, 20).first()) == (len(each), sum(each.values()), sum(c > 20 for c in each.values()), sum(max(0, c - 20) for c in each.values()))


def test_only_postings_of_lists_that_draw_are_placed(docs, monkeypatch):
    held, sizes, real = dedup.hashed(docs, F.col("text"), "id"), [], selection.placed
    monkeypatch.setattr(selection, "placed", lambda d, *o: sizes.append(d.count()) or real(d, *o))
    drawn, rate = selection.sampled_pairs(held, "id", 40)
    assert 0 < rate < 1 and drawn.count() > 10
    assert sizes[0] < held.agg(F.sum("n")).first()[0] / 2


def test_the_encoder_takes_few_texts_at_once(monkeypatch):
    calls = []

    def encode_batch(texts, add_special_tokens):
        calls.append(len(texts))
        return [SimpleNamespace(ids=[10 + len(t)]) for t in texts]

    monkeypatch.setattr(tokens, "_tokenizer", lambda spec: SimpleNamespace(encode_batch=encode_batch))
    monkeypatch.setattr(tokens, "CHARS", 100)
    out = tokens.encode("x", 1, 2).func(pa.array(["a" * 30] * 20 + [None, "", "b" * 500]))
    assert out.to_pylist() == [[1, 40, 2]] * 20 + [[1, 10, 2], [1, 10, 2], [1, 510, 2]]
    assert max(calls) <= 6
    assert tokens.encode("x").func(pa.array([], pa.string())).to_pylist() == []


def test_a_benchmarks_shingles_go_to_the_rows(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contamination.shared_shingles(docs, docs.where("id < 2"), "id", "id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {tuple(r) for r in found.where("id = 92").collect()} == {(92, 0, 1), (92, 1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_two_blocks_are_a_batch_and_their_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS", 16)
    monkeypatch.setattr(dedup, "TOKENS", 60)
    monkeypatch.setattr(dedup, "TOLD", 50)
    rows = [(i, " ".join([f"c{k}" for k in range(i % 7 + 3)] + [f"w{i // 2}x{k}" for k in range(8)])) for i in range(60)] + [(60, " ".join(f"c{k}" for k in range(100))), (61, " ".join(f"c{k}" for k in range(90)))]
    tables, sizes, real = [], [], dedup.materialised
    monkeypatch.setattr(dedup, "materialised", lambda d, *o: sizes.append(int(d.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or tables.append(real(d, *o)) or tables[-1])
    monkeypatch.setattr(dedup, "released", lambda *t: None)
    for parts in (3, 40):  # the small blocks of many partitions are gathered
        df = dedup.hashed(spark.createDataFrame(rows, "id long, text string").repartition(parts), F.col("text"), "id")
        got = dedup.shared_totals(df, "id").first().asDict()
        want = stats.similarity_audit(dedup.candidate_pairs(dedup.shingled(spark.createDataFrame(rows, "id long, text string"), F.col("text"), "id"), "id")).first().asDict()
        assert {k: pytest.approx(v) for k, v in want.items()} == got
        blocks = [d for d in tables if "tokens" in d.columns][-1]
        assert sizes[-1] == 1
        assert all(r.rows == 1 or r.rows <= 16 and r.tokens <= 60 for r in blocks.select("rows", "tokens").collect())
        # tokens of one row are in no block
        assert blocks.agg(F.sum("tokens")).first()[0] < df.agg(F.sum("n")).first()[0]
    assert blocks.count() < 40
    assert dedup.shared_totals(df.limit(0), "id").first().pairs == 0


def test_grams_of_many_pairs_are_bounded_as_those_of_one():
    r = random.Random(11)
    base = ["".join(r.choice("etaoin shrdlu") + (r.choice("QXZ7") if r.random() < 0.02 else "") for _ in range(n)) for n in (0, 5, 9, 150, 260, 700, 1100, 1400)]
    texts = base + ["".join(c for c in t if r.random() > p) for t in base for p in (0.01, 0.05, 0.15)]
    one, many = [dedup.Grams(dedup.grams_of(t)) for t in texts], dedup.GramTable([dedup.grams_of(t) for t in texts])
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    n = np.array([len(t) for t in texts])
    for num, den in ((9, 10), (7, 10), (97, 100)):
        for kept in (i < j, i >= j):
            got = dedup.enough_grams_each(num, den, n[i], many, n[j], many, i, j, kept)
            want = [dedup.enough_grams(num, den, len(texts[p]), one[p], len(texts[q]), one[q]) if k else dedup.enough_grams(num, den, len(texts[q]), one[q], len(texts[p]), one[p]) for p, q, k in zip(i, j, kept)]
            assert got.tolist() == want and 0 < sum(want) < len(want)


def test_blocks_of_far_lengths_do_not_meet(spark, monkeypatch):
    r = random.Random(2)
    texts = ["a b c " + " ".join(f"{r.choice('xyz')}{k}" for k in range(10 + i)) for i in range(90)]
    texts += [t + "!" for t in texts[::3]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    held = dedup.hashed(spark.createDataFrame(rows, "id long, _text string"), F.col("_text"), "id", "_text")
    monkeypatch.setattr(dedup, "RATIO_ROWS", 12)
    seen, real = [], dedup.materialised
    monkeypatch.setattr(dedup, "materialised", lambda d, *o: seen.append(real(d, *o)) or seen[-1])
    monkeypatch.setattr(dedup, "released", lambda *t: None)
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and min(len(x), len(y)) * 20 >= (len(x) + len(y)) * 9 and difflib.SequenceMatcher(None, y, x).ratio() >= 0.9}
    assert {tuple(p) for p in dedup.ratio_pairs(held, "id", 9, 10).collect()} == want
    old, new = held.where("id < 60"), held.where("id >= 60")
    assert {tuple(p) for p in dedup.ratio_pairs(new, "id", 9, 10, old).collect()} == {(i, j) for i, j in want if i < 60 <= j}
    blocks = [(b.least, b.most) for b in seen[0].select("least", "most").collect()]
    assert len(blocks) > 8 and sum(y * 11 < x * 9 for _, y in blocks for x, _ in blocks) > len(blocks)
