"""Reports, gates and settings on small rows."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.operators import contamination, packing, stats, tokens
from sparkloom.sources import archive, records, token_sink


def test_the_least_length_that_cuts_nothing(spark):
    rows = spark.createDataFrame([(10,), (70,), (100,)], "w int")
    pick = lambda c, **k: [r.length for r in stats.selected_length(stats.sequence_candidates(rows, "w", c), **k).collect()]
    assert pick((64, 96, 128, 192)) == [128] and pick((64, 96)) == [] and pick((64, 96), fallback=True) == [96]


def test_budget_of_an_update(spark):
    row = stats.budget_expectations(spark.createDataFrame([(10, 4), (20, 5), (6, 3)], "t int, s int"), "t", "s", 32, batch=2, passes=3).first()
    assert (row.examples, row.tokens, row.supervised, row.ignored, row.static_padding, row.updates_per_pass, row.steps, row.positions_per_pass) == (3, 36, 12, 24, 60, 2, 6, 33)
    assert row.positions_per_update == 22 and row.supervised_per_update == 8
    assert stats.budget_expectations(spark.createDataFrame([], "t int, s int"), "t", "s", 32).first().positions_per_update == 0


LOG = "step int, tokens_seen long, train_loss double, validation_loss double, learning_rate double, gradient_norm double, tokens_per_second double"


def test_progress_flags(spark):
    rows = [(k, k * 10, 5.0 - k * 0.1, 4.0 + k * 0.1 if k % 5 == 0 else None, 0.1, None if k == 29 else 1.0 * k, 100.0) for k in range(30)]
    got = stats.training_progress(spark.createDataFrame(rows, LOG)).first()
    assert got.current_step == 29 and got.tokens_seen == 290 and got.train_loss_decreasing and not got.validation_loss_improving and got.divergence_warning
    assert got.best_validation_step == 0 and got.recent_gradient_norm == sum(range(10, 29)) / 19 and got.latest_validation_loss == 6.5
    none = stats.training_progress(spark.createDataFrame([(1, 1, 2.0, None, 0.1, 1.0, 1.0)], LOG)).first()
    assert none.latest_validation_loss is None and not none.validation_loss_improving and not none.divergence_warning
    assert stats.training_progress(spark.createDataFrame([(1, 1, None, 2.0, 0.1, 1.0, 1.0)], LOG)).count() == 0


def test_offsets_that_fit_and_that_do_not(spark):
    check = lambda rows: {r.name: r.passed for r in packing.offset_checks(spark.createDataFrame(rows, "start long, n int"), "start", F.col("n")).collect()}
    assert all(check([(0, 3), (3, 0), (3, 4), (7, 1)]).values()) and all(check([]).values()) and all(check([(0, 0)]).values())
    assert not check([(0, 3), (4, 4)])["contiguous"] and not check([(0, 3), (2, 4)])["contiguous"] and not check([(1, 3)])["starts_at_zero"] and not check([(-1, 3), (2, 2)])["not_negative"]
    assert not check([(0, 3), (0, 3), (3, 2), (3, 2)])["contiguous"]


def test_gates_stop_a_cache(spark, tmp_path):
    ids = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x + 10)
    good = spark.range(3).select(packing.sft_encoding(ids(4), ids(3), 16).alias("e"))
    told = token_sink.write_sft_cache(good, str(tmp_path / "a"), 16, 16)
    assert told["rows"] == 3 and told["tokens"] == 27 and [r.labels[:5] for r in token_sink.read_packed(spark, str(tmp_path / "a")).collect()] == [[-100] * 5] * 3
    bad = {"no_truncation": packing.sft_encoding(ids(40), ids(3), 16), "ids_in_range": packing.sft_encoding(F.array(F.lit(50_000)), ids(3), 16), "both_kinds_everywhere": packing.sft_encoding(ids(3), ids(40), 16)}
    for name, e in bad.items():
        with pytest.raises(ValueError, match=name):
            token_sink.write_sft_cache(spark.range(2).select(e.alias("e")), str(tmp_path / "b"), 16, 16)
    with pytest.raises(ValueError, match="chosen"):
        token_sink.write_sft_cache(good, str(tmp_path / "b"), 16, 32)
    assert not os.path.exists(tmp_path / "b")
    assert spark.range(1).select(packing.checked_ids(F.array(F.lit(5)), 6).alias("i")).first().i == [5]
    with pytest.raises(Exception, match="vocabulary"):
        spark.range(1).select(packing.checked_ids(F.array(F.lit(6)), 6).alias("i")).collect()


def test_shared_shingles_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c"), (3, None), (4, "a b")], "id int, text string")
    items = spark.createDataFrame([(7, "A  b c d"), (8, "a b"), (7, "a b c")], "item int, text string")
    assert sorted(map(tuple, contamination.shared_shingles(docs, items, "id", "item").collect())) == [(1, 7, 2), (2, 7, 1), (4, 8, 1)]


def test_jsonl_digest_sides_and_missing_exclusions(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "b int, a string")
    one, two = (records.write_jsonl(rows.repartition(n), str(tmp_path / f"j{n}"), "b") for n in (2, 5))
    lines = [line for name in sorted(os.listdir(tmp_path / "j2")) if name.startswith("part-") for line in open(tmp_path / "j2" / name)]
    assert [json.loads(x)["b"] for x in lines] == list(range(20)) and lines[0] == '{"a":"t0","b":0}\n' and one == two
    parts = [hashlib.sha256((tmp_path / "j2" / n).read_bytes()).hexdigest() for n in sorted(os.listdir(tmp_path / "j2")) if n.startswith("part-")]
    assert one == hashlib.sha256("\n".join(parts).encode()).hexdigest()
    assert records.read_exclusions(spark, str(tmp_path / "none.json")).count() == 0
    held = spark.createDataFrame([("do", "x = 1", True), (" ", "x = 1", True), ("do", "", True), ("do", "x = =", False)], "instruction string, response string, syntax_valid boolean")
    told = {r.name: r.n for r in records.sft_sides(held, str(tmp_path / "sft")).collect()}
    assert told == {"rows": 4, "accepted": 1, "rejected": 3, "other": 0, "empty_instruction": 1, "empty_response": 1, "syntax_invalid": 1}
    assert records.gate_side(spark, str(tmp_path / "sft"), "rejected").count() == 3


def test_tokenizer_gates_and_reloading(spark):
    df = spark.createDataFrame([("the cat sat", "train"), ("on the mat", "train")] * 2, "text string, split string")
    assert tokens.reload_failures(df, "text", tokens.train_bpe(df, "text", 280)).count() == 0
    assert tokens.training_gate(df, "a", "a", 32_000) == 32_000 and tokens.training_gate(df, "a", "b", 100, smoke=True) == 260
    for bad, digest in ((df, "b"), (df.withColumn("split", F.lit("test")), "a"), (df.withColumn("split", F.lit(None).cast("string")), "a")):
        with pytest.raises(ValueError):
            tokens.training_gate(bad, digest, "a", 32_000)


def test_staging_refuses_a_full_target(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.txt").write_text("x")
    (tmp_path / "one.txt").write_text("1")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    assert archive.stage(source, target, dry_run=True) == ["deep/x.txt"] and not os.path.exists(target)
    assert archive.stage(source, target) == ["deep/x.txt"] and (tmp_path / "out" / "deep" / "x.txt").read_text() == "x"
    with pytest.raises(FileExistsError):
        archive.stage(source, target)
    assert archive.stage(str(tmp_path / "one.txt"), target, force=True) == ["one.txt"]
    with pytest.raises(FileNotFoundError):
        archive.stage(str(tmp_path / "none"), target)


def test_production_and_model_settings():
    assert config.load(config.ProductionConfig, {"minimum_examples": 5, "maximum_examples": 9}).ratios == (0.9, 0.05, 0.05)
    for bad in ({"minimum_examples": 9, "maximum_examples": 5}, {"minimum_examples": 1, "maximum_examples": 5, "require_known_license": False}, {"minimum_examples": 1, "maximum_examples": 5, "difficulty": {"easy": 0.5}}, {"minimum_examples": 1}):
        with pytest.raises(ValueError):
            config.load(config.ProductionConfig, bad)
    assert config.ModelConfig().parameters == 201_560_832
    for bad in ({"heads": 7}, {"special_ids": (0, 0, 1, 2)}, {"special_ids": (0, 1, 2, 40_000)}, {"layers": 0}):
        with pytest.raises(ValueError):
            config.ModelConfig(**bad)
