import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import curves, dedup, stats, tokens, validate
from sparkloom.sources import caches


def test_flat_cache(spark, tmp_path):
    ids = np.arange(1000, dtype="<u2") * 7
    ids.tofile(tmp_path / "a.bin")
    got = caches.read_tokens(spark, str(tmp_path / "a.bin"), part=300)
    assert [(r.pos, r.token) for r in got.orderBy("pos").collect()] == list(enumerate(ids.tolist()))
    (tmp_path / "none.bin").write_bytes(b"")
    assert caches.read_tokens(spark, str(tmp_path / "none.bin")).count() == 0


def test_offset_cache(spark, tmp_path):
    records = [[1, 5, 2], [], [1, 60000, 7, 2]]
    flat = [x for r in records for x in r]
    np.array(flat, "<u2").tofile(tmp_path / "i.bin")
    np.array([-100 if x == 1 else x for x in flat], "<i4").tofile(tmp_path / "l.bin")
    np.save(tmp_path / "o.npy", np.cumsum([0, *map(len, records)]))
    got = caches.read_records(spark, *(str(tmp_path / n) for n in ("i.bin", "l.bin", "o.npy")), part=2).orderBy("record").collect()
    assert [r.input_ids for r in got] == records and got[2].labels == [-100, 60000, 7, 2]
    caches.write_manifest(str(tmp_path / "m.json"), {"é": 1})
    assert json.loads((tmp_path / "m.json").read_text("utf-8")) == {"é": 1}


def test_words_and_shingles_match_python(spark):
    odd = "".join(T.SPACES)
    texts = ["", " ", odd, f"One{odd}two　THREE  four\nfive", "a b", "a b c", "a b c a b c a", "Straße é​x y z", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.words(F.col("t")).alias("w"), T.shingles(F.col("t")).alias("s"), T.strip(F.col("t")).alias("x"), T.dedup_form(F.col("t")).alias("d")).orderBy("k").collect()
    assert odd.split() == [] and got[-1].w is None
    for r, t in zip(got[:-1], texts):
        w = t.lower().split()
        want = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        assert (r.w, r.s, r.x, r.d) == (w, list(dict.fromkeys(want)), t.strip(), " ".join(w))


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": ["\\u00e9", 1e22, null]}', "no json", None, "[]"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.canonical_json("t").alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == ['{"a":["é",1e+22,null],"b":1.0}', None, None, "[]"]


def test_tokenizer_contract_and_inspection(spark):
    docs = spark.createDataFrame([("a b a b abab",), ("abab é",), (None,)], "t string")
    spec = tokens.train_bpe(docs.where("t IS NOT NULL"), "t", vocabulary=262)
    size = len(spec["model"]["vocab"])
    assert tokens.contract(spec, size) == {"vocabulary_size": True, "special_token_ids": True}
    assert not tokens.contract(spec, size + 1)["vocabulary_size"] and not tokens.contract(spec, size, ("<BOS>",))["special_token_ids"]
    for r in tokens.inspect(docs, "t", spec).collect():
        assert r.round_trip and r.token_count == len(r.ids) == len(r.tokens)


def test_final_guard():
    validate.guard_final("validation.jsonl", False)
    held = {"splits": {"train": {"source": "train.jsonl"}, "validation": {"source": "v.jsonl"}}, "test_split_immutable": True}
    validate.guard_final("test.jsonl", True, held)
    for args in (("Test.jsonl", False), ("test.jsonl", True), ("test.jsonl", True, held | {"splits": {"train": {"source": "test.jsonl"}}})):
        with pytest.raises(ValueError):
            validate.guard_final(*args)


def test_normalised_code_and_nulls(spark):
    rows = [("code", None, None, "```py\nx = 1\n```", "Trees", None), ("instruction", None, None, None, None, None)]
    got = validate.normalised(spark.createDataFrame([(k, None, i, None, r, c, g, "code", None, f) for k, i, r, c, g, f in rows], "record_kind string, id string, instruction string, input string, response string, code string, category string, task_type string, source string, family_id string")).collect()
    assert (got[0].code, got[0].family_id, got[0].category, got[0].source) == ("x = 1", "trees", "trees", "unknown")
    assert got[1].instruction == "" and got[1].id.startswith("py_") and got[1].code is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, i string, r string, c int, v array<double>")
    row = stats.sft_summary(none, F.col("i"), F.col("r"), F.col("c"), {"id": F.col("id")}).first()
    assert row.n == 0 and row.response_unique_rate == 0 and row.min_cases == 0
    assert curves.clipping(none, "v").first().norm == 0
    assert dedup.posting_cap(dedup.shingled(none, F.col("i"), "id")).first().postings == 0
