"""The pipeline's stages against plain Python on a small corpus."""

import random
import re

import corpus_pipeline as P
from sparkloom.llm._common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SAY = {"en": "the and with over thing other there shall", "de": "der und nicht schön über auch können straße"}


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        lang = rnd.choice(list(SAY))
        rows.append([i, " ".join(rnd.choice(SAY[lang].split()) for _ in range(rnd.randint(20, 60))), lang])
    rows += [[200, rows[3][1], "en"], [201, re.sub("[a-z]", lambda m: m[0].upper(), rows[4][1]), None], [202, "12345 ...", "en"], [203, None, None], [204, "mail ann@example.com the other thing over there", "en"], [None, "the thing without an id and with words", "en"]]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == P.COLUMNS
    ids = {name: sorted(str(r.doc_id) for r in d.select("doc_id").collect()) for name, d in seen}
    assert "202" not in ids["language_id"] and "203" not in ids["language_id"] and len(ids["language_id"]) == len(rows) - 2
    assert set(ids["language_id"]) - set(ids["jaccard_join"]) == {"200", "201"}
    text = {r.doc_id: r for r in seen[2][1].collect()}
    assert text[204].text == "mail <EMAIL> the other thing over there" and text[204].n_chars == len(text[204].text)
    assert ids["mixing"] == ids["pii"]  # all clean
    assert sorted(set(ids["packing"])) == sorted(set(ids["mixing"]))
    run = sorted(tuple(r)[:5] for r in P.run(spark, str(tmp_path)).where("doc_id IS NOT NULL").collect())
    assert run == sorted(tuple(r)[:5] for r in docs.where("doc_id IS NOT NULL").collect())


def test_near_duplicates_keep_every_document_of_its_own(spark):
    a, b, c = ("the first text of this id and of no other one", "completely other words under the very same id here", "and a third one that nobody else has written down")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (1, a, "en", "r", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 2), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, None, "en", "s", 0), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, None, None, None, None)]
    got = P.near_duplicate_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "en", "r", 1), (1, b, "en", "s", 2), (None, c, "en", "s", 1), (None, None, "en", "s", 0), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, None, None, None, None)]))


def test_no_stage_evaluates_an_arrow_function_twice(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (P.language_stage, P.pii_stage, P.mixing_stage):
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 1 and len(plan) < 50_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
