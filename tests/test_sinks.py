"""Sinks and gates: what is written comes back, and what fails leaves nothing."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import records, token_sink


def files(path):
    return sorted(os.path.relpath(f"{d}/{n}", path) for d, _, names in os.walk(path) for n in names)


@pytest.mark.parametrize("dtype,top", [("<u2", 65_535), ("<u4", 2_000_000_000)])
def test_packed_rows_come_back_in_order(spark, tmp_path, dtype, top):
    rnd = random.Random(1)
    rows = [(k, [rnd.randint(0, top) for _ in range(rnd.choice([0, 1, 5, 40]))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, ids array<bigint>").repartitionByRange(5, "k").sortWithinPartitions("k")
    told = token_sink.write_packed(df.withColumn("labels", F.transform("ids", lambda x, i: i - 100)), str(tmp_path), dtype)
    got = token_sink.read_packed(spark, str(tmp_path), piece=7).orderBy("row").collect()
    assert [r.ids for r in got] == [ids for _, ids in rows] and [r.labels for r in got] == [[i - 100 for i in range(len(ids))] for _, ids in rows]
    assert [r.offset for r in got] == [sum(len(i) for _, i in rows[:k]) for k in range(300)] and [r.row for r in got] == list(range(300))
    assert told["rows"] == 300 and told["tokens"] == sum(len(i) for _, i in rows) and token_sink.verify_packed(str(tmp_path)) == []
    part = next(f for f in files(tmp_path) if f.endswith(".ids") and os.path.getsize(tmp_path / f))
    with open(tmp_path / part, "r+b") as f:
        f.write(b"\xff\xfe")
    assert len(token_sink.verify_packed(str(tmp_path))) == 1


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path)
    good = spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>")
    token_sink.write_packed(good, path)
    before = files(path)
    bad = spark.range(8).select(F.array(F.when(F.col("id") == 6, F.lit(70_000)).otherwise(F.lit(1))).alias("ids")).repartition(4)
    for rows in (bad, spark.createDataFrame([([1, 2], [1])], "ids array<int>, labels array<int>"), spark.createDataFrame([(None,)], "ids array<int>"), spark.createDataFrame([([1], [1]), ([1], None)], "ids array<int>, labels array<int>").coalesce(1)):
        with pytest.raises(Exception):
            token_sink.write_packed(rows, path)
        for _ in range(100):  # tasks that were running end a little later
            if files(path) == before:
                break
            time.sleep(0.1)
        assert files(path) == before
    assert sorted(r.ids for r in token_sink.read_packed(spark, path).collect()) == [[1, 2], [3]]


def test_appending_goes_on_and_overwriting_starts_anew(spark, tmp_path):
    path = str(tmp_path)
    one = spark.createDataFrame([([1, 2],)], "ids array<int>")
    token_sink.write_packed(one, path)
    assert token_sink.write_packed(spark.createDataFrame([([3],)], "ids array<int>"), path, mode="append")["tokens"] == 3
    assert [(r.row, r.offset, r.ids, r.labels) for r in token_sink.read_packed(spark, path).orderBy("row").collect()] == [(0, 0, [1, 2], None), (1, 2, [3], None)]
    assert token_sink.write_packed(one.limit(0), path)["rows"] == 0 and token_sink.read_packed(spark, path).count() == 0 and files(path) == ["manifest.json"]


def test_lines_have_numbers_in_files_of_several_pieces(spark, tmp_path):
    rnd = random.Random(2)
    want = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rnd.choice(['{"id": "%d"}' % k, "", "  ", "broken %d" % k, "[%d]" % k]) for k in range(500)]
        (tmp_path / name).write_text("\n".join(lines) + rnd.choice(["", "\n"]))
        want |= {(name, k + 1): line for k, line in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = records.read_numbered(spark, str(tmp_path)).collect()
        errors = records.line_errors(records.read_numbered(spark, str(tmp_path))).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(os.path.basename(r.file), r.line): r.value for r in got} == {k: v for k, v in want.items() if v.strip()}
    assert sorted(r.message for r in errors) == sorted(f"{n}:{k}: invalid JSON object" for (n, k), v in want.items() if v.strip() and not v.startswith("{"))


def test_one_pass_writes_both_sides_and_counts(spark, tmp_path):
    rows = spark.range(1000).withColumn("value", F.concat(F.lit("v"), F.col("id")))
    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def reason(k):
        judged.add(1)
        return None if k % 3 else ("odd" if k % 2 else "even" if k % 4 else "strange")

    told = {r.name: r.n for r in records.gated(rows, reason("id"), str(tmp_path / "out"), ["odd", "even", "never"]).collect()}
    assert judged.value == 1000  # everything was judged once
    no, yes = (records.gate_side(spark, str(tmp_path / "out"), s) for s in ("rejected", "accepted"))
    assert told == {"rows": 1000, "accepted": 666, "rejected": 334, "other": 84, "odd": 167, "even": 83, "never": 0}
    assert no.count() == 334 and no.where("reason IS NULL").count() == 0 and yes.count() == 666
    empty = {r.name: r.n for r in records.gated(rows.limit(0), F.lit(None).cast("string"), str(tmp_path / "none"), ["odd"]).collect()}
    assert empty["rows"] == 0


def test_manifest_is_plain_json(spark, tmp_path):
    token_sink.write_packed(spark.createDataFrame([([1, 2],)], "ids array<int>"), str(tmp_path))
    held = json.loads((tmp_path / "manifest.json").read_text())
    assert held["rows"] == 1 and held["tokens"] == 2 and held["parts"][0]["first_row"] == 0
