import hashlib
import re
import unicodedata

import pytest
import xxhash

from sparkloom.llm.fingerprint import fingerprint

SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def canon(t):
    nfc = lambda s: unicodedata.normalize("NFC", s)
    return SPACE.sub(" ", nfc(nfc(t).casefold())).strip(" ")


def digest(t):
    b = canon(t).encode()
    return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b'second', 42)):016x}"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
    return out


ROWS = [
    (1, "Cáfe  Au LAIT"), (2, "cáfe au\nlait "), (3, None), (5, ""), (8, "x"), (13, "é" * 3000), (21, "aaaaaa"), (22, "aaaaaa"), (23, "aaaaaa"),
    (34, "Å  Z"), (35, "å z"), (40, "\U0001f600\U0001f601 \U0001f602"), (-7, "minus"),
]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_matches_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(ROWS)
    assert len(got) == len(ROWS)


def test_colliding_bits_are_told_apart_by_bytes(spark):
    rows = [(i, f"text number {i % 17}") for i in range(60)]
    got = {r.doc_id: r for r in fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), bits=2).collect()}
    assert len(got) == 60
    by = {}
    for i, t in rows:
        by.setdefault(got[i].fingerprint, set()).add(t)
    assert len(by) == 17 and all(len(x) == 1 for x in by.values())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, "A  B")]
    got = fingerprint(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS h1", "'x' AS fingerprint")).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2
    assert fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
