"""Decontamination, hard negatives and layout against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sparkloom.llm import decontamination, hard_negatives, layout, queries

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_contamination(docs, items, size=10):
    out = []
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination_case(seed):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "été", "x1", "9", "naïve", "𝒳", "a_b", "don't", "the", "of"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(k, text(rnd.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 25]))) for k in range(20)] + [(3, text(12)), (None, text(10)), (None, text(6)), (7, ""), (8, None), (9, " .,")]
    docs = []
    for k in range(60):
        parts = [text(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            t = rnd.choice(items)[1] or ""
            parts += [t.upper() if rnd.random() < 0.3 else t, text(rnd.randint(0, 5))]
        docs.append((rnd.choice([k, None, 5]), "".join(parts)))
    return docs + docs[:7] + [(100, None), (101, ""), (102, "..."), (100, "alpha")], items


@pytest.mark.parametrize("shared", [1 << 20, 0])
def test_contamination_matches_plain_python(spark, monkeypatch, shared):
    monkeypatch.setattr(decontamination, "MAX_SHARED", shared)  # 0: every join by a shuffle
    docs, items = contamination_case(shared)
    rows = spark.createDataFrame(docs, DOC).selectExpr("*", "'x' AS mark", "1 AS shingle", "2 AS place", "'y' AS win")
    got = decontamination.contamination_report(rows, spark.createDataFrame(items, ITEM).selectExpr("*", "1 AS size", "'z' AS items"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_contamination(docs, items)


def test_contamination_of_long_texts_and_empty_tables(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    long = "word " * 90_000 + passage + " word" * 20_000
    docs, items = [(1, long), (2, "short"), (3, " ".join(passage.split()[5:15]))], [(1, passage), (2, "p1 p2 p3")]
    got = decontamination.contamination_report(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, items)
    none = decontamination.contamination_report(spark.createDataFrame(docs, DOC), spark.createDataFrame([], ITEM)).collect()
    assert sorted(map(tuple, none), key=str) == plain_contamination(docs, [])
    assert decontamination.contamination_report(spark.createDataFrame([], DOC), spark.createDataFrame(items, ITEM)).count() == 0


def test_cleaning_keeps_what_is_below_the_share(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [(1, passage), (1, "clean text"), (2, passage + " more" * 100), (None, passage), (3, None)]
    clean = lambda most: sorted((r[0] or 0) for r in decontamination.without_contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, passage)], ITEM), most=most).collect())
    assert clean(0.0) == [1, 3] and clean(0.5) == [1, 2, 3]


# --- hard negatives --------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(good):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m == label) for b, (j, m, w) in enumerate(good) if b != a)
        for s, p in [(-s, j) for s, j, same in scored if same][:5]:
            fit = [(-n, j) for n, j, same in scored if not same and 50 * s <= -100 * n <= 95 * s][:3]
            out += [(i, p, k + 1, j, s, n) for k, (n, j) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=400):
    rnd = random.Random(seed)
    rows = [(k, [rnd.choice([-0.25, 0.0, 0.1, 0.5, 0.75]) for _ in range(6)], rnd.choice([0, 0, 1, 2, 3])) for k in range(n)]
    rows += rows[:60] + [(50, rows[50][1], 9), (100, None, 1), (150, [None, 1.0], 1), (200, [float("nan")] * 6, 1), (250, [float("inf")] * 6, 1), (300, rows[3][1], None), (None, rows[4][1], 1), (350, [], 1), (401, [0.5], 2), (402, [0.3] * 9, 0)]
    return rows


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 10), (100, 3)])
def test_negatives_match_plain_python(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    rows = vectors(sizes[1])
    got = hard_negatives.negatives_report(spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS row", "'x' AS id", "2 AS v", "3 AS anchor"))
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.negatives_report(spark.createDataFrame([], VEC)).count() == 0


def test_scores_are_exact_at_every_size():
    rnd = random.Random(1)
    for top in (10, 1 << 26, 1 << 30, 1 << 45, (1 << 63) - 1):
        a, b = (np.array([[rnd.randint(-top, top) for _ in range(5)] for _ in range(4)], np.int64) for _ in range(2))
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert hard_negatives.scores(a, b).tolist() == want


def test_limits_with_negative_and_zero_scores():
    score, ids = np.array([10, 9, 0, 0, -5, -10, 5]), np.array([3, 2, 9, 1, 4, 5, 6])
    found = hard_negatives.limited(score, ids, np.ones(7, bool), [10, 0, -10, 20], 3)
    assert [[int(ids[i]) for i in f] for f in found] == [[2, 6], [1, 9], [], [3]]


# --- layout ----------------------------------------------------------------------------------------------------------

ROW = "doc_id long, text string, lang string, source string"


def plain_layout(rows, size=500):
    n = len(rows)
    first = lambda x: (x is not None, (x or "").encode() if isinstance(x, str) or x is None else x)
    value = lambda r: {"length": -1 if r[1] is None else len(r[1].encode()), "source": first(r[3]), "date": -1 if r[0] is None else zlib.crc32(str(r[0]).encode()) % 365, "lang": first(r[2])}
    values = [value(r) for r in rows]
    at = [{} for _ in rows]
    for d in layout.DIMS:
        smaller, seen = {}, 0
        for v, c in sorted(Counter(v[d] for v in values).items()):
            smaller[v] = seen
            seen += c
        for k, v in enumerate(values):
            at[k][d] = 16 * smaller[v[d]] // n
    z = [int("".join(f"{a[d]:04b}"[bit] for bit in range(4) for d in layout.DIMS), 2) for a in at]
    order = sorted(range(n), key=lambda k: (z[k], rows[k][0] is not None, rows[k][0] or 0))
    place = {k: p for p, k in enumerate(order)}
    files = defaultdict(list)
    for k, p in place.items():
        files[p // size].append(k)
    box = {f: {d: (min(at[k][d] for k in own), max(at[k][d] for k in own)) for d in layout.DIMS} for f, own in files.items()}
    out = []
    for k in range(n):
        query = {d: (at[k][d] - layout.REACH[d], at[k][d] + layout.REACH[d]) for d in layout.DIMS}
        touched = sum(all(b[d][0] <= query[d][1] and b[d][1] >= query[d][0] for d in layout.DIMS) for b in box.values())
        match = sum(any(all(query[d][0] <= at[j][d] <= query[d][1] for d in layout.DIMS) for j in own) for own in files.values())
        f = place[k] // size
        out.append((rows[k][0], z[k], place[k], f, touched, match, ",".join(f"{x},{y}" for x, y in (box[f][d] for d in ("source", "lang", "length", "date")))))
    return sorted(out, key=str)


def layout_case(n, seed):
    rnd = random.Random(seed)
    rows = [(k, "w" * rnd.randint(0, 300), rnd.choice(["en", "de", "é", None, ""]), rnd.choice(["hot", "hot", None, f"s{rnd.randint(0, 40)}", "z😀", "z￿"])) for k in range(n)]
    return rows + rows[:20] + [(None, None, None, None), (None, "x", "en", "hot"), (5, None, "en", "hot"), (-3, "ü" * 9, "en", "hot"), (7, "v" * 400_000, "en", "s1")]


@pytest.mark.parametrize("size", [500, 7])
def test_layout_matches_plain_python(spark, monkeypatch, size):
    monkeypatch.setattr(layout, "BOXES", 16)
    rows = layout_case(300, size)
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 AS z", "'x' AS file", "2 AS position", "3 AS c_lang")
    got = sorted(map(tuple, layout.layout_report(df, size).collect()), key=str)
    assert got == plain_layout(rows, size)


def test_layout_of_few_rows(spark):
    assert layout.layout_report(spark.createDataFrame([], ROW)).count() == 0
    one = [(None, None, None, None)]
    assert [tuple(r) for r in layout.layout_report(spark.createDataFrame(one, ROW)).collect()] == plain_layout(one)


def test_cells_round_trip():
    z = np.arange(layout.CELLS)
    at = layout.coordinates(z)
    assert all(set(np.unique(v)) == set(range(16)) for v in at.values())
    k = 0b1000_0100_0010_0001
    assert {d: int(v[k]) for d, v in at.items()} == {"length": 8, "source": 4, "date": 2, "lang": 1}


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["op11_decontamination", "op12_hard_negatives", "op13_layout"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = con.sql(queries.ORACLE_SQL[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect()) and want
