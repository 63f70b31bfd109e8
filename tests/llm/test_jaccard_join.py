import random
import re
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    post = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        near = set()
        for w in s:
            near.update(post[w])
            post[w].append(k)
        for o in near:
            both = len(s & sets[o][1])
            if 100 * both >= 75 * (len(s) + len(sets[o][1]) - both):
                root[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, n=220):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(25)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.55:
            words = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 4, 30, 90]))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        text = rnd.choice([" ", "  ", "\n"]).join(words)
        rows.append((i * 3 + 1, text.upper() if rnd.random() < 0.2 else text))
    return rows + [(0, None), (2, ""), (5, " \n"), (8, "a"), (9, "A"), (11, "é É")]


@pytest.mark.parametrize("seed,dear", [(1, 32), (2, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, dear):
    monkeypatch.setattr(J, "DEAR", dear)
    rows = corpus(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def near_group(n, seed=5):
    """One group of near copies of a text, most of them linked, some with too many changes."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4, 5, 6])):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words[: rnd.choice([120, 120, 120, 118, 110])])))
    return rows


def test_one_large_group_of_near_copies(spark):
    rows = near_group(400)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_components_of_links_that_settle_at_once_take_two_tables(spark, monkeypatch):
    """Each table costs a stage of all partitions, however few the rows."""
    from sparkloom.llm import components as C

    tables, plain = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: tables.append(1) or plain(df))
    got = C.components(spark.createDataFrame([(1, 5), (1, 7), (7, 1), (3, 3)], "x long, y long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (5, 1), (7, 1)]
    assert len(tables) <= 2


def test_links_are_all_links_between_different_sets(spark):
    rows = corpus(4, 120) + [(1000 + i, t) for i, t in near_group(40)]
    links, members = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    node = {i: n for i, _, n in members.collect()}
    sets = {node[i]: shingles(t) for i, t in rows if node[i] is not None}
    pairs = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 100


def test_sets_equal_those_of_strings():
    texts = [t for _, t in corpus(3)] + ["x " * 400_000, "long" * 300_000 + " a b c d e f"]
    for t, s in zip(texts, J.token_sets(texts)):
        assert len(s) == len(shingles(t))
    assert np.array_equal(J.token_sets([texts[5]])[0], J.token_sets(texts)[5])


def test_lists_never_lose_a_link():
    rnd, links = np.random.default_rng(0), 0
    for trial in range(300):
        base = rnd.choice(400, rnd.integers(1, 60), replace=False)
        sets = [np.array(sorted({int(x) for x in base if rnd.random() < 0.95} | {int(x) for x in rnd.integers(0, 400, rnd.integers(0, 4))}), np.uint64) for _ in range(4)]
        dear = np.unique(rnd.integers(0, 400, rnd.choice([0, 100, 900]))).astype(np.uint64)
        rows = J.postings(sets, np.arange(4), np.array([0, 1, 2, 0]), J.Dear(dear, rnd.integers(16, 5000, len(dear)).astype(np.int32)))
        total = defaultdict(int)
        for part in J.counted(rows):
            for x, y, kind, need, shared in part.tolist():
                total[x, y, kind, need] += shared
        found = {(x, y) for (x, y, _, need), n in total.items() if n >= need}
        for a in range(4):
            for b in range(a + 1, 4):
                if len(sets[a]) and len(sets[b]) and (a, b) != (0, 3) and J.link(sets[a], sets[b]):
                    links += 1
                    assert (a, b) in found
        assert (0, 3) not in found
    assert links > 300


def test_long_lists_give_what_short_ones_do(monkeypatch):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.random(50) < 0.97], rnd.integers(0, 1 << 60, 2).astype(np.uint64)])) for _ in range(150)]
    rows = J.postings(sets, np.arange(150), np.where(np.arange(150) % 3, 0, np.arange(150)), J.Dear(np.sort(base), np.full(50, 150, np.int32)))
    found = lambda rows: sorted((x, y) for p in J.counted(rows) for x, y, _, need, n in p.tolist() if n >= need)
    labels = np.where(np.arange(150) % 3, 0, np.arange(150))
    got = set(found(rows))
    assert all((a, b) in got for a in range(150) for b in range(a + 1, 150) if labels[a] != labels[b] and J.link(sets[a], sets[b]))
    monkeypatch.setattr(J, "HELD", 500)
    parts = [p for p in J.counted(rows)]
    assert sum(n for p in parts for n in p["shared"]) == sum(len(x) for x, *_ in J.list_pairs(J._ordered(rows)))
    pairs = [tuple(r)[:3] for p in parts for r in p.tolist()]
    assert len(parts) > 1 and len(pairs) == len(set(pairs))  # no pair leaves a part twice


def test_dear_lists_of_a_pair_lie_in_one_part(spark, monkeypatch):
    """However many other tokens there are."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(90)]
    rows = [(i, " ".join(base[: rnd.choice([70, 80, 90])] + [f"u{i}"])) for i in range(40)]
    rows += [(100 + i, " ".join(f"r{rnd.randrange(10**6)}" for _ in range(1500))) for i in range(40)]
    monkeypatch.setattr(J, "DEAR_PART", 6000)
    seen, plain = [], J._candidates
    monkeypatch.setattr(J, "_candidates", lambda held, *more: seen.extend(held.where("p < 0").collect()) or plain(held, *more))
    links, _ = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links.count() > 300
    parts = defaultdict(list)
    for p, blob in seen:
        i, t, *rest = J._unpacked(blob, "<i8", "<u8", *(J.POSTING[c].str for c in J.POSTING.names[2:]))
        r = np.empty(len(t), J.POSTING)
        for name, c in zip(J.POSTING.names, (t, i, *rest)):
            r[name] = c
        parts[p].append(r)
    pairs = [tuple(r)[:2] for held in parts.values() for part in J.counted(np.concatenate(held)) for r in part.tolist()]
    assert len(pairs) == len(set(pairs)) > 300


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "A b c d e f"), (None, None), (7, "z z z z z z z")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 0, None), (7, 1, 7)]))
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_batch_of_texts_takes_little_memory_beside_its_postings():
    rnd = np.random.default_rng(2)
    texts = [" ".join(map(str, rnd.integers(0, 10**6, 300).tolist())) for _ in range(4000)]  # 8 MB, as bounded_batches has it
    nodes = [J.node_of(s) for s in J.token_sets(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.arange(4000)), pa.array(nodes, pa.binary()), pa.array(texts)], names=["id", "root", "node", "text"])
    work = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    work.select = lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run)
    run = J._postings(work, J.Dear(np.zeros(0, np.uint64), np.zeros(0, np.int32)), 50)
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(x.as_py()) for b in out for x in b.column("blob")) > 8_000_000
    assert peak < 64 << 20


def test_no_join_sorts_the_texts(spark, monkeypatch):
    seen, plain = [], J._postings
    monkeypatch.setattr(J, "_postings", lambda work, *more: seen.append(work) or plain(work, *more))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "q r s t u v w"), (3, "a b c d e g")]
        seen.append(J.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
        assert sorted(map(tuple, seen[-1].collect())) == [(1, "a b c d e f"), (3, "a b c d e g"), (3, "q r s t u v w")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and all("ShuffledHashJoin" in plan for plan in plans)
