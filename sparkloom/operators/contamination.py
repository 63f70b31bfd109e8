"""Overlap of splits and corpora, and matches with benchmarks. Keys are made distinct before they are joined."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, shingles
from ..session import materialised


def overlap(left: DataFrame, right: DataFrame, key: Column | str) -> DataFrame:
    """One row: the number of distinct keys that both sides have."""
    k = lambda d: d.select((F.col(key) if isinstance(key, str) else key).alias("key")).distinct()
    return k(left).join(k(right), "key", "left_semi").agg(F.count("*").alias("shared"))


def overlap_matrix(df: DataFrame, split: str, keys: dict[str, Column]) -> DataFrame:
    """(left_split, right_split, kind, shared) for every pair of splits and kind of key, in one pass. Digests of the keys are shuffled, not the keys."""
    each = df.select(F.col(split).alias("s"), F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.unhex(digest(c.cast("string"))).alias("key")) for n, c in keys.items()])).alias("x")).select("s", "x.kind", "x.key").where("key IS NOT NULL")
    splits = each.groupBy("kind", "key").agg(F.array_sort(F.collect_set("s")).alias("splits")).where("size(splits) > 1")  # as many as there are splits
    pairs = splits.select("kind", F.explode("splits").alias("left_split"), "splits").select("kind", "left_split", F.explode("splits").alias("right_split")).where("left_split < right_split")
    return pairs.groupBy("left_split", "right_split", "kind").agg(F.count("*").alias("shared"))


def matches(df: DataFrame, benchmark: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df's rows that match the benchmark, one for each kind of key (of df, of benchmark)."""
    parts = []
    for kind, (own, other) in keys.items():
        side = benchmark.select(other.alias("_key")).where("_key IS NOT NULL").distinct()
        parts.append(df.withColumn("_key", own).join(side, "_key", "left_semi").drop("_key").withColumn("kind", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence(found: DataFrame, order: str, per_kind: int = 20) -> DataFrame:
    """The first matches of each kind, as examples for a report."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(order))).where(F.col("rank") <= per_kind)


#: Of an item's text so many letters are searched for at once; the rest is compared where they stand.
PROBE = 32
#: Items of an automaton, and characters of their texts, at most (about 150 MB in each worker). More items take more passes over the texts.
MOST_ITEMS, MOST_CHARS = 50_000, 16 << 20
#: Shingles of a benchmark that are broadcast, at most (about 40 MB).
MOST_SHINGLES = 1 << 20
#: The automaton that this worker built last, by its name.
_built: dict[str, tuple] = {}


def _automaton(name: str, needles: list[str]) -> tuple:
    """The automaton of the needles' probes and, for each probe, the places of its needles; built once a worker."""
    if name not in _built:
        import ahocorasick

        by_probe: dict[str, list[int]] = {}
        for k, n in enumerate(needles):
            by_probe.setdefault(n[:PROBE], []).append(k)
        found = ahocorasick.Automaton()
        for probe, own in by_probe.items():
            found.add_word(probe, (len(probe), own))
        found.make_automaton()
        _built.clear()
        _built[name] = (found, needles)
    return _built[name]


def containments(df: DataFrame, benchmark: DataFrame, id_: str, item: str, text: str = "text", most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, item) of all rows whose text holds an item's text, of whatever length; empty and null items are in no text.

    The items' texts become an automaton that finds all of them in one pass over a text, in Arrow batches: no text is shuffled. An
    automaton has bounded numbers of items and characters, dealt by a digest; a larger benchmark takes a pass over the texts for each.
    """
    needles = materialised(benchmark.select(F.col(text).alias("needle")).where("needle <> ''").distinct())
    n, chars = needles.agg(F.count("*"), F.sum(F.length("needle"))).first()
    kind = df.schema[id_].dataType.simpleString()
    groups = max(1, -(-n // most_items), -(-(chars or 0) // most_chars))

    def searched(own: list[str]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, held = _automaton(name, own)
            for b in batches:
                rows, found = [], []
                for k, hay in enumerate(b.column(1).to_pylist()):
                    hit = set()
                    for end, (size, places) in automaton.iter(hay) if hay else ():
                        hit.update(p for p in places if p not in hit and hay.startswith(held[p], end + 1 - size))
                    rows += [k] * len(hit)
                    found += [held[p] for p in sorted(hit)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "needle"])

        return df.select(F.col(id_).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, needle string")

    if not n:
        return df.sparkSession.createDataFrame([], f"id {kind}, item {benchmark.schema[item].dataType.simpleString()}")
    dealt = ([r[0] for r in needles.where(F.pmod(F.xxhash64("needle"), F.lit(groups)) == g).collect()] for g in range(groups))
    parts = [searched(own) for own in dealt if own]
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    named = benchmark.select(F.col(item).alias("item"), F.col(text).alias("needle"))
    return hits.join(named, "needle").select("id", "item").distinct()


def shared_shingles(df: DataFrame, benchmark: DataFrame, id_: str, item: str, text: str = "text", k: int = 3, least: int = 1) -> DataFrame:
    """(id, item, shared): how many distinct shingles of k words a row and an item share, where at least so many. Hashes and ids are shuffled, not texts."""
    each = lambda d, own, name: d.select(F.col(own).alias(name), F.explode(F.transform(shingles(F.col(text), k), lambda s: F.xxhash64(s))).alias("s"))
    items = materialised(each(benchmark, item, "item").distinct())
    # a benchmark's hashes go to the rows, so that only what both have is shuffled
    met = each(df, id_, "id").join(F.broadcast(items) if items.count() <= MOST_SHINGLES else items, "s")
    return met.distinct().groupBy("id", "item").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def manifest_diff(expected: DataFrame, actual: DataFrame, name: str = "name", sha: str = "sha256") -> DataFrame:
    """name and status: same, changed, missing or unexpected."""
    e, a = expected.select(F.col(name).alias("n"), F.col(sha).alias("e")), actual.select(F.col(name).alias("m"), F.col(sha).alias("a"))
    status = F.when(F.col("n").isNull(), "unexpected").when(F.col("m").isNull(), "missing").when(F.col("e").eqNullSafe(F.col("a")), "same").otherwise("changed")
    return e.join(a, F.col("n") == F.col("m"), "full").select(F.coalesce("n", "m").alias("name"), status.alias("status"))
