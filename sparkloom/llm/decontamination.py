"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item has windows of WINDOW consecutive words; an item of fewer words is one window. A window is a set of shingles of SHINGLE
words (a shorter one is a shingle of its own length). It occurs in a document only if all its shingles do, so of its shingles, ordered
by rarity, a prefix of one is necessary: the one that the documents hold least often.

1. Every document lists its shingles as hashes with their places, and itself once. Those that items have too are kept: one pass over the
   texts, whose other rows never leave their task. The counts of what is kept order the shingles by rarity.
2. The rarest shingle of each window is joined with the places of its kind. A place and the shingle's offset in the window give where
   the window must begin; it must begin within the document and end within its words. A window with a shingle that no document holds
   is not joined at all.
3. Documents with such candidates are read again, the words at each place are cut out at the window's size and compared with the windows
   themselves, so no hash decides.

The tables of the benchmark and of candidates are broadcast only when a count has shown that they have at most MAX_SHARED entries; larger
ones are joined by a shuffle. Common passages have as many candidates as occurrences, never pairs of documents. A document is known by its
id and a hash of its text, so that rows which share either stay apart, and copies add up before the shuffle.

Null texts and texts without words have no words and no hits. A null document id is an id like others. Items without words have no
window; rows of one item id are one item, and a null item id is the item named by the empty string. Repeated documents get a row each.
Empty tables: no documents give no rows, no items give no hits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

WINDOW, SHINGLE = 10, 5
#: Entries of a table that may be broadcast, at most (some 100 MB on each executor).
MAX_SHARED = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed set: what separates words.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The first entry of every document's list, which keeps the document itself.
_SELF = "self"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once: inside a lambda an expression would be worked out again for each item."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def words(text: Column) -> Column:
    """The words in order, A-Z lower-cased; none for null."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _GAP), "")


def _shingles(found: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    runs = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
    return _let(F.transform(found, lambda w: F.xxhash64(w)), runs)


def _shared(df: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(df) if entries <= MAX_SHARED else df


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, size, items): each distinct window as its words joined by spaces, its number of words and the ordered ids of its items."""
    held = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    sized = held.select("item", "w", F.least(F.lit(window), F.size("w")).alias("size"))
    each = sized.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    cut = each.select("item", "size", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("win"))
    return cut.groupBy("win", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _listed(docs: DataFrame, kinds: list[int]) -> DataFrame:
    """(doc, mark, n_words, place, shingle): each document's shingles at places from 1 on, and itself at place 0."""
    held = docs.select("doc", "mark", words(F.col("text")).alias("w"))
    first = F.array(F.xxhash64(F.lit(_SELF)))
    parts = [held.select("doc", "mark", F.size("w").alias("n_words"), F.posexplode(F.concat(first, _shingles(F.col("w"), k))).alias("place", "shingle")) for k in kinds]
    out = parts[0]
    for more in parts[1:]:  # items of fewer words than SHINGLE
        out = out.unionByName(more.where("place > 0"))
    return out


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All documents as (doc, mark, n_words), and every occurrence of a window as (doc, mark, start, size, items), start from 0."""
    named = _named(docs, doc_id, text)
    wins = stored(windows(items, item_id, item_text, window))
    kinds = sorted({min(r[0], SHINGLE) for r in wins.select("size").distinct().collect()} | {SHINGLE}, reverse=True)  # at most SHINGLE of them
    split = F.split("win", " ")
    each = wins.select("win", "size", F.posexplode(F.coalesce(*[F.when(F.least("size", F.lit(SHINGLE)) == k, _shingles(split, k)) for k in kinds])).alias("offset", "shingle"))
    known = stored(each.select("shingle").union(docs.sparkSession.range(1).select(F.xxhash64(F.lit(_SELF)))).distinct())
    held = stored(_listed(named, kinds).join(_shared(known, known.count()), "shingle"))

    # the rarest shingle of each window
    often = held.where("place > 0").groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, "shingle", "left").groupBy("win", "size").agg(F.min(F.struct("often", "shingle", "offset")).alias("rarest"), F.count_if(F.col("often").isNull()).alias("absent"))
    prefix = stored(ranked.where("absent = 0").select("rarest.shingle", "rarest.offset", "size").distinct())

    # length and place bounds
    start = F.col("place") - 1 - F.col("offset")
    met = held.where("place > 0").join(_shared(prefix, prefix.count()), "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    spots = stored(met.groupBy("doc", "mark").agg(F.collect_set(F.struct(start.alias("start"), "size")).alias("spots")))

    # the words themselves
    n_spots, n_wins = (df.agg(F.sum(F.size(c))).first()[0] or 0 for df, c in ((spots, "spots"), (wins, "items")))
    again = named.alias("a").join(_shared(spots, n_spots).alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.mark") == F.col("b.mark"))).select("a.doc", "a.mark", "text", "spots")
    cut = lambda w: F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.concat_ws(" ", F.slice(w, s["start"] + 1, s["size"])).alias("win")))
    texts = again.select("doc", "mark", F.explode(_let(words(F.col("text")), cut)).alias("x")).select("doc", "mark", "x.*")
    found = texts.join(_shared(wins, n_wins), ["win", "size"]).select("doc", "mark", "start", "size", "items")
    return held.where("place = 0").select("doc", "mark", "n_words"), found


def contamination(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """A row per document: doc, mark, n_words, n_hit (words inside any occurrence) and the ordered ids of the items that occur."""
    every, found = occurrences(docs, items, **names)
    ends = lambda s: s["start"] + s["size"]
    reach = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), ends(s) - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], ends(s)).alias("end")),
        lambda acc: acc["n"],
    )
    hits = found.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("items").alias("sets"))
    told = hits.select("doc", "mark", reach.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    both = every.alias("a").join(told.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return both.select("a.doc", "a.mark", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most: float = 0.0, **names: str) -> DataFrame:
    """docs without those of which more than the share `most` of the words lies inside a benchmark window; rows as they are."""
    bad = contamination(docs, items, doc_id=doc_id, text=text, **names).where(F.col("n_hit") > F.lit(most) * F.col("n_words")).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs[text]) == bad["_mark"]), "left_anti")


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, items).select(
        F.col("doc").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same by windows of all documents, for small tables.
CONTAMINATION_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), i AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), each AS (
    SELECT item, w, least(len(w), 10) AS size, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS start FROM i WHERE len(w) > 0
), wins AS (
    SELECT DISTINCT item, size, array_to_string(w[start + 1:start + size], ' ') AS win FROM each
), spots AS (
    SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS start FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size
), found AS (
    SELECT r, start, s.size, item FROM (SELECT r, start, size, array_to_string(w[start + 1:start + size], ' ') AS win FROM spots) s JOIN wins USING (size, win)
), hit AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start, start + size)) AS place FROM found) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
