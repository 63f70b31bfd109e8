"""Canonical exact fingerprints, with DataFrame functions only.

A text's canonical form is its NFC form with case folded by Unicode's full folding (and NFC again), with runs of white space as one space and none at the ends. Its
fingerprint is two xxhash64 values with different seeds, 128 bits wide. Rows are grouped by these bits; inside a group that holds
more than one row the canonical bytes themselves are compared, by their least and greatest value, and texts that share the bits but
differ get different suffixes. So equal fingerprints mean equal canonical texts, without an assumption about the hash.

`edited` pairs each document with the next one in descending order of ids. The order is cut into ranges of about equal numbers of
ids; a window runs within each range, and the document at the border of two ranges is sent to both, so no task sees the whole order.

Null texts count as empty and null ids as smaller than all others. Rows of one id follow each other by their fingerprints; rows
equal in everything stay apart, one result row each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, stored

#: Fixed set: Unicode's White_Space characters, and U+0020 apart.
_SPACES = "\\u0009-\\u000d\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: 2 MB of bits: what the bitmap of rows in groups may take, however many rows there are.
MAP_WORDS = 1 << 18
MAX_RANGES = 1 << 16


def nfc(col: Column) -> Column:
    """Unicode normalisation form C, by the ICU library that Spark brings; the column mustn't be null."""
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(False))


def folded(col: Column) -> Column:
    """Unicode's full case folding, by ICU as well: it also makes ss of sharp s, and one letter of both forms of small sigma."""
    return F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), col, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    plain = nfc(folded(nfc(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(plain, f"[ {_SPACES}]{{2,}}|[{_SPACES}]", " "))


def wide_hash(canon: Column, bits: int = 128) -> list[Column]:
    """Two xxhash64 values; fewer bits only to try what happens when they collide."""
    h1, h2 = F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)
    return [h1, h2] if bits == 128 else [F.pmod(h1, F.lit(1 << bits)), F.lit(0).cast("bigint")]


def _shown(h1: str, h2: str, suffix: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"), suffix))


def _longs(values: list[int]) -> Column:
    """A constant array of bigints, as one literal in the plan however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


class _Ranges:
    """Borders that cut a bigint key's values into ranges of about equal numbers of rows; each border is a value that occurs."""

    def __init__(self, keys: DataFrame, n: int):
        n = max(1, min(n, MAX_RANGES))
        at = [(k + 1) / n for k in range(n)]
        row = keys.agg(F.percentile_approx("key", at, max(10_000, 20 * n)).alias("q"), F.max("key").alias("top")).first()
        self.borders = sorted({*(row["q"] or []), *([row["top"]] if row["top"] is not None else [])})

    def of(self, key: Column) -> Column:
        """The number of borders below the key, in two steps: whole chunks of 256 first."""
        chunk = F.size(F.filter(_longs(self.borders[255:-1:256]), lambda b: b < key))
        return chunk * 256 + F.size(F.filter(F.slice(_longs(self.borders), chunk * 256 + 1, 256), lambda b: b < key))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with `range` and `border`; a row whose key is a border also goes, as a border, to the range above, the greatest to the lowest range."""
        n, at = len(self.borders), self.of(F.col("key"))
        is_border = F.get(_longs(self.borders), F.col("range")) == F.col("key")
        rows = rows.withColumn("range", at.cast("int"))
        both = F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("b")), F.struct(F.pmod(F.col("range") + 1, F.lit(max(1, n))).alias("r"), F.lit(True).alias("b")))
        one = F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("b")))
        kept = [c for c in rows.columns if c != "range"]
        return rows.select(*kept, F.explode(F.when(is_border, both).otherwise(one)).alias("to")).select(*kept, F.col("to.r").alias("range"), F.col("to.b").alias("border"))


def _paired(docs: DataFrame, ranges: _Ranges, bits: int) -> DataFrame:
    """docs (key, doc_id, text) with h1, h2 and the next document's key, text, h1, h2."""
    canon = canonical(F.col("text"))
    h1, h2 = wide_hash(F.col("canon"), bits)
    rows = docs.withColumn("canon", canon).withColumns({"h1": h1, "h2": h2}).drop("canon")
    order = Window.partitionBy("range").orderBy("border", F.col("key").desc(), "h1", "h2")
    following = {f"next_{c}": F.lead(c).over(order) for c in ("key", "text", "h1", "h2")}
    return ranges.dealt(rows).withColumns(following).where(~F.col("border")).drop("range", "border")


def _edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the next document's first."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - k), F.substr(following, F.lit(1), k))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is among keys' (column k), and few others: by a bitmap of at most MAP_WORDS rows, which is broadcast."""
    place = F.pmod(F.xxhash64("k"), F.lit(MAP_WORDS * 64))
    bit = F.call_function("shiftleft", F.expr("1L"), F.pmod(place, F.lit(64)).cast("int"))
    words = keys.select(F.floor(place / 64).cast("int").alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    at = F.pmod(F.xxhash64("key"), F.lit(MAP_WORDS * 64))
    held = docs.withColumn("w", F.floor(at / 64).cast("int")).join(F.broadcast(words), "w")
    return held.where(F.getbit("bits", F.pmod(at, F.lit(64)).cast("int")) == 1).select(docs.columns)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = _Ranges(docs.select("key"), partitions(spark))
    pairs = _paired(docs, ranges, bits).withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    canon, after = canonical(F.col("text")), canonical(F.col("edited"))
    e1, e2 = wide_hash(F.col("after"), bits)
    same = lambda a, b: (a == b).cast("double")
    rows = (
        pairs.withColumn("after", after)
        .withColumns({"e1": e1, "e2": e2})
        .select(
            "doc_id", "key", "next_key", "h1", "h2", "e1", "e2",
            F.length("text").cast("bigint").alias("n_chars"),
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            # equal bits are followed by a comparison of the bytes
            F.when((F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), same(canon, F.col("after"))).otherwise(0.0).alias("near_edited"),
            F.when((F.col("h1") == F.col("next_h1")) & (F.col("h2") == F.col("next_h2")), same(canon, canonical(F.col("next_text")))).otherwise(0.0).alias("near_next"),
        )
    )
    rows = stored(rows)
    split = _collisions(docs, rows, ranges, bits)
    if split is None:
        return rows.select("doc_id", "n_chars", "edited_sha256", _shown("h1", "h2", F.lit("")).alias("fingerprint"), _shown("e1", "e2", F.lit("")).alias("edited_fingerprint"), "near_edited", "near_next")
    # texts that share their bits: told apart by their rank in byte order, known by id and digest of the edited text
    own = split.where(~F.col("is_edited")).select(F.col("key"), F.col("h1"), F.col("h2"), F.col("edited_sha256"), F.col("suffix").alias("s1"))
    other = split.where("is_edited").select(F.col("key"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("edited_sha256"), F.col("suffix").alias("s2"))
    rows = rows.join(own, ["key", "h1", "h2", "edited_sha256"], "left").join(other, ["key", "e1", "e2", "edited_sha256"], "left")
    tail = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("doc_id", "n_chars", "edited_sha256", _shown("h1", "h2", tail("s1")).alias("fingerprint"), _shown("e1", "e2", tail("s2")).alias("edited_fingerprint"), "near_edited", "near_next")


def _collisions(docs: DataFrame, rows: DataFrame, ranges: _Ranges, bits: int) -> DataFrame | None:
    """Compares the canonical bytes inside each group of equal bits; None if all groups are of one text, else a suffix for each text of a mixed group."""
    sides = F.explode(F.array(F.struct(F.col("h1").alias("h1"), F.col("h2").alias("h2")), F.struct(F.col("e1").alias("h1"), F.col("e2").alias("h2")))).alias("x")
    shared = stored(rows.select(sides).groupBy("x.h1", "x.h2").count().where("count > 1").drop("count"))
    hit = lambda a, b: rows.join(shared, (rows[a] == shared["h1"]) & (rows[b] == shared["h2"]), "left_semi")
    in_group = hit("h1", "h2").select("key", "next_key").unionByName(hit("e1", "e2").select("key", "next_key"))
    # all rows that are in a group, and those that follow them: neighbours stay neighbours
    near = _only(docs, in_group.select(F.explode(F.array("key", "next_key")).alias("k")))
    pairs = _paired(near, ranges, bits).withColumn("edited", _edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    digest = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    both = pairs.select("key", digest, F.explode(F.array(*[F.struct(F.lit(e).alias("is_edited"), canonical(F.col(c)).alias("canon")) for e, c in ((False, "text"), (True, "edited"))])).alias("x")).select("key", "edited_sha256", "x.*")
    h1, h2 = wide_hash(F.col("canon"), bits)
    members = both.withColumns({"h1": h1, "h2": h2})
    mixed = stored(members.groupBy("h1", "h2").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("h1", "h2"))
    if mixed.isEmpty():
        return None
    found = members.join(mixed, ["h1", "h2"])
    texts = found.select("h1", "h2", "canon").distinct()
    ranked = texts.withColumn("suffix", F.format_string("-%d", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon"))))
    return found.join(ranked, ["h1", "h2", "canon"]).select("key", "edited_sha256", "is_edited", "h1", "h2", "suffix").distinct()


