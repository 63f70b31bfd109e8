"""Multidimensional clustered layout: rows in Z order, cut into files, and how many files a query around each row must open.

Every row has four values (source, lang, length of the text, a date); each becomes one of 16 coordinates by its rank among all rows. The
coordinates' bits interleave to a cell number z, rows are placed by z and id, and FILE rows in order make a file.

* Ranks. The values of each dimension are counted, range-partitioned and summed up within the parts; a part's start is the sum of the parts
  before it. All that leaves the tasks is a number for each part (PARTS at most) and 15 cuts for each dimension, so a coordinate is a
  chain of comparisons.
* Places. Rows are range-partitioned by z, id and a number of their own, so that no hot cell or id is one task's, and numbered within the
  parts, by a window over each part that sorts and spills.
* Files to touch. Files of identical bounds are one box with a weight. The occupied cells are a bitmap of 16^4 bits (8 KB, whatever the size
  of the input). Groups of at most about BOXES boxes compare theirs with the query boxes of the occupied cells, block by block in numpy.
* Files that match. The distinct pairs of cell and file, which are about as many as there are files and cells, go to the cells whose
  queries reach them; distinct pairs of query cell and file are counted.

Cells' figures reach the rows through the pairs of cell and file, of which none has more than FILE rows: no join of rows has a hot key.

A null source or lang is smaller than all others, a null text has length -1, a null id is smaller than all others and has the date -1.
Rows of one z and id, repeated rows among them, are placed in any order, which no result can tell but the order itself. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, stored

STEPS, BITS, FILE = 16, 4, 500
#: Dimensions in the order in which bits interleave.
DIMS = ("length", "source", "date", "lang")
#: How far from a row's own coordinate its query reaches.
REACH = {"length": 2, "source": 0, "date": 2, "lang": 0}
#: Parts of a range partition, at most, and the rows that one should have.
PARTS, PART_ROWS = 1024, 50_000
#: Boxes of a group, and pairs of box and cell that numpy compares at once.
BOXES, HELD = 2048, 1 << 21
CELLS = STEPS ** len(DIMS)


def values(docs: DataFrame) -> DataFrame:
    """doc_id and the four values; numbers as they are, with null for smallest."""
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 365
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).cast("bigint").alias("length"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(crc, F.lit(-1)).cast("bigint").alias("date"),
        F.col("lang").cast("string").alias("lang"),
    )


def _parts(df: DataFrame, n: int) -> int:
    return int(min(PARTS, max(partitions(df.sparkSession), -(-n // PART_ROWS))))


def _starts(sums: dict[int, int]) -> dict[int, int]:
    """For each part what the parts before it hold."""
    out, total = {}, 0
    for k in sorted(sums):
        out[k] = total
        total += sums[k]
    return out


def _of(table: dict[int, int], key: Column) -> Column:
    """The table's entry; parts are consecutive numbers from 0 on, some without rows."""
    return F.get(F.array(*[F.lit(table.get(k, 0)).cast("bigint") for k in range(max(table, default=0) + 1)]), key)


def _numbered(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df in ranges of `order`, with _part; stored."""
    return stored(df.repartitionByRange(_parts(df, n), *order).withColumn("_part", F.spark_partition_id()))


def cuts(rows: DataFrame, n: int) -> dict[str, list]:
    """For each dimension the least value of each coordinate that occurs, with the coordinate, by falling coordinate."""
    # numbers as text of one width, so that all dimensions are counted in one pass
    shown = {d: F.lpad((F.col(d) + 1).cast("string"), 20, "0") if d in ("length", "date") else F.col(d) for d in DIMS}
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), shown[d].alias("value")) for k, d in enumerate(DIMS)])).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("c"))
    held = _numbered(each, ["dim", "value"], n)
    starts = _starts({r[0]: r[1] for r in held.groupBy("_part").agg(F.sum("c")).collect()})
    before = F.sum("c").over(Window.partitionBy("_part").orderBy("dim", F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1))
    smaller = _of(starts, F.col("_part")) + F.coalesce(before, F.lit(0)) - F.col("dim") * n  # each dimension holds all n rows
    step = F.floor(smaller * STEPS / F.lit(n)) if n < 1 << 48 else F.floor(smaller.cast("decimal(38,0)") * STEPS / n)
    least = held.select("dim", "value", step.cast("int").alias("step")).groupBy("dim", "step").agg(F.min("value").alias("value")).where("step > 0")
    out: dict[str, list] = {d: [] for d in DIMS}
    for r in least.collect():  # at most 15 for each dimension
        name = DIMS[r["dim"]]
        out[name].append((r["step"], int(r["value"]) - 1 if name in ("length", "date") else r["value"]))
    return {d: sorted(v, reverse=True) for d, v in out.items()}


def coordinate(dim: str, steps: list) -> Column:
    """The coordinate of the column `dim`; nulls are smallest."""
    out = F.lit(0)
    for step, least in reversed(steps):
        out = F.when(F.col(dim) >= F.lit(least), step).otherwise(out)
    return out.cast("int")


def cell(at: dict[str, Column]) -> Column:
    """The interleaved bits, highest first."""
    out, top = F.lit(0), BITS * len(DIMS) - 1
    for k, d in enumerate(DIMS):
        for bit in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(at[d], bit).bitwiseAND(F.lit(1)), top - k - (BITS - 1 - bit) * len(DIMS)))
    return out


def coordinates(z: np.ndarray) -> dict[str, np.ndarray]:
    """Of cells: what cell() was made from."""
    out, top = {}, BITS * len(DIMS) - 1
    for k, d in enumerate(DIMS):
        out[d] = sum(((z >> (top - k - (BITS - 1 - bit) * len(DIMS))) & 1) << bit for bit in range(BITS))
    return out


def placed(docs: DataFrame, file: int = FILE) -> DataFrame:
    """doc_id, the coordinates c_<dim>, z, position and file of every row; stored."""
    rows = stored(values(docs))
    n = rows.count()
    steps = cuts(rows, n) if n else {d: [] for d in DIMS}
    at = rows.select("doc_id", *[coordinate(d, steps[d]).alias(f"c_{d}") for d in DIMS], F.monotonically_increasing_id().alias("_row"))
    held = _numbered(at.withColumn("z", cell({d: F.col(f"c_{d}") for d in DIMS})), ["z", "doc_id", "_row"], n)
    starts = _starts({r[0]: r[1] for r in held.groupBy("_part").count().collect()})
    place = F.row_number().over(Window.partitionBy("_part").orderBy("z", F.asc_nulls_first("doc_id"), "_row")) - 1 + _of(starts, F.col("_part"))
    return stored(held.select("doc_id", *[f"c_{d}" for d in DIMS], "z", place.cast("bigint").alias("position")).withColumn("file", F.floor(F.col("position") / file).cast("bigint")))


def bounds(rows: DataFrame) -> DataFrame:
    """file and the least and greatest coordinate of each dimension in it, lo_<dim> and hi_<dim>."""
    return rows.groupBy("file").agg(*[f(f"c_{d}").alias(f"{s}_{d}") for d in DIMS for s, f in (("lo", F.min), ("hi", F.max))])


def occupied(rows: DataFrame) -> np.ndarray:
    """The cells that rows have, in order: a bitmap of CELLS bits is all that leaves the tasks."""
    found = rows.groupBy(F.bitmap_bucket_number(F.col("z") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("z") + 1)).alias("bits")).collect()
    bits = np.zeros(CELLS, bool)
    for r in found:
        own = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * len(own)
        bits[at : at + len(own)] = own[: CELLS - at]
    return np.flatnonzero(bits)


def met(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each cell the weights, added up, of the boxes that its query meets; lo and hi have a column for each dimension."""
    out = np.zeros(len(cells), np.int64)
    if not len(lo) or not len(cells):
        return out
    at = coordinates(cells)
    step = max(1, HELD // len(cells))
    for k in range(0, len(lo), step):
        hit = np.ones((len(lo[k : k + step]), len(cells)), bool)
        for j, d in enumerate(DIMS):
            hit &= (lo[k : k + step, j, None] <= at[d] + REACH[d]) & (hi[k : k + step, j, None] >= at[d] - REACH[d])
        out += weight[k : k + step] @ hit
    return out


def touched(files: DataFrame, cells: np.ndarray) -> DataFrame:
    """z and files_touched for the given cells: files whose bounds meet the cell's query."""
    names = [f"{s}_{d}" for d in DIMS for s in ("lo", "hi")]
    boxes = stored(files.groupBy(*names).agg(F.count("*").alias("weight")))
    groups = max(1, -(-boxes.count() // BOXES))

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells), np.int64)
        for b in batches:
            lo, hi = (np.stack([b.column(f"{s}_{d}").to_numpy() for d in DIMS], axis=1) for s in ("lo", "hi"))
            total += met(lo, hi, b.column("weight").to_numpy(), cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells[some], pa.int32()), pa.array(total[some], pa.int64())], names=["z", "n"])

    each = boxes.groupBy(F.pmod(F.xxhash64(*names), F.lit(groups)).alias("g")).applyInArrow(compare, "z int, n bigint")
    return each.groupBy("z").agg(F.sum("n").alias("files_touched"))


def matching(pairs: DataFrame) -> DataFrame:
    """z and files_matching for the cells of pairs (z, file, c_<dim>): files that hold a row inside the cell's query."""
    around = lambda d: F.explode(F.sequence(F.greatest(F.col(f"c_{d}") - REACH[d], F.lit(0)), F.least(F.col(f"c_{d}") + REACH[d], F.lit(STEPS - 1))))
    near = pairs.select("file", *[f"c_{d}" for d in DIMS])
    for d in DIMS:
        if REACH[d]:
            near = near.withColumn(f"c_{d}", around(d))
    cells = near.select("file", cell({d: F.col(f"c_{d}") for d in DIMS}).alias("z"))
    return cells.distinct().groupBy("z").agg(F.count("*").alias("files_matching"))


def layout_report(docs: DataFrame, file: int = FILE) -> DataFrame:
    """One row per row of docs: doc_id, z, position, file, files_touched, files_matching, file_bounds."""
    rows = placed(docs, file)
    pairs = stored(rows.groupBy("z", "file").agg(*[F.first(f"c_{d}").alias(f"c_{d}") for d in DIMS]))
    files = stored(bounds(pairs))
    shown = F.concat_ws(",", *[F.col(f"{s}_{d}").cast("string") for d in ("source", "lang", "length", "date") for s in ("lo", "hi")])
    told = pairs.select("z", "file").join(touched(files, occupied(pairs)), "z").join(matching(pairs), "z").join(files.select("file", shown.alias("file_bounds")), "file")
    return rows.select("doc_id", F.col("z").cast("bigint").alias("z"), "position", "file").join(told.withColumn("z", F.col("z").cast("bigint")), ["z", "file"]).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


#: The same by ranks over whole tables, for small ones. The table of the checksum is made from its polynomial.
LAYOUT_SQL = """
WITH tab AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), v AS (
    SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(octet_length(encode(text)), -1) AS length,
        CASE WHEN doc_id IS NULL THEN -1 ELSE xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 365 END AS date
    FROM documents, tab
), c AS (
    SELECT r, doc_id,
        16 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS s,
        16 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS g,
        16 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS l,
        16 * (rank() OVER (ORDER BY date) - 1) // count(*) OVER () AS d
    FROM v
), z AS (
    SELECT *, list_sum([((l >> b) % 2 * 8 + (s >> b) % 2 * 4 + (d >> b) % 2 * 2 + (g >> b) % 2) << (4 * b) for b in [0, 1, 2, 3]]) AS z FROM c
), p AS (
    SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // 500 AS file FROM z
), f AS (
    SELECT file, min(s) AS s0, max(s) AS s1, min(g) AS g0, max(g) AS g1, min(l) AS l0, max(l) AS l1, min(d) AS d0, max(d) AS d1 FROM p GROUP BY file
), q AS (
    SELECT DISTINCT z, s, g, l, d FROM p
), t AS (
    SELECT z, count(*) AS files_touched FROM q JOIN f ON s BETWEEN s0 AND s1 AND g BETWEEN g0 AND g1 AND l0 <= l + 2 AND l1 >= l - 2 AND d0 <= d + 2 AND d1 >= d - 2 GROUP BY z
), m AS (
    SELECT q.z, count(DISTINCT p.file) AS files_matching FROM q JOIN p ON q.s = p.s AND q.g = p.g AND abs(q.l - p.l) <= 2 AND abs(q.d - p.d) <= 2 GROUP BY q.z
)
SELECT doc_id, CAST(z AS BIGINT) AS z, CAST(position AS BIGINT) AS position, CAST(file AS BIGINT) AS file, CAST(files_touched AS BIGINT) AS files_touched, CAST(files_matching AS BIGINT) AS files_matching,
    concat_ws(',', s0, s1, g0, g1, l0, l1, d0, d1) AS file_bounds
FROM p JOIN f USING (file) JOIN t USING (z) JOIN m USING (z)
"""
