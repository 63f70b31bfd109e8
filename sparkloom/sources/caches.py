"""Flat token caches as a data source: little-endian ids in one file, read in parts, and the three-file form with offsets and labels.

The files are opened by path on the executors, so they must lie where all of them see them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IDS, LABELS = "<u2", "<i4"  # fixed values: types of stored ids and labels


class _Part(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _parts(count: int, size: int) -> list[_Part]:
    return [_Part(k, min(k + size, count)) for k in range(0, count, size)] or [_Part(0, 0)]


class _FlatReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.size = options["path"], options.get("dtype", IDS), int(options.get("part", 1 << 22))

    def partitions(self) -> list[_Part]:
        return _parts(os.path.getsize(self.path) // np.dtype(self.kind).itemsize, self.size)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:  # an empty file can't be mapped
            return
        held, step = np.memmap(self.path, self.kind, "r"), 1 << 16
        for k in range(part.first, part.last, step):
            ids = np.asarray(held[k : min(k + step, part.last)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(ids), dtype=np.int64)), pa.array(ids.astype(np.int32))], names=["pos", "token"])


class _OffsetsReader(DataSourceReader):
    """A row a record: its ids and labels."""

    def __init__(self, options: dict) -> None:
        self.ids, self.labels, self.offsets, self.size = options["path"], options["labels"], options["offsets"], int(options.get("part", 1 << 14))

    def partitions(self) -> list[_Part]:
        return _parts(max(0, len(np.load(self.offsets, mmap_mode="r")) - 1), self.size)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        at = np.load(self.offsets, mmap_mode="r")
        ids, labels = np.memmap(self.ids, IDS, "r"), np.memmap(self.labels, LABELS, "r")
        for k in range(part.first, part.last, 256):
            some = range(k, min(k + 256, part.last))
            x, y = ([np.asarray(v[at[i] : at[i + 1]]).astype(np.int32) for i in some] for v in (ids, labels))
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))], names=["record", "input_ids", "labels"])


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "pos bigint, token int"

    def reader(self, schema) -> DataSourceReader:
        return _FlatReader(self.options)


class OffsetTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_tokens"

    def schema(self) -> str:
        return "record bigint, input_ids array<int>, labels array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _OffsetsReader(self.options)


def read_tokens(spark: SparkSession, path: str, dtype: str = IDS, part: int = 1 << 22) -> DataFrame:
    """(pos, token) of a flat file; an empty file gives no rows."""
    spark.dataSource.register(FlatTokens)
    return spark.read.format("flat_tokens").option("dtype", dtype).option("part", part).load(path)


def read_records(spark: SparkSession, ids: str, labels: str, offsets: str, part: int = 1 << 14) -> DataFrame:
    """(record, input_ids, labels) of a cache whose records lie between neighbouring offsets."""
    spark.dataSource.register(OffsetTokens)
    return spark.read.format("offset_tokens").option("labels", labels).option("offsets", offsets).option("part", part).load(ids)


def write_manifest(path: str, payload: dict) -> None:
    """A small JSON file, written whole or not at all."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2, ensure_ascii=False) + "\n")
    os.replace(f"{path}.tmp", path)
