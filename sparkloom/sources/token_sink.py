"""A packed token cache as a data source that tasks write in parts and a commit makes visible whole.

Rows are (ids array<int>, labels array<int> or null). Each task writes its rows' ids, labels and lengths to files of its own under
_pending; the commit orders the parts, gives each its first row and first token, moves them to their names and puts the manifest in place by
an atomic rename. Readers look at the manifest alone: without a commit there is nothing to read. An abort takes away the sign that the
write is open and then all of its files; a task that ends later misses the sign and deletes its own. The files lie in a folder
that all executors see.

A part's ids are little-endian unsigned 16-bit numbers, or 32-bit ones with dtype "<u4"; labels are signed 32-bit numbers, or
absent. An id that its type can't hold, and labels that are not as many as ids, fail the write.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import packing
from .caches import IDS, LABELS

MANIFEST, PENDING, OPEN = "manifest.json", "_pending", "open"


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    rows: int
    tokens: int
    labelled: bool
    sha256: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"], options.get("dtype", IDS), overwrite
        self.own = f"{self.path}/{PENDING}/{uuid.uuid4().hex}"
        os.makedirs(self.own)
        open(f"{self.own}/{OPEN}", "w").close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"  # attempts of one task don't meet
        try:
            done = self._write(part, name, iterator)
            if not os.path.exists(f"{self.own}/{OPEN}"):
                raise RuntimeError("the write was aborted")
            return done
        except BaseException:
            _drop(self.own, name)
            self._leave()
            raise

    def _write(self, part: int, name: str, iterator: Iterator[pa.RecordBatch]) -> _Written:
        digest, lengths, labelled, tokens = hashlib.sha256(), [], None, 0
        most = np.iinfo(self.kind).max
        with open(f"{self.own}/{name}.ids", "wb") as ids_file, open(f"{self.own}/{name}.labels", "wb") as labels_file:
            for batch in iterator:
                ids, labels = batch.column("ids"), batch.column("labels")
                if ids.null_count:
                    raise ValueError("a row has no ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() > most):
                    raise ValueError(f"an id doesn't fit {self.kind}")
                sizes = np.diff(ids.offsets.to_numpy())
                own = labels.null_count < len(labels) if len(labels) else labelled
                if labelled is not None and own != labelled or own and labels.null_count:
                    raise ValueError("some rows have labels and some have none")
                labelled = own
                if own:
                    if not np.array_equal(np.diff(labels.offsets.to_numpy()), sizes):
                        raise ValueError("a row's labels are not as many as its ids")
                    labels_file.write(labels.flatten().to_numpy(zero_copy_only=False).astype(LABELS).tobytes())
                raw = flat.astype(self.kind).tobytes()
                ids_file.write(raw)
                digest.update(raw)
                lengths.append(sizes)
                tokens += len(flat)
        sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        np.save(f"{self.own}/{name}.lengths.npy", sizes.astype(np.int64))
        return _Written(part, name, len(sizes), tokens, bool(labelled), digest.hexdigest())

    def commit(self, messages: list[_Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        filled = [m for m in done if m.rows]
        if len({m.labelled for m in filled}) > 1:
            self.abort(messages)
            raise ValueError("some rows have labels and some have none")
        before = [] if self.overwrite else _manifest(self.path)["parts"]
        gone = _manifest(self.path)["parts"] if self.overwrite else []
        parts, row, token = list(before), sum(p["rows"] for p in before), sum(p["tokens"] for p in before)
        for m in filled:
            for kind in ("ids", "lengths.npy", *(("labels",) if m.labelled else ())):
                os.replace(f"{self.own}/{m.name}.{kind}", f"{self.path}/{m.name}.{kind}")
            parts.append({"name": m.name, "rows": m.rows, "tokens": m.tokens, "first_row": row, "first_token": token, "labelled": m.labelled, "sha256": m.sha256})
            row, token = row + m.rows, token + m.tokens
        whole = hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest()
        text = json.dumps({"dtype": self.kind, "rows": row, "tokens": token, "sha256": whole, "parts": parts})
        with open(f"{self.own}/{MANIFEST}", "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.own}/{MANIFEST}", f"{self.path}/{MANIFEST}")
        for p in gone:
            _drop(self.path, p["name"])
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in (OPEN, *(os.listdir(self.own) if os.path.isdir(self.own) else ())):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{self.own}/{name}")
        self._leave()

    def _leave(self) -> None:
        """Deletes the folders that are empty now."""
        with contextlib.suppress(OSError):
            os.rmdir(self.own)
            os.rmdir(os.path.dirname(self.own))


def _drop(path: str, name: str) -> None:
    for kind in ("ids", "labels", "lengths.npy"):
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{path}/{name}.{kind}")


def _manifest(path: str) -> dict:
    if not os.path.exists(f"{path}/{MANIFEST}"):
        return {"dtype": IDS, "rows": 0, "tokens": 0, "sha256": hashlib.sha256(b"").hexdigest(), "parts": []}
    with open(f"{path}/{MANIFEST}") as f:
        return json.load(f)


@dataclass
class _Piece(InputPartition):
    part: dict
    first: int
    last: int


class _Reader(DataSourceReader):
    """A row a record, in pieces of `piece` rows."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("piece", 1 << 16))

    def partitions(self) -> list[_Piece]:
        held = _manifest(self.path)
        self.kind = held["dtype"]
        return [_Piece(p | {"dtype": held["dtype"]}, k, min(k + self.size, p["rows"])) for p in held["parts"] for k in range(0, p["rows"], self.size)] or [_Piece({}, 0, 0)]

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        if piece.first == piece.last:
            return
        p = piece.part
        at = np.concatenate([[0], np.cumsum(np.load(f"{self.path}/{p['name']}.lengths.npy", mmap_mode="r"))])
        held = np.memmap(f"{self.path}/{p['name']}.ids", p["dtype"], "r") if p["tokens"] else np.zeros(0, p["dtype"])
        marks = np.memmap(f"{self.path}/{p['name']}.labels", LABELS, "r") if p["labelled"] and p["tokens"] else None
        for k in range(piece.first, piece.last, 1024):
            z = min(k + 1024, piece.last)
            offsets = pa.array((at[k : z + 1] - at[k]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.asarray(held[at[k] : at[z]]).astype(np.int64).astype(np.int32)))
            labels = pa.ListArray.from_arrays(offsets, pa.array(np.asarray(marks[at[k] : at[z]]).astype(np.int32))) if marks is not None else pa.nulls(z - k, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, z) + p["first_row"], pa.int64()), pa.array(at[k:z] + p["first_token"], pa.int64()), ids, labels], names=["row", "offset", "ids", "labels"])


class PackedTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return "row bigint, offset bigint, ids array<int>, labels array<int>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def write_packed(rows: DataFrame, path: str, dtype: str = IDS, mode: str = "overwrite") -> dict:
    """Writes rows (ids and, if there are, labels) in their partitions' order; the count of rows and tokens and the digest of the whole."""
    rows.sparkSession.dataSource.register(PackedTokens)
    os.makedirs(path, exist_ok=True)
    labels = F.col("labels") if "labels" in rows.columns else F.lit(None)
    # the writer has the reader's columns
    shaped = rows.select(F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("offset"), F.col("ids").cast("array<int>").alias("ids"), labels.cast("array<int>").alias("labels"))
    shaped.write.format("packed_tokens").option("path", path).option("dtype", dtype).mode(mode).save()
    return {k: v for k, v in _manifest(path).items() if k != "parts"}


def write_sft_cache(encoded: DataFrame, path: str, length: int, expected_length: int, encoding: str = "e", vocabulary: int = 32_000) -> dict:
    """Writes sft_encoding structs as a cache if all gates pass: the length is the one that the analysis chose, and those of sft_gates. Else nothing is written."""
    if length != expected_length:
        raise ValueError(f"the cache's length {length} isn't the chosen one, {expected_length}")
    failed = [r["name"] for r in packing.sft_gates(encoded, length, encoding, vocabulary).where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"gates failed: {', '.join(sorted(failed))}")
    return write_packed(encoded.select(F.col(f"{encoding}.input_ids").alias("ids"), F.col(f"{encoding}.labels").alias("labels")), path) | {"length": length}


def read_packed(spark: SparkSession, path: str, piece: int = 1 << 16) -> DataFrame:
    """(row, offset, ids, labels): rows numbered in the order of the parts, offset the number of tokens before."""
    spark.dataSource.register(PackedTokens)
    return spark.read.format("packed_tokens").option("piece", piece).load(path)


def verify_packed(path: str) -> list[str]:
    """What doesn't agree with the manifest: missing parts, sizes, digests. For one part after the other, on the driver."""
    held, wrong = _manifest(path), []
    for p in held["parts"]:
        name = f"{path}/{p['name']}.ids"
        if not os.path.exists(name):
            wrong.append(f"{p['name']}: missing")
            continue
        digest = hashlib.sha256()
        with open(name, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if os.path.getsize(name) != p["tokens"] * np.dtype(held["dtype"]).itemsize:
            wrong.append(f"{p['name']}: size")
        elif digest.hexdigest() != p["sha256"]:
            wrong.append(f"{p['name']}: digest")
    return wrong
