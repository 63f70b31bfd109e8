"""Best-fit packing of token sequences by sums of squares.

Documents are tokenised, cut into pieces of at most `capacity` tokens (only longer ones are cut) and packed. A piece goes where the
sum of squared counts of open bins, taken over the residual gaps, becomes smallest: into a bin of the gap that minimises it, or into a
new bin. Only lengths take part; a full piece is a sequence of its own.

Packing is sequential within a group, so pieces are dealt by a hash into groups of about `group` pieces, of any document, source or
text; each group is packed by itself, long pieces first. Its half-empty bins are then broken up and their pieces placed again by the
same sums, but now with a new bin only where no open one has room, while that saves bins.
Groups grow in number with the input, not in size, and a group needs a few numbers for each piece.

Null texts count as empty: one piece that holds the end id alone. Repeated rows are packed one by one. An empty table gives an
empty result. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, stored

CAPACITY = 2048
#: Of words and of pieces of words, the first so many are kept; most words that are frequent turn up early.
MAX_WORDS = 700_000


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts word by word with the ids that the tokenizer gives for the text.

    The vocabulary drops white space and never joins across it, so a text's ids are its words' ids in order. Words of ASCII and
    Latin-1 without an apostrophe or an added token are cut into letter runs, digits and other runs here and looked up piece by piece; all other
    words go through the tokenizer itself. Both caches are bounded; what they don't hold is made anew each time.
    """

    LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # tokens that stand in a text as themselves, in whatever case
        added = [re.escape(t["content"].lower()) for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.plain = re.compile(rf"[\x21-\x26\x28-\x7e{self.LATIN}]+") if self._known(spec) else re.compile(r"(?!)")
        self.runs = re.compile(rf"[{self.LATIN}]+|[0-9]|[^{self.LATIN}0-9]+")
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether the file has the steps that the short way stands for."""
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def _piece(self, run: str) -> bytes:
        found = self.pieces.get(run)
        if found is None:
            shown = run if run.isascii() else "".join(self.alphabet[b] for b in run.encode())
            ids = [t.id for t in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) < MAX_WORDS:
                self.pieces[run] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain.fullmatch(text) and not self.added.search(text.lower()):
            return b"".join(map(self._piece, self.runs.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids, as little-endian unsigned 32-bit numbers."""
        split = text.encode("utf-8", "replace").split()
        words = self.words
        try:
            return b"".join(map(words.__getitem__, split))
        except KeyError:
            pass
        new = {w: self._word(w) for w in set(split).difference(words)}
        if len(words) < MAX_WORDS:
            words.update(new)
            return b"".join(map(words.__getitem__, split))
        return b"".join([new[w] if w in new else words[w] for w in split])  # a word may have no ids at all


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "piece", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """docs with a row for each piece, in the struct column `out`: piece, start, length, ids_crc32, and ids as bytes if wanted later from tokens()."""

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        step = 4 * capacity
        for col in cols:
            rows = []
            for value in col:
                ids = enc.encode(value.as_py() or "") + last
                rows.append([{"piece": k, "start": k * capacity, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, at in enumerate(range(0, len(ids), step)) for part in (ids[at : at + step],)])
            yield pa.array(rows, kind)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, F.explode(cut(F.col(text))))


def tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", end: int = 0) -> DataFrame:
    """docs with the column `out`: the whole text's ids with the end id."""

    @F.arrow_udf("array<int>")
    def ids(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for col in cols:
            yield pa.array([[*np.frombuffer(enc.encode(v.as_py() or ""), "<u4").tolist(), end] for v in col], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def _place(lengths: np.ndarray, order: np.ndarray, capacity: int, last: bool = False) -> tuple[np.ndarray, list[int]]:
    """Sum-of-squares placement in the given order: each piece's bin, and each bin's gap. last: no new bin while an open one has room."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins don't count
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, gaps = np.empty(len(lengths), np.int64), []
    inf = np.iinfo(np.int64).max
    for k in order:
        n = int(lengths[k])
        # change of the sum: a bin leaves gap g and joins gap g - n; a bin that becomes full joins none
        old = count[n:]
        rest = count[: capacity - n + 1].copy()
        rest[0] = 0
        change = 2 * (rest - old) + 2
        change[0] = 1 - 2 * old[0]  # fills the bin
        change[old == 0] = inf
        if n:
            change = np.where(np.arange(n, capacity + 1) == capacity, inf, change)
        best = int(change.argmin())
        fresh = 2 * int(count[capacity - n]) + 1 if n < capacity else 0
        if change[best] == inf or (fresh < change[best] and not last):
            b, left = len(gaps), capacity - n
            gaps.append(left)
        else:
            g = best + n
            b, left = at[g].pop(), g - n
            count[g] -= 1
            gaps[b] = left
        if left:
            at[left].append(b)
            count[left] += 1
        bin_of[k] = b
    return bin_of, gaps


def pack(lengths: np.ndarray, capacity: int = CAPACITY, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Long pieces first; then the pieces of bins with a gap are placed anew while that saves bins."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    bin_of, gaps = _place(lengths, order, capacity)
    best, n = bin_of, len(gaps)
    for r in range(rounds):
        gap = np.array(gaps)
        open_ = gap > 0
        again = np.flatnonzero(open_[best])
        if not len(again):
            break
        # the open bins' own pieces once more: the closed bins stay as they are
        placed, own_gaps = _place(lengths[again], np.argsort(-lengths[again], kind="stable"), capacity, last=True)
        own = len(own_gaps)
        if own >= int(open_.sum()):
            break
        closed = np.cumsum(~open_) - 1
        new = closed[best]
        new[again] = int((~open_).sum()) + placed
        best, n = new, int((~open_).sum()) + own
        gaps = (capacity - np.bincount(best, lengths, n)).astype(int).tolist()
    offset = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), best))
    run = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], np.diff(best[order]) != 0]) if len(order) else np.zeros(0, bool)
    offset[order] = run - np.repeat(run[first], np.diff(np.concatenate([np.flatnonzero(first), [len(order)]])))
    return best, offset


def pack_pieces(rows: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY, group: int = 100_000) -> DataFrame:
    """rows (which must give the same rows when read again) with sequence_id and offset, in place of columns of these names."""
    rows = rows.drop("sequence_id", "offset")
    total = rows.where(F.col(length) < capacity).count()
    groups = max(1, -(-total // group))
    deal = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, kind="stable", na_position="first").reset_index(drop=True)
        bins, offset = pack(pdf[length].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=(bins.astype(np.int64) << 24) | int(key[0]), offset=offset)

    if groups > 1 << 24:
        raise ValueError("more groups than sequence ids have room for")
    # a full piece is a sequence of its own; it needs no group
    full = rows.where(F.col(length) >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = rows.where(F.col(length) < capacity).groupBy(deal.alias("_deal")).applyInPandas(fill, schema)
    return rest.unionByName(full)


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: its document, place in it, length and digest, and its place in a sequence."""
    cut = pieces(docs.select("doc_id", "text"), tokenizer).select("doc_id", "piece.*")
    return pack_pieces(stored(cut), ["doc_id", "piece"])


def sequences(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed training sequences themselves: sequence_id and ids. Each holds at most `CAPACITY` ids, so its group is bounded."""
    plan = pack_pieces(stored(pieces(docs.select(key, text), tokenizer).select(key, "piece.*")), [key, "piece"])
    ids = tokens(docs.select(key, text).dropDuplicates([key]), tokenizer).select(key, "ids")
    parts = plan.join(ids, key).select("sequence_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
