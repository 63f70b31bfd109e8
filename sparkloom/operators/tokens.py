"""Tokenising: pretokens in the JVM, BPE training from distributed counts, encoding and decoding in Arrow batches."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised, released

#: Special tokens with their ids, and the pretoken pattern of byte-level vocabularies.
SPECIALS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that are encoded at once in a worker, about; a longer text by itself.
CHARS = 1 << 18


def pretokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PRETOKEN), F.lit(0))


def pretoken_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(pretokens(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


#: Distinct pretokens with which merges are learnt on the driver; with more, they are learnt by rounds over a table.
DRIVER_PRETOKENS = 2_000_000
#: Merges that a round tries, at most.
ROUND = 256


def merged(word: list[str], pair: tuple[str, str]) -> list[str]:
    """The word with the pair joined wherever it stands, from the left."""
    out, i = [], 0
    while i < len(word):
        step = 2 if i + 1 < len(word) and (word[i], word[i + 1]) == pair else 1
        out.append("".join(word[i : i + step]))
        i += step
    return out


class _Last(tuple):
    """A pair that comes before smaller ones in a heap."""

    def __lt__(self, other: tuple) -> bool:
        return tuple.__gt__(self, other)


def _learnt(words: list[tuple[list[str], int]], vocab: dict[str, int], vocabulary: int, min_count: int) -> list[list[str]]:
    """Merges over words in memory: the most frequent pair, of equal ones the greatest; vocab grows. A heap holds every count that a pair has had."""
    where: dict[tuple[str, str], set[int]] = {}
    count: dict[tuple[str, str], int] = {}
    for k, (w, n) in enumerate(words):
        for p in zip(w, w[1:]):
            count[p] = count.get(p, 0) + n
            where.setdefault(p, set()).add(k)
    heap = [(-n, _Last(p)) for p, n in count.items()]
    heapq.heapify(heap)
    merges: list[list[str]] = []
    while len(vocab) < vocabulary and heap:
        n, last = heapq.heappop(heap)
        best = tuple(last)
        if count.get(best, 0) != -n:  # its count has changed since
            continue
        if -n < min_count:
            break
        merges.append(list(best))
        vocab.setdefault("".join(best), len(vocab))
        touched = set()
        for k in where.pop(best):
            w, n = words[k]
            for p in zip(w, w[1:]):
                count[p] -= n
                touched.add(p)
                if p != best:
                    where[p].discard(k)
            words[k] = (merged(w, best), n)
            for p in zip(words[k][0], words[k][0][1:]):
                count[p] = count.get(p, 0) + n
                touched.add(p)
                where.setdefault(p, set()).add(k)
        for p in touched:
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], _Last(p)))
            else:
                del count[p]
    return merges


def _independent(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """As many of the pairs from the first on as leave each other's counts alone: none begins with what another ends with."""
    out: list[tuple[str, str]] = []
    starts, ends = set(), set()
    for a, b in pairs:
        if a == b and out or a in ends or b in starts or (out and out[0][0] == out[0][1]):
            break
        out.append((a, b))
        starts.add(a)
        ends.add(b)
    return out


def _learnt_in_rounds(words: DataFrame, vocab: dict[str, int], vocabulary: int, min_count: int) -> list[list[str]]:
    """The same merges over a table (w array of symbols, n) of any size.

    Pair counts are a table too. A round takes the most frequent pairs that leave each other's counts alone, applies them in order to the
    words, and counts after which of them each new pair would have come before the next one. From there on they are given up, so the merges are those of
    one step after the other. The driver has ROUND pairs and what would have come before them.
    """
    kind = "step int, a string, b string, d bigint"

    def changes(batch: list[tuple[str, str]]):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                total: dict[tuple[int, str, str], int] = {}
                for w, n in zip(r.column("w").to_pylist(), r.column("n").to_pylist()):
                    held = set(zip(w, w[1:]))
                    for k, pair in enumerate(batch):
                        if pair in held:
                            after = merged(w, pair)
                            for sign, x in ((-1, w), (1, after)):
                                for p in zip(x, x[1:]):
                                    total[k, *p] = total.get((k, *p), 0) + sign * n
                            w = after
                            held = set(zip(w, w[1:]))
                rows_ = [(*key, d) for key, d in total.items() if d]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows_], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["step", "a", "b", "d"])

        return run

    def apply(batch: list[tuple[str, str]]):
        @F.arrow_udf("array<string>")
        def run(col: pa.Array) -> pa.Array:
            out = []
            for w in col.to_pylist():
                held = set(zip(w, w[1:]))
                for pair in batch:
                    if pair in held:
                        w = merged(w, pair)
                        held = set(zip(w, w[1:]))
                out.append(w)
            return pa.array(out, pa.list_(pa.string()))

        return run

    words = materialised(words)
    pairs = materialised(words.select("n", F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("c")))
    merges: list[list[str]] = []
    while len(vocab) < vocabulary:
        top = [r for r in pairs.orderBy(F.desc("c"), F.desc("a"), F.desc("b")).limit(ROUND).collect() if r["c"] >= min_count]
        batch = _independent([(r["a"], r["b"]) for r in top])[: vocabulary - len(vocab)]
        if not batch:
            break
        # a product that is a symbol already has counts of its own: it ends the round
        known = set(vocab)
        for k, p in enumerate(batch):
            if "".join(p) in known:
                batch = batch[: k + 1]
                break
            known.add("".join(p))
        counts = [r["c"] for r in top[: len(batch)]]
        found = materialised(words.mapInArrow(changes(batch), kind).groupBy("step", "a", "b").agg(F.sum("d").alias("d")))
        fresh = ["".join(p) for p in batch]
        new = found.where(F.col("a").isin(fresh) | F.col("b").isin(fresh))
        upto = new.select("step", "a", "b", F.sum("d").over(Window.partitionBy("a", "b").orderBy("step")).alias("c"))
        ahead: dict[tuple[str, str], list] = {}
        for r in upto.where(F.col("c") >= counts[-1]).collect() if len(batch) > 1 else []:
            ahead.setdefault((r["a"], r["b"]), []).append((r["step"], r["c"]))
        keep = len(batch)  # what falls below again later ends the round all the same
        for p, seen in ahead.items():
            for step, c in seen:
                keep = min([keep, *(j + 1 for j in range(step, len(batch) - 1) if (c, p) > (counts[j + 1], batch[j + 1]))])
        batch = batch[:keep]
        for p in batch:
            merges.append(list(p))
            vocab.setdefault("".join(p), len(vocab))
        deltas = found.where(F.col("step") < keep).groupBy("a", "b").agg(F.sum("d").alias("c"))
        before = (pairs, words, found)
        pairs = materialised(pairs.unionByName(deltas).groupBy("a", "b").agg(F.sum("c").alias("c")).where("c > 0"))
        words = materialised(words.select(apply(batch)("w").alias("w"), "n"))
        released(*before)
    released(pairs, words)
    return merges


def train_bpe(df: DataFrame, text: str, vocabulary: int = 32_000, min_count: int = 2, driver_pretokens: int = DRIVER_PRETOKENS) -> dict:
    """A byte-level BPE vocabulary as a tokenizer's JSON: specials first, then the byte alphabet, then merges.

    Pretokens are counted over all texts, and all that occur min_count times or more take part. Up to driver_pretokens distinct ones are merged on
    the driver; with more, by rounds over the table of them, with the same merges.
    """
    from tokenizers import pre_tokenizers

    counted = materialised(pretoken_counts(df, text).where((F.col("n") >= min_count) & (F.col("pretoken") != "")))
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocab = {t: i for i, t in enumerate((*SPECIALS, *alphabet))}

    def spelt(pretoken: str) -> list[str]:
        return list(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(pretoken)[0][0])

    if counted.count() <= driver_pretokens:
        merges = _learnt([(spelt(r["pretoken"]), r["n"]) for r in counted.collect()], vocab, vocabulary, min_count)
    else:

        @F.arrow_udf("array<string>")
        def spell(col: pa.Array) -> pa.Array:
            return pa.array([spelt(t) for t in col.to_pylist()], pa.list_(pa.string()))

        merges = _learnt_in_rounds(counted.select(spell("pretoken").alias("w"), "n"), vocab, vocabulary, min_count)
    added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(SPECIALS)]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": "<UNK>", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}


def completion_tokens(df: DataFrame, text: str, known: DataFrame, need: int, ordinal: str) -> DataFrame:
    """Substrings that fill a vocabulary up: by document, longer first (8 to 3), then place; printable, no space at the ends, no angle brackets."""
    grams = F.flatten(F.transform(F.sequence(F.lit(8), F.lit(3), F.lit(-1)), lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.struct(F.substr(F.col(text), i, k).alias("token"), (8 - k).alias("rank"), i.alias("at")))).otherwise(F.array())))
    ok = F.col("token").rlike(r"^[^\s<>][^<>\p{Cntrl}]*[^\s<>]$")
    each = df.select(F.col(ordinal).alias("o"), F.explode(grams).alias("g")).select("o", "g.*").where(ok)
    first = each.groupBy("token").agg(F.min(F.struct("o", "rank", "at")).alias("first")).join(known.select("token"), "token", "left_anti")
    return first.orderBy("first").limit(need).select("token")


@functools.lru_cache(maxsize=4)
def _tokenizer(spec: str):
    """One for each worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec) if spec.lstrip().startswith("{") else Tokenizer.from_file(spec)


def encode(spec: str | dict, bos: int | None = None, eos: int | None = None):
    """Column function: ids of a text by a tokenizer (its JSON, or a file that all workers see)."""
    text = json.dumps(spec) if isinstance(spec, dict) else spec

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        held = _tokenizer(text)
        head, tail = ([] if bos is None else [bos]), ([] if eos is None else [eos])
        out, some, chars = [], [], 0

        def flush() -> None:
            out.extend(np.array(head + e.ids + tail, np.int32) for e in held.encode_batch(some, add_special_tokens=False))
            some.clear()

        # the tokenizer's own results take some hundred bytes a token: few texts at once, and only the ids stay
        for k in range(len(col)):
            some.append(col[k].as_py() or "")
            chars += len(some[-1])
            if chars >= CHARS:
                flush()
                chars = 0
        flush()
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))

    return run


def decode(spec: str | dict, skip_specials: bool = True):
    text = json.dumps(spec) if isinstance(spec, dict) else spec

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        held = _tokenizer(text)
        return pa.array(held.decode_batch([x or [] for x in col.to_pylist()], skip_special_tokens=skip_specials), pa.string())

    return run


def token_strings(ids: Column, vocabulary: DataFrame | None = None, names: dict[int, str] | None = None) -> Column:
    """Ids as tokens, <INVALID> for unknown ones."""
    table = F.create_map(*[x for k, v in (names or {}).items() for x in (F.lit(k), F.lit(v))])
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("<INVALID>")))


def combined_digest(files: DataFrame) -> DataFrame:
    """One digest of (name, sha256) rows, in order of names."""
    return files.agg(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "sha256", F.lit("\n")))).alias("x")).select(F.sha2(F.array_join("x", ""), 256).alias("digest"))


def contract(spec: str | dict, size: int = 32_000, specials: tuple[str, ...] = SPECIALS) -> dict[str, bool]:
    """Whether a tokenizer has the size and its special tokens the ids 0, 1, 2, .. that caches count on."""
    held = _tokenizer(json.dumps(spec) if isinstance(spec, dict) else spec)
    return {"vocabulary_size": held.get_vocab_size() == size, "special_token_ids": all(held.token_to_id(t) == k for k, t in enumerate(specials))}


def inspect(df: DataFrame, text: str, spec: str | dict) -> DataFrame:
    """df with ids, their tokens, the decoded text, the number of tokens and whether the round trip holds."""
    held = _tokenizer(json.dumps(spec) if isinstance(spec, dict) else spec)
    names = {i: t for t, i in held.get_vocab().items()}

    @F.arrow_udf("array<string>")
    def strings(ids: pa.Array) -> pa.Array:
        return pa.array([[names.get(i, "<INVALID>") for i in x or []] for x in ids.to_pylist()], pa.list_(pa.string()))

    out = df.withColumn("ids", encode(spec)(text)).withColumns({"tokens": strings("ids"), "decoded": decode(spec)("ids"), "token_count": F.size("ids")})
    return out.withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce(F.col(text), F.lit(""))))


def round_trip_failures(df: DataFrame, text: str, spec: str | dict) -> DataFrame:
    return df.withColumn("_back", decode(spec)(encode(spec)(F.col(text)))).where(F.col("_back") != F.col(text)).drop("_back")


def reload_failures(df: DataFrame, text: str, spec: dict) -> DataFrame:
    """Rows whose ids differ between the tokenizer and the one that is loaded from what it saves."""
    from tokenizers import Tokenizer

    again = Tokenizer.from_str(json.dumps(spec)).to_str()
    ids = df.select("*", encode(spec)(text).alias("_one")).select("*", encode(again)(text).alias("_two"))
    return ids.where(~F.col("_one").eqNullSafe(F.col("_two"))).drop("_one", "_two")


#: The least vocabulary of a trial run: specials and all bytes.
SMOKE_LEAST = len(SPECIALS) + 256


def training_gate(df: DataFrame, digest: str, expected: str, vocabulary: int, split: str = "split", smoke: bool = False) -> int:
    """The vocabulary to train, if the training data may be used: its digest is the expected one and all of it is of the training split. A trial run
    needs neither, and takes SMOKE_LEAST at least."""
    if smoke:
        return max(vocabulary, SMOKE_LEAST)
    if digest != expected:
        raise ValueError(f"the training data's digest {digest} isn't {expected}")
    if other := [r[0] for r in df.where(~F.col(split).eqNullSafe(F.lit("train"))).select(split).distinct().limit(5).collect()]:
        raise ValueError(f"rows of other splits than train: {other}")
    return vocabulary
