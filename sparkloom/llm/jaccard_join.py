"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the hashes (64 bits) of its distinct 5-word shingles. Documents of equal sets are one node; nodes link when
100 x intersection >= 75 x union. The result gives each document its component of links.

Prefixes. A token in DEAR documents or more, counted over all of them, is dear: its list costs a candidate for each. The order of the
tokens has the cheap ones first, then the dear ones, each by hash. A link between sets of n and m >= n tokens shares at least
o = ceil(3/7 (n + m)) tokens, and o is 6/7 n and 3/4 m at least. So the smallest shared token lies in the first n - ceil(6/7 n) + 1
tokens of the smaller set and in the first m - ceil(3/4 m) + 1 of the larger. If it is cheap, the pair meets in a short list.
If it is dear, no cheap token is shared at all, and the pair must share o of its dear tokens. Only then the long lists matter, and there
a document's prefix is lengthened by l - 1 tokens, where l grows with the candidates that its lists are estimated to cost; a pair must
share as many prefix tokens as the lower l of the two before it is verified. Documents with too many cheap tokens list no dear ones,
and pairs of which one has too few dear tokens for o are no candidates. Lists of dear tokens are also split by bands of sizes.

Large groups of near copies would make all their pairs candidates. They are drawn together first: nodes that agree in several of eight
minimum hashes are compared with one node of their group, and verified links give labels. Lists give candidates between different
labels alone. That shortens the work, not the result: links inside a label change no component, and those between labels all come from
the exact join. `jaccard_links` leaves the labels out and gives every link between different texts.

Nulls and texts without words have no shingles and are linked with nothing. Null ids take part and are never the smallest. Repeated
rows give a result row each. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SMALL_ROWS, bounded_batches, partitions, released, small, stored
from .components import components

WORDS = 5
#: Bytes of text that are worked on at once. A batch goes in pieces of PIECE, so that a worker holds one piece's sets and arrays beside what it returns.
CHUNK, PIECE = 1 << 18, 1 << 20
MINS = 8
#: From so many documents on a token is dear. The table of dear tokens holds so many at most (12 MB on each executor); tokens beyond count as cheap.
DEAR, MAX_DEAR = 16, 1 << 20
#: l grows by one with each doubling of a document's estimated candidates beyond COST, up to MOST and an eighth of its set.
COST, MOST = 64, 8
#: Of eight minimum hashes so many must agree before a node is compared with its group's representatives, and so many such comparisons a round with either kind.
AGREE, STARS, STAR_ROUNDS = 3, 3, 2
#: Rounds end when they would compare, or have linked, at most one pair for so many nodes.
FEW = 50
#: Shingles for each part of the work, about. Lists of dear tokens have parts of their own: a pair's lists all lie in one band of sizes, which
#: is one part, or several if dear tokens occur more than DEAR_PART times. A pair whose lists lie in one part is made once, and only with all it needs.
PART, DEAR_PART = 2_000_000, 4_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, CHUNK + 4096), _BASE))])
    return _POWERS[:n]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes, and where each begins. A word's hash is a polynomial of its bytes, whatever its place."""
    gap = _GAP[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(raw)
    if not len(first):
        return np.zeros(0, np.uint64), first
    power = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n])])
    # the byte at place k weighs base^k: times base^(n - first) and the inverse of base^n, a word's first byte weighs 1
    h = (total[last] - total[first]) * power[n - first] * np.uint64(pow(int(_BASE), -n, 1 << 64))
    return _mix(h ^ ((last - first).astype(np.uint64) << np.uint64(40))), first


def _segments(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into parts of about CHUNK bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\n"))
        if cut <= at:
            cut = min((k for c in (b" ", b"\n", b"\t") if (k := text.find(c, at + CHUNK)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


#: A shingle's hash mixes the sum of its words' hashes, each times the power of its place.
_PLACES = [np.uint64(int(_BASE) ** (k + 2) % (1 << 64)) for k in range(WORDS)]


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    h = words[:n] * _PLACES[0]
    for j in range(1, k):
        h += words[j : n + j] * _PLACES[j]
    return _mix(h + np.uint64(k))


def _distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _shingles(words: np.ndarray) -> np.ndarray:
    return _windows(words, min(len(words), WORDS)) if len(words) else words


def token_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    out: list[np.ndarray | None] = [None] * len(texts)
    part, size = [], 0

    def flush() -> None:
        nonlocal part, size
        if part:
            raw = np.frombuffer(b"\n".join(t for _, t in part) + b"\n", np.uint8)
            words, first = _words(raw)
            ends = np.searchsorted(first, np.cumsum([len(t) + 1 for _, t in part]))
            runs = _windows(words, WORDS) if len(words) >= WORDS else words[:0]  # those across two texts are left out below
            for (k, _), a, b in zip(part, [0, *ends[:-1]], ends):
                out[k] = _distinct(runs[a : b - WORDS + 1]) if b - a >= WORDS else _shingles(words[a:b])
        part, size = [], 0

    for k, text in enumerate(texts):
        b = (text or "").encode("utf-8", "replace").translate(_LOWER)
        if len(b) > CHUNK:
            out[k] = _distinct(_shingles(np.concatenate([_words(np.frombuffer(s, np.uint8))[0] for s in _segments(b) if s])))
            continue
        if size + len(b) > CHUNK:
            flush()
        part.append((k, b))
        size += len(b) + 1
    flush()
    return out


def _pieces(texts: pa.Array) -> Iterator[slice]:
    """Places of texts of PIECE bytes together, or of one longer text; one piece if there are none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts) or not at:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield slice(at, end)
        at = end


def link(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_SALTS = [np.uint64(int.from_bytes(hashlib.blake2b(b"min%d" % k, digest_size=8).digest(), "big") | 1) for k in range(MINS)]


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, key, mark (of the text), n, node (null without shingles), mins."""
    kind = pa.struct([("n", pa.int64()), ("node", pa.binary()), ("mins", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:bigint,node:binary,mins:array<bigint>>")
    def run(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([told(col[piece]) for piece in _pieces(col)])

    def told(texts: pa.Array) -> pa.Array:
        sets = token_sets(texts.to_pylist())
        n = np.array([len(s) for s in sets], np.int64)
        node = [node_of(s) if len(s) else None for s in sets]
        full = n[n > 0]
        if len(full):
            t, first = np.concatenate(sets), np.cumsum(full) - full
            least = np.stack([np.minimum.reduceat(t * salt, first) for salt in _SALTS], axis=1).view(np.int64)
        else:
            least = np.zeros((0, MINS), np.int64)
        mins = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * MINS)]), pa.int32()), pa.array(least.ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.binary()), mins], fields=list(kind))

    return docs.withColumn("s", run("text")).select("doc_id", "key", F.xxhash64("text").alias("mark"), "s.*")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, tokens) for wanted (id, key, node), n rows at most: sets made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, nodes, texts in ([c[piece] for c in b.columns] for piece in _pieces(b.column(2))):
                own = [(i, s.tobytes()) for i, node, s in zip(ids.to_pylist(), nodes.to_pylist(), token_sets(texts.to_pylist())) if node_of(s) == node]  # not another text of the same document id
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["id", "tokens"])

    return stored(docs.join(small(n)(wanted), "key").select("id", "node", "text").mapInArrow(run, "id bigint, tokens binary").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """Those of n pairs (x, y) that link. Few pairs go to the sets, so that only the sets of pairs are shuffled, and once."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([link(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b)], pa.bool_())

    one, two = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "xy")
    if n <= SMALL_ROWS:
        two = two.join(F.broadcast(pairs.select("y")), "y", "left_semi")
    return stored(one.join(small(n)(pairs), "x").join(two, "y").where(run("tx", "ty")).select("x", "y"))


def _near(nodes: DataFrame) -> DataFrame:
    """Nodes that share AGREE minimum hashes with others, and `common`: how many nodes share each, added up. It is largest in the middle of a group."""
    each = nodes.select("id", F.posexplode("mins").alias("k", "m"))
    often = each.groupBy("k", "m").agg(F.count("*").alias("c")).where("c > 1")
    common = each.join(often, ["k", "m"]).groupBy("id").agg(F.sum("c").alias("common"), F.count("*").alias("shared")).where(F.col("shared") >= AGREE)
    return stored(nodes.join(common.drop("shared"), "id"))


def _stars(near: DataFrame, labels: DataFrame, n: int, round_: int) -> DataFrame:
    """(x, y): nodes and the representatives, of another label, of their groups by minimum hash that agree with them best.

    A group has two: the node with the most in common, the middle of the group, and any one; which of equal ones differs by round.
    """
    held = near.join(small(n)(labels), "id").select("id", "n", "mins", "common", "root")
    each = held.select("id", "n", "mins", "common", "root", F.posexplode("mins").alias("k", "m"))
    node, lot = F.struct(F.col("id").alias("y"), F.col("n").alias("yn"), F.col("mins").alias("ymins"), F.col("root").alias("yroot")), F.xxhash64("k", "id", F.lit(round_))
    # stored, so that the join below reads two plain exchanges, of which Spark splits hot keys, or none
    heads = stored(each.groupBy("k", "m").agg(F.min_by(node, F.struct(-F.col("common"), lot)).alias("middle"), F.min_by(node, lot).alias("other"), F.count("*").alias("c")).where("c > 1"))
    # a row of heads is as long as eight narrow ones
    met = each.join(small(8 * heads.count())(heads), ["k", "m"]).select("id", "n", "mins", "root", F.posexplode(F.array("middle", "other")).alias("kind", "h"))
    agree = F.size(F.filter(F.zip_with("mins", "h.ymins", lambda a, b: a == b), lambda x: x))
    pairs = met.where("root <> h.yroot AND 4 * least(n, h.yn) >= 3 * greatest(n, h.yn)").select(F.col("id").alias("x"), "kind", F.col("h.y").alias("y"), agree.alias("agree")).where(F.col("agree") >= AGREE)
    best = [F.slice(F.reverse(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct("agree", "y"))))), 1, STARS) for kind in (0, 1)]  # of at most MINS each
    out = stored(pairs.groupBy("x").agg(F.array_union(*best).alias("best")).select("x", F.explode("best.y").alias("y")))
    released(heads)
    return out


def _relabelled(labels: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """labels after new links (x, y): the smaller of the two labels, and then the label of the node that a label names. Equal labels mean linked nodes; the rounds need no more than that."""
    both = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
    better = both.join(small(n)(labels), both["y"] == labels["id"]).groupBy("x").agg(F.min("root").alias("better"))
    once = stored(labels.join(small(n)(better), labels["id"] == better["x"], "left").select("id", F.least("root", "better").alias("root")))
    further = once.select(F.col("id").alias("at"), F.col("root").alias("further"))
    out = stored(once.join(small(n)(further), F.col("root.id") == F.col("at")).select("id", F.least("root", "further").alias("root")))
    released(once)
    return out


def _part(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int32)


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that rows go to: the part and their places."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(to)]):
        if z > a:
            yield int(to[a]), order[a:z]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns one after the other, which compress better than rows: the first in planes of bytes."""
    first = np.ascontiguousarray(columns[0])
    return b"".join([first.view(np.uint8).reshape(-1, first.itemsize).T.tobytes(), *(c.tobytes() for c in columns[1:])])


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        part = np.frombuffer(blob, np.uint8, n * size, at)
        out.append((part.reshape(size, n).T.copy().view(k).ravel() if not out else part.view(k)))
        at += n * size
    return out


def _blobs(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names=["p", "blob"])


class Dear:
    """The dear tokens in order and their counts."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's count, 0 if it is cheap."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int32)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


def _dear(docs: DataFrame, parts: int) -> Dear:
    """Tokens of DEAR documents or more, counted over the whole sets of all documents: the MAX_DEAR most frequent of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.concatenate([np.concatenate([np.zeros(0, np.uint64), *token_sets(b.column(0)[piece].to_pylist())]) for piece in _pieces(b.column(0))])
            t.sort()
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            n = np.minimum(np.diff(first, append=len(t)), 65535).astype("<u2")
            t = t[first]
            # a part is a range of tokens; differences of ordered tokens have few bits, and the counts are nearly all 1
            cuts = np.searchsorted((t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
            yield _blobs([(p, _packed(np.diff(t[a:z], prepend=np.uint64(0)), n[a:z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a])

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = [], []
        for b in batches:
            for blob in b.column("blob"):
                d, n = _unpacked(blob.as_py(), "<u8", "<u2")
                tokens.append(np.cumsum(d, dtype=np.uint64))
                counts.append(n)
        t, n = np.concatenate(tokens), np.concatenate(counts)
        tokens.clear()
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order].astype(np.int64)
        del order
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.add.reduceat(n, first)
        often = n >= DEAR
        yield pa.RecordBatch.from_arrays([pa.array(t[first][often].view(np.int64)), pa.array(n[often])], names=["t", "c"])

    found = docs.select("text").mapInArrow(emit, "p int, blob binary").groupBy("p").applyInArrow(count, "t bigint, c bigint")
    rows = found.orderBy(F.desc("c"), "t").limit(MAX_DEAR).toArrow()
    t, c = (np.ascontiguousarray(rows.column(k).to_numpy(), np.int64) for k in (0, 1))
    return Dear(t.view(np.uint64), np.minimum(c, 1 << 30).astype(np.int32))


#: Lists of dear tokens are split by sizes: sizes of 3 to 4 fall into the same band or the next one.
_BAND = np.log(1.34)
#: n: tokens of the set. d: dear ones of them, or -1 in a list of a cheap token. low: documents as the smaller of a pair are listed here too.
POSTING = np.dtype([("t", "<u8"), ("id", "<i8"), ("label", "<i8"), ("n", "<i4"), ("d", "<i4"), ("l", "<i2"), ("low", "<i2")])


def postings(sets: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, dear: Dear) -> np.ndarray:
    """What the sets list, by the rules at the module's head."""
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return np.empty(0, POSTING)
    t, of, first = np.concatenate(sets), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    count = dear.count(t)
    is_dear = count > 0
    before = np.cumsum(is_dear) - is_dear
    rank_d = before - before[np.minimum(first, len(t) - 1)][of]
    rank_c = np.arange(len(t)) - first[of] - rank_d
    d = np.bincount(of, is_dear, len(n)).astype(np.int64)
    low, high = (3 * n + 3) // 4, (6 * n + 6) // 7
    cost = np.bincount(of, np.where(rank_d < (d - low + 1)[of], count, 0), len(n))
    l = 1 + np.minimum(np.minimum(MOST, n // 8), np.log2(np.maximum(1, cost / COST)).astype(np.int64))
    cheap = ~is_dear & (rank_c < (n - low + 1)[of])
    long = is_dear & (rank_d < np.where(d >= low, d - low + l, 0)[of])
    band = _bands(n).astype(np.uint64)
    own, other = _mix(t[long] ^ _BASE * (band[of[long]] + np.uint64(1))), _mix(t[long] ^ _BASE * band[of[long]])
    places = np.concatenate([np.flatnonzero(cheap), np.flatnonzero(long), np.flatnonzero(long)])
    k = of[places]
    out = np.empty(len(places), POSTING)
    out["t"] = np.concatenate([t[cheap], own, other])
    out["id"], out["label"], out["n"], out["l"] = ids[k], labels[k], n[k], l[k]
    n_cheap, n_long = int(cheap.sum()), int(long.sum())
    out["d"] = d[k]
    out["l"][:n_cheap] = 0  # a cheap list
    out["low"] = np.concatenate([(rank_c < (n - high + 1)[of])[cheap], (rank_d < np.where(d >= high, d - high + l, 0)[of])[long], np.zeros(n_long, bool)])
    return out


def _splits(dear: Dear) -> int:
    """Parts of a band of dear lists. Its postings are fewer than the occurrences of dear tokens, whatever the band."""
    return 1 + int(dear.counts.sum(dtype=np.int64)) // DEAR_PART


def _bands(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(1, n)) / _BAND).astype(np.int64)


def _postings(work: DataFrame, dear: Dear, parts: int) -> DataFrame:
    """(p, blob): postings, dealt by token; those of dear tokens to parts below 0, by band and token."""
    splits = _splits(dear)
    held = work.sparkSession.sparkContext.broadcast(dear)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, to = [], []
            for ids, labels, nodes, texts in ([c[piece] for c in b.columns] for piece in _pieces(b.column(3))):
                sets = [s if node_of(s) == node else s[:0] for s, node in zip(token_sets(texts.to_pylist()), nodes.to_pylist())]  # another text of the same document id
                rows = postings(sets, ids.to_numpy(), labels.to_numpy(), held.value)
                cheap, long = rows["l"] == 0, rows["l"] > 0
                # the second half is listed for pairs with smaller sizes, a band lower
                band = _bands(rows["n"][long]) + (np.arange(long.sum()) < long.sum() // 2)
                p = np.empty(len(rows), np.int32)
                p[cheap] = _part(rows["t"][cheap], parts) + 1
                p[long] = -(band * splits + _part(rows["t"][long], splits)) - 1
                listed.append(rows)
                to.append(p)
            rows = np.concatenate(listed)
            listed.clear()
            out = []
            for p, at in _dealt(np.concatenate(to)):
                r = rows[at]
                out.append((p, _packed(r["id"], r["t"], *(r[c] for c in POSTING.names[2:]))))
            del rows
            yield _blobs(out)

    return work.select("id", "root", "node", "text").mapInArrow(run, "p int, blob binary")


def _needs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared listed tokens that pairs x (the smaller) and y need. 0: no link is possible by this list."""
    xn, yn, xd, yd = (v.astype(np.int64) for v in (x["n"], y["n"], x["d"], y["d"]))
    least = (3 * (xn + yn) + 6) // 7
    x_rest = xn - np.minimum(xn - xd, xn - (6 * xn + 6) // 7 + 1)
    y_rest = yn - np.minimum(yn - yd, yn - (3 * yn + 3) // 4 + 1)
    cheap = np.maximum(1, least - np.maximum(x_rest, y_rest))
    return np.where(x["l"] == 0, cheap, np.where(np.minimum(xd, yd) >= least, np.minimum(x["l"], y["l"]), 0))


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Rows of lists that hold more than one document, by list, size and document; repeated rows once."""
    rows = rows[np.lexsort((rows["id"], rows["n"], rows["t"]))]
    new = rows["t"][1:] != rows["t"][:-1]
    rows = rows[np.concatenate([[True], new | (rows["id"][1:] != rows["id"][:-1])])] if len(rows) else rows
    edge = np.concatenate([[True], rows["t"][1:] != rows["t"][:-1], [True]]) if len(rows) else np.ones(1, bool)
    return rows[~(edge[:-1] & edge[1:])]  # most lists hold one row


def _other_pairs(rows: np.ndarray) -> int:
    """How many pairs of different labels the lists of ordered rows have, at most."""
    if not len(rows):
        return 0
    rows = rows[np.lexsort((rows["label"], rows["t"]))]
    new = np.concatenate([[True], rows["t"][1:] != rows["t"][:-1]])
    same = np.concatenate([[True], new[1:] | (rows["label"][1:] != rows["label"][:-1])])
    sizes, labels = (np.diff(np.flatnonzero(x), append=len(rows)).astype(np.int64) for x in (new, same))
    return int((sizes**2).sum() - (labels**2).sum()) // 2


def list_pairs(rows: np.ndarray, band: int = 0, bands: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Candidates of the lists in ordered rows, by list: ids x and y of different labels, the shared listed tokens that they need, and whether the list is a dear one's.

    Of several bands each has the pairs whose first document, by size and id, falls to it; a pair's lists all agree on that.
    """
    if not len(rows):
        return
    cuts = np.concatenate([[0], np.flatnonzero(rows["t"][1:] != rows["t"][:-1]) + 1, [len(rows)]])
    size = np.diff(cuts)
    mine = _mix(rows["id"].view(np.uint64)) % np.uint64(bands) == band if bands > 1 else np.ones(len(rows), bool)

    def pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        need = _needs(x, y)
        ok = (need > 0) & (x["label"] != y["label"]) & (x["low"] > 0)
        for kind in (False, True):
            own = ok & ((x["l"] > 0) == kind)
            if own.any():
                a, b = x["id"][own], y["id"][own]
                yield np.minimum(a, b), np.maximum(a, b), need[own], kind

    # short lists all at once: each row with the one that comes `off` places after it
    long = size > 64
    of = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(~long[of] & mine)
    for off in range(1, 64):
        at = at[at + off < cuts[of[at] + 1]]
        at = at[3 * rows["n"][at + off].astype(np.int64) <= 4 * rows["n"][at].astype(np.int64)]  # later ones are larger still
        if not len(at):
            break
        yield from pairs(rows[at], rows[at + off])
    for k in np.flatnonzero(long):
        r = rows[cuts[k] : cuts[k + 1]]
        names, count = np.unique(r["label"], return_counts=True)
        if len(names) == 1:
            continue
        # rows of the most common label are compared with the others alone
        rare = np.flatnonzero(r["label"] != names[count.argmax()])
        few, common = r[rare], r["label"] == names[count.argmax()]
        for i in np.flatnonzero((r["low"] > 0) & mine[cuts[k] : cuts[k + 1]]):
            held, start = (few, np.searchsorted(rare, i, "right")) if common[i] else (r, i + 1)
            y = held[start : np.searchsorted(held["n"], int(r["n"][i]) * 4 // 3, "right")]
            if len(y):
                yield from pairs(np.broadcast_to(r[i], len(y)), y)


_PAIR = np.dtype([("x", "<i8"), ("y", "<i8"), ("dear", "?"), ("need", "<i8"), ("shared", "<i8")])
#: Pairs that a band of a part should have, and are held before those of the same documents are added up.
HELD = 1 << 20


def _added(found: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows["dear"], rows["y"], rows["x"]))]
    first = np.flatnonzero(np.concatenate([[True], (rows["x"][1:] != rows["x"][:-1]) | (rows["y"][1:] != rows["y"][:-1]) | (rows["dear"][1:] != rows["dear"][:-1])]))
    out = rows[first]
    out["shared"] = np.add.reduceat(rows["shared"], first)
    return out


def counted(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs with the number of lists that they share, each pair once: the lists are gone through in as many bands as their pairs need."""
    rows = _ordered(rows)
    bands = 1 + _other_pairs(rows) // HELD
    for band in range(bands):
        held, n, most = [], 0, HELD
        for x, y, need, kind in list_pairs(rows, band, bands):
            r = np.empty(len(x), _PAIR)
            r["x"], r["y"], r["need"], r["dear"], r["shared"] = x, y, need, kind, 1
            held.append(r)
            n += len(r)
            if n > most:
                held = [_added(held)]
                n = len(held[0])
                most = max(HELD, 2 * n)
        if n:
            yield _added(held)


def _candidates(held: DataFrame, splits: int) -> DataFrame:
    """(x, y) with as many shared listed tokens as they need. A pair's dear lists lie in so many parts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for blob in b.column("blob"):
                i, t, *rest = _unpacked(blob.as_py(), "<i8", "<u8", *(POSTING[c].str for c in POSTING.names[2:]))
                r = np.empty(len(t), POSTING)
                for name, c in zip(POSTING.names, (t, i, *rest)):
                    r[name] = c
                parts.append(r)
        rows = [np.concatenate(parts)]
        parts.clear()
        for pair in counted(rows.pop()):
            if splits == 1:
                pair = pair[~pair["dear"] | (pair["shared"] >= pair["need"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[c])) for c in _PAIR.names], names=list(_PAIR.names))

    each = held.groupBy("p").applyInArrow(run, "x bigint, y bigint, dear boolean, need bigint, shared bigint")
    kinds = [f(F.when(F.col("dear") == dear, F.col(c))).alias(f"{c}_{dear}") for dear in (False, True) for f, c in ((F.max, "need"), (F.sum, "shared"))]
    return stored(each.groupBy("x", "y").agg(*kinds).where("shared_False >= need_False OR shared_True >= need_True").select("x", "y"))


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The texts by key, every document's description, the nodes, and the number of parts to deal their tokens to."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)).alias("key"), F.col(text).alias("text"))
    described = stored(_describe(docs))
    nodes = described.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    nodes = stored(nodes.select("*", F.monotonically_increasing_id().alias("id")))
    total = described.agg(F.sum("n")).first()[0] or 0
    parts = max(8, 4 * partitions(docs.sparkSession), total // PART)
    return docs.select("key", "text"), described, nodes, parts


def _joined(texts: DataFrame, nodes: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """The exact join: verified links (x, y) between nodes of different labels (id, root); a node that has none is its own."""
    where = nodes.select("id", "key", "node").join(labels, "id", "left").select("id", "key", "node", F.coalesce("root", "id").alias("root"))
    dear = _dear(texts, parts)
    # the narrow side is hashed, as sorting the texts would take a task's memory
    pairs = _candidates(_postings(texts.join(where.hint("shuffle_hash"), "key"), dear, parts), _splits(dear))
    n = pairs.count()
    ends = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    sets = _sets(texts, nodes.join(small(2 * n)(ends), "id", "left_semi").select("id", "key", "node"), 2 * n)
    found = _verified(pairs, n, sets)
    released(pairs, sets)
    return found


def _drawn(texts: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Links that draw groups of near copies together; None if no two nodes agree. Only nodes that agree with another take part; their sets are made once."""
    near = _near(nodes)
    n = near.count()
    labels = stored(near.select("id", F.struct((-F.col("common")).alias("order"), "id").alias("root")))  # the middle of a group has the smallest label
    links, sets = [], None
    for r in range(STAR_ROUNDS):
        pairs = _stars(near, labels, n, r)
        # groups that a round hardly changes are left to the exact join
        if (compared := pairs.count()) * FEW <= n:
            break
        sets = _sets(texts, near.select("id", "key", "node"), n) if sets is None else sets
        links.append(_verified(pairs, compared, sets))
        released(pairs)
        if r == STAR_ROUNDS - 1 or links[-1].count() * FEW <= n:
            break
        before, labels = labels, _relabelled(labels, links[-1], n)
        released(before)
    kept = None
    if links:
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        kept = stored(out)
    released(near, sets, labels, *links)
    return kept


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (x, y), and the membership (doc_id, n_shingles, node) of the documents; x and y are nodes."""
    texts, described, nodes, parts = _prepared(docs, key, text)
    links = _joined(texts, nodes, docs.sparkSession.createDataFrame([], "id bigint, root bigint"), parts)
    return links, described.join(nodes.select("node", "id"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("node"))


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document: doc_id, key, mark, n, node, root (of its component's nodes; null without shingles) and the component's least key."""
    texts, described, nodes, parts = _prepared(docs, key, text)
    drawn = _drawn(texts, nodes)
    labels = components(drawn) if drawn is not None else docs.sparkSession.createDataFrame([], "id bigint, root bigint")
    found = _joined(texts, nodes, labels, parts)
    near_to = small(labels.count())
    root = nodes.join(near_to(labels), "id", "left").select("node", F.col("key").alias("least"), F.coalesce("root", "id").alias("root"))
    # links between labels join these
    ends = [labels.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in "xy"]
    between = stored(found.join(near_to(ends[0]), "x", "left").join(near_to(ends[1]), "y", "left").select(F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y")))
    named = root
    if not between.isEmpty():
        joined = components(between)
        named = root.join(small(joined.count())(joined.select(F.col("id").alias("root"), F.col("root").alias("joined"))), "root", "left").select("node", "least", F.coalesce("joined", "root").alias("root"))
    released(drawn, found, between)
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return described.join(named.join(smallest, "root").select("node", "root", "component"), "node", "left")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    component = F.when(F.col("component") == (1 << 63) - 1, F.lit(None)).otherwise(F.coalesce("component", F.col("doc_id").cast("bigint")))
    return _grouped(docs, key, text).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id, and among those of one id that of the least hash of its text.

    Rows that repeat an id and a text count as one document, of which the row stays whose other columns come first in order. Documents
    without words are linked with nothing; all their rows stay. A null id is never the smallest.
    """
    each = _grouped(docs, key, text).where("root IS NOT NULL").groupBy("root", "key", "mark").agg(F.count("*").alias("rows"))
    least = each.groupBy("root").agg(F.min(F.struct("key", "mark", "rows")).alias("k")).select(F.col("k.key").alias("_key"), F.col("k.mark").alias("_mark"), "k.rows")
    kept = least.groupBy("_key", "_mark").agg(F.sum("rows").alias("_rows"))
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.where(has_words).select(F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)).alias("_key"), F.xxhash64(text).alias("_mark"), F.struct(*[docs[c] for c in docs.columns if c != text], text).alias("_row"))
    # texts are not sorted: kept is hashed, and only rows that repeat an id and a text are gathered
    found = named.join(kept.hint("shuffle_hash"), ["_key", "_mark"])
    one = found.where("_rows = 1").select("_row").unionByName(found.where("_rows > 1").groupBy("_key", "_mark").agg(F.min("_row").alias("_row")).select("_row"))
    return one.select("_row.*").select(docs.columns).unionByName(docs.where(~has_words))
