"""Interleaved document sequences with media columns.

`media_table` encodes payloads losslessly as media: an 8-bit grey image (portable graymap, 64 samples a row) for each payload,
stored as a binary column of a table in the shared folder and read back from there. `catalogue` decodes the stored bytes and keeps
a row for each digest: sizes, digests, features. `interleave` parses HTML into ordered structs of text and media references;
captions (figcaption, else alt) stay with the reference they belong to; references resolve against the catalogue by a digest join,
and each document's structs are put together again in order, so positions and captions stay aligned.

Payloads never take part in a shuffle: the join moves digests and descriptions alone. The catalogue is made unique by digest with
sums before the exchange, and Spark may split the references' side of a digest that a third of all documents share.

Nulls count as the empty text: one row of 64 zero samples, or an empty sequence. References to unknown digests stay, unresolved.
Repeated rows give one sequence each (rows of one id are told apart by a row number within the id). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, stored

ROW = 64
SCHEME = "sha256:"


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return data + b"\0" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def encode(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a binary portable graymap."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode(media: bytes) -> np.ndarray:
    """The samples of a graymap that encode() made, a row for each 64 bytes."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a complete 8-bit graymap")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def features(samples: np.ndarray) -> str:
    """Rows, mean, deviation, entropy, and a 64-bit difference hash of the column means of eight bands."""
    count = np.bincount(samples.ravel(), minlength=256)
    p = count[count > 0] / samples.size
    bands = np.array_split(samples, 8) if len(samples) >= 8 else [samples] * 8
    cells = np.array([b.reshape(len(b), 8, 8).mean((0, 2)) for b in bands])
    bits = "".join("01"[int(x)] for x in (cells > cells.mean()).ravel())
    return f"rows={len(samples)};mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};hash={int(bits, 2):016x}"


def media_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """A stored table (digest, n_bytes, media): the payloads of all rows, encoded. The digest is the unpadded payload's SHA-256."""

    @F.arrow_udf("binary")
    def media(col: pa.Array) -> pa.Array:
        return pa.array([encode(pad((t or "").encode("utf-8", "replace"))) for t in col.to_pylist()], pa.binary())

    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    return stored(docs.select(F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest"), F.octet_length(whole).cast("long").alias("n_bytes"), media(text).alias("media")))


FACTS = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"
_FACTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def catalogue(media: DataFrame, payload: bool = False) -> DataFrame:
    """One row per digest, from the stored bytes: n_bytes and what FACTS names."""

    @F.arrow_udf(FACTS)
    def facts(col: pa.Array) -> pa.Array:
        rows = []
        for value in col:
            m = value.as_py()
            samples = decode(m)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), features(samples)))
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows) if rows else [[]] * len(_FACTS), _FACTS)], names=[n for n, _ in _FACTS])

    bounded_batches(media.sparkSession)
    kept = [F.min("media").alias("media")] if payload else []  # one digest, one payload
    return media.select("digest", "n_bytes", facts("media").alias("f"), *(["media"] if payload else [])).groupBy("digest").agg(F.min("n_bytes").alias("n_bytes"), F.min("f").alias("f"), *kept)


class _Figure:
    """An open figure: the places of its media, and its caption so far."""

    def __init__(self):
        self.media: list[int] = []
        self.caption: list[str] = []


class _Sequence(HTMLParser):
    """Collects (kind, text, digest, caption) in document order.

    A figure's caption, wherever in it, goes to its media and to those of figures inside it that have none of their own. A caption that
    has no media to go to is text, and so is a figcaption outside a figure. What is not closed ends with what holds it. A head ends with
    its end tag or the first element that can't be in one.
    """

    SKIP = frozenset({"script", "style", "noscript", "template", "title"})
    IN_HEAD = SKIP | {"html", "head", "meta", "link", "base"}
    MEDIA = frozenset({"img", "audio", "video", "source", "embed"})
    BLOCKS = frozenset({"p", "div", "br", "h1", "h2", "h3", "li", "tr", "section", "article"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.skip = 0
        self.head = False
        self.figures: list[_Figure] = []
        self.captions: list[bool] = []  # for each figure whether its figcaption is open

    def _flush(self) -> None:
        if said := " ".join("".join(self.words).split()):
            self.items.append(["text", said, None, None])
        self.words = []

    def _end_figure(self) -> None:
        self._flush()
        figure = self.figures.pop()
        self.captions.pop()
        said = " ".join("".join(figure.caption).split())
        if said and not figure.media:
            self.items.append(["text", said, None, None])
        for k in figure.media:
            if said and not self.items[k][4]:
                self.items[k][3], self.items[k][4] = said, True
        if self.figures:
            self.figures[-1].media += figure.media

    def finish(self) -> list[list]:
        self.close()
        while self.figures:
            self._end_figure()
        self._flush()
        return [item[:4] for item in self.items]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.IN_HEAD:
            self.head = False
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "head":
            self.head = True
        elif tag == "figure":
            self._flush()
            self.figures.append(_Figure())
            self.captions.append(False)
        elif tag == "figcaption":
            self._flush()
            if self.figures:
                self.captions[-1] = True
                self.figures[-1].caption.append(" ")
        elif tag in self.MEDIA:
            self._flush()
            a = dict(attrs)
            src = a.get("src") or ""
            self.items.append(["media", None, src.removeprefix(SCHEME) if src.startswith(SCHEME) else src or None, a.get("alt"), False])
            if self.figures:
                self.figures[-1].media.append(len(self.items) - 1)
        elif tag in self.BLOCKS:
            self._break()

    def _break(self) -> None:
        if self.captions and self.captions[-1]:
            self.figures[-1].caption.append(" ")
        else:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "head":
            self.head = False
        elif tag == "figcaption":
            if self.captions:
                self.captions[-1] = False
            self._flush()
        elif tag == "figure" and self.figures:
            self._end_figure()
        elif tag in self.BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.skip and not self.head:
            (self.figures[-1].caption if self.captions and self.captions[-1] else self.words).append(data)


def parse(html: str | None) -> list[list]:
    p = _Sequence()
    p.feed(html or "")
    return p.finish()


_ITEM = pa.struct([("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame, key: str, html: str, out: str = "items") -> DataFrame:
    """pages with the column `out`: the HTML's text and media references in order."""

    @F.arrow_udf("array<struct<kind:string,text:string,digest:string,caption:string>>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "text", "digest", "caption"), x)) for x in parse(h)] for h in col.to_pylist()], pa.list_(_ITEM))

    bounded_batches(pages.sparkSession)
    return pages.withColumn(out, run(F.col(html)))


def interleave(pages: DataFrame, facts: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, row (number of the row within its key) and sequence: array of (position, kind, text, digest, caption, and the columns of facts), in document order.

    facts has a row for each digest: catalogue(media) for descriptions, with payload=True for the stored media themselves. A key that is
    called row or sequence keeps its name; the result's own column then has an underscore before it.
    """
    number, sequence = (f"_{n}" if n == key else n for n in ("row", "sequence"))
    rows = sequences(pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")), "_key", "_html", "_items").select("_key", "_items", F.monotonically_increasing_id().alias("_number"))
    named = stored(rows)  # row numbers must not change when a task runs again
    items = named.select("_key", "_number", F.posexplode_outer("_items").alias("_position", "_item"))
    resolved = items.join(facts.withColumnRenamed("digest", "_digest"), F.col("_item.digest") == F.col("_digest"), "left")
    item = F.struct(F.col("_position").alias("position"), *[F.col(f"_item.{n}").alias(n) for n in ("kind", "text", "digest", "caption")], *[F.col(c) for c in facts.columns if c != "digest"])
    whole = resolved.groupBy("_number").agg(F.first("_key").alias("_key"), F.array_sort(F.collect_list(F.when(F.col("_position").isNotNull(), item))).alias("_sequence"))
    return whole.select(F.col("_number").alias(number), F.col("_key").alias(key), F.col("_sequence").alias(sequence))


def media_report(docs: DataFrame) -> DataFrame:
    """One row per document: its payload as stored media, read back through the sequence that refers to it."""
    docs = docs.select("doc_id", "text")
    facts = stored(catalogue(media_table(docs)))  # so that Spark can split the join's side of a digest that many share
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    html = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    found = interleave(docs.select("doc_id", html.alias("html")), facts, "doc_id", "html")
    media = F.element_at(F.filter("sequence", lambda x: x["kind"] == "media"), 1)
    return found.select("doc_id", media.alias("m")).select("doc_id", "m.n_bytes", "m.f.*")
