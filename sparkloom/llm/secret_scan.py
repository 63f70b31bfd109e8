"""Secret scans with multipart credential linking.

Three base patterns (assignments, access keys, hex runs) are reported as they stand. Beyond them the scanner collects weak
parts: access identifiers, unlabelled secrets and endpoints. A weak part alone proves nothing; it is reported only when the
parts that make it a credential stand near it: an interval join, within a scope (a run of lines without an empty line), of the
parts' spans widened by `window` code points.

Nulls count as the empty text and give no spans; an empty table gives an empty result; repeated rows are judged one by one; an
input column that is called as the output column is replaced. The join is a sorted sweep within one text: its memory is bounded
by that text, and no shuffle takes place, so a hot source or group of copies changes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

#: Weak parts: what each may be, by role.
WEAK_ID = re.compile(r"""(?ai)(?:client_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"(?a)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://[^\s\"'<>]+")
SCOPE_END = re.compile(r"\n[\x20\t]*\n")

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches, leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _varied(word: str) -> bool:
    """Random-looking: upper case, lower case and digits mixed."""
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


class _Intervals:
    """Intervals, which may overlap or hold each other, for probes of what lies near."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach = list(accumulate((e for _, e in self.spans), max))  # the furthest end so far

    def near(self, start: int, end: int, window: int, scope: tuple[int, int]) -> bool:
        """Whether another interval inside the scope lies within `window` of (start, end)."""
        k, low = bisect_right(self.starts, end + window) - 1, bisect_left(self.starts, scope[0])
        while k >= low and self.reach[k] >= start - window:
            s, e = self.spans[k]
            if e >= start - window and e <= scope[1] and (s, e) != (start, end):
                return True
            k -= 1
        return False

    def overlap(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.reach[k] > start


def scan(text: str, window: int = 400) -> list[tuple[str, int, int, bool]]:
    """All spans of a text as (kind, start, end, base), by start and then kind."""
    base = base_spans(text)
    out = [(*x, True) for x in base]
    taken = _Intervals([(s, e) for _, s, e in base])
    free = lambda s, e: not taken.overlap(s, e)
    weak = {"weak_id": [], "weak_secret": [], "endpoint": []}
    if ":" in text or "=" in text:
        weak["weak_id"] = [m.span() for m in WEAK_ID.finditer(text) if free(*m.span())]
    if "://" in text:
        weak["endpoint"] = [m.span() for m in ENDPOINT.finditer(text) if free(*m.span())]
    if base or any(weak.values()):  # unlabelled secrets count only beside something else
        weak["weak_secret"] = [m.span() for m in WEAK_SECRET.finditer(text) if _varied(m[0]) and free(*m.span())]
    if any(weak.values()):
        cuts = [0, *(m.end() for m in SCOPE_END.finditer(text)), len(text)]
        of = lambda *kinds: [(s, e) for k, s, e in base if k in kinds]
        ids = _Intervals(of("access") + weak["weak_id"])
        secrets = _Intervals(of("assign", "hex") + weak["weak_secret"])
        for kind, needed in (("weak_id", (secrets,)), ("weak_secret", (ids,)), ("endpoint", (ids, secrets))):
            for s, e in weak[kind]:
                k = bisect_left(cuts, s + 1)
                scope = (cuts[k - 1], cuts[min(k, len(cuts) - 1)])
                if all(x.near(s, e, window, scope) for x in needed):
                    out.append((kind, s, e, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "spans", window: int = 400) -> DataFrame:
    """docs with the column `out`: every secret's span, in code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def spans(col: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "base"), x)) for x in scan(t or "", window)] for t in col.to_pylist()], _ARROW)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, spans.asNondeterministic()(F.col(text)))  # so that no filter on the spans scans the texts a second time


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas, in the spans' order."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans and all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
