"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression over `host + path` (host lower-cased) with a verdict and the literal tokens that every URL it can fit
must hold. How often each of these tokens occurs is counted over all URLs; the rule is filed under its rarest one. A URL's tokens
then fetch the few candidate rules, and only their expressions run. Rules without a literal token are candidates for every URL, so
the index never loses a match.

Tokens are compared in lower case, so that rules of any case can be filed, too. Pattern rules are written with anchors, wildcards and
alternatives (`pattern_rules`); alternatives become rules of their own with tokens of their own, under the pattern's name.

Of the fitting rules the highest priority wins, then the longest rule, then the first in the alphabet. Host rules (`host/path`) come
before patterns. A URL that no rule fits gets the default verdict. Null URLs and URLs without `://` have an empty host and
path, and no rule fits them. Repeated rows are judged one by one; an input column that is called as an output column is replaced.

The number of rules is checked (`MAX_RULES`), as every executor holds the index. URLs are never shuffled: the counts are summed before
their exchange and only the rules' tokens are counted, so a hot host changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

MAX_RULES = 200_000
TOKEN = re.compile(r"[A-Za-z0-9]+")
SPLIT = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name: how the rule is reported; tokens: maximal alphanumeric runs of host and path that the expression can't do without."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    priority: int = 0


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, _, rest = text.partition("/")
    path = "/" + rest
    # The path's last run may go on in the URL unless something ends it, so it is no whole token.
    runs = [m for m in TOKEN.finditer(path) if m.end() < len(path)]
    tokens = tuple(TOKEN.findall(host)) + tuple(m[0] for m in runs)
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, 1)


def _alternatives(text: str) -> list[str]:
    """The texts that a pattern's groups `{a,b}` stand for; groups don't nest."""
    done = [""]
    for k, part in enumerate(re.split(r"\{([^{}]*)\}", text)):
        done = [d + x for d in done for x in (part.split(",") if k % 2 else [part])]
    return done


def pattern_rules(text: str, verdict: str) -> tuple[Rule, ...]:
    """A pattern over host and path in any case (A-Z): `|` first is the host's start and last the path's end, `*` any run, `^` one character
    that is no letter or digit (first and last: or the end of the text), `{a,b}` alternatives. Everything else stands for itself."""
    out = []
    for one in _alternatives(text):
        body, first, last = one, one.startswith("|"), len(one) > 1 and one.endswith("|")
        body = body[first : len(body) - last]
        regex, at_start, at_end = [], first or body.startswith("^"), last or body.endswith("^")
        for k, c in enumerate(body):
            if c == "^" and k == 0 and not first:
                regex.append("(?<![A-Za-z0-9])")
            elif c == "^" and k == len(body) - 1 and not last:
                regex.append("(?![A-Za-z0-9])")
            else:
                regex.append({"*": ".*", "^": "[^A-Za-z0-9]"}.get(c) or re.escape(c))
        # a run that a wildcard or an open end of the pattern touches may go on in the URL, so it is no whole token
        whole = lambda m: (body[m.start() - 1] != "*" if m.start() else at_start) and (body[m.end()] != "*" if m.end() < len(body) else at_end)  # noqa: B023, E731
        tokens = tuple(m[0].lower() for m in TOKEN.finditer(body) if whole(m))
        out.append(Rule(text, verdict, rf"(?ais){'^' if first else ''}{''.join(regex)}{chr(92) + 'Z' if last else ''}", tokens, 0))
    return tuple(out)


#: Fixed rules of the filter.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERNS = (
    "^{casino,casinos}^", "^{porn,porno,xxx}^", "^{viagra,cialis,pills}^", "^{betting,bets}^", "^{escort,escorts}^", "^{warez,torrent,torrents}^", "^payday^",
    "|{ads,adserver,track}.*/", "^banner*.{gif,js}|", "^wp-login.php^", "^free-*-download^",
)
RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(r for p in PATTERNS for r in pattern_rules(p, "block"))


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.partition("://")[2], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of the rules' literal tokens; a row for each such token reaches the driver."""
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    if not wanted:
        return {}
    host = F.expr("translate(substring_index(substring_index(substring_index(u, '/', 1), '?', 1), '#', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    rest = pages.where(F.col(url).contains("://")).select(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)").alias("u"))
    whole = rest.select(F.concat(host, F.expr("substring(substring_index(substring_index(u, '?', 1), '#', 1), length(substring_index(substring_index(substring_index(u, '/', 1), '?', 1), '#', 1)) + 1)")).alias("u"))
    tokens = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")  # those of MAX_RULES rules at most
    each = whole.select(F.explode(F.array_distinct(F.transform(F.split("u", SPLIT), F.lower))).alias("token")).join(F.broadcast(tokens), "token")
    return {r[0]: r[1] for r in each.groupBy("token").count().collect()}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by: dict[str, list[tuple[tuple, Rule, re.Pattern]]] = {}
        for r in rules:
            key = min(map(str.lower, r.tokens), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            self.by.setdefault(key, []).append(((-r.priority, -len(r.name), r.name), r, re.compile(r.regex)))
        for found in self.by.values():
            found.sort(key=lambda x: x[0])

    def best(self, host: str, path: str) -> tuple[Rule | None, int]:
        """The winning rule, and how many expressions ran."""
        if not host:
            return None, 0
        whole, ran, best = host + path, 0, None
        for token in {"", *(t.lower() for t in TOKEN.findall(whole))}:
            for order, rule, regex in self.by.get(token, ()):
                if best is not None and order >= best[0]:
                    break
                ran += 1
                if regex.search(whole):
                    best = (order, rule)
                    break
        return best and best[1], ran


FIELDS = [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("tried", pa.int32())]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", default: str = "allow", out: str = "judged") -> DataFrame:
    """pages with the struct column `out`: host, path, rule (a host rule's name or null), verdict, pattern (any rule's name or null), tried."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an executor may hold {MAX_RULES}")
    bounded_batches(pages.sparkSession)
    index = pages.sparkSession.sparkContext.broadcast((rules, token_counts(pages, rules, url)))

    @F.arrow_udf("struct<host:string,path:string,rule:string,verdict:string,pattern:string,tried:int>")
    def run(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Index(*index.value)
        for col in cols:
            rows = []
            for u in col.to_pylist():
                host, path = host_and_path(u)
                rule, tried = held.best(host, path)
                rows.append((host, path, rule.name if rule and rule.priority else None, rule.verdict if rule else default, rule.name if rule else None, tried))
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows) if rows else [[]] * len(FIELDS), FIELDS)], names=[n for n, _ in FIELDS])

    return pages.withColumn(out, run(F.col(url)))


def url_report(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, the host rule and the verdict."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


_SQL_WORDS = "(^|[^a-z0-9])(casinos?|porno?|xxx|viagra|cialis|pills|betting|bets|escorts?|warez|torrents?|payday|wp-login[.]php|free-.*-download)([^a-z0-9]|$)"
_SQL_PATTERNS = rf"regexp_matches(lowered, '{_SQL_WORDS}', 's') OR regexp_matches(lowered, '^(ads|adserver|track)[.].*/', 's') OR regexp_matches(lowered, '(^|[^a-z0-9])banner.*[.](gif|js)$', 's')"
_SQL_RULES = ", ".join(f"('{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in HOST_RULES)
URL_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), parts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
    translate(raw_host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (VALUES {_SQL_RULES}
), fits AS (
  SELECT p.page_id AS id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY 1
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN host <> '' AND ({_SQL_PATTERNS}) THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits ON page_id = id
"""
