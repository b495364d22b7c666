"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression over the URL (A-Z lower-cased, ASCII
classes).  A pattern's alternatives, options and small character sets are written
out as branches; the whole literal tokens that any match of a branch must contain
are read off it, and the rule is filed, for each branch, under the one that is
rarest in the URL column.  A URL's tokens fetch the rules filed under them, and
only those expressions run; rules with a branch without a literal token (or with
syntax that is not read) run on every URL.  Host/path rules are looked up by the
host's suffixes and come before the patterns.

Rules may be lists or tables.  They are taken in blocks of at most
``block_bytes``, each of which is broadcast; a URL's result is the best over all blocks,
in one pass over the table for all verdicts.

Cases: a null URL, or one without ``://``, has an empty host and path, no rule
and the verdict ``allow`` unless a pattern matches it.  Of host rules of equal length
the last in the order of strings wins; of patterns, the first in the list.  Repeated
rows are judged one by one; a very long URL is judged whole; an empty table gives an
empty result; a column that clashes with the result is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import BROADCAST_BYTES, importable, table

_TOKEN = re.compile(r"[a-z0-9_]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class HostRule(NamedTuple):
    verdict: str  #: allow or block
    text: str  #: host and path, as in ``example.com/en/7``

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


HOST_RULES = (
    HostRule("block", "com/en/"),
    HostRule("allow", "example.com/en/7"),
    HostRule("allow", "net/de/"),
    HostRule("block", "example.net/de/8"),
    HostRule("block", "org/es/"),
)

PATTERNS = (
    r"\bcasino(?:-win)?\b",
    r"\bfree-(?:bets|spins|slots)\b",
    r"\bcheap-(?:pills|meds)\b",
    r"\bads?-(?:track|serve)\b",
    r"\bspam-farm\b",
    r"\badult-[a-z]+\b",
    r"[/.]doubleclick\.",
    r"/(?:banner|popup)s?/\d+",
    r"[?&]affiliate=\w+",
)


#: Branches that a pattern is written out into at most; one with more runs on every URL.
BRANCHES = 64
_EDGE, _ANY = "edge", "any"  #: beside literal characters: a place where a token ends, and unknown text


class _Reader:
    """Writes a pattern out as branches of literal characters, edges and unknown text."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError("the pattern ends early")
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> list[list[str]]:
        out = self.sequence()
        while self.peek() == "|":
            self.at += 1
            out = out + self.sequence()
        return out

    def sequence(self) -> list[list[str]]:
        out: list[list[str]] = [[]]
        while self.peek() not in ("", "|", ")"):
            part = self.repeated(self.atom())
            out = [a + b for a in out for b in part]
            if len(out) > BRANCHES:
                raise ValueError("too many branches")
        return out

    def repeated(self, part: list[list[str]]) -> list[list[str]]:
        sign = self.peek()
        if sign == "?":
            part = [*part, []]
        elif sign == "*":
            part = [[_ANY]]
        elif sign == "+":
            part = [[*x, _ANY] for x in part]
        elif sign == "{" and (m := re.match(r"\{\d*,?\d*\}", self.text[self.at :])):
            part, self.at = [[_ANY]], self.at + m.end() - 1
        else:
            return part
        self.at += 1
        if self.peek() in ("?", "+"):  # lazy or possessive: the same texts
            self.at += 1
        return part

    def literal(self, c: str) -> str:
        return c if _TOKEN.fullmatch(c) else _ANY if c.isalnum() else _EDGE

    def atom(self) -> list[list[str]]:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                if self.peek(2) != "?:":
                    raise ValueError("a group that is not read")
                self.at += 2
            out = self.choice()
            if self.take() != ")":
                raise ValueError("an open group")
            return out
        if c == "[":
            return self.members()
        if c == "\\":
            return [[self.escaped()]]
        return [[_EDGE if c in "^$" else _ANY if c == "." else self.literal(c)]]

    def escaped(self) -> str:
        c = self.take()
        if c in "bsWAZ":
            return _EDGE
        if c in "dwDSB":
            return _ANY
        if c.isalnum():
            raise ValueError("an escape that is not read")
        return self.literal(c)

    def members(self) -> list[list[str]]:
        inside = self.peek() != "^"
        self.at += not inside
        found: list[str] = []
        while True:
            c = self.take()
            if c == "]" and found:
                break
            found.append(self.escaped() if c == "\\" else self.literal(c))
            if self.peek() == "-" and self.peek(2) != "-]":
                self.at += 1
                end = self.take()
                if end == "\\":
                    self.take()
                found.append(_ANY)
        if not inside or _ANY in found:
            return [[_ANY]]
        return [[x] for x in sorted(set(found))]


def branch_tokens(pattern: str) -> list[list[str]]:
    """For each branch, the whole ``[a-z0-9_]+`` tokens that any match must contain; one empty branch if the pattern is not read."""
    reader = _Reader(pattern)
    try:
        branches = reader.choice()
        if reader.at < len(pattern):
            return [[]]
    except ValueError:
        return [[]]
    out = []
    for items in branches:
        found, i = [], 0
        while i < len(items):
            j = i
            while j < len(items) and len(items[j]) == 1:
                j += 1
            if j > i and i and items[i - 1] == _EDGE and j < len(items) and items[j] == _EDGE:
                found.append("".join(items[i:j]))
            i = max(j, i + 1)
        out.append(found)
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens that any match of ``pattern`` must contain, whichever branch matches."""
    first, *rest = branch_tokens(pattern)
    return [t for t in first if all(t in other for other in rest)]


class UrlIndex:
    """A block of rules by token and by host; small enough to be broadcast (see the caller)."""

    def __init__(self, patterns: Iterable[str], host_rules: Iterable[HostRule], counts: dict[str, int]):
        self.patterns = list(patterns)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.untokened: list[int] = []
        for k, pattern in enumerate(self.patterns):
            branches = branch_tokens(pattern)
            if all(branches):
                for token in sorted({min(tokens, key=lambda t: (counts.get(t, 0), t)) for tokens in branches}):
                    self.by_token[token].append(k)
            else:
                self.untokened.append(k)
        self.by_host: dict[str, list[HostRule]] = defaultdict(list)
        for rule in host_rules:
            self.by_host[rule.host].append(rule)
        self._compiled: list[re.Pattern] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None}

    def host_rule(self, host: str, path: str) -> HostRule | None:
        best, rest = None, host
        while rest:
            for rule in self.by_host.get(rest, ()):
                if path.startswith(rule.path) and (best is None or (len(rule.text), rule.text) > (len(best.text), best.text)):
                    best = rule
            rest = rest.partition(".")[2]
        return best

    def pattern(self, url: str) -> str | None:
        """The first (by place in the list) candidate rule that matches."""
        if self._compiled is None:
            self._compiled = [re.compile(p, re.ASCII) for p in self.patterns]
        url = url.translate(_LOWER)
        candidates = set(self.untokened)
        for token in set(_TOKEN.findall(url)):
            candidates.update(self.by_token.get(token, ()))
        return next((self.patterns[k] for k in sorted(candidates) if self._compiled[k].search(url)), None)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        rule, pattern = self.host_rule(host, path), self.pattern(url or "")
        return host, path, rule and rule.text, rule.verdict if rule else "block" if pattern else "allow", pattern


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the docstring of the module has them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def token_counts(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of ``tokens``, over the whole table; the result has one entry a token."""
    if not tokens:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for token in tokens.intersection(_TOKEN.findall((value or "").translate(_LOWER))):
                    total[token] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = pages.select(F.col(url)).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}


def _blocks(rules: Iterable, size: Callable[[Any], int], most: int) -> Iterator[list]:
    block, held = [], 0
    for rule in rules:
        if block and held + size(rule) > most:
            yield block
            block, held = [], 0
        block.append(rule)
        held += size(rule)
    if block:
        yield block


def filter_urls(
    pages: DataFrame, patterns: Iterable[str] | DataFrame = PATTERNS, host_rules: Iterable[HostRule] | DataFrame = HOST_RULES, url: str = "url", out: str = "url_verdict", block_bytes: int = BROADCAST_BYTES // 4
) -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, rule, verdict, pattern.

    ``patterns`` may be a table (place, pattern), ``host_rules`` one of (verdict, text).
    """
    spark = pages.sparkSession
    importable(spark)
    if isinstance(patterns, DataFrame):
        patterns = (r.pattern for r in patterns.orderBy("place").toLocalIterator())
    if isinstance(host_rules, DataFrame):
        host_rules = (HostRule(r.verdict, r.text) for r in host_rules.toLocalIterator())
    # A rule costs a few hundred bytes beside its text.
    blocks = [(b, []) for b in _blocks(patterns, lambda p: len(p) + 200, block_bytes)] + [([], b) for b in _blocks(host_rules, lambda r: len(r.text) + 200, block_bytes)]
    if len(blocks) == 2 and blocks[0][0] and blocks[1][1]:
        blocks = [(blocks[0][0], blocks[1][1])]
    kind = "struct<host:string,path:string,rule:string,verdict:string,pattern:string>"

    def judged(shared) -> Column:
        @F.arrow_udf(kind)
        def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            rules = shared.value
            for part in parts:
                columns = list(zip(*map(rules.judge, part.to_pylist()), strict=True)) or [()] * 5
                yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "path", "rule", "verdict", "pattern"])

        return judge(F.col(url))

    names, asked = [], pages
    for number, (some, hosts) in enumerate(blocks or [([], [])]):
        index = UrlIndex(some, hosts, token_counts(pages, {t for p in some for tokens in branch_tokens(p) for t in tokens}, url))
        names.append(f"__{out}_{number}")
        asked = asked.withColumn(names[-1], judged(spark.sparkContext.broadcast(index)))
    if len(names) == 1:
        return asked.withColumn(out, F.col(names[0])).drop(*names)
    first = F.col(names[0])
    best = F.greatest(*(F.when(F.col(f"{n}.rule").isNotNull(), F.struct(F.length(F.col(f"{n}.rule")).alias("size"), F.col(f"{n}.rule").alias("rule"), F.col(f"{n}.verdict").alias("verdict"))) for n in names))
    pattern = F.coalesce(*(F.col(f"{n}.pattern") for n in names))
    verdict = F.coalesce(best["verdict"], F.when(pattern.isNotNull(), "block").otherwise("allow"))
    return asked.withColumn(out, F.struct(first["host"].alias("host"), first["path"].alias("path"), best["rule"].alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))).drop(*names)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, out="v").select("page_id", "v.host", "v.path", "v.rule", "v.verdict", "v.pattern")


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{r.verdict}', '{r.text}', '{r.host}', '{r.path}')" for r in HOST_RULES)
    patterns = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{p}'" for p in PATTERNS) + " END"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
             CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
      FROM pages),
    split AS (
      SELECT page_id, low, translate(regexp_extract(rest, '^([^/]*)', 1), '{upper}', '{lower}') AS host,
             CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
      FROM parts),
    rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
    best AS (
      SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY page_id)
    SELECT s.page_id, s.host, s.path, b.rule, {patterns} AS pattern,
           coalesce(b.verdict, CASE WHEN {patterns} IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM split s LEFT JOIN best b USING (page_id)"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE_SQL = {"op9_url_filter": _sql()}
