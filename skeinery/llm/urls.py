"""URL filters by a bit-parallel automaton over wildcard rules.

All patterns are packed into one row of 64-bit words, one bit for each place in
a pattern.  A batch of URLs moves one symbol at a time; a step shifts every
state word, keeps what the symbol's mask allows and what a ``*`` holds in place.
The state of all patterns over all URLs of a batch is thus one small matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Stands between host and path; no byte has it, so a path can't pass for a host.
EDGE = 256
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits a host with all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """``*``: any run of symbols, ``?``: any one; host and path each match whole."""

    host: str
    path: str
    verdict: str


def _symbols(glob: str, literal: bool = False) -> list:
    return [b if literal or b not in b"*?" else chr(b) for b in glob.encode()]


class Automaton:
    """Shift-And over many wildcard patterns at once."""

    def __init__(self, patterns: list[list]):
        """patterns: lists of symbols (0 to 255, EDGE, '?' and '*')."""
        places, starts, finals, loops = [], [], [], []
        for p in patterns:
            starts.append(len(places))
            places.append(None)  # the state before any symbol
            for s in p:
                if s == "*":
                    loops.append(len(places) - 1)
                else:
                    places.append(s)
            finals.append(len(places) - 1)
        self.n_words = max(1, -(-len(places) // 64))
        self.finals = finals
        self.start = self._mask(starts)
        self.loop = self._mask(loops)
        self.allow = np.zeros((257, self.n_words), np.uint64)
        for i, s in enumerate(places):
            if s == "?":
                self.allow[:256, i // 64] |= np.uint64(1 << i % 64)
            elif s is not None:
                self.allow[s, i // 64] |= np.uint64(1 << i % 64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def run(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each string, a column for each pattern: does it match whole?"""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        at, left = offsets[:-1][order], lengths[order]
        state = np.broadcast_to(self.start, (len(left), self.n_words)).copy()
        one, top = np.uint64(1), np.uint64(63)
        live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for t, n in enumerate(live):
            d = state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = (moved & self.allow[symbols[at[:n] + t]]) | (d & self.loop)
        out = np.empty((len(left), len(self.finals)), bool)
        for k, f in enumerate(self.finals):
            out[order, k] = (state[:, f // 64] >> np.uint64(f % 64)) & one == one
        return out


def compiled(rules: list[Rule], globs: list[Glob]) -> Automaton:
    """Canonical URL: a dot, the host, EDGE, the path."""
    pats = [["*", *_symbols("." + r.host, True), EDGE, *_symbols(r.path, True), "*"] for r in rules]
    pats += [[ord("."), *_symbols(g.host), EDGE, *_symbols(g.path)] for g in globs]
    return Automaton(pats)


def canonical(hosts: pd.Series, paths: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    h, p = [x.encode() for x in hosts], [x.encode() for x in paths]
    nh, n_p = np.fromiter(map(len, h), np.int64, len(h)), np.fromiter(map(len, p), np.int64, len(p))
    off = np.concatenate([[0], np.cumsum(nh + n_p + 2)])
    data = np.frombuffer(b"".join(x for a, b in zip(h, p, strict=True) for x in (b".", a, b"\0", b)), np.uint8).astype(np.int16)
    data[off[:-1] + nh + 1] = EDGE
    return data, off


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or no ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules: list[Rule], globs: list[Glob], url: str = "url", default: str = ALLOW) -> DataFrame:
    """Adds host, path, rule (null: none fits) and verdict to every row.

    The longest fitting rule decides (equal length: the first given); where none
    fits, the first fitting glob, then ``default``.  Null, empty and malformed
    URLs have empty host and path and get the default unless a glob fits.
    Repeated rows are judged each; columns named like the new ones are replaced.
    """
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))

    @F.pandas_udf("int")
    def winner(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        hits = compiled(rules, globs).run(*canonical(hosts, paths))
        hits = hits[:, [*rank, *range(len(rules), len(rules) + len(globs))]]
        return pd.Series(np.where(hits.any(axis=1), hits.argmax(axis=1), -1).astype("int32"))

    host, path = host_path(F.col(url))
    out = df.withColumns({"host": host, "path": path})
    k = winner("host", "path")
    names = F.array(*[F.lit(rules[i].name) for i in rank], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(x.verdict) for x in [*(rules[i] for i in rank), *globs]], F.lit(default))
    out = out.withColumn("rule", k)
    n = F.col("rule")
    return out.withColumn("verdict", F.get(verdicts, F.when(n < 0, len(rules) + len(globs)).otherwise(n))).withColumn(
        "rule", F.get(names, F.when((n < 0) | (n >= len(rules)), len(rules)).otherwise(n))
    )


#: The production rules and globs.
RULES = [
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
]
GLOBS = [Glob("ads.*", "*", BLOCK), Glob("*", "*/ads/*", BLOCK)]
