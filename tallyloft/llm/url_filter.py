"""URL filters as a bit-parallel wildcard automaton.

Every rule is a glob over a canonical URL (host in lower case, then path). All globs are packed
into one bit vector of as many 64-bit words as they need, and an extended Shift-And runs over the
characters of all URLs of a batch at once: one step shifts every state, keeps those whose position
accepts the character, and keeps the states that stand on a wildcard accepting it.

Globs: ``*`` is any run of characters but ``/``, ``**`` any run at all, ``?`` one character but ``/``;
a backslash takes the next character as it is. The longest rule that matches decides; of equally
long ones a blocking rule, then the smaller text. URLs that are null, or have no ``://``, have empty
host and path and get the default verdict. Repeated rows and further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """One rule: what a report calls it, its globs (any of them matches), and its verdict."""

    name: str
    globs: tuple[str, ...]
    verdict: str


def site_rule(text: str, verdict: str) -> Rule:
    """A rule ``host/path-prefix``: the host and all its subdomains, paths that start with the prefix."""
    escaped = "".join("\\" + c if c in "*?\\" else c for c in text)
    return Rule(text, (f"{escaped}**", f"*.{escaped}**"), verdict)


class GlobAutomaton:
    """All globs of a rule set in multiword Shift-And masks."""

    def __init__(self, rules: list[Rule]):
        order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict != "block", rules[i].name))
        self.rules = [rules[i] for i in order]
        accept, loops, first, ends = [], [], [], []
        for number, rule in enumerate(self.rules):
            for glob in rule.globs:
                chars, runs = self._parse(glob)
                # Position 0 of a glob is its start, before any character; position i its i-th character.
                first.append(len(accept))
                accept += [None, *chars]
                loops += runs
                ends.append((len(accept) - 1, number))
        self.words = max(1, -(-len(accept) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for at, allowed in enumerate(accept):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            for byte in range(256):
                if allowed is not None and (byte == allowed or (allowed == -1 and byte != SLASH)):
                    self.step[byte, word] |= bit
                if loops[at] == 2 or (loops[at] == 1 and byte != SLASH):
                    self.stay[byte, word] |= bit
        for at in first:
            self.start[at // 64] |= np.uint64(1 << (at % 64))
        self.ends = ends

    @staticmethod
    def _parse(glob: str) -> tuple[list[int], list[int]]:
        """The bytes (-1: any but a slash) and, for each position with the start's, its wildcard: 0, 1 for *, 2 for **."""
        chars: list[int] = []
        runs = [0]
        data = glob.encode()
        i = 0
        while i < len(data):
            c = chr(data[i])
            if c == "*":
                runs[-1] = max(runs[-1], 2 if data[i + 1 : i + 2] == b"*" else 1)
                i += 1
                continue
            if c == "\\" and i + 1 < len(data):
                i += 1
                chars.append(data[i])
            else:
                chars.append(-1 if c == "?" else data[i])
            runs.append(0)
            i += 1
        return chars, runs

    def match(self, urls: list[bytes]) -> np.ndarray:
        """For each URL the index of the deciding rule in ``rules``, or -1."""
        n = len(urls)
        best = np.full(n, -1, np.int64)
        if not n or not self.rules:
            return best
        length = np.fromiter((len(u) for u in urls), np.int64, n)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        buffer = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        offset = np.concatenate(([0], np.cumsum(length)[:-1])) if n else length
        state = np.tile(self.start, (n, 1))
        rows = np.arange(n)  # rows whose automaton still lives; the rest can match no more
        final = np.zeros((n, self.words), np.uint64)
        t = 0
        while len(rows):
            live = int(np.searchsorted(-length[rows], -t, side="left"))  # those longer than t
            final[rows[live:]] = state[live:]
            rows, state = rows[:live], state[:live]
            if not live:
                break
            byte = buffer[offset[rows] + t]
            carry = state >> np.uint64(63)
            shifted = state << np.uint64(1)
            shifted[:, 1:] |= carry[:, :-1]
            state = (shifted & self.step[byte]) | (state & self.stay[byte])
            t += 1
            if t % 8 == 0:
                alive = state.any(axis=1)
                rows, state = rows[alive], state[alive]
        for at, number in reversed(self.ends):
            hit = (final[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) > 0
            best[order[hit]] = number
        return best


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` for each row, in one pass without a shuffle.

    Columns of ``df`` with these names are replaced. Batches bound the memory; a URL of any length is read whole.
    """
    added = ["host", "path", "rule", "verdict"]
    kept = df.drop(*(c for c in added if c != url))
    split = kept.withColumns({"host": host_of(url), "path": path_of(url)}) if url not in added else df.select("*", F.col(url).alias("__url")).withColumns({"host": host_of("__url"), "path": path_of("__url")}).drop("__url", *(c for c in ("rule", "verdict") if c in df.columns))
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    automaton = GlobAutomaton(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([r.name for r in automaton.rules] + [None], object)
        verdicts = np.array([r.verdict for r in automaton.rules] + [default], object)
        for batch in batches:
            found = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(batch["host"], batch["path"])])
            yield batch.assign(rule=names[found], verdict=verdicts[found])

    return split.mapInPandas(judge, schema)
