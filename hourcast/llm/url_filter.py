"""Operator 4: URL filters as a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit per automaton
state. A step over a byte shifts every rule at once (multiword Shift-And with
carry) and keeps the states whose wildcard accepts the byte. A batch of URLs
takes its steps together, one state row each.

Globs over the canonical form ``.host/path``: ``*`` is any run without ``/``,
``**`` any run, ``?`` one character but ``/``, everything else stands for itself.

Cases: a null url or one without ``://`` has an empty host and path and matches
no rule that names a host; non-ASCII characters are matched as UTF-8; long URLs
are read whole; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    #: What the result names; None for rules that only give a verdict.
    name: str | None = None


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with ``path``."""
    return Rule(f"*.{host}{path}**", verdict, host + path)


class Automaton:
    """Globs in one bit row. State j of a glob: its first j characters are matched."""

    def __init__(self, globs: list[str]):
        accept: list[list[tuple[int, int]]] = []  # per state the byte ranges that lead into it
        stay: list[str] = []  # per state "", "*" or "**"
        more: list[bool] = []  # per state whether bytes that continue a character stay in it
        self.first, self.last = [], []
        for g in globs:
            self.first.append(len(accept))
            accept.append([])
            stay.append("")
            more.append(False)
            i = 0
            while i < len(g):
                if g[i] == "*":
                    run = "**" if g.startswith("**", i) else "*"
                    stay[-1] = max(stay[-1], run)
                    i += len(run)
                elif g[i] == "?":
                    # one character: an ASCII byte, or a lead byte with the run of bytes that continue it
                    accept.append([(0, ord("/") - 1), (ord("/") + 1, 0x7F), (0xC0, 0xFF)])
                    stay.append("")
                    more.append(True)
                    i += 1
                else:
                    for b in g[i].encode():
                        accept.append([(b, b)])
                        stay.append("")
                        more.append(False)
                    i += 1
            self.last.append(len(accept) - 1)
        self.words = len(accept) // 64 + 1
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for s, (ranges, run, goes_on) in enumerate(zip(accept, stay, more)):
            word, bit = s // 64, np.uint64(1 << (s % 64))
            for lo, hi in ranges:
                self.step[lo : hi + 1, word] |= bit
            if goes_on:
                self.loop[0x80:0xC0, word] |= bit
            if run:
                self.loop[:, word] |= bit
                if run == "*":
                    self.loop[ord("/"), word] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for s in self.first:
            self.start[s // 64] |= np.uint64(1 << (s % 64))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (text, glob): whether the whole text fits the glob."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        buffer = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(self.start, (len(texts), 1))
        live, one, top = len(texts), np.uint64(1), np.uint64(63)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= at:
                live -= 1
            c = buffer[begin[:live] + at]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.zeros((len(texts), len(self.last)), bool)
        for g, s in enumerate(self.last):
            out[order, g] = (state[:, s // 64] >> np.uint64(s % 64)) & one == one
        return out


def judge(rules: list[Rule]):
    """Column function: canonical URL to (rule, verdict) of the rule that wins: named rules before
    unnamed ones, the longest name first, then the smallest; for unnamed rules the first that fits."""
    ranked = sorted(enumerate(rules), key=lambda x: (x[1].name is None, -len(x[1].name or ""), x[1].name or "", x[0]))
    ordered = [r for _, r in ranked]

    @F.pandas_udf("rule string, verdict string")
    def verdicts(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([r.glob for r in ordered])
        for part in urls:
            fits = automaton.matches([u.encode("utf-8") for u in part])
            found, first = fits.any(axis=1), fits.argmax(axis=1) if len(ordered) else np.zeros(len(part), int)
            won = [ordered[i] if f else None for f, i in zip(found.tolist(), first.tolist())]
            yield pd.DataFrame({"rule": [r.name if r else None for r in won], "verdict": [r.verdict if r else None for r in won]}, dtype=object)

    return verdicts


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row."""
    host, path = host_and_path(F.col(url))
    parted = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    judged = parted.withColumn("won", judge(rules)(F.concat(F.lit("."), "host", "path")))
    return judged.select(key, "host", "path", "won.rule", F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
