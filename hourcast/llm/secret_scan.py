"""Operator 7: secret scans with inferred credential grammars.

Three plain patterns find labelled credentials. From a bounded sample of them
(``SAMPLE`` a kind, by hash order) a prefix tree over character classes is grown
per kind; states whose stopping and branching frequencies are compatible under
the Hoeffding bound are merged (red and blue states, folding determinised), which
leaves a probabilistic automaton. Every run of credential characters in
every text, as far as no plain span covers it, is a candidate: its log-likelihood under the automata is held
against a class-bigram model counted over all texts.

Spans are (kind, start, end) in code points, end exclusive. Kinds in order:
assign, access, hex, then format for what the automata add.

Cases: null text is empty and has no spans; texts are read whole; repeated rows
are scanned each; with no labelled credential in the corpus there is no automaton
and only the plain spans come; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import lean, sha256_hex, stored

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "api")
#: A candidate: a run of credential characters, or what plain spans leave of one, of at least the length
#: from which labelled credentials count.
LEAST = 8
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
#: Labelled credentials a kind that an automaton is inferred from.
SAMPLE = 400
#: Hoeffding confidence of a merge, floor of a transition's probability, bits that a candidate must win by.
ALPHA, FLOOR, BITS = 0.05, 1e-4, 30.0

CLASSES = 7
#: Bytes of a text whose class pairs are counted at once.
STRETCH = 1 << 20


def class_table() -> bytes:
    """Byte to character class: 1 digits, 2 a-f, 3 other lower case, 4 A-F, 5 other upper case, 6 symbols, 0 the rest."""
    table = bytearray(256)
    for n, letters in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-"), 1):
        for c in letters.encode():
            table[c] = n
    return bytes(table)


TABLE = class_table()


def plain_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the plain patterns, by start and kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs, or the pieces of them that no plain span covers; ``taken`` by start."""
    i, end = 0, 0  # spans before i start left of the run; end is the furthest end among them
    for m in RUN.finditer(text):
        at = m.start()
        while i < len(taken) and taken[i][0] < m.end():
            s, _, e, _ = taken[i]
            at = max(at, end)
            if s - at >= LEAST:
                yield at, s, text[at:s]
            end = max(end, e)
            i += 1
        at = max(at, end)
        if m.end() - at >= LEAST:
            yield at, m.end(), text[at : m.end()]


@dataclass
class State:
    seen: int = 0
    stop: int = 0
    to: dict[int, int] = field(default_factory=dict)
    went: dict[int, int] = field(default_factory=dict)


class Grammar:
    """A probabilistic automaton inferred from class strings by state merging."""

    def __init__(self, strings: list[bytes]):
        self.states = [State()]
        for s in strings:
            at = self.states[0]
            at.seen += 1
            for c in s:
                if c not in at.to:
                    at.to[c] = len(self.states)
                    self.states.append(State())
                at.went[c] = at.went.get(c, 0) + 1
                at = self.states[at.to[c]]
                at.seen += 1
            at.stop += 1
        self.merge()

    def apart(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if self.apart(x.stop, x.seen, y.stop, y.seen):
                return False
            for c in x.went.keys() | y.went.keys():
                if self.apart(x.went.get(c, 0), x.seen, y.went.get(c, 0), y.seen):
                    return False
                if c in x.to and c in y.to:
                    todo.append((x.to[c], y.to[c]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add the counts of the tree below ``blue`` to the automaton at ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            x.seen += y.seen
            x.stop += y.stop
            for c, n in y.went.items():
                x.went[c] = x.went.get(c, 0) + n
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(r, c, t) for r in red for c, t in sorted(self.states[r].to.items()) if t not in known]
            if not blue:
                break
            parent, c, state = max(blue, key=lambda x: (self.states[x[2]].seen, -x[2]))
            for r in red:
                if self.compatible(r, state):
                    self.states[parent].to[c] = r
                    self.fold(r, state)
                    break
            else:
                red.append(state)
        place = {s: i for i, s in enumerate(red)}
        self.table = []
        for s in red:
            x = self.states[s]
            total = x.seen + 1.0
            self.table.append(({c: (place[t], math.log2(max(FLOOR, x.went[c] / total))) for c, t in x.to.items()}, math.log2(max(FLOOR, x.stop / total))))
        del self.states

    def bits(self, string: bytes) -> float:
        """Log-likelihood of a class string; a class that a state has never seen costs ``FLOOR`` and stays."""
        at, total, lost = 0, 0.0, math.log2(FLOOR)
        for c in string:
            to, cost = self.table[at][0].get(c, (at, lost))
            at, total = to, total + cost
        return total + self.table[at][1]


@dataclass
class Model:
    grammars: list[Grammar]
    plain: list[list[float]]  # log2 of the class-bigram probabilities over all texts

    def wins(self, token: str) -> bool:
        """Whether some automaton explains the token better than ordinary text does, by ``BITS``."""
        if not self.grammars:
            return False
        s = token.encode().translate(TABLE)
        ordinary, at = 0.0, 0
        for c in [*s, 0]:
            ordinary += self.plain[at][c]
            at = c
        return any(g.bits(s) - ordinary >= BITS for g in self.grammars)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = plain_spans(text)
        more = [(s, 3, e) for s, e, token in candidates(text, base) if self.wins(token)]
        return sorted([(s, k, e) for s, k, e, _ in base] + more)


def class_pairs(text: str, found: list[tuple[int, int, int, str]]) -> np.ndarray:
    """Pairs of neighbouring classes of a text outside of its plain spans, counted by place in the table."""
    pieces, at = [], 0
    for s, _, e, _ in found:  # ordinary text is what no plain span holds
        pieces.append(text[at:s])
        at = max(at, e)
    c = " ".join(["", *pieces, text[at:], ""]).encode().translate(TABLE)
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    for i in range(0, len(c) - 1, STRETCH):
        part = np.frombuffer(c, np.uint8, min(STRETCH + 1, len(c) - i), i)
        pairs += np.bincount(part[:-1] * np.uint8(CLASSES) + part[1:], minlength=CLASSES * CLASSES)
    return pairs


def evidence(text: Column) -> Column:
    """Labelled credentials of each text; in a batch's first row the class pairs of the whole batch outside
    of them. Worked out once: a filter on a function that Spark takes for deterministic works it out a second
    time, on the rows that pass alone, in a second Python worker."""

    @F.pandas_udf("labels array<struct<kind:int,value:string>>, pairs array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in lean(texts):
            labels, pairs = [], np.zeros(CLASSES * CLASSES, np.int64)
            for t in part:
                t = t or ""
                found = plain_spans(t)
                labels.append([{"kind": k, "value": v} for _, k, _, v in found])
                pairs += class_pairs(t, found)
            yield pd.DataFrame({"labels": labels, "pairs": [pairs.tolist(), *[None] * (len(part) - 1)]})

    return run.asNondeterministic()(text)


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Automata from at most ``sample`` distinct labelled credentials a kind, pair counts from all texts.

    One pass over the texts; what it gives is small and cached nowhere: labels are distinct by
    hash order within a kind, pairs are summed by position.
    """
    seen = docs.select(evidence(F.col(text)).alias("e")).select("e.*").where("pairs is not null or size(labels) > 0")
    seen = stored(seen, "secret-evidence")
    pairs = np.zeros(CLASSES * CLASSES)
    for r in seen.where("pairs is not null").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        pairs[r["pos"]] = r["n"]
    table = pairs.reshape(CLASSES, CLASSES) + 0.5
    plain = np.log2(table / table.sum(1, keepdims=True)).tolist()
    labels = seen.select(F.explode("labels").alias("x")).select("x.kind", "x.value").distinct()
    grammars = []
    for kind in range(3):
        rows = labels.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        strings = [r["value"].encode().translate(TABLE) for r in rows]
        if strings:
            grammars.append(Grammar(strings))
    return Model(grammars, plain)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanner(model: Model):
    """Column function: text to array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lean(texts):
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in model.spans(t or "")] for t in part], dtype=object)

    return scan


def redactor(model: Model, mask: str = "[SECRET]"):
    """Column function: text with every span, overlapping ones as one, replaced by ``mask``; null stays null."""

    @F.pandas_udf("string")
    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lean(texts):
            out = []
            for t in part:
                pieces, at = [], 0
                for s, _, e in model.spans(t) if t else ():
                    if s >= at:
                        pieces += [t[at:s], mask]
                    at = max(at, e)
                out.append("".join([*pieces, t[at:]]) if pieces else t)
            yield pd.Series(out, dtype=object)

    return redact


def digest(model: Model):
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in lean(texts):
            rows = []
            for t in part:
                spans = model.spans(t or "")
                base = [x for x in spans if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), sha256_hex(listed(base).encode()), listed(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return digests


def scan_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every row."""
    return docs.select("doc_id", scanner(model)(F.col("text")).alias("spans"))


def digest_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    return docs.select("doc_id", digest(model)(F.col("text")).alias("x")).select("doc_id", "x.*")
