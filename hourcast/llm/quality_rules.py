"""Operator 1: quality rules as a learned decision list.

Sequential covering over labelled statistics: a conjunction of thresholds grows
on two thirds of the remaining labelled rows by information gain, is pruned on
the last third to the prefix with the best precision, and is kept if it is
precise enough there; the rows that it covers are removed and the next one grows.
The list is emitted as one ordered Spark conditional expression (CASE WHEN).

Learning sees at most ``SAMPLE`` labelled rows, by hash order of doc_id; the rules
apply to every row.

Cases: null or empty text has zero counts and fails the base rule; rows with null
label or id teach nothing; an id labelled or stored twice teaches once per pair;
without labels the list is empty and only the base rule speaks; texts are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.features import NAMES, RATES, measured, with_rates

SAMPLE = 20_000
#: Thresholds tried a statistic, rules in a list, conditions in a rule, precision and cover that a rule needs.
CUTS, RULES, CONDITIONS, PRECISION, COVER = 48, 16, 4, 0.95, 3


@dataclass(frozen=True)
class Condition:
    name: str
    op: str  # "<=" or ">"
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] <= self.value if self.op == "<=" else x[self.name] > self.value

    def column(self) -> Column:
        c = F.col(self.name)
        return c <= self.value if self.op == "<=" else c > self.value


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: bool

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, start: set[str]) -> list[Condition]:
    """Add the threshold with the most information gain until no kept row is covered; the first one
    is on a statistic of ``start``."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        before, best, found = np.log2(p / (p + n)), 1e-9, None
        for name, values in x.items():
            if not rule and name not in start:
                continue
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, below = v[order], np.cumsum(b[order])
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS)))
            # halfway between neighbours: a threshold that copies of a learned row do not sit on
            at = np.searchsorted(v, cuts, side="right")
            at = np.unique(at[(at > 0) & (at < len(v))])
            value = (v[at - 1] + v[at]) / 2
            p_low, all_low = below[at - 1], at
            for op, pp, total in (("<=", p_low, all_low), (">", p - p_low, len(v) - all_low)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(total, 1)) - before), 0)
                if len(gain) and gain.max() > best:
                    i = int(gain.argmax())
                    best, found = gain[i], Condition(name, op, float(value[i]))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], int, int]:
    """The prefix with the best (p - n) / (p + n) on unseen rows, the shortest of equals; p and n there."""
    best = ([], 0, 0, -2.0)
    for size in range(1, len(rule) + 1):
        inside = Rule(tuple(rule[:size]), False).holds(x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best[3]:
            best = (rule[:size], p, n, value)
    return best[:3]


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Rules that reject, in order; ``fold`` true marks the rows that rules are pruned on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    first = dict(x)  # statistics that a rule may begin with: one that led to an imprecise rule is set aside
    while first and len(rules) < RULES and (left & bad & ~fold).any():
        part = lambda at: ({k: v[at] for k, v in x.items()}, bad[at])
        grown = grow(*part(left & ~fold), start=set(first))
        if not grown:
            break
        rule, p, n = prune(grown, *part(left & fold))
        if p < COVER or p < PRECISION * (p + n):
            del first[grown[0].name]
            continue
        rules.append(Rule(tuple(rule), False))
        left &= ~rules[-1].holds(x)
        first = dict(x)
    return rules


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, rates) of every row."""
    return with_rates(docs.select("doc_id", measured(F.col("text")).alias("x")).select("doc_id", "x.*"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Texts of at most ``sample`` labelled ids; the ids, a bounded list, are broadcast."""
    taught = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")


def bounded(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of (doc_id, bad, rates), whatever number one id has; equal rows of an id count once."""
    rows = rows.select("doc_id", "bad", *RATES).distinct()
    return rows.orderBy(F.xxhash64("doc_id", *RATES), "doc_id", "bad", *RATES).limit(sample)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    rows = labelled(docs, labels, sample)
    rows = with_rates(rows.select("doc_id", "bad", measured(F.col("text")).alias("x")).select("doc_id", "bad", "x.*"))
    rows = bounded(rows, sample).select(*RATES, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("fold")).toPandas()
    # toPandas has no order: sort, so that equal inputs give equal rules
    rows = rows.sort_values([*RATES, "bad", "fold"], ignore_index=True)
    return decision_list({n: rows[n].to_numpy(float) for n in RATES}, rows["bad"].to_numpy(bool), rows["fold"].to_numpy(bool))


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the statistics: the first rule that holds decides, else keep."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(r.verdict)) if out is None else out.when(r.column(), F.lit(r.verdict))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = statistics(docs).withColumn("base_failed", failed)
    return rows.select("doc_id", *NAMES[:5], "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
