"""Operator 9: a quality classifier with hierarchical empirical Bayes.

A logistic model over text statistics, fitted on at most ``SAMPLE`` labelled rows,
gives each document its own evidence. Sites (``source``) and paths in them
(``source`` and ``lang``, unless other columns are named) pool the evidence of all
their documents: a path's rate of good documents is a Beta posterior around its
host's, a host's around the corpus's, with prior strengths fitted by moments from
the grouped rates, so sparse sites shrink to the global prior. A document's score
adds its own log odds to the shift of its path's posterior against the corpus.

Groups are sums with partial aggregation, so a source that holds a third of the
rows costs one row a task.

Cases: null text counts as empty and is rejected by its own evidence (probability
0, weight as any other); null source or lang are groups of their own; rows with
null label or id teach nothing; without labels of both kinds every document is
kept; an empty table gives no rows; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import stored
from hourcast.llm.features import RATES, measured, with_rates
from hourcast.llm.quality_rules import bounded, labelled

SAMPLE = 20_000
#: Documents stay from this probability on; below the base rate, so that doubt keeps.
KEEP = 0.35
#: How far site and path evidence may move a document, in log odds.
SWAY = 1.0
EDGE = 1e-4


@dataclass
class Weights:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # intercept first; linear and absolute terms of each standardised rate

    def logit(self) -> Column:
        out = F.lit(float(self.beta[0]))
        k = len(RATES)
        for i, name in enumerate(RATES):
            z = (F.col(name) - float(self.mean[i])) / float(self.scale[i])
            z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
            out = out + float(self.beta[1 + i]) * z + float(self.beta[1 + k + i]) * F.abs(z)
        return out


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Weights:
    """Ridge logistic regression by Newton steps, classes weighted alike."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -8, 8)
    a = np.hstack([np.ones((len(z), 1)), z, np.abs(z)])
    w = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
    beta, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        slope = a.T @ (w * (good - p)) - penalty @ beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + penalty, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return Weights(mean, scale, beta)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights | None:
    rows = labelled(docs, labels, sample)
    rows = with_rates(rows.select("doc_id", "bad", measured(F.col("text")).alias("x")).select("doc_id", "bad", "x.*"))
    rows = bounded(rows, sample).select(*RATES, "bad").toPandas()
    rows = rows.sort_values([*RATES, "bad"], ignore_index=True)
    good = ~rows["bad"].to_numpy(bool)
    return fit(rows[list(RATES)].to_numpy(float), good) if good.any() and not good.all() else None


def strength(groups: DataFrame, n: str, good: str, centre: Column) -> float:
    """Prior strength of the groups' rates around ``centre`` by moments: what their spread leaves above
    sampling noise; between 1 and 10,000 documents. One row of sums comes to the driver."""
    rate, size = F.col(good) / F.col(n), F.col(n)
    s = groups.agg(
        F.sum(centre * (1 - centre)).alias("noise"), F.sum(size * (rate - centre) * (rate - centre)).alias("spread"),
        F.sum(size * centre * (1 - centre)).alias("within"), F.sum(size).alias("n"), F.sum(size * size).alias("nn"),
    ).first()
    if not s["n"]:
        return 1.0
    excess = (s["spread"] - s["noise"]) / max(s["n"] - s["nn"] / s["n"], 1.0)
    return min(max(s["within"] / s["n"] / excess - 1, 1.0), 1e4) if excess > 0 else 1e4


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


def log_odds(p: Column) -> Column:
    return F.ln(clipped(p) / (1 - clipped(p)))


def site_posteriors(evidence: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, p_all, p_host, p_path) from (host, path, p): two levels of shrunken rates."""
    paths = stored(evidence.groupBy(host, path).agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good")), "site-paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    whole = hosts.agg((F.sum("hgood") / F.sum("hn")).alias("p")).first()["p"]
    p_all = F.lit(float(whole if whole is not None else 0.5))
    tau = strength(hosts, "hn", "hgood", p_all)
    hosts = hosts.withColumn("p_host", (F.col("hgood") + tau * p_all) / (F.col("hn") + tau))
    both = paths.alias("p").join(hosts.alias("h"), F.col(f"p.{host}").eqNullSafe(F.col(f"h.{host}"))).select("p.*", p_all.alias("p_all"), "h.p_host")
    tau = strength(both, "n", "good", F.col("p_host"))
    return both.select(host, path, "p_all", "p_host", ((F.col("good") + tau * F.col("p_host")) / (F.col("n") + tau)).alias("p_path"))


def scored(docs: DataFrame, weights: Weights | None, host: str = "source", path: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, host, path, p_doc, p_host, p_path, score, kept) of every row; with ``carry``, those
    columns of ``docs`` as one struct column ``row``."""
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    rows = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), measured(F.col("text")).alias("x"), *more)
    rows = with_rates(rows.select("doc_id", "host", "path", "x.*", *(["row"] if carry else [])))
    own = F.lit(20.0) if weights is None else F.when(F.col("n_words") > 0, weights.logit()).otherwise(F.lit(-20.0))
    rows = rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-own))).alias("p"), *(["row"] if carry else []))
    rows = stored(rows, "site-evidence")
    sites = stored(site_posteriors(rows.select("host", "path", "p")), "site-posteriors")
    joined = rows.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    shift = F.least(F.greatest(log_odds(F.col("s.p_path")) - log_odds(F.col("s.p_all")), F.lit(-SWAY)), F.lit(SWAY))
    total = log_odds(F.col("d.p")) + shift
    out = joined.select("d.*", "s.p_host", "s.p_path", (1 / (1 + F.exp(-total))).alias("score"))
    return out.select("doc_id", "host", "path", F.col("p").alias("p_doc"), "p_host", "p_path", "score", (F.col("score") >= KEEP).alias("kept"), *(["row"] if carry else []))
