"""Linear models of all steps and penalties from one pass (ML-5, ML-6, ML-13, ML-16).

The rows ``[1, x, y_1 … y_H]`` are summed into one Gram matrix by a tree
aggregate; its size depends on the sequence and the number of steps, never on
the rows. Every model with a squared loss follows from it: a ridge by Cholesky
factors, an elastic net by coordinate descent, for all targets together. The
objective is 1/(2n)·Σ(y − w·x − b)² + λ(α‖w‖₁ + (1 − α)/2·‖w‖²), as documented for
``LinearRegression`` (which divides the squared part by the label's deviation).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Sums over rows ``[1, x, y]``; two of them add up to the sums over all their rows."""
    matrix: np.ndarray
    n_x: int

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.matrix + other.matrix, self.n_x)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(covariances of x, of x and y, means of x, means of y)."""
        mean = self.matrix[0, 1:] / self.n
        cov = self.matrix[1:, 1:] / self.n - np.outer(mean, mean)
        d = self.n_x
        return cov[:d, :d], cov[:d, d:], mean[:d], mean[d:]


def gram_of(rows: DataFrame, x: str, y: str | Column) -> Gram | None:
    """The Gram matrix of array columns ``x`` and ``y``; one job over ``rows``, None without rows."""
    y = F.col(y) if isinstance(y, str) else y
    first = rows.select(F.size(x).alias("n")).first()
    if first is None:
        return None
    vec = rows.select(array_to_vector(F.concat(F.array(F.lit(1.0)), F.col(x), y)).alias("v"))
    total = RowMatrix(MLUtils.convertVectorColumnsFromML(vec, "v")).computeGramianMatrix()
    return Gram(total.toArray(), first["n"])


def ridge(gram: Gram, reg: float) -> "LinearSteps":
    xx, xy, mx, my = gram.centred()
    a = xx + reg * np.eye(len(xx))
    try:
        if reg <= 0:
            raise np.linalg.LinAlgError
        c = np.linalg.cholesky(a)
        w = np.linalg.solve(c.T, np.linalg.solve(c, xy))
    except np.linalg.LinAlgError:  # columns that depend on each other: the smallest solution
        w = np.linalg.lstsq(a, xy, rcond=1e-12)[0]
    return LinearSteps(w.T, my - mx @ w)


def sweeps_of(gram: Gram, reg: float, alpha: float) -> Iterator[tuple["LinearSteps", float]]:
    """(state, largest move) after every sweep of coordinate descent on the covariances, from weights of
    zero; all targets at once, without end."""
    xx, xy, mx, my = gram.centred()
    w, at = np.zeros_like(xy), np.zeros_like(xy)  # at = xx @ w
    scale = np.diag(xx) + reg * (1 - alpha)
    while True:
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            pull = xy[j] - at[j] + xx[j, j] * w[j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - reg * alpha, 0) / scale[j]
            step = new - w[j]
            if step.any():
                at += np.outer(xx[:, j], step)
                w[j] = new
                moved = max(moved, float(np.abs(step).max() * np.sqrt(max(xx[j, j], 0))))
        yield LinearSteps(w.T.copy(), my - mx @ w), moved


def elastic_net(gram: Gram, reg: float, alpha: float, tol: float = 1e-9, most: int = 10_000) -> "LinearSteps":
    """Coordinate descent until a sweep moves no prediction by more than ``tol`` deviations."""
    for state, moved in islice(sweeps_of(gram, reg, alpha), most):
        if moved <= tol:
            break
    return state


def descent(gram: Gram, reg: float, alpha: float, sweeps: int) -> list["LinearSteps"]:
    """The states after 1, 2, … sweeps, for early stopping."""
    return [state for state, _ in islice(sweeps_of(gram, reg, alpha), sweeps)]


def solve(gram: Gram, reg: float, alpha: float = 0.0) -> "LinearSteps":
    return ridge(gram, reg) if alpha == 0 or reg == 0 else elastic_net(gram, reg, alpha)


@dataclass
class LinearSteps:
    """One linear model per step: ``weights`` (steps × inputs) and ``intercepts``."""
    weights: np.ndarray
    intercepts: np.ndarray

    def loss(self, gram: Gram) -> float:
        """Mean squared error over the rows that a Gram matrix sums, all steps together."""
        xx, xy, mx, my = gram.centred()
        d = gram.n_x
        mean = gram.matrix[0, 1:] / gram.n
        yy = np.diag(gram.matrix[1 + d :, 1 + d :]) / gram.n - mean[d:] ** 2
        off = my - self.weights @ mx - self.intercepts
        spread = yy - 2 * np.einsum("hd,dh->h", self.weights, xy) + np.einsum("hd,de,he->h", self.weights, xx, self.weights)
        return float((spread + off**2).mean())

    def predictions(self, x: str) -> Column:
        """Array of all steps' predictions from the array column ``x``."""
        number = lambda v: f"{float(v)!r}D" if np.isfinite(v) else "CAST('NaN' AS DOUBLE)"
        models = ", ".join(f"named_struct('w', array({', '.join(map(number, w))}), 'b', {number(b)})" for w, b in zip(self.weights, self.intercepts))
        return F.expr(f"transform(array({models}), m -> aggregate(zip_with(`{x}`, m.w, (a, w) -> a * w), m.b, (s, v) -> s + v))")

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the first step's prediction, like a fitted Spark ML model over ``features``."""
        return rows.withColumn("_x", vector_to_array("features")).withColumn("prediction", self.predictions("_x")[0]).drop("_x")

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights.tolist(), "intercepts": self.intercepts.tolist()})

    @classmethod
    def from_json(cls, text: str) -> "LinearSteps":
        d = json.loads(text)
        return cls(np.array(d["weights"]), np.array(d["intercepts"]))
