"""Multinomial logistic regression of all folds of a cross-validation at once.

The folds share every pass over the data: a task multiplies its rows with the
weights of all folds in one matrix product, leaves each fold's own rows out of
its sums, and returns loss and gradient of every fold. The scaling of a fold is
part of its weights, so rows are never scaled or copied for a fold. One pass at
the start takes the second moments of each fold, whose sum over the other folds
bounds the curvature (Böhning's bound) and conditions the steps. The steps are
small: limited-memory quasi-Newton, one state for each fold, with the passes
needed by the slowest fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps remembered by the quasi-Newton update, halvings of a step at most, share of the promised decrease a step must bring.
MEMORY, HALVINGS, ENOUGH = 12, 30, 1e-4
#: Rows multiplied at once.
ROWS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the arrays ``v`` for each ``f``, added up in the tasks first; one row a fold comes back."""
    summary = Summarizer.metrics("sum").summary(array_to_vector("v")).alias("s")
    rows = df.groupBy("f").agg(summary).select("f", vector_to_array("s.sum").alias("v")).collect()
    return {r["f"]: np.array(r["v"]) for r in rows}


def second_moments(rows: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """Sum of ``[x, 1]' [x, 1]`` over the rows of each fold; rows are ``(f, y, x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), _matrix(batch.column(2))
            for f in np.unique(fold).tolist():
                one = np.c_[x[fold == f], np.ones(int((fold == f).sum()))]
                total[f] = total.get(f, 0.0) + one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["f", "v"])

    found = _summed(rows.select("f", "y", "x").mapInArrow(run, "f int, v array<double>"))
    return {f: g.reshape(int(np.sqrt(len(g))), -1) for f, g in found.items()}


def losses(rows: DataFrame, raw: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold the summed loss over all rows of other folds, and its gradient by ``raw[fold]`` (classes x dimensions and intercept)."""
    folds, classes, width = raw.shape
    weights, intercepts = raw[:, :, :-1].reshape(folds * classes, width - 1), raw[:, :, -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = np.zeros(folds), np.zeros((folds * classes, width))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                fold, y, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
                z = (x @ weights.T).reshape(len(x), folds, classes) + intercepts
                z -= z.max(axis=2, keepdims=True)
                p = np.exp(z)
                size = p.sum(axis=2, keepdims=True)
                used = fold[:, None] != np.arange(folds)
                at = (np.arange(len(x)), slice(None), y)
                loss += ((np.log(size[:, :, 0]) - z[at]) * used).sum(axis=0)
                p /= size
                p[at] -= 1.0
                p *= used[:, :, None]
                d = p.reshape(len(x), -1)
                gradient[:, :-1] += d.T @ x
                gradient[:, -1] += d.sum(axis=0)
        both = np.c_[loss, gradient.reshape(folds, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds, dtype=np.int32)), pa.array(list(both), pa.list_(pa.float64()))], ["f", "v"])

    return _summed(rows.select("f", "y", "x").mapInArrow(run, "f int, v array<double>"))


class _Descent:
    """Quasi-Newton descent of one fold, a step for each pass over the data."""

    def __init__(self, moments: np.ndarray, mean: np.ndarray, std: np.ndarray, classes: int, ridge: float, tol: float):
        self.n = moments[-1, -1]
        self.mean, self.std, self.tol = mean, std, tol
        # Moments of the scaled rows: (x - mean) / std = T [x, 1].
        turn = np.zeros_like(moments)
        turn[:-1, :-1], turn[:-1, -1], turn[-1, -1] = np.diag(1.0 / std), -mean / std, 1.0
        self.turn = turn
        self.ridge = np.r_[np.full(len(mean), ridge / self.n), 0.0]
        bound = 0.5 * turn @ moments @ turn.T / self.n + np.diag(self.ridge) + 1e-10 * np.eye(len(turn))
        self.inverse = np.linalg.inv(bound)
        self.point = self.trial = np.zeros((classes, len(turn)))
        self.value, self.gradient, self.step, self.direction = np.inf, None, 1.0, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.halvings, self.done = 0, False

    def raw(self) -> np.ndarray:
        """Weights of the trial point for rows that are not scaled."""
        return self.trial @ self.turn

    def take(self, sums: np.ndarray) -> None:
        """Loss and gradient at the trial point; chooses the next one."""
        value = sums[0] / self.n + 0.5 * float((self.ridge * self.trial**2).sum())
        gradient = sums[1:].reshape(self.point.shape) @ self.turn.T / self.n + self.ridge * self.trial
        if self.direction is not None:
            promised = self.step * float((self.gradient * self.direction).sum())
            # At the end of the descent the decrease drowns in rounding; the gradient then still tells.
            better = value <= self.value + ENOUGH * promised or (value <= self.value + 1e-12 * abs(self.value) and np.abs(gradient).max() < np.abs(self.gradient).max())
            if not better:
                self.halvings += 1
                self.step *= 0.5
                self.done = self.halvings > HALVINGS
                self.trial = self.point if self.done else self.point + self.step * self.direction
                return
            s, y = self.trial - self.point, gradient - self.gradient
            if float((s * y).sum()) > 1e-16 * float((y * y).sum()):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.point, self.value, self.gradient, self.halvings, self.step = self.trial, value, gradient, 0, 1.0
        if np.abs(gradient).max() <= self.tol:
            self.done = True
            return
        q, kept = gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = float((s * q).sum()) / float((s * y).sum())
            q -= a * y
            kept.append(a)
        q = q @ self.inverse
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - float((y * q).sum()) / float((s * y).sum()))
        self.direction = -q
        self.trial = self.point + self.direction


def fit_all_folds(
    rows: DataFrame, scalers: list[tuple[np.ndarray, np.ndarray]], classes: int, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-7
) -> tuple[np.ndarray, int]:
    """Weights for scaled rows, ``(folds, classes, dimensions and intercept)``, and how many passes over the rows that took.

    Rows are ``(f, y, x)`` with folds and classes numbered from 0; fold ``f``
    is fitted on all other rows, scaled by ``scalers[f]``. The objective is the
    mean cross-entropy plus ``|w|^2 / (2 c n)``; intercepts are free. A fold
    stops when no component of its gradient exceeds ``tol``. The passes are
    those of the slowest fold, whatever the number of folds.
    """
    folds = len(scalers)
    own = second_moments(rows, folds)
    total = sum(own.values())
    descents = [_Descent(total - own.get(f, 0.0), mean, std, classes, 1.0 / c, tol) for f, (mean, std) in enumerate(scalers)]
    passes = 0
    while passes < max_iter and not all(d.done for d in descents):
        found = losses(rows, np.stack([d.raw() for d in descents]))
        passes += 1
        for f, d in enumerate(descents):
            if not d.done:
                d.take(found[f])
    return np.stack([d.point for d in descents]), passes + 1
