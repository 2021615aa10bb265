"""Logistic regression over the sparse rows of a bounded sample.

fit_in_task trains in one executor task, as the driver may be small: the sample
is bounded by its caller, in texts and in bytes, and only the weights come back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteloom.llm.common import freed

CHUNK = 1 << 18


def fit_logistic(
    index: np.ndarray, edge: np.ndarray, targets: np.ndarray, size: int, l2: float, values: np.ndarray | None = None, scale: np.ndarray | None = None, rounds: int = 80, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch AdaGrad. Row r has the features
    index[edge[r]:edge[r + 1]], of value 1 or `values`, times `scale` of the
    feature; targets are probabilities. Works in chunks of about CHUNK entries."""
    n = max(1, len(targets))
    cuts = [0]
    while cuts[-1] < len(targets):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edge, edge[cuts[-1]] + CHUNK, "right")) - 1))
    w, b = np.zeros(size), 0.0
    sum_w, sum_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        grad, grad_b = l2 * w, 0.0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = index[edge[lo] : edge[hi]]
            owner = np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1]))
            x = np.ones(len(at), np.float32) if values is None else values[edge[lo] : edge[hi]]
            if scale is not None:
                x = x * scale[at]
            z = np.bincount(owner, x * w[at], minlength=hi - lo) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[lo:hi]) / n
            grad = grad + np.bincount(at, x * error[owner], minlength=size)
            grad_b += error.sum()
        sum_w += grad * grad
        sum_b += grad_b * grad_b
        w -= rate * grad / np.sqrt(sum_w)
        b -= rate * grad_b / np.sqrt(sum_b)
    return w, float(b)


def fit_curve(scores: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve that turns scores
    into probabilities of y, by Newton's method."""
    mean, spread = float(scores.mean()), float(scores.std()) + 1e-9
    z = np.stack([(scores - mean) / spread, np.ones(len(scores))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -30, 30)))
        curve = (z * (p * (1 - p) + 1e-9)) @ z.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, z @ (p - y) + 1e-3 * at)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, float(at[0])) / spread
    return slope, float(at[1]) - slope * mean


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column, and where each list starts."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks] or [np.empty(0, np.int64)])
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def fit_in_task(features: DataFrame, fit: Callable[[pa.Table], tuple[np.ndarray, float] | None]) -> tuple[np.ndarray, float] | None:
    """fit(the whole of features), in one task; None for no rows."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        got = fit(pa.Table.from_batches(held)) if held else None
        held.clear()
        freed()
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got[0].astype("<f8").tobytes()], pa.binary()), pa.array([got[1]])], ["w", "b"])

    rows = features.repartition(1).mapInArrow(run, "w binary, b double").collect()
    return (np.frombuffer(rows[0]["w"], "<f8"), float(rows[0]["b"])) if rows else None
