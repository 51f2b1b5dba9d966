"""Linear models from sufficient statistics: sums of products by group, from
which every training window, fold and penalty is solved without another fit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.trees import matrix_of


def product_sums(rows: DataFrame, group: Column, x: Column, width: int) -> DataFrame:
    """(g, i, j, value): sums of products of every two (i <= j) of 1 and the
    width entries of an array, by an integer group; rows with a missing entry are
    left out. Tasks add up their rows, so what is shuffled is one matrix per task
    and group."""
    upper = np.triu_indices(width + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy()
            ones = np.column_stack([np.ones(batch.num_rows), matrix_of(batch.column(1), width)])
            known = ~np.isnan(ones).any(axis=1)
            for g in np.unique(groups[known]):
                own = ones[known & (groups == g)]
                held[int(g)] = held.get(int(g), 0.0) + own.T @ own
        for g, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), g)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(m[upper])], ["g", "i", "j", "value"])

    asked = rows.select(group.cast("long").alias("g"), x.alias("x")).where("g is not null")
    return asked.mapInArrow(run, "g long, i int, j int, value double").groupBy("g", "i", "j").agg(F.sum("value").alias("value"))


def running_sums(sums: DataFrame) -> DataFrame:
    """The sums of all groups up to each group: expanding windows. Every group has
    all cells, and a window holds one value a group."""
    upto = Window.partitionBy("i", "j").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("g", "i", "j", F.sum("value").over(upto).alias("value"))


def matrix(cells: Iterable[tuple[int, int, float]], size: int) -> np.ndarray:
    """Symmetric matrix of the cells (i, j, value)."""
    m = np.zeros((size, size))
    for i, j, v in cells:
        m[i, j] = m[j, i] = v
    return m


def standardised(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """(n, means, deviations, mean of the target, covariances of the inputs by
    their deviations, those with the target) of sums whose last column is the
    target; an input that does not vary has deviation 1 and no weight."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    flat = d <= 1e-9 * np.maximum(np.abs(mean[:-1]), 1e-9)
    d = np.where(flat, 1.0, d)
    c = cov[:-1, :-1] / np.outer(d, d)
    r = cov[:-1, -1] / d
    c[flat, :] = c[:, flat] = 0.0
    r[flat] = 0.0
    return n, mean[:-1], d, mean[-1], c, r


def ridge(m: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, weights) that minimise squared errors plus penalty times the
    squared weights of the standardised inputs; the intercept is free."""
    n, mean, d, target, c, r = standardised(m)
    w = np.linalg.solve(n * c + (penalty + 1e-9) * np.eye(len(c)), n * r) / d
    return np.concatenate([[target - w @ mean], w])


def elastic_net(m: np.ndarray, penalty: float, l1_ratio: float, rounds: int = 5_000, least_step: float = 1e-10) -> np.ndarray:
    """(intercept, weights) for half the mean squared error plus penalty *
    (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2), by coordinate descent on the
    covariances."""
    _, mean, d, target, c, r = standardised(m)
    w = np.zeros(len(c))
    for _ in range(rounds):
        step = 0.0
        for k in range(len(w)):
            rest = r[k] - c[k] @ w + c[k, k] * w[k]
            new = np.sign(rest) * max(abs(rest) - penalty * l1_ratio, 0.0) / (c[k, k] + penalty * (1 - l1_ratio)) if c[k, k] > 0 else 0.0
            step = max(step, abs(new - w[k]))
            w[k] = new
        if step < least_step:
            break
    w = w / d
    return np.concatenate([[target - w @ mean], w])


def squared_error(m: np.ndarray, weights: np.ndarray) -> float:
    """Sum of squared errors of (intercept, weights) on the rows of the sums."""
    full = np.append(weights, -1.0)
    return float(max(full @ m @ full, 0.0))
