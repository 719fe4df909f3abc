"""Genetic search for the subset of columns whose logistic model has the least BIC or AIC.

All subsets of a generation are fitted together: a Newton step of all of them is one aggregate over the rows, and subsets that were
met before are not fitted again. Draws depend on the seed alone, so the search is the same on every run. Rows with a null in a column
or the label are left out; without rows every criterion is 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.passes import quadratic, totals

STEPS = 15


def criteria(df: DataFrame, columns: list[str], label: str, subsets: list[tuple[int, ...]], n: int, by: str) -> dict[tuple[int, ...], tuple[float, np.ndarray]]:
    """For each subset (places of columns) its criterion and coefficients, the constant first."""
    state = {s: np.zeros(len(s) + 1) for s in subsets}
    best: dict[tuple[int, ...], tuple[float, np.ndarray]] = {s: (math.inf, state[s]) for s in subsets}
    going = list(subsets)
    for _ in range(STEPS):
        sizes = [1 + (k := len(s) + 1) + k * k for s in going]
        now = [state[s] for s in going]

        def measure(x: np.ndarray, going: list = going, now: list = now) -> np.ndarray:
            out, y = [], x[:, -1]
            for s, beta in zip(going, now, strict=True):
                z = np.column_stack([np.ones(len(x)), x[:, list(s)]])
                at = z @ beta
                p = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
                out.append(np.concatenate([[(np.logaddexp(0, at) - y * at).sum()], z.T @ (y - p), quadratic(z, p * (1 - p))]))
            return np.concatenate(out)

        parts = np.split(totals(df, [*columns, label], measure, sum(sizes)), np.cumsum(sizes)[:-1])
        still = []
        for s, total in zip(going, parts, strict=True):
            k, beta = len(s) + 1, state[s]
            if total[0] > best[s][0] + 1e-9:  # too far: half way back
                state[s] = (beta + best[s][1]) / 2
                still.append(s)
                continue
            won, best[s] = best[s][0] - total[0], (float(total[0]), beta)
            move = np.linalg.lstsq(total[1 + k :].reshape(k, k), total[1 : 1 + k], rcond=1e-12)[0]
            if won > 1e-7 and np.abs(move).max() > 1e-9:
                state[s] = beta + np.clip(move, -5, 5)
                still.append(s)
        going = still
        if not going:
            break
    if by == "loss":  # negative log-likelihood alone
        return best
    each = 2.0 if by == "aic" else math.log(max(n, 1))
    return {s: (2 * loss + each * (len(s) + 1), beta) for s, (loss, beta) in best.items()}


def genetic(df: DataFrame, columns: list[str], label: str, by: str = "bic", population: int = 40, patience: int = 6, most: int = 100, mutation: float = 0.1, seed: int = 42) -> tuple[list[tuple[int, list[str], float]], np.ndarray]:
    """([(generation, its best columns so far, criterion)], coefficients of the last, the constant first).

    A generation keeps its best tenth; the others have two parents, each the better of two drawn, columns taken from either and
    flipped now and then. The search ends when `patience` generations bring nothing better, or after `most`."""
    whole = df.dropna(subset=[*columns, label]).select(*[F.col(c).cast("double").alias(c) for c in [*columns, label]]).persist()
    try:
        n, rng = whole.count(), np.random.default_rng(seed)
        pool = rng.random((population, len(columns))) < 0.5
        met: dict[tuple[int, ...], tuple[float, np.ndarray]] = {}
        history: list[tuple[int, list[str], float]] = []
        best, stale = (math.inf, ()), 0
        for generation in range(most):
            names = [tuple(np.flatnonzero(m).tolist()) for m in pool]
            new = sorted(set(names) - set(met))
            if new:
                met |= criteria(whole, columns, label, new, n, by)
            order = sorted(range(population), key=lambda i: (met[names[i]][0], names[i]))
            top = (met[names[order[0]]][0], names[order[0]])
            best, stale = (top, 0) if top < (best[0] - 1e-9, ()) else (best, stale + 1)
            history.append((generation, [columns[i] for i in best[1]], best[0]))
            if stale > patience:
                break
            rank = np.empty(population, dtype=int)
            rank[order] = np.arange(population)
            elite = pool[order[: max(1, population // 10)]]
            draw = lambda: order[min(rank[rng.integers(population)], rank[rng.integers(population)])]  # noqa: E731, B023
            young = [np.where(rng.random(len(columns)) < 0.5, pool[draw()], pool[draw()]) ^ (rng.random(len(columns)) < mutation) for _ in range(population - len(elite))]
            pool = np.array([*elite, *young])
        return history, met[best[1]][1]
    finally:
        whole.unpersist()
