"""Maximum-likelihood factor analysis of correlations, turned by varimax and promax, with AIC and BIC.

The correlations are one aggregate over the rows; everything after works on a matrix of columns by columns. For given unique
variances the best loadings are known, so only those variances are sought, by damped Newton steps between their bounds.
Rows with a null, NaN or infinite column are left out; a constant column is an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.passes import quadratic, totals

LEAST = 0.005


def correlations(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Correlations and the number of whole rows. Rows are scaled before their products are added up."""
    x = {c: F.col(c).cast("double") for c in columns}
    rows = df.where(F.forall(F.array(*x.values()), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).select(*[v.alias(c) for c, v in x.items()])
    first = rows.agg(F.count("*"), *[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    n = first[0]
    mean, deviation = (np.array([v if v is not None else 0.0 for v in first[i::2]]) for i in (1, 2))
    if not n or (deviation <= 0).any():
        raise ValueError("a column is constant or there are no whole rows")
    p = len(columns)
    c = totals(rows, columns, lambda x: quadratic((x - mean) / deviation, np.ones(len(x))), p * p).reshape(p, p) / n
    return c / np.sqrt(np.outer(np.diag(c), np.diag(c))), n


def varimax(load: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Turned so that squared loadings vary most within factors, rows scaled to length 1 meanwhile."""
    if load.shape[1] < 2:
        return load
    length = np.sqrt((load**2).sum(axis=1, keepdims=True))
    length[length == 0] = 1
    x, turn, last = load / length, np.eye(load.shape[1]), 0.0
    for _ in range(rounds):
        y = x @ turn
        u, s, v = np.linalg.svd(x.T @ (y**3 - y * (y**2).mean(axis=0)))
        turn = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return x @ turn * length


def promax(load: np.ndarray, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(oblique loadings, correlations of the factors): turned towards powers of the loadings given."""
    u = np.linalg.lstsq(load, load * np.abs(load) ** (power - 1), rcond=None)[0]
    u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
    back = np.linalg.inv(u)
    return load @ u, back @ back.T


class Factors:
    """k factors of correlations r over n rows: uniquenesses, loadings as found, rotated (varimax), oblique with phi (promax),
    loglik, aic, bic, and the test that k are enough: statistic, degrees."""

    def __init__(self, r: np.ndarray, n: int, k: int):
        p = len(r)
        self.degrees = ((p - k) ** 2 - p - k) // 2
        if not 0 < k < p or self.degrees < 0:
            raise ValueError(f"{k} factors are too many for {p} columns")
        self.r, self.k = r, k
        low, high = math.log(LEAST), 0.0
        x = np.clip(np.log((1 - 0.5 * k / p) / np.diag(np.linalg.pinv(r))), low, high)
        value, slope = self._fit(x)
        damp = 1e-3
        for _ in range(500):
            free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
            if np.abs(slope[free]).max(initial=0) < 1e-9:
                break
            curve = np.column_stack([(self._fit(x + 1e-5 * e)[1] - self._fit(x - 1e-5 * e)[1]) / 2e-5 for e in np.eye(p)])
            curve = ((curve + curve.T) / 2)[np.ix_(free, free)]
            values, vectors = np.linalg.eigh(curve)
            while damp < 1e12:
                move = np.zeros(p)
                move[free] = -vectors @ ((vectors.T @ slope[free]) / (np.abs(values) + damp))
                then = np.clip(x + np.clip(move, -1.5, 1.5), low, high)
                new, new_slope = self._fit(then)
                if new <= value - 1e-4 * abs(slope @ (then - x)) or np.abs(then - x).max() < 1e-12:
                    break
                damp *= 10
            damp = max(damp / 30, 1e-9)
            if np.abs(then - x).max() < 1e-12:
                break
            x, value, slope = then, new, new_slope
        self.uniquenesses = np.exp(x)
        self.loadings = self._loadings(x)
        self.loadings *= np.where(self.loadings.sum(axis=0) < 0, -1, 1)
        self.rotated = varimax(self.loadings)
        self.rotated = self.rotated[:, np.argsort(-(self.rotated**2).sum(axis=0), kind="stable")]
        self.rotated *= np.where(self.rotated.sum(axis=0) < 0, -1, 1)
        self.oblique, self.phi = promax(self.rotated)
        model = self.loadings @ self.loadings.T + np.diag(self.uniquenesses)
        _, log_det = np.linalg.slogdet(model)
        self.loglik = -n / 2 * (p * math.log(2 * math.pi) + log_det + np.trace(np.linalg.solve(model, r)))
        free_numbers = p * k + p - k * (k - 1) // 2
        self.aic, self.bic = 2 * free_numbers - 2 * self.loglik, math.log(n) * free_numbers - 2 * self.loglik
        self.statistic = (n - 1 - (2 * p + 5) / 6 - 2 * k / 3) * value

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        root = np.exp(x / 2)
        values, vectors = np.linalg.eigh(self.r / np.outer(root, root))
        return values[::-1], vectors[:, ::-1], root

    def _loadings(self, x: np.ndarray) -> np.ndarray:
        values, vectors, root = self._parts(x)
        return root[:, None] * vectors[:, : self.k] * np.sqrt(np.clip(values[: self.k] - 1, 0, None))

    def _fit(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Misfit, and its slopes by the logs of the uniquenesses."""
        values, _, _ = self._parts(x)
        load, psi = self._loadings(x), np.exp(x)
        rest = np.maximum(values[self.k :], 1e-300)
        return float((rest - np.log(rest) - 1).sum()), ((load**2).sum(axis=1) + psi - np.diag(self.r)) / psi
