"""An outcome seen only where a choice was made: probit, Heckman's two steps, and the likelihood of both together.

Each Newton or scoring step is one aggregate over the rows. Rows with a null, NaN or infinite covariate, a null choice, or a chosen
row without an outcome are left out of fits; in predictions they give nulls.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.passes import quadratic, scored, totals

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_share(x: np.ndarray) -> np.ndarray:
    """The share of a standard normal law below x."""
    return 0.5 * np.asarray(_erfc(-np.asarray(x, dtype=np.float64) / math.sqrt(2)), dtype=np.float64)


def mills(x: np.ndarray) -> np.ndarray:
    """Density over share below: the mean of a standard normal law above -x. Far down by its expansion."""
    x = np.asarray(x, dtype=np.float64)
    far = x < -25
    near = np.where(far, 0.0, x)
    down = np.where(far, x, -30.0)
    return np.where(far, -down / (1 - 1 / down**2 + 3 / down**4), np.exp(-near * near / 2) / math.sqrt(2 * math.pi) / normal_share(near))


def _log_share(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log of the share below x, whose mills(x) is m."""
    return -x * x / 2 - 0.5 * math.log(2 * math.pi) - np.log(np.maximum(m, 1e-300))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


class Probit:
    """Coefficients (the constant first), their covariance and the log-likelihood."""

    def __init__(self, df: DataFrame, columns: list[str], chosen: str, steps: int = 30):
        k = len(columns) + 1
        self.columns, self.beta, self.covariance, self.loglik = columns, np.zeros(k), np.zeros((k, k)), -math.inf
        move = np.zeros(k)
        for _ in range(steps):

            def measure(x: np.ndarray, beta: np.ndarray = self.beta + move) -> np.ndarray:
                z, sign = _with_one(x[:, :-1]), 2 * x[:, -1] - 1
                at = sign * (z @ beta)
                m = mills(at)
                return np.concatenate([[_log_share(at, m).sum()], z.T @ (sign * m), quadratic(z, m * (m + at))])

            total = totals(df, [*columns, chosen], measure, 1 + k + k * k)
            if total[0] < self.loglik - 1e-9 and np.abs(move).max() > 1e-10:  # too far: half the way
                move = move / 2
                continue
            self.loglik, self.beta, info = float(total[0]), self.beta + move, total[1 + k :].reshape(k, k)
            self.covariance = np.linalg.pinv(info)
            move = _solve(info, total[1 : 1 + k])
            if np.abs(move).max() < 1e-10:
                break


class Heckman:
    """select: a Probit of the choice; beta: outcome coefficients (the constant first); mills: that of the inverse Mills ratio;
    se: errors of (beta, mills), corrected for the estimated ratio and unequal variances; sigma, rho."""

    def __init__(self, df: DataFrame, select_columns: list[str], outcome_columns: list[str], chosen: str, outcome: str):
        names = list(dict.fromkeys([*select_columns, *outcome_columns]))
        fine = F.col(chosen).isNotNull() & ((F.col(chosen).cast("double") == 0) | F.col(outcome).isNotNull())
        for c in names:
            x = F.col(c).cast("double")
            fine &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        self.rows = df.where(fine).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(chosen).cast("double").alias("_chosen"), F.col(outcome).cast("double").alias("_outcome")).persist()
        try:
            self._two_steps(select_columns, outcome_columns, names)
        except BaseException:
            self.rows.unpersist()
            raise

    def _two_steps(self, select_columns: list[str], outcome_columns: list[str], names: list[str]) -> None:
        self.names, self.outcome_columns = names, outcome_columns
        self.select = Probit(self.rows.select(*select_columns, "_chosen"), select_columns, "_chosen")
        self._z, self._x = [names.index(c) for c in select_columns], [names.index(c) for c in outcome_columns]
        picked = self.rows.where("_chosen = 1").select(*names, "_outcome")
        k, at_z, at_x, gamma = len(outcome_columns) + 2, self._z, self._x, self.select.beta

        def design(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            z = _with_one(x[:, at_z])
            at = z @ gamma
            m = mills(at)
            return np.column_stack([_with_one(x[:, at_x]), m]), z, m * (m + at)

        def normal(x: np.ndarray) -> np.ndarray:
            w = design(x)[0]
            return np.concatenate([[len(x)], w.T @ x[:, -1], quadratic(w, np.ones(len(x)))])

        total = totals(picked, [*names, "_outcome"], normal, 1 + k + k * k)
        n, inverse = total[0], np.linalg.pinv(total[1 + k :].reshape(k, k))
        both = inverse @ total[1 : 1 + k]
        self.beta, self.mills = both[:-1], float(both[-1])
        q = len(select_columns) + 1

        def spread(x: np.ndarray) -> np.ndarray:
            w, z, d = design(x)
            left = x[:, -1] - w @ both
            return np.concatenate([[left @ left, d.sum()], quadratic(w, d), quadratic(w, d, z)])

        total = totals(picked, [*names, "_outcome"], spread, 2 + k * k + k * q)
        variance = max((total[0] + self.mills**2 * total[1]) / max(n, 1), 1e-300)
        self.sigma = math.sqrt(variance)
        self.rho = max(-1.0, min(1.0, self.mills / self.sigma))
        plain = np.linalg.pinv(inverse)
        wd, wz = total[2 : 2 + k * k].reshape(k, k), total[2 + k * k :].reshape(k, q)
        middle = plain - self.rho**2 * wd + self.rho**2 * wz @ self.select.covariance @ wz.T
        self.covariance = variance * inverse @ middle @ inverse
        self.se = np.sqrt(np.clip(np.diag(self.covariance), 0, None))
        self.loglik: float | None = None

    def likelihood(self, steps: int = 100) -> Heckman:
        """Goes on from the two steps to the largest joint likelihood, by scoring with outer products of gradients. Sets gamma,
        beta, sigma, rho, loglik, and se (of gamma, beta, log sigma, atanh rho)."""
        self.rows.persist()
        try:
            return self._likelihood(steps)
        finally:
            self.close()

    def close(self) -> None:
        """Gives up the rows, which stay persisted from the two steps for likelihood(): they are made once for both."""
        self.rows.unpersist()

    def _likelihood(self, steps: int) -> Heckman:
        kz, kx = len(self._z) + 1, len(self._x) + 1
        size, at_z, at_x = kz + kx + 2, self._z, self._x
        now = np.concatenate([self.select.beta, self.beta, [math.log(self.sigma), math.atanh(max(-0.95, min(0.95, self.rho)))]])
        best, move, slack = -math.inf, np.zeros(size), 0
        for _ in range(steps):

            def measure(x: np.ndarray, at: np.ndarray = now + move) -> np.ndarray:
                z, w, chosen = _with_one(x[:, at_z]), _with_one(x[:, at_x]), x[:, -2] == 1
                g, b, sigma, rho = at[:kz], at[kz : kz + kx], math.exp(at[-2]), math.tanh(at[-1])
                r = math.sqrt(1 - rho * rho)
                want = z @ g
                u = np.where(chosen, (np.nan_to_num(x[:, -1]) - w @ b) / sigma, 0.0)
                a = (want + rho * u) / r
                side = np.where(chosen, a, -want)
                m = none = mills(side)  # a row needs one of them
                share = _log_share(side, m)
                loglik = np.where(chosen, -u * u / 2 - 0.5 * math.log(2 * math.pi) - at[-2] + share, share)
                score = np.column_stack([
                    z * np.where(chosen, m / r, -none)[:, None], w * np.where(chosen, (u - m * rho / r) / sigma, 0.0)[:, None],
                    np.where(chosen, u * u - 1 - m * rho * u / r, 0.0), np.where(chosen, m * (u * r + (want + rho * u) * rho / r), 0.0),
                ])
                return np.concatenate([[loglik.sum()], score.sum(axis=0), quadratic(score, np.ones(len(x)))])

            total = totals(self.rows, [*self.names, "_chosen", "_outcome"], measure, 1 + size + size * size)
            if not total[0] >= best - 1e-9 and slack < 20:
                move, slack = move / 2, slack + 1
                continue
            gained, now, slack = total[0] - best, now + move, 0
            best, outer = total[0], total[1 + size :].reshape(size, size)
            move = _solve(outer, total[1 : 1 + size])
            if gained < 1e-9 or np.abs(move).max() < 1e-7:
                break
        self.gamma, self.beta = now[:kz], now[kz : kz + kx]
        self.sigma, self.rho, self.loglik = math.exp(now[-2]), math.tanh(now[-1]), float(best)
        self.mills = self.rho * self.sigma
        self.se = np.sqrt(np.clip(np.diag(np.linalg.pinv(outer)), 0, None))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with probability of the choice, outcome (were it made) and their product, expected."""
        gamma, beta, at_z, at_x = (self.select.beta if self.loglik is None else self.gamma), self.beta, self._z, self._x

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            p, y = normal_share(_with_one(x[:, at_z]) @ gamma), _with_one(x[:, at_x]) @ beta
            return {"probability": p, "outcome": y, "expected": p * y}

        out = scored(df, self.names, score, dict.fromkeys(["probability", "outcome", "expected"], T.DoubleType()))
        return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("probability", "outcome", "expected")})
