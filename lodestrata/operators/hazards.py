"""Proportional hazards on several covariates, with tied times exact.

Rows are counted by time and covariate pattern. Who is at risk at a time is a sum over all later times, taken by ranges of
times: totals of ranges first, then a window in each range, so no window and no driver holds all times. Given how many of
those at risk have an event, the law of who they are has elementary symmetric polynomials of the patterns' hazards as its
sums; one factor a pattern is multiplied in, together with first and second derivatives. Beyond EXACT events at a time (and
as many without one) the law's saddle point stands for it, whose log has an error below one part in EXACT squared; so a time
costs no more however many rows it ties. Each Newton step is one aggregate over the times.

Covariates are numbers that take few values together: at most PATTERNS patterns (a ValueError beyond; continuous covariates have
to be cut into classes first). Rows with a null in time, event or a covariate are left out; without events every coefficient is 0
and its error infinite.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.passes import chi_square_tail, totals

PATTERNS = 64
EXACT = 200
RANGES = 64


def risk_sets(df: DataFrame, time: str, event: str, covariates: list[str], ranges: int = RANGES, weight: str | None = None) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """A row for each time with events: time, survival (Kaplan-Meier, before the time), n0, d0, n1, d1, ... (at risk and
    events by pattern); the patterns; and what was persisted for both. The rows are gone over once, to be counted."""
    names = [f"x{i}" for i in range(len(covariates))]
    rows = df.where(F.col(event).isNotNull() & F.col(time).isNotNull()).dropna(subset=covariates).select(F.col(time).cast("double").alias("time"), F.col(event).cast("long").alias("event"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"), *[F.col(c).cast("double").alias(n) for n, c in zip(names, covariates, strict=True)])
    held = rows.groupBy("time", *names).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("event")).alias("event")).where("w > 0").persist()
    found = held.select(*names).distinct().orderBy(*names).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        held.unpersist()
        raise ValueError(f"more than {PATTERNS} patterns of covariates")
    patterns = np.array([list(r) for r in found], dtype=np.float64).reshape(len(found), len(covariates))
    of = lambda p: F.lit(True) if not names else _all([F.col(n) == F.lit(float(v)) for n, v in zip(names, p, strict=True)])
    counts = [F.sum(F.when(of(p), F.col(c)).otherwise(0)).alias(f"{a}{i}") for i, p in enumerate(patterns) for a, c in (("c", "w"), ("d", "event"))]
    cuts = held.agg(F.percentile_approx("time", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    part = sum((F.when(F.col("time") > F.lit(float(c)), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    per = held.groupBy("time").agg(*counts).withColumn("part", part)
    n = len(patterns)
    later = per.groupBy("part").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]).orderBy("part").collect()  # a row a range
    after = {r.part: [sum(q[f"c{i}"] for q in later if q.part > r.part) for i in range(n)] for r in later}
    base = lambda i: F.element_at(F.create_map(*[F.lit(v) for k, row in after.items() for v in (k, row[i])]), F.col("part")) if after else F.lit(0)
    w = Window.partitionBy("part").orderBy(F.desc("time"))
    risk = per.select("time", "part", *[f"d{i}" for i in range(n)], *[(F.sum(f"c{i}").over(w) + base(i)).alias(f"n{i}") for i in range(n)])
    d, r = (sum((F.col(f"{c}{i}") for i in range(n)), F.lit(0)) for c in "dn")
    step = F.when(d >= r, F.lit(-60.0)).otherwise(F.log1p(-d / r))  # all gone: as good as nothing is left
    steps = risk.where(d > 0).withColumn("_step", step)
    sums = {x.part: x.s for x in steps.groupBy("part").agg(F.sum("_step").alias("s")).collect()}
    before = {k: sum(s for q, s in sums.items() if q < k) for k in sums}
    first = F.element_at(F.create_map(*[F.lit(v) for k, s in before.items() for v in (k, float(s))]), F.col("part")) if before else F.lit(0.0)
    up = Window.partitionBy("part").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    out = steps.select("time", F.exp(first + F.coalesce(F.sum("_step").over(up), F.lit(0.0))).alias("survival"), *[f"{c}{i}" for i in range(n) for c in "nd"])
    return out, patterns, held


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _choices(at_risk: np.ndarray, d: int, x: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all choices of d of those at risk of exp(beta * their sum of x); mean and covariance of that sum.

    log, mean and second have an entry for each number chosen so far; a pattern's own number shifts and mixes them."""
    k = x.shape[1]
    log, mean, second = np.full(d + 1, -np.inf), np.zeros((d + 1, k)), np.zeros((d + 1, k, k))
    log[0] = 0.0
    seen = 0
    for n, own in zip(at_risk.astype(int), x, strict=True):
        j = np.arange(min(n, d) + 1)
        b = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in j]) + j * float(own @ beta)
        top = min(d, seen + n)
        total = np.arange(top + 1)[:, None] - j[None, :]  # how many come from the patterns before
        fits = (total >= 0) & (total <= seen)
        back = np.where(fits, total, 0)
        both = np.where(fits, log[back] + b[None, :], -np.inf)
        high = both.max(axis=1, keepdims=True)
        share = np.exp(both - high)
        size = share.sum(axis=1, keepdims=True)
        share /= size
        shift = (share @ j)[:, None] * own[None, :]
        old = np.einsum("tj,tjk->tk", share, mean[back])
        cross = np.einsum("tj,j,tjk->tk", share, j, mean[back])
        moved = np.einsum("tj,tjkl->tkl", share, second[back]) + (share @ (j * j))[:, None, None] * np.outer(own, own)[None]
        moved += cross[:, :, None] * own[None, None, :] + own[None, :, None] * cross[:, None, :]
        log[: top + 1], mean[: top + 1], second[: top + 1] = (high + np.log(size))[:, 0], old + shift, moved
        seen = min(d, seen + n)
    return float(log[d]), mean[d], second[d] - np.outer(mean[d], mean[d])


def _saddle(at_risk: np.ndarray, d: int, x: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """As _choices, for many: independent draws tilted to d on average, and their second-order correction."""
    n, eta = at_risk.astype(np.float64), x @ beta
    low, high = -60 - eta.max(), 60 - eta.min()
    for _ in range(200):
        u = (low + high) / 2
        low, high = (u, high) if (n / (1 + np.exp(-(eta + u)))).sum() < d else (low, u)
    p = 1 / (1 + np.exp(-(eta + u)))
    v = n * p * (1 - p)
    third, fourth = v * (1 - 2 * p), v * (1 - 6 * p * (1 - p))
    all_v = v.sum()
    log = (n * np.logaddexp(0, eta + u)).sum() - d * u - 0.5 * math.log(2 * math.pi * all_v) + fourth.sum() / all_v**2 / 8 - 5 * third.sum() ** 2 / all_v**3 / 24
    counts = n * p - (third - v * third.sum() / all_v) / (2 * all_v)
    return float(log), counts @ x, x.T @ (x * v[:, None]) - np.outer(v @ x, v @ x) / all_v


def _moments(at_risk: np.ndarray, events: np.ndarray, x: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of one time: the log-likelihood, and the mean and covariance of the events' sum of covariates, given their number."""
    d, rest = int(events.sum()), int(at_risk.sum() - events.sum())
    own = float((events @ x) @ beta)
    if rest < d:  # choose those without an event
        log, mean, cov = _saddle(at_risk, rest, x, -beta) if rest > EXACT else _choices(at_risk, rest, x, -beta)
        return own - float(at_risk @ x @ beta) - log, at_risk @ x - mean, cov
    log, mean, cov = _saddle(at_risk, d, x, beta) if d > EXACT else _choices(at_risk, d, x, beta)
    return own - log, mean, cov


class Cox:
    """Coefficients (beta), their errors (se), log-likelihoods with (loglik) and without (base) the covariates. weight: a column
    of how many rows a row stands for."""

    def __init__(self, df: DataFrame, time: str, event: str, covariates: list[str], steps: int = 30, ranges: int = RANGES, weight: str | None = None):
        risk, self.patterns, held = risk_sets(df, time, event, covariates, ranges, weight)
        self.risk, k = risk.persist(), len(covariates)
        try:
            self.beta, info = np.zeros(k), np.zeros((k, k))
            self.base = self.loglik = self._sums(self.beta)[0]
            score, info = self._sums(self.beta)[1:]
            for _ in range(steps):
                move = np.linalg.lstsq(info, score, rcond=1e-10)[0] if k else np.zeros(0)
                if np.abs(move).max(initial=0) < 1e-9:
                    break
                while True:
                    loglik, score2, info2 = self._sums(self.beta + move)
                    if loglik >= self.loglik - 1e-9 or np.abs(move).max() < 1e-9:
                        break
                    move = move / 2
                self.beta, self.loglik, score, info = self.beta + move, loglik, score2, info2
            self.covariance = np.linalg.pinv(info, rcond=1e-10)
            self.se = np.where(np.diag(info) > 1e-12, np.sqrt(np.clip(np.diag(self.covariance), 0, None)), math.inf)
            self._tests = self._score_tests()
        finally:
            self.risk.unpersist()
            held.unpersist()

    def _columns(self) -> list[str]:
        return ["time", "survival", *[f"{c}{i}" for i in range(len(self.patterns)) for c in "nd"]]

    def _sums(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k, x = self.patterns.shape[1], self.patterns

        def measure(rows: np.ndarray) -> np.ndarray:
            out = np.zeros(1 + k + k * k)
            for row in rows:
                n, d = row[2::2], row[3::2]
                loglik, mean, cov = _moments(n, d, x, beta)
                out += np.concatenate([[loglik], d @ x - mean, cov.ravel()])
            return out

        total = totals(self.risk, self._columns(), measure, 1 + k + k * k)
        return float(total[0]), total[1 : 1 + k], total[1 + k :].reshape(k, k)

    def likelihood_ratio(self) -> tuple[float, int, float]:
        """Chi-square, degrees, p-value of all covariates together."""
        x, k = max(0.0, 2 * (self.loglik - self.base)), len(self.beta)
        return x, k, chi_square_tail(x, k)

    def _score_tests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, x, beta = self.patterns.shape[1], self.patterns, self.beta

        def measure(rows: np.ndarray) -> np.ndarray:
            out = np.zeros(k + 3 * k * k)
            for row in rows:
                _, mean, cov = _moments(row[2::2], row[3::2], x, beta)
                g = 1 - row[1]
                out += np.concatenate([g * (row[3::2] @ x - mean), cov.ravel(), g * cov.ravel(), g * g * cov.ravel()])
            return out

        total = totals(self.risk, self._columns(), measure, k + 3 * k * k)
        return total[:k], *(total[k + i * k * k : k + (i + 1) * k * k].reshape(k, k) for i in range(3))

    def schoenfeld(self) -> list[tuple[float, int, float]]:
        """Score tests of effects that change with 1 - Kaplan-Meier survival: chi-square, degrees, p-value of each covariate, and
        last of all together."""
        u, plain, once, twice = self._tests
        spread = twice - once.T @ np.linalg.pinv(plain, rcond=1e-10) @ once
        out = []
        for i in range(len(u)):
            x = float(u[i] ** 2 / spread[i, i]) if spread[i, i] > 1e-12 else 0.0
            out.append((x, 1, chi_square_tail(x, 1)))
        x = float(u @ np.linalg.pinv(spread, rcond=1e-10) @ u) if len(u) else 0.0
        return [*out, (x, len(u), chi_square_tail(x, len(u)))]


def dummies(df: DataFrame, column: str, reference) -> tuple[DataFrame, list[str]]:
    """df with a column of 0 and 1 for each value of a column but the reference; null stays null."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(PATTERNS + 1).collect() if r[0] != reference]
    names = {f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in values}
    return df.withColumns(names), list(names)
