"""Statistical models: fits are distributed by Spark's own learners or run on aggregates of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import stats, subsets
from lodestrata.operators.forest import mixed
from lodestrata.operators.passes import matrix, quadratic, totals


def with_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


def expanded(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with all products of two columns and all squares, and the names of all terms."""
    terms = {f"{a}:{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}
    return df.withColumns(terms), [*columns, *terms]


def _held(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The numbers alone, persisted, of rows without a null."""
    return df.select([F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate([*columns, *more])]).dropna().persist()


def stepwise(df: DataFrame, columns: list[str], label: str, by: str = "aic") -> list[tuple]:
    """Forward and backward selection for a logistic model: (step, change, columns, criterion) of every step, the first
    with the intercept alone. All models of a step are fitted together: a Newton step of all of them is one pass over the rows."""
    return stepwise_by(df, columns, label, [by])[by]


def stepwise_by(df: DataFrame, columns: list[str], label: str, criteria: list[str]) -> dict[str, list[tuple]]:
    """stepwise() for each criterion; a set of columns is fitted once for all of them."""
    rows = _held(df, columns, label)
    try:
        n, names = rows.count(), rows.columns
        losses: dict[frozenset, float] = {}
        at = {c: i for i, c in enumerate(columns)}

        def walk(by: str) -> list[tuple]:
            def fitted(sets: list[list[str]]) -> list[float]:
                new = sorted({tuple(sorted(at[c] for c in s)) for s in sets} - set(losses))
                if new:
                    losses.update({s: loss for s, (loss, _) in subsets.criteria(rows, names[:-1], names[-1], new, n, "loss").items()})
                each = 2.0 if by == "aic" else math.log(max(n, 1))
                return [2 * losses[tuple(sorted(at[c] for c in s))] + each * (len(s) + 1) for s in sets]

            chosen: list[str] = []
            out = [(0, "", [], fitted([[]])[0])]
            while True:
                tries = [(f"+{c}", [*chosen, c]) for c in columns if c not in chosen] + [(f"-{c}", [x for x in chosen if x != c]) for c in chosen]
                found = [(v, *t) for v, t in zip(fitted([own for _, own in tries]), tries, strict=True)]
                best = min(found, default=(math.inf, "", []))
                if best[0] >= out[-1][3] - 1e-9:
                    return out
                chosen = best[2]
                out.append((len(out), best[1], chosen, best[0]))

        return {by: walk(by) for by in criteria}
    finally:
        rows.unpersist()


class Lasso:
    """The model of the lambda chosen: coefficients and intercept; area: of each lambda, the mean over folds of the area below the ROC curve."""

    def __init__(self, columns: list[str], coefficients: np.ndarray, intercept: float, lam: float, area: dict[float, float]):
        from pyspark.ml.linalg import Vectors

        self.columns, self.coefficients, self.intercept, self.lam, self.area = columns, Vectors.dense(coefficients), float(intercept), lam, area

    def probability(self) -> Column:
        at = sum((F.col(f"`{c}`") * float(b) for c, b in zip(self.columns, self.coefficients.toArray(), strict=True)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-at))


#: A score counts as its first bits (of a double), so that the area below a curve is a sum over a bounded number of scores; others are ties.
SCORE_BITS = 20


def lasso(df: DataFrame, columns: list[str], label: str, fold: str, folds: int = 5, grid: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)) -> Lasso:
    """A logistic LASSO whose lambda is chosen by the area below the ROC curve over folds that a column gives; ties to the first of the grid.

    The loss is the mean over rows, the penalty lambda times the sum of coefficients on columns of deviation 1. The fits of every
    fold and lambda go on together: a pass over the rows adds up slopes and curvatures of all, and the penalised quadratic is
    minimised on the driver, by coordinates. Rows with a null are left out."""
    rows = _held(df, columns, label, fold)
    try:
        return _lasso(rows, columns, folds, grid)
    finally:
        rows.unpersist()


def _penalised(curve: np.ndarray, slope: np.ndarray, beta: np.ndarray, lam: float) -> np.ndarray:
    """The least of slope (b - beta) + (b - beta) curve (b - beta) / 2 + lam |b|, the first (the constant) free, by coordinates."""
    b, g, use = beta.copy(), slope.copy(), np.diag(curve) > 1e-14
    for sweep in range(1, 10_001):
        most = 0.0
        for j in np.flatnonzero(use):
            want = b[j] - g[j] / curve[j, j]
            new = want if j == 0 else math.copysign(max(abs(want) - lam / curve[j, j], 0.0), want)
            if new != b[j]:
                g += curve[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]) * math.sqrt(curve[j, j]))
                b[j] = new
        if most < 1e-12:
            break
        if sweep % 25 == 0:  # the exact least, if signs are those of now
            on = use & ((b != 0) | (np.arange(len(b)) == 0))
            pull = np.where(np.arange(len(b)) == 0, 0.0, lam) * np.sign(b)
            exact = np.zeros(len(b))
            exact[on] = np.linalg.lstsq(curve[np.ix_(on, on)], (curve @ beta - slope - pull)[on], rcond=1e-14)[0]
            rest = np.abs(slope + curve @ (exact - beta))[use & ~on]
            if (np.sign(exact) == np.sign(b))[1:].all() and (rest <= lam * (1 + 1e-9)).all():
                return exact
    return b


def _lasso(rows: DataFrame, columns: list[str], folds: int, grid: tuple[float, ...]) -> Lasso:
    names, k = rows.columns, len(columns) + 1

    def moments(x: np.ndarray) -> np.ndarray:
        own = np.zeros((folds + 1, 1 + 2 * (k - 1)))
        for f in range(folds):
            z = x[x[:, -1] == f, : k - 1] - shift
            own[f] = np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])
        z = x[:, : k - 1] - shift
        own[folds] = np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])
        return own.ravel()

    first = rows.agg(F.count("*"), *[F.avg(c) for c in names[: k - 1]]).first()
    if not first[0]:
        raise ValueError("there are no whole rows")
    shift = np.array(first[1:], dtype=np.float64)
    total = totals(rows, names, moments, (folds + 1) * (1 + 2 * (k - 1))).reshape(folds + 1, -1)
    total = np.concatenate([total[folds] - total[:folds], total[folds:]])  # of the rows that each fit learns from, all of them last
    n = np.maximum(total[:, 0], 1)
    mean = total[:, 1:k] / n[:, None]
    deviation = np.sqrt(np.maximum(total[:, k:] / n[:, None] - mean**2, 0) * (n / np.maximum(n - 1, 1))[:, None])
    scale = np.where(deviation > 1e-12, deviation, np.inf)  # a constant column keeps the coefficient 0

    def fitted(problems: list[tuple[int, float]]) -> list[np.ndarray]:
        """Coefficients (the constant first), on the columns less shift, of each fit: (the fold left out, or folds for none; lambda)."""
        beta = [np.zeros(k) for _ in problems]
        best, kept, going = [math.inf] * len(problems), [b.copy() for b in beta], list(range(len(problems)))
        size = 1 + k + k * k
        for _ in range(60):

            def measure(x: np.ndarray, going: list = going, beta: list = beta) -> np.ndarray:
                out, y = [], x[:, -2]
                z = np.column_stack([np.ones(len(x)), x[:, : k - 1] - shift])
                parts = {f: (z, y) if f == folds else (z[x[:, -1] != f], y[x[:, -1] != f]) for f in {problems[p][0] for p in going}}
                for p in going:
                    own, hit = parts[problems[p][0]]
                    at = own @ (beta[p] / np.r_[1.0, scale[problems[p][0]]])
                    share = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
                    out.append(np.concatenate([[(np.logaddexp(0, at) - hit * at).sum()], own.T @ (share - hit), quadratic(own, share * (1 - share))]))
                return np.concatenate(out)

            sums = totals(rows, names, measure, len(going) * size).reshape(len(going), size)
            still = []
            for p, own in zip(going, sums, strict=True):
                f, lam = problems[p]
                by = 1 / np.r_[1.0, scale[f]]
                value = own[0] / n[f] + lam * np.abs(beta[p][1:]).sum()
                if value > best[p] + 1e-12:  # too far: half way back
                    beta[p] = (beta[p] + kept[p]) / 2
                    if np.abs(beta[p] - kept[p]).max() > 1e-9:
                        still.append(p)
                    continue
                best[p], kept[p] = value, beta[p]
                move = _penalised(own[1 + k :].reshape(k, k) * np.outer(by, by) / n[f], own[1 : 1 + k] * by / n[f], beta[p], lam)
                if np.abs(move - beta[p]).max() > 1e-9 * max(1.0, np.abs(move).max()):
                    beta[p] = move
                    still.append(p)
            going = still
            if not going:
                break
        return [b / np.r_[1.0, scale[f]] for b, (f, _) in zip(kept, problems, strict=True)]

    problems = [(f, lam) for f in range(folds) for lam in grid]
    weights = np.array(fitted(problems))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each fit, rows of the fold it did not see, by label and the first bits of their score."""
        for batch in batches:
            x = matrix(batch)
            for f in range(folds):
                own = x[x[:, -1] == f]
                if not len(own):
                    continue
                z = np.column_stack([np.ones(len(own)), own[:, : k - 1] - shift])
                for i, p in enumerate(range(f * len(grid), (f + 1) * len(grid))):
                    bits = (z @ weights[p] + 0.0).view(np.int64) >> (64 - SCORE_BITS)
                    bits = np.where(bits < 0, -bits - (1 << (SCORE_BITS - 1)), bits)  # in the order of the scores
                    bits, where = np.unique(bits, return_inverse=True)
                    hits = np.bincount(where, own[:, -2], len(bits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), v), t) for v, t in ((f, pa.int32()), (i, pa.int32()))] + [pa.array(bits), pa.array(hits), pa.array(np.bincount(where, minlength=len(bits)) - hits)], names=["fold", "place", "score", "hits", "misses"])

    if len(grid) > 1:
        by = rows.mapInArrow(scored, "fold int, place int, score long, hits double, misses double").groupBy("fold", "place", "score").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
        below = F.coalesce(F.sum("misses").over(Window.partitionBy("fold", "place").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # at most 2^SCORE_BITS rows
        areas = by.withColumn("won", F.col("hits") * (below + F.col("misses") / 2)).groupBy("fold", "place").agg((F.try_divide(F.sum("won"), F.sum("hits") * F.sum("misses"))).alias("area"))
        area = {grid[r.place]: r.area for r in areas.groupBy("place").agg(F.avg("area").alias("area")).collect()}
    else:
        area = {}
    lam = max(grid, key=lambda g: area.get(g) or -1.0)
    own = fitted([(folds, lam)])[0]
    return Lasso(columns, own[1:], own[0] - own[1:] @ shift, lam, area)


def kmeans_table(df: DataFrame, columns: list[str], ks=range(1, 11), starts: int = 10, seed: int = 42) -> list[tuple]:
    """k, sse, r2, semi-partial r2 and BIC: the best of so many starts for each k. Equal rows are one that weighs as many.

    All starts of all k go on together, so a round is one pass over the rows. Starts are chosen by k-means++: each row draws from a
    hash of its numbers, and the least of -log(u) / (weight x squared distance to the centers so far) becomes the next center."""
    rows = df.select([F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).dropna()
    names = rows.columns
    data = rows.groupBy(*names).agg(F.count("*").cast("double").alias("_n")).withColumn("_key", F.shiftrightunsigned(F.xxhash64(*names), 11)).persist()
    try:
        first = data.agg(F.sum("_n"), *[F.sum(F.col(c) * F.col("_n")) for c in names]).first()
        n, d = int(first[0] or 0), len(columns)
        mean = np.array([v / n if n else 0.0 for v in first[1:]])
        spread = totals(data, [*names, "_n"], lambda x: np.array([(((x[:, :-1] - mean) ** 2).sum(axis=1) * x[:, -1]).sum()]), 1)[0] if n else 0.0
        fits = [(k, i) for k in ks if k > 1 for i in range(starts * DRAWS)]
        sse = [(1, float(spread))]
        if n and fits:
            cost = _lloyd(data, names, _starts(data, names, fits, seed), d)
            for k in dict.fromkeys(k for k, _ in fits):
                sse.append((k, min(c for (q, _), c in zip(fits, cost, strict=True) if q == k)))
        return stats.cluster_fit(sse, n, d)
    finally:
        data.unpersist()


#: A start is the best of so many draws of k-means++.
DRAWS = 4


def _distance(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)


def _starts(data: DataFrame, names: list[str], fits: list[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """k-means++ for (k, start) each; one pass a center. Fewer centers where there are fewer different rows."""
    centers: list[np.ndarray] = [np.zeros((0, len(names))) for _ in fits]
    for step in range(max(k for k, _ in fits)):
        open_ = [p for p, (k, _) in enumerate(fits) if k > step and len(centers[p]) == step]

        def drawn(batches: Iterator[pa.RecordBatch], step: int = step, open_: list = open_) -> Iterator[pa.RecordBatch]:
            least: dict[int, tuple[float, list[float]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch)
                for p in open_:
                    u = (mixed(x[:, -1], 1000 * fits[p][0] + 100_000 * fits[p][1] + step, seed) >> np.uint64(11)).astype(np.float64) / 2**53
                    far = _distance(x[:, :-2], centers[p]).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        race = np.where(far > 0, -np.log(u + 2.0**-54) / (x[:, -2] * far), np.inf)
                    i = int(race.argmin())
                    if race[i] < least.get(p, (np.inf, []))[0]:
                        least[p] = (float(race[i]), x[i, :-2].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([v for v, _ in least.values()], pa.float64()), pa.array([c for _, c in least.values()], pa.list_(pa.float64()))], names=["fit", "race", "center"])

        for r in data.select(*names, "_n", F.col("_key").cast("double")).mapInArrow(drawn, "fit int, race double, center array<double>").groupBy("fit").agg(F.min(F.struct("race", "center")).alias("m")).collect():
            centers[r.fit] = np.vstack([centers[r.fit], r.m.center])
    return centers


def _lloyd(data: DataFrame, names: list[str], centers: list[np.ndarray], d: int, rounds: int = 20, moved: float = 1e-4) -> list[float]:
    """The cost of each fit after Lloyd's rounds, which end where no center moves further than `moved`."""
    cost, going = [0.0] * len(centers), list(range(len(centers)))
    for step in range(rounds + 1):
        sizes = [len(centers[p]) * (1 + d) + 1 for p in going]

        def measure(x: np.ndarray, going: list = going, centers: list = list(centers)) -> np.ndarray:
            out, w = [], x[:, -1]
            for p in going:
                far = _distance(x[:, :-1], centers[p])
                own, k = far.argmin(axis=1), len(centers[p])
                sums = [np.bincount(own, w * v, k) for v in (np.ones(len(x)), *x[:, :-1].T)]
                out.append(np.concatenate([[(far[np.arange(len(x)), own] * w).sum()], *sums]))
            return np.concatenate(out)

        parts = np.split(totals(data, [*names, "_n"], measure, sum(sizes)), np.cumsum(sizes)[:-1])
        still = []
        for p, own in zip(going, parts, strict=True):
            cost[p], sums = float(own[0]), own[1:].reshape(1 + d, -1)
            new = np.where(sums[0] > 0, sums[1:] / np.maximum(sums[0], 1e-300), centers[p].T).T
            if ((new - centers[p]) ** 2).sum(axis=1).max(initial=0) > moved**2:
                still.append(p)
            centers[p] = new
        going = still
        if not going or step == rounds:
            return cost
    return cost


class Cox:
    """Proportional hazards on one yes-or-no covariate, tied times exact: given how many at risk have an event at a time, those
    of the covariate follow a noncentral hypergeometric law. Needs one row for each time: at risk and events by covariate."""

    def __init__(self, rows: list[tuple[float, int, int, int, int]]):
        """rows: time, at risk without and with the covariate, events, events with the covariate."""
        self.rows = [r for r in rows if r[3] > 0]
        self.beta = 0.0
        self.base = self._sums(0.0)[0]
        for _ in range(50):
            self.loglik, score, info = self._sums(self.beta)
            if info <= 1e-12 or abs(score) < 1e-9:
                break
            self.beta += max(-2.0, min(2.0, score / info))
        self.loglik, _, info = self._sums(self.beta)
        self.se = 1 / math.sqrt(info) if info > 1e-12 else math.inf

    def _moments(self, row: tuple, beta: float) -> tuple[float, float, float]:
        _, r0, r1, d, dx = row
        j = np.arange(max(0, d - r0), min(d, r1) + 1)
        lg = np.vectorize(math.lgamma, otypes=[float])
        log = lg(r1 + 1) - lg(j + 1) - lg(r1 - j + 1) + lg(r0 + 1) - lg(d - j + 1) - lg(r0 - d + j + 1) + beta * j
        top = log.max()
        w = np.exp(log - top)
        mean = float((w * j).sum() / w.sum())
        own = float(log[j == dx][0] - top - math.log(w.sum()))
        return own, mean, float((w * (j - mean) ** 2).sum() / w.sum())

    def _sums(self, beta: float) -> tuple[float, float, float]:
        parts = [(*self._moments(r, beta), r[4]) for r in self.rows]
        return sum(p[0] for p in parts), sum(p[3] - p[1] for p in parts), sum(p[2] for p in parts)

    def likelihood_ratio(self) -> tuple[float, float]:
        """Chi-square of one degree and its p-value."""
        x = max(0.0, 2 * (self.loglik - self.base))
        return x, math.erfc(math.sqrt(x / 2))

    def schoenfeld(self) -> tuple[float, float]:
        """Score test of an effect that changes with the order of the times: chi-square of one degree, p-value."""
        g = np.arange(1.0, len(self.rows) + 1)
        parts = [(r[4], *self._moments(r, self.beta)[1:]) for r in sorted(self.rows)]
        res, var = np.array([p[0] - p[1] for p in parts]), np.array([p[2] for p in parts])
        spread = (g * g * var).sum() - (g * var).sum() ** 2 / var.sum() if len(parts) and var.sum() > 0 else 0.0
        x = float((g * res).sum() ** 2 / spread) if spread > 0 else 0.0
        return x, math.erfc(math.sqrt(x / 2))


def risk_table(df: DataFrame, time: str, event: str, x: str) -> list[tuple]:
    """One row a time: at risk without and with x, events, events with x. Rows are counted by time in Spark."""
    per = df.groupBy(time).agg(F.sum(1 - F.col(x)).alias("n0"), F.sum(x).alias("n1"), F.sum(event).alias("d"), F.sum(F.col(event) * F.col(x)).alias("dx"))
    out, r0, r1 = [], 0, 0
    for r in per.orderBy(F.desc(time)).collect():  # one row a distinct time
        r0, r1 = r0 + r.n0, r1 + r.n1
        out.append((float(r[time]), int(r0), int(r1), int(r.d), int(r.dx)))
    return out[::-1]


def factors(df: DataFrame, columns: list[str], k: int, rounds: int = 100) -> np.ndarray:
    """Loadings (columns x k) of principal factors of the correlations, turned by varimax. The correlations are aggregates."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)]).first()
    c = np.eye(len(columns))
    for n, (a, b) in enumerate(pairs):
        i, j = columns.index(a), columns.index(b)
        c[i, j] = c[j, i] = 1.0 if i == j else (row[n] if row[n] is not None and np.isfinite(row[n]) else 0.0)
    values, vectors = np.linalg.eigh(c)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.clip(values[::-1][:k], 0, None))
    out, p = load.copy(), len(columns)
    for _ in range(rounds):
        moved = 0.0
        for i in range(out.shape[1]):
            for j in range(i):
                x, y = out[:, i].copy(), out[:, j].copy()
                u, v = x * x - y * y, 2 * x * y
                angle = math.atan2(2 * (u * v).sum() - 2 * u.sum() * v.sum() / p, (u * u - v * v).sum() - (u.sum() ** 2 - v.sum() ** 2) / p) / 4
                out[:, i], out[:, j] = x * math.cos(angle) + y * math.sin(angle), y * math.cos(angle) - x * math.sin(angle)
                moved = max(moved, abs(angle))
        if moved < 1e-9:
            break
    return out * np.where(out.sum(0) < 0, -1, 1)
