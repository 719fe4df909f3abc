"""Support vector machines with a search over C and kernels.

A kernel is a map of the columns: linear, or cosines of random projections whose inner products approach a Gaussian kernel.
For every kernel, C and class the squared hinge loss of that class against the rest is minimised by Newton steps. One pass over
the rows adds up gradients and curvatures of all these problems at once; a kernel's curvature has the square of its width.
The pair of kernel and C of the best accuracy on a validation split wins, ties to the first. Columns are scaled to mean 0 and
deviation 1 of the training rows. Rows with a null label or a null, NaN or infinite column teach nothing; in predictions such
components count as the mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.passes import scored, totals

STEPS = 12
MAX_CLASSES = 100


class Kernel:
    """linear, or (gamma given) a Gaussian kernel exp(-gamma |a - b|^2) in `width` random cosines; a constant is added to both."""

    def __init__(self, columns: int, gamma: float | None = None, width: int = 96, seed: int = 42):
        self.gamma = gamma
        rng = np.random.default_rng(seed)
        self.w = None if gamma is None else rng.normal(0, np.sqrt(2 * gamma), (columns, width))
        self.b = None if gamma is None else rng.uniform(0, 2 * np.pi, width)
        self.size = 1 + (columns if gamma is None else width)

    @property
    def name(self) -> str:
        return "linear" if self.gamma is None else f"rbf {self.gamma:g}"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mapped = x if self.w is None else np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.column_stack([mapped, np.ones(len(x))])


class Machine:
    """The kernel and C chosen, a row of weights for each class, and the accuracy of each pair tried."""

    def __init__(self, columns: list[str], mean: np.ndarray, deviation: np.ndarray, classes: list[float], kernel: Kernel, c: float, weights: np.ndarray, tried: list[tuple[str, float, float]]):
        self.columns, self.mean, self.deviation, self.classes, self.kernel, self.c, self.weights, self.tried = columns, mean, deviation, classes, kernel, c, weights, tried

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        return self.kernel(np.where(np.isfinite(z), z, 0.0)) @ self.weights.T

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction: the class of the largest margin, ties to the first."""
        return scored(df, self.columns, lambda x: {"prediction": np.array(self.classes, dtype=np.float64)[self.margins(x).argmax(axis=1)]}, {"prediction": T.DoubleType()})


def search(df: DataFrame, columns: list[str], label: str, valid: str, gammas: tuple[float, ...] = (0.1, 1.0), cs: tuple[float, ...] = (0.1, 1.0, 10.0), width: int = 96, seed: int = 42) -> Machine:
    """The best machine on the rows where the column `valid` is true, fitted to the others. C weighs the sum of the rows' losses."""
    double = {c: F.col(c).cast("double") for c in columns}
    fine = F.col(label).isNotNull() & F.col(valid).isNotNull()
    for x in double.values():
        fine &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.where(fine).select(*[x.alias(c) for c, x in double.items()], F.col(label).cast("double").alias("_y"), F.col(valid).cast("double").alias("_v")).persist()
    try:
        return _searched(rows, columns, gammas, cs, width, seed)
    finally:
        rows.unpersist()


def _searched(rows: DataFrame, columns: list[str], gammas: tuple[float, ...], cs: tuple[float, ...], width: int, seed: int) -> Machine:
    train = rows.where("_v = 0")
    classes = [r[0] for r in train.select("_y").distinct().orderBy("_y").limit(MAX_CLASSES + 1).collect()]
    if not 1 < len(classes) <= MAX_CLASSES:
        raise ValueError(f"2 to {MAX_CLASSES} classes are needed in the rows to learn from")
    first = train.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean, deviation = np.array(first[0::2], dtype=np.float64), np.array(first[1::2], dtype=np.float64)
    deviation[deviation < 1e-12] = 1.0
    kernels = [Kernel(len(columns)), *[Kernel(len(columns), g, width, seed) for g in gammas]]
    own = classes if len(classes) > 2 else classes[:1]  # of two classes the second's machine is the first's, turned round
    problems = [(k, c, y) for k in range(len(kernels)) for c in cs for y in own]
    weights = [np.zeros(kernels[k].size) for k, _, _ in problems]
    sizes = [1 + (s := kernels[k].size) + s * (s + 1) // 2 for k, _, _ in problems]
    best = [(np.inf, w) for w in weights]
    steps = [1.0] * len(problems)
    open_ = set(range(len(problems)))
    for _ in range(STEPS):
        now = list(weights)

        def measure(x: np.ndarray, now: list = now, going: frozenset = frozenset(open_)) -> np.ndarray:
            some = {problems[p][0] for p in going}
            z = [kernel((x[:, :-2] - mean) / deviation) if k in some else None for k, kernel in enumerate(kernels)]
            out = []
            for p, (k, _, y) in enumerate(problems):
                if p not in going:
                    out.append(np.zeros(sizes[p]))
                    continue
                sign = np.where(x[:, -2] == y, 1.0, -1.0)
                short = 1 - sign * (z[k] @ now[p])
                at = short > 0
                a = z[k][at]
                curve = (a.T @ a)[np.triu_indices(kernels[k].size)]
                out.append(np.concatenate([[(short[at] ** 2).sum()], -2 * a.T @ (sign[at] * short[at]), 2 * curve]))
            return np.concatenate(out)

        total = np.split(totals(train, [*columns, "_y", "_v"], measure, sum(sizes)), np.cumsum(sizes)[:-1])
        for p in sorted(open_):
            k, c, _ = problems[p]
            s, w = kernels[k].size, weights[p]
            loss = 0.5 * w @ w + c * total[p][0]
            if loss > best[p][0] + 1e-12:  # too far: half way back
                steps[p] /= 2
                weights[p] = best[p][1] + (w - best[p][1]) / 2
                if steps[p] < 1e-3:
                    weights[p] = best[p][1]
                    open_.discard(p)
                continue
            grad = w + c * total[p][1 : 1 + s]
            curve = np.zeros((s, s))
            curve[np.triu_indices(s)] = c * total[p][1 + s :]
            curve = curve + np.triu(curve, 1).T + np.eye(s)
            best[p], steps[p] = (loss, w), 1.0
            move = np.linalg.solve(curve, grad)
            if np.abs(move).max() < 1e-9:
                open_.discard(p)
            else:
                weights[p] = w - move
        if not open_:
            break
    of = len(classes)
    found = [x for _, w in best for x in ((w,) if of > 2 else (w, -w))]
    pairs = [(k, c) for k in range(len(kernels)) for c in cs]

    def right(x: np.ndarray) -> np.ndarray:
        z = [kernel((x[:, :-2] - mean) / deviation) for kernel in kernels]
        y, out = np.searchsorted(classes, x[:, -2]), [len(x)]
        for i, (k, _) in enumerate(pairs):
            w = np.array(found[i * of : (i + 1) * of], dtype=np.float64)
            known = np.isin(x[:, -2], classes)
            out.append(((z[k] @ w.T).argmax(axis=1) == y)[known].sum())
        return np.array(out, dtype=np.float64)

    hits = totals(rows.where("_v <> 0"), [*columns, "_y", "_v"], right, 1 + len(pairs))
    accuracy = hits[1:] / max(hits[0], 1)
    i = int(accuracy.argmax())
    k, c = pairs[i]
    own = np.array(found[i * of : (i + 1) * of], dtype=np.float64)
    return Machine(columns, mean, deviation, classes, kernels[k], c, own, [(kernels[k].name, c, float(a)) for (k, c), a in zip(pairs, accuracy, strict=True)])
