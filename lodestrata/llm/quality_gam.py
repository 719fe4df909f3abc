"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Cyclic boosting visits one feature at a time and adds a shallow tree of at most
three leaves over its bins to the feature's lookup table; then the pairs of features whose quadrants explain
most of what is left get tables of two dimensions, boosted in the same way. A score is the logistic function
of an intercept and one table entry for each feature and pair, added up for whole Arrow batches at once.

Features come from the text alone, by JVM expressions over each row; only their numbers go to Python. The
model is fitted on the driver to a bounded sample of labelled rows (SAMPLE, chosen by a hash).

Edge cases: a null text counts as empty and is scored; of several labels of a document the worst counts; null
and other labels are skipped; of rows that share a labelled doc_id one is learned from, the least in its features; without labels every score is 0.5, and with labels of one kind only that kind's
smoothed share; rows that share a doc_id are scored each on its own; a text of any length is one row; an empty table
gives no rows; other columns are ignored, or carried by keep_good() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import SPACE, small_batches, text_or_empty, tidy, words_of

SAMPLE = 20_000
BINS = 48
ROUNDS = 80
PAIRS = 6
PAIR_ROUNDS = 30
RATE = 0.2
RIDGE = 4.0
FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "shouts", "bars", "stops", "distinct", "repeated_lines", "line_length", "next_same"]


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, and FEATURES of text."""
    df = docs.select(*keep, text_or_empty().alias("_t"))
    bare = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    df = df.withColumns({"_w": words_of(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    df = df.withColumns({"_n": F.greatest(F.size("_w"), F.lit(1)), "_c": F.greatest(F.length("_t"), F.lit(1)), "_k": F.greatest(F.size("_l"), F.lit(1))})
    same = F.size(F.filter(F.zip_with(F.slice("_w", 2, F.size("_w")), F.col("_w"), lambda a, b: a == b), lambda x: x))
    of = {
        "log_words": F.log1p(F.size("_w")), "word_length": F.length(F.translate("_t", SPACE, "")) / F.col("_n"), "symbols": bare("[#*$%&|<>]+") / F.col("_n"),
        "capitals": bare(r"\p{Lu}+") / F.col("_c"), "digits": bare("[0-9]+") / F.col("_c"), "shouts": bare("!+") / F.col("_n"), "bars": bare("[|]+") / F.col("_n"),
        "stops": bare("[.,;]+") / F.col("_n"), "distinct": F.size(F.array_distinct("_w")) / F.col("_n"), "repeated_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.col("_k"),
        "line_length": F.log1p(F.col("_n") / F.col("_k")), "next_same": same / F.col("_n"),
    }
    return df.select(*keep, *[of[f].cast("double").alias(f) for f in FEATURES])


def _leaves(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Best tree of at most three leaves over ordered bins: the value of each bin, by Newton steps."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    gain = lambda a, b: a * a / (b + RIDGE)
    cuts, values = [0, len(grad)], np.zeros(len(grad))
    for _ in range(2):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            g0, h0 = (g[lo - 1], h[lo - 1]) if lo else (0.0, 0.0)
            left_g, left_h = g[lo : hi - 1] - g0, h[lo : hi - 1] - h0
            all_g, all_h = g[hi - 1] - g0, h[hi - 1] - h0
            score = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            k = int(np.argmax(score))
            if score[k] > best[0]:
                best = (float(score[k]), lo + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        values[lo:hi] = -grad[lo:hi].sum() / (hess[lo:hi].sum() + RIDGE)
    return values


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree of depth two over a grid: one cut of each side, four leaves. Its gain and the value of each cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = []
    for x in (g, h):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        parts.append((a, b, c, x[-1, -1] - a - b - c))
    score = sum(p * p / (q + RIDGE) for p, q in zip(*parts, strict=True))
    if not score.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    values = np.zeros_like(grad)
    for n, cell in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        values[cell] = -parts[0][n][i, j] / (parts[1][n][i, j] + RIDGE)
    return float(score[i, j]) - float(g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)), values


class Gam:
    """Lookup tables over binned features, and over pairs of them in coarser bins."""

    def __init__(self, width: int):
        self.edges = [np.zeros(0)] * width
        self.coarse = [np.zeros(0)] * width
        self.tables = [np.zeros(1)] * width
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n, width = x.shape
        if not n:
            return self
        share = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        for k in range(width):
            cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
            self.edges[k], self.coarse[k] = cuts, np.unique(np.quantile(x[:, k], np.linspace(0, 1, 13)[1:-1]))
            self.tables[k] = np.zeros(len(cuts) + 1)
        bins = [np.searchsorted(self.edges[k], x[:, k], side="right") for k in range(width)]
        score = np.full(n, self.intercept)
        for _ in range(ROUNDS):
            for k in range(width):
                p = 1 / (1 + np.exp(-score))
                size = len(self.tables[k])
                step = RATE * _leaves(np.bincount(bins[k], p - y, size), np.bincount(bins[k], p * (1 - p), size))
                self.tables[k] += step
                score += step[bins[k]]
        low = [np.searchsorted(self.coarse[k], x[:, k], side="right") for k in range(width)]

        def grid(i: int, j: int) -> tuple[float, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            return _quadrants(np.bincount(cell, p - y, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape))

        best = sorted(((-grid(i, j)[0], i, j) for i in range(width) for j in range(i)))[:PAIRS]
        tables = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for _, i, j in best}
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in tables.items():
                step = RATE * grid(i, j)[1]
                table += step
                score += step[low[i], low[j]]
        self.pairs = [(i, j, t) for (i, j), t in tables.items()]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def held_out(doc_id: str = "doc_id"):
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of labels.quality, from at most `sample` labelled rows outside the held-out fold."""
    truth = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = features(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality")  # at most `sample` ids are sent to each task
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")  # and one row of each comes back
    x = np.nan_to_num(rows[FEATURES].to_numpy(dtype=np.float64).reshape(-1, len(FEATURES)))
    return Gam(len(FEATURES)).fit(x, rows["quality"].to_numpy(dtype=np.float64))


def _scorer(model: Gam, extra: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).reshape(-1, len(FEATURES)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*extra, "score", "predicted"])

    return score


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")), "doc_id", "held_out")
    return rows.mapInArrow(_scorer(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam) -> DataFrame:
    """The rows of docs that the model predicts to be good, with all their columns."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).reshape(-1, len(FEATURES)))
            yield batch.select(["row"]).filter(pa.array(model.score(x) >= 0.5))

    small_batches(docs.sparkSession)
    rows = features(docs.select(F.struct("*").alias("row"), "text"), "row")
    return rows.mapInArrow(tidy(good), rows.select("row").schema).select("row.*")
