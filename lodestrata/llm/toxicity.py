"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Two lexicons: a short list of insults, and terms learned from the labelled rows: words and beginnings of words (3 to 7 letters)
whose share of toxic documents is high beyond chance, counted by Spark over the distinct terms of each document. Features
are densities and counts of their hits, the densest stretch of 50 words, hits near a second person, capitals, punctuation, and
insults that are spelled to hide (digits for letters, masks, stretched or split letters), which count as if spelled plainly too. The labelled rows are cut into
four folds; a row's learned terms, and the raw score that the calibration sees, come from the other three, so neither has seen
its label. Isotonic regression of those scores gives probabilities, with a hundredth of the trees' own so that ties keep their order.

Fitted on the driver to numbers of a bounded sample (SAMPLE labelled ids, chosen by a hash); at most TERMS terms are learned.
Texts are scored one Arrow batch at a time, whole.

Edge cases: a null text counts as empty and is scored; of several labels of a document the worst counts; null and other labels
are skipped; of rows that share a labelled doc_id one is learned from, that of the least text; without labels every score is 0.05,
with labels of one kind only that kind's smoothed share; rows that share a doc_id are scored each on its own; a null doc_id is
scored and not held out; a text of any length is one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import forget, keep, small_batches, text_or_empty, tidy

SAMPLE = 20_000
TERMS = 4000
FOLDS = 4
MIN_DOCS = 4
STEMS = (3, 4, 5, 6, 7)
WINDOW = 50
NEAR = 5
TREES = 80
DEPTH = 3
BINS = 64
RATE = 0.15
RIDGE = 2.0
THRESHOLD = 0.3

#: Insults.
INSULTS = frozenset(
    "airhead bastard bigot bonehead brainless cheater clown cockroach contemptible coward creep cretin degenerate delusional despicable dimwit disgrace disgusting dolt dork dumb dumbass "
    "dummy dunce failure filth filthy fool freak garbage gross halfwit hideous hypocrite idiot idiotic ignorant imbecile incompetent jerk laughingstock liar loser lowlife lunatic maggot "
    "miserable moron moronic nitwit numbskull parasite pathetic pig psycho rat repulsive revolting ridiculous scum scumbag shameful shithead sicko simpleton sleazy slimy snake stupid "
    "swine thug traitor trash twit ugly useless vermin vile weasel weirdo worm worthless wretch".split()
)
#: The second person in four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre tú ti usted tu tus ustedes vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans("01345789@$!|+", "oieastbgasiit")

LETTERS = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"(.)\1{2,}")
MASKS = re.compile(r"[*#_.\-~]+")
AROUND = "\"'()[]{}<>,;:?.!"
LONGEST = 40

FEATURES = ["log_words", "insults", "insult_count", "learned", "learned_sum", "densest", "distinct_hits", "near_you", "near_you_count", "second_person", "capitals", "shouted", "marks", "loud", "hidden", "hidden_count"]


def units(word: str) -> list[str]:
    """The terms a lower-case word counts for: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _runs(marks: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true values."""
    ends = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return ends[1::2] - ends[::2]


class _Seen(dict):
    """What a function gives for each key, remembered; forgets all when it grows."""

    def __init__(self, of, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.of(key)
        return value


class Measure:
    """Numbers of a text, given the weights of learned terms."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.strong = INSULTS | {t for t, w in weights.items() if w >= 2 and not t.endswith("*") and len(t) > 3}
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for t in sorted(self.strong):
            self.by_shape.setdefault((len(t), t[0]), []).append(t)
        self.starts = {t.rstrip("*")[:3] for t in (*weights, *INSULTS, *SECOND)}  # a word that starts otherwise counts for nothing
        self.words = _Seen(self._word)

    def _word(self, word: str):
        """(insult, learned weight, second person) of a word, None where all are nothing."""
        found = (word in INSULTS, max(self.weights.get(u, 0.0) for u in units(word)) if len(word) < 60 else 0.0, word in SECOND)
        return found if any(found) else None

    def _hides(self, token: str) -> str:
        """The insult that a token with other characters than letters spells, or nothing."""
        if token.strip("*_~-") in self.strong:  # emphasis hides nothing
            return ""
        for bare in (MASKS.sub("", token).translate(LEET), MASKS.sub("", token.rstrip("!").translate(LEET))):
            if bare in self.strong:
                return bare
        if "*" not in token and "#" not in token or token[0] in "*#":
            return ""
        return next((t for t in self.by_shape.get((len(token), token[0]), ()) if all(a == b or a in "*#" for a, b in zip(token, t, strict=True))), "")

    def _stretched(self, low: str, at: int) -> tuple[str, str]:
        """The letters around a place where one repeats, and the insult they draw out or nothing."""
        a = b = at
        while a and at - a < LONGEST and low[a - 1].isalpha():
            a -= 1
        while b < len(low) and b - at < LONGEST and low[b].isalpha():
            b += 1
        bare = STRETCHED.sub(r"\1", low[a:b])
        return low[a:b], bare if low[a:b] not in self.strong and bare in self.strong else ""

    def plain_words(self, low: str) -> tuple[list[str], int]:
        """The words of a text, insults that are spelled to hide among them plainly; and how many of these there are."""
        tokens, hidden = low.split(), 0
        plain = {t: found for t in {t for t in tokens if not t.isalpha()} if 3 < len(bare := t.strip(AROUND)) < LONGEST and not bare.isalpha() and (found := self._hides(bare))}
        if plain:
            hidden = sum(t in plain for t in tokens)
            low = " ".join(plain.get(t, t) for t in tokens)
        words, c = LETTERS.findall(low), _codes(low)
        if len(c) > 2:
            triple = np.concatenate([[False], (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 96)])
            drawn = dict(self._stretched(low, i) for i in np.flatnonzero(triple[1:] & ~triple[:-1]).tolist() if low[i].isalpha())
            if any(drawn.values()):
                hidden += sum(bool(drawn.get(w)) for w in words)
                words = [drawn.get(w) or w for w in words]
        return words, hidden

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        (words, hidden), starts, seen = self.plain_words(low), self.starts, self.words
        n = max(1, len(words))
        hits = [(i, v) for i, w in enumerate(words) if w[:3] in starts and (v := seen[w])]
        insults = sum(v[0] for _, v in hits)
        weight = np.array([v[1] for _, v in hits])
        bad = np.array([i for i, v in hits if v[0] or v[1] >= 2], dtype=np.int64)
        you = np.array([i for i, v in hits if v[2]], dtype=np.int64)
        densest, near = 0.0, 0
        if len(hits):
            at, total = np.array([i for i, _ in hits]), np.concatenate([[0.0], np.cumsum(weight)])
            densest = float((total[np.searchsorted(at, at + WINDOW)] - total[:-1]).max())
        if len(bad) and len(you):
            near = int((np.searchsorted(you, bad + NEAR, side="right") > np.searchsorted(you, bad - NEAR)).sum())
        c = _codes(text)
        capitals = _runs(((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)))
        marks = _runs((c == 33) | (c == 63))  # ! and ?
        distinct = len({words[i] for i in bad.tolist()})
        return [
            np.log1p(len(words)), insults / n, np.log1p(insults), weight.sum() / n, np.log1p(weight.sum()), densest, np.log1p(distinct), near / n, np.log1p(near), len(you) / n,
            capitals.sum() / max(1, len(text)), (capitals > 2).sum() / n, marks.sum() / n, (marks > 1).sum() / n, hidden / n, np.log1p(hidden),
        ]


class Trees:
    """Boosted trees of a fixed depth over binned features, by Newton steps of the logistic loss."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.leaves: list[np.ndarray] = []
        self.intercept = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]) if len(x) else np.zeros(x.shape, dtype=np.int64)

    @staticmethod
    def _walk(bins: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for feature, cut in tree:
            node = 2 * node + (bins[rows, feature[node]] > cut[node])
        return node

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 10)
        self.intercept = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for k in range(x.shape[1])]
        bins, score = self._binned(x), np.full(len(y), self.intercept)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess, node, tree = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64), []
            for level in range(DEPTH):
                size = (1 << level) * (BINS + 1)
                best = np.full(1 << level, 1e-9)
                feature, cut = np.zeros(1 << level, dtype=np.int64), np.full(1 << level, BINS, dtype=np.int64)  # a cut at the last bin splits nothing
                for k in range(x.shape[1]):
                    cell = node * (BINS + 1) + bins[:, k]
                    g, h = (np.bincount(cell, v, size).reshape(-1, BINS + 1).cumsum(axis=1) for v in (grad, hess))
                    gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                    gain[(h < 0.25) | (h[:, -1:] - h < 0.25)] = 0
                    top = gain.argmax(axis=1)
                    most = gain[np.arange(len(top)), top]
                    better = most > best
                    best[better], feature[better], cut[better] = most[better], k, top[better]
                tree.append((feature, cut))
                node = 2 * node + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = -RATE * np.bincount(node, grad, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + RIDGE)
            self.trees.append(tree)
            self.leaves.append(leaf)
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.intercept)
        if self.trees and len(x):
            bins = self._binned(x)
            for tree, leaf in zip(self.trees, self.leaves, strict=True):
                score += leaf[self._walk(bins, tree)]
        return score


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y in squares, by pooling neighbours that fall: (middle of each step, its height)."""
    order = np.argsort(raw, kind="stable")
    at, start = np.unique(raw[order], return_index=True)  # equal scores are one step from the start
    weight = np.diff(np.append(start, len(raw))).astype(np.float64)
    steps: list[list[float]] = []
    for x, n, total in zip(at, weight, np.add.reduceat(y[order], start) if len(start) else [], strict=True):
        steps.append([x * n, n, float(total)])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            x2, n2, t2 = steps.pop()
            steps[-1] = [steps[-1][0] + x2, steps[-1][1] + n2, steps[-1][2] + t2]
    return np.array([s[0] / s[1] for s in steps]), np.array([s[2] / s[1] for s in steps])


class Model:
    """Learned terms, trees and calibration."""

    def __init__(self, weights: dict[str, float], trees: Trees, steps: tuple[np.ndarray, np.ndarray] | None):
        self.weights, self.trees, self.steps = weights, trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        own = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
        return own if self.steps is None else 0.99 * np.interp(raw, *self.steps) + 0.01 * own


def held_out(doc_id: str = "doc_id"):
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def term_counts(sample: DataFrame, terms: int = TERMS) -> list:
    """For each term how many toxic (t0, t1, ...) and how many documents (n0, n1, ...) of each fold hold it: the `terms` terms that
    tell most, of those in MIN_DOCS toxic documents or more."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: (F.length(w) >= 3) & (F.length(w) < 60))
    df = sample.select("toxic", "fold", F.array_distinct(words).alias("w"))
    stems = [F.transform(F.filter("w", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    df = df.select("toxic", "fold", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
    in_fold = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{c}{k}") for c, v in (("t", F.col("toxic")), ("n", F.lit(1))) for k in range(FOLDS)]
    counts = df.groupBy("term").agg(*in_fold)
    t, n = (sum((F.col(f"{c}{k}") for k in range(1, FOLDS)), F.col(f"{c}0")) for c in "tn")
    tells = t / n * F.sqrt(t)
    return counts.where(t >= MIN_DOCS).orderBy(tells.desc(), "term").limit(terms).collect()


def weights(counts: list, toxic: np.ndarray, all_docs: np.ndarray, without: int | None = None) -> dict[str, float]:
    """Log odds of the terms that are toxic beyond chance, counted without one fold. toxic, all_docs: documents of each fold."""
    use = [k for k in range(FOLDS) if k != without]
    a, n = toxic[use].sum(), all_docs[use].sum()
    found = {}
    for r in counts:
        t, m = sum(r[f"t{k}"] for k in use), sum(r[f"n{k}"] for k in use)
        if t < MIN_DOCS - 1:
            continue
        odds = np.log((t + 0.5) / (a - t + 0.5)) - np.log((m - t + 0.5) / (n - a - m + t + 0.5))
        if odds >= 1 and odds >= 3 * np.sqrt(1 / (t + 0.5) + 1 / (m - t + 0.5)):
            found[r["term"]] = float(min(odds, 6.0))
    return found


def _measured(measures: list[dict[str, float]]):
    """A function for mapInArrow: numbers of each text, with the learned terms of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Measure(w) for w in measures]
        for batch in batches:
            x = [of[k](t) for k, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    return tidy(run)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labels.toxic, from at most `sample` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    truth = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` ids are sent to each task
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = keep(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("fold", fold), "toxic-sample")
    size = rows.groupBy("fold").agg(F.sum("toxic"), F.count("*")).collect()
    toxic, number = np.zeros(FOLDS), np.zeros(FOLDS)
    for k, t, n in size:
        toxic[k], number[k] = t, n
    if not 0 < toxic.sum() < number.sum():
        forget(rows)
        return Model({}, Trees().fit(np.zeros((int(number.sum()), len(FEATURES))), np.ones(int(number.sum())) if toxic.sum() else np.zeros(int(number.sum()))), None)
    counts = term_counts(rows)
    numbers = rows.mapInArrow(_measured([weights(counts, toxic, number, k) for k in range(FOLDS)]), "doc_id long, toxic int, fold int, x array<double>").toPandas().sort_values("doc_id")  # a row of each of `sample` documents comes back
    forget(rows)
    x, y, folds = np.array(numbers["x"].tolist()), numbers["toxic"].to_numpy(dtype=np.float64), numbers["fold"].to_numpy()
    raw = np.zeros(len(y))
    for k in np.unique(folds).tolist():
        raw[folds == k] = Trees().fit(x[folds != k], y[folds != k]).raw(x[folds == k])
    return Model(weights(counts, toxic, number), Trees().fit(x, y), isotonic(raw, y))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.weights)
        for batch in batches:
            x = np.array([measure(t.as_py()) for t in batch.column("text")], dtype=np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return tidy(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
