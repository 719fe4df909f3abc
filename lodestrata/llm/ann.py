"""Approximate nearest neighbours by multi-index hashing.

Unit vectors get binary codes: the signs of a learned rotation (principal axes turned so that signs lose
least, fitted to a bounded sample). A code is split into substrings, each indexed in a table of buckets of its own
within every block of vectors. By the pigeonhole, a code within Hamming radius r of a query has some
substring within its share of r, so probing the buckets of each table at that radius retrieves every code within r;
these are then reranked by cosine on the original floats, in double precision. Radii are learned too: the greatest is
the distance that covers the wanted share of true neighbours within the sample, where neighbours are farther
than among all vectors, so that the share among all is larger; and for each cosine one that covers that share of
the pairs at least so near. A query probes at NEAR bits first. If that finds k, the k-th cosine tells how far the
search must go on, so a query amid close neighbours never probes far. A block with fewer than k codes within the
greatest radius is searched whole, so every query gets its k nearest found if there are k.

Copies of a vector are one vector with the k + 1 smallest ids, before anything is searched; so a hot vector is one row.
Queries and vectors are dealt into blocks by a hash of the vector, as many as their number asks for (not the cores), and
meet block by block: a task holds one block of each, returns at most k + 1 rows for each of its queries, and these are
merged. A query must ask every block, as its neighbours may be in any: rows shuffled are vectors times query blocks and
queries times vector blocks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those without vec_id; vectors are near only to others of their length, and each length is searched by itself with codes of its own, one
after the other; ties go to the smaller vec_id; repeated rows are rows of their own,
and only the query's own row is left out; an empty table gives no rows; vectors of any length are whole in a task;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import keep

#: Vectors that the codes are fitted to and neighbours of it that the radius is learned from, at most.
SAMPLE = 4096
PROBES = 512
RECALL = 0.96
SUBSTRINGS = 4
#: Radius that every query probes at first; numbers of a block of vectors and of queries (components, at most about).
NEAR = 8
BLOCK = 400_000
QUERY_BLOCK = 64_000
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


class Codes:
    """Rotated sign codes of up to 64 bits, as 16-bit substrings."""

    def __init__(self, sample: np.ndarray, rounds: int = 20):
        unit = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
        self.bits = min(64, unit.shape[1])
        axes = np.linalg.svd(unit, full_matrices=True)[2][: self.bits].T if len(unit) >= 1 else np.eye(unit.shape[1])[:, : self.bits]
        low = unit @ axes
        turn = np.linalg.qr(np.random.default_rng(5).standard_normal((self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        self.turn = axes @ turn
        self.parts = -(-self.bits // 16)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """uint16 [n, parts]"""
        signs = np.zeros((len(vectors), 16 * self.parts), dtype=np.uint8)
        signs[:, : self.bits] = vectors @ self.turn >= 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _POPCOUNT[codes ^ code].sum(axis=1, dtype=np.int64)


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they stand."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class Radii:
    """How far codes of neighbours lie: at most `most` bits, or fewer where a neighbour's cosine is known."""

    def __init__(self, codes: Codes, sample: np.ndarray, k: int, recall: float = RECALL):
        own, found, pairs = codes.of(sample), [], []
        for i in range(min(PROBES, len(sample))):
            score = cosine(sample, sample[i])
            score[i] = -np.inf
            near = np.argsort(-score)[: min(k, len(sample) - 1)]
            d = distances(own, own[i])
            found.append(d[near])
            pairs.append(np.column_stack([score, d])[np.isfinite(score)])
        found = np.concatenate(found) if found else np.array([])
        self.most = int(np.ceil(np.quantile(found, recall))) if len(found) else codes.bits
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2))
        self.cosines = np.linspace(1.0, -1.0, 41)  # radius[i] covers pairs within a step of cosines[i]; the last pairs are the farthest
        radius, last = [], 0
        for c in self.cosines:
            here = pairs[np.abs(pairs[:, 0] - c) <= 0.05, 1]
            angle = codes.bits * np.arccos(np.clip(c, -1, 1)) / np.pi  # where the sample has no such pair: the mean and twice its spread
            last = max(last, int(np.ceil(np.quantile(here, recall))) if len(here) >= 20 else int(np.ceil(angle + 2 * np.sqrt(angle) + 1)))
            radius.append(last)
        self.radius = np.array(radius)

    def beyond(self, score: float) -> int:
        """Bits within which neighbours of at least this cosine lie."""
        return min(self.most, int(self.radius[np.searchsorted(-self.cosines, -score).clip(max=len(self.radius) - 1)]))


class Index:
    """The tables of one block: rows by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, start = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.r_[start, len(order)], order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius: substrings share it by the pigeonhole, buckets within that share are
        read, then whole codes are compared."""
        share, over = divmod(radius, len(self.tables))
        seen = np.zeros(len(self.codes), dtype=bool)
        for j, (values, start, order) in enumerate(self.tables):
            reach = share if j <= over else share - 1
            if reach >= 0:
                at = np.flatnonzero(_POPCOUNT[values ^ code[j]] <= reach)
                n = start[at + 1] - start[at]
                seen[order[np.repeat(start[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.codes[rows], code) <= radius]


def search_block(codes: Codes, radii: Radii, k: int, queries, block) -> dict[str, list]:
    """The k + 1 best rows of a block of distinct vectors for each query: query, vec_id, score."""
    out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
    vectors = np.stack(block["v"].to_numpy()).astype(np.float64)
    ids = block["ids"].to_numpy()
    size, norm = np.array([len(x) for x in ids]), np.sqrt((vectors * vectors).sum(axis=1))
    index, unit = Index(codes.of(vectors)), vectors / norm[:, None]
    asked = np.stack(queries["v"].to_numpy()).astype(np.float64)
    for query, vector, code in zip(queries["key"], asked, codes.of(asked), strict=True):
        length = np.sqrt((vector * vector).sum())
        at = index.within(code, min(NEAR, radii.most))
        enough = size[at].sum() > k
        if enough:
            rough = np.repeat(unit[at] @ vector / length, size[at])
            to = radii.beyond(float(np.partition(rough, -k - 1)[-k - 1]))
        if not enough or to > NEAR:
            at = index.within(code, to if enough else radii.most)
        if size[at].sum() <= k:
            at = np.arange(len(vectors))
        if len(at) > k + 1:
            rough = unit[at] @ vector
            at = at[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-9 * length]
        score = np.repeat(cosine(vectors[at], vector), size[at])
        own = np.concatenate([ids[i] for i in at])
        best = np.lexsort((own, -score))[: k + 1]
        out["query"] += [query] * len(best)
        out["vec_id"] += own[best].tolist()
        out["score"] += score[best].tolist()
    return out


def usable(vectors: DataFrame, asked) -> DataFrame:
    """vec_id, v, key (a hash of v) and asked of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # no negative zeros
    some = vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    return keep(some.withColumn("key", F.xxhash64("v", F.reverse("v"))), "vectors")


def nearest(vectors: DataFrame, asked, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each usable row that the condition `asked` selects."""
    rows = usable(vectors, asked)
    lengths = [r[0] for r in rows.groupBy(F.size("v")).agg(F.max("asked").alias("some")).where("some").orderBy(F.size("v")).collect()]  # a row a length
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_nearest(rows.where(F.size("v") == n), k, recall) for n in lengths]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, k: int, recall: float) -> DataFrame:
    """nearest() of usable rows of one length, queries among them."""
    import pandas as pd

    least = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    distinct = keep(least.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("v").alias("v")).join(rows.groupBy("key").agg(F.max("asked").alias("asked")).hint("merge"), "key"), "distinct")
    n, n_asked, width = distinct.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.max(F.size("v"))).first()
    sample = np.array([r.v for r in distinct.orderBy("key").limit(SAMPLE).collect()], dtype=np.float64)
    codes = Codes(sample)
    radii = Radii(codes, sample[np.random.default_rng(3).permutation(len(sample))], k, recall)
    n_blocks, n_query_blocks = -(-n * width // BLOCK), -(-n_asked * width // QUERY_BLOCK)

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = not len(queries) or not len(block)
        return pd.DataFrame({"query": [], "vec_id": [], "score": []} if none else search_block(codes, radii, k, queries, block))

    dealt = lambda of, parts: F.pmod(F.xxhash64(F.lit(of), "key"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = distinct.where("asked").select("key", "v", dealt("q", n_query_blocks).alias("q"), every(n_blocks).alias("b"))
    right = distinct.select("ids", "v", dealt("b", n_blocks).alias("b"), every(n_query_blocks).alias("q"))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, "query long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    own = rows.where("asked").select("key", F.col("vec_id").alias("query_id")).join(best.hint("merge"), F.col("key") == F.col("query"))
    # the query's own row is one of its vector's, at the place of its id; where that is none of the best, the last of them goes
    at = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
    rest = F.filter("best", lambda x, i: (i + 1) != F.when(at > 0, at).otherwise(k + 1))
    out = own.select("query_id", F.posexplode(rest).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
