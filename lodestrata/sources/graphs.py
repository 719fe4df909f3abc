"""Graphs made up: random and regular families, toys, and costs. All draws are hashes of a seed, so every run agrees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small graphs with known answers.
TOYS = {
    "path_10": [(i, i + 1) for i in range(9)],
    "star_10": [(0, i) for i in range(1, 10)],
    "two_triangles_bridge": [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)],
    "square_with_diagonals": [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (1, 3)],
    "two_cliques_two_bridges": [*((a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)), (0, 5), (1, 6)],
}


def share(seed: int, *keys) -> Column:
    """A number of (0, 1) for the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _arcs(df: DataFrame) -> DataFrame:
    return df.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def toy(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(TOYS[name], "src long, dst long")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Every pair with probability p. Each node draws the gaps to its next partners, so the work is the edges, not the pairs."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                rng, out, j = np.random.default_rng([seed, int(i)]), [], int(i)
                while p > 0:
                    j += 1 if p >= 1 else int(math.log(1 - rng.random()) / math.log1p(-p)) + 1
                    if j >= n:
                        break
                    out.append((int(i), j))
                yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return spark.range(n).mapInPandas(run, "src long, dst long")


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> DataFrame:
    """A ring in which each node has the k // 2 next ones on either side; each edge gets a new end with probability p."""
    i, j = F.col("id"), F.col("j")
    ring = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    moved = F.pmod(F.xxhash64(F.lit(seed + 1), i, j), F.lit(n))
    return _arcs(ring.select(i.alias("src"), F.when(share(seed, i, j) < p, moved).otherwise((i + j) % n).alias("dst")))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Nodes come one after another and join m others by their degree; that is one after another by its nature, so it runs on
    the driver, for 10^6 edges at most."""
    if n * m > 1_000_000:
        raise ValueError("at most 10^6 edges")
    rng, ends, rows = np.random.default_rng(seed), list(range(m)), []
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(int(ends[rng.integers(len(ends))]))
        rows += [(u, v) for u in sorted(chosen)]
        ends += [*chosen, *[v] * m]
    return spark.createDataFrame(rows, "src long, dst long")


def balanced_tree(spark: SparkSession, r: int, height: int) -> DataFrame:
    n = sum(r**h for h in range(height + 1))
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / r).alias("src"), F.col("id").alias("dst"))


def random_costs(arcs: DataFrame, law: str = "lognormal", seed: int = 0, by_median: bool = False, eps: float = 1e-9) -> DataFrame:
    """arcs with cost and cond = 1 / (cost + eps). Laws: lognormal (0, 0.5), uniform (0.5 to 1.5), exponential (1, plus eps)."""
    u, v = share(seed, "src", "dst"), share(seed + 1, "src", "dst")
    laws = {"lognormal": F.exp(0.5 * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)), "uniform": u + 0.5, "exponential": -F.log(u) + eps}
    if law not in laws:
        raise ValueError(f"no law {law}: {', '.join(laws)}")
    out = arcs.withColumn("cost", laws[law])
    if by_median:
        out = out.withColumn("cost", F.col("cost") / out.agg(F.median("cost").alias("m")).scalar())
    return out.withColumn("cond", 1 / (F.col("cost") + eps))
