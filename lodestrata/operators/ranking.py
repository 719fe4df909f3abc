"""Latest, first, top-k, quota selection, samples and splits: windows over an explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in order."""
    return top_k(df, by, [F.desc_nulls_last(c) for c in order], 1)


def earliest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return top_k(df, by, [F.asc_nulls_last(c) for c in order], 1)


def quota_top_k(df: DataFrame, by: str, cls: str, quotas: dict[str, int], order: list[Column], k: int) -> DataFrame:
    """k rows of each group: first up to so many of each class, then by order. No row below the k-th of its group and class
    can be among them, so these alone are ranked over the group; Spark cuts them before the shuffle."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(cls)), F.lit(0)) if quotas else F.lit(0)
    most = max([k, *quotas.values()])
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by, cls).orderBy(*order))).where(F.col("_r") <= most)
    ranked = ranked.withColumn("must_include", F.col("_r") <= quota).drop("_r")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("must_include"), *order))).where(F.col("rank") <= k)


def average_rank(x: str, by: list[str]) -> Column:
    """Ranks from 1, ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of each group over rows where both are numbers; null where one is constant."""
    sound = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})")
    ranks = sound.select(*by, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y"))
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranks.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


def overlap(df: DataFrame, x: str, y: str, tie: str, by: list[str], k: int) -> DataFrame:
    """Share of the top k by x that are also among the top k by y."""
    r = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), tie))
    both = df.select(*by, r(x).alias("_x"), r(y).alias("_y"))
    return both.groupBy(*by).agg((F.sum(F.when((F.col("_x") <= k) & (F.col("_y") <= k), 1).otherwise(0)) / F.least(F.lit(k), F.count("*"))).alias("overlap"))


def hash_order(seed: str, key: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def _hashed(df: DataFrame, by: list[str], seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """df with _hash and _part (one of 4096 by the hash), and for each stratum and part _before (rows of the parts before
    it) and _all (rows of the stratum)."""
    rows = df.withColumn("_hash", hash_order(seed, key)).withColumn("_part", F.substring("_hash", 1, 3))
    n = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # 4096 rows a stratum
    return rows, n.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))


def _met(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(parts[c]) for c in [*by, "_part"]])
    return rows.join(parts, on).drop(*[parts[c] for c in [*by, "_part"]])


def stratified(df: DataFrame, by: str, quotas: dict, seed: str, key: str) -> DataFrame:
    """So many rows of each stratum, at random but reproducibly. Only the parts of a stratum that its quota reaches are
    sorted, each on its own."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(by)), F.lit(0))
    rows, parts = _hashed(df, [by], seed, key)
    near = _met(rows, parts.where(F.col("_before") < quota), [by])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_part").orderBy("_hash", key))
    return near.withColumn("_r", place).where(F.col("_r") <= quota).drop("_r", "_hash", "_part", "_before", "_all")


def split(df: DataFrame, by: list[str], shares: dict[str, float], seed: str, key: str) -> DataFrame:
    """Column split: each stratum dealt by exact shares in a reproducible random order. A stratum is sorted part by part."""
    rows, parts = _hashed(df, by, seed, key)
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_hash", key))
    df = _met(rows, parts, by).withColumn("_place", (F.col("_before") + own - 1) / F.col("_all"))
    place = F.col("_place")
    out, upto = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())[:-1]):
        upto = sum(v for n, v in list(shares.items())[: list(shares).index(name) + 1])
        out = F.when(place < round(upto, 9), name).otherwise(out)
    return df.withColumn("split", out).drop("_place", "_hash", "_part", "_before", "_all")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Columns of sums over all rows up to each in order (ties as they come). Rows are summed within ranges of the order and
    ranges follow on from the sums before them, so no task gets all rows."""
    spread = df.withColumns({f"_x_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = spread.groupBy("_range").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.withColumns({f"_o_{n}": F.sum(f"_x_{n}").over(own) for n in sums}).join(F.broadcast(totals), "_range")
    return placed.withColumns({n: F.col(f"_b_{n}") + F.col(f"_o_{n}") for n in sums}).drop("_range", *[f"{k}{n}" for n in sums for k in ("_x_", "_o_", "_b_")])


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Column of 1, 2, ... over all rows in order."""
    return running(df, order, {name: F.lit(1)})


def kendall(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, tau (tau-b) and n of each group over rows where both are numbers; null where one is constant. A group is
    counted in one task, in n log n steps."""
    import pandas as pd

    def inversions(v: list) -> int:
        count, width, n = 0, 1, len(v)
        while width < n:
            out = []
            for lo in range(0, n, 2 * width):
                a, b, i = v[lo : lo + width], v[lo + width : lo + 2 * width], 0
                for item in b:
                    while i < len(a) and a[i] <= item:
                        out.append(a[i])
                        i += 1
                    count += len(a) - i
                    out.append(item)
                out += a[i:]
            v, width = out, 2 * width
        return count

    def tau(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([x, y])
        n, pairs = len(part), lambda s: int((s * (s - 1) // 2).sum())
        tx, ty, both = (pairs(part.groupby(c).size()) for c in (x, y, [x, y]))
        total, swaps = n * (n - 1) // 2, inversions(part[y].tolist())
        scale = ((total - tx) * (total - ty)) ** 0.5
        value = (total - tx - ty + both - 2 * swaps) / scale if scale else None
        return pd.DataFrame([[*part[by].iloc[0], value, n]], columns=[*by, "tau", "n"])

    sound = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})").select(*by, x, y)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sound.select(*by).schema.fields) + ", tau double, n long"
    return sound.groupBy(*by).applyInPandas(tau, schema)
